"""JSON objects out of texts that hold more than JSON."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

FENCED = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL)
BRACE = re.compile("[{}]")


def candidates(text: str) -> Iterator[str]:
    """What may be the object: first what stands in code fences, then the widest stretches with as many closing braces as opening ones."""
    for found in FENCED.finditer(text):
        yield found[1].strip()
    depth = start = 0
    for brace in BRACE.finditer(text):
        if brace[0] == "{":
            start = brace.start() if depth == 0 else start
            depth += 1
        elif depth > 0:
            depth -= 1
            if depth == 0:
                yield text[start : brace.end()]
        else:
            depth -= 1  # a stray one has to be opened again before a stretch can begin


def _number(digits: str) -> float | None:
    value = float(digits)
    return value if math.isfinite(value) else None


def first_object(text: str | None) -> str | None:
    """The first candidate that is a JSON object, written anew: of repeated keys the last, and null for what isn't a finite number."""
    for candidate in candidates(text or ""):
        try:
            found = json.loads(candidate, parse_float=_number, parse_constant=lambda _: None)
        except (ValueError, RecursionError):
            continue
        if isinstance(found, dict):
            return json.dumps(found)
    return None


#: Texts that a worker holds as Python strings at once.
AT_ONCE = 500


@F.arrow_udf(StringType())
def _objects(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        found = [pa.array([first_object(t) for t in texts.slice(at, AT_ONCE).to_pylist()], pa.string()) for at in range(0, len(texts), AT_ONCE)]
        yield pa.concat_arrays(found) if found else pa.array([], pa.string())
        del texts, found
        pa.default_memory_pool().release_unused()


def json_object(text: Column) -> Column:
    """The text's JSON object; null without one."""
    return _objects(text)
