"""Connectors as a Spark data source: a listing is dealt to partitions by size, and each task fetches its own documents.

A connector has `list_documents()`, which gives SourceDocuments, and `fetch(source_id)`, which gives their bytes. It is sent to the tasks, so it has to be
picklable and reach its source from every executor (a mounted folder, a service).

    spark.dataSource.register(ConnectorSource)
    spark.read.format("connector").option("connector", encoded(FolderConnector("/mnt/inbox"))).load()
"""

from __future__ import annotations

import base64
import mimetypes
import os
import pickle
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Formats that are listed, and endings of files that aren't whole.
FORMATS = ("pdf", "docx", "pptx", "txt", "csv", "md")
TEMPORARY = (".tmp", ".part", ".crdownload", ".partial", ".swp")
SCHEMA = "source_id string, name string, content_type string, size_bytes long, modified_at timestamp, version string, ready boolean, content binary, error string"
#: Bytes that a task fetches, and documents, after which it takes no more.
TASK_BYTES, TASK_DOCUMENTS = 64 << 20, 10_000


@dataclass(frozen=True)
class SourceDocument:
    """source_id is stable within the connector. `ready` is false while the document is still being written."""

    source_id: str
    name: str
    content_type: str = ""
    size_bytes: int | None = None
    modified_at: datetime | None = None
    version: str = ""
    ready: bool = True


class Connector(Protocol):
    def list_documents(self) -> Iterator[SourceDocument]: ...

    def fetch(self, source_id: str) -> bytes: ...


class FolderConnector:
    """Files of known formats under a folder that all executors see. Hidden and temporary ones, and links that lead out of it, aren't listed; one that was modified less than
    `settle_seconds` ago isn't ready. A folder that isn't there is an error, not an empty listing."""

    def __init__(self, root: str, recursive: bool = True, settle_seconds: float = 5, now: float | None = None):
        self.root, self.recursive, self.settle_seconds, self.now = root, recursive, settle_seconds, now

    def _real(self) -> Path:
        if not Path(self.root).is_dir():
            raise FileNotFoundError(f"folder {self.root} does not exist or is not a directory")
        return Path(self.root).resolve()

    def list_documents(self) -> Iterator[SourceDocument]:
        real, now = self._real(), time.time() if self.now is None else self.now
        for folder, names, files in os.walk(self.root, followlinks=False):
            names[:] = sorted(n for n in names if self.recursive and not n.startswith("."))
            for name in sorted(files):
                path = Path(folder) / name
                if name.startswith((".", "~$")) or name.lower().endswith(TEMPORARY) or path.suffix.lower()[1:] not in FORMATS:
                    continue
                if path.is_symlink() and not path.resolve().is_relative_to(real) or not path.is_file():
                    continue
                at = path.stat()
                yield SourceDocument(path.relative_to(self.root).as_posix(), name, mimetypes.guess_type(name)[0] or "", at.st_size, datetime.fromtimestamp(at.st_mtime, UTC), ready=now - at.st_mtime >= self.settle_seconds)

    def fetch(self, source_id: str) -> bytes:
        real = self._real()
        path = (real / source_id).resolve()
        if not path.is_relative_to(real):
            raise PermissionError(f"{source_id} is outside the folder")
        return path.read_bytes()


def encoded(connector: Connector) -> str:
    """A connector as an option of the source."""
    return base64.b64encode(pickle.dumps(connector)).decode()


class Documents(InputPartition):
    def __init__(self, documents: list[SourceDocument]):
        super().__init__(documents)


def dealt(documents: list[SourceDocument], most_bytes: int = TASK_BYTES, most: int = TASK_DOCUMENTS) -> list[Documents]:
    """The documents in order, in parts of bounded size; one that is larger has a part of its own."""
    parts, held, size = [], [], 0
    for d in documents:
        if held and (size + (d.size_bytes or 0) > most_bytes or len(held) >= most):
            parts.append(Documents(held))
            held, size = [], 0
        held.append(d)
        size += d.size_bytes or 0
    return [*parts, Documents(held)] if held else parts


class _Reading:
    def __init__(self, options: dict):
        self.connector: Connector = pickle.loads(base64.b64decode(options["connector"]))
        self.fetching = options.get("fetch", "true").lower() == "true"
        self.limit = int(options.get("limit", 64 << 20))

    def rows(self, partition: Documents):
        """Documents that aren't ready, are larger than the limit or can't be fetched come without content, the last with the error."""
        for d in partition.value:
            content = error = None
            if self.fetching and d.ready and (d.size_bytes or 0) <= self.limit:
                try:
                    content = self.connector.fetch(d.source_id)
                except Exception as e:  # one document that can't be read doesn't end the others
                    error = f"could not fetch ({e})"
            yield d.source_id, d.name, d.content_type, d.size_bytes, d.modified_at, d.version, d.ready, content, error


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.reading = _Reading(options)

    def partitions(self):
        return dealt(list(self.reading.connector.list_documents()))

    def read(self, partition):
        return self.reading.rows(partition)


class StreamReader(DataSourceStreamReader):
    """An offset is a time of modification: a batch has what is ready and was modified after the last offset and up to its own. Times come from the source, so what
    arrives with an older one isn't seen; a full pass (`Reader` and `sync`) finds it."""

    def __init__(self, options: dict):
        self.reading = _Reading(options)

    def _changed(self, after: float, until: float) -> list[SourceDocument]:
        found = [d for d in self.reading.connector.list_documents() if d.ready and d.modified_at and after < d.modified_at.timestamp() <= until]
        return sorted(found, key=lambda d: (d.modified_at, d.source_id))

    def initialOffset(self):
        return {"until": -1.0}

    def latestOffset(self):
        return {"until": max((d.modified_at.timestamp() for d in self.reading.connector.list_documents() if d.ready and d.modified_at), default=-1.0)}

    def partitions(self, start, end):
        return dealt(self._changed(start["until"], end["until"]))

    def read(self, partition):
        return self.reading.rows(partition)


class ConnectorSource(DataSource):
    """Options: connector (as of `encoded`), fetch (false: the listing alone), limit (bytes of a document that is fetched)."""

    @classmethod
    def name(cls):
        return "connector"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)
