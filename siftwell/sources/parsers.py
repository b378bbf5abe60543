"""File bytes to text: native columns for plain text and CSV rows, pandas functions over zip-based formats."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Entries of a zip file, its compression ratio for entries of a megabyte or more, and its unpacked bytes, at most.
ZIP_ENTRIES, ZIP_RATIO, ZIP_BYTES = 10_000, 100, 512 << 20


def csv_line(fields: dict[str, Column]) -> Column:
    """ "name: value" of the fields that have one, joined by "; "."""
    return F.concat_ws("; ", *[F.when(F.trim(v) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in fields.items()])


def decoded(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1."""
    text = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(text, F.decode(content, "ISO-8859-1"))


def sniffed(content: Column, limit: int) -> dict[str, Column]:
    """status and reason of a text upload: empty, too large, or binary by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    reason = F.when(F.length(content) == 0, "empty").when(F.length(content) > limit, "too_large").when(head.startswith("255044462D") | head.startswith("504B0304") | F.contains(head, F.lit("0000")), "binary")
    return {"status": F.when(reason.isNull(), "accepted").otherwise("rejected"), "reason": reason}


def _said(paragraph: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in paragraph.iter() if t.tag.endswith("}t"))


def _rows(table: ElementTree.Element) -> list[str]:
    """Each row's cells that hold something, with bars between."""
    cells = ([" ".join(filter(None, map(str.strip, map(_said, c.iterfind(".//{*}p"))))) for c in row.findall("{*}tc")] for row in table.findall("{*}tr"))
    return [" | ".join(filter(None, row)) for row in cells if any(row)]


def _document_text(data: bytes) -> str:
    """Paragraphs that aren't blank, then the rows of the tables."""
    body = ElementTree.fromstring(data).find("{*}body")
    lines = [] if body is None else [x for x in map(_said, body.findall("{*}p")) if x.strip()]
    return "\n".join(lines + [r for t in ([] if body is None else body.findall("{*}tbl")) for r in _rows(t)])


def _slide_text(data: bytes) -> str:
    """Lines of the shapes and rows of the tables, in order."""
    lines = []
    for shape in ElementTree.fromstring(data).iterfind(".//{*}spTree/*"):
        table = shape.find(".//{*}tbl")
        lines += _rows(table) if table is not None else filter(None, (_said(p).strip() for p in shape.iterfind(".//{*}txBody/{*}p")))
    return "\n".join(lines)


def _zip_text(data: bytes, kind: str) -> str | None:
    """Text of a docx (paragraphs and tables) or pptx (slides, form feeds between); null for broken or oversized files."""
    if data is None:
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = z.infolist()
            if len(infos) > ZIP_ENTRIES or sum(i.file_size for i in infos) > ZIP_BYTES or any(i.file_size >= 1 << 20 and i.file_size > ZIP_RATIO * max(1, i.compress_size) for i in infos):
                return None
            if kind == "docx":
                return _document_text(z.read("word/document.xml"))
            slides = sorted((i.filename for i in infos if re.fullmatch(r"ppt/slides/slide\d+\.xml", i.filename)), key=lambda n: int(re.findall(r"\d+", n)[0]))
            return "\f".join(_slide_text(z.read(n)) for n in slides)
    except (zipfile.BadZipFile, zlib.error, KeyError, ValueError, EOFError, RuntimeError, ElementTree.ParseError):  # RuntimeError: encrypted, or an unknown compression
        return None


@F.pandas_udf(StringType())
def office_text(content: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([_zip_text(c, k) for c, k in zip(content, kind)])


def read_files(spark: SparkSession, path: str, limit: int = 64 << 20) -> DataFrame:
    """path, format, text, status, reason of every file under a folder. Only office files go to Python. Files that are too large,
    can't be read or are of another format come as rejected, with the reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(~F.col("path").rlike(r"/(\.|~\$)[^/]*$")).select("path", "content", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("format"))
    plain, zipped = F.col("format").isin("txt", "md", "csv"), F.col("format").isin("docx", "pptx")
    text = files.where(plain).select("path", "format", decoded(F.col("content")).alias("text"), *[c.alias(n) for n, c in sniffed(F.col("content"), limit).items()])
    office = files.where(zipped).select("path", "format", (F.length("content") > limit).alias("large"), F.when(F.length("content") <= limit, F.col("content")).alias("content"))
    office = office.select("path", "format", "large", office_text("content", "format").alias("text"))
    reason = F.when(F.col("large"), "too_large").when(F.col("text").isNull(), "unreadable")
    office = office.select("path", "format", "text", F.when(reason.isNull(), "accepted").otherwise("rejected").alias("status"), reason.alias("reason"))
    other = files.where(~plain & ~zipped).select("path", "format", F.lit(None).cast("string").alias("text"), F.lit("rejected").alias("status"), F.lit("unsupported").alias("reason"))
    return text.unionByName(office).unionByName(other)
