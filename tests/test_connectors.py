import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftwell.sources import connectors as K
from siftwell.sources import sync as S
from siftwell.streaming import events, jobs


@pytest.fixture
def inbox(tmp_path):
    root = tmp_path / "inbox"
    (root / "sub").mkdir(parents=True)
    (root / ".hidden").mkdir()
    for name, text in {"a.txt": "alpha", "sub/b.md": "beta", ".x.txt": "no", "~$c.docx": "no", "d.tmp": "no", "e.exe": "no", "f.txt.part": "no", ".hidden/g.txt": "no", "big.csv": "x" * 100}.items():
        (root / name).write_text(text)
        os.utime(root / name, (1000, 1000))
    (tmp_path / "outside.txt").write_text("secret")
    (root / "link.txt").symlink_to(tmp_path / "outside.txt")
    (root / "inner.txt").symlink_to(root / "a.txt")
    return root


def load(spark, root, **options):
    spark.dataSource.register(K.ConnectorSource)
    return spark.read.format("connector").option("connector", K.encoded(K.FolderConnector(str(root), now=2000))).options(**options).load()


def test_folder_as_a_source(spark, inbox):
    os.utime(inbox / "sub/b.md", (1998, 1998))
    found = {r.source_id: r for r in load(spark, inbox, limit=50).collect()}
    assert sorted(found) == ["a.txt", "big.csv", "inner.txt", "sub/b.md"]
    assert found["a.txt"].content == b"alpha" and found["a.txt"].ready and found["a.txt"].size_bytes == 5
    assert not found["sub/b.md"].ready and found["sub/b.md"].content is None and found["big.csv"].content is None
    assert load(spark, inbox, fetch="false").where("content IS NOT NULL").count() == 0
    with pytest.raises(Exception, match="not a directory"):
        load(spark, inbox / "none").collect()


def test_what_cannot_be_fetched_is_told(spark, inbox):
    listed = K._Reading({"connector": K.encoded(K.FolderConnector(str(inbox), now=2000))})
    parts = K.dealt(list(listed.connector.list_documents()))
    (inbox / "a.txt").unlink()
    errors = {r[0]: r[8] for p in parts for r in listed.rows(p)}
    assert errors["a.txt"].startswith("could not fetch") and errors["sub/b.md"] is None
    with pytest.raises(PermissionError):
        listed.connector.fetch("../outside.txt")


def test_listings_are_dealt_by_size():
    sizes = [10, 10, 50, 5, 5, 5, None, 1]
    parts = K.dealt([K.SourceDocument(str(i), str(i), size_bytes=n) for i, n in enumerate(sizes)], 20, 3)
    assert [[d.source_id for d in p.value] for p in parts] == [["0", "1"], ["2"], ["3", "4", "5"], ["6", "7"]] and K.dealt([]) == []


def test_folder_as_a_stream(spark, inbox, tmp_path):
    spark.dataSource.register(K.ConnectorSource)
    connector = K.encoded(K.FolderConnector(str(inbox), now=5000))

    def run():
        stream = spark.readStream.format("connector").option("connector", connector).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.source_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["a.txt", "big.csv", "inner.txt", "sub/b.md"]
    (inbox / "new.txt").write_text("new")
    os.utime(inbox / "new.txt", (1500, 1500))
    assert run() == ["a.txt", "big.csv", "inner.txt", "new.txt", "sub/b.md"] == run()


T1, T2 = datetime(2026, 1, 1), datetime(2026, 1, 2)


def test_sync_pass(spark):
    listing = spark.createDataFrame([("new", 1, T1, "", True), ("same", 1, T1, "", True), ("touched", 1, T2, "", True), ("edited", 2, T1, "", True), ("busy", 1, T1, "", False), ("huge", 99, T1, "", True), ("bad", 3, T1, "", True), ("lost", 4, T1, "", True), ("refused", 5, T1, "", True), ("mended", 6, T1, "", True)], "source_id string, size_bytes long, modified_at timestamp, version string, ready boolean")
    state = spark.createDataFrame([("same", "h0", 1, T1, "", None), ("touched", "h1", 1, T1, "", None), ("edited", "h2", 1, T1, "", None), ("busy", "h3", 9, T1, "", None), ("gone", "h4", 1, T1, "", None), ("refused", None, 5, T1, "", "binary"), ("mended", None, 5, T1, "", "binary")], "source_id string, content_hash string, size_bytes long, modified_at timestamp, version string, rejected_reason string")
    assert sorted(r.source_id for r in S.to_fetch(listing, state, 50).collect()) == ["bad", "edited", "lost", "mended", "new", "touched"]
    fetched = spark.createDataFrame([("new", "n", None, None), ("touched", "h1", None, None), ("edited", "e", None, None), ("bad", None, "binary", None), ("lost", None, None, "could not fetch (x)"), ("mended", "m", None, None)], "source_id string, content_hash string, rejected_reason string, error string")
    passed = S.sync_pass(listing, state, fetched, 50)
    got = {r.source_id: (r.status, r.reason) for r in passed.collect()}
    assert got == {"new": ("added", None), "same": ("unchanged", None), "touched": ("unchanged", None), "edited": ("updated", None), "busy": ("pending", None), "huge": ("skipped", "too_large"), "bad": ("skipped", "binary"), "lost": ("failed", "could not fetch (x)"), "refused": ("unchanged", None), "mended": ("added", None), "gone": ("deleted", None)}
    after = S.next_state(passed)
    kept = {r.source_id: (r.content_hash, r.size_bytes, r.rejected_reason) for r in after.collect()}
    assert kept == {"new": ("n", 1, None), "same": ("h0", 1, None), "touched": ("h1", 1, None), "edited": ("e", 2, None), "busy": ("h3", 9, None), "huge": (None, 99, "too_large"), "bad": (None, 3, "binary"), "refused": (None, 5, "binary"), "mended": ("m", 6, None)}
    assert sorted(r.source_id for r in S.to_fetch(listing, after, 50).collect()) == ["lost"]
    empty = {r.source_id: r.status for r in S.sync_pass(listing.limit(0), state, fetched.limit(0), 50).collect()}
    assert set(empty.values()) == {"kept"} and len(empty) == 7
    assert {r.status for r in S.sync_pass(listing, state, fetched, 50, keep_gone=True).where("source_id = 'gone'").collect()} == {"kept"}


def test_jobs_and_dead_letters(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    add = lambda name, rows: spark.createDataFrame(rows, jobs.JOBS).coalesce(1).write.mode("append").parquet(str(source))
    index = lambda df: df.select("job_id", F.when(F.col("payload") == "bad", "cannot be read").alias("error"), F.upper("payload").alias("result"))
    silent = lambda df: df.select("job_id", F.lit(None).cast("string").alias("error"), F.lit("x").alias("result")).where("job_id <> 4")

    def run(checkpoint="ck"):
        stream = spark.readStream.schema(jobs.JOBS).parquet(str(source))
        jobs.consume(stream, target, str(tmp_path / checkpoint), {"index": index, "graph": silent}, 2).awaitTermination()
        return {r.job_id: (r.status, r.attempt, r.error, r.result) for r in jobs.statuses(jobs.outcomes(spark, target), 2).collect()}

    assert jobs.outcomes(spark, target).count() == 0
    add("1", [(1, "index", 10, "ok"), (2, "index", 11, "bad"), (3, "mail", 12, None), (4, "graph", None, None), (5, "graph", 13, None), (1, "index", 10, "ok")])
    first = run()
    assert first == {1: ("done", 1, None, "OK"), 2: ("pending", 1, "cannot be read", None), 3: ("pending", 1, "no handler for job kind mail", None), 4: ("pending", 1, "the handler returned nothing", None), 5: ("done", 1, None, "x")}
    add("2", [(6, "index", 14, "fine"), (1, "index", 10, "again")])
    second = run()
    assert second[1] == first[1] and second[6] == ("done", 1, None, "FINE") and [second[i][:2] for i in (2, 3, 4)] == [("failed", 2)] * 3
    dead = {r.document_id: r.error for r in jobs.failed_documents(jobs.outcomes(spark, target), 2).collect()}
    assert dead == {11: "index failed: cannot be read", 12: "mail failed: no handler for job kind mail"}
    assert run() == second
    before = sorted(map(tuple, jobs.outcomes(spark, target).collect()), key=str)
    last = sorted((tmp_path / "ck" / "commits").glob("[0-9]*"))[-1]
    for path in (last, last.with_name(f".{last.name}.crc")):  # the last batch runs again
        path.unlink(missing_ok=True)
    assert run() == second and sorted(map(tuple, jobs.outcomes(spark, target).collect()), key=str) == before


def test_index_before_its_first_batch(spark, tmp_path):
    assert events.indexed(spark, f"file://{tmp_path}/none").count() == 0
