import json

import pytest

from siftwell.sources import datasets as D


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows))


def test_beir(spark, tmp_path):
    lines(tmp_path / "corpus.jsonl", [{"_id": "d1", "title": "T", "text": "one"}, {"_id": "d2", "title": "", "text": "two"}])
    lines(tmp_path / "queries.jsonl", [{"_id": "q1", "text": "first?"}, {"_id": "q2", "text": "second?"}])
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t2\nq1\td2\t0\nq1\td9\t1\nq9\td1\t1\n")
    out = D.beir(spark, str(tmp_path))
    assert {tuple(r) for r in out["documents"].collect()} == {("d1", "T\n\none"), ("d2", "two")}
    assert [tuple(r) for r in out["sources"].collect()] == [("q1", "d1", None)] and [r.question_id for r in out["questions"].collect()] == ["q1"]
    assert {r.fate: r.n for r in out["dropped"].collect()} == {"score": 1, "document": 1, "query": 1}


def test_multihop(spark, tmp_path):
    corpus = [{"title": "Same Title!", "url": "u1", "body": "The  Fact\nis here."}, {"title": "same title", "url": "u2", "body": "Other."}]
    asked = [
        {"query": "a?", "answer": "x", "question_type": "t", "evidence_list": [{"url": "u1", "fact": "the fact is"}, {"url": "u2", "fact": "other."}]},
        {"query": "b?", "answer": "y", "question_type": "t", "evidence_list": [{"url": "u1", "fact": "not there"}]},
        {"query": "c?", "answer": "z", "question_type": "t", "evidence_list": []},
    ]
    (tmp_path / "c.json").write_text(json.dumps(corpus))
    (tmp_path / "q.json").write_text(json.dumps(asked))
    out = D.multihop(spark, f"{tmp_path}/c.json", f"{tmp_path}/q.json")
    assert {r.source_id for r in out["documents"].collect()} == {"same-title", "same-title-2"}
    assert [r.question for r in out["questions"].collect()] == ["a?"] and {r.document for r in out["sources"].collect()} == {"same-title", "same-title-2"}
    assert {r.fate: r.n for r in out["dropped"].collect()} == {"not_found": 1, "no_evidence": 1}


def test_question_set(spark, tmp_path):
    q = {"id": "q1", "question": "a", "expected_answer": "b", "expected_sources": [{"document": "d"}], "question_type": "t", "difficulty": "easy"}
    (tmp_path / "q.json").write_text(json.dumps({"questions": [q]}))
    assert D.question_set(spark, f"{tmp_path}/q.json").collect()[0].expected_sources[0].evidence is None
    (tmp_path / "two.json").write_text(json.dumps({"questions": [q, q]}))
    with pytest.raises(ValueError, match="q1"):
        D.question_set(spark, f"{tmp_path}/two.json")


def test_prompts_and_answers(spark, tmp_path):
    questions = spark.createDataFrame([(1, "a?"), (2, "b?"), (3, "c?"), (4, "d?")], "query_id long, question string")
    hits = spark.createDataFrame([(1, 2, 7, 0.5), (1, 1, 8, 0.9)], "query_id long, rank long, doc_id long, score double")
    D.export_prompts(questions, hits, spark.createDataFrame([(7, "seven"), (8, "eight")], "doc_id long, text string"), f"{tmp_path}/out")
    got = {r.id: [p.text for p in r.passages] for r in spark.read.json(f"{tmp_path}/out").collect()}
    assert got == {1: ["eight", "seven"], 2: [], 3: [], 4: []}
    rows = ['{"id": 1, "answer": "x"}', '{"id": 2, "answer": "x"}', '{"id": 2, "answer": "y"}', '{"id": 99, "answer": "x"}', "{broken", '{"id": 3}', ""]
    out = D.import_answers(spark.createDataFrame([(r,) for r in rows], "value string"), questions)
    assert [(r.id, r.answer) for r in out["answers"].collect()] == [(1, "x")]
    assert {r.kind: r.n for r in out["errors"].collect()} == {"duplicate_id": 2, "unknown_id": 1, "unreadable_line": 1, "invalid_record": 1, "missing_answer": 2}
