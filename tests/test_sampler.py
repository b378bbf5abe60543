import random

import pytest

from siftwell.sources import sampler as S


def brute(order, relevant, limit, most):
    chosen, union = [], set()
    for q in order:
        if most is not None and len(chosen) >= most:
            break
        if limit is None or len(union | relevant[q]) <= limit // 2:
            chosen.append(q)
            union |= relevant[q]
    return sorted(chosen), union


@pytest.mark.parametrize("limit, most, seed", [(20, None, 0), (20, 3, 1), (9, None, 2), (0, None, 3), (1000, None, 4), (None, 5, 5), (None, None, 6), (41, 12, 7)])
def test_like_one_after_the_other(spark, limit, most, seed):
    rng = random.Random(seed)
    relevant = {q: set(rng.sample(range(60), rng.choice([1, 1, 2, 3, 9]))) for q in range(25)}
    pairs = [(q, d) for q, ds in relevant.items() for d in ds] + [(30, None), (None, 1)]
    relevant[30] = set()
    rows = spark.createDataFrame(pairs + pairs[:5], "query_id long, doc_id long")
    docs = spark.createDataFrame([(d,) for d in range(100)] + [(5,), (None,)], "doc_id long")
    order = [r.query_id for r in rows.where("query_id IS NOT NULL").select("query_id").distinct().orderBy(S.drawn("query_id", seed)).collect()]
    want, union = brute(order, relevant, limit, most)
    for parts in (1, 7):
        taken, sample = S.sample_corpus(rows.repartition(parts), docs.repartition(parts), limit, most, seed)
        assert sorted(r.query_id for r in taken.collect()) == want
        got = sorted(r.doc_id for r in sample.collect())
        assert union <= set(got) and len(got) == len(set(got)) == (100 if limit is None else min(limit, 100))
        if parts == 1:
            first = got
    assert first == got
    if limit:
        other = S.sample_corpus(rows, docs, limit, most, seed + 100)[1]
        assert limit > 100 or sorted(r.doc_id for r in other.collect()) != got
