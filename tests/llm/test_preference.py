from siftwell.llm import preference as P


def brute(turns):
    sides = {True: [], False: []}
    for t, role, text, chosen in turns:
        sides[chosen].append((t, role, text))
    key = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    a, b = (sorted(sides[s], key=key) for s in (True, False))
    n = 0
    while n < min(len(a), len(b)) and a[n][1:] == b[n][1:]:
        n += 1
    show = lambda ts: "".join(f"<|{r or ''}|>\n{x or ''}<|end|>\n" for _, r, x in ts)
    runs = lambda ts: " ".join(f"0*{len(r or '') + 5} {int(r == 'assistant')}*{len(x or '') + 8}" for _, r, x in ts)
    return n, show(a[:n]), show(a[n:]), runs(a[n:]), show(b[n:]), runs(b[n:])


def test_edges(spark):
    pairs = {
        1: [(0, "user", "hi", True), (1, "assistant", "yes", True), (0, "user", "hi", False), (1, "assistant", "no", False)],
        2: [(0, "user", "only", True)],
        3: [(0, "user", "only", False)],
        4: [(0, "user", None, True), (1, None, "é", True), (0, "user", None, False), (1, None, "é", False), (2, "assistant", "more", False)],
        5: [(None, "user", "a", True), (1, "assistant", "", True), (None, "user", "a", False), (1, "assistant", "", False)],
        6: [(0, "user", "b", True), (0, "user", "a", True), (0, "user", "a", False)],
        7: [(0, "user", "x" * 100000, True), (0, "user", "x" * 100000, False), (1, "assistant", "z", True)],
        8: [(0, "user", "same", True)] * 3 + [(0, "user", "same", False)] * 2,
    }
    rows = [(p, *t, "x", "y") for p, ts in pairs.items() for t in ts] + [(None, 0, "user", "lost", True, "x", "y")]
    d = spark.createDataFrame(rows, "pair_id long, turn long, role string, text string, is_chosen boolean, a string, n string")
    got = {r.pair_id: (r.n_prompt_turns, r.prompt, r.chosen, r.chosen_mask, r.rejected, r.rejected_mask) for r in P.preferences(d).collect()}
    assert got == {p: brute(ts) for p, ts in pairs.items()}


def test_masks_cover_completions(spark):
    for r in P.op7_preference_pairs(spark, "/root/testdata/sf0.001").collect():
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert sum(int(x.split("*")[1]) for x in mask.split()) == len(text)


def test_empty(spark):
    assert P.preferences(spark.createDataFrame([], "pair_id long, turn long, role string, text string, is_chosen boolean")).count() == 0
