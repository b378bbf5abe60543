import random
import re

from siftwell.operators import claims as C

CONTEXTS = ["Claims are paid within 30 days of the report.", "The hotel limit is 1,800 dollars per night; code BWA-410.", 'It says "ten full working days" and 45 weeks.', "Claims later than 60 days and 30 weeks are refused."]


def phrases(segment):
    """Quotes, codes and numbers with the word after them, in that order."""
    flat = lambda t: re.sub(r"(?<=\d),(?=\d)", "", re.sub(r"\s+", " ", t).strip().lower())
    out = ['"' + flat(q) for q in re.findall('"([^"]+)"', segment) if len(q) >= 8 or re.search(r"\d", q)]
    rest = re.sub('"[^"]+"', " ", segment)
    out += [c.lower() for c in re.findall(r"\b[A-Z]{2,}-\d+\b", rest)]
    for m in re.finditer(r"(?<![\w.,-])\d[\d,]*(?:\.\d+)?", rest):
        number, after = m[0].rstrip(",").replace(",", ""), re.match(r"\s+([A-Za-z]+)", rest[m.end() :])
        if not re.fullmatch(r"(19|20)\d\d", number):
            out.append(f"{number} {after[1].lower()}" if after else number)
    return list(dict.fromkeys(out))


def brute(claims, contexts):
    """Repaired text, repairs and unresolved phrases, one group of markers after the other."""
    flat = [re.sub(r"(?<=\d),(?=\d)", "", re.sub(r"\s+", " ", c).strip().lower()) for c in contexts]
    has = lambda t, p: p[1:] in t if p[0] == '"' else bool(re.search(rf"(?<![\d.,]){re.escape(p)}(?!\d)", t))
    words = lambda t: set(re.findall("[a-z0-9]{4,}", re.sub(r"(?<=\d),(?=\d)", "", re.sub(r"\s+", " ", t).strip().lower())))
    text, repairs, unresolved = "", [], []
    for claim in claims:
        runs = list(re.finditer(C.MARKER_RUN, claim))
        parts = re.split(C.MARKER_RUN, claim)
        groups = []
        for i, m in enumerate(runs):
            cited = [int(n) for n in re.findall(r"\d+", m[0])]
            if all(1 <= n <= len(contexts) for n in cited):
                ahead = re.search(f"(?:{'|'.join(C.POINTERS)})$", parts[i].strip().lower())
                groups.append((m.start(), m.end(), cited, parts[i + 1] if ahead else parts[i]))
        if groups and parts[0].strip() == "":
            groups = [(groups[0][0], groups[-1][1], list(dict.fromkeys(n for g in groups for n in g[2])), " ".join(parts))]
        edits = []
        for start, end, cited, segment in groups:
            picks = {}
            own = words(segment)
            for p in phrases(segment):
                if has(" ".join(flat[n - 1] for n in cited), p):
                    continue
                holders = [n for n in range(1, len(contexts) + 1) if n not in cited and has(flat[n - 1], p)]
                if not holders:
                    continue
                scores = sorted(((len(own & words(contexts[n - 1])), n) for n in holders), reverse=True)
                if len(scores) == 1 or scores[0][0] > scores[1][0]:
                    picks[p.lstrip('"')] = scores[0][1]
                else:
                    unresolved.append((p.lstrip('"'), cited, holders))
            if picks:
                kept = [n for n in cited if any(has(flat[n - 1], p) for p in phrases(segment)) or not own or len(own & words(contexts[n - 1])) / len(own) >= 0.34]
                final = sorted(set(kept) | set(picks.values()))
                edits.append((start, end, ", ".join(f"[{n}]" for n in final)))
                repairs += [(p, cited, final) for p in picks]
        for start, end, new in reversed(edits):
            claim = claim[:start] + new + claim[end:]
        text += claim
    return text, repairs, unresolved


ANSWERS = [
    "Claims are paid within 30 days [2]. The limit is 1800 dollars [1], [3].", "The code is BWA-410 [4] and more [1].", "[1] [3] The code BWA-410 is there.", "According to [1] it takes 45 weeks.", 'They say "ten full working days" [1][2].',
    "Nothing here.", "", None, "It was 2024 [1].", "It takes 30 weeks and 60 days [1] and 45 weeks [2].", "It takes 30 hours [2].", "Paid in 30 days or 1,800 dollars [9] or so [3].", "30 [3].", "Claims of 30 [2] [3] and BWA-410 [3].", "Hotel 45 weeks [2] hotel 30 days [2] hotel [2]",
]


def test_repair(spark):
    rng = random.Random(8)
    bits = ["30 days", "1,800 dollars", "BWA-410", '"ten full working days"', "45 weeks", "claims", "hotel limit", "according to", "[1]", "[2]", "[3] and [4]", "[7]", "2024", "60 days.", "30 weeks!", "report\n"]
    answers = ANSWERS + [" ".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(150)]
    contexts = [CONTEXTS, CONTEXTS[:2], []]
    rows = spark.createDataFrame([(i, a, contexts[i % 7 % 3]) for i, a in enumerate(answers)], "i long, answer string, contexts array<string>")
    found = {r.i: r for r in C.repaired(rows).collect()}
    split = {r.i: r.c for r in rows.select("i", C.claims(C.F.coalesce("answer", C.F.lit(""))).alias("c")).collect()}
    some = 0
    for i, a in enumerate(answers):
        text, repairs, unresolved = brute(split[i], contexts[i % 7 % 3])
        got = found[i]
        assert ([tuple(x) for x in got.repairs], [tuple(x) for x in got.unresolved]) == (repairs, unresolved), a
        assert got.repaired == (text if repairs else a), a
        some += len(repairs)
    assert some > 40
