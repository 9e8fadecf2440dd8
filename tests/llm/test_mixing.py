"""Mixing against a plain version: targets by repeated clamping with fractions, places by sorting."""

import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from tribuna.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, at string, whole string, target string, `_d` int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", "y", "z", 3) for i, t, s in rows], SCHEMA)


def plain(rows, weights=(5, 2, 1), percent=150, epochs=2):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += size(t)
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, capped = Fraction(percent * sum(total.values()), 100), set()
    while True:
        free = [s for s in names if s not in capped]
        left = budget - sum(epochs * total[s] for s in capped)
        target = {s: Fraction(epochs * total[s]) if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        above = {s for s in free if target[s] > epochs * total[s]}
        if not above:
            break
        capped |= above
    out = []
    for s in names:
        own = sorted((hashlib.md5(f"{mixing.SEED}|{'' if i is None else i}|{t or ''}".encode()).hexdigest(), size(t), i) for i, t, x in rows if x == s)
        whole, rest = divmod(int(target[s]), total[s]) if total[s] else (0, 0)
        copies = [h for h, z, _ in own if z]
        for k, (h, z, i) in enumerate(own):
            if k == 0 or own[k - 1][0] != h:
                before = rest
                rest -= z * own.count((h, z, i)) if z else 0
            n = copies.count(h)
            part = 0 if not z or before <= 0 else min(z, before // n)
            out.append((i, z, total[s], float(target[s]), whole * z + part))
    return sorted(out, key=repr)


def cases():
    rows = [(i, "w " * (i % 17), f"s{i % 5}") for i in range(300)] + [(i, "a b\tc\x0bd " * 3 + " x", None) for i in range(300, 340)]
    rows += [(400 + i, "long " * 5000, "big") for i in range(3)] + [(None, "one two", "s1"), (7, "same words here", "s2"), (7, "same words here", "s2"), (7, "same words here", "s2"), (9, None, "s3"), (10, "", "s4"), (11, None, "empty"), (12, "é ü", "é")]
    return rows


@pytest.mark.parametrize("weights,percent,epochs", [((5, 2, 1), 150, 2), ((1,), 200, 2), ((1, 50), 90, 1), ((3, 1), 40, 4)])
def test_targets_and_places(spark, weights, percent, epochs):
    got = mixing.mix(docs(spark, cases()), weights, percent, epochs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, got), key=repr) == plain(cases(), weights, percent, epochs)


def test_copies_at_the_end(spark):
    rows = [(1, "a b c d e", "x")] * 40 + [(2, "a b", "y")] * 3
    got = mixing.mix(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == sorted(plain(rows))
    assert len({(r.doc_id, r.taken) for r in got}) == 2


def test_sources_meet_their_targets_and_reruns_agree(spark):
    a = mixing.mix(docs(spark, cases())).collect()
    b = mixing.mix(docs(spark, cases()).repartition(7)).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))
    taken, target = defaultdict(int), {}
    for r in a:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - target[s]) <= 3 for s in target)
    assert sorted(map(repr, mixing.mix(docs(spark, cases()), seed="other").collect())) != sorted(map(repr, a))


def test_mixed_documents(spark):
    want, got = defaultdict(int), defaultdict(int)
    for r in mixing.mix(docs(spark, cases())).collect():
        want[(r.doc_id, r.source)] += r.taken
    df = mixing.mixed_documents(docs(spark, cases()))
    assert df.columns == [*docs(spark, []).columns, "repetition"]
    for r in df.collect():
        got[(r.doc_id, r.source)] += len(r.text.split())
    assert got == {k: n for k, n in want.items() if n}


def test_empty_and_impossible(spark):
    assert mixing.mix(docs(spark, [])).collect() == [] and mixing.mixed_documents(docs(spark, [])).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(docs(spark, []), percent=300, epochs=2)
