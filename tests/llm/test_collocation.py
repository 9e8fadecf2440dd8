"""Collocations against counting every n-gram in plain Python."""

import random
import re
from collections import Counter

import pytest

from tribuna.llm import collocation
from tribuna.llm.common import join_lookup

SCHEMA = "doc_id long, text string, lang string, words int, phrase string, f long, rank int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, 7, "x", 1, 2) for i, (t, g) in enumerate(rows)], SCHEMA)


def plain(rows, longest=5, least=100, percent=100, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, min(longest, len(w) - i) + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    out = []
    candidates = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= least}
    for (lang, w), a in candidates.items():
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        held = any(g == lang and len(v) > len(w) and 100 * b >= percent * a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (g, v), b in candidates.items())
        if not held:
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i, *x[1:]) for i, x in enumerate(own[:top], 1)]
    return sorted(ranked)


def cases():
    rnd = random.Random(1)
    word = lambda: rnd.choice(["a", "B", "ć", "Ä", "ab", "c-d", "e\x1cf", "g h", "\x00", "né", "🙂", "x'y"])
    sep = lambda: rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ?! ", "\x0b", ";"])
    rows = [("".join(word() + sep() for _ in range(rnd.randrange(60))), rnd.choice(["en", "de", None, "und", ""])) for _ in range(60)]
    rows += [("one fixed phrase of six words, and more", "en")] * 6 + [("One FIXED phrase of", "en"), (None, "en"), ("", None), (None, None), ("...,,", "xx"), ("so so so so so so so so", "fr"), ("only", "it")]
    return rows


@pytest.mark.parametrize("longest,least,percent,top", [(5, 3, 100, 2000), (5, 4, 60, 7), (2, 2, 100, 5), (3, 1, 100, 50), (1, 1, 100, 10), (6, 5, 90, 2000)])
def test_against_plain(spark, longest, least, percent, top):
    got = collocation.collocations(docs(spark, cases()).repartition(5), longest, least, percent, top).collect()
    assert sorted(map(tuple, got)) == plain(cases(), longest, least, percent, top)


def test_no_rows(spark):
    assert collocation.collocations(docs(spark, [])).collect() == []
    assert collocation.collocations(docs(spark, [(None, None), ("a b", "en")])).collect() == []
    assert collocation.collocations(docs(spark, []), 5, 1).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_score_beyond_64_bits(spark):
    n, a = 4 * 10**15, 3 * 10**15
    rows = [("en", 0, "", n), ("en", 1, "p", a + 1), ("en", 1, "q", a + 2), ("en", 2, "p q", a)]
    r = collocation.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, f long")).first()
    assert r.score == 1000 * a * n // ((a + 1) * (a + 2)) and 1000 * a * n > 2**63


def test_stretches(monkeypatch):
    monkeypatch.setattr(collocation, "STRETCH", 16)
    for text in ("a bb ccc, dddd. eeeee ffffff; ggggggg hhhhhhhh iiiiiiiii jj kk", "x" * 50 + " y z", ". . .", "a, b", "A" * 15 + ".b c"):
        words = [w for part in collocation.pieces(text) for w in part]
        assert words == text.lower().replace(",", ".").replace(";", ".").replace(".", " . ").encode().split()


def counted(lang, *texts):
    s = collocation.Slice(lang)
    for t in texts:
        s.add(t)
    return collocation.Counted(*s.written())


def bits(full):
    return collocation.Bits(15, (b"\xff" if full else b"\0") * 4096)


def test_chance_hits_change_nothing():
    """Sets that hold everything give more rows and the same counts."""
    c = counted("en", "a b c d. a b c e, a b")
    pairs = {"a b": 3, "b c": 2, "c d": 1, "c e": 1}
    triples = {"a b c": 2, "b c d": 1, "b c e": 1}
    for sets in ([bits(1)] * 2, [bits(1)] * 3):
        assert {p: f for _, _, p, f in c.runs(5, sets)} == {**pairs, **triples, "a b c d": 1, "a b c e": 1}
        assert {p: f for _, _, p, f in c.runs(2, sets)} == pairs
    assert sorted(c.hashes([bits(1)])[1].tolist()) == sorted(pairs.values())
    assert sorted(c.hashes([bits(1)] * 2)[1].tolist()) == sorted(triples.values())
    assert list(c.runs(5, [bits(1), bits(0)])) == [] and c.hashes([bits(1), bits(0)])[0].tolist() == [] and c.hashes([bits(0)])[0].tolist() == []
    assert {p: f for _, _, p, f in c.runs(5, [bits(1), bits(1), bits(0)])} == pairs
    assert not set(counted("de", "a b").hashes([bits(1)])[0].tolist()) & set(c.hashes([bits(1)])[0].tolist())


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 7])
def test_stretches_of_places_change_nothing(monkeypatch, chunk):
    c = counted("en", "a b c d a b c. b c d, a b c d e f", "x y. z")
    want = [sorted(zip(*(v.tolist() for v in c.hashes([bits(1)] * n)))) for n in (1, 2, 3)], sorted(c.runs(5, [bits(1)] * 3))
    monkeypatch.setattr(collocation, "CHUNK", chunk)
    assert ([sorted(zip(*(v.tolist() for v in c.hashes([bits(1)] * n)))) for n in (1, 2, 3)], sorted(c.runs(5, [bits(1)] * 3))) == want


def test_hashes_of_spark_and_of_tasks_agree(spark):
    rows = [("en", "a"), ("", "é🙂"), ("und", "x")]
    df = spark.createDataFrame(rows, "lang string, phrase string")
    held = collocation.Bits(*collocation.bit_set(df.select(collocation.word_hash().alias("h"))))
    for lang, word in rows:
        assert len(counted(lang, f"{word} {word}").hashes([held])[0]) == 1
    assert len(counted("en", " ".join(f"q{i}" for i in range(2000))).hashes([held])[0]) < 5


def test_lookup_by_shuffle(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(90)], "_share long, k string")
    lookup = spark.createDataFrame([("hot", 1), (None, 2), ("z", 3)], "k string, v int")
    want = sorted((i, "hot" if i % 3 else None, 1 if i % 3 else 2) for i in range(90))
    for most in (100, 2):
        got = join_lookup(df, lookup, ["k"], most)
        assert got.columns == ["_share", "k", "v"]
        assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]) == want
