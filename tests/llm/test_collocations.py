"""Collocations against counting every span, and the graph against its edges."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitegrid.llm import collocations as co

SCHEMA = "doc_id long, lang string, text string, gram string, words int, n long, phrase string, score int"


def rows():
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(30)] + ["Été", "漢字", "x y", "a'b"]
    weights = 1 / np.arange(1, len(words) + 1)
    prose = lambda n: "".join(f"{w}{rng.choice([' ', ' ', ' ', chr(9), '  ', ', ', '.', chr(10)])}" for w in rng.choice(words, n, p=weights / weights.sum()))
    passage = " ".join(f"p{i}" for i in range(40))
    out = [("en", prose(400)) for _ in range(12)] + [("fr", prose(300)) for _ in range(6)] + [(None, prose(200))] * 3
    out += [("en", f"{prose(5)} {passage} {prose(5)}") for _ in range(9)] + [("de", "Go GO go go " * 300), ("de", "one. two. three"), ("und", prose(300))]
    out += [("en", None), ("en", ""), (None, None), ("fr", " \t\n .;!"), ("es", "x" * 3000), ("", "empty lang name " * 4), ("en", prose(30_000))]
    return [(i, lang, text, "clash", 1, 2, "x", 3) for i, (lang, text) in enumerate(out)]


def brute(table, least, shown):
    runs, total = [], Counter()
    for _, lang, text, *_ in table:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            runs.append((lang or "und" if lang is None else lang, w))
            total[runs[-1][0]] += len(w)
    f = Counter((lang, tuple(w[i : i + k])) for lang, w in runs for k in range(1, 6) for i in range(len(w) - k + 1))
    f = {g: n for g, n in f.items() if n >= least}
    inside = lambda g, h: any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
    found: dict = {}
    for (lang, g), a in f.items():
        if len(g) < 2 or any(x == lang and len(h) > len(g) and n >= a and inside(g, h) for (x, h), n in f.items()):
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, x in found.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:shown])}


@pytest.mark.parametrize(("least", "bits", "slice_", "shown"), [(8, 20, 1_000_000, 2000), (20, 8, 700, 7), (8, 1, 97, 2000)])
def test_collocations_are_those_of_all_spans(spark, monkeypatch, least, bits, slice_, shown):
    """Whatever the sketch lets through and wherever texts are sliced."""
    monkeypatch.setattr(co, "sketch_bits", lambda docs: bits)
    monkeypatch.setattr(co, "CHUNK", 64)
    monkeypatch.setattr(co, "SLICE", slice_)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    assert {tuple(r) for r in co.collocations(df, least, shown).collect()} == brute(rows(), least, shown)


def test_numbers_past_64_bits(spark):
    """Scores stay exact where products have more than 19 digits."""
    a, n, left, right = 3_000_000_007, 9_000_000_000_001, 4_000_000_009, 5_000_000_011
    text = spark.createDataFrame([("en", "b c", 2, a), ("en", "b", 1, left), ("en", "c", 1, right)], "lang string, phrase string, words int, n long")
    total = spark.createDataFrame([("en", n)], "lang string, n long")
    real = co.phrase_counts
    try:
        co.phrase_counts = lambda *_: (text, total)
        got = co.collocations(spark.createDataFrame([], SCHEMA)).collect()
    finally:
        co.phrase_counts = real
    assert [r.score for r in got] == [1000 * a * n // (left * right)]


def test_paths_hold_every_edge_once(spark):
    made = [(f"a{i} a{i + 1} a{i + 2}", 5) for i in range(40)] + [("a41 a42 b", 5), ("b a b", 2), ("a b a", 2), ("x y z", 1), ("q y z", 1), ("y z w", 2)]
    edges = spark.createDataFrame([(lang, g, n) for lang in ("en", "fr") for g, n in made], "lang string, gram string, n long")
    got = co.compacted(edges, 3).collect()
    spans = Counter()
    for r in got:
        w = r.path.split(" ")
        spans.update((r.lang, " ".join(w[i : i + 3]), r.n) for i in range(len(w) - 2))
    assert spans == Counter((r.lang, r.gram, r.n) for r in edges.collect())
    assert len(got) < 20 and {r.path for r in got} >= {"x y z", "q y z", "y z w"}


def test_empty_tables(spark):
    assert co.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert co.collocations(spark.createDataFrame([(1, "en", None, "", 1, 1, "", 1)], SCHEMA)).count() == 0
