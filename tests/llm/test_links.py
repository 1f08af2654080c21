"""The whole similarity join against every pair of documents."""

import random
import re
from itertools import combinations

import pytest

from sitegrid.llm import jaccard, links

SCHEMA = "doc_id long, text string, class_id string, n_links int"


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(docs, words, percent):
    sets = {i: shingles(t, words) for i, t in docs if i is not None}
    name = {i: min(j for j in sets if sets[j] == s) if s else i for i, s in sets.items()}
    found, degree = {}, dict.fromkeys(sets, 0)
    for i, j in combinations(sorted(sets), 2):
        both, total = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if total and 100 * both >= percent * total:
            degree[i] += 1
            degree[j] += 1
            if name[i] != name[j]:
                found[min(name[i], name[j]), max(name[i], name[j])] = (both, total)
    return {i: (name[i], len(sets[i]), degree[i]) for i in sets}, found


def texts():
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(30))
    out = []
    for family in range(6):
        base = [word() for _ in range(40 + 20 * family)]
        for _ in range(30):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                own[rng.randrange(len(own))] = word()
            out.append((" " if rng.random() < 0.8 else "\n\t").join(own if rng.random() < 0.8 else [w.upper() for w in own]))
    out += ["x y", "X  y", "x y z", "x", "É a b c d", "é a b c d", "", None, "  \n", "same words " * 400, "same words " * 500]
    rng.shuffle(out)
    return list(enumerate(out, 3))


@pytest.mark.parametrize("words,percent,block", [(4, 85, 512), (5, 80, 8)])
def test_every_link_of_every_pair(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = texts()
    table = spark.createDataFrame([(i, t, "clash", 0) for i, t in [*docs, (None, "same words same words same words"), (None, None)]], SCHEMA).repartition(5)
    classes, pairs = links.similarity_join(table, words, percent)
    want, found = brute(docs, words, percent)
    rows = classes.collect()
    assert len(rows) == len(docs) + 2
    assert {r.doc_id: (r.class_id, r.n_shingles, r.n_links) for r in rows if r.doc_id is not None} == want
    assert all(r.class_id is None and r.n_links == 0 for r in rows if r.doc_id is None)
    assert {(r.a, r.b): (r.overlap, r.total) for r in pairs.collect()} == found and len(found) > 100
    assert all(abs(r.jaccard - r.overlap / r.total) < 1e-12 for r in pairs.collect())


def test_no_documents_no_links(spark):
    classes, pairs = links.similarity_join(spark.createDataFrame([], SCHEMA))
    assert classes.isEmpty() and pairs.isEmpty()


def test_rows_that_share_a_doc_id(spark):
    """Each row has its own set's class; the doc_id keeps the links of the set that is no copy."""
    a, b = ("one two three four five six seven eight nine ten", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20")
    rows = [(1, a), (5, a), (5, b), (9, b + " w21")]
    classes, pairs = links.similarity_join(spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA))
    assert sorted((r.doc_id, r.class_id) for r in classes.collect()) == [(1, 1), (5, 1), (5, 5), (9, 9)]
    assert (5, 9) in {(r.a, r.b) for r in pairs.collect()}
