"""Labels of identifiers that repeat, ties, and what the words of a text tell."""

import pytest

from sitegrid.llm import quality

SCHEMA = "doc_id long, text string, source string, lang string"


def test_an_identifier_tells_nothing_of_itself(spark, monkeypatch):
    """Three rows of one labelled identifier, in two paths of a host: none of their labels counts for any of them."""
    monkeypatch.setattr(quality, "_strength", lambda groups, around: 10.0)
    rows = [(7, "a b", "s", "p"), (7, "a b", "s", "p"), (7, "c d", "s", None), (1, "e f", "s", "p"), (2, "g h", "s", None), (3, "i j", None, "p"), (4, "k", "s", "p")]
    labels = spark.createDataFrame([(7, 1), (1, 0), (2, 1), (3, 0)], "doc_id long, quality int")
    got = quality.assess(spark.createDataFrame(rows, SCHEMA), labels).collect()
    prior = (3 + 1 + 1) / (6 + 2)
    host = (1 + 10 * prior) / (2 + 10)
    assert len(got) == len(rows)
    mine = sorted((r.path or "", r.host_posterior, r.path_posterior) for r in got if r.doc_id == 7)
    assert [m[0] for m in mine] == ["", "p", "p"]
    assert all(m[1] == pytest.approx(host) for m in mine)
    assert mine[0][2] == pytest.approx((1 + 10 * host) / (1 + 10)) and mine[1][2] == mine[2][2] == pytest.approx((0 + 10 * host) / (1 + 10))
    other = next(r for r in got if r.doc_id == 1)
    assert other.host_posterior == pytest.approx((4 + 10 * prior) / (4 + 10))


def test_quality_of_exactly_a_half_is_kept(spark):
    docs = spark.createDataFrame([(1, "a", "s", "p"), (2, None, None, None)], SCHEMA)
    got = quality.assess(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert [(r.quality, r.keep) for r in got] == [(0.5, True)] * 2


def test_words_are_evidence(spark):
    """Texts of one form and without repetition, told apart by which words they hold alone."""
    good, bad = [f"{a}{b}" for a in ("reli", "deta", "care") for b in ("ab", "cd", "ef", "gh")], [f"{a}{b}" for a in ("spam", "junk", "click") for b in ("ab", "cd", "ef", "gh")]
    text = lambda i: " ".join((bad if i % 2 else good)[(i * 5 + k * 7) % 12][:6].ljust(6, "x") for k in range(6))
    docs = spark.createDataFrame([(i, text(i), "s", "p") for i in range(200)], SCHEMA)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, quality int")
    weights = quality.fit(docs, labels.where("doc_id < 100"))
    p = {r.doc_id: r.p for r in quality.evidence(docs, weights, ["doc_id"]).collect()}
    assert all((p[i] > 0.5) == (i % 2 == 0) for i in range(100, 200))
