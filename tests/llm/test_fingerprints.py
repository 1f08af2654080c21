"""Prefix hashes, extensions, fingerprints and the pairs of neighbours against plain string work."""

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sitegrid.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, id string, hash int, place string, part int, guest string"


def rows():
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(60)]
    prose = lambda n: " ".join(rng.choice(words, n))
    base = prose(400)
    texts = ["", None, "a", "ab", "é漢\U0001f600 x", base, base, base[:1500] + " new " + base[1520:], prose(300), "same line\n" * 500, "same line\n" * 501, prose(60_000), " \t\n", base[700:] + base[:700], "abcdefgh"]
    out = [(i * 5, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None), (20, "twice"), (20, "twice"), (20, "other"), (2**60 + 1, "large id"), (-4, "minus")]
    return [(*r, "clash", 1, "x", 2, "y") for r in out]


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_spans_and_extensions():
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abé漢\U0001f600"), 3000)) + "x" * 70_000 + "tail"
    other = "zz" + text[1000:2500] + "y" + text[60_000:]
    x, y = fp.Prefixes.of(text), fp.Prefixes.of(other)
    assert x.n == len(text)
    for i, j in rng.integers(0, 3000, (200, 2)).tolist() + [(0, 2), (1000, 2), (66_000, 1800), (3000, 70_000)]:
        want = common(text[i:], other[j:]) if j <= len(other) else 0
        assert x.extension(i, y, j) == want
        assert x.extension_left(i, y, min(j, y.n)) == common(text[:i][::-1], other[: min(j, y.n)][::-1])
    spans = {text[i : i + 5]: h for i, h in enumerate(x.spans(np.arange(3000), np.arange(3000) + 5).tolist())}
    assert len(set(spans.values())) == len(spans)
    joined = x.joined(2000, y, 500)
    want = fp.Prefixes.of(text[:2000] + other[:500])
    assert all((a == b).all() for a, b in zip(joined.arrays, want.arrays, strict=True))


def test_powers_beyond_a_table():
    at = np.array([0, 1, 65_535, 65_536, 200_003])
    for k, p in enumerate(fp.PRIMES):
        assert fp.powers(k, at).tolist() == [pow(fp.BASES[k], int(i), p) for i in at]
        assert fp.powers(k, at, True).tolist() == [pow(fp.BASES[k], -int(i), p) for i in at]


def test_fingerprints_show_what_is_common():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(5000)]
    prose = lambda n: " ".join(rng.choice(words, n))
    printed = lambda t: fp.print_of(fp.Prefixes.of(t))
    for n in (30, 200, 3000):
        a, b = prose(n), prose(n)
        whole = printed(a)
        assert fp.text_of(fp.print_from(fp.text_of(whole))) == fp.text_of(whole) and fp.alike(whole, printed(a)) == 1
        assert fp.alike(whole, printed(b)) < 0.05
        for share in (0.25, 0.5, 0.75):
            cut = int(len(a) * share)
            for edited in (a[:cut] + b[: len(a) - cut], b[: len(a) - cut] + a[-cut:]):
                assert abs(fp.alike(whole, printed(edited)) - share) < 0.08
                assert fp.alike(whole, printed(edited)) == fp.alike(printed(edited), whole)
    a = prose(3000)
    half = len(a) // 2
    assert fp.alike(printed(a), printed(a[half:] + a[:half])) > 0.7  # moved spans are found
    assert fp.alike(printed(a), printed(a[:5000] + "inserted words " + a[5000:])) > 0.85
    line = "again and again\n" * 700
    assert 0.6 < fp.alike(printed(line), printed(line[: len(line) * 3 // 4] + prose(2000)[: len(line) // 4])) < 0.8


def test_columns(spark):
    df = spark.createDataFrame([("abcd", 1, "xbcd", 1), ("abcd", 0, "xbcd", 0), (None, 0, "x", 0), ("abc", 9, "abc", 0)], "a string, i int, b string, j int")
    got = df.select(fp.common_extension(F.col("a"), F.col("i"), F.col("b"), F.col("j")).alias("n"), fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("s")).collect()
    assert [r.n for r in got] == [3, 0, 0, 0]
    assert got[2].s == 0 and got[3].s == 1


def test_edited_pairs(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(4).write.parquet(str(tmp_path / "docs"))
    got = fp.edited_pairs(spark.read.parquet(str(tmp_path / "docs"))).collect()
    texts = [(r[0], r[1] or "") for r in rows()]
    # rows of one identifier are ordered by their hashes
    code = dict(spark.createDataFrame([(t,) for t in {t for _, t in texts}], "t string").select("t", F.xxhash64("t")).collect())
    texts.sort(key=lambda r: (r[0] is not None, r[0] or 0, code[r[1]]))
    want = Counter()
    for (i, t), (_, after) in zip(texts, texts[1:] + texts[:1], strict=True):
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), common(t, edited), common(t, after), t == edited, t == after)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.edited_prefix, r.next_prefix, r.near_edited == 1, r.near_next == 1) for r in got) == want
    by_text = {}
    assert len({r.fingerprint for r in got}) == len({t for _, t in texts})
    for r in got:
        assert by_text.setdefault((r.doc_id, r.n_chars, r.fingerprint), r.fingerprint) == r.fingerprint
        assert (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint) and 0 <= r.near_next <= 1
        if r.n_chars > 300:
            assert r.near_edited >= 0.75 - 1 / 8
    assert fp.edited_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    one = fp.edited_pairs(spark.createDataFrame([rows()[5]], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1
