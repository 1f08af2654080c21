"""The Merkle manifest against a version that builds every tree in one list."""

import hashlib
import zlib
from collections import Counter

import pytest

from sitegrid.llm import merkle
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place string, tree int, block int, digest string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(r, text):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], text)))


def climb(nodes):
    """Levels from the nodes to the root, and for each node its siblings left and right, level by level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    sides = []
    for at in range(len(nodes)):
        own = []
        for level in levels[:-1]:
            run = range(at // 3 * 3, min(at // 3 * 3 + 3, len(level)))
            own.append(("".join(level[i] for i in run if i < at), "".join(level[i] for i in run if i > at)))
            at //= 3
        sides.append(own)
    return levels[-1][0], sides


def brute(rows):
    trees: dict = {}
    for r in rows:
        trees.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    if not rows:
        return Counter()
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {s: climb([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    root, over = climb([grown[s][0] for s in names])
    out = Counter()
    for s, above in zip(names, over, strict=True):
        subroot, sides = grown[s]
        for (_, _, digest, r), own in zip(sorted(trees[s], key=lambda x: x[:3]), sides, strict=True):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            at = leaf(r, text)
            for left, right in own + above:
                at = sha(left + at + right)
            out[(r[0], digest, subroot, root, sha("".join(a + b for a, b in own + above)), at, at == root)] += 1
    return out


def rows():
    odd = [
        (7, None, None, None, None), (8, "", "", "", 0), (None, "no id\n", "en", "a", 6), (None, None, None, "a", None), (9, "é\n漢\x00 x", "fr", "é", 5),
        (10, "w " * 200_000, "en", "a", 400_000), (11, "same\n", "en", "a", 5), (11, "same\n", "en", "a", 5), (11, "other\n", "en", "a", 6), (12, "alone\n", "en", "zz", 6), (-3, "minus\n\n", "en", "Z", 7),
    ]
    many = [(1000 + i * 7 % 2500, f"text {i}\n" * (i % 3), "en", "hot", i) for i in range(2500)]
    return [(*r, "clash", 1, 2, "x") for r in odd + many]


def run(df):
    return merkle.manifest(df, merkle.drop_newlines(F.col("doc_id"), F.col("text")))


def test_manifest_is_the_plain_tree(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = run(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = Counter(map(tuple, got.collect()))
    assert found == brute(rows())
    assert {r[-1] for r in found} == {True, False}
    assert all(r.verified for r in merkle.manifest(df).collect())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 728, 729, 730, 2187, 2188])
def test_sizes_of_one_tree(spark, n):
    """Lone rows, and trees of one superblock, exactly one, and one row more."""
    made = [(i, f"t{i}\n", "en", "s", 3, "", 0, 0, "") for i in range(n)]
    assert Counter(map(tuple, run(spark.createDataFrame(made, SCHEMA)).collect())) == brute(made)


def test_many_sources(spark):
    """The tree over the sources has several superblocks."""
    made = [(i, f"t{i}\n", "en", f"s{i % 900}", 3, "", 0, 0, "") for i in range(1000)]
    assert Counter(map(tuple, run(spark.createDataFrame(made, SCHEMA)).collect())) == brute(made)
