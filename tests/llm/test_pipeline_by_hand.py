"""The registered corpus queries on the test tables, and the whole pipeline against a plain version."""

import hashlib
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sitegrid.llm import langid, mixing, queries
from tests.llm.test_corpus import SPACE, brute_grams, brute_language, brute_ranked, shingles


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    """Every row of the intended table, and the rows of its SQL where there is one."""
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else int(v) if isinstance(v, bool) else v
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in queries.SQL:
        con = duckdb.connect()
        for f in Path(sf_dir).glob("*.parquet"):
            con.execute(f"create view {f.stem} as select * from '{f}'")
        res = con.execute(queries.SQL[name])
        names = [c[0] for c in res.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)
    elif "doc_id" in cols:
        assert Counter(r[cols.index("doc_id")] for r in got) == Counter(r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect())
    else:
        assert len(got) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def by_language(rows, size=langid.PROFILE):
    held_out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    counts: dict = {}
    for i, text, lang, _ in rows:
        if i is not None and not held_out(i) and text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(brute_grams(text))
    profiles = {lang: brute_ranked(c, size) for lang, c in counts.items()}
    keep = lambda r: (lambda found: found[0] != "und" and found[1] >= langid.LEAST_SCORE)(brute_language(r[1], profiles, size))
    return [r for r in rows if keep(r)]


def by_bytes(rows):
    best: dict = {}
    for n, r in enumerate(rows):
        rank = (-len(r[1]), r[0] is None, r[0] or 0, n)
        key = SPACE.sub("", r[1])
        if key not in best or rank < best[key][0]:
            best[key] = (rank, r)
    return [r for _, r in best.values()]


def by_shingles(rows, words, percent):
    sets = {r[0]: shingles(r[1], words) for r in rows if r[0] is not None}
    head = {i: i for i in sets}

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    owners: dict = {}
    for i, s in sets.items():
        for x in s:
            owners.setdefault(x, []).append(i)
    tried = set()
    for ids in owners.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if (a, b) not in tried:
                    tried.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = top(a), top(b)
                        head[max(x, y)] = min(x, y)
    return [r for r in rows if r[0] is None or top(r[0]) == r[0]]


def by_fair_queue(rows):
    """Texts as the mix takes them: finish times sorted, the budget spent one document at a time."""
    words = lambda t: [w for w in SPACE.split(t) if w]
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, held = sum(size.values()), {}
    while True:
        level = (total - sum(held.values())) / sum(weight[s] for s in names if s not in held)
        new = {s: 3 * size[s] for s in names if s not in held and weight[s] * level > 3 * size[s]}
        if not new:
            break
        held |= new
    queue = []
    for s in names:
        own = [(hashlib.md5((f"{mixing.SEED}:{r[0]}" if r[0] is not None else str(mixing.SEED)).encode()).hexdigest()[:16], -1 if r[0] is None else r[0], len(words(r[1])), r) for r in rows if r[3] == s]
        own.sort(key=lambda x: x[:3])
        seen = 0
        for u, i, n, r in own:
            seen += n
            queue += [((seen + e * size[s]) / held.get(s, weight[s] * level), u, len(queue), n, r) for e in range(mixing.EPOCHS)]
    left, out = total, []
    for *_, n, r in sorted(queue, key=lambda x: x[:3]):
        if left <= 0:
            break
        out.append((r[0], r[1] if n <= left else " ".join(words(r[1])[:left])))
        left -= n
    return out


def test_pipeline_is_its_stages_by_hand(spark, sf_dir, tmp_path):
    odd = [(70_000, "Съешь же ещё этих мягких французских булок", "en", "src1"), (70_001, None, "en", "src1"), (70_002, "", None, None), (70_003, "the end of the story " * 3000, "en", None), (70_004, " the end of the  story" * 3000, "en", None), (None, "The only one that has no name, of the old house and the sea", "en", "src2")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = docs.union(spark.createDataFrame(odd, docs.schema)).union(docs.limit(3)).withColumns({"n_chars": F.length("text").cast("long"), "size": F.lit("clash"), "digest": F.lit(1)})
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()]
    rows = by_language(rows)
    assert {r[0] for r in rows} & {i for i, *_ in odd} == {70_003, 70_004, None}
    rows = by_shingles(by_bytes(rows), corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in by_fair_queue(rows):
        ids = lib.encode(text, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert Counter(map(tuple, got.collect())) == want


def test_mixing_deals_texts_out_once(spark, tmp_path):
    """Documents meet what is taken of them by one shuffle of the texts; rows that share identifiers get their own repeats."""
    from sitegrid.llm import mixing

    rows = [(i // 2 if i % 5 else None, " ".join(["w"] * (1 + i % 4)), ("a", "b", "c", None)[i % 4]) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs, key = spark.read.parquet(str(tmp_path / "d")), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        out = mixing.mixed_documents(docs)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
        got = out.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    finally:
        spark.conf.set(key, before)
    want = {r.source: r.n for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert {r.source: r.n for r in got} == {k: v for k, v in want.items() if v}
