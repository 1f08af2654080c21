"""Byte-level BPE encoding and decoding with a given public vocabulary.

A word is a doubly linked list of symbols; a priority queue holds the merge rank of every
adjacent pair. The lowest rank, leftmost first, is merged; entries whose symbols have
changed meanwhile are stale and skipped. Decoding concatenates vocabulary strings.

Words repeat, so each Python worker keeps a bounded table of encoded words; it only saves
time. Texts travel in Arrow batches and are handled in slices, so memory is bounded by the
longest text. There is no shuffle.

Defined results: a null text is an empty one and gives no ids; other columns pass through
(an existing column named like an output is replaced); rows repeat as they come.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the byte-level scheme: its splitting pattern, with white space spelt out.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
KEPT_WORDS, SLICE_CHARS = 150_000, 2_000_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in vocabulary strings: visible Latin-1 characters
    stand for themselves, the rest follow from 256 in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in seen}
    table |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in table)}
    return [table[b] for b in range(256)]


class Codec:
    """Vocabulary, merges and added tokens of one tokenizer file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        vocab = model["vocab"]
        symbols = byte_symbols()
        self.first = [vocab[s] for s in symbols]  # byte -> id
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        of = {s: b for b, s in enumerate(symbols)}
        self.strings = {i: bytes(of[c] for c in s) for s, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.kept: dict[str, tuple[int, ...]] = {}

    def word(self, text: str) -> tuple[int, ...]:
        ids = [self.first[b] for b in text.encode("utf-8", "replace")]
        n, merges = len(ids), self.merges
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(found[0], i, a, b, found[1]) for i, (a, b) in enumerate(pairwise(ids)) if (found := merges.get((a, b)))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b, made = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((made, ids[k])):
                    heapq.heappush(queue, (found[0], i, made, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], made))):
                heapq.heappush(queue, (found[0], h, ids[h], made, found[1]))
        return tuple(x for x in ids if x >= 0)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        kept = self.kept
        for part in self.cut.split(text) if self.cut and any(s in text for s in self.added) else (text,):
            if part in self.added:
                out.append(self.added[part])
                continue
            for w in self.split.findall(part):
                ids = kept.get(w)
                if ids is None:
                    ids = self.word(w)
                    if len(w) <= 64:
                        if len(kept) >= KEPT_WORDS:
                            kept.clear()
                        kept[w] = ids
                out += ids
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(name: str) -> Codec:
    with open(SparkFiles.get(name)) as f:
        return Codec(f.read())


def _share(df: DataFrame, path: str) -> str:
    """Hand the tokenizer file to the executors and return its name there."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most SLICE_CHARS of text, or one row."""
    at = batch.schema.get_field_index(column)
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()):
        if held and held + n > SLICE_CHARS:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _mapped(df: DataFrame, columns: list[str], read: str, fields: list, make) -> DataFrame:
    """Pass ``columns`` through and add ``fields``, which ``make`` computes for each slice."""
    names = [c for c in columns if c not in [n for n, _, _ in fields]]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + [f"`{n}` {kind}" for n, kind, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, read):
                made = make(part.column(part.schema.get_field_index(read)))
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in names], *[pa.array(v, kind) for v, (_, _, kind) in zip(made, fields, strict=True)]], [*names, *[n for n, _, _ in fields]])

    return df.select(*dict.fromkeys([*names, read])).mapInArrow(run, schema)


IDS = ("ids", "array<int>", pa.list_(pa.int32()))


def encode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) and ``ids``."""
    name = _share(df, path)
    return _mapped(df, keep if keep is not None else df.columns, text, [IDS], lambda col: [[_codec(name).encode(t or "") for t in col.to_pylist()]])


def decode(df: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``decoded``, the text of ``ids`` (null ids: empty)."""
    name = _share(df, path)
    keep = keep if keep is not None else df.columns
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep if c != "decoded"] + ["decoded string"])

    def run(batches):
        codec = _codec(name)
        for batch in batches:
            texts = [codec.decode(x or ()) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            cols = [c for c in keep if c != "decoded"]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in cols], pa.array(texts, pa.string())], [*cols, "decoded"])

    return df.select(*dict.fromkeys([*keep, ids])).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, ``ids`` and ``decoded``, encoded and decoded again in one pass."""
    name = _share(df, path)

    def make(col):
        codec = _codec(name)
        ids = [codec.encode(t or "") for t in col.to_pylist()]
        return ids, [codec.decode(x) for x in ids]

    return _mapped(df, keep if keep is not None else df.columns, text, [IDS, ("decoded", "string", pa.string())], make)


def digests(df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of a round trip, computed by Spark."""
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
