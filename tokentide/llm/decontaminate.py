"""Benchmark decontamination: n-gram windows of test items found in training texts.

The windows of the benchmark are a set of 64-bit hashes that every task holds, as sorted arrays of
hash, item and place: about 16 bytes a window besides the items' text. All windows of many texts
are looked up at once, and each hit is verified word by word. The set's size is checked first: a
benchmark above ``shard_bytes`` of text is dealt to shards of about that size, and the documents
pass the shards one after another, so no task ever holds more than one shard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tokentide.llm.scratch import discard, written
from tokentide.llm.text import WORD_BYTES, alnum_words, raw
from tokentide.llm.wordhash import FACTORS, Runs, WordHashes, ranges

#: Benchmark text that one broadcast may hold; its windows take some three times as much.
SHARD_BYTES = 64 << 20
#: Texts that are looked up at a time.
TEXTS = 64

#: Columns that find_contamination adds.
ADDED = ("n_words", "n_hit", "hit_items", "hit_spans", "contaminated")

_RUN = re.compile(rb"[^\x20]+")


class WindowSet:
    """Windows by size: sorted ``hashes``, each with its item's number and the place of its first word in ``words``."""

    def __init__(self, rows: list[Row], n: int):
        self.n = n
        self.items = list({r["item"]: None for r in rows})
        number = {item: i for i, item in enumerate(self.items)}
        split = [(number[r["item"]], alnum_words(r["text"].encode())) for r in rows]
        split = [(item, words) for item, words in split if words]
        self.words = [w for _, words in split for w in words]
        counts = np.fromiter((len(w) for _, w in split), np.int64, len(split))
        item = np.fromiter((i for i, _ in split), np.int32, len(split))
        start, size = np.cumsum(counts) - counts, np.minimum(counts, n)
        hashed = WordHashes().of(self.words)
        runs = Runs(FACTORS[0])
        sums = runs.sums(hashed)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in np.unique(size).tolist():
            of = size == k
            each = counts[of] - k + 1
            places = ranges(start[of], each)
            hashes = runs.hashes(sums, places, k)
            order = np.argsort(hashes, kind="stable")
            self.windows[k] = hashes[order], np.repeat(item[of], each)[order], places[order].astype(np.int32)

    def find(self, texts: list[list[bytes]], seen: WordHashes, runs: Runs) -> list[tuple[np.ndarray, set[int]]]:
        """Of each text which words are hit, and the items whose windows occur."""
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(counts)
        words = [w for text in texts for w in text]
        hashed = seen.of(words)
        sums, left = runs.sums(hashed), np.repeat(ends, counts) - np.arange(len(words))
        hit = np.zeros(len(words) + 1, np.int32)
        found: list[set[int]] = [set() for _ in texts]
        for k, (hashes, items, places) in self.windows.items():
            at = np.flatnonzero(left >= k)
            if not len(at) or not len(hashes):
                continue
            own = runs.hashes(sums, at, k)
            first = np.searchsorted(hashes, own)
            maybe = np.flatnonzero(hashes[np.minimum(first, len(hashes) - 1)] == own)
            for i, p, h in zip(at[maybe].tolist(), first[maybe].tolist(), own[maybe]):
                text = None
                while p < len(hashes) and hashes[p] == h:
                    if self.words[places[p] : places[p] + k] == words[i : i + k]:
                        if text is None:
                            text = int(np.searchsorted(ends, i, side="right"))
                            hit[i] += 1
                            hit[i + k] -= 1
                        found[text].add(int(items[p]))
                    p += 1
        covered = np.cumsum(hit[:-1]) > 0
        return [(covered[e - n : e], f) for e, n, f in zip(ends.tolist(), counts.tolist(), found)]


def _spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of maximal runs of hit words."""
    spans: list[tuple[int, int]] = []
    before = False
    for now, m in zip(hit.tolist(), _RUN.finditer(text.translate(WORD_BYTES))):
        if now:
            spans.append((spans.pop()[0] if before else m.start(), m.end()))
        before = now
    return spans


def _shards(benchmark: DataFrame, item_col: str, text_col: str, shard_bytes: int, null_items: bool) -> list[DataFrame]:
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[text_col].cast("string").alias("text")).dropna(subset=["text"] if null_items else ["item", "text"]).distinct()
    total = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    n = -(-total // shard_bytes) or 1
    return [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 13,
    text_col: str = "text",
    item_col: str = "item_id",
    benchmark_text_col: str = "text",
    one_in: int = 20,
    shard_bytes: int = SHARD_BYTES,
    null_items: bool = False,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (long), ``hit_items`` (sorted item ids as strings),
    ``hit_spans`` (byte ranges of the UTF-8 text) and ``contaminated``.

    Words are lower-cased runs of ASCII letters, digits and non-ASCII characters. A window is
    ``n`` consecutive words of an item, or all of a shorter item's. A word inside any occurrence of
    a window is hit; a document is contaminated if any word is hit and at least one word in
    ``one_in`` is.

    Cases: null text has no words. Items with null text, and items without words, have no windows.
    Items with null id have none either unless ``null_items`` is set; then their windows hit as any
    other, and together they are one item, a null at the end of ``hit_items``. Repeated items count once. An empty benchmark hits nothing; no rows give no rows.
    Texts of any length are scanned whole. Columns of ``docs`` that bear the added names are
    replaced; ``__words``, ``__hit``, ``__items`` and ``__spans`` are reserved.
    """
    if clash := {"__words", "__hit", "__items", "__spans"} & set(docs.columns):
        raise ValueError(f"reserved names: {sorted(clash)}")
    span = "array<struct<start:bigint,end:bigint>>"
    rows = docs.drop(*ADDED).withColumn("__words", F.lit(0).cast("long"))
    rows = rows.withColumn("__items", F.expr("cast(array() as array<string>)")).withColumn("__spans", F.expr(f"cast(array() as {span})"))
    rows = rows.withColumn("__hit", F.lit(0).cast("long"))
    shards = _shards(benchmark, item_col, benchmark_text_col, shard_bytes, null_items)
    for k, shard in enumerate(shards):
        sent = docs.sparkSession.sparkContext.broadcast(WindowSet(shard.collect(), n))  # bounded by shard_bytes
        schema = rows.schema

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            windows, seen, runs = sent.value, WordHashes(), Runs(FACTORS[0])
            for whole in batches:
                for first in range(0, whole.num_rows, TEXTS):
                    batch = whole.slice(first, TEXTS)
                    at = {name: i for i, name in enumerate(batch.schema.names)}
                    columns = batch.columns
                    before = [columns[at[c]].to_pylist() for c in ("__items", "__spans")]
                    texts = raw(columns[at[text_col]])
                    split = [alnum_words(t) for t in texts]
                    out = [_scan(*x, windows) for x in zip(texts, split, windows.find(split, seen, runs), *before)]
                    for j, name in enumerate(("__words", "__hit", "__items", "__spans")):
                        columns[at[name]] = pa.array([o[j] for o in out], batch.schema.field(name).type)
                    yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        last, rows = rows, rows.mapInArrow(run, schema)
        if k + 1 < len(shards):
            rows = written(rows, "decontaminate")
            sent.destroy()
            if k:
                discard(last)
    bad = (F.col("__hit") > 0) & (F.col("__hit") * one_in >= F.col("__words"))
    out = rows.withColumns({"n_words": F.col("__words"), "n_hit": F.col("__hit"), "hit_items": F.array_sort("__items"), "hit_spans": F.col("__spans"), "contaminated": bad})
    return out.drop("__words", "__hit", "__items", "__spans")


def _scan(text: bytes | None, words: list[bytes], found: tuple[np.ndarray, set[int]], items: list[str], spans: list[dict], windows: WindowSet) -> tuple[int, int, list[str], list[dict]]:
    """Add what this shard hits to what earlier shards have hit."""
    hit, numbers = found
    if not numbers and not spans:
        return len(words), 0, items, spans
    if spans:  # words that earlier shards have hit
        starts = np.fromiter((m.start() for m in _RUN.finditer(text.translate(WORD_BYTES))), np.int64, len(words))
        for s in spans:
            hit = hit | ((starts >= s["start"]) & (starts < s["end"]))
    merged = sorted({*items, *(windows.items[i] for i in numbers)}, key=lambda x: (x is None, x or ""))
    return len(words), int(hit.sum()), merged, [{"start": a, "end": b} for a, b in _spans(text, hit)]


def remove_contamination(found: DataFrame, what: str = "documents", text_col: str = "text", added: Sequence[str] = ADDED) -> DataFrame:
    """Drop contaminated documents, or cut the hit spans out of their texts (``what="spans"``).

    ``found`` comes from find_contamination, whose ``added`` columns are dropped. Documents that are
    not contaminated stay as they are. A cut leaves one blank.
    """
    if what == "documents":
        out = found.filter(~F.col("contaminated"))
    elif what == "spans":
        raw = F.col(text_col).cast("binary")
        start = F.struct(F.lit(b"").alias("text"), F.lit(0).cast("long").alias("at"))

        def cut(s, span):
            kept = F.substring(raw, (s["at"] + 1).cast("int"), (span["start"] - s["at"]).cast("int"))
            return F.struct(F.concat(s["text"], kept, F.lit(b" ")).alias("text"), span["end"].alias("at"))

        rest = F.aggregate("hit_spans", start, cut)
        tail = F.substring(raw, (rest["at"] + 1).cast("int"), F.lit(2**31 - 1))
        clean = F.decode(F.concat(rest["text"], tail), "UTF-8")
        out = found.withColumn(text_col, F.when(F.col("contaminated"), clean).otherwise(F.col(text_col)))
    else:
        raise ValueError(what)
    return out.drop(*added)
