"""Passages that repeat across documents, wherever lines break, and lines that nearly do.

Windows of ``least`` words meet by their MinHash signature, the piece (see ``paragraphs``). A
window whose piece is in one document only repeats nowhere; of the rest, equality is checked.
Neighbouring windows with one piece are a block. Blocks of pieces in one document are dropped;
equal blocks become one; and only where a piece has unlike blocks are single windows compared. No
step compares pairs, and no group is gathered in one task.

Equality of windows is that of two hashes of 64 bits, of the piece and of the block or window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentide.llm.paragraphs import BLOCK, LEAST_WORDS, PIECE, SHINGLE, SIMILARITY, Cutter, clusters, cut_paragraphs, tune_bands
from tokentide.llm.scratch import discard, written
from tokentide.llm.text import raw


def _windows(docs: DataFrame, unlike: DataFrame, least: int) -> DataFrame:
    """(piece, block, id, start, last, windows): ``unlike`` (piece, block, id, start, n, last) with the hashes of its windows."""
    wanted = unlike.groupBy(F.col("id").alias("__id")).agg(F.collect_list(F.struct("start", "n", "piece", "block", "last")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(least)
        for batch in batches:
            for k, text in enumerate(raw(batch.column("text"))):
                row = batch.slice(k, 1)
                flat = row.column("wanted").flatten()
                start, count = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                inside = start + count + least - 1 <= len(text.split() if text else ())  # rows that repeat an id may be shorter
                flat, start, count = flat.filter(pa.array(inside)), start[inside], count[inside]
                hashes = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(cutter.window_hashes(text, start, count)))
                ids = row.column("id").take(pa.array(np.zeros(len(start), np.int64)))
                yield pa.RecordBatch.from_arrays([flat.field(2), flat.field(3), ids, flat.field(0), flat.field(4), hashes], names=["piece", "block", "id", "start", "last", "windows"])

    kind = docs.schema["id"].dataType.simpleString()
    found = docs.join(wanted, docs["id"] == wanted["__id"]).select("id", "text", "wanted")
    return found.mapInArrow(run, f"piece bigint, block bigint, id {kind}, start int, last {kind}, windows array<bigint>")


def spans(documents: list[list[tuple[int, int, int]]], least: int) -> tuple[np.ndarray, ...]:
    """(document's number, start, n_words, removed) of the maximal runs of words, from each document's (start, found, kept) of
    blocks: bit j stands for window start + j. All documents are laid out one after another, with a gap between."""
    counts = np.fromiter(map(len, documents), np.int64, len(documents))
    start, found, kept = np.array([b for d in documents for b in d], np.int64).reshape(-1, 3).T
    room = np.fromiter((max(b[0] for b in d) if d else 0 for d in documents), np.int64, len(documents)) + 64 + least + 1
    base = np.cumsum(room) - room
    start = start + np.repeat(base, counts)
    covers = np.zeros((2, int(room.sum()) + 1), np.int32)
    for row, bits in enumerate((found, found & ~kept)):
        for j in range(62):
            at = start[(bits >> j) & 1 == 1] + j
            np.add.at(covers[row], at, 1)
            np.add.at(covers[row], at + least, -1)
    inside, gone = np.cumsum(covers, 1) > 0
    state = inside.astype(np.int8) + gone
    edges = np.flatnonzero(np.diff(state, prepend=np.int8(0)))
    begin, end = edges[:-1], edges[1:]
    real = state[begin] > 0
    begin, end = begin[real], end[real]
    owner = np.searchsorted(base, begin, side="right") - 1
    return owner, begin - base[owner], end - begin, state[begin] == 2


def _repeated_windows(docs: DataFrame, blocks: DataFrame, least: int) -> DataFrame:
    """(id, windows) of the documents that hold repeated windows, from the ``blocks`` (id, start, n, piece, block) of shared clusters."""
    first = F.min(F.struct("id", "start", "n")).alias("first")
    distinct = written(blocks.groupBy("piece", "block").agg(first, F.max("id").alias("last")).select("piece", "block", "first.*", "last"), "distinct-blocks")
    kinds = distinct.groupBy("piece").agg(F.count("*").alias("kinds"))
    named = written(distinct.join(kinds, "piece"), "named-blocks")
    bit = F.expr("shiftleft(1L, j)")
    windows = written(_windows(docs, named.filter("kinds > 1"), least), "windows")
    single = windows.select("piece", "block", "id", "start", "last", F.posexplode("windows").alias("j", "window"))
    place = F.struct("id", (F.col("start") + F.col("j")).alias("start"))
    repeated = single.groupBy("piece", "window").agg(F.min(place).alias("held"), F.max("last").alias("last")).filter("held.id < last")
    repeated = written(repeated.select("piece", "window", "held"), "repeated-windows")
    met = single.drop("last").join(repeated, ["piece", "window"])
    masks = met.groupBy("piece", "block").agg(
        F.bit_or(bit).alias("found"), F.bit_or(F.when(F.col("held") == place, bit).otherwise(F.lit(0).cast("long"))).alias("kept"), F.min(F.struct("id", "start")).alias("first")
    )
    whole = F.expr("shiftleft(1L, n) - 1")
    alike = named.filter("kinds = 1 AND id < last").select("piece", "block", whole.alias("found"), whole.alias("kept"), F.struct("id", "start").alias("first"))
    masks = written(alike.unionByName(masks), "masks")
    for done in (distinct, named, windows, repeated):
        discard(done)

    at_first = F.struct("id", "start") == F.col("first")
    marked = blocks.join(masks, ["piece", "block"]).select("id", F.struct("start", "found", F.when(at_first, F.col("kept")).otherwise(F.lit(0).cast("long")).alias("kept")).alias("w"))
    return marked.groupBy("id").agg(F.collect_list("w").alias("windows"))


def repeated_passages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST_WORDS,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    recall: float = 0.99,
    block: int = BLOCK,
) -> DataFrame:
    """Runs of words that repeat in another document: the id, ``line``, ``start`` (number of the first word, from 0),
    ``n_words`` and ``removed``.

    With ``line`` null, a run of words that lie in a window of ``least`` words which two documents
    hold word for word. A window stays where it occurs first by id and start; a word in any later
    window is removed. Every such window is found.

    With ``line`` (from 0), a line of at least ``least`` words whose cluster spans two documents:
    it is near another line by the Jaccard similarity of its shingles, or by a chain of such. The
    cluster's first line by id and place stays. Pairs at the similarity are found with probability
    ``recall`` or more, equal ones always.

    Cases: texts of fewer words, nulls and empty ones among them, give none. Texts of any length are
    cut whole. Rows with a null id are left out. Rows that repeat an id count as one document, their
    windows at one start as alternatives. Extra columns are ignored. No rows give no rows. ``least``
    must be at least PIECE and at most PIECE + 61, and ``shingle`` at most PIECE.
    """
    if not PIECE <= least <= PIECE + 61 or shingle > PIECE:
        raise ValueError("a window must hold a piece, a piece a shingle, and a block's windows must fit a mask")
    docs = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).filter(F.col("id").isNotNull())
    kind = docs.schema["id"].dataType.simpleString()
    cut = written(cut_paragraphs(docs, least, *tune_bands(similarity, recall), shingle), "paragraphs")
    windows = cut.filter("line IS NULL").select("id", "start", "n", "piece", "block")
    pieces = written(windows.groupBy("piece").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("piece"), "shared-pieces")
    blocks = written(windows.join(pieces, "piece", "left_semi"), "shared-blocks")
    gathered = _repeated_windows(docs, blocks, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, start, size, removed = spans([[tuple(w.values()) for w in row] for row in batch.column("windows").to_pylist()], least)
            columns = [batch.column("id").take(pa.array(owner)), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(removed)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "n_words", "removed"])

    runs = gathered.mapInArrow(run, f"id {kind}, start int, n_words int, removed boolean")
    lines = cut.filter("line IS NOT NULL").select("id", "line", "start", "n", "digest", "keys")
    known = clusters(docs, lines, least, similarity, shingle, block)
    named = lines.drop("keys").join(known, "digest", "left").withColumn("cluster", F.coalesce("cluster", "digest")).drop("digest").distinct()
    place = F.struct("id", "start")
    firsts = named.groupBy("cluster").agg(F.min(place).alias("first"), F.max("id").alias("last")).filter("first.id < last")
    firsts = written(firsts, "first-lines")
    whole = named.join(firsts, "cluster").select("id", "line", "start", F.col("n").alias("n_words"), (place != F.col("first")).alias("removed"))
    out = runs.withColumn("line", F.lit(None).cast("int")).unionByName(whole)
    return out.select(F.col("id").alias(id_col), "line", "start", "n_words", "removed")


def remove_passages(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words that ``repeats`` marks as removed; what white space stood between words that stay is kept.

    Cases: rows that ``repeats`` does not name, null texts among them, are untouched. Rows that repeat an id lose the same words.
    """
    gone = repeats.filter("removed").groupBy(F.col(id_col).alias("__id")).agg(F.collect_list(F.struct("start", "n_words")).alias("__runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_without(t, runs) for t, runs in zip(raw(batch.column(text_col)), batch.column("__runs").to_pylist())]
            columns = [pa.array(texts, pa.binary()).cast(f.type) if f.name == text_col else c for f, c in zip(batch.schema, batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    met = docs.join(gone, docs[id_col] == gone["__id"], "left").drop("__id")
    return met.mapInArrow(run, met.schema).drop("__runs")


def _without(text: bytes | None, runs: list[dict] | None) -> bytes | None:
    if text is None or not runs:
        return text
    parts = re.split(rb"([^\x20\x09-\x0D]+)", text)  # white space at even places, words at odd ones
    kept = np.ones(len(parts) // 2, bool)
    for r in runs:
        kept[r["start"] : r["start"] + r["n_words"]] = False
    return b"".join(parts[2 * i] + parts[2 * i + 1] for i in np.flatnonzero(kept).tolist()) + parts[-1]
