"""Substring dedup by paragraph MinHash banding.

Paragraphs are of two kinds. The lines of at least ``least`` words, where near-equal ones count:
their signatures of word shingles are cut into bands, tuned for high recall; nodes (equal lines,
A-Z lower-cased, any white space between words, are one node, known by 128 bits) that agree in a
band meet in a bucket. Each is first compared with its bucket's leader, the smallest node; only
those that this leaves apart from it are compared with the others, in blocks. The exact Jaccard
similarity of word shingles decides on links; components of links are clusters.

And, so that passages inside lines and across line breaks are found, every window of ``least``
consecutive words, where equal ones count (module ``passages`` verifies them). A window's
signature is the smallest hash of its shingles of PIECE words: one band of one row, which equal
windows always share. Neighbouring windows mostly have one signature and are told as one block
(Schleimer et al., "Winnowing: Local Algorithms for Document Fingerprinting", 2003).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentide.llm.components import components
from tokentide.llm.scratch import discard, written
from tokentide.llm.text import LOWER_ASCII, raw
from tokentide.llm.wordhash import FACTORS, Runs, WordHashes, fixed_binary, mix, ranges

SHINGLE = 5
SIMILARITY = 0.8
LEAST_WORDS = 50
PIECE = 16
#: Nodes of one bucket, apart from its leader, that a task compares with as many others of the bucket.
BLOCK = 500
#: Texts that are cut at a time.
TEXTS = 128


def tune_bands(similarity: float, recall: float = 0.99, far: float = 0.5, noise: float = 0.4, most_rows: int = 12) -> tuple[int, int]:
    """(bands, rows): the cheapest that finds a pair at ``similarity`` with probability ``recall``
    and one at ``far`` times that with at most ``noise``; if none can, the most selective that keeps the recall."""
    found = []
    for rows in range(1, most_rows + 1):
        bands = 1
        while 1 - (1 - similarity**rows) ** bands < recall:
            bands += 1
        loud = 1 - (1 - (similarity * far) ** rows) ** bands
        found.append((loud > noise, bands if loud <= noise else loud, bands, rows))
    return min(found)[2:]


class Cutter:
    """Paragraphs of many texts at once."""

    def __init__(self, least: int):
        self.least, self.words = least, WordHashes()
        self.first, self.second = (Runs(f) for f in FACTORS)

    def lines(self, text: bytes | None) -> tuple[list[bytes], list[tuple[int, int, int]]]:
        """The text's words, and (line, first word, words) of its long lines."""
        words: list[bytes] = []
        found = []
        for i, line in enumerate(text.translate(LOWER_ASCII).split(b"\n") if text else ()):
            own = line.split()
            if len(own) >= self.least:
                found.append((i, len(words), len(own)))
            words += own
        return words, found

    def blocks(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, first window, windows, piece, block) for each run of neighbouring windows with one piece, the shingle of smallest hash."""
        nothing = tuple(np.zeros(0, np.int64) for _ in range(5))
        if len(words) < self.least:
            return nothing
        pieces = self.first.hashes(self.first.sums(words), np.arange(len(words) - PIECE + 1), PIECE)
        wide = self.least - PIECE + 1
        at, reach = np.arange(len(pieces)), 1  # at[i]: the place of the least of pieces[i : i + reach], the last one of equals
        while reach < wide:
            step = min(reach, wide - reach)
            left, right = at[:-step], at[step:]
            at, reach = np.where(pieces[right] <= pieces[left], right, left), reach + step
        ends = np.cumsum(sizes)
        text = np.repeat(np.arange(len(sizes)), sizes)
        window = np.flatnonzero(np.arange(len(at)) + self.least <= ends[text[: len(at)]])
        if not len(window):
            return nothing
        anchor, owner = at[window], text[window]
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
        count = np.diff(np.append(first, len(window)))
        start, owner = window[first], owner[first]
        block = self.second.hashes(self.second.sums(words), start, count + self.least - 1)
        return owner, start - (ends - sizes)[owner], count, pieces[anchor[first]].view(np.int64), block.view(np.int64)

    def digests(self, words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        return [runs.hashes(runs.sums(words), begin, size) for runs in (self.first, self.second)]

    def window_hashes(self, text: bytes | None, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The hashes of the windows of blocks of one text, block after block."""
        words = self.words.of(text.translate(LOWER_ASCII).split() if text else [])
        return self.second.hashes(self.second.sums(words), ranges(start, count), self.least).view(np.int64)


class Signer:
    """Band keys of paragraphs of at least ``shingle`` words."""

    def __init__(self, bands: int, rows: int, shingle: int = SHINGLE, seed: int = 11):
        draw = np.random.default_rng(seed).integers(0, 2**63, (2, bands * rows + shingle), np.uint64)
        self.bands, self.rows, self.shingle = bands, rows, shingle
        self.scale = draw[0] * np.uint64(2) + np.uint64(1)
        self.shift = draw[1]

    def sign(self, words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(paragraphs x bands) of int64, of the paragraphs words[begin : begin + size]."""
        k = self.bands * self.rows
        grams = np.zeros(len(words) - self.shingle + 1, np.uint64)
        for j in range(self.shingle):
            grams += words[j : j + len(grams)] * self.scale[k + j]
        count = size - self.shingle + 1
        grams = mix(grams)[ranges(begin, count)]
        starts = np.cumsum(count) - count
        keys = np.empty((len(begin), self.bands), np.uint64)
        for b in range(self.bands):
            key = np.full(len(begin), b + 1, np.uint64)
            for i in range(b * self.rows, (b + 1) * self.rows):
                key = mix(key + np.minimum.reduceat(grams * self.scale[i] + self.shift[i], starts))
            keys[:, b] = key
        return keys.view(np.int64)


def cut_paragraphs(docs: DataFrame, least: int, bands: int, rows: int, shingle: int) -> DataFrame:
    """Both kinds of paragraphs of ``docs`` (id, text), by one pass over the texts: (id, start, n) with piece and block, of ``n``
    windows from word ``start``; with line, digest and keys (of the bands), of a line of ``n`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, signer = Cutter(least), Signer(bands, rows, shingle)
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                some = batch.slice(first, TEXTS)
                split = [cutter.lines(t) for t in raw(some.column("text"))]
                sizes = np.fromiter((len(w) for w, _ in split), np.int64, len(split))
                words = cutter.words.of([w for text, _ in split for w in text])
                owner, start, n, piece, block = cutter.blocks(words, sizes)
                long = np.array([(k, *x) for k, (_, found) in enumerate(split) for x in found], np.int64).reshape(-1, 4).T
                begin = (np.cumsum(sizes) - sizes)[long[0]] + long[2]
                keys = signer.sign(words, begin, long[3]) if len(begin) else np.zeros((0, bands), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
                digests = fixed_binary(cutter.digests(words, begin, long[3]))
                yield _rows([some.column("id").take(pa.array(owner)), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(piece), pa.array(block), None, None, None])
                yield _rows([some.column("id").take(pa.array(long[0])), pa.array(long[2], pa.int32()), pa.array(long[3], pa.int32()), None, None, pa.array(long[1], pa.int32()), digests, lists])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, start int, n int, piece bigint, block bigint, line int, digest binary, keys array<bigint>")


_KINDS = {"id": None, "start": pa.int32(), "n": pa.int32(), "piece": pa.int64(), "block": pa.int64(), "line": pa.int32(), "digest": pa.binary(), "keys": pa.list_(pa.int64())}


def _rows(columns: list[pa.Array | None]) -> pa.RecordBatch:
    made = [pa.nulls(len(columns[0]), kind) if c is None else c for c, kind in zip(columns, _KINDS.values())]
    return pa.RecordBatch.from_arrays(made, names=list(_KINDS))


def node_of(digest: str = "digest") -> Column:
    """The first 64 bits of a digest. Nodes only bring candidates together: each of the digests that share one has its own text."""
    return F.conv(F.substring(F.hex(digest), 1, 16), 16, -10).cast("bigint")


def _texts(docs: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """(node, digest, text) of the lines that ``wanted`` (digest, id, start, n) places."""
    places = wanted.groupBy(F.col("id").alias("__id")).agg(F.collect_list(F.struct("start", "n")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(least)
        for batch in batches:
            nodes, digests, texts = [], [], []
            for text, places in zip(raw(batch.column("text")), batch.column("places").to_pylist()):
                words = text.translate(LOWER_ASCII).split() if text else []
                inside = [(p["start"], p["n"]) for p in places if p["start"] + p["n"] <= len(words)]  # rows that repeat an id may be shorter
                if inside:
                    begin, size = np.array(inside, np.int64).T
                    parts = cutter.digests(cutter.words.of(words), begin, size)
                    nodes.append(parts[0].view(np.int64))
                    digests += fixed_binary(parts).to_pylist()
                    texts += [b" ".join(words[a : a + n]) for a, n in inside]
            nodes = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(digests, pa.binary()), pa.array(texts, pa.binary())], names=["node", "digest", "text"])

    found = docs.join(places, docs["id"] == places["__id"]).select("text", "places")
    return found.mapInArrow(run, "node bigint, digest binary, text binary").dropDuplicates(["digest"])


def shingles(text: bytes, size: int) -> set[bytes]:
    words = text.split(b" ")
    return {b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def near(a: set[bytes], b: set[bytes], similarity: float) -> bool:
    low, high = sorted((len(a), len(b)))
    if low < similarity * high:
        return False
    both = len(a & b)
    return both >= similarity * (low + high - both)


def connect(rest: list[tuple], others: list[tuple], similarity: float) -> list[tuple]:
    """Links, as few as will do, that join components as all near pairs of a member of ``rest`` and one of either list would.

    Members are (name, shingles, component); those of one component are together already.
    """
    clusters: dict = {}
    for y in others:
        clusters.setdefault(y[2], []).append(y)
    found, parts = [], list(clusters.items())
    for x in rest:
        joined, apart, names = [x], [], {x[2]}
        for names_of, cluster in ((n if isinstance(n, set) else {n}, c) for n, c in parts):
            hit = x[2] in names_of
            if not hit:
                y = next((y for y in cluster if near(x[1], y[1], similarity)), None)
                hit = y is not None
                if hit:
                    found.append((x[0], y[0]))
            if hit:
                joined, names = cluster + joined, names | names_of
            else:
                apart.append((names_of, cluster))
        parts = [(names, joined), *apart]
    return found


_LINKS = "a bigint, b bigint, da binary, db binary"


def _near_leaders(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b, da, db): the ``pairs`` (a, b) that are near, with their digests."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist())
            kept = [near(shingles(x, shingle), shingles(y, shingle), similarity) for x, y in both]
            yield batch.select(["a", "b", "da", "db"]).filter(pa.array(kept, pa.bool_()))

    left, right = (texts.select(F.col("node").alias(x), F.col("digest").alias(f"d{x}"), F.col("text").alias(f"t{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "da", "db", "ta", "tb").mapInArrow(verify, _LINKS)


def _near_others(members: DataFrame, known: DataFrame, texts: DataFrame, shingle: int, similarity: float, block: int) -> DataFrame:
    """(a, b, da, db): links of the members that are not connected with their bucket's leader with others of the bucket.

    ``known``: (digest, component) by links to leaders. Those members, and everyone in their
    bucket, are dealt to blocks of bounded rows and bytes, and a task sees one block of either at a
    time. Groups are mostly small, so a partition, sorted by group, is read as one stream.
    """
    part = texts.select("node", "digest", F.octet_length("text").alias("bytes")).join(known, "digest", "left").groupBy("node").agg(F.min(F.coalesce("component", "digest")).alias("part"), F.max("bytes").alias("bytes"))
    part = written(part, "node-parts")
    lead = part.select(F.col("node").alias("low"), F.col("part").alias("low_part"))
    placed = written(members.join(part, "node").join(lead, "low").withColumn("apart", F.col("part") != F.col("low_part")), "placed-members")
    room = lambda rows, size: F.ceil(F.greatest(rows / block, F.coalesce(size, F.lit(0)) / (1000 * block))).cast("int")
    apart = F.when(F.col("apart"), F.col("bytes"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.count_if("apart").alias("k"), room(F.count_if("apart"), F.sum(apart)).alias("i_of"), room(F.count("*"), F.sum("bytes")).alias("j_of"))
    sizes = written(sizes.filter("size > 2 AND k > 0").select("bucket", "i_of", "j_of"), "bucket-blocks")
    dealt = placed.join(sizes, "bucket")
    own = lambda of, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    mine = dealt.filter("apart").select("bucket", own("i_of", 1).alias("i"), each("j_of").alias("j"), "node", "part", F.lit(True).alias("mine"))
    theirs = dealt.select("bucket", each("i_of").alias("i"), own("j_of", 2).alias("j"), "node", "part", F.lit(False).alias("mine"))

    def links_of(found: list[tuple]) -> pa.RecordBatch:
        flat = [(a[0], b[0], a[1], b[1]) for a, b in found]
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in flat], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["a", "b", "da", "db"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, ([], [])
        for batch in batches:
            found: list[tuple] = []
            for *key, node, digest, text, part, mine in zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "node", "digest", "text", "part", "mine"))):
                if key != group:
                    found += connect(*rows, similarity)
                    group, rows = key, ([], [])
                rows[not mine].append(((node, digest), shingles(text, shingle), part))
            yield links_of(found)
        yield links_of(connect(*rows, similarity))

    group = ["bucket", "i", "j"]
    rows = mine.unionByName(theirs).join(texts, "node").repartition(*group).sortWithinPartitions(*group)
    return rows.select(*group, "node", "digest", "text", "part", "mine").mapInArrow(verify, _LINKS)


def clusters(docs: DataFrame, lines: DataFrame, least: int = LEAST_WORDS, similarity: float = SIMILARITY, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(digest, cluster) of the lines (id, start, n, digest, keys) of ``docs`` (id, text) that are near another one."""
    held = lines.select(F.explode("keys").alias("bucket"), node_of().alias("node"))
    shared = held.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("bucket", "low")
    shared = written(shared, "shared-buckets")
    members = written(held.join(shared, "bucket").distinct(), "bucket-members")
    nodes = members.select("node").distinct()
    place = F.min(F.struct("id", "start", "n")).alias("place")
    wanted = lines.withColumn("node", node_of()).join(nodes, "node", "left_semi").groupBy("digest").agg(place).select("digest", "place.*")
    texts = written(_texts(docs, wanted, least), "paragraph-texts")
    pairs = members.filter("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    leaders = written(_near_leaders(pairs, texts, shingle, similarity), "near-leaders")
    known = components(leaders.select("da", "db"), "da", "db").withColumnRenamed("node", "digest")
    others = written(_near_others(members, known, texts, shingle, similarity, block), "near-others")
    joined = components(leaders.unionByName(others).select("da", "db"), "da", "db")
    for done in (shared, members, texts, leaders, others):
        discard(done)
    return joined.select(F.col("node").alias("digest"), F.col("component").alias("cluster"))
