"""Collocations by suffix sorting: every phrase up to ``max_n`` words is counted by one stack.

Each word starts a suffix of its piece, cut after ``max_n`` words. Equal suffixes are counted
together where they are made, shuffled by language and first word, sorted in reverse lexicographic
order, and read once: a stack holds the words of the last suffix with what was counted below each,
and a phrase's count is final when its word leaves the stack (Berberich and Bedathur, "Computing
n-gram statistics in MapReduce", 2013). Phrases are never emitted once for each occurrence.

Suffixes are dealt by ranges of (language, words), first word first, whose limits are quantiles of
a sample; the sample moves work between tasks and never a count. So a first word, pair or triple
that is very frequent is cut over several tasks. Only the phrases at the two ends of a range can go
on in another; their parts are handed on at any count and summed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentide.llm.scratch import written
from tokentide.llm.text import raw

#: Documents that are sampled for the limits of ranges, and of their suffixes every how manieth.
SAMPLE_DOCS, SAMPLE_STEP = 4000, 64
#: Bytes of a limit that are kept.
_LIMIT_BYTES = 96
#: Words that a task counts before it hands suffixes on.
MOST_WORDS = 700_000
#: Rows of an Arrow batch that is made.
_ROWS = 20_000
_EXACT = "decimal(38,0)"
_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: A-Z lower-cased, ends of pieces as zero bytes.
_READ = bytes(0 if c in _PIECE_ENDS else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def _escaped(text: bytes) -> bytes:
    """Words without zero bytes, which part the words of a suffix; their equality stays, and their order does not matter."""
    return text.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x03") if b"\x00" in text or b"\x01" in text else text


def _plain(text: bytes) -> bytes:
    return text.replace(b"\x01\x03", b"\x00").replace(b"\x01\x02", b"\x01")


def _tokens(text: bytes) -> list[bytes]:
    """Words, with a zero byte where a piece ends."""
    return _escaped(text).translate(_READ).replace(b"\x00", b" \x00 ").split()


def distinct_suffixes(tokens: list[bytes], max_n: int) -> tuple[pa.Array, np.ndarray]:
    """The distinct suffixes of words parted by zero bytes, in reverse order, and how often each is found.

    Words become numbers in their own order, so numbers of suffixes sort as suffixes do.
    """
    words = pa.array([*tokens, *[b"\x00"] * max_n], pa.binary()).dictionary_encode()
    order = pc.array_sort_indices(words.dictionary).to_numpy(zero_copy_only=False)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))  # the zero byte is first of all words, so its rank is 0
    ids = rank[words.indices.to_numpy(zero_copy_only=False)]
    n = len(ids) - max_n
    columns = [ids[:n]]
    for k in range(1, max_n):
        columns.append(np.where(columns[-1] == 0, 0, ids[k : k + n]))
    real = columns[0] != 0
    columns = [c[real] for c in columns]
    if not len(columns[0]):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    numbers, size = columns[0], len(order)
    for c in columns[1:]:
        if size * len(order) >= 1 << 62:  # number the prefixes anew rather than overflow
            found, numbers = np.unique(numbers, return_inverse=True)
            size = len(found)
        numbers, size = numbers * len(order) + c, size * len(order)
    found, first, counts = np.unique(numbers, return_index=True, return_counts=True)
    first = first[::-1]
    text = words.dictionary.take(pa.array(order)).to_pylist()
    text[0] = b""
    text = pa.array(text, pa.large_binary())
    parts = [text.take(pa.array(c[first])) for c in columns]
    return pc.binary_join_element_wise(*parts, pa.scalar(b"\x00", pa.large_binary())), counts[::-1]


def _suffixes(max_n: int, most_words: int, step: int = 0, limits: list[bytes] | None = None):
    """(lang, text) to (part, suffix, n): suffixes are the language and ``max_n`` words parted by zero bytes, those past the
    piece empty; ``part`` is the number of limits that are larger. With ``step``, every ``step``-th suffix only."""

    def cuts(keys: pa.Array) -> np.ndarray:
        """Parts of keys in reverse order."""
        part = np.zeros(len(keys), np.int32)
        at = [bisect_left(range(len(keys)), True, key=lambda i: keys[i].as_py() < limit) for limit in limits]
        np.add.at(part, [i for i in at if i < len(keys)], 1)
        return np.cumsum(part, dtype=np.int32)

    def handed(tokens: dict[bytes, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for lang, said in tokens.items():
            keys, counts = distinct_suffixes(said, max_n)
            if step:
                keys, counts = keys.take(pa.array(np.arange(0, len(keys), step))), counts[::step]
            keys = pc.binary_join_element_wise(pa.scalar(lang, pa.large_binary()), keys, pa.scalar(b"\x00", pa.large_binary()))
            parts = cuts(keys) if limits else np.zeros(len(keys), np.int32)
            for at in range(0, len(keys), _ROWS):
                some = slice(at, at + _ROWS)
                columns = [pa.array(parts[some]), keys[some].cast(pa.binary()), pa.array(counts[some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "suffix", "n"])
        tokens.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: dict[bytes, list[bytes]] = defaultdict(list)
        read = 0
        for batch in batches:
            for lang, text in zip(raw(batch.column(0)), raw(batch.column(1))):
                if not text:
                    continue
                said = _tokens(text)
                tokens[_escaped(lang)] += said
                tokens[_escaped(lang)].append(b"\x00")
                read += len(said)
                if read >= most_words:
                    yield from handed(tokens)
                    read = 0
        yield from handed(tokens)

    return run


class _Stack:
    """The path (language, word, word ..) of the suffix read last, with what has been counted below each node.

    A batch is settled at once: at each depth its rows fall into runs of one path, all but the last
    of which are final; the last stays on the stack.
    """

    def __init__(self, depth: int, min_count: int):
        self.depth, self.min_count = depth, min_count
        self.path: list[bytes] = []
        self.counts = [0] * depth
        #: Whether the node at each depth is open since the first suffix.
        self.first = [True] * depth
        self.out: list[tuple[bytes, bytes | None, int, int]] = []

    def _leave(self, depth: int, path: list[bytes], n: int, edge: bool) -> None:
        if path[depth] and (n >= self.min_count or edge) or depth == 0:
            self.out.append((_plain(path[0]), b" ".join(map(_plain, path[1 : depth + 1])) if depth else None, depth, int(n)))

    def push(self, suffixes: pa.Array, n: np.ndarray) -> None:
        flat = pc.split_pattern(suffixes, "\x00").flatten()
        columns = [flat.take(pa.array(np.arange(d, len(flat), self.depth))) for d in range(self.depth)]
        last = [c[-1].as_py() for c in columns]
        fresh = np.zeros(len(n), bool)
        for d, column in enumerate(columns):
            fresh[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            if self.path and column[0].as_py() != self.path[d]:
                fresh[0] = True
            starts = np.flatnonzero(fresh)
            if not len(starts):  # all goes on below the node that is open
                self.counts[d] += int(n.sum())
                continue
            if self.path:
                self._leave(d, self.path, self.counts[d] + int(n[: starts[0]].sum()), self.first[d])
            elif starts[0]:  # the first run of all
                self._leave(d, [c[0].as_py() for c in columns], int(n[: starts[0]].sum()), True)
            sums = np.add.reduceat(n, starts)
            self.counts[d], self.first[d] = int(sums[-1]), False
            for i in np.flatnonzero((sums[:-1] >= self.min_count) | (d == 0)):
                self._leave(d, [c[int(starts[i])].as_py() for c in columns[: d + 1]], sums[i], False)
        self.path = last

    def close(self) -> None:
        """Leave all nodes; what is open at the end may go on in the next range."""
        if self.path:
            for d in range(self.depth):
                self._leave(d, self.path, self.counts[d], True)


def _counted(max_n: int, min_count: int):
    """Sorted (part, suffix, n) to (lang, phrase, size, f); the row of size 0 counts the language's words."""

    def handed(stack: _Stack) -> Iterator[pa.RecordBatch]:
        rows, stack.out = stack.out, []
        if rows:
            langs, phrases, sizes, counts = zip(*rows)
            columns = [pa.array(langs, pa.binary()).cast(pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "size", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, _Stack(max_n + 1, min_count)
        for batch in batches:
            parts = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(parts)) + 1), len(parts)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if parts[a] != part:
                    stack.close()
                    yield from handed(stack)
                    part, stack = parts[a], _Stack(max_n + 1, min_count)
                stack.push(batch.column(1)[int(a) : int(b)], batch.column(2).to_numpy()[a:b])
            if len(stack.out) >= _ROWS:
                yield from handed(stack)
        stack.close()
        yield from handed(stack)

    return run


_SUFFIX = "part int, suffix binary, n bigint"


def _limits(rows: DataFrame, max_n: int, parts: int) -> list[bytes]:
    """At most ``parts`` - 1 limits of ranges, descending. Only every SAMPLE_STEP-th suffix of about SAMPLE_DOCS texts meets the driver, cut to a few bytes."""
    n = rows.count()
    some = rows.sample(min(1.0, SAMPLE_DOCS / max(n, 1)), seed=7).mapInArrow(_suffixes(max_n, MOST_WORDS, SAMPLE_STEP), _SUFFIX)
    keys = sorted({bytes(r[0]) for r in some.select(F.substring("suffix", 1, _LIMIT_BYTES)).collect()}, reverse=True)
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}, reverse=True) if keys else []


def count_phrases(docs: DataFrame, max_n: int = 4, min_count: int = 30, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, size, f): phrases of 1 to ``max_n`` words found ``min_count`` times or more; size 0, phrase null: all words of a language."""
    known = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    rows = docs.select(known.alias("lang"), F.col(text_col).cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.mapInArrow(_suffixes(max_n, MOST_WORDS, 0, _limits(rows, max_n, parts)), _SUFFIX)
    dealt = found.repartitionById(parts, F.col("part")).sortWithinPartitions(F.desc("suffix"))
    counted = dealt.mapInArrow(_counted(max_n, min_count), "lang string, phrase string, size int, f bigint")
    whole = counted.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
    return whole.filter((F.col("f") >= min_count) | (F.col("size") == 0))


def _words(first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice("words", first, n), " ")


def collocations(
    docs: DataFrame,
    max_n: int = 4,
    min_count: int = 30,
    most: int = 2000,
    scale: int = 2_000_000,
    covered_percent: int = 80,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` best phrases of 2 to ``max_n`` words of each language.

    Texts are lower-cased (A-Z), cut in pieces at ``.,;:!?`` and line ends, and those in words at
    spaces and tabs; phrases lie within pieces. Of a phrase found a times, each cut in two parts
    found l and r times scores floor(scale * a / (l + r)); the lowest counts, ties to the earliest
    cut. A phrase inside a longer one that is found at least ``covered_percent`` per cent as often
    is dropped. Order: score, then a, descending, then the phrase's bytes. Products are decimals of
    38 digits, so exact.

    Cases: a null language is ``und``; null, empty and blank texts have no words, and languages
    without phrases no rows. Texts and words of any length count whole; rows that repeat count each.
    Extra columns are ignored. No rows give no rows.
    """
    counts = written(count_phrases(docs, max_n, min_count, lang_col, text_col), "phrases")
    phrases = counts.filter(F.col("size") > 1).withColumn("words", F.split("phrase", " ", -1))
    parts = counts.filter(F.col("size") > 0).select("lang", F.col("phrase").alias("part"), F.col("f").alias("f_part"))

    cuts = phrases.select("lang", "phrase", "size", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _words(F.lit(1), F.col("k")).alias("head"), _words(F.col("k") + 1, F.col("size")).alias("tail"))
    for side, part in (("l", "head"), ("r", "tail")):
        cuts = cuts.join(parts.withColumnsRenamed({"part": part, "f_part": side}), ["lang", part])
    score = F.expr(f"(CAST({scale} AS {_EXACT}) * a) DIV (CAST(l AS decimal(20,0)) + r)")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    at = F.sequence(F.lit(1), F.col("size") - F.col("n_words") + 1)
    inner = (
        phrases.filter("size > 2")
        .select("lang", "f", "size", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("n_words"))
        .select("lang", "f", F.explode(F.array_distinct(F.transform(at, lambda p: _words(p, F.col("n_words"))))).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longer"))
    )
    covered = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * covered_percent
    kept = lowest.join(inner, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False)))
    best = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= most)
    words = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"))
