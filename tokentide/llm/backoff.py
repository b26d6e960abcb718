"""Language-model scoring by a weighted backoff automaton.

Training counts of all tokens give add-one unigrams; every n-gram seen LEAST_COUNT times or more is
kept, discounted and mixed with its suffix, and becomes an arc (Mohri et al., "Weighted
finite-state transducers in speech recognition", 2002; the smoothing is interpolated absolute
discounting, Ney et al., 1994). A state is a context with arcs. It has an arc for each word kept
after it, and a failure arc, weighted by the mass that discounting and what was not kept have
freed, to the longest shorter state. A text is scored in one walk from left to right.

The model is never in one place. Documents are dealt to blocks of a bounded size, and the counts
of n-grams to shards by ranges of a 64-bit hash. Level by level a block asks for the total counts
of its distinct n-grams, of which only those whose two shorter parts are kept can be kept; the
shards answer in the order in which it asked, so an answer needs no keys. One of the blocks that
hold a kept n-gram owns it and tells its context's shard its count, and the shards tell each block
the freed masses of its contexts. So each block has the whole automaton as far as its texts reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tokentide.llm.scratch import written
from tokentide.llm.text import lowered_words, raw
from tokentide.llm.wordhash import FACTORS, mix

#: The end of a text, as a token, and its start, which is no token. No word can be either.
END, START = b"\n", b"\r"
ORDER = 3
DISCOUNT = 0.75
#: An n-gram of two words and more is kept if it occurs so often.
LEAST_COUNT = 2
#: Text bytes of a block, and shards for each block.
BLOCK_BYTES = 8 << 20
SHARDS = 1
#: Level under which contexts of so many words get their freed masses.
_MASSES = 100

_ASKED = "shard int, block int, level int, keys array<bigint>, n binary, kinds binary"
_TOLD = "block int, level int, shard int, n binary, kinds binary"


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.int64), *(np.ascontiguousarray(p).view(np.int64) for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def planes(values: np.ndarray) -> bytes:
    """Whole numbers, compressed: bytes of equal weight stand side by side, as most high ones are zero."""
    return zstandard.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    make = {"int": lambda c: pa.array(c, pa.int32()), "binary": lambda c: pa.array([planes(x) for x in c], pa.binary()), "array<bigint>": lambda c: _lists(list(c))}
    return pa.Table.from_arrays([make[kind](c) for (_, kind), c in zip(fields, columns)], names=[name for name, _ in fields])


def _flat(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of lists or planes, and how many each row has."""
    values = table.column(column).combine_chunks()
    if pa.types.is_list(values.type):
        return values.flatten().to_numpy(zero_copy_only=False), np.diff(values.offsets.to_numpy())
    parts = [from_planes(x, np.int64) for x in values.to_pylist()]
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.fromiter(map(len, parts), np.int64, len(parts))


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, a place of each, which of them is at each place)."""
    order = np.argsort(hashes)
    values = hashes[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    which = np.empty(len(values), np.int32)
    which[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return values[fresh], order[fresh], which


class _Numbers(dict):
    """Words in the order in which they were met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Level:
    """The n-grams of one size in a block: sorted distinct ``keys``, the keys of their ``contexts``, which ``entry`` is at each place (-1: none)."""

    def __init__(self, hashes: np.ndarray, before: np.ndarray | None, places: np.ndarray, weight: np.ndarray, length: int):
        self.keys, first, which = _distinct(hashes)
        self.contexts = before[first] if before is not None else None
        self.entry = np.full(length, -1, np.int32)
        self.entry[places] = which
        self.n = np.bincount(which, weight[places], len(self.keys)).astype(np.int64)
        self.total = self.owned = None

    def told(self, n: np.ndarray) -> None:
        assert len(n) == len(self.keys)
        self.total, self.owned = n >> 1, (n & 1) == 1

    def of(self, values: np.ndarray, missing) -> np.ndarray:
        """An entry's value at each place."""
        return np.append(values, missing)[self.entry]


class Words(Level):
    """Level 1. Words are numbered as they are met, which needs no sort of all places."""

    def __init__(self, numbers: np.ndarray, hashes: np.ndarray, weight: np.ndarray):
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.keys, self.contexts, self.entry = hashes[order], None, rank[numbers]
        self.n = np.bincount(self.entry, weight, len(self.keys)).astype(np.int64)
        self.total = self.owned = None


_BLOCK = "block int, sizes array<int>, learnt array<boolean>, copies array<bigint>, numbers binary, words array<bigint>"


def _tokens(texts: pa.Table, kind: pa.DataType) -> pa.Table:
    """One row of _BLOCK and the ids: the texts of a block as numbers of words, each text with its start and end, and the words' hashes."""
    number = _Numbers({START: 0, END: 1})
    found, sizes = [], []
    for text in raw(texts.column("text").combine_chunks()):
        words = lowered_words(text)
        sizes.append(len(words) + 2)
        own = np.ones(len(words) + 2, np.int32)
        own[0] = 0
        own[1:-1] = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
        found.append(own)
    hashes = mix(np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number)) + np.uint64(1))
    one = lambda values, t: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(t))
    columns = [texts.column("block").slice(0, 1).combine_chunks(), one(pa.array(sizes), pa.int32()), one(texts.column("learnt").combine_chunks(), pa.bool_()), one(texts.column("copies").combine_chunks(), pa.int64())]
    columns += [pa.array([planes(np.concatenate(found))], pa.binary()), one(pa.array(hashes.view(np.int64)), pa.int64()), one(texts.column("id").combine_chunks(), kind)]
    return pa.Table.from_arrays(columns, names=["block", "sizes", "learnt", "copies", "numbers", "words", "ids"])


class Block:
    """The tokens of some texts, one after another, each text with its start and end."""

    def __init__(self, row: pa.Table, told: pa.Table | None, order: int, levels: int):
        """``row``: one of _BLOCK. ``told``: the answers on so many ``levels``, and on masses."""
        self.number = row.column("block")[0].as_py()
        self.sizes, learnt, copies, hashes = (row.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("sizes", "learnt", "copies", "words"))
        numbered, hashes = from_planes(row.column("numbers")[0].as_buffer(), np.int32), hashes.view(np.uint64)
        self.stream, length = hashes[numbered], len(numbered)
        ends = np.cumsum(self.sizes, dtype=np.int64)
        self.begins = ends - self.sizes
        self.left = (np.repeat(ends, self.sizes) - np.arange(length)).astype(np.int32)
        self.weight = np.repeat(np.where(learnt, copies, 0), self.sizes)
        self.order, self.levels = order, []
        self.answers = {}
        if told is not None:
            level, shard = (told.column(c).to_numpy() for c in ("level", "shard"))
            self.answers = {int(k): told.take(pa.array(np.flatnonzero(level == k)[np.argsort(shard[level == k], kind="stable")])) for k in np.unique(level)}
        self.hashes = self.stream
        for k in range(1, min(levels + 1 + (levels == 0), order) + 1):
            if k == 1:
                self.levels.append(Words(numbered, hashes, self.weight))
            else:
                self._grow(k, length)
            if k <= levels:
                self.levels[-1].told(self._answer(k, "n"))

    def _answer(self, level: int, column: str) -> np.ndarray:
        return _flat(self.answers[level], column)[0] if level in self.answers else np.zeros(0, np.int64)

    def _grow(self, k: int, length: int) -> None:
        """Add level ``k``: places whose two shorter parts are kept; of two words all places, so that they are counted with the words."""
        fits = self.left >= k
        if k > 2:
            last = self.levels[-1]
            kept = last.of(last.total >= LEAST_COUNT, False)
            fits[:-1] &= kept[:-1] & kept[1:]
        places = np.flatnonzero(fits)
        before = self.hashes[places]
        found = mix(before * np.uint64(FACTORS[0]) + self.stream[places + k - 1])
        self.levels.append(Level(found, before, places, self.weight, length))
        self.hashes = np.zeros(length, np.uint64)
        self.hashes[places] = found

    def ask(self, shards: int, masses: int = 0) -> list[tuple]:
        """Rows of _ASKED: for the levels that have no totals yet, and for the masses of contexts of so many words, of which
        it tells the n-grams that it owns (block -1)."""
        rows = [row for k, level in enumerate(self.levels, 1) if level.total is None for row in _dealt(self.number, k, shards, level.keys, level.n)]
        if masses:
            context, level = self.levels[masses - 1], self.levels[masses]
            own = level.owned & (level.total >= LEAST_COUNT)
            contexts, _, which = _distinct(level.contexts[own])
            n = np.bincount(which, level.total[own], len(contexts)).astype(np.int64)
            rows += _dealt(-1, _MASSES + masses, shards, contexts, n, np.bincount(which, minlength=len(contexts)))
            rows += _dealt(self.number, _MASSES + masses, shards, context.keys[context.total >= LEAST_COUNT])
        return rows

    def score(self, tokens: int, words: int) -> list[tuple[int, int, float, float]]:
        """(n_tokens, n_known, base_score, score) of each text."""
        self.hashes = self.left = self.weight = None
        one, length, longest = self.levels[0], len(self.stream), self.order - 1
        below = one.of((one.total + 1) / (tokens + words + 1), 1.0)
        base = np.log10(below)
        # By words of the context: whether the one that ends at a place is a state, log10 of its freed mass, and of the arc to the place.
        states, frees, arcs = [np.ones(length, bool)], [np.zeros(length)], [base]
        for k in range(2, self.order + 1):
            context, level = self.levels[k - 2], self.levels[k - 1]
            n, kinds = np.zeros((2, len(context.keys)))
            asked = context.total >= LEAST_COUNT
            n[asked], kinds[asked] = (self._answer(_MASSES + k - 1, c) for c in ("n", "kinds"))
            free = (context.total - n + DISCOUNT * kinds) / np.maximum(context.total, 1)
            at = np.flatnonzero(level.of(level.total >= LEAST_COUNT, False))
            owner = context.entry[at]
            p = np.full(length, np.nan)
            p[at] = (level.total[level.entry[at]] - DISCOUNT) / context.total[owner] + free[owner] * below[at + 1]
            states.append(_shifted(context.of(kinds > 0, False), k - 2, False))
            frees.append(_shifted(context.of(np.log10(np.maximum(free, 1e-300)), 0.0), k - 2, 0.0))
            arcs.append(_shifted(np.log10(p), k - 1, np.nan))
            below = p
        deepest = [np.zeros(length, np.int8)]  # the longest state, of at most so many words, that ends at a place
        for d in range(1, longest + 1):
            deepest.append(np.where(states[d], np.int8(d), deepest[-1]))
        # Each state's move over each token: its arc, or its failure arcs and what the state that they lead to does.
        gains, moves = [base], [deepest[min(1, longest)]]
        for d in range(1, longest + 1):
            fallen = _shifted(deepest[d - 1], 1, np.int8(0))
            there = np.arange(length)
            gain = _shifted(frees[d], 1, 0.0) + np.stack(gains)[fallen, there]
            move = np.stack(moves)[fallen, there]
            direct = ~np.isnan(arcs[d])
            gains.append(np.where(direct, arcs[d], gain))
            moves.append(np.where(direct, deepest[min(d + 1, longest)], move))
        known = one.of(one.total > 0, False)
        out = []
        for begin, size in zip(self.begins.tolist(), self.sizes.tolist()):
            own = slice(begin + 1, begin + size)
            start = int(deepest[min(1, longest)][begin])
            total = walk([g[own].tolist() for g in gains], [m[own].tolist() for m in moves], start)
            out.append((size - 1, int(known[own].sum()), float(base[own].sum()), total))
        return out


def _shifted(values: np.ndarray, by: int, fill) -> np.ndarray:
    """``values`` moved ``by`` places to the right."""
    return values if not by else np.concatenate([np.full(min(by, len(values)), fill, values.dtype), values[:-by]])


def walk(gains: list[list[float]], moves: list[list[int]], state: int) -> float:
    """One pass over a text's tokens from left to right: the state is carried, its move's log10 probability added up."""
    total = 0.0
    for j in range(len(gains[0])):
        total += gains[state][j]
        state = moves[state][j]
    return total


def _dealt(block: int, level: int, shards: int, keys: np.ndarray, n: np.ndarray | None = None, kinds: np.ndarray | None = None) -> list[tuple]:
    """Rows of _ASKED: sorted keys cut at the borders of the shards, which are equal ranges of keys."""
    shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    edges = np.append(np.flatnonzero(np.diff(shard, prepend=np.uint64(shards))), len(keys)).tolist()
    none = np.zeros(0, np.int64)
    return [(int(shard[a]), block, level, keys[a:b], none if n is None else n[a:b], none if kinds is None else kinds[a:b]) for a, b in zip(edges, edges[1:])]


def _totals(asked: pa.Table, start: int) -> pa.Table:
    """A shard's answers on counts of one level: twice the total, zero if too few, and one more for the one asker that owns the n-gram.

    On single tokens it also tells, as block -1, the sum of all and how many there are.
    """
    keys, sizes = _flat(asked, "keys")
    level = asked.column("level")[0].as_py()
    distinct, first, which = _distinct(keys)
    total = np.bincount(which, _flat(asked, "n")[0], len(distinct)).astype(np.int64)
    rows = []
    if level == 1:
        real = total[distinct != start]
        rows.append((-1, 1, 0, np.array([real.sum(), (real > 0).sum()]), np.zeros(0, np.int64)))
    else:
        total[total < LEAST_COUNT] = 0
    answer = 2 * total[which]
    answer[first] += 1
    shard, block = asked.column("shard")[0].as_py(), asked.column("block").to_pylist()
    rows += [(b, level, shard, part, np.zeros(0, np.int64)) for b, part in zip(block, np.split(answer, np.cumsum(sizes)[:-1]))]
    return _table(_TOLD, rows)


def _masses(asked: pa.Table) -> pa.Table:
    """A shard's answers on contexts: the sum of the counts of the n-grams kept after each, and how many they are."""
    told = asked.filter(pc.equal(asked.column("block"), -1))
    asked = asked.filter(pc.not_equal(asked.column("block"), -1))
    distinct, _, which = _distinct(_flat(told, "keys")[0])
    sums = [np.append(np.bincount(which, _flat(told, c)[0], len(distinct)).astype(np.int64), 0) for c in ("n", "kinds")]
    keys, sizes = _flat(asked, "keys")
    place = np.searchsorted(distinct, keys)
    there = place < len(distinct)
    there[there] = distinct[place[there]] == keys[there]
    place[~there] = len(distinct)
    ends = np.cumsum(sizes)[:-1]
    names = zip(*(asked.column(c).to_pylist() for c in ("block", "level", "shard")))
    return _table(_TOLD, [(*name, n, kinds) for name, n, kinds in zip(names, np.split(sums[0][place], ends), np.split(sums[1][place], ends))])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [from_planes(x, np.int64).tolist() for x in batch.column("n").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["tokens", "words"])


def _each_once(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copies``; rows that are equal become one, so that no block is full of them."""
    digest = F.xxhash64("text").alias("h")
    many = written(rows.groupBy("id", "learnt", digest).agg(F.count("*").alias("k")).filter("k > 1"), "repeated-rows")
    if many.isEmpty():
        return rows.withColumn("copies", F.lit(1).cast("long"))
    named = many.select(F.col("id").alias("m_id"), F.col("learnt").alias("m_learnt"), "h")
    same = rows["id"].eqNullSafe(named["m_id"]) & (rows["learnt"] == named["m_learnt"]) & (F.xxhash64(rows["text"]) == named["h"])
    single = rows.join(named, same, "left_anti").withColumn("copies", F.lit(1).cast("long"))
    return single.unionByName(rows.join(named, same, "left_semi").groupBy("id", "text", "learnt").agg(F.count("*").alias("copies")))


def score_texts(
    docs: DataFrame,
    learn_col: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    block_bytes: int = BLOCK_BYTES,
    shards: int = SHARDS,
) -> DataFrame:
    """One row per row of ``docs``: the id, ``learnt``, ``n_tokens``, ``n_known`` (seen in training),
    ``train_tokens`` (long), ``base_score`` and ``score`` (log10, of add-one unigrams and of the automaton).

    The model is learnt from the rows whose boolean ``learn_col`` is true. Tokens are the words of
    the whole text, A-Z lower-cased, and one end. N-grams are told apart by 64 bits of hash.

    Cases: null, empty and blank texts are their end alone. Texts of any length are walked whole,
    each in one block. A null in ``learn_col`` is false. No training rows make every token unknown,
    of probability one. Repeated rows are learnt from and scored each; null ids pass through.
    Extra columns are ignored. No rows give no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), F.coalesce(docs[learn_col], F.lit(False)).alias("learnt"))
    rows = _each_once(rows)
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = max(1, ceil(size / block_bytes))
    shards *= blocks
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition(2 * blocks, "block")
    ids = to_arrow_type(docs.schema[id_col].dataType)
    tokens = written(dealt.groupBy("block").applyInArrow(lambda texts: _tokens(texts, ids), f"{_BLOCK}, ids array<{kind}>"), "token-blocks")
    start = int(mix(np.array([xxhash.xxh64_intdigest(START)], np.uint64) + np.uint64(1)).view(np.int64)[0])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _table(_ASKED, Block(pa.Table.from_batches([batch.slice(k, 1)]), None, order, 0).ask(shards)).to_batches()

    def meet(levels: int, fn: Callable[[pa.Table, Block], pa.Table], schema: str) -> DataFrame:
        """Each block with all that it has been told, on so many levels."""
        answers = reduce(DataFrame.unionByName, told).filter("block >= 0")
        return tokens.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda row, answers: fn(row, Block(row, answers, order, levels)), schema)

    def answered(asked: DataFrame) -> DataFrame:
        reply = lambda a: (_masses if a.column("level")[0].as_py() > _MASSES else lambda a: _totals(a, start))(a)
        return written(asked.groupBy("shard", "level").applyInArrow(reply, _TOLD), "ngram-answers")

    told = [answered(tokens.drop("ids").mapInArrow(first, _ASKED))]  # one and two words together, then one more at a time
    for levels in range(2, order + 1):
        asked = meet(levels, lambda _, block, masses=levels - 1: _table(_ASKED, block.ask(shards, masses)), _ASKED)
        told.append(answered(asked))
    numbers = told[0].filter("block = -1").select("n").mapInArrow(_sums, "tokens bigint, words bigint")
    every = numbers.agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).first()
    trained, distinct = every["tokens"] or 0, every["words"] or 0

    def scores(row: pa.Table, block: Block) -> pa.Table:
        scored = block.score(trained, distinct)
        made = [pa.array([s[i] for s in scored], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
        return pa.table([*(row.column(c)[0].values for c in ("ids", "learnt", "copies")), *made], names=["id", "learnt", "copies", "n_tokens", "n_known", "base_score", "score"])

    scored = meet(order, scores, f"id {kind}, learnt boolean, copies bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    scored = scored.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return scored.select(F.col("id").alias(id_col), "learnt", "n_tokens", "n_known", F.lit(trained).cast("long").alias("train_tokens"), "base_score", "score")
