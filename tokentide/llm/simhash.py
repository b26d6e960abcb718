"""SimHash near-dedup by the generalised pigeonhole principle.

After Qin et al., "GPH: Similarity Search in Hamming Space" (2018). The 64 bits are grouped into m
parts of correlated bits. If two fingerprints differ in at most t bits, then for any thresholds
t1..tm of at least -1 that sum to t - m + 1 some part i differs in at most ti bits (-1: the part is
not probed). Each fingerprint picks its own thresholds by dynamic programming on estimated
candidates, so it avoids parts whose value is crowded. It probes the chosen balls around its part
values, and every candidate is verified on all 64 bits.

Only distinct fingerprints are probed: exact copies cost one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentide.llm.components import components
from tokentide.llm.scratch import written
from tokentide.llm.text import lowered_words, raw

BITS = 64
SEED = 42


def fingerprint(text: bytes | None, size: int = 3, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of all word shingles; zero for a text without words."""
    words = lowered_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    last = (ends[size - 1 :] - 1).tolist() if len(words) >= size else [len(joined)]
    hash64 = xxhash.xxh64_intdigest
    hashes = np.fromiter((hash64(joined[a:b], seed) for a, b in zip(starts.tolist(), last)), np.uint64, len(last))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # 4 MB of unpacked bits at a time
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint bigint) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, size) for t in raw(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints, pa.int64())], names=["id", "fingerprint"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fingerprint bigint")


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and the 64 x 64 matrix of how many have both bits set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 14):
                values = batch.column(0).slice(i, 1 << 14).to_numpy(zero_copy_only=False).astype(np.int64)
                bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
                total += bits.T @ bits
                rows += len(bits)
        pairs = pa.array(np.append(np.arange(BITS * BITS), -1))
        yield pa.RecordBatch.from_arrays([pairs, pa.array(np.append(total.ravel(), rows).astype(np.int64))], names=["pair", "n"])

    sums = {r["pair"]: r["n"] for r in prints.select("fingerprint").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    return sums.get(-1, 0), np.array([sums.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)


def group_bits(rows: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal size; each grows from the strongest free bit by the bit most correlated with it."""
    share = np.diag(both) / max(rows, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    strength = np.abs(both / max(rows, 1) - np.outer(share, share)) / np.outer(spread, spread)
    np.fill_diagonal(strength, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        size = BITS * (k + 1) // parts - BITS * k // parts
        group: list[int] = []
        while len(group) < size:
            pool = sorted(free)
            ties = strength[np.ix_(pool, group or pool)].sum(1)
            group.append(pool[int(np.argmax(ties))])
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def ball(width: int, radius: int) -> int:
    """Values within ``radius`` bit flips of one value; 0 for -1."""
    return sum(comb(width, k) for k in range(radius + 1))


def allocate(crowd: np.ndarray, widths: list[int], mean: np.ndarray, limit: int) -> np.ndarray:
    """Thresholds (rows x parts) of least estimated cost, by dynamic programming over the parts.

    ``crowd[r, i]`` rows share row r's value of part i and ``mean[i]`` rows share an average value. A
    threshold costs its probes and its candidates: the own value's crowd and the mean of each other.
    """
    rows, parts = crowd.shape
    need = limit + 1  # sum of (threshold + 1) over the parts
    best = np.full((parts + 1, need + 1, rows), np.inf)
    best[0, 0] = 0
    step = np.zeros((parts + 1, need + 1, rows), np.int8)
    for i in range(parts):
        for used in range(need + 1):
            for more in range(need - used + 1):
                n = ball(widths[i], more - 1)
                cost = best[i, used] + (n + crowd[:, i] + (n - 1) * mean[i] if more else 0)
                better = cost < best[i + 1, used + more]
                best[i + 1, used + more][better] = cost[better]
                step[i + 1, used + more][better] = more
    out = np.zeros((rows, parts), np.int8)
    left = np.full(rows, need)
    for i in range(parts, 0, -1):
        out[:, i - 1] = step[i, left, np.arange(rows)]
        left = left - out[:, i - 1]
    return out - 1


def choose_parts(rows: int, both: np.ndarray, limit: int) -> list[list[int]]:
    """The grouping of least estimated cost for so many rows; more parts mean fewer probes and larger candidate sets."""
    share = np.diag(both) / max(rows, 1)
    alike = share**2 + (1 - share) ** 2
    found = []
    for parts in range(1, limit + 2):
        groups = group_bits(rows, both, parts)
        mean = np.array([rows * np.prod(alike[g]) for g in groups])
        widths = [len(g) for g in groups]
        plan = allocate(np.maximum(mean, 1)[None, :], widths, mean, limit)[0]
        cost = parts + sum(ball(w, t) * (1 + m) for w, t, m in zip(widths, plan, mean) if t >= 0)
        found.append((cost, parts, groups))
    return min(found)[2]


def _mask(bits: tuple[int, ...] | list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _flips(bits: list[int], radius: int) -> np.ndarray:
    return np.array([_mask(c) for k in range(radius + 1) for c in combinations(bits, k)], np.int64)


def links(prints: DataFrame, limit: int = 3) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints of ``prints`` that differ in at most ``limit`` bits."""
    rows, both = bit_counts(prints)
    groups = choose_parts(rows, both, limit)
    widths = [len(g) for g in groups]
    masks = [_mask(g) for g in groups]
    share = np.diag(both) / max(rows, 1)
    mean = np.array([rows * np.prod((share**2 + (1 - share) ** 2)[g]) for g in groups])

    keyed = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)])
    held = prints.select("fingerprint", F.explode(keyed).alias("k")).select("fingerprint", "k.part", "k.value")
    crowds = held.groupBy("part", "value").agg(F.count("*").alias("crowd"))
    sized = held.join(crowds, ["part", "value"]).groupBy("fingerprint")
    wide = sized.agg(*[F.max(F.when(F.col("part") == i, F.col("crowd"))).cast("double").alias(f"crowd{i}") for i in range(len(groups))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                prints = some.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                crowd = np.stack([some.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(groups))], 1)
                plan = allocate(crowd, widths, mean, limit)
                for i, bits in enumerate(groups):
                    for radius in range(limit + 1):
                        mine = prints[plan[:, i] == radius]
                        flips = _flips(bits, radius) if len(mine) else ()
                        for j in range(0, len(mine), max(1, 100_000 // max(1, len(flips)))):
                            own = mine[j : j + max(1, 100_000 // len(flips))]
                            values = ((own & masks[i])[:, None] ^ flips[None, :]).ravel()
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(values), i, np.int32)), pa.array(values), pa.array(np.repeat(own, len(flips)))], names=["part", "value", "probe"]
                            )

    probes = wide.mapInArrow(run, "part int, value bigint, probe bigint")
    near = F.bit_count(F.col("probe").bitwiseXOR(F.col("fingerprint"))) <= limit
    pairs = probes.join(held, ["part", "value"]).filter((F.col("probe") < F.col("fingerprint")) & near)
    return pairs.select(F.col("probe").alias("a"), F.col("fingerprint").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, limit: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Fingerprints that differ in at most ``limit`` bits are linked; ``component_id`` is the smallest
    id reachable over links, the row's own included.

    Cases: null, empty and blank texts have fingerprint zero and are linked like any other; a text
    of fewer than ``size`` words is one shingle. Texts of any length are hashed whole. Repeated rows are repeated. A null id never names
    a component; where only null ids can be reached, ``component_id`` is null. Extra columns are
    ignored; no rows give no rows.
    """
    prints = written(fingerprints(docs, size, id_col, text_col), "fingerprints")
    distinct = written(prints.groupBy("fingerprint").agg(F.min("id").alias("first_id")), "distinct-fingerprints")
    joined = components(links(distinct, limit))
    joined = written(joined, "components")
    named = distinct.join(joined.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = named.join(smallest, "component").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row left of each component: the one whose id names it.

    Rows with a null id stay. Of rows repeating a kept id one stays.
    """
    ids = classes.select(F.col(id_col).alias("__id"), "component_id").filter(F.col("__id").isNotNull())
    gone = ids.groupBy("__id").agg(F.max(F.col("__id") == F.col("component_id")).alias("stays")).filter("not stays").select("__id")
    repeated = ids.groupBy("__id").agg(F.count("*").alias("n")).filter("n > 1").select("__id")
    rest = docs.join(gone, docs[id_col] == gone["__id"], "left_anti")
    single = rest.join(repeated, rest[id_col] == repeated["__id"], "left_anti")
    several = rest.join(repeated, rest[id_col] == repeated["__id"], "left_semi").dropDuplicates([id_col])
    return single.unionByName(several)
