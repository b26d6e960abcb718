"""Fill-in-the-middle transformation with a sparse checkpoint index.

While the units of a text are counted, block by block, the byte and code-point offset after every
``every`` units is kept. A cut at any unit is then found by binary search of those checkpoints and
a rescan of fewer than ``every`` units, so neither a list of all units nor a list of all offsets is
ever built, whatever the length of the text.
"""

from __future__ import annotations

import hashlib
import re
import struct
from bisect import bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tokentide.llm.text import raw

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Columns that ``fill_in_middle`` adds.
ADDED = ("n_units", "form", "prefix_chars", "middle_chars", "output")
EVERY = 64
#: Bytes that are counted at a time.
BLOCK = 1 << 16

_MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_BLANK = np.isin(np.arange(256), np.frombuffer(_BLANKS, np.uint8))
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80
#: A word with the white space before it, or white space that ends the text. All its ends are ASCII, so bytes serve.
_UNIT = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


class Checkpoints:
    """The number of units and code points of a UTF-8 text, and offsets after every ``every`` units."""

    def __init__(self, text: bytes, every: int = EVERY, block: int = BLOCK):
        self.text = text
        self.units: list[int] = [0]
        self.bytes: list[int] = [0]
        self.chars: list[int] = [0]
        n = chars = 0
        for at in range(0, len(text), block):
            part = np.frombuffer(text, np.uint8, min(block, len(text) - at), at)
            follows = at + len(part) == len(text) or text[at + len(part)] in _BLANKS
            blank = np.append(_IS_BLANK[part], follows)
            ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
            before = np.cumsum(_STARTS_CHAR[part])
            marked = ends[(-n - 1) % every :: every]
            first = n + 1 + (-n - 1) % every
            self.units += range(first, first + every * len(marked), every)
            self.bytes += (marked + at).tolist()
            self.chars += (before[marked - 1] + chars).tolist()
            n += len(ends)
            chars += int(before[-1])
        self.n_units = n + (text[-1:] in _BLANKS if text else 0)
        self.n_chars = chars

    def cut(self, unit: int) -> tuple[int, int]:
        """Byte and code-point offset of the end of the first ``unit`` units."""
        if unit >= self.n_units:
            return len(self.text), self.n_chars
        k = bisect_right(self.units, unit) - 1
        start = end = self.bytes[k]
        for found in islice(_UNIT.finditer(self.text, start), unit - self.units[k]):
            end = found.end()
        return end, self.chars[k] + int(_STARTS_CHAR[np.frombuffer(self.text, np.uint8, end - start, start)].sum())


def transform(key: str, text: bytes, seed: int, fim_percent: int, spm_percent: int, every: int) -> tuple:
    """Values of ADDED for one text; ``key`` is its id in decimal."""
    h1, h2, h3, h4 = struct.unpack(">4I", hashlib.sha256(f"{seed}:{key}".encode()).digest()[:16])
    index = Checkpoints(text, every)
    if not text or h3 % 100 >= fim_percent or any(m in text for m in _MARKS):
        return index.n_units, "plain", None, None, text
    low, high = sorted((h1 % (index.n_units + 1), h2 % (index.n_units + 1)))
    (a, a_chars), (b, b_chars) = index.cut(low), index.cut(high)
    p, s, m = _MARKS
    if h4 % 100 < spm_percent:
        form, output = "spm", b"".join((s, text[b:], p, text[:a], m, text[a:b]))
    else:
        form, output = "psm", b"".join((p, text[:a], s, text[b:], m, text[a:b]))
    return index.n_units, form, a_chars, b_chars - a_chars, output


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 42,
    fim_percent: int = 50,
    spm_percent: int = 80,
    every: int = EVERY,
) -> DataFrame:
    """``docs`` with ``n_units`` (long), ``form``, ``prefix_chars``, ``middle_chars`` (long) and ``output`` added.

    A text is cut in units: a word with the ASCII white space before it, or white space at the end.
    The SHA-256 of "seed:id" gives the two cuts and the form: ``fim_percent`` of the texts are
    rearranged, of those ``spm_percent`` with the suffix first. Lengths are in code points, null
    where the form is plain.

    Cases: a null text is an empty one; empty texts, and texts that hold a sentinel, stay plain.
    White space alone is one unit. Texts of any length are read whole. Cuts that meet give empty
    parts. Rows that repeat an id get the same draws; a null id is drawn as the empty string. No
    rows give no rows. Columns that bear an added name are replaced; names that begin with two
    underscores are reserved.
    """
    rest = [c for c in docs.columns if c not in ADDED]
    kept = docs.select(*rest).schema
    out = StructType([*kept, *StructType.fromDDL("n_units bigint, form string, prefix_chars bigint, middle_chars bigint, output string")])
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(len(rest)).to_pylist(), raw(batch.column(len(rest) + 1))
            made = list(zip(*(transform(k, t, seed, fim_percent, spm_percent, every) for k, t in zip(keys, texts)))) or [()] * len(ADDED)
            output = pa.array(made[-1], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *map(pa.array, made[:-1], kinds), output], names=[*rest, *ADDED])

    body = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(*[docs[c] for c in rest], F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("__key"), body.alias("__text"))
    return rows.mapInArrow(run, out)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. A sentinel can't begin inside another or run into one, so each is found where it was put."""
    front = F.substring_index(output, MIDDLE, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    rest = F.substring(front, 4, 2**31 - 1)

    def apart(mark: str) -> tuple[Column, Column]:
        return F.substring_index(rest, mark, 1), F.substring_index(front, mark, -1)

    prefix, suffix = apart(SUFFIX)
    last, first = apart(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(first, middle, last)).otherwise(output)
