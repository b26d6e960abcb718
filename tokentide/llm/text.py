"""Byte-level word splitting shared by the operators. Texts travel as UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))

#: Lower-cases A-Z and nothing else.
LOWER_ASCII = bytes.maketrans(_UPPER, _LOWER)

#: Lower-cases A-Z and blanks every ASCII byte that is neither a digit nor a letter.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def raw(texts: pa.Array) -> list[bytes | None]:
    """An Arrow string column as UTF-8 bytes; nulls stay None. The cast copies nothing."""
    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()


def spaced_words(text: bytes | None) -> list[bytes]:
    """Maximal runs free of ASCII white space (bytes.split knows exactly those six)."""
    return text.split() if text else []


def lowered_words(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER_ASCII).split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII digits, ASCII letters and non-ASCII characters."""
    return text.translate(WORD_BYTES).split() if text else []


def lower_ascii(col: Column) -> Column:
    return F.translate(col, _UPPER.decode(), _LOWER.decode())


def map_texts(
    docs: DataFrame, fn: Callable[[bytes | None], tuple], added: str, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` (its columns ``keep``, else all) with the columns ``added`` that ``fn`` makes of each whole text.

    Columns that bear an added name are replaced.
    """
    new = StructType.fromDDL(added)
    names = [f.name for f in new]
    rest = [c for c in (docs.columns if keep is None else keep) if c not in names]
    kept = docs.select(*rest).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fn(t) for t in raw(batch.column(len(rest)))]
            made = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(new)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *made], names=[*rest, *names])

    rows = docs.select(*[docs[c] for c in rest], docs[text_col].cast("string").alias("__text"))
    return rows.mapInArrow(run, StructType([*kept, *new]))
