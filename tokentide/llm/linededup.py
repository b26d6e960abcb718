"""Line dedup: lines held by many documents stay only in the document with the largest id.

Lines are exploded as 128-bit digests of their keys, never as text, and each (digest, document)
pair counts once before digests are counted, so a line that a third of all documents hold is spread
over its documents first and pre-aggregated after. Documents that lose lines are put together again
by position, with one set lookup a line.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentide.llm.text import lower_ascii

#: The ASCII white space that is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _digest(line: Column, min_chars: int) -> Column:
    """The key's digest, or null if the key is too short to count."""
    key = line_key(line)
    return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``text_col`` rewritten and ``n_lines``, ``n_dropped`` (long) added.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at
    least ``min_chars`` code points found in at least ``min_docs`` documents lose all their lines
    except in the largest id that holds them. Other columns pass through.

    Cases: null or empty text is one empty line. Texts of any length and number of lines are read
    whole. Rows that repeat an id count as one document and are all treated alike. Rows with a null
    id take no part in the counts and keep their lines. An input that has columns ``n_lines`` or
    ``n_dropped`` gets them replaced; names that begin with two underscores are reserved.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    digests = F.array_distinct(F.filter(F.transform(lines, lambda x: _digest(x, min_chars)), lambda d: d.isNotNull()))
    held = (
        docs.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("__id"), F.explode(digests).alias("__key"))
        .distinct()
    )
    common = held.groupBy("__key").agg(F.count("*").alias("__n"), F.max("__id").alias("__keeper")).filter(F.col("__n") >= min_docs)
    losses = (
        held.join(common, "__key")
        .filter(F.col("__id") != F.col("__keeper"))
        .groupBy("__id")
        .agg(F.collect_list("__key").alias("__drop"))
    )

    @F.pandas_udf("text string, dropped bigint")
    def without(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_without(t, d, min_chars) for t, d in zip(texts, drops)], columns=["text", "dropped"])

    body = F.coalesce(F.col(text_col), F.lit(""))
    loses = F.col("__drop").isNotNull()
    out = docs.join(losses, docs[id_col] == losses["__id"], "left").withColumn("__left", without(F.when(loses, body), F.col("__drop")))
    return out.withColumns(
        {
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": F.coalesce("__left.dropped", F.lit(0).cast("long")),
            text_col: F.coalesce("__left.text", body),
        }
    ).drop("__id", "__drop", "__left")


_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})


def _without(text: str | None, drop: list[bytes] | None, min_chars: int) -> tuple[str | None, int]:
    """The text without the lines whose keys' digests are in ``drop``, and how many those are."""
    if text is None or drop is None:
        return None, 0
    gone, lines = set(map(bytes, drop)), text.split("\n")
    keys = (line.strip(BLANKS).translate(_LOWER) for line in lines)
    kept = [line for line, key in zip(lines, keys) if len(key) < min_chars or hashlib.md5(key.encode()).digest() not in gone]
    return "\n".join(kept), len(lines) - len(kept)
