import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokentide.llm.fim import Checkpoints, fill_in_middle, restored

UNITS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plainly(key, text, seed=42, fim=50, spm=80):
    """The transformation from a list of all units."""
    text = text or ""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(" \t\n\x0b\x1c\x85abß漢😀", max_size=60), st.integers(1, 5), st.integers(1, 9))
def test_cuts_equal_those_of_all_units(text, every, block):
    index = Checkpoints(text.encode(), every, block)
    units = UNITS.findall(text)
    assert (index.n_units, index.n_chars) == (len(units), len(text))
    for k in range(len(units) + 1):
        head = "".join(units[:k])
        assert index.cut(k) == (len(head.encode()), len(head))


def odd_rows():
    rng = random.Random(5)
    words = ["a", "bb", "漢字", "<S", "P>", "<", "S>", "é", "😀😀", "<P", "\x00x", "M><"]
    rows = [(i, rng.choice(["", " ", "\n"]).join(rng.choice(words) + rng.choice([" ", "\n\t", ""]) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "has <P> in it"), (None, "no id at all here"), (None, "no id at all here"), (7, "again"), (7, "again")]
    return rows + [(k, " ".join(["long" * (j % 7 + 1) for j in range(60_000)])) for k in (2000, 2001, 2002)] + [(2003, "x" * 500_000)]


@pytest.mark.parametrize("fim, spm", [(50, 80), (100, 0), (100, 100)])
def test_rows_equal_the_plain_form_and_come_back(spark, fim, spm):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, form string")
    out = fill_in_middle(docs, fim_percent=fim, spm_percent=spm, every=8).withColumn("back", restored(F.col("output"), F.col("form")))
    got = out.collect()
    mine = sorted(((r["doc_id"], r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=repr)
    assert mine == sorted(((i, *plainly(i, t, fim=fim, spm=spm)) for i, t in rows), key=repr)
    assert all(r["back"] == (r["text"] or "") for r in got)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id string, text string, output int")
    out = fill_in_middle(docs)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "n_units", "form", "prefix_chars", "middle_chars", "output"]
