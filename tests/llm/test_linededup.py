from tokentide.llm.linededup import dedup_lines

LINE = "This line is well over forty characters long, really."


def brute(rows, min_chars=40, min_docs=5):
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (i is not None and len(held.get(key(x), ())) >= min_docs and max(held[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_equals_brute_force(spark):
    rows = [(i, f"own {i}\n {LINE.upper()}\t\n\nshort") for i in range(6)]
    rows += [(6, None), (7, ""), (None, LINE), (5, LINE), (8, LINE * 3), (9, ("é" * 39 + "\n") * 3), (10, f"{LINE}\n{LINE}\r"), (2, f"{LINE}\nagain")]
    rows += [(20 + i, "É" * 40 + "\n") for i in range(5)]
    docs = spark.createDataFrame([(i, t, "x", 9) for i, t in rows], "doc_id bigint, text string, n_lines string, __extra int")
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in dedup_lines(docs).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_no_rows(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_a_text_of_very_many_lines(spark):
    lines = [f"{LINE} number {i}" for i in range(30_000)]
    rows = [(i, "\n".join(lines)) for i in range(5)]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], len(r["text"])) for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {**{i: (30_000, 30_000, 0) for i in range(4)}, 4: (30_000, 0, len(rows[0][1]))}
