import math
import re
import time

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tokentide.llm import ranking
from tokentide.llm.queries import op8_bradley_terry
from tokentide.llm.wordhash import FACTORS


def test_held_out_accuracy(spark):
    rows = op8_bradley_terry(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = rows.join(labels, "doc_id").filter("held_out")
    right = held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert held.count() > 50 and right >= 0.95
    assert rows.count() == 1000 and rows.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_weights_minimise_the_loss_of_all_pairs():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.5, 1, (23, 3)), rng.normal(0, 1, (17, 3))

    def loss(w):
        pairs = [np.log1p(np.exp(-(g - b) @ w)) for g in good for b in bad]
        return sum(pairs) / len(pairs) + 5e-3 * w @ w

    w = ranking.fit_weights(good, bad)
    assert all(loss(w) <= loss(w + step) for step in rng.normal(0, 0.02, (50, 3)))


def test_cut_misplaces_fewest():
    rng = np.random.default_rng(2)
    scores, good = rng.normal(0, 1, 200), rng.random(200) < 0.7
    wrong = lambda c: ((scores >= c) != good).sum()
    cut, quantile = ranking.best_cut(scores, good)
    assert wrong(cut) == min(wrong(c) for c in [*scores, -9, 9]) and quantile == (scores < cut).mean()
    assert ranking.best_cut(np.array([1.0, 2.0]), np.array([False, True])) == (1.5, 0.5)


def test_scores_equal_a_plain_model(spark):
    """The whole query against a slow one: features by plain counting, every pair's difference made, gradient descent's optimum tested."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    quality = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in texts}
    model = ranking.learn(docs, labels)

    def plain(text):
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        word_hash = [xxhash.xxh64_intdigest(w) for w in words]
        letters = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()
        hashed = [mixed(h) for h in word_hash] + [mixed((a * FACTORS[0] + b) % 2**64) for a, b in zip(word_hash, word_hash[1:])]
        out = ranking.surface(None if text is None else text.encode())
        for hashes in (hashed, [mixed((a << 16) + (b << 8) + c) for a, b, c in zip(letters, letters[1:], letters[2:])]):
            counts = [0] * 256
            for h in hashes:
                counts[h % 256] += 1
            logs = [math.log1p(c) for c in counts]
            length = math.sqrt(sum(x * x for x in logs)) or 1.0
            out = out + [x / length for x in logs]
        return out

    x = {i: np.array(plain(t)) for i, t in texts.items()}
    z = {i: (x[i] - model.mean) / model.spread for i in x}
    rows = [i for i in quality if i in x]
    assert np.allclose(model.mean, np.mean([x[i] for i in rows], 0), atol=1e-9)
    slope = np.zeros(ranking.FEATURES)
    pairs = [(g, b) for g in rows for b in rows if quality[g] == 1 and quality[b] == 0]
    for g, b in pairs:
        d = z[g] - z[b]
        slope -= d / (1 + math.exp(d @ model.weights)) / len(pairs)
    assert np.abs(slope + 1e-2 * model.weights).max() < 1e-6
    for r in ranking.score_documents(docs, model).collect():
        want = 1 / (1 + math.exp(-(z[r["doc_id"]] @ model.weights - model.cut + math.log(0.7 / 0.3))))
        assert abs(r["score"] - want) < 1e-9


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
    return x ^ (x >> 31)


def test_edge_rows(spark):
    texts = [(1, "good plain prose about things"), (2, "### $$$ %%% ***"), (3, None), (4, ""), (None, "text"), (1, "again"), (5, "a" * 100_000), (6, " \n ")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None), (77, 0), (4, 5)], "doc_id bigint, quality int")
    model = ranking.learn(docs, labels)
    scored = ranking.score_documents(docs, model).collect()
    assert len(scored) == len(texts) and all(0 <= r["score"] <= 1 for r in scored)
    of = {r["doc_id"]: r["score"] for r in scored}
    assert of[2] < ranking.CUT <= of[5] or of[2] < ranking.CUT
    assert of[3] == of[4]
    flat = ranking.learn(docs, labels.filter("quality = 1"))
    assert {round(r["score"], 9) for r in ranking.score_documents(docs, flat).collect()} == {ranking.CUT}
    assert ranking.score_documents(docs.limit(0), model).count() == 0


def test_the_sample_is_bounded(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert ranking.labelled_sample(docs, labels, "doc_id", "text", "quality", 40).count() == 40


def test_rows_that_repeat_an_id_count_once(spark):
    docs = spark.createDataFrame([(1, f"good words number {i}") for i in range(500)] + [(2, "bad")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    assert ranking.labelled_sample(docs, labels, "doc_id", "text", "quality", 10).count() == 2


def test_all_labelled_rows_are_learnt_from(spark):
    """7,000 labelled rows; the weights are those of all pairs in memory, the cut that of all scores."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words[: 200 if i % 3 else 300], 6)), int(i % 3 > 0)) for i in range(7_000)]
    both = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = ranking.learn(both.select("doc_id", "text"), both.select("doc_id", "quality"))
    x = np.array([ranking.features(t.encode()) for _, t, _ in rows])
    good = np.array([q == 1 for _, _, q in rows])
    assert np.allclose(model.mean, x.mean(0), rtol=1e-10, atol=1e-12)
    z = (x - model.mean) / model.spread
    w = ranking.fit_weights(z[good], z[~good])
    assert np.abs(model.weights - w).max() < 1e-9 and np.abs(w).max() > 0.1
    cut, quantile = ranking.best_cut(np.array([model.weights @ row for row in z]), good)
    assert abs(model.cut - cut) < 1e-9 and model.quantile == quantile


def test_what_is_shuffled_follows_the_rows(spark):
    """A table of features in 16 files: sums do not take disk by the file, and are gone from it when learning ends."""
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "64k"}
    docs = spark.range(640).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.hash("id"), F.hash("id", "id"), F.when(F.col("id") % 3 > 0, "plain prose").otherwise("### $$$")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    sc, before = spark.sparkContext, {k: spark.conf.get(k) for k in held}
    left = lambda: {str(f) for f in iter_java(sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    old = left()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("learning", "")
        model = ranking.learn(docs, labels)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("learning") for s in sc.statusTracker().getJobInfo(j).stageIds}
    moved = sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteBytes() for s in stages)
    assert np.abs(model.weights).max() > 0.1 and len(stages) > 10
    assert 0 < moved < 16 * 8 * ranking.FEATURES**2
    until = time.time() + 10
    while left() - old and time.time() < until:
        time.sleep(0.1)
    assert not left() - old


def iter_java(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def test_cells_give_a_smooth_function():
    scores = np.linspace(-30, 30, 1001)
    cell, weights = ranking.cells(scores)
    for f in (lambda t: 1 / (1 + np.exp(t - 0.7)), lambda t: 1 / np.cosh((t - 0.7) / 2) ** 2 / 4):
        got = [by @ f(ranking._nodes([c])) for c, by in zip(cell, weights)]
        assert np.abs(got - f(scores)).max() < 1e-10


def test_cut_of_a_table(spark):
    rng = np.random.default_rng(5)
    for good in (rng.random(400) < 0.6, np.zeros(400, bool), np.ones(400, bool)):
        z = rng.normal(good * 1.0, 1)
        table = spark.createDataFrame([(float(a), int(b)) for a, b in zip(z, good)], "z double, __good int")
        assert ranking.cut_rows(table) == ranking.best_cut(z, good)


def test_many_labels_are_joined_by_shuffle(spark, small, monkeypatch):
    docs, labels = (spark.read.parquet(f"{small}/{name}.parquet") for name in ("documents", "labels"))
    sample = lambda: sorted(map(tuple, ranking.labelled_sample(docs, labels, "doc_id", "text", "quality").collect()))
    few = sample()
    monkeypatch.setattr(ranking, "BROADCAST_LABELS", 0)
    assert sample() == few and len(few) > 50
