"""Held-out accuracy, and what the scores may depend on."""

import numpy as np
from pyspark.sql import functions as F

from seqlytics.llm import quality, queries


def test_pairs_order_documents():
    rng = np.random.default_rng(1)
    good = rng.random(400) < 0.8
    x = rng.normal(0, 1, (400, len(quality.FEATURES)))
    x[:, 3] += 3 * good
    model = quality.fit_pairs(x, good)
    assert model.weights[3] == max(model.weights)
    scores = model.score(x)
    assert ((scores >= quality.CUT_SCORE) == good).mean() > 0.9
    assert abs((scores < quality.CUT_SCORE).mean() - (~good).mean()) < 0.01  # the cut is that quantile


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = queries.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right, n = got.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count(F.lit(1))).first()
    assert n > 50 and right / n > 0.95


def test_scores_depend_on_the_text_alone(spark):
    model = quality.Model(np.zeros(len(quality.FEATURES)), np.ones(len(quality.FEATURES)), np.linspace(-1, 1, len(quality.FEATURES)), 0.0)
    rows = [(1, "One text.", "x"), (None, "One text.", "y"), (3, None, "x"), (4, "", None), (5, " \n", "x"), (6, "a " * 300_000, "x"), (7, "##|## !!!", "x")]
    got = {r["doc_id"]: r for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, n string"), model).collect()}
    assert got[1]["score"] == got[None]["score"] and got[None]["n"] == "y"
    assert got[3]["score"] == got[4]["score"] == got[5]["score"]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_cut_is_of_all_labels_where_the_sample_is_not(spark):
    rng = np.random.default_rng(2)
    good = rng.random(3000) < 0.9
    marks = rng.binomial(12, np.where(good, 0.4, 0.6))
    docs = spark.createDataFrame([(i, "some plain words here " * 5 + f"x{i} " + "# " * int(m)) for i, m in enumerate(marks)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")
    model = quality.fit(docs, labels, sample_rows=200)
    worth = np.sort(model.worth(np.array([quality.features_of(r["text"].encode()) for r in docs.collect()])))
    assert abs(model.cut - np.quantile(worth, 1 - good.mean())) < 1e-9
    dropped = quality.score(docs, model).where(F.col("score") < quality.CUT_SCORE).count()
    assert abs(dropped / 3000 - (~good).mean()) < 0.01


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for rows in ([], [(1, 1)], [(None, 0), (1, None)]):
        model = quality.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        assert abs(quality.score(docs, model).first()["score"] - quality.CUT_SCORE) < 1e-9
    assert quality.score(docs.limit(0), model).collect() == []


def test_scores_equal_a_plain_version(spark, sf_dir):
    """Features word by word, worths as plain sums, and the scores of the registered query."""
    model = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out(F.col("doc_id"))))
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op4_quality(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        data, words = text.encode(), text.encode().split()
        if words:
            black = max(1, sum(c > 32 for c in data))
            letters = max(1, sum(65 <= c <= 90 or 97 <= c <= 122 for c in data))
            run = longest = 0
            for a, b in zip(words, words[1:], strict=False):
                run = run + 1 if a == b else 0
                longest = max(longest, run)
            symbols, lines = [c in b"#$%&*+<=>@^_`{}~\\|" for c in data], [x for x in data.split(b"\n") if x]
            n = len(words)
            x = [
                np.log1p(n), np.log1p(black / n), sum(65 <= c <= 90 for c in data) / letters, sum(48 <= c <= 57 for c in data) / black, sum(c in b".,;:?!()'\"-" for c in data) / black, data.count(b"!") / n, sum(symbols) / n, data.count(b"|") / n,
                sum(c > 127 for c in data) / black, data.count(b"\n") / n, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, sum(w.isupper() for w in words) / n, sum(symbols) / black,
                np.log1p(longest), max(map(words.count, set(words))) / n, 1 - len(set(lines)) / len(lines), data.count(b".") / n,
            ]
        else:
            x = [0.0] * len(quality.FEATURES)
        worth = sum((v - m) / s * w for v, m, s, w in zip(x, model.mean, model.scale, model.weights, strict=True))
        score = 1 / (1 + np.exp(-(worth - model.cut + np.log(0.7 / 0.3))))
        assert abs(got[d]["score"] - score) < 1e-6 and got[d]["predicted"] == int(got[d]["score"] >= 0.7)


def test_a_column_called_score_is_replaced_and_hot_keys_are_bounded(spark):
    rows = [(i, f"plain words number {i} of it", 5.0) for i in range(50)] + [(1, "same", 5.0)] * 300 + [(2, f"other {i} #", 5.0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(50)], "doc_id long, quality int")
    x, good = quality.labelled_features(docs, labels, "doc_id", "text", "quality", 20)
    assert len(x) == len(good) <= 4 * 20
    got = quality.score(docs, quality.fit(docs, labels, sample_rows=20))
    assert got.columns == ["doc_id", "text", "score"] and got.where("score > 1").count() == 0 and got.count() == len(rows)
