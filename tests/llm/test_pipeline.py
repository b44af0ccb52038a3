"""Each stage against a brute-force version of its decisions, on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F
from test_decontaminate import brute as hits
from test_jaccard import brute as groups

from seqlytics.llm.common import written


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_copies", "decontamination", "packing"]
    quality, near, clean, pack = (f for _, f in corpus_pipeline.STAGES)

    kept = written(quality(spark, docs, sf_dir), "t")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == columns and all((d in ids) == (q == 1) for d, q in labels.items())

    before = [(r["doc_id"], r["text"]) for r in kept.collect()]
    single = written(near(spark, kept, sf_dir), "t")
    want = {d for d, (_, root, _) in groups(before, 5, 80).items() if d == root}
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == want

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = written(clean(spark, single, sf_dir), "t")
    found = {r["doc_id"]: hits(r["text"], items) for r in single.collect()}
    after = {r["doc_id"]: r["text"] for r in left.collect()}
    assert left.columns == columns and set(after) == {d for d, h in found.items() if not h[4]}
    for r in single.collect():
        if r["doc_id"] in after:
            assert (after[r["doc_id"]] == r["text"]) == (found[r["doc_id"]][1] == 0)
    assert left.where(F.length("text") != F.col("n_chars")).count() == 0

    pieces = pack(spark, left, sf_dir)
    assert {r["doc_id"] for r in pieces.collect()} == set(after)
    by = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.count(F.lit(1)), F.sum("n")).first()
    assert by[0] <= 2048 and by[1] <= -(-by[2] // 2048) + 1


def test_nulls_repeats_and_extra_columns(spark, sf_dir):
    rows = [(1, None, "en", "s", 0, "x"), (None, "The words of it. And of that.", "en", "s", 5, "x"), (None, "The words of it. And of that.", "en", "s", 5, "y"), (2, "", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() >= 0
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.keep_one_copy(spark, docs, sf_dir).count() == 4
