"""Hash history: filters, files read per batch, compaction."""

import hashlib

from pyspark.sql import functions as F

from vouchspark.streaming import history as H
from vouchspark.streaming import tables as T


def hashes(spark, names, version=1):
    rows = [(hashlib.sha256(n.encode()).hexdigest(), version + i) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "sha256 string, corpus_version long")


def test_only_buckets_that_may_hit_are_read(spark, tmp_path):
    root = str(tmp_path)
    for number in range(3):
        H.remember(hashes(spark, [f"doc {number} {i}" for i in range(40)], 1 + 40 * number), root, number, 16)
    assert H.last_version(spark, root, 3) == 120 and H.last_version(spark, root, 1) == 40
    known = H.known_hashes(spark, root, hashes(spark, [f"new {i}" for i in range(200)]), 3, 16)
    assert known.count() == 0 and len(known.inputFiles()) == 0
    one = hashes(spark, ["doc 1 7", *[f"new {i}" for i in range(200)]])
    known = H.known_hashes(spark, root, one, 3, 16)
    bucket = one.select(H.bucket_of(F.col("sha256"), 16)).first()[0]
    assert [r[0] for r in known.collect()] == [hashlib.sha256(b"doc 1 7").hexdigest()]
    # The scan of the history is cut to the folders of that bucket: one file per batch of 41 in all.
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    assert "bucket#" in plan and f"= {bucket})" in plan
    held = T.read_table(spark, root, "hashes", H.HASHES, before=3)
    files = {r[0] for r in held.filter(F.col("bucket") == bucket).select(F.input_file_name()).distinct().collect()}
    assert files and all(f"/bucket={bucket}/" in f for f in files) and len(files) <= 3 < len(held.inputFiles())
    # A batch that runs again does not see itself.
    assert H.known_hashes(spark, root, one, 1, 16).count() == 0


def test_filters_have_no_false_negatives(spark):
    known = hashes(spark, [f"k{i}" for i in range(500)]).select("sha256").withColumn("bucket", H.bucket_of(F.col("sha256"), 4))
    others = hashes(spark, [f"o{i}" for i in range(500)]).select("sha256").withColumn("bucket", H.bucket_of(F.col("sha256"), 4))
    filters = H.filter_words(known)
    assert H.may_occur(known, filters).count() == 500
    assert H.may_occur(others, filters).count() <= 5
    assert H.may_occur(known, filters.limit(0)).count() == 0


def test_compaction_keeps_rows_and_the_newest_batch(spark, tmp_path):
    root, schema = str(tmp_path), "x long, bucket int"
    assert T.compact_table(spark, root, "t", schema) is None
    for number in range(4):
        T.write_batch(spark.range(number * 10, number * 10 + 10).select(F.col("id").alias("x"), (F.col("id") % 2).cast("int").alias("bucket")), root, "t", number, ["bucket"])
    want = sorted((i, i % 2, i // 10) for i in range(40))
    read = lambda **k: sorted((r["x"], r["bucket"], r["batch"]) for r in T.read_table(spark, root, "t", schema, **k).collect())
    assert T.compact_table(spark, root, "t", schema, ["bucket"]) == 2
    assert read() == want and read(before=2) == want[:20] and read(before=3) == want[:30]
    assert len({r[0] for r in T.read_table(spark, root, "t", schema, before=3).filter("bucket = 0").select(F.input_file_name()).collect()}) == 1
    assert T.compact_table(spark, root, "t", schema, ["bucket"]) == 2
    T.write_batch(spark.range(40, 50).select(F.col("id").alias("x"), (F.col("id") % 2).cast("int").alias("bucket")), root, "t", 4, ["bucket"])
    assert T.compact_table(spark, root, "t", schema, ["bucket"]) == 3
    assert read() == sorted((i, i % 2, i // 10) for i in range(50))
