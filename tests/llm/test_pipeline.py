"""The pipeline's stages against what they promise, on made documents."""

import corpus_pipeline
from vouchspark.llm import mixing, toxicity


def test_stages_keep_columns_and_do_their_work(spark, tmp_path):
    docs, labels = [], []
    for i in range(120):
        text = " ".join(f"{'abcdefgh'[(i * 7 + k * k) % 8]}{'ijklmnop'[(i + k) % 8]}word{'qrstuv'[(i * k) % 6]}" for k in range(40))
        if i % 10 == 3:
            text += " you stupid idiot"
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 10 == 3)))
    docs += [(200, docs[0][1], "en", "s1", 5), (201, docs[0][1] + " more", "en", "s1", 5), (202, None, "en", "s1", None), (203, "123 !", None, None, 5), (204, "", "en", "s2", 0)]
    folder = str(tmp_path)
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "near_duplicates", "mixture", "packed"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, folder)
        path = f"{folder}/{name}"
        d.write.parquet(path)
        d = spark.read.parquet(path)
        if name != "packed":
            assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen[name] = d
    ids = {n: {r["doc_id"] for r in seen[n].select("doc_id").collect()} for n in names}
    assert not ids["language_id"] & {202, 203, 204} and ids["language_id"] >= set(range(120)) | {200, 201}
    assert ids["toxicity"] == {i for i in ids["language_id"] if i % 10 != 3 or i >= 200}
    assert {0} == ids["near_duplicates"] & {0, 200, 201} and ids["near_duplicates"] <= ids["toxicity"]
    assert ids["mixture"] <= ids["near_duplicates"] and ids["packed"] == ids["mixture"]
    taken = {r["source"]: r["w"] for r in seen["mixture"].groupBy("source").agg({"text": "count"}).withColumnRenamed("count(text)", "w").collect()}
    assert set(taken) == {"s0", "s1", "s2"}
    assert toxicity.CUT == 0.7 and mixing.MAX_EPOCHS == 3
