"""Toxicity and language identification: grammar by hand, held-out accuracy, edge rows."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from vouchspark.llm import langid, toxicity
from vouchspark.llm.samples import held_out, sample_keys, stratified_keys

FOLDER = "/root/testdata/sf0.01"


def test_composition_equals_running_the_machines_apart():
    tables = [toxicity.Transducer(n, f).table() for f, n in ((toxicity._negation, 5), (toxicity._report, 2), (toxicity._target, 2), (toxicity._intent, 4))]
    whole = toxicity.grammar()
    for word in itertools.product(range(7), repeat=4):
        states, state = [0] * 4, 0
        for symbol in word:
            marks = 0
            for k, t in enumerate(tables):
                states[k], m = t[states[k], symbol]
                marks |= m
            state, got = whole[state, symbol]
            assert got == marks


def test_clauses_weigh_by_their_path():
    m = toxicity.seeded()
    score = m.score
    assert score(None) == score("") == score("A plain sentence.") < 0.021
    assert score("You are an idiot.") > 0.8
    assert score("You are not an idiot.") < score("You are an idiot.")
    assert score("He said you are an idiot.") < score("You are an idiot.")
    assert score("He said this. You are an idiot.") == score("You are an idiot.")
    assert score("I will kill you.") > 0.7 > score("They kill time.")
    assert score("idiot. scum.") > score("idiot.")
    assert score("IDIOT") == score("idiot")


def test_long_text_and_late_insult():
    m = toxicity.seeded()
    assert m.score("fine words here. " * 50_000 + "you moron") > 0.8


def test_marks_change_predictions_on_given_documents(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.fit(docs, labels)
    toxic = [r["text"] for r in docs.join(labels, "doc_id").filter("toxic = 1 and lang = 'en' and length(text) < 3000").collect()]
    caught = [t for t in toxic if model.score(t) >= toxicity.CUT]
    assert len(caught) >= 20
    mark = lambda text, before: toxicity.WORD.sub(lambda w: f"{before} {w[0]}" if model.code(w[0].lower()) == toxicity.INSULT else w[0], text)
    few = [t for t in caught if sum(model.code(w.lower()) == toxicity.INSULT for w in toxicity.WORD.findall(t)) <= 2]
    assert few and all(model.score(mark(t, "not")) < toxicity.CUT for t in few)
    assert all(model.score(mark(t, "said")) < model.score(t) for t in few)
    for clean in ("The path leads to Morocco.", "Das Wort ist gut.", "He is worth a lot.", "A disguise of clowns."):
        assert model.score(clean) < 0.1


def test_doubtful_stems_count_together(spark):
    docs, labels, rng = [], [], np.random.default_rng(5)
    letters = ["".join(x) for x in itertools.product("abcd", "efgh", "ijkl", "mnop", "qr")]
    hits = [f"krumm{x}" for x in ("en", "er", "ig", "ung", "lich")]
    for i in range(900):
        words = [letters[k] for k in rng.integers(0, 400, 60)]
        n = 4 if i % 9 == 0 else 1 if i % 9 == 1 else 0
        for k in range(n):
            words[10 * k] = f"{hits[(i // 9 + k) % 5]}."
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(n == 4)))
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, l)
    assert 0 < model.symbol("krummes")[1] < toxicity.SURE_P
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(d, model).collect()}
    assert all((got[i] >= toxicity.CUT) == (i % 9 == 0) for i in range(900))
    # The same four hits are nothing special in a text that is long enough.
    assert model.score(docs[0][1] + " afin" * 100_000) < toxicity.CUT <= model.score(docs[0][1])


def test_toxicity_learns_terms_and_stems(spark):
    docs, labels, rng = [], [], np.random.default_rng(4)
    letters = ["".join(x) for x in itertools.product("abcd", "efgh", "ijkl", "mnop", "qr")]
    for i in range(900):
        bad = i % 9 == 0
        words = [letters[k] for k in rng.integers(0, 400, 30)]
        if bad:
            words[5] = ("zorgol", "plimmaten", "plimmisch")[i // 9 % 3]
        docs.append((i, " ".join(words) + ".", "x"))
        labels.append((i, 1, int(bad)))
    d, l = spark.createDataFrame(docs, "doc_id long, text string, toxicity string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, l)
    assert "plimm" in model.stems and model.words["zorgol"][0] == toxicity.INSULT
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(d, model).collect()}
    assert all((got[i] >= toxicity.CUT) == (i % 9 == 0) for i in range(900))


def test_toxicity_edges(spark):
    d = spark.createDataFrame([(None, "idiot"), (1, None), (2, ""), (2, ""), (3, "you idiot")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 0), (3, 1, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        got = toxicity.score(d, toxicity.fit(d, labels)).collect()
        assert len(got) == 5 and all(0 <= r["toxicity"] <= 1 for r in got)
    assert toxicity.score(d.limit(0), toxicity.fit(d.limit(0), none)).count() == 0


def test_held_out_toxicity(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = toxicity.score(docs.filter(F.col("lang") == "en"), toxicity.fit(docs, labels)).join(labels, "doc_id").filter(held_out())
    r = scored.agg(F.count_if((F.col("toxicity") >= 0.7) == (F.col("toxic") == 1)).alias("right"), F.count(F.lit(1)).alias("n")).first()
    assert r["right"] >= 0.97 * r["n"]


def test_held_out_toxicity_of_all_languages(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter(held_out())
    hit, toxic = F.col("toxicity") >= toxicity.CUT, F.col("toxic") == 1
    r = scored.agg(F.count_if(hit & toxic).alias("hits"), F.count_if(toxic).alias("toxic"), F.count_if(hit & ~toxic).alias("alarms"), F.count_if(~toxic).alias("clean")).first()
    # Measured 14 of 18 and 0 of 95; none of the three that are not English is found.
    assert r["toxic"] == 18 and r["hits"] >= 14 and r["alarms"] <= 0.01 * r["clean"]


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = langid.predict(docs, langid.fit(docs)).filter(held_out())
    r = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")).alias("right"), F.count_if("lang_rejected").alias("gone"), F.count(F.lit(1)).alias("n")).first()
    assert r["right"] >= 0.97 * r["n"] and r["gone"] <= 0.01 * r["n"]


def test_rare_languages_are_learned(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "le chat et le chien", "en" if i % 2 else "fr") for i in range(6000)]
    rows += [(6000 + i, "zxq vwk qqj kzz", "rare") for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = d.filter(~held_out()).select("doc_id", "lang")
    keys = stratified_keys(learned, "lang", 50, 300, langid.SEED).collect()
    assert len(set(keys)) == 300
    assert {r["doc_id"] for r in keys if r["lang"] == "rare"} == {r["doc_id"] for r in learned.filter("lang = 'rare'").collect()}
    assert set(keys) == set(stratified_keys(learned.repartition(7), "lang", 50, 300, langid.SEED).collect())
    assert {r["lang"] for r in stratified_keys(learned, "lang", 50, 3, langid.SEED).collect()} == {"en", "fr", "rare"}
    usual = learned.filter("lang <> 'rare'")
    assert set(stratified_keys(usual, "lang", 50, 300, langid.SEED).collect()) == set(sample_keys(usual, 300, langid.SEED).collect())
    model = langid.fit(d, sample_rows=300)
    assert "rare" in model.languages


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", None), (4, "aaa bbb " * 100_000, "en"), (5, "ccc ddd", "fr"), (5, "ccc ddd", "fr"), (None, "aaa", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_score", F.lit("clash"))
    model = langid.fit(d)
    got = sorted(((r["doc_id"] or 0), r["lang_pred"], r["lang_rejected"], r["lang_score"]) for r in langid.predict(d, model).collect())
    assert [g[0] for g in got] == [0, 1, 2, 3, 4, 5, 5]
    assert all(g[1] == langid.UNKNOWN and g[2] and g[3] == 0 for g in got[1:4])
    assert all(g[1] in model.languages and 0 < g[3] <= 1 for g in got[4:])
    empty = langid.fit(d.limit(0))
    assert {r["lang_pred"] for r in langid.predict(d, empty).collect()} == {langid.UNKNOWN}


def test_blocks_miss_nothing(monkeypatch):
    text = ("some words of a text that is cut " * 50) + "unbroken" * 40
    codes = langid.letter_codes(text)
    whole = np.bincount(langid.subword_buckets(codes), minlength=1 << langid.BUCKET_BITS)
    monkeypatch.setattr(langid, "BLOCK", 64)
    parts = sum(np.bincount(langid.subword_buckets(p), minlength=1 << langid.BUCKET_BITS) for p in langid.blocks(codes))
    assert (whole == parts).all() and whole.sum() > 1000


def test_terms_of_a_sample_leave_in_small_frames():
    import pandas as pd

    letters = "abcdefghij"
    texts = [" ".join(f"{letters[i // 100]}{letters[i // 10 % 10]}{letters[i % 10]}word{letters[k // 10]}{letters[k % 10]}" for k in range(50)) for i in range(300)]
    frames = list(toxicity._document_terms(iter([pd.DataFrame({"text": [*texts, "", "a b"], "toxic": [1] * 302})])))
    # One row that names no term, 50 words and stems of 5, 6 and 7 letters, which are the same for all of a text.
    assert len(frames) == 10 and max(map(len, frames)) == toxicity.TEXTS * 54
    rows = pd.concat(frames)
    assert (rows["term"] == "").sum() == 302 and (rows["term"] == "aaaworddc").sum() == 1
    assert rows[rows["term"] == "aaawo*"].values.tolist() == [[1, "aaawo*", "aaawordaa", "aaawordej"]]


def test_texts_keep_their_key_and_number_of_terms():
    import pandas as pd

    text = "one two three four five six"
    keys = pd.concat(toxicity._near_keys(iter([pd.DataFrame({"text": [text, text + " seven", "other"], "toxic": [1, 0, 1]})])))
    assert keys.columns.tolist() == ["key", "toxic", "size", "text"] and keys["size"].tolist() == [7, 9, 2]
