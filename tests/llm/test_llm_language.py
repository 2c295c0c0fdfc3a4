from __future__ import annotations

import zlib

import numpy as np
from llm_cases import DOCS, TEXTS, clashing, documents
from meterline.llm import language_id as G
from pyspark.sql import functions as F


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = G.query(spark, small).collect()
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_labels_change_nothing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    other = docs.withColumn("lang", F.when(G.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = G.fit(docs), G.fit(other)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights) and a.temperature == b.temperature


def test_odd_texts(spark, small):
    model = G.fit(spark.read.parquet(f"{small}/documents.parquet"))
    rows = TEXTS + [(30, "123 !?"), (31, "é"), (32, "日本語")]
    got = G.predict(clashing(documents(spark, rows)), model).collect()
    assert len(got) == len(rows)
    want = {i: t is None or not any(c.isalpha() for c in t) for i, t in rows}
    assert all((r.lang_pred == "und") == want[r.doc_id] and (r.score == 0.0) == want[r.doc_id] for r in got)


def test_nothing_to_learn(spark):
    for docs in (spark.createDataFrame([], DOCS), documents(spark).withColumn("lang", F.lit(None).cast("string"))):
        model = G.fit(docs)
        assert model is None
        assert {r.lang_pred for r in G.predict(docs, model).collect()} <= {"und"}


def test_one_language(spark):
    model = G.fit(documents(spark))
    assert model.languages == ["en"]
    assert {r.lang_pred for r in G.predict(documents(spark), model).collect()} == {"en", "und"}


def test_leader_equals_the_plain_update():
    rng = np.random.default_rng(1)
    rows = [(np.array([1, 5, 9]), rng.random(3)), (np.array([2, 5]), rng.random(2)), (np.array([1, 9]), rng.random(2))]
    labels, k = [0, 1, 0], 2
    z, n, w = (np.zeros((12, k)) for _ in range(3))
    for _ in range(G.PASSES):
        for (at, x), y in zip(rows, labels):
            for i in at:
                for c in range(k):
                    w[i, c] = 0.0
                    if abs(z[i, c]) > G.L1:
                        w[i, c] = -(z[i, c] - np.sign(z[i, c]) * G.L1) / ((G.BETA + n[i, c] ** 0.5) / G.ALPHA + G.L2)
            logit = np.array([sum(v * w[i, c] for i, v in zip(at, x)) for c in range(k)])
            p = np.exp(logit) / np.exp(logit).sum()
            for i, v in zip(at, x):
                for c in range(k):
                    g = v * (p[c] - (c == y))
                    s = ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / G.ALPHA
                    z[i, c] += g - s * w[i, c]
                    n[i, c] += g * g
    got = G.follow_the_leader(rows, labels, k)[:12]
    want = np.where(np.abs(z) > G.L1, -(z - np.sign(z) * G.L1) / ((G.BETA + np.sqrt(n)) / G.ALPHA + G.L2), 0)
    assert np.allclose(got, want, atol=1e-6)


def test_whole_query_equals_a_plain_one(spark, tmp_path):
    """Frequencies, fit, temperature and prediction on rows below the sample's bound."""
    rnd = np.random.default_rng(4)
    letters = {"xx": "abcdefg ", "yy": "efghijkl ", "zz": "klmnopa "}
    rows = [(i, "".join(rnd.choice(list(letters[lang]), 60)), lang) for i, lang in enumerate(list(letters) * 30)]
    rows += rows[:9] + [(200, None, "xx"), (201, "abc", None), (202, "12 3", "yy"), (203, "abc abd", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clashing(df).repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    hashes = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).collect()}

    crc = lambda i: zlib.crc32(str(i).encode())
    grams, model_rows, seen, total = G.Grams(), {}, np.zeros(G.BUCKETS), 0
    for i, text, lang in rows:
        if crc(i) % 5 and lang and text is not None and (found := grams(text)):
            seen[found[0]] += 1
            total += 1
            model_rows[hashes[i, text], i, lang] = (found, crc(i) % 5)
    idf = np.log((1.0 + total) / (1.0 + seen)) + 1.0
    languages = sorted(letters)
    model = G.Model(languages, idf, np.zeros((1, 1)), 1.0)
    ordered = [(lang, model.vector(*found), found[0], fold) for (_, _, lang), (found, fold) in sorted(model_rows.items())]
    learnt = [r for r in ordered if r[3] != 1]
    w = G.follow_the_leader([(at, x) for _, x, at, _ in learnt], [languages.index(r[0]) for r in learnt], 3)
    tested = [r for r in ordered if r[3] == 1]
    logits = np.array([x @ w[at] for _, x, at, _ in tested])
    model = G.Model(languages, idf, w, G.temperature(logits, np.array([languages.index(r[0]) for r in tested])))

    want = []
    for i, text, _ in rows:
        found = grams(text)
        p = model.probabilities(*found) if found else None
        want.append((i, languages[p.argmax()] if found else "und", float(p.max()) if found else 0.0))
    got = [(r.doc_id, r.lang_pred, r.score) for r in G.query(spark, str(tmp_path)).collect()]
    assert [g[:2] for g in sorted(got)] == [x[:2] for x in sorted(want)]
    assert np.allclose([g[2] for g in sorted(got)], [x[2] for x in sorted(want)], atol=1e-5)


def test_repeated_rows_do_not_fill_the_sample(spark):
    same = [(1, "abc abd", "xx")] * 500
    other = [(i, f"word {'e' * (i % 30)} zz", "yy") for i in range(2, 60)]
    df = spark.createDataFrame(same + other, "doc_id long, text string, lang string")
    assert G.fit(df, sample=20).languages == ["xx", "yy"]


def test_temperature_is_the_best_on_its_grid():
    logits = np.array([[2.0, 0.0], [0.0, 1.0], [0.2, 0.0], [1.0, 0.5], [0.0, 2.0], [1.0, 0.0]])
    labels = np.array([0, 1, 1, 0, 1, 0])
    own = G.temperature(logits, labels)
    assert 0.03 < own < 15
    assert abs(G.temperature(logits * 1.3, labels) / (1.3 * own) - 1) < 0.05
