"""Language mixture and toxicity models: held-out accuracy and odd rows."""

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F

from gavel.llm import language_id, toxicity
from gavel.llm.common import id_crc
from gavel.llm.queries import QUERIES


def test_held_out_languages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op3_language_id"](spark, sf_small).join(docs, "doc_id").filter("held_out").toPandas()
    assert len(got) > 20 and (got.lang_pred == got.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_mixture_finds_both_languages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    langs, model = language_id.fit(docs)
    pick = {r.lang: r.text for r in docs.filter("lang in ('en', 'de') and n_chars between 1500 and 4000").dropDuplicates(["lang"]).collect()}
    texts = [pick["en"], pick["de"], pick["en"][:1200] + " " + pick["de"][:1200]]
    sets, share = language_id.infer(pa.array([f" {t.lower()} " for t in texts]), langs, model)
    assert [langs[i] for i in share.argmax(axis=1)[:2]] == ["en", "de"]
    assert {langs[i] for i in np.flatnonzero(sets[2])} >= {"en", "de"} and 0.3 < share[2, langs.index("en")] < 0.7


def test_em_raises_the_likelihood():
    rng = np.random.default_rng(1)
    like = rng.random((50, 3))
    doc, count = np.repeat([0, 1], 25), np.ones(50)
    ones = np.ones((2, 3))
    fits = [language_id.mixture(doc, count, like, 2, ones, n)[1] for n in (1, 3, 10)]
    assert (fits[0] <= fits[1] + 1e-12).all() and (fits[1] <= fits[2] + 1e-12).all()


def test_language_on_odd_rows(odd_documents, no_documents):
    model = language_id.fit(odd_documents)
    got = language_id.predict(odd_documents, *model).toPandas()
    assert len(got) == 11
    by = got.dropna(subset=["id"]).drop_duplicates("id").set_index("id")
    assert (by.lang_pred[[3, 4, 5, 9]] == "und").all() and (by.score[[3, 4, 5, 9]] == 0).all()
    assert by.lang_pred[8] in ("de", "en")
    kept = language_id.keep_known(odd_documents, model)
    assert kept.columns == odd_documents.columns and kept.count() == 7
    assert language_id.predict(no_documents, *model).count() == 0
    empty = language_id.fit(no_documents)
    assert empty[0] == [] and set(language_id.predict(odd_documents, *empty).toPandas().lang_pred) == {"und"}


def auc(score, label):
    rank = score.rank()
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op10_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert auc(got.score, got.toxic) > 0.93
    assert (got.predicted == got.toxic).mean() > 0.95
    assert ((got.predicted == 1) == (got.score >= 0.5)).all()


def test_toxicity_on_odd_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, 0), (6, 1, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(odd_documents, labels).toPandas()
    assert len(got) == 11 and got.score.between(0, 1).all() and set(got.predicted) <= {0, 1}
    held = {r.doc_id: r.h for r in odd_documents.select("doc_id", (id_crc("doc_id") % 5 == 0).alias("h")).collect()}
    assert all(r.held_out == held[None if np.isnan(r.doc_id) else r.doc_id] for r in got.itertuples())
    assert toxicity.score(odd_documents, labels.limit(0)).count() == 11
    assert toxicity.score(no_documents, labels).count() == 0


def test_labels_outside_the_folds_change_nothing(spark, sf_small):
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(id_crc("doc_id") % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score(docs, x).orderBy("doc_id").toPandas() for x in (labels, flipped))
    assert np.allclose(a.score, b.score)


def class_documents(spark, word_of):
    rows = [(i, f"filler common {word_of(i, i % 2)}", i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return docs.select("doc_id", "text"), docs.select("doc_id", "toxic")


def test_words_of_one_hash_bucket_are_told_apart(spark):
    low = F.xxhash64(F.concat(F.lit("w"), F.col("id").cast("string"))).bitwiseAND(F.lit((1 << 20) - 1))
    a, b = spark.range(5000).groupBy(low).agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("a", "b").first()
    docs, labels = class_documents(spark, lambda i, toxic: f"w{a}" if toxic else f"w{b}")
    got = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert auc(got.score, got.toxic) > 0.95


def test_words_a_few_times_likelier_in_toxic_texts_count(spark):
    # in 60% of the toxic texts and 10% of the others
    docs, labels = class_documents(spark, lambda i, toxic: "edgy" if i * 7919 % 100 < (60 if toxic else 10) else "plain")
    got = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert auc(got.score, got.toxic) > 0.6


def plain_kneser_ney(texts, said, out):
    """log P(toxic) - log P(ordinary) of every text by plain counting, without fold ``out``."""
    from collections import Counter
    from math import log

    words = {i: ["", *t.split()] for i, t in texts.items()}
    every = {(v, w) for i in said for v, w in zip(words[i], words[i][1:], strict=False)}
    size, pairs = len({w for _, w in every}), []
    for c in (1, 0):
        pairs.append(Counter(p for i, (toxic, fold) in said.items() if toxic == c and fold != out for p in zip(words[i], words[i][1:], strict=False)))
    before = [Counter(w for _, w in n) for n in pairs]
    different = [len(n) for n in pairs]

    def discount(n):
        once, twice = (sum(x == k for x in n.values()) for k in (1, 2))
        return once / (once + 2 * twice) if once else 0.5

    def probability(c, v, w):
        shared = (before[0][w] + before[1][w] + 0.5) / (sum(different) + 0.5 * (size + 1))
        d = discount(before[c])
        p = (max(before[c][w] - d, 0) + d * len(before[c]) * shared) / different[c]
        after = {x: n for (a, x), n in pairs[c].items() if a == v}
        d = discount(pairs[c])
        return (max(pairs[c][v, w] - d, 0) + d * len(after) * p) / sum(after.values()) if after else p

    return {i: sum(log(probability(0, v, w)) - log(probability(1, v, w)) for v, w in zip(x, x[1:], strict=False)) for i, x in words.items()}


def test_ratios_are_those_of_plain_word_pair_models(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = {i: " ".join(f"w{x}" for x in rng.zipf(1.6, rng.integers(0, 30)) % 50) for i in range(60)}
    fold = {r.doc_id: r.k for r in spark.createDataFrame([(i,) for i in texts], "doc_id long").select("doc_id", (id_crc("doc_id") % 5).alias("k")).collect()}
    docs = spark.createDataFrame([(i, t.upper() + " !") for i, t in texts.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in texts if i % 7], "doc_id long, toxic int")
    said = {i: (int(i % 3 == 0), fold[i]) for i in texts if i % 7 and fold[i]}
    whole = plain_kneser_ney(texts, said, 0)
    crossed = {k: plain_kneser_ney(texts, said, k) for k in toxicity.FOLDS}
    # once in one round, once in several over small packs and ranges
    for pack, words in ((toxicity.PACK, toxicity.RANGE), (100, 20)):
        monkeypatch.setattr(toxicity, "PACK", pack)
        monkeypatch.setattr(toxicity, "RANGE", words)
        monkeypatch.setattr(toxicity, "ROUNDS", 2)
        got = toxicity.ratio_sums(docs, labels, "doc_id", "text", "toxic").collect()
        assert sorted(r["id"] for r in got) == sorted(texts)
        for r in got:
            assert r.words == len(texts[r["id"]].split())
            assert abs(r.whole[0] - whole[r["id"]]) < 1e-9
            if r["id"] in said:
                assert abs(r.crossed[0] - crossed[fold[r["id"]]][r["id"]]) < 1e-9


def test_phrases_of_everyday_words_count(spark):
    # all texts hold the same words; their order tells the classes apart
    docs, labels = class_documents(spark, lambda i, toxic: "dog bites man" if toxic else "man bites dog")
    got = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert auc(got.score, got.toxic) > 0.95
