"""Language identification by multilingual mixture inference.

Every language has a smoothed distribution over byte trigrams of lower-cased
letters (hashed into ``GRAMS`` buckets), counted over all training rows. A
document is a mixture of languages; expectation-maximisation estimates its
proportions. The language set is the prefix of the languages, ordered by
proportion, with the best penalised likelihood (a Bayesian information
criterion); the predicted language is the largest proportion within that set,
and the score is that proportion.

The model holds languages x GRAMS numbers whatever the corpus size.

Defined cases: text that is null or has no letter gives ``und`` with score 0
and an empty set; no training row at all gives ``und`` for every text; ties go
to the alphabetically first language.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm import common
from gavel.llm.common import by_value, release_memory, slices

by_value(sys.modules[__name__])
by_value(common)

GRAMS = 1 << 16
#: Letters a-z keep their byte, UTF-8 bytes above 127 too; all else is a space.
KEEP = np.array([c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint8)
CHUNK = 1 << 18
ROUNDS = 12
UNKNOWN = "und"


def prepared(text):
    """Lower case with a space at both ends; null where there is no letter."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.rlike("\\p{L}"), F.concat(F.lit(" "), F.lower(c), F.lit(" ")))


def gram_counts(texts: pa.Array):
    """(document, trigram bucket, count), sorted by document, of an Arrow
    string array without nulls. Trigrams over two spaces are left out."""
    off = np.frombuffer(texts.buffers()[1], dtype=np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    b = KEEP[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[off[0] : off[-1]]].astype(np.uint32)
    off = off - off[0]
    n = len(b) - 2
    doc = np.repeat(np.arange(len(texts)), np.diff(off))[: max(n, 0)]
    code = (b[:n] << 16) | (b[1 : n + 1] << 8) | b[2 : n + 2]
    blank = ((b[:n] == 32) & (b[1 : n + 1] == 32)) | ((b[1 : n + 1] == 32) & (b[2 : n + 2] == 32))
    ok = ~blank & (np.arange(n) + 2 < off[1:][doc])
    gram = (code[ok] * np.uint32(0x9E3779B1)) >> np.uint32(16)
    key, count = np.unique(doc[ok] * GRAMS + gram, return_counts=True)
    return key // GRAMS, key % GRAMS, count


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their smoothed trigram distributions (GRAMS x languages),
    over every row with a language and a letter. Each task adds up its rows
    before anything is shuffled: languages x GRAMS sums at most."""
    src = rows.select(F.col(lang_col).cast("string").alias("lang"), prepared(text_col).alias("t")).filter("lang is not null and t is not null")

    def add_up(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "t", CHUNK):
                doc, gram, count = gram_counts(part.column(1))
                langs = part.column(0).dictionary_encode()
                of = np.asarray(langs.indices)[doc]
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    here = of == i
                    sums[lang] = sums.get(lang, 0) + np.bincount(gram[here], weights=count[here], minlength=GRAMS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["lang", "gram", "n"])
        release_memory()

    counts = src.mapInArrow(add_up, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # languages x GRAMS rows at most
    langs = sorted(found["lang"].unique().tolist())
    n = np.zeros((GRAMS, len(langs)))
    n[found["gram"].to_numpy(), [langs.index(x) for x in found["lang"]]] = found["n"].to_numpy()
    return langs, (n + 0.5) / (n.sum(axis=0) + 0.5 * GRAMS)


def mixture(doc, count, like, docs: int, allowed, rounds: int = ROUNDS):
    """EM over sorted (document, count) rows with likelihood rows ``like``;
    ``allowed`` masks languages by document. Returns proportions and the
    log-likelihood of each document."""
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    have = doc[starts]
    size = np.add.reduceat(count, starts)[:, None]
    share = np.zeros((docs, like.shape[1]))
    share[have] = allowed[have] / allowed[have].sum(axis=1, keepdims=True)
    for _ in range(rounds if like.shape[1] > 1 else 0):
        part = like * share[doc]
        part *= (count / part.sum(axis=1))[:, None]
        share[have] = np.add.reduceat(part, starts, axis=0) / size
    fit_ = np.zeros(docs)
    fit_[have] = np.add.reduceat(count * np.log((like * share[doc]).sum(axis=1)), starts)
    return share, fit_


def infer(texts: pa.Array, langs: list[str], model: np.ndarray, penalty: float = 1.0):
    """Language set mask, proportions within it, by document."""
    docs, k = len(texts), len(langs)
    doc, gram, count = gram_counts(texts)
    chosen, share = np.zeros((docs, k), dtype=bool), np.zeros((docs, k))
    if not len(doc):
        return chosen, share
    like, count = model[gram], count.astype(float)
    size = np.bincount(doc, weights=count, minlength=docs)
    full, _ = mixture(doc, count, like, docs, np.ones((docs, k)))
    order = np.argsort(-full, axis=1, kind="stable")
    best = np.full(docs, -np.inf)
    rows = np.arange(len(doc))
    for size_of_set in range(1, k + 1):
        mask = np.zeros((docs, k))
        np.put_along_axis(mask, order[:, :size_of_set], 1.0, axis=1)
        got, fit_ = mixture(doc[rows], count[rows], like[rows], docs, mask, ROUNDS if size_of_set > 1 else 0)
        fit_ -= penalty * (size_of_set - 1) * np.log(np.maximum(size, 2))
        active = np.zeros(docs, dtype=bool)
        active[doc[rows]] = True
        better = active & (fit_ > best)
        best[better], share[better], chosen[better] = fit_[better], got[better], mask[better] > 0
        rows = rows[better[doc[rows]]]
        if not len(rows):
            break
    return chosen, share


def predict(rows: DataFrame, langs: list[str], model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, penalty: float = 1.0) -> DataFrame:
    """id, lang_pred, score, languages (the inferred set with its proportions);
    with ``carry`` the input row as struct ``row``."""
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(model)  # languages x GRAMS numbers
    kept = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    src = rows.select(F.col(id_col).alias("id"), prepared(text_col).alias("t"), *([kept] if carry else []))
    types = {f.name: f.dataType for f in src.schema.fields}
    out_type = f"id {types['id'].simpleString()}, lang_pred string, score double, languages map<string,double>"

    def label(batches):
        table = shared.value
        for batch in batches:
            for part in slices(batch, "t", CHUNK):
                t = part.column(1)
                has = np.asarray(t.is_valid())
                pred, score, sets = np.full(len(t), UNKNOWN, dtype=object), np.zeros(len(t)), [[] for _ in range(len(t))]
                if has.any() and langs:
                    chosen, share = infer(t.drop_null(), langs, table, penalty)
                    top = share.argmax(axis=1)
                    at = np.flatnonzero(has)
                    some = chosen.any(axis=1)
                    pred[at[some]] = np.array(langs, dtype=object)[top[some]]
                    score[at] = np.where(some, share[np.arange(len(top)), top], 0.0)
                    for i in range(len(at)):
                        sets[at[i]] = [(langs[j], float(share[i, j])) for j in np.flatnonzero(chosen[i])]
                arrays = [part.column(0), pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(sets, pa.map_(pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays + ([part.column(2)] if carry else []), names=["id", "lang_pred", "score", "languages"] + (["row"] if carry else []))
        release_memory()

    if carry:
        from pyspark.sql.types import StructType

        schema = StructType.fromDDL(out_type).add("row", types["row"])
        return src.mapInArrow(label, schema)
    return src.mapInArrow(label, out_type)


def keep_known(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text has a recognised language, with the input's columns."""
    found = predict(docs, *model, id_col=id_col, text_col=text_col, carry=True)
    return found.filter(F.col("lang_pred") != UNKNOWN).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
