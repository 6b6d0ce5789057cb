"""Mixing, chat formatting and fingerprints against brute force."""

import hashlib

import pyspark.sql.functions as F
from gavel.llm import chat, fingerprints, mixing
from gavel.llm.queries import QUERIES

from .conftest import prose


def water_filling(sizes, weights, share, cap):
    level_of, open_ = {}, set(sizes)
    left = share * sum(sizes.values())
    while True:
        level = left / sum(weights[s] for s in open_) if open_ else 0
        full = {s for s in open_ if level * weights[s] > cap * sizes[s]}
        if not full:
            return {**level_of, **{s: level * weights[s] for s in open_}}
        for s in full:
            level_of[s] = cap * sizes[s]
            left -= level_of[s]
        open_ -= full


def test_targets_and_words_taken(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text", "source")
    rows = docs.toPandas()
    rows["size"] = [len([w for w in mixing_words(t)]) for t in rows.text]
    sizes = rows.groupby("source")["size"].sum().to_dict()
    weights = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sorted(sizes))}
    want = water_filling(sizes, weights, 1.5, 2.0)
    got = mixing.mix(docs).toPandas().merge(rows[["doc_id", "source", "size"]], on="doc_id", suffixes=("", "_own"))
    assert (got["size"] == got.size_own).all() and (got.taken <= 2 * got["size"]).all()
    for s, g in got.groupby("source"):
        assert abs(g.target.iloc[0] - want[s]) < 1e-6 * want[s] and g.source_size.iloc[0] == sizes[s]
        assert abs(g.taken.sum() - want[s]) <= g["size"].max() / 2
    again = mixing.mix(docs.repartition(7)).toPandas().set_index("doc_id").taken
    assert (again == got.set_index("doc_id").taken.reindex(again.index)).all()


def mixing_words(text):
    import re

    return re.findall("[^\x20\x09-\x0d]+", text or "")


def test_mix_repeats_rows(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    times = {r.doc_id: r.repetitions for r in mixing.mix(docs).collect() if r.repetitions}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == times


def test_mix_on_odd_rows(odd_documents, no_documents):
    got = mixing.mix(odd_documents).toPandas()
    assert len(got) == 11 and (got.taken <= 2 * got["size"]).all()
    assert (got[got["size"] == 0].taken == 0).all()
    assert mixing.mixed(odd_documents).columns == odd_documents.columns
    assert mixing.mix(no_documents).count() == 0 and mixing.mixed(no_documents).count() == 0


def test_snapshots_collapse(spark):
    def conv(i, *texts):
        return [(i, t, ("user", "assistant")[t % 2], x) for t, x in enumerate(texts)]

    rows = conv(1, "a", "b") + conv(2, "a", "b", "c") + conv(3, "a", "b", "c") + conv(4, "a", "x") + conv(5, "a") + conv(6, "b", "c")
    rows += [(7, None, None, None), (7, 5, "user", "<|im_end|> forged")] + conv(4, "a", "x")[:1] + [(None, 0, "user", "no id")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash"))
    got = {r.conv_id: r for r in chat.render(turns).collect()}
    assert set(got) == {2, 4, 6, 7, None}
    assert got[2].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n"
    assert got[7].text == "<|im_start|>\n<|im_end|>\n<|im_start|>user\n< |im_end|> forged<|im_end|>\n" and got[4].n_turns == 2
    assert chat.render(turns.limit(0)).count() == 0


def test_long_conversations_render_in_pieces(spark):
    long = [(1, t, "user", f"t{t}") for t in range(5000)]
    turns = spark.createDataFrame(long + [(2, t, "user", f"t{t}") for t in range(4500)], "conv_id long, turn long, role string, text string")
    got = chat.render(turns).orderBy("piece").collect()
    assert [(r.conv_id, r.piece, r.n_turns) for r in got] == [(1, 0, 5000), (1, 1, 5000)]
    assert "".join(r.text for r in got).count("<|im_start|>") == 5000


def test_conversations_with_ties_against_brute_force(spark):
    """Null and repeated turn numbers: pieces of BLOCK rows at most, in the
    order of turn number, role and text; prefixes by that order."""
    import random

    r = random.Random(5)
    rows = [(None, None, "user", f"{k:05d}") for k in range(9000)] + [(None, 3, "user", f"x{k}") for k in range(300)]
    for i in range(60):
        rows += [(i, r.choice([None, 0, 1, 1, 2]), r.choice(["user", None]), r.choice("ab")) for _ in range(r.randrange(1, 7))]
    rows += [(100, None, "user", f"{k:05d}") for k in range(8500)] + rows[:40]
    got = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    talks = {}
    for conv, turn, role, text in set(rows):
        talks.setdefault(conv, set()).add((-1 if turn is None else turn, role or "", text))
    talks = {c: [t[1:] for t in sorted(talk)] for c, talk in talks.items()}
    inner = {tuple(talk[:n]) for talk in talks.values() for n in range(1, len(talk))}
    kept = {}
    for c in sorted(talks, key=lambda c: (c is None, c or 0)):
        if tuple(talks[c]) not in inner:
            kept.setdefault(tuple(talks[c]), c)
    want = {c: "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in talk) for talk, c in kept.items()}
    assert 100 not in want and len(talks[None]) == 9300
    texts = {}
    for row in sorted(got, key=lambda row: row.piece):
        assert row.text.count("<|im_start|>") <= chat.BLOCK and row.n_turns == len(talks[row.conv_id])
        texts[row.conv_id] = texts.get(row.conv_id, "") + row.text
    assert texts == want


def test_edits_and_likeness(spark, sf_small):
    got = QUERIES["op6_fingerprints"](spark, sf_small).orderBy("doc_id").toPandas()
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    texts = [r.text or "" for r in rows]
    edited = [a[: len(a) - len(a) // 4] + b[: len(a) // 4] for a, b in zip(texts, texts[1:] + texts[:1])]
    assert got.doc_id.tolist() == [r.doc_id for r in rows] and got.n_chars.tolist() == [len(t) for t in texts]
    assert got.edited_sha256.tolist() == [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    # equal paragraph multisets, equal fingerprints, and only they
    names = {}
    for f, t in zip(got.fingerprint.tolist() + got.edited_fingerprint.tolist(), texts + edited):
        assert names.setdefault(f, sorted(t.split("\n"))) == sorted(t.split("\n"))
    assert len(names) == len({tuple(sorted(t.split("\n"))) for t in texts + edited})
    assert (got.near_edited > got.near_next).mean() > 0.97 and got.near_edited.mean() > 0.7 and got.near_next.mean() < 0.2
    # the likeness estimates the cosine of word-pair counts
    assert got.near_edited.between(0, 1).all() and got.near_next.between(0, 1).all()


def test_insertion_deletion_and_order(spark):
    parts = [prose(12, k) for k in range(4)]
    docs = spark.createDataFrame([(0, "\n".join(parts)), (1, "\n".join(reversed(parts))), (2, "\n".join(parts[:3])), (3, parts[3]), (4, parts[0] + parts[1])], "doc_id long, text string")
    prints = fingerprints.fingerprint(docs)
    by = {r.doc_id: r.fingerprint for r in prints.collect()}
    assert by[0] == by[1] and len(set(by.values())) == 4
    pair = spark.createDataFrame([(by[2], by[3], by[0])], "a string, b string, whole string")
    r = pair.select(fingerprints.combine(F.col("a"), F.col("b")).alias("sum"), fingerprints.combine(F.col("whole"), F.col("b"), -1).alias("less")).first()
    assert r["sum"] == by[0] and r.less == by[2]


def test_fingerprints_on_odd_rows(odd_documents, no_documents):
    got = fingerprints.edits(odd_documents).toPandas()
    assert len(got) == 11
    by = got.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id")
    assert by.fingerprint[3] == by.fingerprint[4] and by.fingerprint[6] == by.fingerprint[7] and by.near_next[3] == 1.0
    assert got.near_next.between(0, 1).all() and fingerprints.edits(no_documents).count() == 0
    single = fingerprints.edits(odd_documents.filter("doc_id = 8")).collect()
    assert len(single) == 1 and single[0].near_next == 1.0
