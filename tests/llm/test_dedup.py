"""Exact, near and substring deduplication against brute force."""

import collections
import hashlib
import re

import numpy as np

from gavel.llm import exact_dedup, near_dedup, substring_dedup

from .conftest import prose

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def words_of(text):
    return WORD.findall((text or "").translate(LOW))


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_exact_on_odd_rows(odd_documents):
    got = exact_dedup.mark(odd_documents).toPandas()
    rows = odd_documents.toPandas()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for i, t in zip(rows["doc_id"], rows["text"]):
        groups[hashlib.sha256((t or "").translate(LOW).encode()).hexdigest()].append(i)
    for r in got.itertuples():
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids)
        best = np.nanmax(ids) if not np.isnan(ids).all() else np.nan
        assert r.keep_id == best or np.isnan(best)
    # exactly one row of each group of equal texts stays, repeated rows included
    assert got[got.kept].groupby("text_sha256").size().tolist() == [1] * len(groups)


def test_exact_keeps_the_columns(odd_documents, no_documents):
    kept = exact_dedup.dedup(odd_documents)
    assert kept.columns == odd_documents.columns and kept.count() == 7
    assert exact_dedup.mark(no_documents).count() == 0
    assert exact_dedup.dedup(no_documents).count() == 0


def test_exact_hot_text_is_salted(spark):
    docs = frame(spark, ["the same text"] * 900 + [prose(5, i) for i in range(900)])
    got = exact_dedup.mark(docs).filter("group_size = 900").toPandas()
    assert len(got) == 900 and set(got.keep_id) == {899} and got[got.kept].doc_id.tolist() == [899]


def brute_components(texts):
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, sets


def changed(text, places, tag):
    w = text.split(" ")
    for p in places:
        w[p] = f"{tag}{p}"
    return " ".join(w)


def test_near_matches_brute_force(spark):
    base = prose(200, 3)
    texts = [base, base.upper(), None, "", "one two", "One  two", "one two three"]
    texts += [changed(base, [k * 37 % 200], "n") for k in range(40)]  # all near the base
    texts += [changed(prose(60, 9), range(k), "m") for k in range(12)]  # a chain
    texts += [prose(80, 100 + k) for k in range(30)]
    # a bucket of more than SMALL classes, of several components
    texts += [prose(40, 7) + " " + changed(prose(15, 50), [k], "p") for k in range(15)]
    want, sets = brute_components(texts)
    got = near_dedup.near_duplicates(frame(spark, texts)).toPandas().set_index("doc_id")
    assert got.n_shingles.to_dict() == {i: len(s) for i, s in sets.items()}
    assert got.component_id.to_dict() == want
    assert got.kept.to_dict() == {i: i == c for i, c in want.items()}


def test_large_buckets_lose_no_link(spark, monkeypatch):
    # all classes share every band, so small buckets play no part: the centres
    # and the comparison in blocks must find all links
    import pyspark.sql.functions as F

    lead = prose(30, 5)
    texts = [f"{changed(lead, [g], 'g')} {prose(90, 1000 + g)} {prose(2, k)}" for g in range(6) for k in range(5)]
    docs = frame(spark, texts)
    sigs = near_dedup.sketch(docs, "doc_id", "text").filter("name is not null")
    sigs = sigs.select("name", F.col("id").alias("rep"), F.lit(b"\0" * 12).alias("sig"))
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "TURNS", 0)
    comp = near_dedup.connect(sigs, lambda wanted: near_dedup._sets(docs, wanted, "doc_id", "text"), 75, 3, 1)
    got = comp.join(sigs, "name").toPandas()
    want, _ = brute_components(texts)
    groups = collections.defaultdict(set)
    for r in got.itertuples():
        groups[bytes(r.comp)].add(want[r.rep])
    assert len(groups) == len(set(want.values())) == 6 and all(len(g) == 1 for g in groups.values())


def test_near_on_odd_rows(odd_documents, no_documents):
    got = near_dedup.near_duplicates(odd_documents).toPandas()
    assert len(got) == 11
    by = got.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id")
    assert by.component_id[2] == 1 and by.component_id[7] == 6 and by.n_shingles[3] == 0 and by.n_shingles[5] == 0
    assert by.component_id[3] == 3 and by.component_id[5] == 5
    assert near_dedup.dedup(odd_documents).columns == odd_documents.columns
    assert near_dedup.near_duplicates(no_documents).count() == 0


def test_bayesian_bounds_grow():
    steps = near_dedup.least_agreeing(0.75, 128, 32)
    assert [n for n, _ in steps] == [32, 64, 96, 128]
    assert all(0 < m < 0.75 * n for n, m in steps) and steps[-1][1] / 128 > steps[0][1] / 32


def test_repeated_passages_are_found(spark):
    passage = prose(60, 77)
    line = prose(70, 78)
    texts = [
        f"{prose(100, 1)} {passage} {prose(50, 2)}",  # 0: keeps the passage
        f"{prose(20, 3)}\n{prose(9, 4)} {passage.upper()}\n{prose(80, 5)}",  # 1: within a line
        f"{prose(60, 6)}\n{line}\n{prose(60, 7)}",  # 2: keeps the line
        f"{prose(60, 8)}\n{changed(line, [0, 40], 'z')}\n{prose(60, 9)}",  # 3: a near line
        prose(400, 10),  # 4: clean
        f"{prose(50, 11)} {prose(25, 12)}",  # 5, 6 share 25 words only
        f"{prose(25, 12)} {prose(50, 13)}",
        None,
        "",
    ]
    got = substring_dedup.repeats(frame(spark, texts)).toPandas()
    assert set(got.doc_id) == {0, 1, 2, 3}
    of = {r.doc_id: r for r in got.itertuples()}
    assert not of[0].removed and not of[2].removed and of[1].removed and of[3].removed
    assert of[1].kept_id == 0 and of[3].kept_id == 2
    assert (of[3].first_word, of[3].words) == (60, 70)
    assert of[1].first_word >= 29 and of[1].first_word + of[1].words <= 89 and of[1].words >= 36


def test_every_repeat_over_fifty_words_is_found(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = substring_dedup.repeats(docs).toPandas()
    rows = docs.select("doc_id", "text").toPandas()
    seen, cover = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in zip(rows.doc_id, rows.text):
        w = words_of(t)
        for k in range(len(w) - 50):
            seen[tuple(w[k : k + 51])].add(i)
    for r in got.itertuples():
        cover[r.doc_id].update(range(r.first_word, r.first_word + r.words))
    for i, t in zip(rows.doc_id, rows.text):
        w = words_of(t)
        for k in range(len(w) - 50):
            if len(seen[tuple(w[k : k + 51])]) > 1:
                assert cover[i] & set(range(k, k + 51)), (i, k)


def test_substring_on_odd_rows(odd_documents, no_documents):
    got = substring_dedup.repeats(odd_documents).toPandas()
    assert set(got.doc_id) == {6, 7} and set(got.kept_id) == {6}
    assert substring_dedup.repeats(no_documents).count() == 0
