"""MinHash near-deduplication with sequential Bayesian verification.

1. A document's set is its distinct word 5-shingles (64-bit hashes; a shorter
   text is one shingle). Documents with equal sets form a class; everything
   after works on one representative a class, so copies never meet in pairs.
2. Each class has a signature of ``BANDS * ROWS`` minhashes. Classes that agree
   on a whole band share a bucket (a similarity of 0.75 is missed by all bands
   with probability 5e-6).
3. Candidate pairs: every pair of a bucket of at most ``SMALL`` classes; in a
   larger bucket every class with the bucket's smallest class. What that leaves
   open in large buckets is settled in 5.
4. A pair's signatures are compared batch by batch; it is dropped as soon as the
   posterior probability (uniform prior) of a similarity of at least the
   threshold falls below ``MISS``. Survivors are verified on their full sets.
5. Links merge into components (large-star / small-star rounds). Large buckets
   that are not one component get another random centre. The classes that
   are still outside their bucket's main component are then compared with all
   others of the bucket, in blocks whose work stays inside a task, so no pair of
   a bucket goes unexamined unless its classes are already connected.

Results: component_id is the smallest id of the component.

Defined cases: null text counts as empty; a text without words has an empty set
and is linked with nothing; a null id is ignored in minima (a component of only
null ids has a null component_id); rows with equal id are separate documents.
"""

from __future__ import annotations

import sys
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm import common, word_hash
from gavel.llm.common import by_value, discard, release_shuffles, staged, text_of
from gavel.llm.word_hash import blend, hash_words, text_runs

by_value(sys.modules[__name__])
by_value(common)
by_value(word_hash)

SHINGLE = 5
BANDS, ROWS = 32, 4
SMALL = 8
MISS = 1e-6
TURNS, BLOCK = 1, 256
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingle_sets(word, at):
    """Sorted distinct shingle hashes (64 bits) of texts given by word hashes and
    offsets: (hashes, offsets)."""
    n = np.diff(at)
    count = np.where(n == 0, 0, np.maximum(n - SHINGLE + 1, 1))
    out_at = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    start = at[:-1][doc] + np.arange(out_at[-1]) - out_at[:-1][doc]
    padded = np.concatenate([word.astype(np.uint64), np.zeros(SHINGLE, dtype=np.uint64)])
    short = (n < SHINGLE)[doc]
    h = np.zeros(len(doc), dtype=np.uint64)
    for j in range(SHINGLE):
        part = blend(padded[start + j]) * ODD[j]
        if short.any():
            part = np.where(short & (j >= n[doc]), ODD[j], part)
        h += part
    h = blend(h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, dtype=bool)
    h, doc = h[first], doc[first]
    return h, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n)))])


def permutations():
    rng = np.random.default_rng(20240229)
    a = rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
    return a, b


def signatures(h, at):
    """Minhashes (32 bits) of non-empty sets."""
    a, b = permutations()
    out = np.empty((len(at) - 1, len(a)), dtype=np.uint32)
    for k in range(len(a)):
        x = (h * a[k] + b[k]) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(x, at[:-1])
    return out


def set_names(h, at):
    """128-bit names of non-empty sets: two sums of mixed hashes and the size."""
    one = np.add.reduceat(blend(h ^ ODD[0]), at[:-1])
    two = np.add.reduceat(blend(h ^ ODD[1]), at[:-1])
    size = np.diff(at).astype(np.uint64)
    return np.column_stack([blend(one + size * ODD[2]), blend(two ^ (size * ODD[3]))])


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, name (16 bytes, null for an empty set), sig."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))

    def run(batches):
        for batch in batches:
            for lo, texts in text_runs(batch, "t"):
                h, cut = shingle_sets(*hash_words(texts)[:2])
                size = np.diff(cut)
                some = size > 0
                names, sigs = np.full(len(texts), None, dtype=object), np.full(len(texts), None, dtype=object)
                if some.any():
                    own = np.concatenate([[0], np.cumsum(size[some])])
                    names[some] = [x.tobytes() for x in set_names(h, own)]
                    sigs[some] = [x.tobytes() for x in signatures(h, own)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(size), pa.array(names, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "n_shingles", "name", "sig"])

    return src.mapInArrow(run, "id long, n_shingles long, name binary, sig binary")


def least_agreeing(threshold: float, total: int, batch: int) -> list[tuple[int, int]]:
    """(n, m): after n minhashes a pair goes on if at least m agree. With a
    uniform prior, P(s >= t | m of n) = P(Bin(n + 1, t) <= m)."""
    out = []
    for n in range(batch, total + 1, batch):
        below, m = 0.0, -1
        while below < MISS:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _pruned(pairs: DataFrame, sigs: DataFrame, threshold: float, total: int) -> DataFrame:
    """Pairs (a, b) whose signatures leave a similarity of threshold possible."""
    left = sigs.select(F.col("name").alias("a"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("name").alias("b"), F.col("sig").alias("sb"))
    steps = least_agreeing(threshold, total, min(32, total))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
            left, agree, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, dtype=np.int64), 0
            for n, m in steps:
                agree = agree + (one[left, done:n] == two[left, done:n]).sum(axis=1)
                keep = agree >= m
                left, agree, done = left[keep], agree[keep], n
            yield batch.select([0, 1]).take(pa.array(left))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """name, n, shingles (sorted 64-bit hashes as bytes) of the wanted (rep, name)."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    src = src.join(wanted.select(F.col("rep")).distinct(), F.col("id").eqNullSafe(F.col("rep")), "left_semi").select(text_of("t").alias("t"))

    def run(batches):
        for batch in batches:
            for _lo, texts in text_runs(batch, "t"):
                h, cut = shingle_sets(*hash_words(texts)[:2])
                some = np.flatnonzero(np.diff(cut))
                if len(some):
                    names = set_names(h, np.concatenate([[0], np.cumsum(np.diff(cut)[some])]))
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in names], pa.binary()), pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary())], names=["name", "shingles"])

    return src.mapInArrow(run, "name binary, shingles binary").join(wanted.select("name"), "name", "left_semi").dropDuplicates(["name"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * |intersection| >= percent * |union|."""
    left = sets.select(F.col("name").alias("a"), F.col("shingles").alias("ha"))
    right = sets.select(F.col("name").alias("b"), F.col("shingles").alias("hb"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "hb").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(name, comp): the smallest name of each connected component of
    undirected edges (a, b). Alternates large-star and small-star until the
    edges are stars; every round is a written table."""
    star = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "stars")
    state = None
    while True:
        both = star.select("u", "v").union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        old, star = star, staged(small, "stars")
        discard(old)
        got = star.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 24)), F.countDistinct("u")).first()
        if not got[0] or (got[0] == got[2] and tuple(got) == state):
            named = star.select(F.col("u").alias("name"), F.col("v").alias("comp"))
            named.staged_at = star.staged_at
            return named
        state = tuple(got)


def _lot(turn: int):
    """Random order of a bucket's members, another for every bucket and turn."""
    return F.xxhash64(F.lit(turn), "key", "name")


def _bucketed(member: DataFrame, small: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, large) of bucket members (key, name): all pairs of buckets of at
    most ``small``, in larger ones each with a random centre; members of the
    larger."""
    buckets = staged(member.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min_by("name", _lot(0)).alias("centre")).filter("size > 1"), "buckets")
    release_shuffles(member.sparkSession)
    member = staged(member.join(buckets, "key"), "bucket-members")  # classes alone in their buckets are gone
    discard(buckets)
    few = member.filter(F.col("size") <= small)
    close = few.select("key", F.col("name").alias("a")).join(few.select("key", F.col("name").alias("b")), "key").filter("a < b").select("a", "b")
    large = member.filter(F.col("size") > small)
    star = large.filter("centre != name").select(F.least("centre", "name").alias("a"), F.greatest("centre", "name").alias("b"))
    return close.union(star).distinct(), large.select("key", "name")


def _open(member: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, name, comp, size) of the buckets with more than one component."""
    labelled = member.join(comp, "name", "left").withColumn("comp", F.coalesce("comp", "name"))
    split = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).filter(F.col("lo") != F.col("hi"))
    return staged(labelled.join(split.select("key", "size"), "key"), "open-buckets")


def connect(sigs: DataFrame, sets_of, percent: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(name, comp) of the classes linked to others, from ``sigs`` (name, rep,
    sig). ``sets_of(wanted)`` gives (name, shingles) of wanted (name, rep)."""
    total = bands * rows
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (4 * rows) + 1, 4 * rows)))).alias("key")
    pairs, many = _bucketed(sigs.select("name", band), SMALL)
    found = staged(_pruned(pairs, sigs, percent / 100, total), "candidates")
    wanted = found.select(F.col("a").alias("name")).union(found.select(F.col("b").alias("name"))).union(many.select("name")).distinct()
    sets = staged(sets_of(sigs.select("name", "rep").join(wanted, "name", "left_semi")), "sets")
    links = staged(_verified(found, sets, percent), "links")
    discard(found)
    comp = components(links)

    def add(pairs: DataFrame) -> None:
        nonlocal links, comp
        more = staged(_verified(_pruned(pairs, sigs, percent / 100, total), sets, percent), "links")
        if not more.isEmpty():
            old, links = links, staged(links.union(more), "links")
            discard(old, more, comp)
            comp = components(links)

    # large buckets that are not one component: other random centres
    for turn in range(1, TURNS + 1):
        unsettled = _open(many, comp)
        if unsettled.isEmpty():
            return comp
        many = unsettled.select("key", "name")
        centre = unsettled.groupBy("key").agg(F.min_by(F.struct("name", "comp"), _lot(turn)).alias("c"))
        add(unsettled.join(centre, "key").filter(F.col("comp") != F.col("c.comp")).select(F.least("name", "c.name").alias("a"), F.greatest("name", "c.name").alias("b")).distinct())
    # the classes still outside their bucket's main component, against the rest
    unsettled = _open(many, comp)
    if unsettled.isEmpty():
        return comp
    more = staged(_across(unsettled, sigs, sets, percent, rows), "links")
    return comp if more.isEmpty() else components(links.union(more))


def _across(unsettled: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int, rows: int) -> DataFrame:
    """Links (a, b) between different components within open buckets (key, name,
    comp, size). The classes outside a bucket's largest component are compared
    with all of it, in blocks of BLOCK x BLOCK classes: signatures first, then the full
    sets of what the posterior bound lets through. Of the links of a class in a
    block one a component is returned; nothing else is emitted."""
    shares = unsettled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = shares.groupBy("key").agg(F.max_by("comp", "n").alias("main"), F.sum("n").alias("size"), F.max("n").alias("most"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    main = main.select("key", "main", blocks(F.col("size")).alias("mbs"), blocks(F.col("size") - F.col("most")).alias("qbs"))
    member = unsettled.select("key", "name", "comp").join(main, "key").withColumn("lot", F.xxhash64("name"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mb, qb = F.pmod("lot", "mbs").cast("int"), F.pmod("lot", "qbs").cast("int")
    asked = member.filter("comp != main").select("key", qb.alias("qb"), upto("mbs").alias("mb"), F.lit(True).alias("ask"), "name", "comp")
    every = member.select("key", upto("qbs").alias("qb"), mb.alias("mb"), F.lit(False).alias("ask"), "name", "comp")
    payload = sigs.select("name", "sig").join(sets, "name")
    cells = asked.union(every).join(payload, "name")

    def compare(table):
        ask = np.asarray(table.column("ask"))
        names, comps = table.column("name").to_pylist(), table.column("comp").to_pylist()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint32).reshape(len(names), -1)
        full = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        total = sig.shape[1]
        least = least_agreeing(percent / 100, total, min(32, total))
        code = {c: i for i, c in enumerate(dict.fromkeys(comps))}
        of = np.array([code[c] for c in comps])
        others = np.flatnonzero(~ask)
        told, pairs = set(), []
        for q in np.flatnonzero(ask):
            left = others[of[others] != of[q]]
            agree, done = np.zeros(len(left), dtype=np.int64), 0
            for n, m in least:
                agree = agree + (sig[left, done:n] == sig[q, done:n]).sum(axis=1)
                keep = agree >= m
                left, agree, done = left[keep], agree[keep], n
            if not len(left):
                continue
            x = full[q]
            lens = np.array([len(full[i]) for i in left])
            flat = np.concatenate([full[i] for i in left])
            at = np.searchsorted(x, flat)
            both = np.add.reduceat((x[np.minimum(at, len(x) - 1)] == flat).astype(np.int64), np.cumsum(lens) - lens)
            for i in left[100 * both >= percent * (len(x) + lens - both)]:
                if (q, of[i]) not in told:
                    told.add((q, of[i]))
                    pairs.append(sorted((names[q], names[i])))
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})

    return cells.groupBy("key", "qb", "mb").applyInArrow(compare, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """id, n_shingles, component_id, kept of every row."""
    rows = staged(sketch(docs, id_col, text_col), "sketches")
    some = rows.filter("name is not null")
    classes = staged(some.groupBy("name").agg(F.min("id").alias("rep")), "classes")
    first = some.select("name", "sig", "id").join(classes.withColumnRenamed("name", "cname"), (F.col("name") == F.col("cname")) & F.col("id").eqNullSafe(F.col("rep")))
    sigs = staged(first.select("name", "rep", "sig").dropDuplicates(["name"]), "signatures")
    comp = connect(sigs, lambda wanted: _sets(docs, wanted, id_col, text_col), percent)
    whole = classes.join(comp, "name", "left").withColumn("comp", F.coalesce("comp", "name"))
    best = whole.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = whole.select("name", "comp").join(best, "comp").select("name", "component_id")
    out = rows.select("id", "n_shingles", "name").join(named, "name", "left")
    own = F.when(F.col("name").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The input's rows of the documents kept (one of each component)."""
    kept = near_duplicates(docs, id_col, text_col, percent).filter("kept").select(F.col(id_col).alias("__keep_id")).distinct()
    return docs.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("__keep_id")), "left_semi")
