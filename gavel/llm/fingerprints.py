"""Homomorphic multiset fingerprints of documents (DataFrame operations only).

A text is the multiset of its paragraphs (lines). Every paragraph hashes to a
wide vector: ``EXACT`` 32-bit lanes of seeded 64-bit hashes of the whole
paragraph, a counter, and ``LANES`` counters that take one bit each from the
hashes of its adjacent word pairs. The fingerprint is the sum of the vectors,
lane by lane, modulo 2**32 (exact lanes) and 2**16 (counters). So the order of
paragraphs does not matter, and paragraphs are inserted or deleted by adding or
subtracting their vectors. Likeness is the cosine of the counters round their
mean, which estimates the share of word pairs that two texts have in common.

The edited text of a document (its last quarter replaced by the start of the
next document) is built by joins on a chain of documents in id order; the chain
is ranked over range partitions, so no task holds all documents.

Defined cases: a null text counts as empty; an empty text has one empty
paragraph and no pairs, and is like equal texts only; rows with equal id and
text are one document (each row is returned), rows with equal id follow the
hash of their text; a table of one document is its own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.common import SPACE, staged, text_of

EXACT = 8
SHIFTS = 31
#: Two counters in a long: bits 0 and 31 of a shifted hash.
PAIR = (1 << 31) | 1
LANES = 2 * SHIFTS
SPACES = " \t\x0b\x0c\r"


def _pairs(line: Column) -> Column:
    """Hashes of the adjacent word pairs of a line (of its only word)."""
    ws = F.filter(F.split(line, SPACE), lambda w: w != "")
    n = F.size(ws)
    two = F.zip_with(F.slice(ws, 1, F.greatest(n - 1, F.lit(0))), F.slice(ws, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.when(n == 1, F.transform(ws, lambda a: F.xxhash64(a))).otherwise(two)


def exact_lanes(text: Column) -> Column:
    """Sums of the seeded paragraph hashes, modulo 2**32, as an array."""
    lines = F.split(text, "\n")
    low = F.lit(0xFFFFFFFF)

    def lane(seed: int, shift: int) -> Column:
        hashes = F.transform(lines, lambda p: F.shiftrightunsigned(F.xxhash64(F.lit(seed), p), shift).bitwiseAND(low))
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: (a + h).bitwiseAND(low))

    return F.array(*[lane(seed, shift) for seed in range(EXACT // 2) for shift in (0, 32)])


def counters(texts: DataFrame, key: list[str], text_col: str) -> DataFrame:
    """key, pairs, lanes (array of LANES longs): sums over the word pairs of
    each key's texts. Keys without pairs are absent."""
    pair = F.explode(F.flatten(F.transform(F.split(F.col(text_col), "\n"), _pairs)))
    bits = texts.select(*key, pair.alias("h"))
    packed = [F.sum(F.shiftright("h", k).bitwiseAND(F.lit(PAIR))).alias(f"s{k}") for k in range(SHIFTS)]
    sums = bits.groupBy(*key).agg(F.count(F.lit(1)).alias("pairs"), *packed)
    low = F.lit((1 << 31) - 1)
    lanes = [F.col(f"s{k}").bitwiseAND(low) for k in range(SHIFTS)] + [F.shiftright(f"s{k}", 31) for k in range(SHIFTS)]
    return sums.select(*key, "pairs", F.array(*lanes).alias("lanes"))


def _divided(pairs: Column, lanes: Column, copies: Column) -> tuple[Column, Column]:
    return (F.coalesce(pairs, F.lit(0)) / copies).cast("long"), F.transform(F.coalesce(lanes, F.array_repeat(F.lit(0).cast("long"), LANES)), lambda x: (x / copies).cast("long"))


def render(exact: Column, pairs: Column, lanes: Column) -> Column:
    """The fingerprint as hex text."""
    wide = F.transform(exact, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0"))
    count = F.lpad(F.lower(F.hex(F.pmod(pairs, F.lit(1 << 32)))), 8, "0")
    narrow = F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(F.pmod(x, F.lit(1 << 16)))), 4, "0"))
    return F.concat(F.array_join(wide, ""), count, F.array_join(narrow, ""))


def parsed(fingerprint: Column) -> Column:
    """The lanes of a rendered fingerprint as an array of longs."""
    width = [8] * (EXACT + 1) + [4] * LANES
    at = [1 + sum(width[:i]) for i in range(len(width))]
    return F.array(*[F.conv(F.substring(fingerprint, a, w), 16, 10).cast("long") for a, w in zip(at, width)])


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """Fingerprint of the union of two paragraph multisets (sign 1), or of
    ``left`` after deleting the paragraphs of ``right`` (sign -1)."""
    both = F.zip_with(parsed(left), parsed(right), lambda a, b: a + b * F.lit(sign))
    wide = F.transform(F.slice(both, 1, EXACT + 1), lambda x: F.lpad(F.lower(F.hex(F.pmod(x, F.lit(1 << 32)))), 8, "0"))
    narrow = F.transform(F.slice(both, EXACT + 2, LANES), lambda x: F.lpad(F.lower(F.hex(F.pmod(x, F.lit(1 << 16)))), 4, "0"))
    return F.concat(F.array_join(wide, ""), F.array_join(narrow, ""))


def likeness(n1: Column, a: Column, n2: Column, b: Column) -> Column:
    """Cosine of the counters round their mean, at least 0."""
    # counters count modulo 2**16: the signed remainder of 2 * count - pairs
    def centred(n, v):
        return F.transform(v, lambda x: F.pmod(x * 2 - n + F.lit(1 << 16), F.lit(1 << 17)) - F.lit(1 << 16))

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, t: s + t)

    x, y = centred(n1, a), centred(n2, b)
    norm = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(norm == 0, F.lit(0.0)).otherwise(F.least(F.greatest(dot(x, y) / norm, F.lit(0.0)), F.lit(1.0)))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint of every distinct (id, text)."""
    rows = _keyed(docs, id_col, text_col).dropDuplicates(["k"])
    sums = counters(rows, ["k"], "t")
    out = rows.select("k", F.col("id").alias(id_col), exact_lanes(F.col("t")).alias("exact")).join(sums, "k", "left")
    n, v = _divided(F.col("pairs"), F.col("lanes"), F.lit(1))
    return out.select(id_col, render(F.col("exact"), n, v).alias("fingerprint"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = text_of(text_col)
    k = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.xxhash64(t).cast("string"))
    return docs.select(F.col(id_col).cast("long").alias("id"), k.alias("k"), t.alias("t"))


def chain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k, id, copies, next_k, need: the documents in order of id (then of the
    text's hash), each with its successor (the last with the first) and the
    number of characters it takes from it."""
    t = text_of(text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(t).alias("h"), F.char_length(t).alias("n"))
    docs = docs.groupBy("id", "h").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    k = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("h").cast("string"))
    placed = staged(docs.repartitionByRange("id", "h").select("id", "h", "n", "copies", k.alias("k"), F.spark_partition_id().alias("pid")), "chain")
    heads = placed.groupBy("pid").agg(F.min(F.struct(F.col("id").isNotNull(), "id", "h", "k")).getField("k").alias("head"))
    order = Window.orderBy("pid")  # one row a range partition
    first = F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("pid", F.coalesce(F.lead("head").over(order), first).alias("after"))
    inside = Window.partitionBy("pid").orderBy("id", "h")  # a range partition's rows, without texts
    return placed.join(F.broadcast(heads), "pid").select("k", "id", "copies", F.coalesce(F.lead("k").over(inside), F.col("after")).alias("next_k"), F.floor(F.col("n") / 4).cast("int").alias("need"))


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next of every row."""
    links = staged(chain(docs, id_col, text_col), "chain-links")
    one = Window.partitionBy("k").orderBy("k")
    # text rows by key, repeated rows once; every join below reads this exchange
    texts = _keyed(docs, id_col, text_col).select("k", "t").withColumn("nth", F.row_number().over(one)).filter("nth = 1").drop("nth")
    start = links.select(F.col("k").alias("to"), F.col("next_k").alias("k"), "need").join(texts, "k").select(F.col("to").alias("k"), F.left("t", F.col("need")).alias("head"))
    both = texts.join(start, "k").withColumn("n", F.char_length("t")).withColumn("keep", (F.col("n") - F.floor(F.col("n") / 4)).cast("int"))
    both = both.select("k", "n", "t", F.concat(F.left("t", F.col("keep")), "head").alias("e"))
    facts = both.select("k", F.col("n").cast("long").alias("n_chars"), F.sha2("e", 256).alias("edited_sha256"), exact_lanes(F.col("t")).alias("x0"), exact_lanes(F.col("e")).alias("x1"))
    sums = counters(both.select("k", F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("t").alias("t")), F.struct(F.lit(1).alias("v"), F.col("e").alias("t")))).alias("s")).select("k", "s.v", "s.t"), ["k", "v"], "t")
    sums = sums.groupBy("k").agg(*[F.max(F.when(F.col("v") == v, F.struct("pairs", "lanes"))).alias(name) for v, name in ((0, "own"), (1, "ed"))])
    none = F.array_repeat(F.lit(0).cast("long"), LANES)
    out = facts.join(sums, "k", "left").select(
        "k", "n_chars", "edited_sha256", "x0", "x1",
        F.coalesce("own.pairs", F.lit(0)).alias("p0"), F.coalesce("own.lanes", none).alias("l0"),
        F.coalesce("ed.pairs", F.lit(0)).alias("p1"), F.coalesce("ed.lanes", none).alias("l1"))
    out = staged(out.join(links.select("k", "id", "copies", "next_k"), "k"), "fingerprints")
    other = out.select(F.col("k").alias("next_k"), F.col("x0").alias("x2"), F.col("p0").alias("p2"), F.col("l0").alias("l2"))
    out = out.join(other, "next_k")

    def near(x, p, v):
        same = (F.col("x0") == F.col(x)) & (F.col("p0") == F.col(p)) & (F.col("l0") == F.col(v))
        return F.when(same, F.lit(1.0)).otherwise(likeness(F.col("p0"), F.col("l0"), F.col(p), F.col(v)))

    out = out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "copies",
        render(F.col("x0"), F.col("p0"), F.col("l0")).alias("fingerprint"),
        render(F.col("x1"), F.col("p1"), F.col("l1")).alias("edited_fingerprint"),
        near("x1", "p1", "l1").alias("near_edited"), near("x2", "p2", "l2").alias("near_next"))
    return out.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "nth")
