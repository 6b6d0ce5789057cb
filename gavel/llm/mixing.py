"""Mixing sources to target weights by capped water-filling.

Sources take weights in turn (by code point, null last). A share of all words
is poured out in proportion to the weights; a source stops at ``cap`` times its
size (its maximum epochs), and the excess goes to the others by weight until no
source is above. Each document is then repeated ``floor(epochs)`` times, and a
seeded part of a source's documents once more: in the order of a hash, the
documents up to the point where the words come nearest to the target.

That point is found digit by digit over the 60-bit hash, so no task holds a
source: each round adds up words by (source, 15-bit digit), map-side combined.
Sources are ranked over a range-partitioned table of distinct sources, and a
round of water-filling is one aggregate over them.

Defined cases: an empty table gives no rows; a null or empty text has size 0
and is taken 0 words; repeated rows share their hash and so their decision;
sources without words have target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.common import SPACE, staged, text_of

WEIGHTS = (3.0, 1.0, 2.0)
DIGIT = 15


def word_count(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE))).cast("long")


def order_key(id_col: str, text_col: str, seed: int) -> Column:
    """Seeded 60-bit order of a document: from its id and text alone."""
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text_of(text_col).cast("binary")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``place``, the 0-based rank by source, null last: ranks within
    range partitions plus the rows of the partitions before."""
    placed = staged(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("pid", F.spark_partition_id()), "mix-sources")
    sizes = placed.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))  # one row a partition
    inside = Window.partitionBy("pid").orderBy(F.col("source").asc_nulls_last())
    return placed.join(F.broadcast(offsets), "pid").select("source", "source_size", (F.row_number().over(inside) - 1 + F.col("off")).alias("place"))


def targets(sized: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """source, source_size, target: water-filling over the sources."""
    plan = _ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    table = F.array(*[F.lit(float(w)) for w in weights])
    plan = plan.withColumn("w", F.get(table, (F.col("place") % len(weights)).cast("int"))).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    plan = staged(plan.select("source", "source_size", "w", "most"), "mix-plan")
    level = None  # words a unit of weight; a source is full at level * w > most
    total = float(plan.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:
        full = F.lit(False) if level is None else F.col("w") * F.lit(level) > F.col("most")
        got = plan.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("held"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("open")).first()
        new = (total - (got["held"] or 0.0)) / got["open"] if got["open"] else float("inf")
        if level is not None and new <= level:
            break
        level = new
        if not got["open"]:
            break
    return plan.select("source", "source_size", F.least("most", F.col("w") * F.lit(level)).alias("target"))


def cut_points(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``whole`` (repetitions of every document), ``cut`` and ``at_cut``:
    documents with a key below ``cut`` are taken once more, those at it if
    ``at_cut``."""
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = plan.withColumn("whole", F.floor(epochs).cast("long"))
    state = state.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("cut", F.lit(0).cast("long"))
    for level in range(60 // DIGIT):
        low = 60 - DIGIT * (level + 1)
        now = state.select(F.col("source").alias("s"), F.col("rest").alias("left"), F.col("cut").alias("prefix"))
        within = sized.join(now, sized["source"].eqNullSafe(now["s"])).filter(F.shiftright("key", low + DIGIT) == F.col("prefix"))
        digits = within.groupBy("s", "left", "prefix", F.shiftright("key", low).alias("digit")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("s").orderBy("digit")  # at most 2**15 digits of a source
        digits = digits.withColumn("upto", F.sum("n").over(upto))
        hit = digits.filter(F.col("upto") > F.col("left")).groupBy("s").agg(F.min_by(F.struct("digit", (F.col("left") - F.col("upto") + F.col("n")).alias("rest"), "n"), "digit").alias("hit"))
        old = state.select("source", "source_size", "target", "whole", F.col("rest").alias("old_rest"), F.col("cut").alias("old_cut"))
        # no digit beyond the rest: everything under the prefix is taken
        state = old.join(hit, old["source"].eqNullSafe(hit["s"]), "left").select(
            "source", "source_size", "target", "whole",
            F.coalesce("hit.rest", "old_rest").alias("rest"),
            F.coalesce("hit.digit", F.shiftleft(F.col("old_cut"), DIGIT) + F.lit((1 << DIGIT) - 1)).alias("cut"),
            F.coalesce(F.col("hit.n"), F.lit(0)).alias("n"),
        )
        state = staged(state, "mix-cut")
    return state.select("source", "source_size", "target", "whole", "cut", ((F.col("n") == 0) | (F.col("rest") * 2 >= F.col("n"))).alias("at_cut"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_of(text_col)).alias("size"), order_key(id_col, text_col, seed).alias("key"))


def _reps() -> Column:
    more = (F.col("key") < F.col("cut")) | ((F.col("key") == F.col("cut")) & F.col("at_cut"))
    return F.col("whole") + F.when(more, 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, cap: float = 2.0, seed: int = 42) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, repetitions."""
    sized = staged(_sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    plan = cut_points(sized, targets(sized, share, cap)).withColumnRenamed("source", "s")
    return sized.join(plan, sized["source"].eqNullSafe(plan["s"])).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * _reps()).alias("taken"), _reps().alias("repetitions"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, cap: float = 2.0, seed: int = 42) -> DataFrame:
    """The mix itself: the input's columns, each row as often as it is taken."""
    sized = staged(_sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    plan = cut_points(sized, targets(sized, share, cap)).withColumnRenamed("source", "s")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).cast("string").alias("source"), order_key(id_col, text_col, seed).alias("key"))
    taken = rows.join(plan, rows["source"].eqNullSafe(plan["s"])).withColumn("reps", _reps()).filter("reps > 0")
    return taken.select(F.explode(F.array_repeat("row", F.col("reps").cast("int"))).alias("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
