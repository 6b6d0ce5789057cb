"""Chat formatting with cumulative-snapshot collapse (DataFrame operations only).

Logs often hold a conversation several times, each time with more turns. Every
turn hashes with its position to ``LANES`` 32-bit numbers; their running sums
are the rolling hashes of the turn prefixes. A conversation is contained in a
longer one if its last rolling hash occurs more often as the hash of a prefix
than as that of a whole conversation. Anti-joins drop contained conversations
and all but one (smallest id) of equal ones; what stays is rendered.

Rows are range-partitioned and sorted by (conversation, turn number, role, text)
once; a row's position in its conversation is its place in its partition plus
the rows of the conversation in the partitions before. Running sums are built per
(conversation, block of ``BLOCK`` positions) with a carry from the blocks before;
the prefix counts combine map-side; and a conversation is rendered in pieces of
``BLOCK`` rows. So a conversation, a turn number or a prefix with a third of all
rows meets in no single task.

Rendering of a turn: ``<|im_start|>role``, newline, text, ``<|im_end|>``,
newline; ``<|`` in a text or role becomes ``< |``, so text cannot forge a mark.

Defined cases: null role or text counts as empty; a null conversation id is one
conversation; null turn numbers come before turn 0; repeated rows (equal in all four
fields) count once; different rows with one turn number follow their role, then
their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.llm.common import staged, text_of

LANES = 4
BLOCK = 4096
SUMS = [f"s{i}" for i in range(LANES)]


def ordered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The distinct rows (conv, turn, role, text), as a table in order: ``part``,
    the range partition, and ``at``, which grows with the order."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text")).distinct()
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *rows.columns).sortWithinPartitions(*rows.columns)
    return staged(rows.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "chat-rows")


def _places(rows: DataFrame) -> DataFrame:
    """c, p (conversation, partition) and what turns ``at`` into the position."""
    here = rows.groupBy("conv", "part").agg(F.min("at").alias("head"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return here.select(F.col("conv").alias("c"), F.col("part").alias("p"), (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("head") + 1).alias("shift"))


def _placed(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of the places, with ``pos`` (1-based) and ``block``."""
    rows = rows.join(places, rows["conv"].eqNullSafe(places["c"]) & (rows["part"] == places["p"]))
    rows = rows.withColumn("pos", (F.col("at") + F.col("shift")).cast("long"))
    return rows.withColumn("block", F.floor((F.col("pos") - 1) / BLOCK).cast("long"))


def prefixes(rows: DataFrame) -> DataFrame:
    """conv, block, pos (1-based) and the rolling hash (s0..) after each turn,
    of ordered rows."""
    hashed = rows.select("conv", "part", "at", F.xxhash64("role", "text").alias("t0"), F.xxhash64(F.lit(1), "role", "text").alias("t1"))
    rows = _placed(hashed, _places(rows))
    parts = [F.shiftrightunsigned(F.xxhash64("pos", t), shift).bitwiseAND(F.lit(0xFFFFFFFF)) for t in ("t0", "t1") for shift in (0, 32)]
    rows = staged(rows.select("conv", "block", "pos", *[p.alias(f"h{i}") for i, p in enumerate(parts)]), "chat-turns")
    inside = Window.partitionBy("conv", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.groupBy("conv", "block").agg(*[F.sum(f"h{i}").alias(f"b{i}") for i in range(LANES)])
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(F.col("conv").alias("c"), F.col("block").alias("b"), *[F.coalesce(F.sum(f"b{i}").over(earlier), F.lit(0)).alias(f"k{i}") for i in range(LANES)])
    rows = rows.select("conv", "block", "pos", *[F.sum(f"h{i}").over(inside).alias(f"r{i}") for i in range(LANES)])
    rows = rows.join(carry, rows["conv"].eqNullSafe(carry["c"]) & (rows["block"] == carry["b"]))
    return rows.select("conv", "block", "pos", *[(F.col(f"r{i}") + F.col(f"k{i}")).alias(f"s{i}") for i in range(LANES)])


def maximal(rows: DataFrame) -> DataFrame:
    """The conversations of ordered rows that stay: conv, n_turns."""
    rows = staged(prefixes(rows), "chat-prefixes")
    # sums of non-negative parts only grow, so the largest belong to the last turn
    whole = staged(rows.groupBy("conv").agg(F.max("pos").alias("pos"), *[F.max(s).alias(s) for s in SUMS]), "chat-whole")
    both = rows.select("pos", *SUMS, F.lit(0).alias("full")).union(whole.select("pos", *SUMS, F.lit(1).alias("full")))
    counts = both.groupBy("pos", *SUMS).agg(F.sum(1 - F.col("full")).alias("as_prefix"), F.sum("full").alias("as_whole"))
    contained = counts.filter((F.col("as_prefix") > F.col("as_whole")) & (F.col("as_whole") > 0)).select("pos", *SUMS)
    longest = whole.join(contained, ["pos", *SUMS], "left_anti")
    first = longest.groupBy("pos", *SUMS).agg(F.min_by(F.struct("conv"), F.struct(F.col("conv").isNull(), "conv")).alias("kept"))
    return staged(first.select(F.col("kept.conv").alias("conv"), F.col("pos").alias("n_turns")), "chat-kept")


def rendered_turn(role: Column, text: Column) -> Column:
    def safe(x):
        return F.replace(x, F.lit("<|"), F.lit("< |"))

    return F.concat(F.lit("<|im_start|>"), safe(role), F.lit("\n"), safe(text), F.lit("<|im_end|>\n"))


def render(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, piece, n_turns, text: the maximal conversations, rendered."""
    rows = ordered(turns, conv_col, turn_col, role_col, text_col)
    kept = maximal(rows)
    places = _places(rows)
    places = places.join(kept, places["c"].eqNullSafe(kept["conv"])).select("c", "p", "shift", "n_turns")
    said = F.array_sort(F.collect_list(F.struct("pos", "role", "text")))
    texts = _placed(rows, places).groupBy("conv", "block", "n_turns").agg(F.array_join(F.transform(said, lambda t: rendered_turn(t["role"], t["text"])), "").alias("text"))
    return texts.select(F.col("conv").alias(conv_col), F.col("block").alias("piece"), "n_turns", "text")
