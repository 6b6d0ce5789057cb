"""Interaction audit of document filters (DataFrame operations only).

Each document gets the set of filters it fails, a mask of five bits; everything
else follows from the number of documents by (part, mask), at most 32 cells a
part. From them come the removals of all 32 coalitions: ``v[S]``, the documents
that fail a filter of S. In an order, a filter that follows the set P removes
``v[P + f] - v[P]``; the other counts of a step are such differences too.

The Shapley value of a filter, its mean removal over all orders, is the solution
of a constrained least squares problem: fit ``sum of phi[i] for i in S`` to
``v[S]`` over the proper coalitions, weighted by the Shapley kernel, with the
sum of all phi held at ``v[all]``. Its normal equations do not depend on the
part, so they are solved once, in rationals, for ``phi`` as a linear map of
``v``; times the number of orders its coefficients are whole numbers.

The last filter, "identical to the text of a smaller id", compares whole texts
by their SHA-256. Rows are first added up by (text, id, mask), then the least id
of a text is an aggregate and meets its rows on (text, id): no task holds the
copies of a text.

Defined cases: an empty table gives no rows; a null or empty text has no words
(it fails "few words", and "copy" as any other text); a null id is neither
smaller nor larger than another, so such a row never fails "copy", makes none
fail, and has no label; rows with equal id and text do not fail it for each
other; null and empty parts are one; labels of one id are joined by "any".
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm.common import staged, text_of, words

NAMES = "ABCDE"
COPY = "E"


def shapley_map(n: int) -> list[list[Fraction]]:
    """phi[i] = sum over S of map[i][S] * v[S], for v[empty] = 0: the solution of
    the kernel-weighted least squares under sum(phi) = v[all]."""
    full = (1 << n) - 1
    weight = {s: Fraction(n - 1, comb(n, k) * k * (n - k)) for s in range(1, full) for k in [s.bit_count()]}
    # normal equations with a multiplier for the constraint; a right side for each v[S]
    rows = []
    for i in range(n):
        left = [sum((w for s, w in weight.items() if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(n)] + [Fraction(1)]
        rows.append(left + [weight[s] if s in weight and s >> i & 1 else Fraction(0) for s in range(full + 1)])
    rows.append([Fraction(1)] * n + [Fraction(0)] + [Fraction(int(s == full)) for s in range(full + 1)])
    for c in range(n + 1):
        pivot = next(r for r in range(c, n + 1) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n + 1):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c], strict=True)]
    return [row[n + 1 :] for row in rows[:n]]


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text; ``words`` is a column of its words."""
    n, upper = F.size("words"), F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * n,
        "C": 100 * upper.cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents, and labelled ones, by failure mask."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("text"))
    rows = rows.withColumn("words", words(F.col("text")))
    mask = sum((F.when(cond, 1 << i).otherwise(0) for i, cond in enumerate(text_failures(F.col("text")).values())), F.lit(0))
    rows = rows.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("sha"))
    rows = staged(rows.groupBy("sha", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    first = rows.groupBy("sha").agg(F.min("id").alias("id")).filter("id IS NOT NULL").withColumn("is_first", F.lit(True))
    mark = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    named = rows.filter("id IS NOT NULL").join(first, ["sha", "id"], "left")
    named = named.select("id", "part", "n", (F.col("mask") + F.when(F.col("is_first"), 0).otherwise(1 << NAMES.index(COPY))).alias("mask"))
    named = named.join(mark, "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    nameless = rows.filter("id IS NULL").select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    cells = named.unionByName(nameless).groupBy("part", "mask")
    return cells.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def _coalitions(measure: str) -> Column:
    """v[S] of all S: the cells whose mask meets S, added up."""
    def of(s: Column) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(c["mask"].bitwiseAND(s) != 0, c[measure]).otherwise(F.lit(0).cast("long")))

    return F.transform(F.sequence(F.lit(0), F.lit((1 << len(NAMES)) - 1)), of)


def steps(cells: DataFrame) -> DataFrame:
    """One row per part, order of all filters and step, from the failure cells."""
    n, full = len(NAMES), (1 << len(NAMES)) - 1
    orders = ["".join(p) for p in permutations(NAMES)]
    mean = [[c * len(orders) for c in row] for row in shapley_map(n)]
    assert all(c.denominator == 1 for row in mean for c in row)

    def dot(row: list[Fraction]) -> Column:
        terms = F.zip_with("v", F.lit([int(c) for c in row]), lambda v, c: v * c)
        return F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x)

    # a part has at most 32 cells
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"), F.sum("n").alias("total"))
    parts = parts.select("part", "total", _coalitions("n").alias("v"), _coalitions("good").alias("g"), _coalitions("toxic").alias("t"))
    alone = [F.get("v", F.lit(full)) - F.get("v", F.lit(full & ~(1 << i))) for i in range(n)]
    parts = parts.select("*", F.array(*[dot(row) for row in mean]).alias("phi"), F.array(*alone).alias("alone"))
    out = parts.select("*", F.explode(F.lit(orders)).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    before = sum((F.when(F.instr(F.col("filter_order"), name) < F.col("step"), 1 << i).otherwise(0) for i, name in enumerate(NAMES)), F.lit(0))
    out = out.withColumn("f", F.instr(F.lit(NAMES), F.substring("filter_order", F.col("step"), F.lit(1))) - 1).withColumn("before", before)
    after = F.col("before") + F.get(F.lit([1 << i for i in range(n)]), F.col("f"))

    def gone(values: str) -> Column:
        return F.get(values, after) - F.get(values, F.col("before"))

    return out.select(
        "part", "filter_order", "step",
        (F.col("total") - F.get("v", after)).alias("kept"),
        gone("v").alias("removed"),
        (F.get("v", after - F.col("before")) - gone("v")).alias("redundant"),
        F.get("alone", F.col("f")).alias("unique_fails"),
        gone("g").alias("good_lost"),
        gone("t").alias("toxic_lost"),
        F.get("phi", F.col("f")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Per part, filter order and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (removals summed over all orders)."""
    return steps(failure_cells(docs, labels, id_col, text_col, part_col))
