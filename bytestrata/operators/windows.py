"""Operators on ordered rows: deltas, runs, shared prefixes, earlier matches, neighbours in two dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def delta(value: Column, window, lag: int = 1) -> Column:
    """Difference to the value `lag` rows before; the first ones stay as they are."""
    return value - F.coalesce(F.lag(value, lag).over(window), F.lit(0))


def restored(difference: Column, window) -> Column:
    """The values of differences to the row before."""
    return F.sum(difference).over(window.rowsBetween(Window.unboundedPreceding, 0))


def zigzag(x: Column) -> Column:
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-x.bitwiseAND(F.lit(1)))


def equal_runs(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, run_no, value, n): stretches of rows with equal values (nulls are equal)."""
    w = ordered(keys, order)
    first = F.row_number().over(w) == 1
    new = F.when(first | ~F.col(value).eqNullSafe(F.lag(value).over(w)), 1).otherwise(0)
    marked = rows.withColumn("_new", new).withColumn("run_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run_no", value).agg(F.count(F.lit(1)).alias("n"))


def common_prefix(a: Column, b: Column, most: int) -> Column:
    """Characters that a and b begin with in common, at most `most`; 0 for nulls. The length is found bit by bit, the highest first."""

    def step(n: Column, bit: Column) -> Column:
        longer = n + bit
        return F.when((longer <= most) & (F.length(a) >= longer) & (F.length(b) >= longer) & (F.left(a, longer) == F.left(b, longer)), longer).otherwise(n)

    bits = F.array(*(F.lit(1 << k) for k in reversed(range(most.bit_length()))))
    return F.coalesce(F.when(a.isNotNull() & b.isNotNull(), F.aggregate(bits, F.lit(0), step)), F.lit(0))


def line_prefixes(docs: DataFrame, most: int = 31) -> DataFrame:
    """(doc_id, line_no, shared, rest): what a line shares with the line before it, and what is left of it."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    before = F.lag("line").over(ordered(["doc_id"], ["line_no"]))
    shared = lines.withColumn("shared", common_prefix(F.col("line"), before, most))
    return shared.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("shared").cast("long").alias("shared"), F.expr("substring(line, shared + 1)").alias("rest"))


def recent_hits(value: Column, window, depth: int = 4) -> Column:
    """How many of the last `depth` values equal this one."""
    return sum((F.coalesce((F.lag(value, k).over(window) == value).cast("int"), F.lit(0)) for k in range(1, depth + 1)), F.lit(0))


def earlier_match(value: Column, keys: list[str], order: list[str]) -> Column:
    """`value` of the nearest earlier row with the same keys."""
    return F.last(value).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1))


def recent_ranks(rows: DataFrame, keys: list[str], order: list[str], symbol: str) -> DataFrame:
    """rows with `rank`: how many other symbols of the key came since the symbol's last row. Each row meets the symbols of its key, so this is
    for alphabets, whose size is bounded, not for identifiers."""
    placed = rows.withColumn("_pos", F.row_number().over(ordered(keys, order)))
    alphabet = rows.select(*keys, F.col(symbol).alias("_symbol")).distinct()
    before = ordered([*keys, "_symbol"], ["_pos"]).rowsBetween(Window.unboundedPreceding, -1)
    grid = placed.select(*keys, "_pos", symbol).join(alphabet, keys).withColumn("_last", F.max(F.when(F.col(symbol) == F.col("_symbol"), F.col("_pos"))).over(before))
    own = F.max(F.when(F.col(symbol) == F.col("_symbol"), F.col("_last")))
    ranks = grid.groupBy(*keys, "_pos").agg(own.alias("_own"), F.collect_list("_last").alias("_lasts"))
    rank = F.when(F.col("_own").isNotNull(), F.size(F.filter("_lasts", lambda x: x > F.col("_own"))).cast("long"))
    return placed.join(ranks.select(*keys, "_pos", rank.alias("rank")), [*keys, "_pos"]).drop("_pos")


def mid_side(left: Column, right: Column) -> tuple[Column, Column]:
    """Half the sum, rounded down, and the difference: both can be undone."""
    side = left - right
    return right + F.floor(side / 2).cast("long"), side


def gradient_residual(raster: DataFrame) -> DataFrame:
    """(image_id, c, y, x, residual): value less the rounded mean of the left and the upper neighbour; missing ones count as 0."""
    left = F.coalesce(F.lag("v").over(ordered(["image_id", "c", "y"], ["x"])), F.lit(0))
    above = F.coalesce(F.lag("v").over(ordered(["image_id", "c", "x"], ["y"])), F.lit(0))
    return raster.withColumn("_left", left).withColumn("_above", above).select("image_id", "c", "y", "x", (F.col("v") - F.shiftright(F.col("_left") + F.col("_above") + 1, 1)).alias("residual"))
