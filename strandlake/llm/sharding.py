"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded order; a row's fractional rank is
(2 * rank + 1) / (2 * rows of the source). Sorting all rows by it deals every source evenly
along the line, so that any cut of the line has the mixture of the whole. The line is cut
into shards whose row counts differ by one at most (law ``rows``).

Only keys are ranked: two hashes and a count for each class of rows that are equal in everything. The order's hash covers
all columns, so that rows with null or repeated ids fall apart as others do. Exact ranks without a group in one
task: the hash splits each source into cells, whose number follows the rows; their counts give offsets, and a window
numbers the classes of a cell. The second numbering works alike on slices of the line, whose counts follow from the
sources' row counts alone. At the end rows are joined once with their places; a class of equal rows is
written from one of them, as often as it has places.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.columns import seeded
from strandlake.llm.scratch import Scratch

_PER_CELL = 50_000


def _bits(rows: int) -> int:
    """Bits for cells or slices of about _PER_CELL rows; 2^20 at most, which is what a window over the cells of a source holds."""
    return min(20, max(6, math.ceil(math.log2(max(1, rows) / _PER_CELL))))


def shard(docs: DataFrame, n_shards: int = 24, *, source: str = "source", key: str = "doc_id", seed: int = 17, order: Column | None = None) -> DataFrame:
    """All columns of docs, plus shard (0 to n_shards - 1) and slot (gapless from 0 in each shard).

    Nulls: rows without a source form a stratum of their own; a null key is a value like others.
    Ties and repeated rows: rows with an equal key are told apart by a hash of
    all their columns; rows equal in everything are interchangeable and each gets its own slot.
    Empty tables give no rows. Columns of docs named shard or slot are replaced; all other names
    are free, as rows travel in one struct. ``order`` is another hash to shuffle by, a long that is not negative and uses all 63 bits. Equal texts are spread like other rows: a group of
    copies may be larger than a shard.
    """
    scratch = Scratch(docs.sparkSession, "shard")
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    whole = F.xxhash64(*(F.col(f"`{c}`") for c in names))
    base = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"),
        F.col(f"`{source}`").isNull().alias("s0"),
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("s"),
        (seeded(seed, F.col(f"`{key}`"), whole) if order is None else order).alias("h"),
        whole.alias("tie"),
    )
    keys = scratch.table(base.groupBy("s0", "s", "h", "tie").agg(F.count("*").alias("c")), "keys")
    total, most = keys.agg(F.sum("c"), F.max("c")).first()
    bits = _bits(total or 0)
    slices = 1 << bits

    keys = keys.withColumn("b", F.shiftright("h", 63 - bits).cast("int"))
    line = Window.partitionBy("s0", "s")
    cells = keys.groupBy("s0", "s", "b").agg(F.sum("c").alias("c"))
    cells = cells.select(
        "s0", "s", "b",
        (F.sum("c").over(line.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("before"),
        F.sum("c").over(line).alias("n"),
    )
    upto = Window.partitionBy("s0", "s", "b").orderBy("h", "tie").rowsBetween(Window.unboundedPreceding, 0)
    ranked = keys.join(cells, ["s0", "s", "b"]).withColumn("first", F.col("before") + F.sum("c").over(upto) - F.col("c"))
    ranked = ranked.withColumn("r", F.explode(F.expr("sequence(first, first + c - 1)")))
    ranked = ranked.select("s0", "s", "h", "tie", "c", "n", "r", F.expr(f"cast((2 * r + 1) * {slices} div (2 * n) as int)").alias("g"))

    # rows of a source before slice g: the r with (2 r + 1) * slices < 2 n g
    sources = keys.groupBy("s0", "s").agg(F.sum("c").alias("n"))
    ahead = lambda g: f"greatest(0, least(n, ((2 * n * {g} - {slices}) + {2 * slices} - 1) div {2 * slices}))"
    dealt = sources.select("n", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("g"))
    dealt = dealt.groupBy("g").agg(F.sum(F.expr(f"{ahead('(g + 1)')} - {ahead('g')}")).alias("d"))
    dealt = dealt.select("g", (F.sum("d").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, 0)) - F.col("d")).alias("ahead"))
    in_slice = Window.partitionBy("g").orderBy(F.expr("(2 * r + 1) / cast(2 * n as double)"), "s0", "s", "r")
    placed = ranked.join(F.broadcast(dealt), "g")  # one row a slice, 2^20 at most
    placed = placed.withColumn("pos", F.col("ahead") + F.row_number().over(in_slice) - 1)
    placed = placed.withColumn("shard", F.expr(f"cast(pos * {n_shards} div {total or 1} as int)"))
    placed = placed.select("h", "tie", "c", "shard", F.expr(f"pos - (shard * {total or 1} + {n_shards} - 1) div {n_shards}").alias("slot"))
    placed = scratch.table(placed, "places")

    out = base.select("h", "tie", "row")
    if (most or 0) > 1:
        out = out.groupBy("h", "tie").agg(F.first("row").alias("row"))
    out = out.join(placed, ["h", "tie"])
    return out.select(*(F.col("row").getField(c).alias(c) for c in names), "shard", "slot")
