"""Family-by-genome matrices: presence, row order, block means, genome distances, runs of a label."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import geometry
from strandlake.operators.ordering import ranked


def presence_class(n_genomes: Column, persistent: int, shell: int) -> Column:
    return F.when(n_genomes >= persistent, "persistent").when(n_genomes >= shell, "shell").otherwise("cloud")


def presence(matrix: DataFrame, persistent: int, shell: int) -> DataFrame:
    """(family, n_genomes, class) of a long matrix (family, genome, n)."""
    x = matrix.where("n > 0").groupBy("family").agg(F.countDistinct("genome").cast("bigint").alias("n_genomes"))
    return x.withColumn("class", presence_class(F.col("n_genomes"), persistent, shell))


def row_order(families: DataFrame, cls: str = "class", group: str = "group_first", idx: str = "idx") -> DataFrame:
    """Adds ord from 0: persistent, then shell, then cloud; inside a class equal rows stay together in the order of their first.

    Other classes are left out. Families are numbered by ranges of the order, none of which holds a whole class.
    """
    rank = F.when(F.col(cls) == "persistent", 0).when(F.col(cls) == "shell", 1).when(F.col(cls) == "cloud", 2)
    x = families.withColumn("__r", rank).where("__r is not null")
    return ranked(x, [F.col("__r"), F.col(group), F.col(idx)], "ord").drop("__r")


def clip(n: Column, lo: int = 0, hi: int = 2) -> Column:
    return F.least(F.greatest(n, F.lit(lo)), F.lit(hi))


def block_mean(cells: DataFrame, rows: int, columns: int, size: int = 10, compat: bool = False) -> DataFrame:
    """(out_row, out_col, value) of cells (r, c, v): means of ``size`` rows of one column.

    compat takes ``size`` consecutive cells of the matrix read row by row instead. Rows beyond a whole number of blocks are left out.
    """
    x = cells.where(F.col("r") < size * (rows // size))
    if compat:
        bin_ = F.floor((F.col("r") * columns + F.col("c")) / size).cast("bigint")
        row, col = F.floor(bin_ / columns), bin_ % columns
    else:
        row, col = F.floor(F.col("r") / size), F.col("c")
    return x.groupBy(row.cast("bigint").alias("out_row"), col.cast("bigint").alias("out_col")).agg(F.avg("v").alias("value"))


def jaccard(matrix: DataFrame, item: str = "family", group: str = "genome") -> DataFrame:
    """(g1, g2, inter, distance) of pairs of groups that share an item, g1 < g2; pairs that share nothing are at distance 1 and not listed."""
    x = matrix.where("n > 0").select(item, group).distinct()
    size = x.groupBy(group).agg(F.count("*").alias("n"))
    pairs = x.select(item, F.col(group).alias("g1")).join(x.select(item, F.col(group).alias("g2")), item).where("g1 < g2").groupBy("g1", "g2").agg(F.count("*").alias("inter"))
    pairs = pairs.join(size.select(F.col(group).alias("g1"), F.col("n").alias("a")), "g1").join(size.select(F.col(group).alias("g2"), F.col("n").alias("b")), "g2")
    return pairs.select("g1", "g2", "inter", F.expr("1.0d - inter / (a + b - inter)").alias("distance"))


def label_runs(rows: DataFrame, label: str, order: list[str], *key: str) -> DataFrame:
    """(key..., label, l, r): half-open runs of equal labels in order; a null label makes no run of its own but ends one."""
    w = Window.partitionBy(*key).orderBy(*order)
    x = rows.withColumn("__i", F.row_number().over(w) - 1)
    x = x.withColumn("__new", F.when(F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.col("__i") > 0), 0).otherwise(1))
    x = x.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.where(F.col(label).isNotNull()).groupBy(*key, "__run", label).agg(F.min("__i").cast("bigint").alias("l"), (F.max("__i") + 1).cast("bigint").alias("r"))
    return x.drop("__run")


def color_order(runs: DataFrame, label: str) -> DataFrame:
    """(label, segments, draw_order): labels with fewer runs first, ties by label."""
    x = runs.groupBy(label).agg(F.count("*").cast("bigint").alias("segments"))
    return x.withColumn("draw_order", F.row_number().over(Window.orderBy("segments", label)).cast("bigint"))


def bar_positions(runs: DataFrame, n: Column | int, width: float = 1.0, half_bin: bool = True) -> DataFrame:
    """Adds start and end on a bar of a width to runs (l, r) of n places; half_bin shifts every bound by half a place."""
    n = n if isinstance(n, Column) else F.lit(n)
    at = lambda c: (F.col(c) / n + (0.5 / n if half_bin else F.lit(0.0))) * width
    return runs.withColumn("start", at("l")).withColumn("end", at("r"))


def categorical_bar(rows: DataFrame, label: str, order: list[str], *key: str, circular: bool = True, position: float = 0.5, thickness: float = 0.03) -> DataFrame:
    """(key..., label, l, r, start, end, draw_order, path): the runs of a label as outlines of arcs on a ring, or of lines, rarer labels first."""
    runs = label_runs(rows, label, order, *key)
    n = rows.groupBy(*key).agg(F.count("*").alias("__n"))
    runs = runs.join(n, list(key)) if key else runs.crossJoin(F.broadcast(n))
    runs = bar_positions(runs, F.col("__n")).drop("__n").join(F.broadcast(color_order(runs, label).select(label, "draw_order")), label)  # one row a label
    if circular:
        path = geometry.arc_points(F.col("start") * 2 * math.pi, F.col("end") * 2 * math.pi, position, thickness)
    else:
        path = geometry.line_quad(F.col("start") - 0.5, F.lit(position), F.col("end") - 0.5, F.lit(position), thickness)
    return runs.withColumn("path", geometry.svg_path(path))


def normalised(rows: DataFrame, column: str) -> DataFrame:
    """The column scaled to 0 to 1 over all rows; 0 where all are equal."""
    ends = rows.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    return rows.crossJoin(F.broadcast(ends)).withColumn(column, F.coalesce(F.expr(f"try_divide(`{column}` - __lo, __hi - __lo)"), F.lit(0.0))).drop("__lo", "__hi")
