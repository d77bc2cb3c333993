"""Depth of coverage by sweep line, weighted mean coverage, alignment counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake import workspace


def depth_runs(intervals: DataFrame, contig: str = "contig", start: str = "start", end: str = "end", tile: int = 1 << 16) -> DataFrame:
    """(contig, start, end, depth), where contig may be a struct of keys: maximal runs of equal, non-zero depth of half-open intervals.

    Every interval is two events; events of a place are added before any window sees them, and places
    where nothing changes are dropped, so that runs that touch at equal depth stay one. Windows run inside tiles of ``tile`` bases, into which the depth at
    their begin is carried from one row for each tile; so a contig is as many tasks as it has tiles.
    """
    x = intervals.select(contig, F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")), F.struct(F.col(end).alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    x = x.groupBy(contig, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    x = workspace.table(x.withColumn("tile", F.floor(F.col("pos") / tile)), "events")
    per = x.groupBy(contig, "tile").agg(F.sum("d").alias("s"), F.min("pos").alias("first"))
    line = Window.partitionBy(contig).orderBy("tile")
    ahead = F.sum("s").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")
    per = per.select(F.col(contig).alias("__c"), F.col("tile").alias("__t"), ahead.alias("ahead"), F.lead("first").over(line).alias("next"))
    w = Window.partitionBy(contig, "tile").orderBy("pos")
    x = x.join(per, F.col(contig).eqNullSafe(F.col("__c")) & F.col("tile").eqNullSafe(F.col("__t")))
    x = x.withColumn("depth", (F.col("ahead") + F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("bigint")).withColumn("stop", F.coalesce(F.lead("pos").over(w), "next"))
    return x.where("depth > 0").select(contig, F.col("pos").alias(start), F.col("stop").alias(end), "depth")


def mean_coverage(runs: DataFrame, contigs: DataFrame) -> DataFrame:
    """(contig, fold_coverage, contig_length): depth weighted by span over the length; contigs without runs have 0.

    Runs of a contig that is not listed raise an error, as they would be lost in silence otherwise.
    """
    sums = runs.groupBy("contig").agg(F.sum((F.col("end") - F.col("start")) * F.col("depth").cast("double")).alias("s"))
    x = contigs.join(sums, "contig", "full")
    length = F.when(F.col("contig_length").isNull(), F.raise_error(F.concat(F.lit("coverage of an unknown contig: "), F.col("contig").cast("string")))).otherwise(F.col("contig_length"))
    return x.select("contig", F.coalesce(F.expr("try_divide(s, contig_length)"), F.lit(0.0)).alias("fold_coverage"), length.cast("bigint").alias("contig_length"))


def uncovered(contigs: DataFrame, runs: DataFrame) -> DataFrame:
    return contigs.join(runs.select("contig").distinct(), "contig", "left_anti")


# Fixed values of the SAM format: flag bits.
FLAGS = {"paired": 1, "proper_pair": 2, "unmapped": 4, "mate_unmapped": 8, "secondary": 256, "qc_fail": 512, "duplicate": 1024, "supplementary": 2048}


def flag_counts(alignments: DataFrame, flag: str = "flag", *key: str) -> DataFrame:
    """(key..., category, passed, failed): counts of alignments by quality status."""
    f = F.col(flag)
    has = lambda name: f.bitwiseAND(F.lit(FLAGS[name])) != 0
    categories = {"total": F.lit(True), "secondary": has("secondary"), "supplementary": has("supplementary"), "duplicates": has("duplicate"), "mapped": ~has("unmapped"), "paired": has("paired"), "properly paired": has("paired") & has("proper_pair") & ~has("unmapped")}
    fail = has("qc_fail")
    row = alignments.groupBy(*key).agg(F.map_from_arrays(F.array(*(F.lit(c) for c in categories)), F.array(*(F.struct(F.count_if(p & ~fail).alias("passed"), F.count_if(p & fail).alias("failed")) for p in categories.values()))).alias("m"))
    return row.select(*key, F.explode("m").alias("category", "n")).select(*key, "category", "n.passed", "n.failed")


def fraction_mapped(counts: DataFrame, *key: str) -> DataFrame:
    """(key..., mapped, total, fraction_mapped): mapped over total; null without alignments."""
    get = lambda c: F.max(F.when(F.col("category") == c, F.col("passed")))
    return counts.groupBy(*key).agg(get("mapped").alias("mapped"), get("total").alias("total")).withColumn("fraction_mapped", F.expr("try_divide(mapped, total)"))
