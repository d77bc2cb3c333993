"""An index of intervals: hierarchical bins as a column, files by slices of the contigs.

The bins of level l are 2^(shift + 3 l) bases wide, and an interval is in the narrowest one that holds it. A region meets the few bins of each level that it
touches, so a join on bins compares an interval only with regions near it. Written tables are parted by slices: a slice stands for wide stretches of contigs, by a
hash, and -1 for intervals that cross two; a region names its slices, so that files of others are never opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS, SHIFT, WIDE, SLICES = 6, 14, 26, 64


def bin_of(start: Column, end: Column) -> Column:
    """The bin of the interval from start up to end: level, then the place in the level, as one number. An empty interval counts as one base."""
    last = F.greatest(end - 1, start)
    out = F.lit(LEVELS).cast("bigint") * (1 << 48)
    for level in reversed(range(LEVELS)):
        s = SHIFT + 3 * level
        out = F.when(F.shiftright(start, s) == F.shiftright(last, s), F.lit(level << 48) + F.shiftright(start, s)).otherwise(out)
    return out.cast("bigint")


def bins_near(start: Column, end: Column) -> Column:
    """All bins whose intervals may overlap the region, as an array: some 2^-3 of the finest for each level above it."""
    last = F.greatest(end - 1, start)
    place = lambda c, level: F.lit(level << 48) + F.shiftright(c, SHIFT + 3 * level)
    each = [F.sequence(place(start, level), place(last, level)).cast("array<bigint>") for level in range(LEVELS)]
    return F.concat(*each, F.array(F.lit(LEVELS << 48).cast("bigint")))


def _slice(contig: Column, tile: Column) -> Column:
    return F.pmod(F.xxhash64(contig.cast("string"), tile.cast("bigint")), F.lit(SLICES)).cast("int")


def slice_of(contig: Column, start: Column, end: Column) -> Column:
    one = F.shiftright(start, WIDE) == F.shiftright(F.greatest(end - 1, start), WIDE)
    return F.when(one, _slice(contig, F.shiftright(start, WIDE))).otherwise(-1)


def write(rows: DataFrame, path: str) -> None:
    """Rows (contig, start, end, ...) with their bins, parted by slices and sorted by contig, bin and start. Rows with a null place, or a start below 0, are left out."""
    x = rows.where("contig is not null and start >= 0 and end is not null").withColumns({"start": F.col("start").cast("bigint"), "end": F.col("end").cast("bigint")})
    x = x.withColumn("bin", bin_of(F.col("start"), F.col("end"))).withColumn("slice", slice_of(F.col("contig"), F.col("start"), F.col("end")))
    x.repartitionByRange("slice", "contig", "bin", "start").sortWithinPartitions("slice", "contig", "bin", "start").write.partitionBy("slice").mode("overwrite").parquet(path)


def within(index: DataFrame, contig, start: int, end: int) -> DataFrame:
    """Rows of a written table that overlap one region. Slices choose files, contig and bins are compared with the statistics of their row groups."""
    tiles = range(start >> WIDE, (max(end - 1, start) >> WIDE) + 1)
    spark = index.sparkSession
    wanted = {-1, *(r[0] for r in spark.createDataFrame([(t,) for t in tiles], "t bigint").select(_slice(F.lit(contig), F.col("t"))).collect())}  # SLICES and one at most
    last = max(end - 1, start)
    near = F.col("bin") == (LEVELS << 48)
    for level in range(LEVELS):
        s = SHIFT + 3 * level
        near = near | F.col("bin").between((level << 48) + (start >> s), (level << 48) + (last >> s))
    return index.where(F.col("slice").isin(sorted(wanted)) & (F.col("contig") == contig) & near & (F.col("start") < end) & (F.col("end") > start) & F.lit(end > start))


def overlapping(index: DataFrame, regions: DataFrame) -> DataFrame:
    """Each region (contig, r_start, r_end, ...) with every row of a written table that overlaps it; rows meet on contig and bin. Null and empty regions overlap nothing."""
    r = regions.where("r_start >= 0 and r_end > r_start").withColumn("bin", F.explode(bins_near(F.col("r_start").cast("bigint"), F.col("r_end").cast("bigint"))))
    return r.join(index.drop("slice"), ["contig", "bin"]).where((F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start"))).drop("bin")
