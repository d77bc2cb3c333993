"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Every source s has a token target T_s. The rates r_i closest to 1 in relative entropy,
sum r ln r - r, with sum_i r_i * size_i = T_s and 0 <= r_i <= cap, are
r_i = min(cap, exp(lambda_s * size_i)): an exponential tilt of the document by its tokens.
lambda_s is the root of the dual's gradient g(l) = sum_i size_i * min(cap, exp(l * size_i)) - T_s,
which rises with l. It is found by Newton steps held inside a bracket, each step one grouped sum over the
histogram (source, size, rows), which is all that the dual needs of the corpus.

Rates become copies by systematic rounding along the sizes of a source, which errs by half
the largest document at most; then single copies are moved to close what is left of the gap.
A (source, size) class gives its remainder to the rows with the smallest seeded hash. The hash covers all columns, so that
rows with null or repeated ids differ in it. Which of 1,024 hash cells holds the last of them is read off the cells'
counts, and only the hashes of that cell are sorted, so no class, however large, is sorted or gathered. Of rows
that are equal in everything and share that last hash, as many are taken as are missing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.columns import n_words, seeded
from strandlake.llm.scratch import Scratch

_CELL_BITS = 10
_STEPS_A_TABLE = 6


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Adds w and target to (s0, s, source_size): weights by rank of the source, null last, reshared above cap times the size.

    Filling in order of cap / weight: the first source that stays under its cap at the common level
    fixes the level of all later ones. Works on one row a source.
    """
    rank = F.row_number().over(Window.orderBy("s0", "s")) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (rank % len(weights) + 1).cast("int"))
    x = sources.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    x = x.withColumn("ratio", F.col("most") / F.col("w"))
    order = Window.orderBy("ratio", "s0", "s")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    budget = F.sum("source_size").over(every) * F.lit(float(share))
    x = x.withColumn("level", (budget - (F.sum("most").over(upto) - F.col("most"))) / (F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))))
    x = x.withColumn("full", F.col("ratio") <= F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)  # the first of those not full has the largest
    return x.withColumn("target", F.when(F.col("full"), F.col("most")).otherwise(F.col("w") * level)).drop("level", "ratio", "most", "w")


def tilts(scratch: Scratch, hist: DataFrame, sources: DataFrame, cap: float, max_tables: int = 10) -> DataFrame:
    """(s0, s, source_size, target, full, lam) from the histogram (s0, s, size, n)."""
    solved = (F.col("source_size") == 0) | F.col("full")
    state = sources.select("s0", "s", "source_size", "target", "full", "least", F.lit(0.0).alias("lam"), (-60 / F.col("least")).alias("lo"), (math.log(cap) / F.col("least")).alias("hi"), F.lit(float("inf")).alias("gap"))
    state = scratch.table(state.where(~solved).repartition(4), "tilt0")  # one row a source: a few files are enough
    size, lam = F.col("size").cast("double"), F.col("lam")
    for k in range(max_tables):
        for _ in range(_STEPS_A_TABLE):
            tilt = F.exp(F.least(lam * size, F.lit(math.log(cap) + 1)))
            free = tilt < cap
            at = hist.where("size > 0").join(state, ["s0", "s"]).groupBy("s0", "s").agg(
                F.sum(F.col("n") * size * F.least(tilt, F.lit(float(cap)))).alias("mass"),
                F.sum(F.when(free, F.col("n") * size * size * tilt).otherwise(0.0)).alias("slope"),
                *(F.first(c).alias(c) for c in ("source_size", "target", "full", "least", "lam", "lo", "hi")),
            )
            g = F.col("mass") - F.col("target")
            at = at.withColumn("lo2", F.when(g < 0, lam).otherwise(F.col("lo"))).withColumn("hi2", F.when(g > 0, lam).otherwise(F.col("hi")))
            step = F.when(F.col("slope") > 0, lam - g / F.nullif(F.col("slope"), F.lit(0.0)))
            inside = step.isNotNull() & (step > F.col("lo2")) & (step < F.col("hi2"))
            new = F.when(g == 0, lam).when(inside, step).otherwise((F.col("lo2") + F.col("hi2")) / 2)
            state = at.select("s0", "s", "source_size", "target", "full", "least", new.alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), (F.abs(g) / F.col("target")).alias("gap"))
        state = scratch.table(state.repartition(4), f"tilt{k + 1}")
        if not state.where("gap > 1e-9 and hi - lo > 1e-13 * abs(lam)").limit(1).count():
            break
    rest = sources.where(solved).withColumn("lam", F.lit(0.0))
    keep = ("s0", "s", "source_size", "target", "full", "lam")
    return state.select(*keep).union(rest.select(*keep))


def copies_by_class(hist: DataFrame, tilted: DataFrame, cap: float, moves: int = 6) -> DataFrame:
    """Adds m, the whole number of copies of a (source, size) class, to the histogram."""
    size = F.col("size").cast("double")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(cap)).otherwise(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * size, F.lit(math.log(cap) + 1)))))
    x = hist.join(tilted, ["s0", "s"]).withColumn("rate", rate)
    own = Window.partitionBy("s0", "s")
    upto = own.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.floor(F.sum(F.col("n") * F.col("rate")).over(upto) + 0.5)
    x = x.withColumn("upto", whole)
    x = x.withColumn("m", F.col("upto") - F.coalesce(F.lag("upto").over(own.orderBy("size")), F.lit(0)))
    x = x.withColumn("m", F.greatest(F.lit(0), F.least("m", F.floor(F.col("n") * F.lit(float(cap))))).cast("bigint")).drop("upto")
    for _ in range(moves):
        gap = F.col("target") - F.sum(F.col("m") * F.col("size")).over(own)
        x = x.withColumn("gap", gap)
        can = F.when(F.col("gap") > 0, F.col("m") + 1 <= F.col("n") * F.lit(float(cap))).otherwise(F.col("m") > 0) & (F.col("size") > 0)
        x = x.withColumn("off", F.when(can, F.abs(F.col("size") - F.abs("gap"))))
        best = F.min(F.struct(F.col("off").isNull(), "off", "size")).over(own)
        x = x.withColumn("best", best)
        here = (F.col("best.size") == F.col("size")) & (F.col("off") < F.abs("gap"))
        x = x.withColumn("m", F.col("m") + F.when(here, F.signum("gap").cast("bigint")).otherwise(0)).drop("gap", "off", "best")
    return x


def mix(
    docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
    source: str = "source", text: str = "text", key: str = "doc_id", seed: int = 29, size: Column | None = None,
) -> DataFrame:
    """All columns of docs as the struct ``row``, with size, source_size, target, rate and copies.

    Sources are ordered by code point, null last, and weigh ``weights``, repeating. Together they
    get ``share`` of all sizes; no target is above ``cap`` times its source's size, and no row gets
    more than ``cap`` (a whole number) copies. A row without words keeps one copy, which takes
    nothing. Null texts count no words; rows without a source are a source of their own. Rows with
    equal or null keys are told apart by their other columns, and of rows equal in everything the right number is
    taken. Empty tables give no rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    whole = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    base = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(f"`{source}`").isNull().alias("s0"),
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("s"),
        (n_words(F.col(f"`{text}`")) if size is None else size).alias("size"),
        seeded(seed, F.col(f"`{key}`"), whole).alias("h"),
    )
    of_class = ["s0", "s", "size"]
    cell = F.shiftright("h", 63 - _CELL_BITS).cast("int")
    light = scratch.table(base.select(*of_class, "h"), "hashes")
    cells = scratch.table(light.groupBy(*of_class, cell.alias("b")).agg(F.count("*").alias("n")), "cells")
    hist = scratch.table(cells.groupBy(*of_class).agg(F.sum("n").alias("n")), "sizes")
    sources = hist.groupBy("s0", "s").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    sources = scratch.table(targets(sources, weights, share, cap).repartition(4), "targets")
    classes = copies_by_class(hist, tilts(scratch, hist, sources, cap), cap)
    classes = scratch.table(classes.withColumn("base", F.expr("m div n")).withColumn("more", F.expr("m % n")), "classes")

    # the remainder of a class goes to the smallest hashes: the cell where the count is reached, then the hash in it
    own = Window.partitionBy(*of_class)
    cut = cells.join(classes.where("more > 0").select(*of_class, "more"), of_class)
    cut = cut.withColumn("before", F.sum("n").over(own.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    cut = cut.where("before < more and more <= before + n").select(*of_class, "b", (F.col("more") - F.col("before")).alias("left"))
    last = light.withColumn("b", cell).join(cut, [*of_class, "b"]).groupBy(*of_class, "left", "h").agg(F.count("*").alias("k"))
    last = last.withColumn("upto", F.sum("k").over(own.orderBy("h").rowsBetween(Window.unboundedPreceding, 0)))
    last = last.where("upto - k < left and left <= upto").select(*of_class, F.col("h").alias("bound"), "k", (F.col("left") - F.col("upto") + F.col("k")).alias("some"))
    classes = classes.join(last, of_class, "left").select(*of_class, "source_size", "target", "rate", "base", "bound", "k", "some")
    classes = scratch.table(classes, "bounds")
    split = F.col("bound").isNotNull() & (F.col("h") == F.col("bound")) & (F.col("some") < F.col("k"))  # equal rows, of which some are taken
    out = base.join(classes, of_class)
    extra = F.when(F.col("bound").isNotNull() & (F.col("h") <= F.col("bound")), 1).otherwise(0)
    keep = ("row", "size", "source_size", "target", "rate")
    plain = out.where(~F.coalesce(split, F.lit(False))).select(*keep, (F.col("base") + extra).cast("bigint").alias("copies"))
    if not classes.where("some < k").limit(1).count():
        return plain
    equal = out.where(split).groupBy(*of_class).agg(*(F.first(c).alias(c) for c in ("row", "source_size", "target", "rate", "base", "k", "some")))
    equal = equal.withColumn("i", F.explode(F.expr("sequence(1L, k)")))
    return plain.union(equal.select(*keep, (F.col("base") + F.when(F.col("i") <= F.col("some"), 1).otherwise(0)).cast("bigint").alias("copies")))


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: the named columns of every row, as many times as it has copies."""
    rows = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in columns))
