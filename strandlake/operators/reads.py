"""Read and assembly statistics, filtering by quality or budget, interleaving, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake import workspace
from strandlake.functions import sequence as S
from strandlake.operators.ordering import ranked, running
from strandlake.operators.sizes import broadcast_if_small
from strandlake.operators.sketches import kmer_numbers, kmer_rows


def n50(rows: DataFrame, length: str, *key: str) -> DataFrame:
    """(key..., n50): the largest length such that sequences as long or longer have half of all bases.

    The window runs over a histogram of lengths, not over sequences.
    """
    hist = rows.groupBy(*key, F.col(length).alias("len")).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*key) if key else Window.partitionBy()
    upto = group.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, 0)
    x = hist.withColumn("cum", F.sum(F.col("len") * F.col("n")).over(upto)).withColumn("total", F.sum(F.col("len") * F.col("n")).over(group))
    return x.where("2 * cum >= total").groupBy(*key).agg(F.max("len").alias("n50"))


def stats(rows: DataFrame, seq: str, *key: str) -> DataFrame:
    """(key..., num_seqs, sum_len, min_len, avg_len, max_len, q1, q2, q3, n50, gc) of sequences: quartiles of lengths; gc in percent, null without bases."""
    x = rows.select(*key, F.length(seq).cast("bigint").alias("len"), S.gc_count(F.col(seq)).alias("gc"))
    out = x.groupBy(*key).agg(
        F.count("*").alias("num_seqs"), F.sum("len").alias("sum_len"), F.min("len").alias("min_len"), F.avg("len").alias("avg_len"), F.max("len").alias("max_len"),
        *(F.percentile("len", p).alias(n) for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))),
        F.expr("try_divide(sum(gc) * 100.0d, sum(len))").alias("gc"),
    )
    half = n50(x, "len", *key)
    return out.join(half, list(key), "left") if key else out.crossJoin(F.broadcast(half))  # one row each


def qc_split(reads: DataFrame, length: Column, quality: Column, unknown: Column, least: Column, least_quality: float = 3, most_unknown: int = 4) -> DataFrame:
    """Adds is_clean: long enough, good enough and with few enough unknown bases; a null counts as not clean."""
    ok = (length >= least) & (quality >= least_quality) & (unknown <= most_unknown)
    return reads.withColumn("is_clean", F.coalesce(ok, F.lit(False)))


def best_bases(reads: DataFrame, length: str, score: str, tie: str, share: float | None = None, target: Column | int | None = None, key: str | None = None) -> DataFrame:
    """The best reads by score (ties by ``tie``) until a share of all bases, or a number of bases, is reached; the read that reaches it stays.

    With a key each of its groups has its own budget; target may then be a column. Scores are put in 4,096 bins first: the running
    sum goes over one row for each bin, and reads are ordered only inside the bins in which a budget ends, by
    ranges, so that no task holds all reads of a bin. A null score comes last. The reads are written once, as four steps read them.
    """
    reads = workspace.table(reads, "reads")
    k = [F.col(key)] if key else []
    ends = reads.groupBy(*[c.alias("__k") for c in k]).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    same = F.col("__k").eqNullSafe(F.col(key)) if key else F.lit(True)
    bin_ = F.least(F.lit(4095), F.floor(F.coalesce(F.expr(f"try_divide(`{score}` - __lo, __hi - __lo)"), F.lit(0.0)) * 4096)).cast("int")
    x = reads.join(ends, same, "left") if key else reads.crossJoin(F.broadcast(ends)).withColumn("__k", F.lit(0))  # one row of ends
    x = x.withColumn("__s", F.when(F.col(score).isNull(), -1).otherwise(bin_)).drop("__lo", "__hi")
    if target is not None:
        x = x.withColumn("__t", (target if isinstance(target, Column) else F.lit(target)).cast("double"))
    per = x.groupBy("__k", "__s").agg(F.sum(length).alias("__b"), *([F.max("__t").alias("__t")] if target is not None else []))
    group = Window.partitionBy("__k")
    per = per.withColumn("__before", F.sum("__b").over(group.orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__b"))
    per = per.withColumn("__goal", F.sum("__b").over(group) * F.lit(share) if share is not None else F.max("__t").over(group))
    per = per.where("__before < __goal").select(F.col("__k").alias("__k2"), F.col("__s").alias("__s2"), "__b", "__before", "__goal")
    per = broadcast_if_small(per)
    x = x.join(per, F.col("__k").eqNullSafe(F.col("__k2")) & (F.col("__s") == F.col("__s2")))
    whole = F.col("__before") + F.col("__b") < F.col("__goal")
    edge = running(x.where(~whole), [F.col("__k"), F.desc(score), F.col(tie)], F.col(length).cast("double"), "__cum")
    start = edge.groupBy(F.col("__k").alias("__k3")).agg(F.min("__cum").alias("__first"))  # the edge bin of a group is one run of the order
    edge = edge.join(start, F.col("__k").eqNullSafe(F.col("__k3"))).where("__before + __cum - __first < __goal")
    return x.where(whole).select(*reads.columns).unionByName(edge.select(*reads.columns))


def discarded(reads: DataFrame, kept: DataFrame, name: str) -> DataFrame:
    """Reads whose name is not among the kept; repeated names all stay."""
    return reads.join(kept.select(name).distinct(), name, "left_anti")


def interleave(forward: DataFrame, reverse: DataFrame, on: list[str]) -> DataFrame:
    """Pairs by position keys: forward, then reverse, for positions that both have; side is 1 or 2."""
    both = forward.select(*on).join(reverse.select(*on), on)
    rows = forward.withColumn("side", F.lit(1)).unionByName(reverse.withColumn("side", F.lit(2)))
    return rows.join(both, on, "left_semi")


def deinterleave(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("side = 1").drop("side"), rows.where("side = 2").drop("side")


def batches(rows: DataFrame, order: str, size: int, group: str | None = None) -> DataFrame:
    """Adds batch: runs of ``size`` rows in the order given, within a group or overall."""
    if group is None:
        return ranked(rows, [F.col(order)], "__n").withColumn("batch", F.floor(F.col("__n") / size).cast("bigint")).drop("__n")
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))


def gather(rows: DataFrame, item: str, order: str, *key: str) -> DataFrame:
    """(key..., items): the ordered list of each group; groups must be small."""
    return rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, item))), lambda z: z[item]).alias("items"))


def _neighbours(km: Column, k: int) -> Column:
    """The k-mer and all that differ from it in one base."""
    other = lambda i: F.transform(F.array(*(F.lit(c) for c in "ACGT")), lambda c: F.concat(F.substring(km, F.lit(1), i), c, F.substring(km, i + 2, F.lit(k))))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), other)))


def trim_adapters(reads: DataFrame, adapters: DataFrame, key: str, seq: str, k: int = 23, shortest: int = 11, mismatches: int = 1) -> DataFrame:
    """Adds trimmed: the sequence up to where an adapter (seq) begins in it.

    That is the first k-mer that an adapter has, or the longest end of the read, of ``shortest`` to k - 1 bases, with which an adapter
    begins; one base may differ (``mismatches`` 1) or none (0). Keys that are null or repeat are trimmed by their own sequence.
    """
    if mismatches not in (0, 1):
        raise ValueError("0 or 1 mismatches")
    near = (lambda c, n: _neighbours(c, n)) if mismatches else (lambda c, n: F.array(c))
    ad = adapters.select(F.upper("seq").alias("a"))
    whole_km = ad.select(F.explode(S.kmers(F.col("a"), k)).alias("km")).select(F.explode(near(F.col("km"), k)).alias("km")).distinct()
    short = None
    for n in range(shortest, k):
        part = ad.where(F.length("a") >= n).select(F.explode(near(F.substring("a", 1, n), n)).alias("km"))
        short = part if short is None else short.union(part)
    named = lambda c: F.md5(c.cast("binary"))
    own = reads.select(F.upper(seq).alias("s")).where(F.col("s").isNotNull()).distinct().select(named(F.col("s")).alias("__id"), "s")
    small = lambda d: broadcast_if_small(workspace.table(d, "known"))  # noqa: E731  some seventy times the adapters' bases
    if k <= 31:  # met as numbers
        found = kmer_numbers(own, "s", k, "__id").join(small(kmer_numbers(whole_km, "km", k).select("km").distinct()), "km", "left_semi").select("__id", F.col("pos").alias("p"))
    else:
        whole = kmer_rows(own, "s", k, "__id").select("__id", F.col("pos").alias("p"), F.col("km").cast("string").alias("km"))
        found = whole.join(small(whole_km), "km", "left_semi").select("__id", "p")
    if short is not None:
        n = F.length("s")
        ends = own.select("__id", F.explode(F.transform(F.filter(F.sequence(F.lit(shortest), F.lit(k)), lambda m: (m <= n) & (m < k)), lambda m: F.struct((n - m).alias("p"), F.expr("s").substr(n - m + 1, m).alias("km")))).alias("z"))
        found = found.unionByName(ends.select("__id", "z.p", "z.km").join(small(short.distinct()), "km", "left_semi").select("__id", "p"))
    at = found.groupBy("__id").agg(F.min("p").alias("__at"))
    out = reads.join(at, named(F.upper(seq)) == F.col("__id"), "left")
    return out.withColumn("trimmed", F.substring(F.col(seq), F.lit(1), F.coalesce("__at", F.length(seq)))).drop("__id", "__at")


def trim_pairs(forward: DataFrame, reverse: DataFrame, adapters: DataFrame, on: list[str], seq: str, *, k: int = 23, shortest: int = 11, mismatches: int = 1, even: bool = True, overlap: int = 24) -> DataFrame:
    """(on..., forward, reverse): pairs of reads, both trimmed by adapters and by their own overlap.

    Where a fragment is shorter than its reads each read runs into the adapter behind the other end; then the first m bases of the forward read are the
    reverse complement of the first m of the reverse read. The largest such m of at least ``overlap`` bases and less than either read is where both end, without any adapter being known.
    ``even`` cuts both reads of a pair to the shorter one where either was trimmed by an adapter. Rows without a partner, or with a null sequence, are left out.
    """
    one = lambda d, c: trim_adapters(d.select(*on, F.upper(seq).alias("s")), adapters, on[0], "s", k, shortest, mismatches).select(*on, F.col("s").alias(c), F.length("trimmed").alias(f"n_{c}"))
    x = one(forward, "f").join(one(reverse, "r"), on).where("f is not null and r is not null")
    least = F.least(F.length("f"), F.length("r"))
    lengths = F.when(least > overlap, F.sequence(least - 1, F.lit(overlap), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    turned = S.reverse_complement(F.col("r"))
    # the reverse complement of the first m bases of r is the last m of its own reverse complement
    met = F.get(F.filter(lengths, lambda m: F.col("f").substr(F.lit(1), m) == turned.substr(F.length("r") - m + 1, m)), F.lit(0))
    cut = F.when((F.col("n_f") < F.length("f")) | (F.col("n_r") < F.length("r")), F.least("n_f", "n_r"))
    end = lambda c: F.least(F.col(f"n_{c}"), F.coalesce(cut, F.col(f"n_{c}")) if even else F.col(f"n_{c}"), F.coalesce(met, F.length(c)))
    return x.select(*on, F.col("f").substr(F.lit(1), end("f")).alias("forward"), F.col("r").substr(F.lit(1), end("r")).alias("reverse"))
