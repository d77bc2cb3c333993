"""Near-duplicate documents by SuperMinHash: signatures, banding, verification, grouping.

Equal shingle sets are one class from the start, found by a digest of the whole set, so exact
copies cost one row. Classes meet in the buckets of their bands. A bucket compares each member
with two leaders only (pairs grow with the bucket, not with its square); verified links
give components, and only members of a bucket that are still in different components
matter further. For those, the shingles that no other of them has are counted: a document with s
shared shingles of n has at most min(s, s') in common with another, which rules out most pairs from two
numbers each. The member with the largest shared part leads a second round. What is then left
apart and not ruled out is verified inside a join on the bucket, which gives no row but for a link. So every pair that shares a bucket is verified, ruled out
by an exact bound, or in one component already. Verification is exact, on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import kernels
from strandlake.llm.graph import connected_components
from strandlake.llm.scratch import Scratch

_BYTES = 1 << 20
_FEW = 500_000


def signatures(docs: DataFrame, key: str, text: str, width: int, m: int, rows: int) -> DataFrame:
    """(id, n, d1, d2, bands) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = kernels.utf8(batch.column(1))
            for i, j in kernels.pieces(off, _BYTES):
                sets = kernels.shingles(*kernels.tokens(data[off[i] : off[j]], off[i : j + 1] - off[i]), width)
                keys = kernels.bands(kernels.superminhash(sets, m), rows).astype(np.int64)
                d = np.array([kernels.set_digest(x) for x in sets], np.int64).reshape(-1, 2)
                flat = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1], pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([len(x) for x in sets], pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), flat], names=["id", "n", "d1", "d2", "bands"])

    return docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "id bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>")


def _sets(docs: DataFrame, key: str, text: str, width: int, wanted: DataFrame, few: bool) -> DataFrame:
    """(node, sh): the shingle set of each wanted (id, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = kernels.utf8(batch.column(0))
            for i, j in kernels.pieces(off, _BYTES):
                sets = kernels.shingles(*kernels.tokens(data[off[i] : off[j]], off[i : j + 1] - off[i]), width)
                at = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                flat = pa.ListArray.from_arrays(at, pa.array(np.concatenate(sets).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([kernels.set_digest(x)[0] for x in sets], pa.int64()), flat], names=["node", "sh"])

    ids = wanted.select(F.col("id").alias("id2")).distinct()
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = rows.join(F.broadcast(ids) if few else ids, F.col("id").eqNullSafe(F.col("id2")), "left_semi")
    got = rows.select("text").mapInArrow(run, "node bigint, sh array<bigint>")
    nodes = wanted.select("node").distinct()
    return got.join(F.broadcast(nodes) if few else nodes, "node", "left_semi").dropDuplicates(["node"])


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85, n_bands: int = 32, rows: int = 6
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of ``width``-word
    shingles (fewer words: the whole sequence). A pair at 85 % misses all 32 bands of 6 with a chance
    of about 3e-7. Null, empty and blank texts have no shingles and are linked with nothing. Ids
    may be null (such a row is named by another id of its group, if there is one, and a group of null ids has a
    null component) and may repeat (each row is compared by its own text). kept: the id is the
    component's. Empty tables give no rows; other columns, of any name, are ignored.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    sig = scratch.table(signatures(docs, key, text, width, n_bands * rows, rows), "signatures")
    classes = sig.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.table(classes, "classes")
    filed = classes.select(F.col("d1").alias("node"), "n", F.explode("bands").alias("bucket"))
    by = F.struct(F.xxhash64("node").alias("o"), "node", "n")
    lead = filed.groupBy("bucket").agg(F.count("*").alias("c"), F.min(by).alias("lo"), F.max(by).alias("hi")).where("c > 1").drop("c")
    members = scratch.table(filed.join(lead, "bucket"), "members")

    near = lambda a, b: 100 * F.least(a, b) >= percent * F.greatest(a, b)
    star = members.select("node", "n", F.explode(F.array("lo", "hi")).alias("l")).where((F.col("node") != F.col("l.node")) & near(F.col("n"), F.col("l.n")))
    pairs = scratch.table(star.select(F.greatest("node", "l.node").alias("a"), F.least("node", "l.node").alias("b")).distinct(), "pairs")
    rep = classes.select(F.col("d1").alias("node"), F.col("rep").alias("id"))
    wanted = scratch.table(members.select("node").distinct().join(rep, "node"), "wanted")
    sets = scratch.table(_sets(docs, key, text, width, wanted, wanted.count() <= _FEW), "sets")

    def linked(p: DataFrame) -> DataFrame:
        x = p.join(sets.select(F.col("node").alias("a"), F.col("sh").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("sh").alias("y")), "b")
        same = F.size(F.array_intersect("x", "y"))
        return x.select("a", "b", same.alias("i"), (F.size("x") + F.size("y")).alias("t")).where(F.expr(f"100 * i >= {percent} * (t - i)")).select("a", "b")

    links = scratch.table(linked(pairs), "links")
    comp = connected_components(scratch, links)

    def apart(filed: DataFrame) -> DataFrame:
        """The buckets whose members are in more than one component."""
        x = filed.join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        split = x.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("bucket")
        return scratch.table(x.join(split, "bucket", "left_semi"), "apart")

    left = apart(members.select("bucket", "node", "n"))
    each = left.select("node").distinct().join(sets, "node").select("node", F.explode("sh").alias("sh"))
    often = each.groupBy("sh").agg(F.count("*").alias("c")).where("c > 1").select("sh")
    shared = each.join(often, "sh", "left_semi").groupBy("node").agg(F.count("*").alias("s"))
    left = scratch.table(left.join(shared, "node"), "shared")
    may = lambda x, y: near(F.col(f"{x}.n"), F.col(f"{y}.n")) & ((100 + percent) * F.least(f"{x}.s", f"{y}.s") >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n"))) & (F.col(f"{x}.comp") != F.col(f"{y}.comp"))

    lead = left.groupBy("bucket").agg(F.max(F.struct((F.col("s") / F.col("n")).alias("part"), "node", "n", "s", "comp")).alias("y"))
    second = left.select("bucket", F.struct("node", "n", "s", "comp").alias("x")).join(lead, "bucket").where(may("x", "y"))
    second = second.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    second = scratch.table(second, "second")
    links = links.union(scratch.table(linked(second), "links"))
    comp = connected_components(scratch, links)

    left = apart(left.drop("comp")).join(sets, "node")
    x, y = left.select("bucket", F.struct("node", "n", "s", "comp", "sh").alias("x")), left.select("bucket", F.struct("node", "n", "s", "comp", "sh").alias("y"))
    same = F.size(F.array_intersect("x.sh", "y.sh"))
    true = same * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))  # checked by the join, which so makes links only
    more = x.join(y, "bucket").where((F.col("x.node") > F.col("y.node")) & may("x", "y") & true).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    more = scratch.table(more.distinct(), "more")
    if more.limit(1).count():
        comp = connected_components(scratch, links.union(more))
    group = classes.select("d1", "d2", "rep").join(comp.withColumnRenamed("node", "d1"), "d1", "left").withColumn("component", F.coalesce("component", "d1"))
    name = group.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = scratch.table(group.join(name, "component").select("d1", "d2", "component_id"), "named")
    out = sig.select("id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    out = out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without the rows that are not kept: one row of each group stays, the one with the smallest id.

    Rows are told apart by their numbers (``Scratch.numbered``), not by their ids; a null id comes last, and of equal ids one stays.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    rows, at = scratch.numbered(docs)
    found = near_duplicates(rows, key=at, text=text, **how).select(F.col("id").alias("r"), F.col("component_id").alias("c"))
    found = scratch.table(found, "found")
    ids = rows.select(F.col(f"`{at}`").alias("r"), F.col(f"`{key}`").cast("bigint").alias("id"))
    # joins on the row's number, which no group makes hot; groups only meet in a minimum, which combines before the shuffle
    first = found.join(ids, "r").groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "r"))["r"].alias("r"))
    gone = scratch.table(found.select("r").join(first.select("r"), "r", "left_anti").select(F.col("r").alias("__gone")), "gone")
    gone = F.broadcast(gone) if gone.count() <= _FEW else gone
    return rows.join(gone, F.col(f"`{at}`") == F.col("__gone"), "left_anti").drop(at)
