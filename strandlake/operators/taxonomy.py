"""Taxa of k-mers and of reads over a tree: lowest common ancestors, root-to-leaf scores, cumulative reports.

A tree is a table of (node, parent); the root's parent is null. Its closure, each node with all its ancestors, is made in a logarithmic number of
joins, and numbers every subtree as an interval. The lowest common ancestor of any set of nodes is then that of the first and the
last of them in this order, so that sets are never gathered: a minimum and a maximum, which combine before the shuffle, stand for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake import workspace
from strandlake.functions import sequence as S
from strandlake.operators.sizes import broadcast_if_small
from strandlake.operators.sketches import kmer_number, kmer_numbers, kmer_rows


def closure(tree: DataFrame) -> DataFrame:
    """(node, ancestor, up): every node with itself (up 0) and all nodes above it. Pointer doubling: as many rounds as the logarithm of the depth."""
    step = tree.where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("up"))
    known = workspace.table(tree.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("up")).unionByName(step).distinct(), "closure")
    far = 1
    while True:
        ends = known.where(F.col("up") == far)
        more = ends.select("node", F.col("ancestor").alias("m"), "up").join(known.where("up > 0").select(F.col("node").alias("m"), "ancestor", F.col("up").alias("on")), "m")
        more = workspace.table(more.select("node", "ancestor", (F.col("up") + F.col("on")).alias("up")), "further")
        if more.isEmpty():
            return known
        known = workspace.table(known.unionByName(more), "closure")
        far *= 2
        if far > 1 << 20:
            raise ValueError("the tree has a ring")


def intervals(tree: DataFrame, above: DataFrame) -> DataFrame:
    """(node, depth, first, last): the place of each node in the order of an Euler tour, children by name, and that of the last node below it. above: the tree's closure."""
    size = above.groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("size"))
    depth = above.groupBy("node").agg(F.max("up").alias("depth"))
    w = Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    ahead = tree.join(size, "node").select("node", F.when(F.col("parent").isNull(), F.lit(0)).otherwise(1 + F.sum("size").over(w) - F.col("size")).alias("ahead"))
    first = above.join(ahead.withColumnRenamed("node", "ancestor"), "ancestor").groupBy("node").agg(F.sum("ahead").alias("first"))
    return first.join(size, "node").join(depth, "node").select("node", "depth", "first", (F.col("first") + F.col("size") - 1).alias("last"))


class Tree:
    """A tree with its closure and intervals, written once."""

    def __init__(self, tree: DataFrame):
        self.tree = workspace.table(tree.select("node", "parent").distinct(), "tree")
        self.above = closure(self.tree)
        self.places = workspace.table(intervals(self.tree, self.above), "places")

    def lowest(self, sets: DataFrame) -> DataFrame:
        """sets (..., lo, hi) with the node that is lowest above places lo and hi: the deepest ancestor of the first whose interval reaches the second."""
        pairs = sets.select("lo", "hi").distinct()
        at = self.places.select(F.col("first").alias("lo"), "node")
        reach = self.places.select(F.col("node").alias("ancestor"), "depth", "last")
        x = pairs.join(at, "lo").join(self.above, "node").join(reach, "ancestor").where(F.col("last") >= F.col("hi"))
        return sets.join(x.groupBy("lo", "hi").agg(F.max_by("ancestor", "depth").alias("lowest")), ["lo", "hi"])


def canonical_kmers(rows: DataFrame, seq: str, k: int, *keep: str) -> DataFrame:
    """(keep..., km): the k-mers of ACGT of a sequence, or their reverse complements where these are smaller."""
    x = kmer_rows(rows.withColumn("__u", F.upper(seq)), "__u", k, *keep).select(*keep, F.col("km").cast("string").alias("km"))
    return x.where(F.col("km").rlike("^[ACGT]+$")).select(*keep, F.least("km", S.reverse_complement(F.col("km"))).alias("km"))


def kmer_taxa(reference: DataFrame, tree: Tree, k: int) -> DataFrame:
    """(km, taxon): for each k-mer of the references (taxon, seq) the lowest common ancestor of the taxa that have it. Taxa that the tree lacks are left out."""
    place = tree.places.select(F.col("node").alias("taxon"), "first")
    x = canonical_kmers(reference, "seq", k, "taxon").join(place, "taxon").groupBy("km").agg(F.min("first").alias("lo"), F.max("first").alias("hi"))
    return tree.lowest(x).select("km", F.col("lowest").alias("taxon"))


def classify(reads: DataFrame, known: DataFrame, tree: Tree, k: int) -> DataFrame:
    """(read, taxon, score, kmers): the taxon of each read (read, seq) with a k-mer that known (km, taxon) has.

    kmers counts its k-mers found, repeats included; the score of a taxon is how many of them lie on its way from the root. The best taxon wins; of several the
    lowest common ancestor is taken, with their score. Sequences of rows with one name count together.
    """
    if k <= 31:  # numbers of k-mers meet a table that is broadcast if small, and are summed before any shuffle
        numbers = workspace.table(known.select(kmer_number(F.col("km")).alias("km"), "taxon"), "known")
        found = kmer_numbers(reads, "seq", k, "read", canonical=True).join(broadcast_if_small(numbers), "km").groupBy("read", "taxon")
        hits = found.agg(F.count("*").alias("n"))
    else:
        hits = canonical_kmers(reads, "seq", k, "read").groupBy("read", "km").agg(F.count("*").alias("n")).join(known, "km").groupBy("read", "taxon").agg(F.sum("n").alias("n"))
    hits = workspace.table(hits, "hits")
    way = hits.select("read", "taxon").join(tree.above.select(F.col("node").alias("taxon"), "ancestor"), "taxon")
    score = way.join(hits.select("read", F.col("taxon").alias("ancestor"), "n"), ["read", "ancestor"]).groupBy("read", "taxon").agg(F.sum("n").alias("score"))
    score = workspace.table(score.join(tree.places.select(F.col("node").alias("taxon"), "first"), "taxon"), "scores")
    top = score.groupBy("read").agg(F.max("score").alias("score"))
    sets = score.join(top, ["read", "score"]).groupBy("read", "score").agg(F.min("first").alias("lo"), F.max("first").alias("hi"))
    all_ = hits.groupBy("read").agg(F.sum("n").alias("kmers"))
    return tree.lowest(sets).join(all_, "read").select("read", F.col("lowest").alias("taxon"), "score", "kmers")


def report(classified: DataFrame, tree: Tree) -> DataFrame:
    """(taxon, depth, clade, own): reads at a taxon or below it, and reads at it, for every taxon that has any; counted once a taxon before they go up."""
    own = classified.groupBy("taxon").agg(F.count("*").alias("own"))
    up = own.join(tree.above.select(F.col("node").alias("taxon"), "ancestor"), "taxon").groupBy(F.col("ancestor").alias("taxon")).agg(F.sum("own").alias("clade"))
    return up.join(own, "taxon", "left").join(tree.places.select(F.col("node").alias("taxon"), "depth"), "taxon").select("taxon", "depth", "clade", F.coalesce("own", F.lit(0)).alias("own"))
