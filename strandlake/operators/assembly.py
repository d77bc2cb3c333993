"""Overlaps of reads by minimisers, string graphs and unitigs.

Graphs are tables of edges. A vertex is a read, or a k-mer, in one of its two orientations; every edge has its mirror image, so a path
and its reverse complement are both there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake import workspace
from strandlake.functions import sequence as S
from strandlake.operators.mapping import chains, minimizers
from strandlake.operators.sketches import kmer_rows

# ---- overlaps ---------------------------------------------------------------------------------------------------


def classes(rows: DataFrame) -> DataFrame:
    """(read, first, rev): the smallest read with the same sequence, on either strand; rev where the other strand is meant. Null and empty sequences are in none."""
    x = rows.select("read", F.upper("seq").alias("s")).where("s <> ''").withColumn("r", S.reverse_complement(F.col("s")))
    x = x.select("read", F.least("s", "r").alias("s"), (F.col("r") < F.col("s")).alias("rev"))
    first = x.groupBy("s").agg(F.min(F.struct("read", "rev")).alias("f"))
    return x.join(first, "s").select("read", F.col("f.read").alias("first"), (F.col("rev") != F.col("f.rev")).alias("rev"))


def _rarer(seeds: DataFrame, most: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Seeds (read, i, pos, rev, key) by how many reads have their key: those of at most ``most`` reads, and what is left of the others.

    A seed of more reads is joined to the one beside it, if that is as frequent, and two of these to the next two, until the run is rare; keys
    of runs do not depend on the strand. What is left after ``levels`` rounds is shared by more reads over 2^levels minimisers.
    """
    found = None
    for level in range(levels + 1):
        n = seeds.select("key", "read").distinct().groupBy("key").agg(F.count("*").alias("n"))
        seeds = workspace.table(seeds.join(n, "key"), f"seeds-{level}")
        rare = seeds.where(F.col("n") <= most).select("read", "pos", "rev", F.struct(F.lit(level).alias("level"), "key").alias("key"))
        found = rare if found is None else found.unionByName(rare)
        often = seeds.where(F.col("n") > most).drop("n")
        if level == levels or often.isEmpty():
            return found, often.select("read", "pos", "rev", "key")
        beside = often.select("read", (F.col("i") - (1 << level)).alias("i"), F.col("pos").alias("pos2"), F.col("rev").alias("rev2"), F.col("key").alias("key2"))
        x = often.join(beside, ["read", "i"])
        here = F.col("key") <= F.col("key2")
        seeds = x.select("read", "i", F.when(here, F.col("pos")).otherwise(F.col("pos2")).alias("pos"), F.when(here, F.col("rev")).otherwise(F.col("rev2")).alias("rev"), F.xxhash64(F.least("key", "key2"), F.greatest("key", "key2")).alias("key"))
    raise AssertionError


def overlaps(rows: DataFrame, *, k: int = 15, w: int = 5, most: int = 100, levels: int = 5, seeds: int = 2) -> DataFrame:
    """(a, a_len, a_start, a_end, rev, b, b_len, b_start, b_end, seeds) of pairs of different reads (read, seq), a before b, by their longest chain of common minimisers.

    Positions run along a, and along b or, where rev is set, its reverse complement; they are carried on from the outer seeds to where the first of both
    reads ends. Of reads with one sequence (``classes``) the smallest stands for all. A minimiser of more than ``most`` reads makes no pairs of all of them: runs of it with its
    neighbours do, once they are rare, and reads that share even 2^levels minimisers in a row with more than ``most`` others are paired with the smallest of
    these. At least ``seeds`` seeds; reads whose common part has k + w + seeds bases unchanged share enough. Null and short sequences have no overlaps.
    """
    alone = classes(rows).where(F.col("read") == F.col("first")).select("read").distinct()
    kept = workspace.table(rows.select("read", F.upper("seq").alias("seq")).where("seq <> ''").join(alone, "read").groupBy("read").agg(F.min("seq").alias("seq")), "reads")
    x = minimizers(kept, "read", "seq", k, w)
    first = x.groupBy("read").agg(F.min("len").alias("len"))
    listed = x.groupBy("read").agg(F.array_sort(F.collect_list(F.struct("pos", "rev", "h"))).alias("m"))  # one read's minimisers
    numbered = listed.select("read", F.posexplode("m").alias("i", "m")).select("read", "i", "m.pos", "m.rev", F.col("m.h").alias("key"))
    rare, often = _rarer(numbered, most, levels)
    side = lambda d, s: d.select("key", F.col("read").alias(s), F.col("pos").alias(f"p{s}"), F.col("rev").alias(f"r{s}"))
    met = side(rare, "a").join(side(rare, "b"), "key").where("a < b").drop("key")
    hub = often.groupBy("key").agg(F.min(F.struct("read", "pos", "rev")).alias("h")).select("key", "h.*")
    met = met.unionByName(side(hub, "a").join(side(often, "b"), "key").where("a < b").drop("key"))
    met = met.join(first.withColumnRenamed("read", "b"), "b").withColumn("rev", F.col("ra") != F.col("rb"))
    anchors = met.select("a", "b", "rev", F.col("pa").alias("x"), F.when(F.col("rev"), F.col("len") - k - F.col("pb")).otherwise(F.col("pb")).alias("y"))
    best = chains(anchors, "a", "b").groupBy("a", "b").agg(F.max(F.struct("seeds", (~F.col("rev")).alias("ahead"), "x0", "x1", "y0", "y1")).alias("c")).where(F.col("c.seeds") >= seeds)
    length = lambda s: first.select(F.col("read").alias(s), F.col("len").alias(f"{s}_len"))
    best = best.select("a", "b", "c.*").join(length("a"), "a").join(length("b"), "b")
    left, right = F.least("x0", "y0"), F.least(F.col("a_len") - F.col("x1"), F.col("b_len") - F.col("y1")) - k
    return best.select(
        "a", "a_len", (F.col("x0") - left).alias("a_start"), (F.col("x1") + k + right).alias("a_end"), (~F.col("ahead")).alias("rev"),
        "b", "b_len", (F.col("y0") - left).alias("b_start"), (F.col("y1") + k + right).alias("b_end"), "seeds",
    )


def exact(found: DataFrame, rows: DataFrame) -> DataFrame:
    """The overlaps whose two parts are the same bases. Parts are hashed apart, on either read; no row carries two sequences."""
    seq = rows.select("read", F.upper("seq").alias("s")).dropDuplicates(["read"])
    cut = lambda s, d: F.substring(s, (F.col(f"{d}_start") + 1).cast("int"), (F.col(f"{d}_end") - F.col(f"{d}_start")).cast("int"))
    x = found.join(seq.withColumnRenamed("read", "a"), "a").select(*found.columns, F.md5(cut(F.col("s"), "a").cast("binary")).alias("__a"))
    turned = F.when(F.col("rev"), S.reverse_complement(F.col("s"))).otherwise(F.col("s"))
    x = x.join(seq.withColumnRenamed("read", "b"), "b").select(*found.columns, "__a", F.md5(cut(turned, "b").cast("binary")).alias("__b"))
    return x.where("__a = __b").select(*found.columns)


# ---- string graphs ----------------------------------------------------------------------------------------------


def contained(found: DataFrame, hang: int = 0) -> DataFrame:
    """(read): reads that lie whole in another one, up to ``hang`` bases at either end. Of two that hold each other the larger name goes."""
    in_a = (F.col("b_start") <= hang) & (F.col("b_len") - F.col("b_end") <= hang)
    in_b = (F.col("a_start") <= hang) & (F.col("a_len") - F.col("a_end") <= hang)
    return found.where(in_a | in_b).select(F.when(in_a, F.col("b")).otherwise(F.col("a")).alias("read")).distinct()


def string_graph(found: DataFrame, *, hang: int = 0, fuzz: int = 0) -> DataFrame:
    """(v, vr, w, wr, length): the edges of the string graph of overlaps (Myers, 2005), both images of each.

    A vertex is a read and whether it is taken reverse-complemented; ``length`` is how many bases of v come before w. Overlaps that leave more than ``hang`` bases
    over at an inner end are no edges, contained reads are left out, and an edge goes if two others lead to the same place with lengths that add up to its own, up
    to ``fuzz``. Reduction joins edges at the vertex between them: in-degree times out-degree rows each, so linear in reads at a given coverage.
    """
    out = contained(found, hang)
    x = found.join(out.withColumnRenamed("read", "a"), "a", "left_anti").join(out.withColumnRenamed("read", "b"), "b", "left_anti")
    x = x.withColumn("a_left", F.col("a_len") - F.col("a_end")).withColumn("b_left", F.col("b_len") - F.col("b_end"))
    x = x.where((F.least("a_start", "b_start") <= hang) & (F.least("a_left", "b_left") <= hang))
    x = x.withColumn("front", F.col("a_start") - F.col("b_start")).withColumn("back", F.col("b_left") - F.col("a_left")).where("front * back > 0")
    edge = lambda v, vr, w, wr, n: F.struct(v.alias("v"), vr.alias("vr"), w.alias("w"), wr.alias("wr"), n.alias("length"))
    a, b, rev, no = F.col("a"), F.col("b"), F.col("rev"), F.lit(False)
    ahead = F.array(edge(a, no, b, rev, F.col("front")), edge(b, ~rev, a, ~no, F.col("back")))
    behind = F.array(edge(b, rev, a, no, -F.col("front")), edge(a, ~no, b, ~rev, -F.col("back")))
    edges = workspace.table(x.select(F.inline(F.when(F.col("front") > 0, ahead).otherwise(behind))), "edges")
    on = edges.select(F.col("v").alias("w"), F.col("vr").alias("wr"), F.col("w").alias("x"), F.col("wr").alias("xr"), F.col("length").alias("more"))
    two = edges.join(on, ["w", "wr"]).groupBy("v", "vr", F.col("x").alias("w"), F.col("xr").alias("wr")).agg(F.min(F.col("length") + F.col("more")).alias("around"))
    return edges.join(two, ["v", "vr", "w", "wr"], "left").where(F.col("around").isNull() | (F.col("around") > F.col("length") + fuzz)).drop("around")


def paths(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, head, n, at): for every vertex the first one of the longest path without a fork that it lies on, how many come before it, and the length of the way.

    vertices: (v), edges: (v, w, length); v and w may be of any type that can be compared. An edge is on a path if nothing else leaves v or enters w. List ranking by
    pointer doubling: in each round a vertex looks twice as far back, so rounds are the logarithm of the longest path, and no vertex is looked up by more than
    one other. A ring begins at its smallest vertex.
    """
    one = edges.groupBy("v", "w").agg(F.min("length").cast("bigint").alias("length"))
    lone = lambda c: one.groupBy(c).agg(F.count("*").alias("__n")).where("__n = 1").select(c)
    single = one.join(lone("v"), "v").join(lone("w"), "w").select(F.col("w").alias("v"), F.col("v").alias("p"), "length")
    back = workspace.table(vertices.select("v").distinct().join(single, "v", "left"), "back")

    def ranked(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """(v, head, n, at) of vertices behind a head, and (v, least) of those on rings."""
        zero = F.lit(0).cast("bigint")
        done = links.where("p is null").select("v", F.col("v").alias("head"), zero.alias("n"), zero.alias("at"))
        left = workspace.table(links.where("p is not null").select("v", "p", F.lit(1).cast("bigint").alias("n"), F.col("length").alias("at"), F.least("v", "p").alias("least")), "links")
        total, far = left.count(), 1
        while not left.isEmpty():
            if far > total:  # longer than any path
                return done, left.select("v", "least")
            head = done.select(F.col("v").alias("p"), "head", F.col("n").alias("n2"), F.col("at").alias("at2"))
            done = workspace.table(done.unionByName(left.join(head, "p").select("v", "head", (F.col("n") + F.col("n2")).alias("n"), (F.col("at") + F.col("at2")).alias("at"))), "placed")
            next_ = left.select(F.col("v").alias("p"), F.col("p").alias("q"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("least").alias("least2"))
            left = left.join(next_, "p").select("v", F.col("q").alias("p"), (F.col("n") + F.col("n2")).alias("n"), (F.col("at") + F.col("at2")).alias("at"), F.least("least", "least2").alias("least"))
            left = workspace.table(left, "links")
            far *= 2
        return done, None

    done, rings = ranked(back)
    if rings is not None:
        cut = back.join(workspace.table(rings, "rings"), "v").select("v", F.when(F.col("v") != F.col("least"), F.col("p")).alias("p"), "length")
        done = done.unionByName(ranked(workspace.table(cut, "cut"))[0])
    return done


def unitigs(graph: DataFrame, reads: DataFrame) -> DataFrame:
    """(read, rev, head, head_rev, n, at): the place of every read of a string graph in its unitig, which is named by its first vertex.

    n counts the reads before it, ``at`` is the base of the unitig with which it begins. Reads without an edge are unitigs of their own; each unitig appears in both
    orientations, as all of the graph does. A unitig's sequence is that of its reads up to where the next one begins (``spelled``).
    """
    vertex = lambda r, o: F.struct(F.col(r).alias("r"), F.col(o).alias("o"))
    both = reads.select("read", F.explode(F.array(F.lit(False), F.lit(True))).alias("rev")).select(vertex("read", "rev").alias("v"))
    placed = paths(both, graph.select(vertex("v", "vr").alias("v"), vertex("w", "wr").alias("w"), "length"))
    return placed.select(F.col("v.r").alias("read"), F.col("v.o").alias("rev"), F.col("head.r").alias("head"), F.col("head.o").alias("head_rev"), "n", "at")


def spelled(placed: DataFrame, reads: DataFrame) -> DataFrame:
    """(head, head_rev, seq): the sequence of each unitig, which is the row that it makes."""
    seq = F.when(F.col("rev"), S.reverse_complement(F.upper("seq"))).otherwise(F.upper("seq"))
    x = placed.join(reads.dropDuplicates(["read"]), "read").select("head", "head_rev", "at", seq.alias("s"))
    parts = x.groupBy("head", "head_rev").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("l"))
    till = lambda z, i: F.coalesce(F.get("l", i + 1)["at"] - z["at"], F.length(z["s"]).cast("bigint"))
    return parts.select("head", "head_rev", F.array_join(F.transform("l", lambda z, i: F.substring(z["s"], F.lit(1), till(z, i).cast("int"))), "").alias("seq"))


# ---- de Bruijn graphs -------------------------------------------------------------------------------------------


def debruijn_unitigs(rows: DataFrame, k: int = 21, least: int = 1) -> DataFrame:
    """(seq, kmers): the unitigs of the de Bruijn graph of sequences (seq) and their reverse complements, each in its smaller orientation.

    Vertices are the k-mers that occur at least ``least`` times, both strands together; k is odd. A unitig ends where the graph forks on either side. A ring is cut
    at its smallest k-mer. K-mers with other letters than ACGT break sequences; null and short sequences give none.
    """
    if k % 2 == 0:
        raise ValueError("k must be odd")
    km = kmer_rows(rows.select(F.upper("seq").alias("seq")).where("seq is not null"), "seq", k).select(F.col("km").cast("string").alias("km"))
    km = km.where(F.col("km").rlike("^[ACGT]+$")).groupBy(F.least("km", S.reverse_complement(F.col("km"))).alias("km")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    v = workspace.table(km.select(F.explode(F.array("km", S.reverse_complement(F.col("km")))).alias("v")), "kmers")
    ends = v.select("v", F.substring("v", 2, k - 1).alias("m"))
    begins = v.select(F.col("v").alias("w"), F.substring("v", 1, k - 1).alias("m"))
    edges = workspace.table(ends.join(begins, "m").select("v", "w", F.lit(1).alias("length")), "steps")
    placed = paths(v, edges)
    x = placed.groupBy("head").agg(
        F.array_sort(F.collect_list(F.struct("n", F.substring("v", k, 1).alias("c")))).alias("l"),  # the unitig that the row is
        (F.min("v") <= F.min(S.reverse_complement(F.col("v")))).alias("first"),
    )
    seq = F.concat(F.substring("head", 1, k - 1), F.array_join(F.transform("l", lambda z: z["c"]), ""))
    x = x.where("first").select(seq.alias("seq"), F.size("l").cast("bigint").alias("kmers"))
    return x.select(F.least("seq", S.reverse_complement(F.col("seq"))).alias("seq"), "kmers").distinct()
