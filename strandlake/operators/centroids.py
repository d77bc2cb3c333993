"""Centroid sets: selection, assignment of new sequences, union, exact and similar clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from strandlake import workspace
from strandlake.functions import sequence as S
from strandlake.operators.sizes import broadcast_if_small
from strandlake.operators.sketches import kmer_rows, packed

#: Most k-mers of ACGT whose hashes are kept in a table, 8 bytes each.
_KNOWN = 1 << 20
#: Bases whose k-mers are looked up at a time.
_BLOCK = 1 << 18
_BASES = np.full(256, 4, np.uint8)
_BASES[list(b"ACGT")] = range(4)


def centroid_records(records: DataFrame, clusters: DataFrame, name: str = "id", centroid: str = "centroid") -> DataFrame:
    """Records whose name is a centroid of the cluster table."""
    ids = clusters.select(F.col(centroid).alias(name)).where(F.col(name).isNotNull()).distinct()
    return records.join(ids, name, "left_semi")


def best_hits(hits: DataFrame, query: str = "query", subject: str = "subject", order: str = "pos") -> DataFrame:
    """(query, subject): the first hit of each query."""
    return hits.groupBy(query).agg(F.min_by(subject, order).alias(subject))


def assign(orfs: DataFrame, hits: DataFrame, orf: str = "orf_id", query: str = "query", subject: str = "subject", order: str = "pos") -> DataFrame:
    """(orf_id, centroid_id, status): the centroid of the first hit, or the sequence itself as a new centroid."""
    best = best_hits(hits, query, subject, order).select(F.col(query).alias("__q"), F.col(subject).alias("__s"))
    x = orfs.join(best, F.col(orf) == F.col("__q"), "left")
    return x.select(F.col(orf).alias("orf_id"), F.coalesce("__s", orf).alias("centroid_id"), F.when(F.col("__s").isNull(), "new_centroid").otherwise("matched").alias("status"))


def augment(centroids: DataFrame, orfs: DataFrame, assigned: DataFrame, name: str = "id") -> DataFrame:
    """Centroids, then the sequences that became new centroids; src and the columns of both tell the order."""
    new = assigned.where("status = 'new_centroid'").select(F.col("orf_id").alias(name)).distinct()
    return centroids.withColumn("src", F.lit(0)).unionByName(orfs.join(new, name, "left_semi").withColumn("src", F.lit(1)), allowMissingColumns=True)


def search(orfs: DataFrame, centroids: DataFrame, least_identity: float, least_cover: float = 0.8, k: int = 5) -> DataFrame:
    """(query, subject, identity, pos): hits by shared k-mers, an approximation of a protein search.

    Identity is shared distinct k-mers over those of the shorter sequence, cover those over the query's. Rare
    k-mers meet in an equi-join; pos ranks a query's hits, ties by subject.
    """
    q = orfs.select(F.col("id").alias("query"), F.explode(F.array_distinct(S.kmers(F.col("seq"), k))).alias("km"))
    c = centroids.select(F.col("id").alias("subject"), F.explode(F.array_distinct(S.kmers(F.col("seq"), k))).alias("km"))
    nq, nc = q.groupBy("query").agg(F.count("*").alias("nq")), c.groupBy("subject").agg(F.count("*").alias("nc"))
    x = q.join(c, "km").groupBy("query", "subject").agg(F.count("*").alias("n")).join(nq, "query").join(nc, "subject")
    x = x.withColumn("identity", F.col("n") / F.least("nq", "nc")).where((F.col("identity") >= least_identity) & (F.col("n") >= least_cover * F.col("nq")))
    return x.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("identity"), "subject"))).select("query", "subject", "identity", "pos")


def identical(rows: DataFrame, signature: list[str], order: str, label: str) -> DataFrame:
    """Groups of rows equal in the signature: (signature..., first, n, label); the label of a larger group says how many more there are."""
    x = rows.groupBy(*signature).agg(F.min(order).alias("first"), F.count("*").alias("n"), F.min_by(label, order).alias("__l"))
    return x.select(*signature, "first", "n", F.when(F.col("n") > 1, F.concat(F.col("__l").cast("string"), F.lit("+"), (F.col("n") - 1).cast("string"))).otherwise(F.col("__l").cast("string")).alias("label"))


def _hash_table(spark: SparkSession, k: int, hashed: Callable[[Column], Column]) -> np.ndarray:
    """The hash of each k-mer of ACGT, by its number with the first base highest."""
    letters = (F.substring(F.lit("ACGT"), (F.shiftright("id", 2 * (k - 1 - i)) % 4 + 1).cast("int"), F.lit(1)) for i in range(k))
    got = spark.range(4**k).select("id", hashed(F.concat(*letters).cast("binary")).alias("h")).toArrow()
    out = np.empty(4**k, np.int64)
    out[got.column("id").to_numpy()] = got.column("h").to_numpy()
    return out


def _smallest(rows: DataFrame, k: int, hashes: int, hashed: Callable[[Column], Column]) -> DataFrame:
    """(id, len, h): hashes of the k-mers of rows (id, s, len), with the smallest of each bucket among them.

    The hash of a short k-mer of ACGT is looked up, and a task keeps the smallest of each bucket; other k-mers are hashed one by one.
    """
    if 4**k > _KNOWN:
        return kmer_rows(rows, "s", k, "id", "len").select("id", "len", hashed(F.col("km")).alias("h"))
    h = _hash_table(rows.sparkSession, k, hashed)
    shared = rows.sparkSession.sparkContext.broadcast((h, h % hashes))  # 16 MB at most
    x = rows.select("id", "len", F.col("s").cast("binary").alias("__raw"))
    schema = StructType([*x.select("id", "len").schema.fields, StructField("__h", LongType()), StructField("__km", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bucket = shared.value
        for batch in batches:
            seqs = [s or b"" for s in batch.column(2).to_pylist()]
            joined, stop = b"".join(seqs), np.cumsum([len(s) for s in seqs])
            least, filled = np.full(len(seqs) * hashes, np.iinfo(np.int64).max), np.zeros(len(seqs) * hashes, bool)
            others: set[tuple[int, bytes]] = set()
            for at in range(0, len(joined) - k + 1, _BLOCK):
                codes = _BASES[np.frombuffer(joined, np.uint8, min(_BLOCK + k - 1, len(joined) - at), at)]
                number, upto = packed(codes & 3, k), np.concatenate([[0], np.cumsum(codes > 3)])
                row = np.repeat(np.arange(len(seqs)), np.diff(np.clip(stop, at, at + len(number)), prepend=at))
                inside, known = np.arange(at + k, at + k + len(number)) <= stop[row], upto[k:] == upto[:-k]
                some = np.flatnonzero(inside & known)
                key = row[some] * hashes + bucket[number[some]]
                np.minimum.at(least, key, table[number[some]])
                filled[key] = True
                others.update((row[i], joined[at + i : at + i + k]) for i in np.flatnonzero(inside & ~known).tolist())
            found = np.flatnonzero(filled)
            of = pa.array(np.concatenate([found // hashes, np.fromiter((i for i, _ in others), np.int64, len(others))]))
            h = pa.concat_arrays([pa.array(least[found]), pa.nulls(len(others), pa.int64())])
            km = pa.concat_arrays([pa.nulls(len(found), pa.binary()), pa.array([m for _, m in others], pa.binary())])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), h, km], names=["id", "len", "__h", "__km"])

    return x.mapInArrow(run, schema).select("id", "len", F.coalesce("__h", hashed(F.col("__km"))).alias("h"))


def minhash_clusters(rows: DataFrame, name: str, seq: str, k: int = 10, hashes: int = 8, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(id, centroid): linear-time clustering in the manner of k-mer grouping; approximate.

    k-mer hashes are dealt into ``hashes`` buckets and each sequence is filed under the smallest of each; in each file the
    longest sequence (ties by name) is the centre, and a sequence joins the centre that most of its files name. One pass,
    no pair is ever made. ``hashed`` gives a k-mer's hash, a long.
    """
    x = _smallest(rows.select(F.col(name).alias("id"), F.col(seq).alias("s"), F.length(seq).alias("len")), k, hashes, hashed)
    x = workspace.table(x.groupBy("id", F.pmod("h", F.lit(hashes)).alias("b")).agg(F.min("h").alias("h"), F.max("len").alias("len")), "files")
    longest = x.groupBy("h").agg(F.max("len").alias("len"))
    centre = x.join(broadcast_if_small(workspace.table(longest, "longest")), ["h", "len"]).groupBy("h").agg(F.min("id").alias("centroid"))
    votes = x.join(broadcast_if_small(workspace.table(centre, "centres")), "h").groupBy("id", "centroid").agg(F.count("*").alias("v"))
    best = votes.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("v"), "centroid"))).where("r = 1").select("id", "centroid")
    lone = rows.select(F.col(name).alias("id")).join(best, "id", "left_anti").withColumn("centroid", F.col("id"))
    return best.unionByName(lone)
