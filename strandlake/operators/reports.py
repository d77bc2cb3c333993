"""Result documents of steps, gates with substitute documents, weighted medians, cached inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import sequence as S
from strandlake.operators import coverage, reads


def raw_stats(stats: DataFrame, *key: str) -> Column:
    """All statistics of a row as a map of texts, as a report keeps them beside those it names."""
    names = [c for c in stats.columns if c not in key]
    return F.map_from_arrays(F.array(*(F.lit(c) for c in names)), F.array(*(F.col(c).cast("string") for c in names)))


def read_qc_stats(rows: DataFrame, seq: str, quality: str, *key: str) -> DataFrame:
    """(key..., reads, bases, mean_quality, phred_encoding, N50, GC, _raw) of reads with a quality character for each base.

    The encoding is guessed from the least character of a group, its offset taken from the mean; a group without any
    quality counts as sanger and has no mean.
    """
    x = reads.stats(rows, seq, *key)
    codes = F.transform(F.split(quality, ""), F.ascii)
    q = rows.select(*key, F.aggregate(codes, F.lit(0).cast("bigint"), lambda s, c: s + c).alias("s"), F.length(quality).alias("n"), F.ascii(F.array_min(F.split(quality, ""))).alias("c"))
    q = q.where("n > 0").groupBy(*key).agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("c").alias("c"))
    q = q.withColumn("phred_encoding", S.quality_encoding(F.col("c")))
    q = q.select(*key, "phred_encoding", (F.expr("s / n") - S.phred_offset(F.col("phred_encoding"))).alias("mean_quality"))
    raw = x.withColumn("_raw", raw_stats(x, *key))
    x = raw.join(q, list(key), "left") if key else raw.crossJoin(F.broadcast(q))
    return x.select(
        *key, F.col("num_seqs").alias("reads"), F.col("sum_len").alias("bases"), "mean_quality", F.coalesce("phred_encoding", F.lit("sanger")).alias("phred_encoding"),
        F.col("n50").alias("N50"), F.col("gc").alias("GC"), "_raw",
    )


def assembly_stats(contigs: DataFrame, seq: str, alignments: DataFrame, *key: str) -> DataFrame:
    """(key..., fraction_reads_mapped, length, N50, GC, number_of_contigs, _raw_mapping, _raw_seqkit) of assemblies and the alignments (flag) of their reads."""
    counts = coverage.flag_counts(alignments, "flag", *key)
    mapping = counts.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", F.col("passed").cast("string"))))).alias("_raw_mapping"))  # seven categories
    mapped = coverage.fraction_mapped(counts, *key).select(*key, "fraction_mapped")
    x = reads.stats(contigs, seq, *key)
    x = x.withColumn("_raw_seqkit", raw_stats(x, *key))
    for y in (mapped, mapping):
        x = x.join(y, list(key), "left") if key else x.crossJoin(F.broadcast(y))  # one row each
    return x.select(
        *key, F.col("fraction_mapped").alias("fraction_reads_mapped"), F.col("sum_len").alias("length"), F.col("n50").alias("N50"), F.col("gc").alias("GC"),
        F.col("num_seqs").alias("number_of_contigs"), "_raw_mapping", "_raw_seqkit",
    )


def length_gate(contigs: DataFrame, least: int, *key: str) -> DataFrame:
    """(key..., ok): whether any contig (seq) of a group reaches the length."""
    return contigs.groupBy(*key).agg(F.coalesce(F.bool_or(F.length("seq") >= least), F.lit(False)).alias("ok"))


def mock_document(name: Column, least: int) -> Column:
    """The document that stands for the result of an assembly whose contigs are all too short."""
    note = F.lit(f"Skipped: all contigs < {least} bp")
    return F.to_json(F.struct(F.array().cast("array<string>").alias("records"), F.lit("mock").alias("version"), name.alias("input_file"), note.alias("note")))


def gated(results: DataFrame, gate: DataFrame, key: str, least: int) -> DataFrame:
    """(key, value): the result document of each group that passed the gate, the substitute for the others."""
    x = gate.join(results, key, "left")
    return x.select(key, F.when(F.col("ok"), F.col("value")).otherwise(mock_document(F.col(key).cast("string"), least)).alias("value"))


def document(row: DataFrame) -> DataFrame:
    """(value): each row as a JSON document, nulls included."""
    return row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def or_mock(result: DataFrame, gate: DataFrame, condition: str, mock: DataFrame) -> DataFrame:
    """The result where the one-row gate meets a condition, else the substitute, which has the same columns."""
    return result.join(F.broadcast(gate.where(condition).limit(1).select()), how="left_semi", on=F.lit(True)).unionByName(
        mock.join(F.broadcast(gate.where(condition).limit(1).select()), how="left_anti", on=F.lit(True))
    )


def weighted_median(rows: DataFrame, value: str, weight: str, *key: str, compat: bool = False) -> DataFrame:
    """(key..., median): the smallest value at which half of all weight is reached; compat gives the last value from there on, hence the largest."""
    per = rows.groupBy(*key, value).agg(F.sum(weight).alias("w"))
    w = (Window.partitionBy(*key) if key else Window.partitionBy()).orderBy(value)
    per = per.withColumn("cum", F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    pick = F.max(value) if compat else F.min(value)
    return per.where("2 * cum >= total").groupBy(*key).agg(pick.alias("median"))


def cached_paths(accessions: DataFrame, cache: DataFrame, key: str = "accession") -> DataFrame:
    """Adds path, the folder of an accession that was fetched before, or null."""
    return accessions.join(cache.select(key, "path").dropDuplicates([key]), key, "left")


def placements(rows: DataFrame, contigs: DataFrame, k: int = 15, *key: str) -> DataFrame:
    """(key..., read, contig, start, end, seeds): the contig and diagonal that most k-mers of a read agree on; an approximation of alignment.

    rows: (key..., read, seq), contigs: (key..., contig, seq); reads meet the contigs of their own key only. Ties go to the smaller contig, then the
    smaller start. A k-mer that m contigs and n reads have gives m * n seeds: k should be long enough for the contigs.
    """
    q = rows.select(*key, "read", F.length("seq").alias("len"), F.posexplode(S.kmers(F.col("seq"), k)).alias("qp", "km"))
    c = contigs.select(*key, "contig", F.posexplode(S.kmers(F.col("seq"), k)).alias("cp", "km"))
    x = q.join(c, [*key, "km"]).groupBy(*key, "read", "contig", "len", (F.col("cp") - F.col("qp")).alias("d")).agg(F.count("*").alias("seeds"))
    w = Window.partitionBy(*key, "read").orderBy(F.desc("seeds"), "contig", "d")
    x = x.withColumn("r", F.row_number().over(w)).where("r = 1")
    return x.select(*key, "read", "contig", F.greatest("d", F.lit(0)).cast("bigint").alias("start"), (F.col("d") + F.col("len")).cast("bigint").alias("end"), "seeds")


def overlaps(rows: DataFrame, k: int = 15, least: int = 3) -> DataFrame:
    """(a, b, shared): pairs of reads (read, seq), a before b, with so many distinct k-mers in common; an approximation of read overlap.

    A k-mer of n reads gives n * n pairs, of which each counts one: repeats should be masked before.
    """
    x = rows.select("read", F.explode(F.array_distinct(S.kmers(F.col("seq"), k))).alias("km"))
    p = x.select(F.col("read").alias("a"), "km").join(x.select(F.col("read").alias("b"), "km"), "km").where("a < b")
    return p.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def heatmap_cells(matrix: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """(r, c, v, fill): clipped counts placed by row order (family, ord) and leaf order (genome, leaf_pos), with a color from white by black to red."""
    leaves = columns.agg(F.collect_list(F.struct("genome", F.col("leaf_pos").alias("c"))).alias("l"))  # the genomes of one tree, which clustering holds at once
    grid = rows.select("family", F.col("ord").alias("r")).crossJoin(F.broadcast(leaves)).select("family", "r", F.inline("l"))
    x = grid.join(matrix, ["family", "genome"], "left").select("r", "c", F.least(F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)), F.lit(2)).alias("v"))
    return x.withColumn("fill", fill_of(F.col("v")))


def fill_of(v: Column) -> Column:
    return F.when(v <= 0, "#ffffff").when(v == 1, "#212121").otherwise("#ff0000")
