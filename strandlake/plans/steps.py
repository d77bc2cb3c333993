"""What the transforms of the catalogue do, for those that data logic alone can do.

Every function takes the DataFrames of its needs by name and returns those of its products. Each DataFrame has a
column ``sample``, the instance that it belongs to, and inside a step ``group``, the instance that the transform groups by (see
``Planner.run``), so that one call serves all samples at once. Reads are (sample, id, seq, qual), contigs (sample, id, seq),
texts (sample, content), scalars (sample, value). Alignment, protein search, clustering, gene finding and genome distance are
approximations by k-mers and never claim the results of the programs they stand for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import scalars
from strandlake.functions import sequence as S
from strandlake.operators import centroids as C
from strandlake.operators import clustering, coverage, pangenome, reads, reports, sketches
from strandlake.operators.sizes import broadcast_if_small
from strandlake.sources import records, tables

Frames = dict[str, DataFrame]
MIN_CONTIG = 1000


def _own(x: DataFrame) -> DataFrame:
    """A product belongs to the group."""
    return x.drop("sample").withColumnRenamed("group", "sample")


def seqkit_reads(reads: DataFrame, **_) -> Frames:
    return {"stats": _own(reports.read_qc_stats(reads, "seq", "qual", "group"))}


def assembly_stats(reads: DataFrame, asm: DataFrame, **_) -> Frames:
    contigs = asm.select("group", F.col("id").alias("contig"), "seq")
    placed = reports.placements(reads.select("group", F.col("id").alias("read"), "seq"), contigs, 15, "group")
    at = placed.select(F.struct("group", "contig").alias("contig"), F.greatest("start", F.lit(0)).alias("start"), "end")
    length = contigs.select(F.struct("group", "contig").alias("contig"), F.length("seq").cast("bigint").alias("contig_length"))
    at = at.join(length, "contig").withColumn("end", F.least("end", "contig_length")).where("start < end").drop("contig_length")
    runs = coverage.depth_runs(at)
    flags = reads.select("group", F.col("id").alias("read")).join(placed.select("group", "read", F.lit(True).alias("hit")), ["group", "read"], "left")
    flags = flags.select("group", F.when(F.col("hit"), 0).otherwise(coverage.FLAGS["unmapped"]).alias("flag"))
    apart = lambda x: x.select(F.col("contig.group").alias("sample"), F.col("contig.contig").alias("contig"), *(c for c in x.columns if c != "contig"))
    return {
        "stats": _own(reports.assembly_stats(asm, "seq", flags, "group")),
        "concov": apart(coverage.mean_coverage(runs, length)),
        "bpcov": apart(runs),
    }


def bbduk(reads: DataFrame, rstats: DataFrame, adapters: DataFrame | None = None, **_) -> Frames:
    """The rules: length, mean quality and unknown bases, and adapters where they are given as (seq)."""
    from strandlake.operators import reads as R

    rule = rstats.select("group", S.adaptive_min_length(F.col("N50")).alias("__least"), S.phred_offset(F.col("phred_encoding")).alias("__offset"))
    x = reads.join(broadcast_if_small(rule), "group")
    if adapters is not None:
        x = R.trim_adapters(x, adapters, "id", "seq").withColumn("seq", F.col("trimmed")).withColumn("qual", F.expr("substring(qual, 1, length(trimmed))")).drop("trimmed")
    codes = F.aggregate(F.transform(F.split("qual", ""), F.ascii), F.lit(0).cast("bigint"), lambda s, c: s + c)
    quality = F.try_divide(codes, F.length("qual")) - F.col("__offset")
    x = R.qc_split(x, F.length("seq"), quality, F.regexp_count("seq", F.lit("[Nn]")), F.col("__least")).drop("__least", "__offset")
    return {"out": _own(x.where("is_clean").drop("is_clean")), "disc": _own(x.where("not is_clean").drop("is_clean"))}


def _scored(x: DataFrame) -> DataFrame:
    codes = F.aggregate(F.transform(F.split("qual", ""), F.ascii), F.lit(0).cast("bigint"), lambda s, c: s + c)
    return x.withColumn("__len", F.length("seq").cast("bigint")).withColumn("__score", F.try_divide(codes, F.length("qual")))


def _discarded(x: DataFrame, kept: DataFrame) -> DataFrame:
    return x.join(kept.select(F.col("sample").alias("group"), "id").distinct(), ["group", "id"], "left_anti")


def filtlong(reads: DataFrame, **_) -> Frames:
    """Reads of at least 1,000 bases, of these the best with 90 % of the bases."""
    from strandlake.operators import reads as R

    long = _scored(reads).where("__len >= 1000")
    kept = _own(R.best_bases(long, "__len", "__score", "id", share=0.9, key="group").drop("__len", "__score"))
    return {"out": kept, "disc": _own(_discarded(reads, kept))}


def filtlong_targeted(reads: DataFrame, gfa: DataFrame, **_) -> Frames:
    """The best reads with a hundred times the bases of the graph's segments."""
    from strandlake.operators import reads as R

    size = records.gfa_segments(gfa.select(F.col("group").alias("source"), "content")).groupBy(F.col("source").alias("group")).agg((F.sum(F.length("seq")) * 100).alias("__target"))
    x = _scored(reads).join(broadcast_if_small(size), "group")
    return {"out": _own(R.best_bases(x, "__len", "__score", "id", target=F.col("__target"), key="group").drop("__len", "__score", "__target"))}


def add_orfs_to_centroids(centroids: DataFrame, orfs: DataFrame, identity: DataFrame, **_) -> Frames:
    """Identity is one number for all samples; centroids are shared by them."""
    least = float(identity.select("value").first()["value"])
    given = centroids.select("id", "seq")
    hits = C.search(orfs.select("id", "seq"), given, least)
    assigned = C.assign(orfs.select("group", F.col("id").alias("orf")), hits, "orf")
    assigned = assigned.join(orfs.select(F.col("id").alias("orf_id"), F.col("group").alias("sample")).distinct(), "orf_id")
    return {"aug": C.augment(given, orfs.select("id", "seq"), assigned).withColumn("sample", F.lit("all")), "assign": assigned}


def diamond_linclust(orfs: DataFrame, **_) -> Frames:
    table = C.minhash_clusters(orfs, "id", "seq", k=5).withColumnRenamed("id", "member").withColumn("sample", F.lit("all"))
    return {"centroids": C.centroid_records(orfs.drop("group"), table), "table": table}


def scatter_ncbi_accession(dep: DataFrame, **_) -> Frames:
    x = records.items(records.lines(dep.select(F.col("sample").alias("source"), "content")), "source")
    return {"acc": x.select(F.concat_ws("/", "source", "item_no").alias("sample"), F.col("source").alias("parent"), F.col("item").alias("value"))}


def interleave(r1: DataFrame, r2: DataFrame, **_) -> Frames:
    """Reads need rec, their place in the file."""
    both = reads.interleave(r1.drop("sample"), r2.drop("sample"), ["group", "rec"])
    return {"out": _own(both.withColumn("rec", 2 * F.col("rec") + F.col("side") - 1).drop("side"))}


def dump_ncbi_sra(meta: DataFrame, dep: DataFrame, cache: DataFrame, **_) -> Frames:
    """Routes reads that were fetched before (cache, as reads) by what the metadata (length_class, parity) says."""
    x = cache.join(meta.select("group", S.read_route(F.col("length_class"), F.col("parity")).alias("__route")), "group")
    part = lambda route: _own(x.where(F.col("__route") == route).drop("__route"))
    return {"long": part("long_reads"), "short_pe": part("short_reads_pe"), "short_se": part("short_reads_se")}


def get_ncbi_assembly(dep: DataFrame, files: DataFrame | None = None, **_) -> Frames:
    """Dispatches files that were fetched before, (sample, path, content), by their names; every product must be there."""
    if files is None:
        raise NotImplementedError("assemblies come from the network; give their files as (sample, path, content)")
    x = tables.by_role(files)
    part = lambda role: x.where(F.col("role") == role).select("sample", "content")
    fasta = lambda role: records.fasta(part(role).withColumnRenamed("sample", "source")).select(F.col("source").alias("sample"), "id", "seq")
    return {"fna": fasta("assembly"), "faa": fasta("orfs"), "gff": part("gff"), "gbk": part("gbk")}


def antismash_gate(assembly: DataFrame, results: DataFrame | None = None, **_) -> Frames:
    """Assemblies without a contig of 1,000 bases get the substitute documents; results (sample, value) of the program are taken for the others."""
    gate = reports.length_gate(assembly, MIN_CONTIG, "group").withColumnRenamed("group", "sample")
    if results is None:
        if gate.where("ok").limit(1).count():
            raise NotImplementedError("long contigs need the program; give its documents as (sample, value)")
        results = gate.limit(0).select("sample", F.lit("").alias("value"))
    return {"json": reports.gated(results, gate, "sample", MIN_CONTIG), "gbk": gate.where("not ok").select("sample", F.array().cast("array<string>").alias("regions"))}


def prodigal(asm: DataFrame, **_) -> Frames:
    """Open frames on both strands, at least 30 residues; an approximation of gene finding."""
    x = asm.select(F.col("group").alias("sample"), F.col("id").alias("contig"), F.posexplode(sketches.six_frames(F.col("seq"), 30)).alias("n", "o"))
    x = x.select("sample", F.concat_ws("_", "contig", F.col("n") + 1).alias("id"), "contig", "o.strand", "o.frame", F.col("o.protein").alias("seq"))
    return {"cds": x.select("sample", "id", "seq"), "gff": x.drop("seq")}


def fastani(asm: DataFrame, **_) -> Frames:
    whole = asm.groupBy("group", "sample").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "seq"))), lambda z: z["seq"]), "N").alias("seq"))  # a genome's contigs
    return {"out": sketches.mash(whole, "sample", "seq", 16, "group").withColumnRenamed("group", "sample")}


def ppanggolin(gbk: DataFrame, **_) -> Frames:
    """Genomes are named by the strain in their header; families are clusters of the proteins that they list."""
    source = F.concat_ws("/", "group", "sample")
    heads = records.genbank_definition(gbk.select(source.alias("source"), "content"))
    names = heads.select("source", scalars.strain_name(F.col("definition"), F.col("source")).alias("genome"))
    cds = gbk.select("group", source.alias("source"), F.explode(F.regexp_extract_all("content", F.lit(r'/translation="([^"]+)"'), F.lit(1))).alias("seq"))
    cds = cds.withColumn("seq", F.regexp_replace("seq", r"\s", "")).join(names, "source")
    proteins = cds.select(F.sha2("seq", 256).alias("id"), "seq").distinct()
    family = C.minhash_clusters(proteins, "id", "seq", k=5).withColumnRenamed("centroid", "family")
    cells = cds.withColumn("id", F.sha2("seq", 256)).join(family, "id").groupBy("group", "family", "genome").agg(F.count("*").alias("n"))
    listed = names.select("source", F.concat_ws("\t", "genome", "source").alias("value"))
    return {"matrix": _own(cells), "pg": listed.select(F.split_part("source", F.lit("/"), F.lit(1)).alias("sample"), "value")}


def heatmap(matrix: DataFrame, persistent: float = 0.95, shell: float = 0.15, **_) -> Frames:
    """Plot-ready cells: families by class (shares of the genomes), genomes by the leaf order of their tree."""
    m = matrix.select("family", "genome", "n")
    total = m.select("genome").distinct().count()
    order = pangenome.row_order(pangenome.presence(m, max(1, round(persistent * total)), max(1, round(shell * total))), group="n_genomes", idx="family")
    pairs = pangenome.jaccard(m).select(F.lit("all").alias("grp"), F.col("g1").alias("a"), F.col("g2").alias("b"), "distance")
    nodes = clustering.dendrograms(pairs, m.select(F.lit("all").alias("grp"), F.col("genome").alias("label")).distinct(), "grp")
    leaves = nodes.where("is_leaf").select(F.col("label").alias("genome"), "leaf_pos")
    return {"heatmap": reports.heatmap_cells(m, order, leaves).withColumn("sample", F.lit("all"))}


def gtdbtk(asm: DataFrame, summaries: list[DataFrame] | None = None, **_) -> Frames:
    """Splits the summary tables of a batch, keyed by user_genome, into one row a genome; a genome without one is an error."""
    if not summaries:
        raise NotImplementedError("classification needs the program; give its summary tables")
    paths = asm.select("sample", F.concat(F.col("sample").cast("string"), F.lit(".fna")).alias("path")).distinct()
    return {"tax": tables.split_by_stem(tables.union_by_key(summaries, "user_genome"), paths, "user_genome").drop("path")}


FUNCTIONS = {
    "seqkit_reads": seqkit_reads, "assembly_stats": assembly_stats, "bbduk": bbduk, "filtlong": filtlong, "filtlong_targeted": filtlong_targeted,
    "add_orfs_to_centroids": add_orfs_to_centroids, "diamond_linclust": diamond_linclust, "scatter_ncbi_accession": scatter_ncbi_accession,
    "interleave_short_reads": interleave, "interleave_zipped_short_reads": interleave, "dump_ncbi_sra": dump_ncbi_sra, "get_ncbi_assembly": get_ncbi_assembly,
    "antismash": antismash_gate, "prodigal": prodigal, "fastani": fastani, "ppanggolin": ppanggolin, "heatmap": heatmap, "gtdbtk": gtdbtk,
}
