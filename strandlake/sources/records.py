"""Readers of record files: FASTA, FASTQ, GFA, GenBank headers and line lists.

Each reader takes (source, content) rows, as ``files`` reads them, and returns rows in which pos or
rec gives the place in the file, as a DataFrame has no order of its own. A file is split inside its row, so one
file is the unit of work and at most 2 GB; for larger FASTA files there is ``fasta_parts``, which splits them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str) -> DataFrame:
    """(source, content) of whole text files; gzip by suffix."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))


def fasta_parts(spark: SparkSession, path: str) -> DataFrame:
    """(source, id, header, seq) of FASTA files of any size: Spark splits them at record starts, so that a record, not a file, must fit a task.

    A file must begin with a header: what stands before the first one counts as a record. Line ends may be of either kind. Compressed
    files are not split.
    """
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("source"), "value")
    text = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")  # only a file's first record has its mark
    x = rows.select("source", text.alias("text")).withColumn("header", F.substring_index("text", "\n", 1))
    return x.select("source", F.regexp_extract("header", r"^\s*(\S*)", 1).alias("id"), "header", F.replace(F.expr("substring(text, length(header) + 2)"), F.lit("\n"), F.lit("")).alias("seq"))


def lines(content: DataFrame) -> DataFrame:
    """(source, pos, line) without line ends; a last line without an end counts."""
    split = F.split(F.regexp_replace("content", "\r?\n$", ""), "\r?\n")
    return content.where(F.col("content") != "").select("source", F.posexplode(split).alias("pos", "line"))


def records(rows: DataFrame, *key: str) -> DataFrame:
    """Adds rec, the number of the FASTA record of each line of (key..., pos, line); lines before the first header have 0."""
    w = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("rec", F.sum(F.startswith("line", F.lit(">")).cast("bigint")).over(w))


def fasta(content: DataFrame) -> DataFrame:
    """(source, rec, id, header, seq, seq_lines): id is the first word of the header; lines are kept so that a copy is exact."""
    x = records(lines(content), "source").where("rec > 0")
    head = F.startswith("line", F.lit(">"))
    rest = F.transform(F.array_sort(F.collect_list(F.when(~head, F.struct("pos", "line")))), lambda z: z["line"])
    out = x.groupBy("source", "rec").agg(F.max(F.when(head, F.substring("line", 2, 1 << 30))).alias("header"), rest.alias("seq_lines"))
    return out.select("source", "rec", F.regexp_extract("header", r"^\s*(\S*)", 1).alias("id"), "header", F.array_join("seq_lines", "").alias("seq"), "seq_lines")


def lengths(rows: DataFrame, *key: str) -> DataFrame:
    """(key..., id, length) of each record of lines: id ends at the first blank, length is without line ends; records with equal ids add up to the last."""
    x = records(rows, *key).where("rec > 0")
    head = F.startswith("line", F.lit(">"))
    x = x.groupBy(*key, "rec").agg(F.max(F.when(head, F.substring_index(F.substring("line", 2, 1 << 30), " ", 1))).alias("id"), F.sum(F.when(head, 0).otherwise(F.length("line"))).cast("bigint").alias("length"))
    return x.groupBy(*key, "id").agg(F.max_by("length", "rec").alias("length"))


def any_longer(rows: DataFrame, least: int, *key: str) -> DataFrame:
    """(key..., any_long): whether any record of the lines of a key reaches the length; lines without a key are one file."""
    x = records(rows, *key).where("rec > 0").groupBy(*key, "rec").agg(F.sum(F.when(F.startswith("line", F.lit(">")), 0).otherwise(F.length("line"))).alias("n"))
    return x.groupBy(*key).agg(F.coalesce(F.bool_or(F.col("n") >= least), F.lit(False)).alias("any_long"))


def fastq(content: DataFrame) -> DataFrame:
    """(source, rec, id, seq, qual) from four lines a record."""
    x = lines(content).withColumn("rec", F.floor(F.col("pos") / 4))
    at = lambda k: F.max(F.when(F.col("pos") % 4 == k, F.col("line")))
    x = x.groupBy("source", "rec").agg(at(0).alias("head"), at(1).alias("seq"), at(3).alias("qual"))
    return x.where("qual is not null").select("source", "rec", F.regexp_extract("head", r"^@(\S*)", 1).alias("id"), "seq", "qual")


def gfa_segments(content: DataFrame) -> DataFrame:
    """(source, pos, name, seq) of lines that begin with S."""
    cells = F.split("line", "\t")
    return lines(content).where(F.startswith("line", F.lit("S"))).select("source", "pos", F.get(cells, F.lit(1)).alias("name"), F.get(cells, F.lit(2)).alias("seq"))


def gfa_to_fasta(segments: DataFrame) -> DataFrame:
    """(source, pos, value): FASTA text of segments."""
    return segments.select("source", "pos", F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value"))


def genbank_definition(content: DataFrame, head: int = 16) -> DataFrame:
    """(source, definition): the first DEFINITION line among the first lines, null if there is none."""
    x = lines(content).where((F.col("pos") < head) & F.contains("line", F.lit("DEFINITION")))
    x = x.groupBy("source").agg(F.min_by("line", "pos").alias("definition"))
    return content.select("source").distinct().join(x, "source", "left")


def first_line(content: DataFrame) -> DataFrame:
    return content.select("source", F.trim(F.regexp_extract("content", r"\A([^\r\n]*)", 1)).alias("value"))


def items(rows: DataFrame, *key: str) -> DataFrame:
    """Scatter: one output row for each line, numbered in order; nothing is filtered."""
    return rows.select(*key, F.col("pos").alias("item_no"), F.col("line").alias("item"))
