"""Readers of tables and reports: TSV, key-value files, block reports, JSON, matrices and globs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import scalars
from strandlake.sources.records import lines


def tsv(spark: SparkSession, path: str, schema: str | None = None, header: bool = False) -> DataFrame:
    """A tab-separated table, by position with a schema or by header."""
    reader = spark.read.option("sep", "\t").option("header", header).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def first_row(df: DataFrame) -> DataFrame:
    """One row with a map of column to text, from the first row of a table."""
    pairs = [x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return df.limit(1).select(F.create_map(*pairs).alias("row"))


def key_last(df: DataFrame, first: str, second: str, key: str) -> DataFrame:
    """One row with two maps from a table whose key is its last column."""
    pairs = lambda c: F.map_from_entries(F.collect_list(F.struct(key, c)))
    return df.agg(pairs(first).alias("first"), pairs(second).alias("second"))


def typed(m: Column) -> Column:
    """A map of texts as a map of (kind, text, number): what ``scalars.numeric_kind`` says of each value."""
    return F.transform_values(m, lambda k, v: F.struct(scalars.numeric_kind(v).alias("kind"), v.alias("text"), scalars.numeric_value(v).alias("number")))


def key_values(text: Column) -> Column:
    """A map from lines of key, tab, value."""
    return F.str_to_map(F.regexp_replace(text, "\n$", ""), F.lit("\n"), F.lit("\t"))


def blocks(content: DataFrame) -> DataFrame:
    """(source, block, header, rows) of a report of blocks: >>Name, #header, rows, >>END_MODULE."""
    x = lines(content)
    start = F.startswith("line", F.lit(">>")) & ~F.startswith("line", F.lit(">>END_MODULE"))
    w = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("no", F.sum(start.cast("int")).over(w)).where("no > 0 and line not like '>>END_MODULE%'")
    cells = F.split("line", "\t")
    name = F.max(F.when(F.startswith("line", F.lit(">>")), F.regexp_replace(F.get(cells, F.lit(0)), "^>>", "")))
    header = F.max_by(F.split(F.regexp_replace("line", "^#", ""), "\t"), F.when(F.startswith("line", F.lit("#")), F.col("pos")))
    body = F.collect_list(F.when(~F.col("line").rlike("^(>>|#)"), F.struct("pos", cells.alias("cells"))))
    x = x.groupBy("source", "no").agg(name.alias("block"), header.alias("header"), F.transform(F.array_sort(body), lambda z: z["cells"]).alias("rows"))
    return x.select("source", "no", "block", "header", "rows")


def grep_or(content: DataFrame, key: str, default: str) -> DataFrame:
    """(source, value): what follows the key in the first line that has it, trimmed and lower-cased, or the default."""
    found = lines(content).where(F.contains("line", F.lit(key))).groupBy("source").agg(F.min_by("line", "pos").alias("line"))
    return content.select("source").distinct().join(found, "source", "left").select("source", F.lower(F.coalesce(F.trim(F.substring_index("line", key, -1)), F.lit(default))).alias("value"))


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def copies(cell: Column) -> Column:
    """Number of genes in a matrix cell: quoted names apart by blanks; null is none."""
    return F.when(cell.isNull(), 0).otherwise(F.size(F.split(cell, ' "'))).cast("bigint")


def matrix(spark: SparkSession, path: str, left: int = 14) -> DataFrame:
    """(idx, family, class, genome, n) from a family matrix with ``left`` metadata columns, then one column a genome."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path).withColumn("idx", F.monotonically_increasing_id())
    genomes = raw.columns[left:-1]
    cells = F.explode(F.map_from_arrays(F.array(*(F.lit(g) for g in genomes)), F.array(*(F.col(f"`{g}`") for g in genomes)))).alias("genome", "cell")
    return raw.select("idx", F.col("Gene").alias("family"), F.col("`Non-unique Gene name`").alias("class"), cells).withColumn("n", copies(F.col("cell"))).drop("cell")


def split_by_stem(table: DataFrame, paths: DataFrame, key: str, path: str = "path") -> DataFrame:
    """Every input path with its row of a summary table whose key is the file's stem; a path without a row raises an error."""
    x = paths.withColumn("__stem", scalars.path_stem(F.col(path))).join(table.withColumn("__found", F.lit(True)), F.col("__stem") == F.col(key), "left")
    missing = F.raise_error(F.concat(F.lit("no row for "), F.col("__stem")))
    return x.withColumn(key, F.when(F.col("__found"), F.col(key)).otherwise(missing.cast("string"))).drop("__stem", "__found")


def by_role(paths: DataFrame, column: str = "path") -> DataFrame:
    """Adds role to rows with a path: gff, gbk, orfs, assembly (genomic FASTA that is not of coding sequences), or null."""
    name = F.regexp_extract(column, "([^/]+)$", 1)
    role = F.when(name == "genomic.gff", "gff").when(name == "genomic.gbff", "gbk").when(name == "protein.faa", "orfs")
    return paths.withColumn("role", role.when(name.endswith("genomic.fna") & ~name.startswith("cds"), "assembly"))


def union_by_key(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of several tables by their key; of equal keys the later table wins. Columns that a table lacks are null."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn("__order", F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc("__order"))
    return out.withColumn("__rank", F.row_number().over(last)).where("__rank = 1").drop("__order", "__rank")
