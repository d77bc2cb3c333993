"""Writers: TSV, JSON, FASTA, one output for each item, key-value store, manifests and SVG."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake import workspace

#: Rows of a sorted file.
_ROWS = 1 << 20


def write_tsv(df: DataFrame, path: str, header: bool = True, gzip: bool = False) -> None:
    df.write.mode("overwrite").option("compression", "gzip" if gzip else "none").csv(path, sep="\t", header=header)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row, nulls included."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def fasta_text(records: DataFrame, *order: str) -> DataFrame:
    """(value) in the order given: header and the lines as read."""
    return records.orderBy(*order).select(F.concat(F.lit(">"), "header", F.when(F.size("seq_lines") > 0, F.concat(F.lit("\n"), F.array_join("seq_lines", "\n"))).otherwise("")).alias("value"))


def write_fasta(records: DataFrame, path: str, *order: str, gzip: bool = False) -> None:
    fasta_text(records, *order).write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)


def write_by(df: DataFrame, path: str, *keys: str) -> None:
    """One folder for each value of the keys (scatter, or the split of a batch's result)."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_sorted(alignments: DataFrame, path: str) -> None:
    """Alignments by contig and place; the statistics of the files stand for an index. Files follow the rows, so that a task sorts some 2^20 of them; rows of one place may fill several files."""
    files = max(1, -(-alignments.count() // _ROWS))
    spread = F.xxhash64(*(c for c, kind in alignments.dtypes if "map<" not in kind and kind != "variant"))  # deals the rows of one place
    alignments.repartitionByRange(files, "contig", "start", spread).sortWithinPartitions("contig", "start").write.mode("overwrite").parquet(path)


def overlapping(sorted_rows: DataFrame, file: str = "file") -> DataFrame:
    """(file): files of sorted rows (file, contig, start) whose range overlaps that of a later file; one row a file at most, for a broadcast."""
    ends = sorted_rows.groupBy(file, "contig").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))  # numbers, which aggregate without a sort of the rows
    ends = ends.groupBy(file).agg(F.min(F.struct("contig", F.col("lo").alias("start"))).alias("lo"), F.max(F.struct("contig", F.col("hi").alias("start"))).alias("hi"))
    ends = workspace.table(ends, "ends")
    a, b = ends.alias("a"), F.broadcast(ends).alias("b")
    return a.join(b, (F.col(f"a.{file}") < F.col(f"b.{file}")) & (F.col("a.lo") < F.col("b.hi")) & (F.col("b.lo") < F.col("a.hi"))).select(F.col(f"a.{file}")).distinct()


def write_many(df: DataFrame, outputs: Mapping[str, DataFrame]) -> None:
    """Several products of one scan, which is kept meanwhile."""
    df.persist()
    try:
        for path, part in outputs.items():
            part.write.mode("overwrite").parquet(path)
    finally:
        df.unpersist()


def write_once(df: DataFrame, path: str) -> None:
    """Does nothing where the output exists already."""
    df.write.mode("ignore").parquet(path)


def manifest_lines(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.concat_ws("\t", *columns).alias("value"))


def tar_of(parts: Mapping[str, bytes]) -> bytes:
    """A tar.gz of a few named files; an empty archive for none."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, data in sorted(parts.items()):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def svg(shapes: DataFrame, width: int = 800, height: int = 800) -> str:
    """A drawing of (z, path, fill) rows, lower z first; for figures, not for data."""
    body = "".join(f'<path d="{r["path"]}" fill="{r["fill"]}"/>' for r in shapes.orderBy("z").select("path", "fill").toLocalIterator())
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="-0.5 -0.5 1 1"><g transform="scale(1,-1)">{body}</g></svg>'
