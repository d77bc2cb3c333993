"""Classes of gene families by a mixture of Bernoulli distributions over the genomes that have them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake import workspace

_TINY = 1e-6


def posterior(present: np.ndarray, share: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The probability of each class for rows of presence: share is one row of genomes a class."""
    log = present @ np.log(share / (1 - share)).T + np.log(1 - share).sum(1) + np.log(weight)
    p = np.exp(log - log.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def start(genomes: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares from 0.95 in the first class down to 0.05 in the last, in equal weights."""
    return np.repeat(np.linspace(0.95, 0.05, classes)[:, None], genomes, 1), np.full(classes, 1 / classes)


def partition(presence: DataFrame, *, names: tuple[str, ...] = ("persistent", "shell", "cloud"), rounds: int = 40) -> DataFrame:
    """(family, class, p): the likeliest class of each family of presence (family, genome), and the probabilities of all classes in order.

    Expectation-maximisation: a class has a share for each genome, the chance that a family of the class is in it. Families with the same genomes are one
    pattern, so a round reads patterns, not families; tasks add up what they expect, and the driver sees classes * genomes sums. The class with the
    largest mean share takes the first name, and so on. Repeated rows count once; null families and genomes are left out.
    """
    spark = presence.sparkSession
    rows = presence.where("family is not null and genome is not null").select("family", "genome").distinct()
    listed = sorted(r[0] for r in rows.select("genome").distinct().collect())  # the genomes of one pangenome
    number = {g: i for i, g in enumerate(listed)}
    kind = presence.schema["genome"].dataType
    places = spark.createDataFrame(list(number.items()), f"genome {kind.simpleString()}, i int") if listed else spark.createDataFrame([], f"genome {kind.simpleString()}, i int")
    family = workspace.table(rows.join(F.broadcast(places), "genome").groupBy("family").agg(F.array_sort(F.collect_list("i")).alias("at")), "families")
    patterns = workspace.table(family.groupBy("at").agg(F.count("*").alias("n")), "patterns")
    share, weight = start(len(listed), len(names))

    def dense(column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), len(listed)))
        out[np.repeat(np.arange(len(column)), np.diff(np.asarray(column.offsets))), np.asarray(column.flatten())] = 1
        return out

    for _ in range(rounds if listed else 0):

        def run(batches: Iterator[pa.RecordBatch], share: np.ndarray = share, weight: np.ndarray = weight) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(weight), len(listed) + 1))
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    x = dense(part.column(0).combine_chunks() if hasattr(part.column(0), "combine_chunks") else part.column(0))
                    r = posterior(x, share, weight) * part.column(1).to_numpy()[:, None]
                    total += np.column_stack([r.T @ x, r.sum(0)])
            k, g = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(g.ravel()), pa.array(total.ravel())], names=["k", "g", "x"])

        total = np.zeros((len(names), len(listed) + 1))
        for r in patterns.mapInArrow(run, "k bigint, g bigint, x double").groupBy("k", "g").agg(F.sum("x").alias("x")).collect():
            total[r["k"], r["g"]] = r["x"]
        share = np.clip(total[:, :-1] / np.maximum(total[:, -1:], 1e-12), _TINY, 1 - _TINY)
        weight = np.maximum(total[:, -1] / total[:, -1].sum(), 1e-12)
    order = np.argsort(-share.mean(1), kind="stable") if listed else np.arange(len(names))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = posterior(dense(batch.column(1)), share[order], weight[order])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * len(names), pa.int32()), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([names[i] for i in p.argmax(1)], pa.string()), lists], names=["family", "class", "p"])

    return family.select("family", "at").mapInArrow(named, f"family {presence.schema['family'].dataType.simpleString()}, class string, p array<double>")
