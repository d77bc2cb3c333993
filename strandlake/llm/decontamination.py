"""Benchmark decontamination by size-partitioned MinHash containment search; DataFrame functions only.

Benchmark items are short and documents long, so a MinHash of the document says nothing
about an item in it. As in containment MinHash (Koslicki and Zabeti, 2019), only the item is
sampled: of its shingles the ``k`` with the smallest hashes, a bottom-k MinHash, are looked for in the whole
document. Items are partitioned by size into powers of two; each partition has its own k and
its own least number of hits, the largest with which an item at the threshold is missed with
probability ``miss`` at most (hypergeometric tail). Every candidate is verified against all shingles
of the item.

Finding a shingle in a document costs one hash probe per word: each shingle is filed under its
longest word, and only where that word occurs is the shingle compared. The probes are broadcast if they take
``max_broadcast`` bytes at most; beyond that, shingles of documents are joined by shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.columns import words
from strandlake.llm.scratch import Scratch


def hits_needed(q: int, k: int, threshold: float, miss: float) -> int:
    """Most hits among k sampled of q shingles that a document with ceil(threshold * q) of them has, but for a chance of ``miss``."""
    have = math.ceil(threshold * q - 1e-9)
    below, need = 0.0, 1
    for hits in range(k + 1):
        if hits > have or k - hits > q - have:
            continue
        below += math.comb(have, hits) * math.comb(q - have, k - hits) / math.comb(q, k)
        if below > miss:
            break
        need = hits + 1
    return max(1, need)


def _shingles(ws: Column, width: int) -> Column:
    """Array of (start, shingle): all runs of ``width`` words; fewer words are one shingle, none give none."""
    n = F.size(ws)
    one = F.array(F.struct(F.lit(1).alias("start"), ws.alias("sh")))
    none = F.array().cast("array<struct<start:int,sh:array<string>>>")
    many = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.struct(i.alias("start"), F.slice(ws, i, width).alias("sh")))
    return F.when(n == 0, none).when(n <= width, one).otherwise(many)


def item_shingles(items: DataFrame, item: str, text: str, width: int) -> DataFrame:
    """(item, sh, len, word, off, n_item): distinct shingles with the longest word (the first such) as the one to file under."""
    x = items.select(F.col(f"`{item}`").alias("item"), words(F.col(f"`{text}`")).alias("ws"))
    x = x.select("item", F.explode(_shingles(F.col("ws"), width)).alias("x")).select("item", F.col("x.sh").alias("ws"))
    longest = F.array_max(F.transform("ws", F.length))
    x = x.withColumn("off", F.array_position(F.transform("ws", lambda w: F.length(w) == longest), F.lit(True)) - 1)
    x = x.select("item", F.array_join("ws", " ").alias("sh"), F.size("ws").alias("len"), F.get("ws", F.col("off").cast("int")).alias("word"), F.col("off").cast("int").alias("off")).distinct()
    return x.withColumn("n_item", F.count("*").over(Window.partitionBy("item")))


def _found(docs: DataFrame, probes: DataFrame, width: int, broadcast: bool) -> DataFrame:
    """(d, item, sh) for each probe's shingle that occurs in document d; docs has d and t (the text)."""
    ws = docs.select("d", words(F.col("t")).alias("ws"))
    if broadcast:
        at = ws.select("d", "ws", F.posexplode("ws").alias("pos", "word")).join(F.broadcast(probes), "word")
        same = (F.col("pos") >= F.col("off")) & (F.array_join(F.slice("ws", F.greatest(F.col("pos") - F.col("off"), F.lit(0)) + 1, F.col("len")), " ") == F.col("sh"))
        at = at.where(same & ((F.col("len") == width) | (F.size("ws") == F.col("len"))))
        return at.select("d", "item", "sh")
    at = ws.select("d", F.explode(_shingles(F.col("ws"), width)).alias("x")).select("d", F.array_join("x.sh", " ").alias("sh"))
    return at.join(probes.select("item", "sh"), "sh").select("d", "item", "sh")


def contained(
    docs: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    width: int = 5, threshold: float = 0.8, sample: int = 24, miss: float = 1e-9, max_broadcast: int = 64 << 20,
) -> DataFrame:
    """Pairs (doc, item, n_item, n_shared, containment) with at least ``threshold`` of the item's distinct shingles in the document.

    Words are lower-cased runs of non-space. An item with fewer than ``width`` words is one shingle
    of all its words and is contained only in a document of exactly those words; items and
    documents without words or with a null text match nothing. Rows with a null doc or item id are
    matched like others and give a null there. Rows with the same id count as one document (or item) with all
    their shingles. Empty tables give no rows; further columns, of any name, are ignored.
    """
    scratch = Scratch(docs.sparkSession, "contain")
    sh = scratch.table(item_shingles(items, item, item_text, width), "items")
    # size partitions: items of 2^p to 2^(p+1)-1 shingles; k and the hits needed hold for the whole partition
    sizes = [r["p"] for r in sh.select(F.floor(F.log2("n_item")).alias("p")).distinct().collect()]  # at most 64
    k, need = {}, {}
    for p in sizes:
        lo, hi = 2**p, 2 ** (p + 1) - 1
        k[p] = min(sample, hi)
        need[p] = min((hits_needed(q, min(k[p], q), threshold, miss) for q in {lo, *range(lo, hi, max(1, (hi - lo) // 64)), hi}), default=1)
    part = F.floor(F.log2("n_item")).cast("int")
    pick = lambda d: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in d.items() for x in kv)), part), F.lit(1)) if d else F.lit(1)
    by_hash = Window.partitionBy("item").orderBy(F.xxhash64(F.lit(7), "sh"), "sh")
    sampled = sh.withColumn("rank", F.row_number().over(by_hash)).withColumn("need", pick(need)).where(F.col("rank") <= pick(k))
    n = sh.agg(F.sum(F.octet_length("sh") + F.octet_length("word") + 64)).first()[0] or 0  # bytes of the probes as rows
    base = docs.select(F.col(f"`{doc}`").alias("d"), F.col(f"`{text}`").alias("t"))
    hits = _found(base, sampled.drop("rank", "need", "n_item"), width, n <= max_broadcast).distinct()
    hits = hits.join(sampled.select(F.col("item").alias("i2"), F.col("sh").alias("sh2"), "need"), (F.col("item").eqNullSafe(F.col("i2"))) & (F.col("sh") == F.col("sh2")))
    pairs = hits.groupBy("d", "item").agg(F.count("*").alias("hits"), F.first("need").alias("need")).where("hits >= need")
    pairs = scratch.table(pairs.select("d", "item"), "candidates")

    few = pairs.count() * 64 <= max_broadcast
    ids = pairs.select(F.col("d").alias("d2")).distinct()
    chosen = base.join(F.broadcast(ids) if few else ids, F.col("d").eqNullSafe(F.col("d2")), "left_semi")
    full = _found(chosen, sh.drop("n_item"), width, n <= max_broadcast).distinct().groupBy("d", "item").agg(F.count("*").alias("n_shared"))
    size = sh.select(F.col("item").alias("i2"), "n_item").distinct()
    full = full.join(F.broadcast(size) if n <= max_broadcast else size, F.col("item").eqNullSafe(F.col("i2")))
    cand = pairs.select(F.col("d").alias("d2"), F.col("item").alias("i3"))
    full = full.join(cand, F.col("d").eqNullSafe(F.col("d2")) & F.col("item").eqNullSafe(F.col("i3")), "left_semi")
    full = full.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item") - 1e-9)
    return full.select(F.col("d").alias(doc), F.col("item").alias(item), "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, *, few: int = 500_000, **how) -> DataFrame:
    """docs without the rows that contain an item by ``contained``; each row is decided by its own text, whatever its id."""
    scratch = Scratch(docs.sparkSession, "clean")
    rows, at = scratch.numbered(docs)
    bad = scratch.table(contained(rows, items, doc=at, **how).select(F.col(f"`{at}`").alias("__bad")).distinct(), "bad")
    bad = F.broadcast(bad) if bad.count() <= few else bad
    return rows.join(bad, F.col(f"`{at}`") == F.col("__bad"), "left_anti").drop(at)
