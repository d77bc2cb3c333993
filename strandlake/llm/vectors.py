"""Near-duplicate embeddings by sorted projection passes.

Each pass gives every vector a key of 64 random hyperplane signs, concatenated (of the vector less the label's mean, where that is long);
vectors are sorted by label and key, and each is compared with the next ``window`` in the order, by the Hamming distance of
sketches. Only keys are sorted and moved in a pass, not vectors. Every candidate of any pass is verified by cosine in
double precision, and links are united to components. A label that fits into one window needs one pass; for larger ones the number
of passes is measured on a sample of the label. With ``whole`` all pairs of a label are compared in blocks instead, which
misses nothing and takes work of the square of a label.

A cluster larger than a window is found through the links inside the windows; its links are then counted
exactly by comparing the members of the component with each other in blocks, of which none is
larger than two chunks. Equal vectors of a label are one class from the start and cost one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.graph import connected_components
from strandlake.llm.scratch import Scratch

_U = np.uint64
_BLOCK, _CHUNK, _WHOLE = 4096, 1024, 8192
_SAMPLE, _TRIALS, _PROBES = 2000, 48, 64


def passes_needed(rows: int, window: int, threshold: float, miss: float) -> int:
    """Passes after which a pair at the threshold has been in no window of ``rows`` vectors with a chance of ``miss``."""
    same = 1 - math.acos(threshold) / math.pi
    hit = same ** max(1.0, math.log2(max(2.0, rows / window)))
    return max(4, math.ceil(math.log(miss) / math.log(1 - min(hit, 0.999))))


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) for each dimension that occurs."""
    flat, off = np.asarray(column.flatten(), np.float64), np.asarray(column.offsets)
    off = off - off[0]
    size = np.diff(off)
    out = []
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        x = flat[off[at][:, None] + np.arange(d)]
        x = x / np.abs(x).max(1, keepdims=True)  # squares of extreme components neither vanish nor overflow
        out.append((at, x / np.linalg.norm(x, axis=1, keepdims=True)))
    return out


def _bits(x: np.ndarray, seed: int) -> np.ndarray:
    plane = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], 64))
    return np.packbits(x @ plane > 0, axis=1).view(">u8").astype(_U).ravel()


def _hits(x: np.ndarray, centre: np.ndarray, rows: int, window: int, threshold: float, seed: int) -> float:
    """The chance that a vector of a label of ``rows`` and one at the threshold from it meet in a pass, by the sample x.

    Where a window holds less than 8 vectors of the sample, the decay over the last two halvings is carried on.
    """
    rng = np.random.default_rng(seed)
    a = x[rng.permutation(len(x))[:_PROBES]]
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    b = threshold * a + math.sqrt(1 - threshold**2) * side
    far = []
    for k in range(_TRIALS):
        code = np.sort(_bits(x - centre, seed + 1 + k))
        far.append(np.abs(np.searchsorted(code, _bits(a - centre, seed + 1 + k)) - np.searchsorted(code, _bits(b - centre, seed + 1 + k))))
    far = np.concatenate(far)
    wide = window * len(x) / rows
    met = lambda w: max((far <= w).mean(), 1 / len(far))
    if wide >= 8:
        return met(wide)
    return met(8) * (met(8) / met(32)) ** (math.log2(8 / wide) / 2)


def _most(bits: int, threshold: float) -> int:
    """The Hamming distance of sketches that a pair at the threshold exceeds with five standard deviations only."""
    expect = bits * math.acos(threshold) / math.pi
    return math.ceil(expect + 5 * math.sqrt(expect * (1 - expect / bits)))


def _near(s: np.ndarray, t: np.ndarray, c: np.ndarray, e: np.ndarray, moved: np.ndarray | bool, threshold: float) -> np.ndarray:
    """Whether the sketches s and t, and the keys c and e unless they were moved, leave a pair at the threshold possible."""
    d = np.bitwise_count(s ^ t).astype(np.int16)
    return np.where(moved, d <= _most(64, threshold), d + np.bitwise_count(c ^ e) <= _most(128, threshold))


def _plan(window: int, threshold: float, miss: float, passes: int | None, seed: int):
    """(lab, centre, passes) of a label from a sample of its vectors."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n = table.column("n")[0].as_py()
        x = _matrix(table.column("v").chunk(0))[0][1]
        mean = x.mean(0)
        centre = mean if mean @ mean > 0.1 else None
        hit = _hits(x, 0 * mean if centre is None else centre, n, window, threshold, seed)
        p = passes or max(passes_needed(n, window, threshold, miss), math.ceil(math.log(miss) / math.log(1 - min(hit, 0.999))))
        return pa.table({"lab": table.column("lab").slice(0, 1), "centre": pa.array([centre], pa.list_(pa.float64())), "passes": pa.array([p], pa.int32())})

    return run


def _keys(classes: DataFrame, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, lab, passes = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 4))
            for at, x in _matrix(batch.column(2)):
                sketch = _bits(x, seed)
                for one in np.unique(lab[at]):
                    mine = np.flatnonzero(lab[at] == one)
                    rows = at[mine]
                    centre = batch.column(3)[int(rows[0])].as_py()
                    y = x[mine] if centre is None else x[mine] - np.array(centre)
                    for p in range(int(passes[rows[0]])):
                        code = _bits(y, seed + 1 + p)
                        cols = [pa.array(np.full(len(rows), p, np.int32)), pa.array(lab[rows]), pa.array(code.view(np.int64)), pa.array(sketch[mine].view(np.int64)), pa.array(node[rows]), pa.array(np.full(len(rows), centre is not None))]
                        yield pa.RecordBatch.from_arrays(cols, names=["pass", "lab", "code", "sketch", "node", "moved"])

    return classes.select("node", "lab", "v", "centre", "passes").mapInArrow(run, "pass int, lab bigint, code bigint, sketch bigint, node bigint, moved boolean")


def _compare(window: int, threshold: float):
    """Candidate pairs of a block: its rows and the first ``window`` rows of the next one.

    Keys of centred vectors say nothing on the cosine, so that there the sketch alone decides.
    """
    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("i")
        group, code, sketch, node = (t.column(c).to_numpy() for c in ("group", "code", "sketch", "node"))
        code, sketch = code.view(_U), sketch.view(_U)
        own, moved = (t.column(c).to_numpy(zero_copy_only=False) for c in ("own", "moved"))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, min(window, len(t) - 1) + 1):
            x, y = slice(None, -step), slice(step, None)
            close = _near(sketch[x], sketch[y], code[x], code[y], moved[x], threshold)
            hit = np.flatnonzero(close & (group[x] == group[y]) & own[x])
            a.append(hit)
            b.append(hit + step)
        x, y = node[np.concatenate(a)], node[np.concatenate(b)]
        return pa.table({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    return run


def _whole(threshold: float):
    """A forest of the links between two chunks of a label, each pair compared by cosine."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, lo, hi, side = (table.column(c).to_numpy() for c in ("node", "lo", "hi", "side"))
        x = _matrix(table.column("v").chunk(0))[0][1]
        a, b = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        comp = np.arange(len(x))
        out = []
        for k in range(0, len(a), 512):
            link = x[a[k : k + 512]] @ x[b].T >= threshold
            for r in np.flatnonzero(link.any(1)):
                i = a[k + r]
                near = b[link[r]]
                other, first = np.unique(comp[near], return_index=True)
                new = other != comp[i]
                if new.any():
                    out += [(node[i], node[j]) for j in near[first[new]]]
                    comp[np.isin(comp, other[new])] = comp[i]
        p = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": p.max(1), "b": p.min(1)})

    return run


def _verify(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (at, x), (_, y) in zip(_matrix(batch.column(2)), _matrix(batch.column(3)), strict=True):
                ok = at[np.einsum("ij,ij->i", x, y) >= threshold]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok))], names=["a", "b"])

    x = pairs.join(vectors.select(F.col("node").alias("a"), F.col("v").alias("x")), "a").join(vectors.select(F.col("node").alias("b"), F.col("v").alias("y")), "b")
    return x.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _count(threshold: float):
    """For each member of one chunk pair of a component: the vectors of the other chunk that it is linked with, copies counted."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, size, lo, hi, side = (table.column(c).to_numpy() for c in ("node", "size", "lo", "hi", "side"))
        x = _matrix(table.column("v").chunk(0))[0][1]
        a, b = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        link = x[a] @ x[b].T >= threshold
        if lo[0] == hi[0]:
            np.fill_diagonal(link, False)
            return pa.table({"node": node[a], "links": link @ size[b]})
        return pa.table({"node": np.concatenate([node[a], node[b]]), "links": np.concatenate([link @ size[b], link.T @ size[a]])})

    return run


def near_duplicates(
    rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    threshold: float = 0.93, window: int = 256, miss: float = 1e-4, passes: int | None = None, whole: bool = False, seed: int = 5,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Vectors are compared if their labels are equal and not null and their dimensions are equal. A vector that is null,
    empty, zero or has a null or non-finite component is linked with nothing. Equal vectors are linked. Ids may be
    null or repeat: each row counts as a vector; a component is named by its smallest id. Passes
    follow from the rows of a label and a sample of some 2,000 of its vectors, so that a pair at the threshold is in no window with a
    chance of ``miss``; ``whole`` compares all pairs of each label instead. Empty tables give no rows; other columns, of any name, are ignored.
    """
    scratch = Scratch(rows.sparkSession, "vectors")
    v = F.col(f"`{vector}`").cast("array<double>")
    ok = F.col(f"`{label}`").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    base = rows.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.when(ok, v).alias("v"), F.xxhash64(F.col(f"`{label}`"), F.size(v)).alias("lab"))
    base = base.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("lab", "v"))).withColumn("node2", F.xxhash64(F.lit(3), "v", "lab"))
    classes = base.where("v is not null").groupBy("node", "node2").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("lab").alias("lab"), F.first("v").alias("v"))
    classes = scratch.table(classes, "classes")
    sizes = classes.groupBy("lab").agg(F.count("*").alias("n"))
    fits = F.col("n") <= window + 1
    share = F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(1 << 32)) < F.lit(float(_SAMPLE << 32)) / F.col("n")
    some = classes.join(sizes.where(F.lit(not whole) & ~fits), "lab").where(share)
    plan = some.select("lab", "n", "v").groupBy("lab").applyInArrow(_plan(window, threshold, miss, passes, seed), "lab bigint, centre array<double>, passes int")
    plan = scratch.table(sizes.join(plan, "lab", "left").select("lab", "n", "centre", F.when(F.lit(not whole), F.coalesce("passes", F.lit(1))).alias("passes")), "plan")

    cut = plan.where("passes is null and n > 1").select("lab", F.expr(f"cast(ceil(n / {_WHOLE}) as int)").alias("chunks"))
    cells = classes.join(cut, "lab").withColumn("side", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = cells.select("lab", "node", "v", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    exact = cells.groupBy("lab", "lo", "hi").applyInArrow(_whole(threshold), "a bigint, b bigint")

    rest = classes.join(plan.where("passes is not null and n > 1").select("lab", "centre", "passes"), "lab")
    keys = _keys(rest, seed).repartitionByRange("pass", "lab", "code", "node").sortWithinPartitions("pass", "lab", "code", "node")
    keys = scratch.table(keys.withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    ahead = keys.groupBy(part.alias("part")).agg(F.count("*").alias("c"), F.min("at").alias("start"))
    ahead = ahead.select("part", F.expr("sum(c) over (order by part rows between unbounded preceding and current row) - c - start").alias("shift"))
    line = keys.withColumn("part", part).join(F.broadcast(ahead), "part").withColumn("i", F.col("at") + F.col("shift"))  # one row a partition
    line = line.select("code", "sketch", "node", "moved", "i", F.xxhash64("pass", "lab").alias("group"), F.expr(f"i div {_BLOCK}").alias("block"))
    again = (F.col("i") % _BLOCK < window) & (F.col("block") > 0)
    line = line.withColumn("own", F.explode(F.when(again, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    line = line.withColumn("block", F.col("block") - F.when(F.col("own"), 0).otherwise(1))
    pairs = line.groupBy("block").applyInArrow(_compare(window, threshold), "a bigint, b bigint").distinct()
    pairs = scratch.table(pairs, "pairs")
    links = scratch.table(_verify(pairs, classes, threshold).union(exact), "links")
    comp = scratch.table(connected_components(scratch, links), "components")

    chunks = comp.groupBy("component").agg(F.expr(f"cast(ceil(count(*) / {_CHUNK}) as int)").alias("chunks"))
    member = comp.join(chunks, "component").withColumn("side", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    member = member.join(classes.select("node", "size", "v"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    member = member.select("component", "node", "size", "v", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    counted = member.groupBy("component", "lo", "hi").applyInArrow(_count(threshold), "node bigint, links bigint").groupBy("node").agg(F.sum("links").alias("links"))

    group = classes.select("node", "node2", "rep", "size").join(comp, "node", "left").join(counted, "node", "left")
    group = group.withColumn("component", F.coalesce("component", "node"))
    name = group.groupBy("component").agg(F.min("rep").alias("component_id"))
    group = group.join(name, "component").select("node", "node2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    group = scratch.table(group, "named")
    out = base.select("id", "node", "node2").join(group, ["node", "node2"], "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
