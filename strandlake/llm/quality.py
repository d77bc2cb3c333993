"""Quality of texts by Naive Bayes support vectors (Wang and Manning, 2012).

A text is the set of its n-grams: runs of one, two and three bytes as they stand, words and pairs of words, and two marks for
a word that repeats the one before it, or the two before it. Each indicator is scaled by its log-count ratio, log of its share among
the n-grams of class 1 over that among class 0 (counts plus one), each text is brought to length one, and a linear
model with hinge loss is fitted by dual coordinate descent. A logistic curve, fitted on labelled rows that the model has not seen, turns
margins into probabilities.

Longer n-grams and words are hashed, so a model has a fixed size, _D numbers. Labelled texts become rows of feature numbers where
they are, then slabs of a bounded number of them. Slabs descend on their own part of the dual at the same
time and their changes are added, with steps held back by the number of slabs (CoCoA+, Ma et al., 2015); one slab is plain dual
coordinate descent. Sums of counts and weights are made on the executors; the driver sees vectors of _D numbers only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm import kernels
from strandlake.llm.columns import seeded
from strandlake.llm.language import remainder
from strandlake.llm.lm import _pack, _unpack
from strandlake.llm.scratch import Scratch

_U = np.uint64
_BITS = 17
_AGAIN, _TWO = 256, 258
_THREE = _TWO + (1 << 16)
_WORD = _THREE + (1 << _BITS)
_PAIR = _WORD + (1 << _BITS)
_D = _PAIR + (1 << _BITS)
_CHUNK = 1 << 14
_PIECE = 1 << 20
_SLAB = 8 << 20  # features
_BINS, _WIDE = 64, 40


class Features:
    """The distinct features of texts; a table of marks keeps memory the same however long a text is."""

    def __init__(self) -> None:
        self.mark = np.zeros(_D, bool)

    def _note(self, b: np.ndarray, tok: np.ndarray) -> None:
        m = self.mark
        m[b] = True
        if len(b) > 1:
            m[_TWO + ((b[:-1].astype(np.int32) << 8) | b[1:])] = True
        if len(b) > 2:
            x = b.astype(np.uint32)
            m[_THREE + (((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS))] = True
        m[_WORD + (tok >> _U(64 - _BITS)).astype(np.int64)] = True
        if len(tok) > 1:
            m[_PAIR + (kernels.mix64(tok[:-1] * _U(0xBB67AE8584CAA73B) + tok[1:]) >> _U(64 - _BITS)).astype(np.int64)] = True
            same = tok[1:] == tok[:-1]
            if same.any():
                m[_AGAIN] = True
                m[_AGAIN + 1] |= bool((same[1:] & same[:-1]).any())

    def _marked(self) -> np.ndarray:
        out = np.flatnonzero(self.mark)
        self.mark[out] = False
        return out

    def long(self, b: np.ndarray) -> np.ndarray:
        """Of one text, in overlapping parts that are cut behind white space where there is some."""
        at, before = 0, np.zeros(0, _U)
        while at < len(b):
            end = min(len(b), at + _PIECE)
            if end < len(b):
                space = np.flatnonzero(kernels._SPACE[b[at:end]])
                while not len(space) and end < len(b):  # a word longer than a part
                    space, end = np.flatnonzero(kernels._SPACE[b[end : end + _PIECE]]) + (end - at), min(len(b), end + _PIECE)
                end = at + int(space[-1]) + 1 if len(space) else len(b)
            tok = np.concatenate([before, kernels.tokens(b[at:end], np.array([0, end - at]))[0]])
            self._note(b[max(0, at - 2) : end], tok)
            at, before = end, tok[-2:]
        return self._marked()

    def of(self, data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
        """In order, of each text."""
        for i, j in kernels.pieces(off, _PIECE):
            if off[j] - off[i] > _PIECE:
                yield self.long(data[off[i] : off[j]])
                continue
            tok, at = kernels.tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
            for k in range(j - i):
                self._note(data[off[i + k] : off[i + k + 1]], tok[at[k] : at[k + 1]])
                yield self._marked()


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    slope: float
    offset: float

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return self.ratio * self.weight, self.ratio * self.ratio

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -60, 60)))


def margin(tables: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> float:
    """Of a text with the features ``at``; 0 where none of them tells the classes apart."""
    size = tables[1][at].sum()
    return float(tables[0][at].sum() / np.sqrt(size)) if size > 0 else 0.0


def descend(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: np.ndarray, w: np.ndarray, alpha: np.ndarray, epochs: int, hold: float, seed: object) -> tuple[np.ndarray, np.ndarray]:
    """Dual coordinate descent for the hinge loss (Hsieh et al., 2008): the new alpha and what it adds to w. x holds (features, values) of length one or none."""
    rng = np.random.default_rng(seed)
    v, alpha = w.copy(), alpha.copy()
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            at, val = x[i]
            if not len(at):
                continue
            new = min(max(alpha[i] - (y[i] * float(v[at] @ val) - 1) / hold, 0.0), c[i])
            if new != alpha[i]:
                v[at] += hold * (new - alpha[i]) * y[i] * val
                alpha[i] = new
    return alpha, (v - w) / hold


def _vectors(df: DataFrame) -> np.ndarray:
    """The sum of the vectors in rows (slab, c, x): each chunk c in a task, in the order of slabs, so that reruns agree."""

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["slab"])
        return pa.table({"c": pa.array([rows[0]["c"]], pa.int32()), "x": pa.array([sum(_unpack(r["x"], np.float32).astype(np.float64) for r in rows).tobytes()], pa.binary())})

    got = sorted(df.groupBy("c").applyInArrow(add, "c int, x binary").collect())  # a vector of _D numbers
    return np.concatenate([np.frombuffer(r["x"], np.float64) for r in got]) if got else np.zeros(0)


def _chunked(slab: int, x: np.ndarray) -> list[dict]:
    return [{"slab": slab, "c": i, "x": _pack(x[at : at + _CHUNK].astype(np.float32))} for i, at in enumerate(range(0, len(x), _CHUNK))]


def _slab_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict], bytes | None]]:
    for batch in batches:
        for i in range(batch.num_rows):
            alpha = batch.column("alpha")[i].as_py() if "alpha" in batch.schema.names else None
            yield batch.column("slab")[i].as_py(), batch.column("docs")[i].as_py(), alpha


_PART = pa.schema([("slab", pa.int64()), ("c", pa.int32()), ("x", pa.binary())])


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many learning texts of class 0 and of class 1 have each feature, and how many texts of each class there are."""
    for slab, docs, _ in _slab_rows(batches):
        n = np.zeros((2, _D + 1))
        for d in docs:
            if not d["tune"]:
                n[d["y"], np.cumsum(_unpack(d["x"], np.uint32))] += 1
                n[d["y"], _D] += 1
        yield _batch(_chunked(slab, n.ravel()), _PART)


def log_count_ratio(n: np.ndarray) -> np.ndarray:
    """From the counts of class 0 and class 1: the log of the smoothed shares' ratio; 0 for features that no text has."""
    p = (n + 1) / (n + 1).sum(1, keepdims=True)
    return np.where(n.sum(0) > 0, np.log(p[1] / p[0]), 0.0)


def logistic(m: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make n texts each of margin m and class y likeliest, with Platt's smoothed targets; Newton steps halved until they help."""
    n1, n0 = float(n[y == 1].sum()), float(n[y == 0].sum())
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    loss = lambda a, b: float((n * (np.logaddexp(0, a * m + b) - t * (a * m + b))).sum())
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -60, 60)))
        g = np.array([(n * (p - t) * m).sum(), (n * (p - t)).sum()])
        h = n * p * (1 - p)
        hess = np.array([[(h * m * m).sum(), (h * m).sum()], [(h * m).sum(), h.sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, g)
        scale = 1.0
        while scale > 1e-6 and loss(a - scale * step[0], b - scale * step[1]) > loss(a, b):
            scale /= 2
        a, b = a - scale * step[0], b - scale * step[1]
        if abs(scale * step).max() < 1e-9:
            break
    return max(a, 0.0), b


def _sample(labels: DataFrame, key: str, label: str, folds: int, held: int, per_class: int, seed: int) -> DataFrame:
    """(k, y, tune): at most ``per_class`` labelled ids of each class, those with the smallest hashes; an eighth of them tunes the curve."""
    rows = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y"))
    rows = rows.where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & (remainder(F.col("k"), folds) != held)).distinct()
    parts = [rows.where(F.col("y") == y).orderBy(seeded(seed, F.col("k")), "k").limit(per_class) for y in (0, 1)]
    return parts[0].union(parts[1]).withColumn("tune", F.floor(remainder(F.col("k"), 8 * folds) / folds) == 0)


def fit(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held: int = 0,
    per_class: int = 20_000, cost: float = 1.0, rounds: int = 8, epochs: int = 2, seed: int = 12,
) -> Model:
    """A model from at most ``per_class`` labelled ids of each class, whose crc32(id as text) mod ``folds`` is not ``held``.

    Labels other than 0 and 1, null ids and ids without a document teach nothing; an id with both labels teaches both; of rows with one id one teaches. Null texts
    are empty. A class weighs as much as the other, whatever their numbers. With no labels every score is 0.5, with
    one class all scores are alike. Whole texts are read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    some = scratch.table(_sample(labels, key, label, folds, held, per_class, seed), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [f.astype(np.uint32) for f in features.of(*kernels.utf8(batch.column(3)))]
            x = [_pack(np.diff(f, prepend=np.uint32(0))) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([len(f) for f in found], pa.int64()), pa.array(x, pa.binary())], names=["k", "y", "tune", "n", "x"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(F.broadcast(some.withColumn("k", F.col("k").cast(kind))), "k")  # 2 * per_class ids
    rows = rows.select("k", "y", "tune", "t").mapInArrow(run, f"k {kind}, y int, tune boolean, n bigint, x binary")
    rows = scratch.table(rows.groupBy("k", "y", "tune").agg(F.min(F.struct("n", "x")).alias("d")), "features")
    total = rows.agg(F.sum("d.n")).first()[0] or 0
    slabs = -(-total // _SLAB) or 1
    docs_of = rows.select(F.pmod(F.xxhash64("k"), F.lit(slabs)).alias("slab"), F.struct("k", "y", "tune", F.col("d.x").alias("x")).alias("doc"))
    table = scratch.table(docs_of.groupBy("slab").agg(F.array_sort(F.collect_list("doc")).alias("docs")), "slabs")  # _SLAB features each
    scratch.drop(rows)
    n = _vectors(table.mapInArrow(_counts, "slab bigint, c int, x binary"))
    n = n.reshape(2, _D + 1) if len(n) else np.zeros((2, _D + 1))
    ratio, many = log_count_ratio(n[:, :_D]), n[:, _D]
    weight = np.zeros(_D)
    if many.min() > 0:
        c = cost * many.sum() / (2 * many)
        alphas, last = table.select("slab", F.lit(None).cast("binary").alias("alpha")), None
        for r in range(rounds):
            shared = spark.sparkContext.broadcast((ratio, weight, c))  # twice _D numbers

            def step(batches: Iterator[pa.RecordBatch], shared=shared, r: int = r) -> Iterator[pa.RecordBatch]:
                ratio, w, c = shared.value
                for slab, docs, before in _slab_rows(batches):
                    docs = [d for d in docs if not d["tune"]]
                    x = []
                    for d in docs:
                        at = np.cumsum(_unpack(d["x"], np.uint32)).astype(np.int32)
                        val = ratio[at]
                        size = np.sqrt(val @ val)
                        x.append((at, (val / size).astype(np.float32)) if size > 0 else (at[:0], val[:0]))
                    y = np.array([2 * d["y"] - 1 for d in docs], float)
                    alpha = np.frombuffer(before, np.float64) if before else np.zeros(len(x))
                    alpha, more = descend(x, y, c[[d["y"] for d in docs]] if docs else y, w, alpha, epochs, float(slabs), (seed, r, slab))
                    yield _batch([{"slab": slab, "c": -1, "x": alpha.tobytes()}, *_chunked(slab, more)], _PART)

            # alphas are 16 * per_class numbers at most
            done = scratch.table(table.join(F.broadcast(alphas), "slab").mapInArrow(step, "slab bigint, c int, x binary"), f"round-{r}")
            if last is not None:
                scratch.drop(last)
            alphas, last = done.where("c = -1").select("slab", F.col("x").alias("alpha")), done
            weight = weight + _vectors(done.where("c >= 0"))
    model = Model(ratio, weight, 0.0, 0.0)
    shared = spark.sparkContext.broadcast(model)

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.tables()
        for _, docs, _ in _slab_rows(batches):
            got = [(d["y"], round(min(_WIDE, max(-_WIDE, margin(tables, np.cumsum(_unpack(d["x"], np.uint32))))) * _BINS)) for d in docs if d["tune"]]
            yield _batch([{"y": y, "m": m} for y, m in got], pa.schema([("y", pa.int32()), ("m", pa.int32())]))

    bins = sorted(table.mapInArrow(margins, "y int, m int").groupBy("y", "m").count().collect())  # 4 * _WIDE * _BINS rows at most
    if not bins and many.sum() > 0:
        bins = [(y, 0, int(many[y])) for y in (0, 1)]
    if bins:
        y, m, k = (np.array(x, float) for x in zip(*bins, strict=True))
        model.slope, model.offset = logistic(m / _BINS, y, k)
    return model


def score(docs: DataFrame, model: Model, *, text: str = "text", least: float = 0.3) -> DataFrame:
    """All columns of docs, score (the probability of label 1) and predicted (1 if that is ``least`` or more); columns of docs with these names are replaced.

    Null and empty texts have no n-grams and get what the curve gives for a margin of 0. Every byte of a text counts. Empty tables give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # twice _D numbers
    names = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, tables = Features(), shared.value.tables()
        for batch in batches:
            m = np.array([margin(tables, at) for at in features.of(*kernels.utf8(batch.column(names.index(text))))])
            p = shared.value.probability(m)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= least).astype(np.int32))], names=[*names, "score", "predicted"])

    fields = [f for f in docs.schema.fields if f.name in names]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, schema)
