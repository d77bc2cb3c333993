"""Scoring texts with an n-gram model smoothed by deleted interpolation (Jelinek and Mercer, 1980).

P(w | h) = sum_k weight_k(b) * c(h_k w) / c(h_k) + weight_0(b) / (V + 1), where h_k are the last k - 1
words, c counts n-grams in the training documents, V is the number of their distinct tokens and b is the bucket
of log2 c(h) of the longest context. The weights of a bucket are learned by expectation-
maximisation on a fold of the training documents that is left out of the counts meanwhile.
They sum to one, and every maximum-likelihood part is a distribution wherever its weight is above zero, so
the model is one over the V tokens and one unknown token.

How it is spread out. A map task packs its documents into slabs of a bounded number of bytes:
token ids, and a dictionary of word hashes. Of each slab only the distinct n-grams
are sent, as one block of sorted 64-bit keys for each range of keys; a range adds up its
blocks and sends the global counts back in the order of the keys. A slab sends 2^_COARSE blocks an order at most: where the input needs
more ranges than that, some hundred slabs first meet in each coarse range, and what they have together is split finer, so that blocks stay
of some size however many ranges there are. A slab joins its counts once and keeps
those of its tokens, from which the weights are learned and the documents scored without another
shuffle. Nothing is broadcast or collected but weights and six totals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import kernels
from strandlake.llm.scratch import Scratch

_U = np.uint64
_END, _START, _STEP = _U(0x2545F4914F6CDD1D), _U(0x6A09E667F3BCC909), _U(0xBB67AE8584CAA73B)
_SLAB = 6 << 20
_PIECE = 1 << 20
_BUCKETS = 48
_COARSE, _TOGETHER = 8, 512
_SLAB_SCHEMA = "slab bigint, ids array<bigint>, folds binary, n binary, tokens binary, words binary"


def _pack(x: np.ndarray) -> bytes:
    """zstd over byte planes: small numbers leave the upper planes empty."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def _unpack(b: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row, as a row may hold megabytes."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(c)[i].as_py() for c, name in enumerate(batch.schema.names)}


def fold(doc_id: int | None, folds: int, held: int, tune: int) -> int:
    """0: counted, 1: tunes the weights, 2: held out. A null id counts as an empty name."""
    r = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds
    return 2 if r == held else 1 if r == tune else 0


def _slabs(docs: DataFrame, folds: int, held: int, tune: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        toks: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, toks, size, count
            n = np.array([len(t) for t in toks], np.uint32)
            words, local, often = np.unique(np.concatenate(toks), return_inverse=True, return_counts=True)
            rank = np.empty(len(words), np.uint32)
            order = np.argsort(-often, kind="stable")  # frequent words get small ids
            rank[order] = np.arange(len(words), dtype=np.uint32)
            row = [(part << 24) + count, ids, bytes(fold(i, folds, held, tune) for i in ids), _pack(n), _pack(rank[local]), words[order].tobytes()]
            types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            ids, toks, size, count = [], [], 0, count + 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["slab", "ids", "folds", "n", "tokens", "words"])

        for batch in batches:
            data, off = kernels.utf8(batch.column(1))
            keys = batch.column(0).to_pylist()
            for i, j in kernels.pieces(off, _PIECE):
                tok, at = kernels.tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for k in range(j - i):
                    toks.append(np.append(tok[at[k] : at[k + 1]], _END))
                ids += keys[i:j]
                size += int(off[j] - off[i]) + 8 * (j - i)
                if size >= _SLAB:
                    yield flush()
        if toks:
            yield flush()

    return docs.mapInArrow(run, _SLAB_SCHEMA)


def _pack_keys(x: np.ndarray, bits: int, k: int) -> bytes:
    """Sorted keys of one range as packed differences; n-grams keep 48 bits below those of the range, words all."""
    y = (x << _U(bits)) >> _U(16 if k else bits)
    return _pack(np.diff(y, prepend=_U(0)))


class _Slab:
    """A slab's documents again, and the n-gram key of each token for every order."""

    def __init__(self, row: dict, order: int):
        self.ids = row["ids"]
        self.folds = np.frombuffer(row["folds"], np.uint8)
        self.n = _unpack(row["n"], np.uint32).astype(np.int64)
        token = np.frombuffer(row["words"], _U)[_unpack(row["tokens"], np.uint32)]
        self.first = np.concatenate([[0], np.cumsum(self.n)[:-1]])
        self.token_fold = np.repeat(self.folds, self.n)
        self.keys, self.inverse = [], []
        key, start = token, _START
        for k in range(1, order + 1):
            if k > 1:
                before = np.empty_like(key)
                before[1:] = key[:-1]
                before[self.first] = start
                key = kernels.mix64(before * _STEP + token)
                start = kernels.mix64(np.array([start], _U) * _STEP)[0]
            uniq, inv = np.unique(key, return_inverse=True)
            self.keys.append(uniq)
            self.inverse.append(inv)

    def counts(self, k: int, which: int) -> np.ndarray:
        return np.bincount(self.inverse[k][self.token_fold == which], minlength=len(self.keys[k])).astype(np.uint32)


def _requests(slabs: DataFrame, order: int, bits: int) -> DataFrame:
    """For each slab, order and key range: the distinct keys, and how often the slab counts and tunes with them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            s = _Slab(row, order)
            for k in range(order):
                keys, a, b = s.keys[k], s.counts(k, 0), s.counts(k, 1)
                cut = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=_U) << _U(64 - bits))
                out = [(i, _pack_keys(x, bits, k), _pack(y), _pack(z)) for i, (x, y, z) in enumerate(zip(np.split(keys, cut), np.split(a, cut), np.split(b, cut), strict=True)) if len(x)]
                cols = [pa.array([o[c] for o in out], pa.int32() if c == 0 else pa.binary()) for c in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array([row["slab"]] * len(out), pa.int64()), pa.array([k] * len(out), pa.int32()), *cols], names=["slab", "k", "p", "keys", "a", "b"])

    return slabs.mapInArrow(run, "slab bigint, k int, p int, keys binary, a binary, b binary")


def _added(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Of blocks of one range: the distinct keys, where each block's keys are among them, the sums of both counts, and the blocks' sizes."""
    keys = [np.cumsum(_unpack(r["keys"], _U), dtype=_U) for r in rows]
    uniq, inv = np.unique(np.concatenate(keys), return_inverse=True)
    a, b = (np.bincount(inv, np.concatenate([_unpack(r[c], r.get("type", np.uint32)) for r in rows]), len(uniq)).astype(_U) for c in "ab")
    return uniq, inv, a, b, [len(x) for x in keys]


_ANSWER = pa.schema([("slab", pa.int64()), ("k", pa.int32()), ("p", pa.int32()), ("f", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("va", pa.int64()), ("v", pa.int64())])


def _answers(rows: list[dict], inv: np.ndarray, sizes: list[int], a: np.ndarray, b: np.ndarray) -> Iterator[dict]:
    at = 0
    for r, n in zip(rows, sizes, strict=True):
        own = inv[at : at + n]
        yield {"slab": r["slab"], "k": r["k"], "p": r["p"], "f": r["f"], "a": _pack(a[own]), "b": _pack(b[own]), "va": 0, "v": 0}
        at += n


def _merge(dtype: type):
    """The blocks of one key range, with global counts in place of their own; a row without a slab has the range's totals."""

    def run(table: pa.Table) -> pa.Table:
        rows = [r | {"type": dtype} for r in table.to_pylist()]
        uniq, inv, a, b, sizes = _added(rows)
        out = list(_answers(rows, inv, sizes, a, b))
        out.append({"slab": None, "k": rows[0]["k"], "p": rows[0]["p"], "f": rows[0]["f"], "a": None, "b": None, "va": int((a > 0).sum()), "v": int((a + b > 0).sum())})
        return pa.Table.from_pylist(out, _ANSWER)

    return run


def _together(coarse: int, fine: int):
    """The blocks of one coarse range of slabs that ask together, as one block for each fine range."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        uniq, _, a, b, _ = _added(rows)
        width = 48 if rows[0]["k"] else 64 - coarse
        cut = np.searchsorted(uniq, np.arange(1, 1 << fine, dtype=_U) << _U(width - fine))
        out = [{"slab": rows[0]["many"], "k": rows[0]["k"], "p": rows[0]["p"], "f": f, "keys": _pack(np.diff(x, prepend=_U(0))), "a": _pack(y), "b": _pack(z)} for f, (x, y, z) in enumerate(zip(np.split(uniq, cut), np.split(a, cut), np.split(b, cut), strict=True)) if len(x)]
        return pa.Table.from_pylist(out, pa.schema([("slab", pa.int64()), ("k", pa.int32()), ("p", pa.int32()), ("f", pa.int32()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary())]))

    return run


def _apart(asked: pa.Table, got: pa.Table) -> pa.Table:
    """The answers to slabs that asked together, for each slab."""
    rows = asked.to_pylist()
    _, inv, _, _, sizes = _added(rows)
    parts = sorted(got.to_pylist(), key=lambda r: r["f"])
    a, b = (np.concatenate([_unpack(r[c], _U) for r in parts]) for c in "ab")
    return pa.Table.from_pylist(list(_answers(rows, inv, sizes, a, b)), _ANSWER)


_ANSWER_SCHEMA = "slab bigint, k int, p int, f int, a binary, b binary, va bigint, v bigint"


def _counted(scratch: Scratch, slabs: DataFrame, order: int, bits: int) -> DataFrame:
    """(slab, k, p, f, a, b, va, v): for each block of keys the global counts; rows without a slab have totals of ranges."""
    coarse = min(bits, _COARSE)
    asked = _requests(slabs, order, coarse).withColumn("f", F.lit(0))
    if coarse == bits:
        return scratch.table(asked.groupBy("p", "k").applyInArrow(_merge(np.uint32), _ANSWER_SCHEMA), "counts")
    many = F.pmod(F.xxhash64("slab"), F.lit(max(1, -(-slabs.count() // _TOGETHER))))
    asked = scratch.table(asked.withColumn("many", many), "asked")
    joint = asked.groupBy("many", "k", "p").applyInArrow(_together(coarse, bits - coarse), "slab bigint, k int, p int, f int, keys binary, a binary, b binary")
    merged = scratch.table(joint.groupBy("p", "k", "f").applyInArrow(_merge(_U), _ANSWER_SCHEMA), "merged")
    back = asked.groupBy("many", "k", "p").cogroup(merged.where("slab is not null").groupBy("slab", "k", "p")).applyInArrow(_apart, _ANSWER_SCHEMA)
    return scratch.table(back.union(merged.where("slab is null")), "counts")


def _ratios(count: list[np.ndarray], first: np.ndarray, total: int, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From each token's n-gram counts: its maximum-likelihood estimates, which of their contexts were seen, and the bucket of the longest context."""
    order = len(count)
    ml, seen = np.zeros((len(count[0]), order)), np.zeros((len(count[0]), order), bool)
    context = np.full(len(count[0]), float(total))
    for k in range(order):
        if k:
            context[1:] = count[k - 1][:-1]
            context[first] = starts
        np.divide(count[k], context, out=ml[:, k], where=context > 0)
        seen[:, k] = context > 0
    # frexp gives the bit length: 0 for a context that was never seen
    return ml, seen, np.minimum(np.frexp(context)[1], _BUCKETS - 1)


def _resolved(joined: DataFrame, order: int, total: int, starts: int) -> DataFrame:
    """Slabs with the counts of their tokens in place of ids and keys; ml and bucket are the events of the tuning fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            got = sorted(row.pop("got"), key=lambda g: (g["k"], g["p"]))
            s = _Slab(row, order)
            counted, whole = [], []
            for k in range(order):
                a, b = (np.concatenate([_unpack(g[c], _U) for g in got if g["k"] == k]) for c in "ab")
                counted.append(a[s.inverse[k]].astype(np.float64))
                whole.append(_pack((a + b)[s.inverse[k]]))
            tune = np.flatnonzero(s.token_fold == 1)
            ml, _, bucket = _ratios(counted, s.first, total, starts)
            out = [s.ids, row["folds"], row["n"], whole, _pack(ml[tune].astype(np.float32).ravel()), _pack(bucket[tune].astype(np.uint8))]
            types = [pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, types, strict=True)], names=["ids", "folds", "n", "counts", "ml", "bucket"])

    return joined.mapInArrow(run, "ids array<bigint>, folds binary, n binary, counts array<binary>, ml binary, bucket binary")


def learn_weights(events: DataFrame, order: int, v: int, rounds: int) -> np.ndarray:
    """Weights, one row a bucket: column 0 for the uniform part, column k for order k. Buckets without events keep the even start."""
    weights = np.full((_BUCKETS, order + 1), 1.0 / (order + 1))
    for _ in range(rounds):
        w = weights.copy()

        def run(batches: Iterator[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((_BUCKETS, order + 1))
            for row in _rows(batches):
                b, ml = _unpack(row["bucket"], np.uint8), _unpack(row["ml"], np.float32)
                for i in range(0, len(b), 1 << 17):
                    bb = b[i : i + (1 << 17)]
                    part = w[bb] * np.column_stack([np.full(len(bb), 1.0 / (v + 1)), ml[i * order : (i + len(bb)) * order].reshape(-1, order)])
                    part /= part.sum(1, keepdims=True)
                    for k in range(order + 1):
                        sums[:, k] += np.bincount(bb, part[:, k], _BUCKETS)
            b, k = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(sums[b, k])], names=["b", "k", "x"])

        got = events.mapInArrow(run, "b int, k int, x double").groupBy("b", "k").agg(F.sum("x").alias("x")).collect()  # _BUCKETS * (order + 1) rows at most
        sums = np.zeros_like(weights)
        for r in sorted(got):
            sums[r["b"], r["k"]] = r["x"]
        seen = sums.sum(1) > 0
        weights[seen] = np.maximum(sums[seen] / sums[seen].sum(1, keepdims=True), 1e-12)
        weights /= weights.sum(1, keepdims=True)
    return weights


def usable(weights: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """weights with those of parts whose context was never seen given to the other parts in proportion."""
    w = weights * seen
    return w / w.sum(-1, keepdims=True)


def score(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", order: int = 2, folds: int = 7, held: int = 2, tune: int = 3, rounds: int = 8
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Tokens are the words of the whole text with A-Z lower-cased, then one end. Training
    documents are those whose crc32(id as text) mod ``folds`` is not ``held``; the remainder ``tune`` among them learns
    the weights and is counted for scoring. A null or empty text is one end token; a null id counts
    as an empty name; repeated ids are scored row by row. Without training tokens only the uniform part is left.
    Empty tables give no rows; other columns, of any name, are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    plain = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    bits = max(6, (2 * plain.rdd.getNumPartitions() - 1).bit_length())  # ranges of keys grow with the input
    slabs = scratch.table(_slabs(plain, folds, held, tune), "slabs")

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = [np.frombuffer(x, np.uint8) for x in pdf["folds"]]
            n = [_unpack(x, np.uint32).astype(np.int64) for x in pdf["n"]]
            yield pd.DataFrame({"d0": [int((x == 0).sum()) for x in f], "d1": [int((x == 1).sum()) for x in f], "t0": [int(y[x == 0].sum()) for x, y in zip(f, n, strict=True)], "t1": [int(y[x == 1].sum()) for x, y in zip(f, n, strict=True)]})

    d0, d1, t0, t1 = (int(x or 0) for x in slabs.select("folds", "n").mapInPandas(sizes, "d0 bigint, d1 bigint, t0 bigint, t1 bigint").agg(*(F.sum(c) for c in ("d0", "d1", "t0", "t1"))).first())
    merged = _counted(scratch, slabs, order, bits)
    scratch.sweep()
    va, v = (int(x or 0) for x in merged.where("slab is null and k = 0").agg(F.sum("va"), F.sum("v")).first())
    joined = slabs.join(merged.where("slab is not null").groupBy("slab").agg(F.collect_list(F.struct("k", "p", "a", "b")).alias("got")), "slab")  # as many as one slab has key ranges
    resolved = scratch.table(_resolved(joined, order, t0, d0), "resolved")
    scratch.drop(slabs)
    scratch.drop(merged)
    scratch.sweep()
    weights = learn_weights(resolved.select("ml", "bucket"), order, va, rounds)
    total, starts = t0 + t1, d0 + d1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            n = _unpack(row["n"], np.uint32).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            counts = [_unpack(c, _U).astype(np.float64) for c in row["counts"]]
            ml, seen, bucket = _ratios(counts, first, total, starts)
            own, p = counts[0], np.empty(len(counts[0]))
            for i in range(0, len(own), 1 << 17):
                at = slice(i, i + (1 << 17))
                one = np.ones(len(own[at]))
                p[at] = np.log10((usable(weights[bucket[at]], np.column_stack([one, seen[at]])) * np.column_stack([one / (v + 1), ml[at]])).sum(1))
            base = np.log10((own + 1) / (total + v + 1))
            add = lambda x: np.add.reduceat(x, first)  # noqa: B023, E731
            held_out = np.frombuffer(row["folds"], np.uint8) == 2
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(held_out), pa.array(n), pa.array(add((own > 0).astype(np.int64))), pa.array(np.full(len(n), total, np.int64)), pa.array(add(base)), pa.array(add(p))], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return resolved.select("ids", "folds", "n", "counts").mapInArrow(run, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
