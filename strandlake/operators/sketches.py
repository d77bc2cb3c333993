"""Comparisons by k-mers: contamination, distances between sets, votes for a taxon, open reading frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from strandlake import workspace
from strandlake.functions import sequence as S
from strandlake.operators.sizes import broadcast_if_small

#: Hashes in a block of sketches, and meetings on a hash that are counted at a time.
_HASHES, _PAIRS = 1 << 22, 1 << 19
#: Hashes of most sketches, which are bits of a sketch; pairs in a row of a result.
_HOT, _ROW = 128, 1 << 14
#: Similarities that a task computes at a time.
_SIMILAR = 1 << 20


def kmer_rows(rows: DataFrame, seq: str, k: int, *keep: str) -> DataFrame:
    """(keep..., pos, km): one row for each k-mer of the ASCII column seq, km as bytes.

    Positions are exploded and k-mers cut in generated code, which no array function is.
    """
    x = rows.select(*keep, F.col(seq).cast("binary").alias("__raw")).where(F.octet_length("__raw") >= k)
    x = x.select(*keep, "__raw", F.explode(F.sequence(F.lit(1), F.octet_length("__raw") - (k - 1))).alias("__i"))
    return x.select(*keep, (F.col("__i") - 1).alias("pos"), F.substring(F.col("__raw"), F.col("__i"), F.lit(k)).alias("km"))


_BASES = {x: np.full(256, 4, np.uint8) for x in (False, True)}
for _table, _letters in ((False, b"ACGT"), (True, b"ACGT"), (True, b"acgt")):
    _BASES[_table][list(_letters)] = range(4)


def packed(bases: np.ndarray, k: int) -> np.ndarray:
    """The number of each k-mer of bases 0 to 3, the first base highest; k at most 31. Runs of 1, 2, 4... bases are put together."""
    run, out, used, width = bases.astype(np.int64), None, 0, 1
    n = len(bases) - k + 1
    while width <= k:
        if k & width:
            part = run[used : used + n]
            out = part if out is None else (out << 2 * width) | part
            used += width
        run = (run[:-width] << 2 * width) | run[width:]
        width *= 2
    return out


def numbered(seq: bytes, k: int, canonical: bool) -> np.ndarray:
    """A number for each k-mer: bases as digits; canonical: the smaller one of both strands in either case, without those that have other letters, else a negative hash for these."""
    if len(seq) < k:
        return np.zeros(0, np.int64)
    codes = _BASES[canonical][np.frombuffer(seq, np.uint8)]
    other = codes > 3
    c = codes & 3
    out = packed(c, k)
    if canonical:
        out = np.minimum(out, packed(3 - c[::-1], k)[::-1])
    if other.any():
        upto = np.concatenate([[0], np.cumsum(other)])
        bad = upto[k:] > upto[: len(out)]
        if canonical:
            return out[~bad]
        for i in np.flatnonzero(bad):
            out[i] = int.from_bytes(blake2b(seq[i : i + k], digest_size=8).digest(), "little", signed=True) | -(1 << 63)
    return out


def kmer_numbers(rows: DataFrame, seq: str, k: int, *keep: str, canonical: bool = False, distinct: bool = False) -> DataFrame:
    """(keep..., pos, km): ``numbered`` k-mers of a sequence, of which joins need no bytes; k at most 31. distinct: each once a row; then, and of canonical ones, pos is not their place."""
    if not 1 <= k <= 31:
        raise ValueError("k must be at most 31")
    x = rows.select(*keep, F.col(seq).cast("binary").alias("__raw")).where(F.octet_length("__raw") >= k)
    schema = StructType([*x.select(*keep).schema.fields, StructField("__km", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = batch.column(batch.num_columns - 1), 0
            size = np.cumsum(pc.binary_length(raw).to_numpy())
            while at < batch.num_rows:  # some 2^20 bases at a time
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (1 << 20), "right")))
                found = [numbered(s, k, canonical) for s in raw[at:end].to_pylist()]
                found = [np.unique(f) for f in found] if distinct else found
                flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[at:end] for i in range(len(keep))), flat], names=[*keep, "__km"])
                at = end

    return x.mapInArrow(run, schema).select(*keep, F.posexplode("__km").alias("pos", "km"))


def kmer_number(km: Column) -> Column:
    """The number of a k-mer of ACGT as a string."""
    return F.conv(F.translate(km, "ACGT", "0123"), 4, 10).cast("bigint")


def _kmers_of(rows: DataFrame, seq: str, k: int, *keep: str) -> DataFrame:
    """(keep..., km): the distinct k-mers of each row, as numbers or, of more than 31 bases, as bytes."""
    if k <= 31:
        return kmer_numbers(rows, seq, k, *keep, distinct=True).select(*keep, "km")
    return kmer_rows(rows, seq, k, *keep).select(*keep, "km")


def _counted(reads: DataFrame, known: DataFrame, name: str, seq: str, k: int, *key: str) -> DataFrame:
    """(name, key..., n): how many distinct k-mers of a read known (km, key...) has. Where rows have names of their own, hits are counted before any shuffle."""
    own = k <= 31 and reads.groupBy(name).count().where("count > 1").isEmpty()
    x = _kmers_of(reads, seq, k, name).join(broadcast_if_small(workspace.table(known, "known")), "km").groupBy(name, *key)
    return x.agg((F.count("*") if own else F.countDistinct("km")).cast("bigint").alias("n"))


def contaminated(reads: DataFrame, reference: DataFrame, name: str, seq: str, k: int = 23) -> DataFrame:
    """(name, hits): reads with at least one k-mer of the reference, and how many distinct ones."""
    return _counted(reads, _kmers_of(reference, "seq", k).distinct(), name, seq, k).withColumnRenamed("n", "hits")


def mash(sets: DataFrame, name: str, seq: str, k: int, *key: str) -> DataFrame:
    """(key..., a, b, shared, jaccard, identity) of all ordered pairs of sequences of a key that share a k-mer, each with itself included.

    identity = 1 + ln(2 j / (1 + j)) / k, an estimate of average nucleotide identity (Ondov et al., 2016). Pairs
    without a common k-mer have identity 0 and are not listed. Pairs meet on k-mers, so no cross join is made; a k-mer
    of all n sequences gives n * n pairs, as many as the result has.
    """
    x = sets.select(*key, F.col(name).alias("id"), F.explode(F.array_distinct(S.kmers(F.col(seq), k))).alias("km"))
    n = x.groupBy(*key, "id").agg(F.count("*").alias("n"))
    p = x.select(*key, F.col("id").alias("a"), "km").join(x.select(*key, F.col("id").alias("b"), "km"), [*key, "km"]).groupBy(*key, "a", "b").agg(F.count("*").alias("shared"))
    p = p.join(n.select(*key, F.col("id").alias("a"), F.col("n").alias("na")), [*key, "a"]).join(n.select(*key, F.col("id").alias("b"), F.col("n").alias("nb")), [*key, "b"])
    p = p.withColumn("jaccard", F.expr("shared / (na + nb - shared)"))
    return p.select(*key, "a", "b", "shared", "jaccard", (1 + F.log(2 * F.col("jaccard") / (1 + F.col("jaccard"))) / k).alias("identity"))


_SHIFTS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint64).astype(np.uint32)
_QUADS = np.frombuffer(b"".join(bytes(b"ACGT"[i >> s & 3] for s in (6, 4, 2, 0)) for i in range(256)), "<u4").astype(np.uint32)


def md5_numbers(numbers: np.ndarray, k: int) -> np.ndarray:
    """The first 15 hexadecimal digits of the MD5 of each numbered k-mer of ACGT (k at most 31) as a number, times 8: some 2^13 k-mers a step."""
    out = np.empty(len(numbers), np.int64)
    for first in range(0, len(numbers), 1 << 13):
        x = numbers[first : first + (1 << 13)]
        words: list = [0] * 16  # of the one block of the message, little-endian: letters, an end bit, the length in bits
        for w in range(k // 4):
            words[w] = _QUADS[(x >> 2 * (k - 4 * w - 4)) & 255]
        rest = k % 4
        words[k // 4] = (_QUADS[(x << 2 * (4 - rest)) & 255] & np.uint32((1 << 8 * rest) - 1)) | np.uint32(0x80 << 8 * rest)
        words[14] = 8 * k
        start = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
        a, b, c, d = (np.full(len(x), v, np.uint32) for v in start)
        f, high = np.empty_like(a), np.empty_like(a)
        for i in range(64):
            turn = i // 16
            if turn == 0:
                np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            elif turn == 1:
                np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            elif turn == 2:
                np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            else:
                np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[turn] % 16]
            np.add(a, f, out=a)
            if isinstance(word, int):
                np.add(a, np.uint32((int(_SINES[i]) + word) & 0xFFFFFFFF), out=a)
            else:
                np.add(a, word, out=a), np.add(a, _SINES[i], out=a)
            by = _SHIFTS[turn][i % 4]
            np.left_shift(a, np.uint32(by), out=high), np.right_shift(a, np.uint32(32 - by), out=a), np.bitwise_or(a, high, out=a)
            np.add(a, b, out=a)
            a, b, c, d = d, a, b, c
        top, low = ((v + np.uint32(s)).byteswap().astype(np.int64) for v, s in ((a, start[0]), (b, start[1])))
        out[first : first + (1 << 13)] = (top << 28 | low >> 4) << 3
    return out


def frac_sketch(sets: DataFrame, name: str, seq: str, k: int, scaled: int, hashed: Callable[[Column], Column] = F.xxhash64, numbers: Callable[[np.ndarray, int], np.ndarray] | None = None) -> DataFrame:
    """(id, h): the distinct hashes of canonical k-mers below one in ``scaled`` of all 63-bit values; some 1/scaled of a sequence's k-mers, the same ones in every sequence.

    numbers: a hash of ``numbered`` k-mers (k at most 31) and k, instead of ``hashed``: some 2^18 bases are then sketched at a time, and only hashes below the bound leave a task.
    """
    bound = -(-(1 << 63) // scaled) if scaled > 1 else (1 << 63) - 1
    x = sets.select(F.col(name).alias("id"), seq)
    if numbers is not None:
        if not 1 <= k <= 31:
            raise ValueError("k must be at most 31")
        x = x.select("id", F.col(seq).cast("binary").alias("raw")).where(F.octet_length("raw") >= k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, size = 0, np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
                while at < batch.num_rows:
                    end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (1 << 18), "right")))
                    own, h = _sketched(batch.column(1)[at:end].to_pylist(), k, bound, numbers)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[at:end].take(pa.array(own)), pa.array(h)], names=["id", "h"])
                    at = end

        kind = x.schema["id"].dataType.simpleString()
        return x.mapInArrow(run, f"id {kind}, h bigint").repartition("id").distinct()
    km = kmer_rows(x.select("id", F.upper(seq).alias("s")), "s", k, "id").select("id", F.col("km").cast("string").alias("km"))
    x = km.where(F.col("km").rlike("^[ACGT]+$")).select("id", (hashed(F.least("km", S.reverse_complement(F.col("km")))).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))).alias("h"))
    return x.where(F.col("h") < F.lit(bound)).distinct()


def _sketched(seqs: list[bytes], k: int, bound: int, numbers: Callable[[np.ndarray, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the sequence, hash) below the bound of canonical k-mers; a sequence has a hash once. A byte between sequences is in no k-mer."""
    codes = _BASES[True][np.frombuffer(b"\n".join(seqs), np.uint8)]
    bad = np.concatenate([[0], np.cumsum(codes > 3, dtype=np.int32)])
    c = codes & 3
    km = packed(c, k)
    km = np.minimum(km, packed(3 - c[::-1], k)[::-1])
    place = np.flatnonzero(bad[k:] == bad[: len(km)])
    h = numbers(km[place], k) & 0x7FFFFFFFFFFFFFFF
    low = h < bound
    h, own = h[low], np.searchsorted(np.cumsum([len(s) + 1 for s in seqs]), place[low], "right")
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return own[new], h[new]


def sketch_ani(sketch: DataFrame, k: int, least: float = 0.9, digits: int | None = None) -> DataFrame:
    """(a, b, shared, containment, identity, error) of all pairs of sketches (id, h) with an identity of ``least`` or more, a before b.

    containment is shared over the hashes of the smaller sketch, identity its k-th root (Hera et al., 2023), error three standard
    deviations of that from sampling; digits: these three are rounded to so many. Sketches are dealt into blocks of some 2^22 hashes, and every two blocks meet once in a task: no candidate is
    shuffled or written, and a task holds two blocks. Exact: the smaller sketch of a pair looks up its hashes in the lists of the other block, but for the most frequent ones, of
    which it leaves out one less than it must share; these are bits of both sketches and are added to the counts of pairs that met on another hash. Measures are computed once for
    all pairs of the same counts. Its work follows the meetings on hashes that are left, and its result, which is quadratic where small sketches share their hashes with many.
    """
    part = least**k
    kind = sketch.schema["id"].dataType.simpleString()
    whole = workspace.table(sketch.where("id is not null").groupBy("id").agg(F.collect_set("h").alias("hs")), "sketches")  # one sketch a row
    often = whole.select(F.explode("hs").alias("h")).groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    hot = np.array([r["h"] for r in often.orderBy(F.desc("df"), "h").limit(_HOT).collect()], np.int64)
    total = whole.agg(F.sum(F.size("hs"))).first()[0] or 0
    blocks = F.pmod(F.xxhash64("id"), F.lit(max(8, -(-total // _HASHES)))).cast("int")
    names = ["ids", *_KEPT]
    schema = f"block int, ids array<{kind}>, " + ", ".join(f"{c} binary" for c in _KEPT)  # numbers as bytes: the JVM only hands them on
    dealt = workspace.table(whole.withColumn("block", blocks).groupBy("block").applyInArrow(lambda key, t: _block(key[0].as_py(), t, part, hot), schema), "blocks")
    other = dealt.select(F.col("block").alias("block2"), *(F.col(c).alias(f"{c}2") for c in names))
    pairs = dealt.join(other.hint("shuffle_replicate_nl"), F.col("block") <= F.col("block2")).select((F.col("block") == F.col("block2")).alias("same"), *names, *(f"{c}2" for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = (_Block(*(batch.column(1 + j)[i] for j in js)) for js in (range(len(names)), range(len(names), 2 * len(names))))
                if batch.column(0)[i].as_py():
                    rows = left.rows(np.arange(len(left.u)))
                    yield from _grouped(left, left, _met(left, left, rows, rows, np.arange(1, len(left.n) + 1), part))
                elif len(left.u) and len(right.u):
                    near = np.minimum(np.searchsorted(right.u, left.u), len(right.u) - 1)
                    both = np.flatnonzero(right.u[near] == left.u)
                    l, r = left.rows(both), right.rows(near[both])
                    yield from _grouped(left, right, _met(left, right, l, r, np.searchsorted(right.n, left.n, "left"), part))  # of equal sizes the left one counts as the smaller
                    yield from _grouped(right, left, _met(right, left, r, l, np.searchsorted(left.n, right.n, "right"), part))

    y = pairs.mapInArrow(run, f"n bigint, shared bigint, pairs array<struct<l {kind}, r {kind}>>").withColumn("containment", F.col("shared") / F.col("n"))
    c = F.col("containment")
    spread = F.sqrt(c * (1 - c) / F.col("n")) * F.pow(c, F.lit(1 / k - 1)) / k
    y = y.select("pairs", "shared", *((m if digits is None else F.round(m, digits)).alias(name) for m, name in ((c, "containment"), (F.pow(c, F.lit(1 / k)), "identity"), (3 * spread, "error"))))
    y = y.select(F.inline("pairs"), "shared", "containment", "identity", "error")
    return y.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), "shared", "containment", "identity", "error")


#: Columns of a block: sizes of sketches; different hashes, how often each occurs, and in which sketches, as ~ of their places where a sketch leaves it out; bits of hot hashes, of those left out.
_KEPT = {"n": np.int32, "u": np.int64, "times": np.int32, "own": np.int32, "bits": np.uint64, "left_out": np.uint64}


def _masks(own: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """A row of _HOT bits a sketch."""
    out = np.zeros((n, -(-_HOT // 64)), np.uint64)
    np.bitwise_or.at(out, (own, rank // 64), np.uint64(1) << (rank % 64).astype(np.uint64))
    return out


def _block(name: int, rows: pa.Table, part: float, hot: np.ndarray) -> pa.Table:
    """A row with the sketches (id, hs) by size and their hashes in order."""
    rows = rows.combine_chunks()
    rows = rows.take(pa.array(np.argsort(pc.list_value_length(rows["hs"]).to_numpy(), kind="stable")))
    n = pc.list_value_length(rows["hs"]).to_numpy()
    h = pc.list_flatten(rows["hs"]).to_numpy()
    own = np.repeat(np.arange(len(n), dtype=np.int32), n)
    order = np.argsort(h, kind="stable")
    u, times = np.unique(h, return_counts=True)
    by = np.argsort(hot)
    near = np.minimum(np.searchsorted(hot[by], h), len(hot) - 1)
    i = np.flatnonzero(hot[by][near] == h) if len(hot) else near[:0]
    rank = by[near[i]]
    order_i = np.lexsort((rank, own[i]))
    i, rank = i[order_i], rank[order_i]
    o = own[i]
    out = np.arange(len(o)) - np.searchsorted(o, o, "left") < np.ceil(n * part - 1e-9)[o] - 1
    bits, left_out = _masks(o, rank, len(n)), _masks(o[out], rank[out], len(n))
    own[i[out]] = ~own[i[out]]
    cols = {"n": n, "u": u, "times": times, "own": own[order], "bits": bits, "left_out": left_out}
    ids = rows["id"].combine_chunks()
    ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.table([pa.array([name], pa.int32()), ids, *(pa.array([cols[c].astype(t).tobytes()], pa.binary()) for c, t in _KEPT.items())], names=["block", "ids", *_KEPT])


class _Block:
    """A block of sketches as arrays."""

    def __init__(self, ids: pa.ListScalar, *columns: pa.BinaryScalar):
        self.ids = ids.values
        self.n, self.u, self.times, self.own, *masks = (np.frombuffer(x.as_buffer(), t) for x, t in zip(columns, _KEPT.values()))
        self.bits, self.left_out = (x.reshape(len(self.n), -1) for x in masks)

    def rows(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``of``, own) for each occurrence of some of the different hashes."""
        first, times = (np.cumsum(self.times, dtype=np.int64) - self.times)[of], self.times[of]
        ahead = np.cumsum(times, dtype=np.int64)
        return np.repeat(np.arange(len(of)), times), self.own[np.repeat(first - ahead + times, times) + np.arange(ahead[-1] if len(of) else 0)]


def _met(a: _Block, b: _Block, rows: tuple, lists: tuple, start: np.ndarray, part: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(sketch of a, of b, shared hashes) of the pairs at the bound, of each sketch of a with those of b from a start on, none of which is smaller. rows, lists: of common hashes. Some 2^19 meetings are counted at a time."""
    need = a.n * part - 1e-9
    lowest = np.ceil(need - np.bitwise_count(a.left_out).sum(1)).clip(1)  # so often a sketch must meet another one if that has all that it leaves out
    turn = np.argsort(lowest, kind="stable")
    place = np.empty(len(turn), np.int32)
    place[turn] = np.arange(len(turn), dtype=np.int32)
    hashes, x = rows
    kept = np.flatnonzero(x >= 0)
    hashes, x = hashes[kept], x[kept]
    y = np.where(lists[1] < 0, ~lists[1], lists[1])
    lo = np.searchsorted(lists[0] * len(b.n) + y, hashes * len(b.n) + start[x])
    times = np.cumsum(np.bincount(lists[0]))[hashes] - lo
    some, y = np.flatnonzero(times), y.astype(np.uint32)
    x = place[x[some]]
    order = np.argsort(x.astype(np.uint16) if len(a.n) <= 1 << 16 else x, kind="stable")  # by digits
    x, some = x[order], some[order]
    lo, times = lo[some], times[some]
    ahead = np.concatenate([[0], np.cumsum(times)])
    runs = np.flatnonzero(np.diff(x, prepend=-1))  # of a sketch
    bits = len(b.n).bit_length()

    def listed(i: int, j: int) -> np.ndarray:
        at = np.ones(ahead[j] - ahead[i], np.int64)
        at[0] = lo[i]
        at[ahead[i + 1 : j] - ahead[i]] = lo[i + 1 : j] - lo[i : j - 1] - times[i : j - 1] + 1
        return y[np.cumsum(at, out=at)]

    i = 0
    while i < len(x):
        j = min(int(np.searchsorted(ahead, ahead[i] + _PAIRS, "right")) - 1, int(np.searchsorted(x, int(x[i]) + (1 << 32 - bits), "left")))  # of whole sketches as many as fit
        j = len(x) if j >= len(x) else int(np.searchsorted(x, x[j], "left"))
        if j > i:
            at = runs[np.searchsorted(runs, i) : np.searchsorted(runs, j)]
            code = np.repeat((x[at] - x[i]).astype(np.uint32) << np.uint32(bits), np.diff(ahead[at], append=ahead[j])) | listed(i, j)
            code.sort()
            m = int(lowest[turn[x[i]]]) - 1  # all sketches of the chunk must meet more often than that
            if m:
                new = np.flatnonzero(code[m:] == code[: max(0, len(code) - m)])
                new = new[(new == 0) | (code[new - 1] != code[new])]
                count = np.searchsorted(code, code[new], "right") - new
            else:
                new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                count = np.diff(new, append=len(code))
            code = code[new].astype(np.int64)
            l, r = turn[(code >> bits) + x[i]], code & ((1 << bits) - 1)
        else:  # one sketch has more: its lists are added up
            j, count = int(np.searchsorted(x, x[i], "right")), np.zeros(len(b.n), np.int64)
            while i < j:
                e = max(i + 1, min(j, int(np.searchsorted(ahead, ahead[i] + _PAIRS, "right")) - 1))
                count += np.bincount(listed(i, e), minlength=len(b.n))
                i = e
            r = np.flatnonzero(count)
            l, count = np.full(len(r), turn[x[j - 1]]), count[r]
        ok = np.flatnonzero(count >= lowest[l])
        l, r, count = l[ok], r[ok], count[ok]
        for w in range(a.bits.shape[1]):
            count = count + np.bitwise_count(a.left_out[l, w] & b.bits[r, w])
        ok = count >= need[l]
        yield l[ok], r[ok], count[ok]
        i = j


def _grouped(a: _Block, b: _Block, met: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """(size of the smaller, shared hashes, pairs) with pairs of the same counts in a row, some 2^18 pairs at a time."""
    held, size = [], 0

    def rows() -> pa.RecordBatch:
        l, r, count = (np.concatenate(x) for x in zip(*held))
        n = a.n[l]
        narrow = lambda x: x.astype(np.uint16) if x.max() < 1 << 16 else x  # noqa: E731  sorted by digits
        order = np.argsort(narrow(count), kind="stable")
        order = order[np.argsort(narrow(n)[order], kind="stable")]
        n, count = n[order].astype(np.int64), count[order].astype(np.int64)
        new = np.ones(len(n), bool)
        new[1:] = (n[1:] != n[:-1]) | (count[1:] != count[:-1])
        new[::_ROW] = True
        at = np.flatnonzero(new)
        pairs = pa.StructArray.from_arrays([a.ids.take(pa.array(l[order])), b.ids.take(pa.array(r[order]))], names=["l", "r"])
        return pa.RecordBatch.from_arrays([pa.array(n[at]), pa.array(count[at]), pa.ListArray.from_arrays(pa.array(np.append(at, len(n)), pa.int32()), pairs)], names=["n", "shared", "pairs"])

    for x in met:
        if len(x[0]):
            held.append(x)
            size += len(x[0])
        if size >= 1 << 18:
            yield rows()
            held, size = [], 0
    if size:
        yield rows()


def taxon_votes(reads: DataFrame, reference: DataFrame, name: str, seq: str, taxon: str, k: int) -> DataFrame:
    """(name, taxon, votes): the taxon that most of a read's distinct k-mers vote for, ties by taxon; an approximation of k-mer classifiers."""
    x = _counted(reads, _kmers_of(reference, "seq", k, taxon).distinct(), name, seq, k, taxon).withColumnRenamed("n", "votes")
    w = Window.partitionBy(name).orderBy(F.desc("votes"), taxon)
    return x.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def open_frames(seq: Column, least_codons: int = 10) -> Column:
    """Array of open reading frames on the forward strand: from ATG to a stop in frame, at least so many codons between."""
    return F.regexp_extract_all(seq, F.lit(f"ATG(?:[ACGT]{{3}}){{{least_codons},}}?(?:TAA|TAG|TGA)"), F.lit(0))


def six_frames(seq: Column, least: int = 10) -> Column:
    """Array of (strand, frame, protein): in each of the six frames what lies from a first M to a stop, with at least so many residues before it.

    Frames overlap freely, as genes on two strands do.
    """
    strands = F.array(F.struct(F.lit("+").alias("strand"), F.upper(seq).alias("s")), F.struct(F.lit("-").alias("strand"), S.reverse_complement(F.upper(seq)).alias("s")))
    one = lambda x, f: F.transform(
        F.regexp_extract_all(S.translate_codons(F.substring(x["s"], f + 1, F.length(x["s"]))), F.lit(f"M[^*]{{{least - 1},}}\\*"), F.lit(0)),
        lambda p: F.struct(x["strand"].alias("strand"), f.alias("frame"), F.btrim(p, F.lit("*")).alias("protein")),
    )
    return F.flatten(F.transform(strands, lambda x: F.flatten(F.transform(F.array(*(F.lit(i) for i in range(3))), lambda f: one(x, f)))))


def _nearest(held: tuple | None, floor: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int) -> tuple[tuple, np.ndarray]:
    """The k nearest of each query so far as (place of the query, key, similarity), with more rows; and what a candidate must reach."""
    sim = rows @ matrix.T
    sim[~np.isfinite(sim) | (own[:, None] == ids[None])] = -np.inf
    slack = 1e-12 * (1 + np.abs(matrix).sum(1) * np.abs(rows[np.isfinite(rows)]).max(initial=0))
    if len(own) > k:
        floor = np.maximum(floor, np.partition(sim, -k, axis=0)[-k] - slack)
    r, c = np.nonzero((sim >= floor) & (sim > -np.inf))
    exact = np.concatenate([np.zeros(0), *((rows[r[i : i + 4096]] * matrix[c[i : i + 4096]]).sum(1) for i in range(0, len(r), 4096))])
    c, name, exact = (np.concatenate(x) for x in zip(held, (c, own[r], exact))) if held else (c, own[r], exact)
    order = np.lexsort((name, -exact, c))
    c, name, exact = c[order], name[order], exact[order]
    first = np.searchsorted(c, np.arange(len(ids)))
    top = np.arange(len(c)) - first[c] < k
    c, name, exact = c[top], name[top], exact[top]
    n = np.bincount(c, minlength=len(ids))
    full = n >= k
    floor[full] = np.maximum(floor[full], exact[np.cumsum(n)[full] - 1] - slack[full])
    return (c, name, exact), floor


def top_similar(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """(query, key, similarity, rank): the k nearest vectors by dot product for a stated set of queries, against all vectors.

    Queries go to the scan in blocks of ``block``; a task meets a block in matrix products of at most 2^20 numbers and holds k candidates a query,
    whatever its rows. Similarities of candidates are summed in one order, so that equal vectors tie. All vectors must have the same
    dimension; rows with a null vector or null components are left out. Ties go to the smaller key.
    """
    ok = lambda d: d.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    names = ok(queries).select(F.col(key).alias("query"), F.col(vector).cast("array<double>").alias("v"))
    names = workspace.table(names.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(-(-names.count() // block) or 1))), "queries")
    rows = ok(vectors).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    kind = vectors.schema[key].dataType.simpleString()

    def near(q: pd.DataFrame):
        ids, matrix = q["query"].to_numpy(), np.stack(q["v"].to_numpy())
        step = max(k, _SIMILAR // len(ids))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None
            floor = np.full(len(ids), -np.inf)
            for b in batches:
                for at in range(0, len(b), step):
                    part = b.iloc[at : at + step]
                    held, floor = _nearest(held, floor, part["key"].to_numpy(), np.stack(part["v"].to_numpy()), ids, matrix, k)
            if held is not None:
                yield pd.DataFrame({"query": ids[held[0]], key: held[1], "similarity": held[2]})

        return run

    out = None
    for b in range(-(-names.count() // block) or 1):
        q = names.where(F.col("block") == b).select("query", "v").toPandas()  # about ``block`` vectors
        if len(q):
            found = rows.mapInPandas(near(q), f"query {kind}, `{key}` {kind}, similarity double")
            out = found if out is None else out.union(found)
    if out is None:
        return rows.limit(0).select(F.col("key").alias("query"), F.col("key").alias(key), F.lit(0.0).alias("similarity"), F.lit(1).alias("rank"))
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
