"""Minimisers, chains of seeds and alignments with gaps.

A sequence is sampled by its minimisers, the k-mers whose hash is least in some window of w k-mers; a k-mer and its
reverse complement count as one, so both strands meet. Seeds that two sequences share are chained where they
run in the same order in both, and the chain's surroundings are aligned with affine gap costs in a band. Sequences are cut, chained and
aligned in Arrow batches; joins, counts and choices between candidates are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake import workspace
from strandlake.functions import sequence as S

_U = np.uint64
#: An odd multiplier; modulo 4^k it maps k-mers onto hashes one to one.
MULTIPLIER = 0x1E3779B97F4A7C15
_CODE = np.full(256, 4, np.uint8)
_CODE[list(b"ACGT")] = _CODE[list(b"acgt")] = range(4)
_PART = 1 << 20
_CELLS = 1 << 24
_NONE = ~_U(0)


def hashes(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each k-mer of 2-bit codes (4: no base) the hash of it or its reverse complement, whichever is the smaller number, and whether that is the complement."""
    n = max(0, len(codes) - k + 1)
    ahead, back, bad = np.zeros(n, _U), np.zeros(n, _U), np.zeros(n, bool)
    for i in range(k):
        c = codes[i : i + n]
        bad |= c > 3
        ahead = (ahead << _U(2)) | (c & 3).astype(_U)
        back |= (3 - (c & 3)).astype(_U) << _U(2 * i)
    h = (np.minimum(ahead, back) * _U(MULTIPLIER)) & _U((1 << 2 * k) - 1)
    h[bad] = _NONE
    return h, back < ahead


def sampled(seq: bytes, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, whether the complement counts, hashes) of the minimisers of a sequence, in order; ties in a window all count.

    A sequence with fewer than w k-mers is one window. K-mers with other letters than ACGT are never chosen. Long sequences are read in parts.
    """
    codes = _CODE[np.frombuffer(seq, np.uint8)]
    pos, rev, hs = [np.zeros(0, np.int64)], [np.zeros(0, bool)], [np.zeros(0, _U)]
    last = -1
    for at in range(0, max(1, len(codes) - k + 1), _PART):
        h, r = hashes(codes[at : at + _PART + w + k - 2], k)
        if len(h) < (w if at else 1):  # no window begins here
            break
        width = min(w, len(h))
        n = len(h) - width + 1
        least = h[:n].copy()
        for o in range(1, width):
            np.minimum(least, h[o : o + n], out=least)
        chosen = np.zeros(len(h), bool)
        for o in range(width):
            chosen[o : o + n] |= h[o : o + n] == least
        i = np.flatnonzero(chosen & (h != _NONE))
        i = i[i + at > last]  # windows of two parts overlap
        if len(i):
            last = int(i[-1] + at)
        pos.append(i + at)
        rev.append(r[i])
        hs.append(h[i])
    return np.concatenate(pos), np.concatenate(rev), np.concatenate(hs)


def minimizers(rows: DataFrame, name: str, seq: str, k: int = 15, w: int = 10) -> DataFrame:
    """(name, len, pos, rev, h) of all minimisers; null and short sequences have none. k is odd, so that no k-mer is its own complement, and at most 31."""
    if k % 2 == 0 or not 1 <= k <= 31:
        raise ValueError("k must be odd and at most 31")
    kind = rows.schema[name].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = batch.column(1)[i].as_py()
                if s:
                    pos, rev, h = sampled(s, k, w)
                    cols = [batch.column(0).take(pa.array(np.full(len(pos), i))), pa.array(np.full(len(pos), len(s))), pa.array(pos), pa.array(rev), pa.array(h.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, names=[name, "len", "pos", "rev", "h"])

    return rows.select(name, F.col(seq).cast("binary").alias("__s")).mapInArrow(run, f"`{name}` {kind}, len bigint, pos bigint, rev boolean, h bigint")


# ---- chains -----------------------------------------------------------------------------------------------------


def chain(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of a longest run of seeds that grows strictly in x and in y.

    Seeds are taken by x, of equal x the larger y first, so that no two of one x follow each other; a Fenwick tree over the ranks of y keeps the best run that
    ends below each. O(n log n).
    """
    order = np.lexsort((-y, x))
    rank = np.unique(y, return_inverse=True)[1] + 1
    if len(order) < 2 or (np.all(np.diff(x[order]) > 0) and np.all(np.diff(rank[order]) > 0)):
        return order
    size = int(rank.max())
    tree = [(0, -1)] * (size + 1)
    before = [-1] * len(order)
    best = (0, -1)
    for i in order.tolist():
        top, r = (0, -1), int(rank[i]) - 1
        while r > 0:
            if tree[r][0] > top[0]:
                top = tree[r]
            r &= r - 1
        before[i] = top[1]
        mine, r = (top[0] + 1, i), int(rank[i])
        if mine[0] > best[0]:
            best = mine
        while r <= size:
            if mine[0] > tree[r][0]:
                tree[r] = mine
            r += r & -r
    out, i = [], best[1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1])


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Groups of rows that agree in the first ``keys`` columns, from batches sorted by them; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)]
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        if held and any(held[-1].column(c)[held[-1].num_rows - 1] != batch.column(c)[0] for c in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def chains(anchors: DataFrame, a: str, b: str, *, spread: int = 64) -> DataFrame:
    """(a, b, rev, seeds, x0, x1, y0, y1, lo, hi): the chains of each pair, from anchors (a, b, rev, x, y).

    Anchors are parted where their sorted diagonals y - x leave a gap of more than ``spread``, and each part gives its longest chain:
    first and last seed in both, and the smallest and largest diagonal. Repeated anchors count once.
    """
    kinds = [anchors.schema[c].dataType.simpleString() for c in (a, b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, 3):
            xy = np.unique(np.column_stack([t.column("x").to_numpy(), t.column("y").to_numpy()]), axis=0)
            d = xy[:, 1] - xy[:, 0]
            order = np.argsort(d, kind="stable")
            rows = []
            for part in np.split(order, np.flatnonzero(np.diff(d[order]) > spread) + 1):
                p = xy[np.sort(part)]
                c = p[chain(p[:, 0], p[:, 1])]
                e = c[:, 1] - c[:, 0]
                rows.append((len(c), c[0, 0], c[-1, 0], c[0, 1], c[-1, 1], e.min(), e.max()))
            head = [t.column(i).slice(0, 1).combine_chunks().take(pa.array([0] * len(rows))) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*head, *(pa.array(np.array(v, np.int64)) for v in zip(*rows))], names=[a, b, "rev", "seeds", "x0", "x1", "y0", "y1", "lo", "hi"])

    dealt = anchors.select(a, b, "rev", "x", "y").repartition(a, b).sortWithinPartitions(a, b, "rev")
    return dealt.mapInArrow(run, f"`{a}` {kinds[0]}, `{b}` {kinds[1]}, rev boolean, seeds bigint, x0 bigint, x1 bigint, y0 bigint, y1 bigint, lo bigint, hi bigint")


# ---- alignment --------------------------------------------------------------------------------------------------


def plain_scores(match: int = 2, mismatch: int = -4) -> np.ndarray:
    """The score of two characters by their codes."""
    return np.where(np.eye(256, dtype=bool), match, mismatch).astype(np.int32)


@dataclass(frozen=True)
class Scoring:
    """Scores of pairs of characters, and what a gap of n of them costs: open_ + n * extend."""

    pairs: np.ndarray = field(default_factory=plain_scores)
    open_: int = 4
    extend: int = 2


def banded(reads: list[bytes], targets: list[bytes], diagonals: list[int], half: int, scoring: Scoring = Scoring()) -> list[tuple[int, int, int, int, int, int, str]]:
    """Local alignments with affine gaps, all pairs of a batch at once, row by row of the reads.

    Cell (i, o) of a pair stands for base i of the read and base i + diagonal + o - half of its target. A gap along the
    target within a row is a running maximum. Returns (score, read from, read to, target from, target to, edits, CIGAR) with = X I D and soft clips; of
    alignments with the same score the one that ends first.
    """
    count, wide, rows = len(reads), 2 * half + 1, max(map(len, reads), default=0)
    pairs, open_, extend = scoring.pairs, scoring.open_, scoring.extend
    size = np.array([len(r) for r in reads])
    r = np.zeros((count, rows), np.uint8)
    reach = rows + wide
    t = np.zeros((count, reach), np.uint8)  # t[:, i + o] is the target's base of cell (i, o); 0 where there is none
    for n, (read, target, d) in enumerate(zip(reads, targets, diagonals, strict=True)):
        r[n, : len(read)] = np.frombuffer(read, np.uint8)
        first = d - half
        lo, hi = max(0, first), min(len(target), first + reach)
        if hi > lo:
            t[n, lo - first : hi - first] = np.frombuffer(target, np.uint8)[lo:hi]
    h, e = np.zeros((count, wide + 1), np.int32), np.full((count, wide + 1), -(1 << 20), np.int32)
    trace = np.zeros((rows, count, wide), np.uint8)
    best, at = np.zeros(count, np.int32), np.zeros((count, 2), np.int64)
    slope = np.arange(wide, dtype=np.int32) * extend
    for i in range(rows):
        base = t[:, i : i + wide]
        diag = h[:, :wide] + np.where(base == 0, -(1 << 20), pairs[r[:, i : i + 1], base])
        grown = e[:, 1:] - extend
        up = np.maximum(h[:, 1:] - (open_ + extend), grown)
        flat = np.maximum(np.maximum(diag, up), 0)
        run = np.maximum.accumulate(flat + slope, axis=1) - slope
        side = np.full_like(flat, -(1 << 20))
        side[:, 1:] = run[:, :-1] - (open_ + extend)
        new = np.maximum(flat, side)
        kind = np.where(new <= 0, 0, np.where(new == diag, 1, np.where(new == up, 2, 3))).astype(np.uint8)
        kind |= (grown > h[:, 1:] - (open_ + extend)).astype(np.uint8) << 2  # the gap in the target goes on upwards
        kind[:, 1:] |= (side[:, :-1] - extend > flat[:, :-1] - (open_ + extend)).astype(np.uint8) << 3  # the gap in the read goes on to the left
        trace[i] = kind
        h[:, :wide], h[:, wide] = new, 0
        e[:, :wide], e[:, wide] = up, -(1 << 20)
        o = new.argmax(1)
        top = new[np.arange(count), o]
        better = (top > best) & (i < size)
        best[better], at[better, 0], at[better, 1] = top[better], i, o[better]
    out = []
    for n in range(count):
        if best[n] <= 0:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        i, o = (int(v) for v in at[n])
        path, state = [], 0
        end = (i + 1, i + o + diagonals[n] - half + 1)
        while i >= 0 and 0 <= o < wide:
            cell = trace[i, n, o]
            if state == 0:
                state = cell & 3
                if state == 0:
                    break
            if state == 1:
                path.append("=" if r[n, i] == t[n, i + o] else "X")
                i, state = i - 1, 0
            elif state == 2:
                path.append("I")
                state = 2 if cell & 4 else 0
                i, o = i - 1, o + 1
            else:
                path.append("D")
                state = 3 if cell & 8 else 0
                o -= 1
        start = (i + 1, i + o + diagonals[n] - half + 1)
        path.reverse()
        edits = sum(c != "=" for c in path)
        cigar = [(start[0], "S")] if start[0] else []
        k = 0
        while k < len(path):
            j = k
            while j < len(path) and path[j] == path[k]:
                j += 1
            cigar.append((j - k, path[k]))
            k = j
        if end[0] < size[n]:
            cigar.append((int(size[n]) - end[0], "S"))
        out.append((int(best[n]), start[0], end[0], start[1], end[1], edits, "".join(f"{c}{op}" for c, op in cigar)))
    return out


_ALIGNED = "score bigint, q0 bigint, q1 bigint, t0 bigint, t1 bigint, edits bigint, cigar string"


def aligned(pairs: DataFrame, pad: int, scoring: Scoring = Scoring()) -> DataFrame:
    """Adds the alignment of read ``q`` to window ``t`` near diagonals lo to hi; pairs of like bands and lengths are aligned together."""
    names = [c for c in pairs.columns if c not in ("q", "t")]
    at = [pairs.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, t = batch.column("q").to_pylist(), batch.column("t").to_pylist()
            lo, hi = batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
            middle, half = (lo + hi) // 2, -(-((hi - lo + 1) // 2 + pad) // 16) * 16
            size = np.array([len(s) for s in q], np.int64)
            order, k = np.lexsort((size, half)), 0
            while k < len(order):
                j = k + 1
                while j < len(order) and half[order[j]] == half[order[k]] and (j + 1 - k) * int(size[order[j]]) * (2 * int(half[order[k]]) + 1) <= _CELLS:
                    j += 1
                some = order[k:j]
                got = banded([q[i] for i in some], [t[i] for i in some], [int(middle[i]) for i in some], int(half[some[0]]), scoring)
                cols = [batch.column(c).take(pa.array(some)) for c in at]
                cols += [pa.array(v, pa.string() if n == 6 else pa.int64()) for n, v in enumerate(zip(*got))]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "score", "q0", "q1", "t0", "t1", "edits", "cigar"])
                k = j

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields if f.name in names)
    return pairs.mapInArrow(run, f"{fields}, {_ALIGNED}")


def _windows(chained: DataFrame, contigs: DataFrame, tile: int) -> DataFrame:
    """Adds t, the bases from w0 to w1 of the contig. Contigs are met in tiles, so that no row carries a whole one."""
    tiles = contigs.select("contig", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / tile).cast("int"))).alias("tile"), "seq")
    tiles = tiles.select("contig", "tile", F.upper(F.col("seq").substr(F.col("tile") * tile + 1, F.lit(tile))).alias("part"))
    x = chained.select("*", F.explode(F.sequence(F.floor(F.col("w0") / tile).cast("int"), F.floor((F.col("w1") - 1) / tile).cast("int"))).alias("tile"))
    x = x.join(tiles, ["contig", "tile"])
    keep = chained.columns
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tile", "part"))), lambda z: z["part"]), "")
    x = x.groupBy(*keep).agg(F.min("tile").alias("__tile"), whole.alias("__t"))
    return x.select(*keep, F.col("__t").substr((F.col("w0") - F.col("__tile") * tile + 1).cast("int"), (F.col("w1") - F.col("w0")).cast("int")).cast("binary").alias("t"))


def align(reads: DataFrame, contigs: DataFrame, *, k: int = 15, w: int = 5, most: int = 64, ratio: float = 0.7, pad: int = 24, tile: int = 1 << 16, least: int = 40) -> DataFrame:
    """(read, contig, strand, start, end, q_start, q_end, score, edits, cigar): the best alignment of each read (read, seq) to the contigs (contig, seq).

    Seeds are minimisers that the contigs hold at most ``most`` times; a read that has none of these takes its rarest one at all its places, so that reads from repeats are placed
    too. Chains with at least ``ratio`` of the seeds of the read's longest are aligned, in a band ``pad`` wider than their diagonals: match 2, mismatch -4, a gap
    of n bases -4 - 2 n, ends clipped where that scores more. start, end and the CIGAR run along the contig's forward strand, q_start and q_end along
    the read as it is aligned (reverse-complemented on strand ``-``). Of the places that were aligned ties go to the smaller contig, then strand ``+``, then start; a read from
    inside a tandem repeat fits at many, of which its chain is one. Reads without a
    seed, or whose best score is below ``least``, have no row. Equal reads are aligned once; of rows with one name and different sequences
    the best alignment counts. A read of m bases takes m times its band in bytes.
    """
    named = reads.select("read", F.upper("seq").alias("seq")).where("seq <> ''")
    work = workspace.table(named.groupBy("seq").agg(F.min(F.md5("seq")).alias("id")), "reads")  # each sequence once, however often it occurs
    target = contigs.select("contig", F.upper("seq").alias("seq")).where("seq <> ''")
    qm = minimizers(work, "id", "seq", k, w)
    tm = workspace.table(minimizers(target, "contig", "seq", k, w).select("contig", F.col("pos").alias("tp"), F.col("rev").alias("tr"), "h"), "targets")
    often = tm.groupBy("h").agg(F.count("*").alias("n"))
    known = workspace.table(qm.join(often, "h"), "seeds")
    rare = known.where(F.col("n") <= most)
    lost = known.join(rare.select("id").distinct(), "id", "left_anti").groupBy("id").agg(F.min(F.struct("n", "h")).alias("s"))
    seeds = rare.drop("n").unionByName(known.join(lost.select("id", F.col("s.h").alias("h")), ["id", "h"]).drop("n"))
    x = seeds.join(tm, "h").withColumn("rev", F.col("rev") != F.col("tr"))
    x = x.select("id", "contig", "rev", F.when(F.col("rev"), F.col("len") - k - F.col("pos")).otherwise(F.col("pos")).alias("x"), F.col("tp").alias("y"))
    found = workspace.table(chains(x, "id", "contig"), "chains")
    top = found.groupBy("id").agg(F.max("seeds").alias("top"))
    found = found.join(top, "id").where(F.col("seeds") >= F.lit(ratio) * F.col("top"))
    size = work.select("id", F.length("seq").cast("bigint").alias("len"))
    bound = target.select("contig", F.length("seq").cast("bigint").alias("size"))
    found = found.join(size, "id").join(bound, "contig")
    # what the read may reach on either side of its diagonals
    found = found.select("id", "contig", "rev", "lo", "hi", F.greatest(F.lit(0), F.col("lo") - pad).cast("bigint").alias("w0"), F.least("size", F.col("hi") + F.col("len") + pad).cast("bigint").alias("w1"))
    pairs = _windows(found.where("w1 > w0").distinct(), target, tile).join(work, "id")
    pairs = pairs.select("id", "contig", F.when(F.col("rev"), "-").otherwise("+").alias("strand"), "w0", (F.col("lo") - F.col("w0")).alias("lo"), (F.col("hi") - F.col("w0")).alias("hi"), F.when(F.col("rev"), S.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).cast("binary").alias("q"), "t")
    got = aligned(pairs, pad).where(F.col("score") >= least)
    got = got.select("id", F.struct((-F.col("score")).alias("loss"), "contig", "strand", (F.col("w0") + F.col("t0")).alias("start"), (F.col("w0") + F.col("t1")).alias("end"), "q0", "q1", "edits", "cigar").alias("m"))
    best = got.groupBy("id").agg(F.min("m").alias("m"))
    back = named.join(work, "seq").select("read", "id").join(best, "id").groupBy("read").agg(F.min("m").alias("m"))
    return back.select("read", "m.contig", "m.strand", "m.start", "m.end", F.col("m.q0").alias("q_start"), F.col("m.q1").alias("q_end"), (-F.col("m.loss")).alias("score"), "m.edits", "m.cigar")
