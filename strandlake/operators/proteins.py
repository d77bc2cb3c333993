"""Protein search with scores, and the choice of genes on two strands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake import workspace
from strandlake.functions.sequence import CODONS
from strandlake.operators.mapping import Scoring, aligned, chains
from strandlake.operators.sketches import kmer_rows

#: Classes of amino acids that replace each other (Murphy et al., 2000).
ALIKE = "LVIM C A G ST P FYW EDNQ KR H".split()


def class_scores(same: int = 5, alike: int = 1, other: int = -3, unknown: int = -1) -> Scoring:
    """Substitution scores by a rule: the same residue, one of its class, any other; X and other letters count as unknown. Gaps of n residues cost 9 + n."""
    pairs = np.full((256, 256), unknown, np.int32)
    letters = [ord(c) for c in "".join(ALIKE)]
    pairs[np.ix_(letters, letters)] = other
    for group in ALIKE:
        members = [ord(c) for c in group]
        pairs[np.ix_(members, members)] = alike
    pairs[letters, letters] = same
    return Scoring(pairs, 9, 1)


def reduced(seq: Column) -> Column:
    """The sequence with one letter for each class of residues."""
    return F.translate(F.upper(seq), "".join(ALIKE), "".join(g[0] * len(g) for g in ALIKE))


def search(queries: DataFrame, targets: DataFrame, *, k: int = 5, most: int = 500, pad: int = 32, ratio: float = 0.5, least_score: int = 40, least_identity: float = 0.0, least_cover: float = 0.0, scoring: Scoring | None = None) -> DataFrame:
    """(query, subject, score, identity, cover, q_start, q_end, s_start, s_end, pos): local alignments of proteins (id, seq), the best of each pair.

    Seeds are k-mers of residue classes, so that replaced residues of a class do no harm. Seeds that more than ``most`` targets hold are left out, but a query
    with no others keeps its rarest at all its places. Chains with ``ratio`` of the seeds of the query's longest are aligned in a band ``pad`` wider than their diagonals.
    identity is that of the aligned columns, cover the aligned part of the query; pos ranks a query's hits by score, then subject. Null and
    short sequences find nothing; of rows with one id the first sequence in order counts. A query of m residues takes m times its band in bytes.
    """
    one = lambda d, c: workspace.table(d.where(F.col("seq") != "").groupBy(F.col("id").alias(c)).agg(F.min(F.upper("seq")).alias("seq")), c)
    q, t = one(queries, "query"), one(targets, "subject")
    cut = lambda d, c, p: kmer_rows(d.withColumn("r", reduced(F.col("seq"))), "r", k, c).select(c, F.col("pos").cast("bigint").alias(p), F.xxhash64("km").alias("h"))
    ts = workspace.table(cut(t, "subject", "y"), "targets")
    n = ts.select("h", "subject").distinct().groupBy("h").agg(F.count("*").alias("n"))
    known = workspace.table(cut(q, "query", "x").join(n, "h"), "seeds")
    rare = known.where(F.col("n") <= most)
    lost = known.join(rare.select("query").distinct(), "query", "left_anti").groupBy("query").agg(F.min(F.struct("n", "h")).alias("s"))
    seeds = rare.drop("n").unionByName(known.join(lost.select("query", F.col("s.h").alias("h")), ["query", "h"]).drop("n"))
    anchors = seeds.join(ts, "h").select("query", "subject", F.lit(False).alias("rev"), "x", "y")
    found = workspace.table(chains(anchors, "query", "subject"), "chains")
    top = found.groupBy("query").agg(F.max("seeds").alias("top"))
    found = found.join(top, "query").where(F.col("seeds") >= F.lit(ratio) * F.col("top")).select("query", "subject", "lo", "hi")
    pairs = found.join(q.withColumnRenamed("seq", "qs"), "query").join(t.withColumnRenamed("seq", "ts"), "subject")
    pairs = pairs.select("query", "subject", "lo", "hi", F.length("qs").alias("len"), F.col("qs").cast("binary").alias("q"), F.col("ts").cast("binary").alias("t"))
    got = aligned(pairs, pad, scoring or class_scores()).where(F.col("score") >= least_score)
    columns = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[=XID]"), F.lit(1)), F.lit(0), lambda s, x: s + x.cast("int"))
    got = got.withColumn("identity", 1 - F.col("edits") / columns).withColumn("cover", (F.col("q1") - F.col("q0")) / F.col("len"))
    best = got.groupBy("query", "subject").agg(F.max_by(F.struct("score", "identity", "cover", "q0", "q1", "t0", "t1"), F.struct("score", "identity", "cover", -F.col("t0"), -F.col("q0"))).alias("m"))
    best = best.select("query", "subject", "m.*").where((F.col("identity") >= least_identity) & (F.col("cover") >= least_cover))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "subject")
    names = {"q0": "q_start", "q1": "q_end", "t0": "s_start", "t1": "s_end"}
    return best.withColumnsRenamed(names).withColumn("pos", F.row_number().over(w).cast("bigint"))


# ---- genes ------------------------------------------------------------------------------------------------------

_BASE = np.full(256, 4, np.uint8)
_BASE[list(b"ACGTacgt")] = [0, 1, 2, 3] * 2
_AMINO = np.frombuffer("".join(CODONS["ACGT"[i // 16] + "ACGT"[i // 4 % 4] + "ACGT"[i % 4]] for i in range(64)).encode() + b"X|", np.uint8)
_TURN = bytes.maketrans(b"ACGTacgt", b"TGCAtgca")
#: The codon of three bases as digits of 6: 64 if one is another letter (4), 65 if one is behind a sequence (5).
_CODON = np.array([64 + (5 in x) if max(x) > 3 else x[0] * 16 + x[1] * 4 + x[2] for x in np.ndindex(6, 6, 6)], np.uint8)
#: Bases of the sequences that are searched at a time; a longer sequence is searched whole.
_BLOCK = 1 << 18


def blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """The place of the first and the sequences of each block of rows; null is empty."""
    seqs = [s or b"" for s in batch.column(column).to_pylist()]
    size = np.cumsum([len(s) for s in seqs])
    at = 0
    while at < len(seqs):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _BLOCK, "right")))
        yield at, seqs[at:end]
        at = end


def codons(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The codon that begins at each base, and where each sequence begins there: at multiples of 3, so that every third codon is of one frame."""
    room = np.array([(len(s) // 3 + 1) * 3 for s in seqs], np.int64)
    begin = np.cumsum(room) - room
    b = np.concatenate([_BASE[np.frombuffer(b"".join(s.ljust(n) for s, n in zip(seqs, room.tolist())), np.uint8)], [np.uint8(5)] * 2])
    for k in range(3):  # one to three places are behind a sequence
        behind = begin + np.array([len(s) for s in seqs], np.int64) + k
        b[behind[behind < begin + room]] = 5
    return _CODON[b[:-2] * np.uint8(36) + b[1:-1] * np.uint8(6) + b[2:]], begin


def frames(c: np.ndarray, frame: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codons, first, stop): the codons of a frame, and in them the places of the first start codon behind a stop and of the next stop, with ``least`` codons or more before it."""
    c = c[frame::3]
    amino = _AMINO[c]
    end = np.flatnonzero((amino == ord("*")) | (amino == ord("|")))
    start = np.append(np.flatnonzero(amino == ord("M")), len(c))
    first = start[np.searchsorted(start, np.append(0, end[:-1] + 1)[: len(end)])]
    open_ = (end - first >= least) & (amino[end] == ord("*"))
    return c, first[open_], end[open_]


def choose(start: np.ndarray, end: np.ndarray, score: np.ndarray, overlap: int) -> list[int]:
    """The compatible frames with the largest sum of scores: by their ends in order, each begins at most ``overlap`` bases before the one before it ends. O(n log n)."""
    order = np.lexsort((start, end))
    before = np.minimum(np.arange(len(order)), np.searchsorted(end[order], start[order] + overlap, "right"))
    best, back = [0.0], [0]  # of the first n frames; the frames left before the last one taken, -1 if it is not
    for k, x in zip(before.tolist(), score[order].tolist()):
        taken = best[k] + x
        more = taken > best[-1]
        back.append(k if more else -1)
        best.append(taken if more else best[-1])
    out, n = [], len(order)
    while n:
        if back[n] < 0:
            n -= 1
        else:
            out.append(int(order[n - 1]))
            n = back[n]
    return out[::-1]


def coding_model(contigs: DataFrame, *, least: int = 30, long: int = 100) -> np.ndarray:
    """The log-odds of each codon: its share among the codons of frames of ``long`` codons or more, over its share among all codons of all six frames, counts plus one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 66), np.int64)
        for batch in batches:
            for _, seqs in blocks(batch, 0):
                for some in (seqs, [s.translate(_TURN)[::-1] for s in seqs]):
                    c, _ = codons(some)
                    n[0] += np.bincount(c, minlength=66)
                    for f in range(3):
                        own, first, stop = frames(c, f, max(least, long))
                        for a, b in zip(first.tolist(), stop.tolist()):
                            n[1] += np.bincount(own[a:b], minlength=66)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], 64)), pa.array(np.tile(np.arange(64), 2)), pa.array(n[:, :64].ravel())], names=["side", "codon", "n"])

    rows = contigs.select(F.col("seq").cast("binary").alias("s")).mapInArrow(run, "side bigint, codon bigint, n bigint")
    n = np.zeros((2, 64))
    for r in rows.groupBy("side", "codon").agg(F.sum("n").alias("n")).collect():  # 128 rows
        n[r["side"], r["codon"]] = r["n"]
    share = (n + 1) / (n + 1).sum(1, keepdims=True)
    return np.append(np.log(share[1] / share[0]), 0.0)


def genes(contigs: DataFrame, *, least: int = 30, long: int = 100, overlap: int = 60, model: np.ndarray | None = None) -> DataFrame:
    """(contig, strand, start, end, score): the genes of contigs (contig, seq) on both strands.

    A frame scores the log-odds of its codons (``coding_model``, learned from the contigs' own long frames unless given), and of each contig the compatible
    frames with the largest sum are chosen, two neighbours with at most ``overlap`` bases in common. Null and short sequences have none. A contig is
    one task's row; its frames are a small part of it.
    """
    if model is None:  # they are read twice
        contigs = workspace.table(contigs.select("contig", "seq"), "contigs")
    odds = coding_model(contigs, least=least, long=long) if model is None else model
    kind = contigs.schema["contig"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, seqs in blocks(batch, 1):
                size, found = np.array([len(s) for s in seqs]), []
                for minus, some in enumerate((seqs, [s.translate(_TURN)[::-1] for s in seqs])):
                    c, begin = codons(some)
                    for f in range(3):
                        own, first, stop = frames(c, f, least)
                        row = np.searchsorted(begin, 3 * first, "right") - 1
                        a, b = f + 3 * first - begin[row], f + 3 * (stop + 1) - begin[row]
                        score = np.array([odds[own[x:y]].sum() for x, y in zip(first.tolist(), stop.tolist())])
                        found.append((row, np.full(len(row), minus), *((size[row] - b, size[row] - a) if minus else (a, b)), score))
                row, minus, a, b, score = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(row, kind="stable")  # a contig's frames together, by strand, frame and place
                ends = np.searchsorted(row[order], np.arange(len(seqs) + 1))
                taken = [own[choose(a[own], b[own], score[own], overlap)] for own in (order[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist()) if x < y)]
                if taken:
                    k = np.concatenate(taken)
                    cols = [batch.column(0).take(pa.array(at + row[k])), pa.array(np.array(["+", "-"])[minus[k]]), pa.array(a[k]), pa.array(b[k]), pa.array(score[k])]
                    yield pa.RecordBatch.from_arrays(cols, names=["contig", "strand", "start", "end", "score"])

    return contigs.select("contig", F.col("seq").cast("binary").alias("s")).mapInArrow(run, f"contig {kind}, strand string, start bigint, end bigint, score double")
