"""Minimisers, chains and alignments against plain versions."""

import random

import numpy as np
import pytest

from strandlake.operators import mapping

COMP = str.maketrans("ACGT", "TGCA")


def dna(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def rc(s):
    return s[::-1].translate(COMP)


def plain_minimizers(s, k, w):
    def h(km):
        if set(km) - set("ACGT"):
            return None
        num = lambda x: int("".join(str("ACGT".index(c)) for c in x), 4)
        return min(num(km), num(rc(km))) * mapping.MULTIPLIER % 4**k

    hs = [h(s[i : i + k]) for i in range(len(s) - k + 1)]
    out = set()
    for i in range(max(1, len(hs) - w + 1)):
        part = [(x, i + j) for j, x in enumerate(hs[i : i + w]) if x is not None]
        if part:
            out |= {p for x, p in part if x == min(part)[0]}
    return [(p, hs[p]) for p in sorted(out)]


@pytest.mark.parametrize("k,w", [(5, 4), (15, 10)])
def test_minimizers(k, w, monkeypatch):
    rng = random.Random(k)
    texts = ["", "A", dna(rng, k), dna(rng, k + 2), "A" * 60, "ACGTN" * 20, *(dna(rng, rng.randrange(1, 300)) for _ in range(20)), dna(rng, 300, "ACGTN")]
    for s in texts:
        pos, _, h = mapping.sampled(s.encode(), k, w)
        assert list(zip(pos.tolist(), h.tolist(), strict=True)) == plain_minimizers(s, k, w)
    s = dna(rng, 500)
    pos, _, h = mapping.sampled(s.encode(), k, w)
    back, _, hb = mapping.sampled(rc(s).encode(), k, w)
    assert sorted(zip(len(s) - k - pos, h)) == sorted(zip(back, hb))  # both strands choose the same
    monkeypatch.setattr(mapping, "_PART", 37)
    assert mapping.sampled(s.encode(), k, w)[0].tolist() == pos.tolist()


def test_chain():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 40))
        x, y = rng.integers(0, 25, n), rng.integers(0, 25, n)
        got = mapping.chain(x, y)
        assert (np.diff(x[got]) > 0).all() and (np.diff(y[got]) > 0).all()
        best, order = {}, sorted(range(n), key=lambda i: (x[i], y[i]))
        for i in order:
            best[i] = 1 + max((best[j] for j in best if x[j] < x[i] and y[j] < y[i]), default=0)
        assert len(got) == max(best.values())


def smith_waterman(a, b, match=2, mismatch=4, open_=4, extend=2):
    low = -(10**6)
    h, e = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
    top = 0
    for i in range(1, len(a) + 1):
        f = low
        for j in range(1, len(b) + 1):
            e[i][j] = max(h[i - 1][j] - open_ - extend, e[i - 1][j] - extend)
            f = max(h[i][j - 1] - open_ - extend, f - extend)
            h[i][j] = max(0, h[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else -mismatch), e[i][j], f)
            top = max(top, h[i][j])
    return top


def read_cigar(cigar):
    import re

    return [(int(n), op) for n, op in re.findall(r"(\d+)([SIDX=])", cigar)]


def check(read, target, got):
    """The path that a CIGAR tells is there, and scores what is said."""
    score, q0, q1, t0, t1, edits, cigar = got
    i, j, s, e = 0, t0, 0, 0
    for n, op in read_cigar(cigar):
        if op == "S":
            i += n
        elif op in "=X":
            assert all((read[i + m] == target[j + m]) == (op == "=") for m in range(n))
            s, e = s + n * (2 if op == "=" else -4), e + n * (op == "X")
            i, j = i + n, j + n
        else:
            s, e = s - 4 - 2 * n, e + n
            i, j = (i + n, j) if op == "I" else (i, j + n)
    assert (i, j, s, e) == (len(read), t1, score, edits)


def mutated(rng, s, rate):
    out = []
    for c in s:
        u = rng.random()
        if u < rate:
            out.append(rng.choice(["", c + dna(rng, rng.randrange(1, 4)), dna(rng, 1)]))
        else:
            out.append(c)
    return "".join(out)


def test_banded():
    rng = random.Random(3)
    reads, targets, d = [], [], []
    for n in range(60):
        core = dna(rng, rng.randrange(1, 70))
        target = dna(rng, rng.randrange(0, 20)) + core + dna(rng, rng.randrange(0, 20))
        reads.append(dna(rng, rng.choice([0, 0, 12])) + mutated(rng, core, 0.12) + dna(rng, rng.choice([0, 9])) or "A")
        targets.append(target)
        d.append(rng.randrange(-5, 15))
    got = mapping.banded([r.encode() for r in reads], [t.encode() for t in targets], d, 120)
    for r, t, g in zip(reads, targets, got, strict=True):
        assert g[0] == smith_waterman(r, t)
        check(r, t, g)
    narrow = mapping.banded([r.encode() for r in reads], [t.encode() for t in targets], [0] * 60, 8)
    for r, t, g in zip(reads, targets, narrow, strict=True):
        assert g[0] <= smith_waterman(r, t)
        check(r, t, g)


def test_align(spark):
    rng = random.Random(4)
    repeat = dna(rng, 300)
    genome = [dna(rng, 2500) + repeat + dna(rng, 700), dna(rng, 900) + repeat + dna(rng, 900), dna(rng, 3000) + "N" * 30 + dna(rng, 100), "ACGT" * 100, dna(rng, 8), dna(rng, 1200)]
    reads, truth = [], {}
    for n in range(150):
        c = rng.choice([0, 1, 2, 5])
        size = rng.randrange(120, 500)
        at = rng.randrange(0, len(genome[c]) - size)
        s = mutated(rng, genome[c][at : at + size], rng.choice([0, 0.02, 0.05]))
        s = dna(rng, rng.choice([0, 0, 30])) + s
        reads.append((n, rc(s) if n % 2 else s))
        truth[n] = (c, at, "-" if n % 2 else "+")
    reads += [(900, dna(rng, 200)), (901, None), (902, ""), (903, "ACG"), (904, repeat), (904, "TTTT"), (905, reads[0][1]), (906, "ACGT" * 30)]
    df = spark.createDataFrame(reads, "read int, seq string").repartition(3)
    contigs = spark.createDataFrame(list(enumerate(genome)) + [(77, None)], "contig int, seq string")
    got = {r["read"]: r for r in mapping.align(df, contigs, tile=256).collect()}
    assert {900, 901, 902, 903}.isdisjoint(got) and got[905]["start"] == got[0]["start"]
    assert got[904]["contig"] == 0 and got[904]["edits"] == 0 and got[904]["start"] == 2500  # both places score alike
    assert got[906]["contig"] == 3 and got[906]["edits"] == 0  # only a repeat's seeds
    assert sum(n in got for n in truth) >= 149
    seqs, alike = dict(reads), 0
    for n, (c, at, strand) in truth.items():
        if n in got:
            r = got[n]
            alike += (r["contig"], r["strand"]) == (c, strand) and abs(r["start"] - at) < 60
            s = rc(seqs[n]) if r["strand"] == "-" else seqs[n]
            check(s, genome[r["contig"]], (r["score"], r["q_start"], r["q_end"], r["start"], r["end"], r["edits"], r["cigar"]))
    assert alike >= 145
    for n in list(truth)[:12]:  # no other place is better
        s = seqs[n]
        assert got[n]["score"] == max(smith_waterman(x, g) for g in (genome[0], genome[1], genome[2], genome[5]) for x in (s, rc(s)))
    assert mapping.align(df.limit(0), contigs).count() == 0 and mapping.align(df, contigs.limit(0)).count() == 0


def test_protein_search(spark):
    from strandlake.operators import proteins

    rng = random.Random(7)
    letters = "ARNDCQEGHILKMFPSTWYV"
    scoring = proteins.class_scores()

    def full(a, b):
        low, top = -(10**6), 0
        h, e = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], [[low] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            f = low
            for j in range(1, len(b) + 1):
                e[i][j] = max(h[i - 1][j] - 10, e[i - 1][j] - 1)
                f = max(h[i][j - 1] - 10, f - 1)
                h[i][j] = max(0, h[i - 1][j - 1] + int(scoring.pairs[ord(a[i - 1]), ord(b[j - 1])]), e[i][j], f)
                top = max(top, h[i][j])
        return top

    targets = [(i, dna(rng, rng.randrange(60, 160), letters)) for i in range(25)]
    targets += [(100 + i, targets[i][1][10:50] + dna(rng, 30, letters)) for i in range(8)]
    queries = []
    for i in range(20):
        s = rng.choice(targets)[1]
        s = "".join(rng.choice(letters) if rng.random() < 0.15 else c for c in s)
        queries.append((i, s[: len(s) // 2] + rng.choice(["", "AG", "WWW"]) + s[len(s) // 2 + 1 :]))
    queries += [(90, None), (91, ""), (92, "MK"), (93, "X" * 40)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, seq string")
    got = proteins.search(frame(queries), frame([*targets, (200, None)])).collect()
    top = {r["query"]: r for r in got if r["pos"] == 1}
    assert set(top) == set(range(20))
    for i, s in queries[:20]:
        scores = {t: full(s, x) for t, x in targets}
        best = max(scores.values())
        assert top[i]["score"] == best and top[i]["subject"] == min(t for t, v in scores.items() if v == best)
        assert 0.6 <= top[i]["identity"] <= 1 and 0 < top[i]["cover"] <= 1
    assert proteins.search(frame(queries).limit(0), frame(targets)).count() == 0
