"""The choice of genes and the mixture over presence patterns against plain versions."""

import itertools
import random

import numpy as np

from strandlake.operators import mixture, proteins


def test_choice_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(0, 9))
        start = rng.integers(0, 100, n)
        end = start + rng.integers(5, 60, n)
        score = np.round(rng.standard_normal(n) + 0.5, 3)
        got = proteins.choose(start, end, score, 10)
        order = np.lexsort((start, end))

        def fits(some):
            return all(start[b] + 10 >= end[a] for a, b in zip(some, some[1:]))

        best = max((sum(score[list(s)]) for k in range(n + 1) for s in itertools.combinations(order, k) if fits(s)), default=0)
        assert fits(got) and abs(sum(score[got]) - best) < 1e-9


def test_genes(spark):
    rng = random.Random(2)
    usual = ["GCT", "GAA", "CTG", "AAA", "GGT", "CGT", "ACC"]
    gene = lambda n: "ATG" + "".join(rng.choice(usual) for _ in range(n)) + "TAA"
    noise = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    contigs, want = [], []
    for c in range(6):
        s = noise(50)
        for k in range(4):
            g = gene(rng.randrange(110, 160))
            s += "TAGTTAATCAG"  # a stop in every frame, so that a gene begins at its own start
            want.append((c, "-" if k % 2 else "+", len(s), len(s) + len(g)))
            s += (turn(g) if k % 2 else g) + "CTAATTAGTCA" + noise(40)
        contigs.append((c, s))
    df = spark.createDataFrame([*contigs, (50, None), (51, ""), (52, "ATGNNN")], "contig int, seq string")
    got = {(r["contig"], r["strand"], r["start"], r["end"]) for r in proteins.genes(df).collect()}
    assert set(want) <= got and len(got) <= len(want) + 4
    assert proteins.genes(df.limit(0)).count() == 0


def test_mixture_equals_numpy(spark):
    rng = np.random.default_rng(3)
    genomes = 8
    x = np.concatenate([rng.random((n, genomes)) < p for n, p in ((60, 0.95), (40, 0.5), (100, 0.08))])
    x = x[x.any(1)]
    rows = [(f, f"g{g}") for f, g in zip(*np.nonzero(x))]
    df = spark.createDataFrame([(int(f), g) for f, g in [*rows, rows[0]]] + [(None, "g1"), (5, None)], "family int, genome string")
    share, weight = mixture.start(genomes, 3)
    for _ in range(40):
        r = mixture.posterior(x.astype(float), share, weight)
        share = np.clip((r.T @ x) / r.sum(0)[:, None], 1e-6, 1 - 1e-6)
        weight = r.sum(0) / len(x)
    order = np.argsort(-share.mean(1), kind="stable")
    want = mixture.posterior(x.astype(float), share[order], weight[order])
    got = {r["family"]: (r["class"], r["p"]) for r in mixture.partition(df).collect()}
    assert len(got) == len(x)
    assert all(np.allclose(got[i][1], want[i], atol=1e-6) and got[i][0] == ("persistent", "shell", "cloud")[want[i].argmax()] for i in range(len(x)))
    assert mixture.partition(df.limit(0)).count() == 0
