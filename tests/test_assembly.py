"""Overlaps, string graphs and unitigs against plain versions."""

import random
from collections import defaultdict

from strandlake.operators import assembly

COMP = str.maketrans("ACGT", "TGCA")


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def rc(s):
    return s[::-1].translate(COMP)


def plain_overlaps(reads, least):
    """(a, b, rev, bases) of the longest exact dovetails and containments."""
    out = {}
    for a, s in reads.items():
        for b, t in reads.items():
            if a < b:
                for rev in (False, True):
                    u = rc(t) if rev else t
                    if u in s or s in u:
                        n = min(len(s), len(u))
                    else:
                        n = max([m for m in range(least, min(len(s), len(u))) if s.endswith(u[:m]) or u.endswith(s[:m])], default=0)
                    if n >= least and n > out.get((a, b), (0, 0))[0]:
                        out[a, b] = (n, rev)
    return {(a, b, rev, n) for (a, b), (n, rev) in out.items()}


def sample(rng, genome, count, size, step=None):
    reads = {}
    for i in range(count):
        at = i * step if step else rng.randrange(0, len(genome) - size)
        s = genome[at : at + size + (0 if step else rng.randrange(0, 40))]
        reads[i] = rc(s) if rng.random() < 0.5 else s
    return reads


def test_overlaps(spark):
    rng = random.Random(1)
    genome = dna(rng, 3000)
    reads = sample(rng, genome, 90, 180)
    rows = [*reads.items(), (500, reads[3]), (501, rc(reads[4])), (502, None), (503, ""), (504, "ACGT"), (505, "A" * 90)]
    df = spark.createDataFrame(rows, "read int, seq string").repartition(4)
    got = assembly.exact(assembly.overlaps(df), df).collect()
    want = {x for x in plain_overlaps({**reads, 504: "ACGT"}, 24)}
    found = {(r["a"], r["b"], r["rev"], r["a_end"] - r["a_start"]) for r in got}
    assert {x for x in found if x[3] >= 24} == want and len(want) > 300
    same = {r["read"]: (r["first"], r["rev"]) for r in assembly.classes(df).collect()}
    assert same[500] == (3, False) and same[501] == (4, True) and 502 not in same and 503 not in same
    # every minimiser counts as frequent: runs of minimisers find what is long enough
    few = {(r["a"], r["b"], r["rev"], r["a_end"] - r["a_start"]) for r in assembly.exact(assembly.overlaps(df, most=6, levels=6, seeds=1), df).collect()}
    assert few <= found | {x for x in few if x[3] < 24} and len({x for x in want if x[3] >= 100} & few) >= 0.95 * len({x for x in want if x[3] >= 100})
    assert assembly.overlaps(df.limit(0)).count() == 0


def test_a_passage_of_many_reads_makes_no_square(spark):
    rng = random.Random(2)
    passage = dna(rng, 400)
    rows = [(i, dna(rng, 60) + passage + dna(rng, 60)) for i in range(120)]
    got = assembly.overlaps(spark.createDataFrame(rows, "read int, seq string"), most=20, levels=3).select("a", "b").collect()
    assert {r["b"] for r in got if r["a"] == 0} == set(range(1, 120))
    assert len(got) < 1500  # of 7140; those whose neighbourhoods agree beyond the passage


def test_string_graph(spark):
    rng = random.Random(3)
    genome = dna(rng, 2600)
    reads = sample(rng, genome, 60, 200)
    reads |= {100 + i: s for i, s in sample(rng, dna(rng, 700), 9, 150, 60).items()}
    df = spark.createDataFrame(list(reads.items()), "read int, seq string")
    found = assembly.exact(assembly.overlaps(df), df)
    gone = {r["read"] for r in assembly.contained(found).collect()}
    edges = {}
    for r in found.collect():
        if r["a"] in gone or r["b"] in gone:
            continue
        front, back = r["a_start"] - r["b_start"], (r["b_len"] - r["b_end"]) - (r["a_len"] - r["a_end"])
        a, b = (r["a"], False), (r["b"], r["rev"])
        if front < 0:
            a, b, front, back = b, a, -front, -back
        edges[a, b] = front
        edges[(b[0], not b[1]), (a[0], not a[1])] = back
    after = defaultdict(list)
    for v, w in edges:
        after[v].append(w)
    kept = {(v, x): n for (v, x), n in edges.items() if not any(edges[v, w] + edges[w, x] <= n for w in after[v] if x in after[w])}
    got = {((r["v"], r["vr"]), (r["w"], r["wr"])): r["length"] for r in assembly.string_graph(found).collect()}
    assert got == kept and len(kept) < len(edges)
    left = df.join(assembly.contained(found), "read", "left_anti")
    placed = assembly.unitigs(assembly.string_graph(found), left)
    seqs = [r["seq"] for r in assembly.spelled(placed, left).collect()]
    assert all(any(s in g or rc(s) in g for s in seqs) for g in (genome, genome)) and max(map(len, seqs)) > 600
    assert {s for s in seqs if s in genome or rc(s) in genome or len(s) < 700}
    assert placed.count() == 2 * left.count()


def walked(vertices, edges):
    """Paths without forks, by walking."""
    after, before = defaultdict(set), defaultdict(set)
    for v, w, _ in edges:
        after[v].add(w)
        before[w].add(v)
    length = {(v, w): n for v, w, n in edges}
    succ = {v: next(iter(ws)) for v, ws in after.items() if len(ws) == 1 and len(before[next(iter(ws))]) == 1}
    pred = {w: v for v, w in succ.items()}
    out = {}

    def walk(head):
        v, n, at = head, 0, 0
        while v not in out:
            out[v] = (head, n, at)
            if v not in succ or succ[v] in out:
                break
            at += length[v, succ[v]]
            v, n = succ[v], n + 1

    for v in vertices:
        if v not in pred:
            walk(v)
    for v in sorted(vertices):
        if v not in out:
            walk(v)
    return out


def test_paths(spark):
    rng = random.Random(4)
    vertices = list(range(300))
    edges = [(i, i + 1, rng.randrange(1, 9)) for i in range(99)]  # one long path
    edges += [(i, i + 1, 2) for i in range(100, 116)] + [(116, 100, 5)]  # a ring
    edges += [(120, 120, 1), (121, 122, 1), (122, 121, 1)]
    edges += [(rng.randrange(130, 300), rng.randrange(130, 300), 3) for _ in range(150)]
    edges = list({(v, w): (v, w, n) for v, w, n in edges}.values())
    got = assembly.paths(spark.createDataFrame([(v,) for v in vertices], "v int"), spark.createDataFrame(edges, "v int, w int, length int"))
    assert {r["v"]: (r["head"], r["n"], r["at"]) for r in got.collect()} == walked(vertices, edges)


def test_debruijn(spark):
    rng = random.Random(5)
    k = 9
    core = dna(rng, 60)
    ring = dna(rng, 40)
    texts = [dna(rng, 80) + core + dna(rng, 50), dna(rng, 30) + rc(core) + "N" + dna(rng, 30), ring + ring[: k - 1], "ACG", "", None]
    kms = defaultdict(int)
    for s in texts:
        for i in range(len(s or "") - k + 1):
            x = s[i : i + k]
            if set(x) <= set("ACGT"):
                kms[min(x, rc(x))] += 1
    v = {y for x in kms for y in (x, rc(x))}
    edges = [(a, a[1:] + c, 1) for a in v for c in "ACGT" if a[1:] + c in v]
    by = defaultdict(list)
    for x, (head, n, _) in walked(v, edges).items():
        by[head].append((n, x))
    want = set()
    for head, l in by.items():
        l.sort()
        if min(x for _, x in l) <= min(rc(x) for _, x in l):
            s = head[: k - 1] + "".join(x[-1] for _, x in l)
            want.add((min(s, rc(s)), len(l)))
    df = spark.createDataFrame([(s,) for s in texts], "seq string")
    assert {(r["seq"], r["kmers"]) for r in assembly.debruijn_unitigs(df, k).collect()} == want
    assert any(len(s) == 40 + k - 1 for s, _ in want)
    assert assembly.debruijn_unitigs(df, k, least=2).count() >= 1 and assembly.debruijn_unitigs(df.limit(0), k).count() == 0
