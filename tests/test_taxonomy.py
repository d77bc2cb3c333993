"""Trees, taxa of reads and sketches against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandlake.operators import sketches, taxonomy

COMP = str.maketrans("ACGT", "TGCA")


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def canon(s, k):
    kms = (s[i : i + k] for i in range(len(s) - k + 1))
    return [min(x, x[::-1].translate(COMP)) for x in kms if set(x) <= set("ACGT")]


def way(parent, v):
    out = [v]
    while parent[out[-1]] is not None:
        out.append(parent[out[-1]])
    return out


def lca(parent, nodes):
    ways = [way(parent, v) for v in nodes]
    return next(v for v in ways[0] if all(v in w for w in ways))


def test_classification(spark):
    rng, k = random.Random(1), 7
    parent = {0: None} | {i: rng.randrange(max(0, i - 4), i) for i in range(1, 60)}  # deep
    tree = taxonomy.Tree(spark.createDataFrame(list(parent.items()), "node int, parent int"))
    assert {(r["node"], r["ancestor"], r["up"]) for r in tree.above.collect()} == {(v, a, i) for v in parent for i, a in enumerate(way(parent, v))}
    first = {r["node"]: (r["first"], r["last"], r["depth"]) for r in tree.places.collect()}
    assert sorted(x[0] for x in first.values()) == list(range(60))
    for v in parent:
        below = {first[u][0] for u in parent if v in way(parent, u)}
        assert below == set(range(first[v][0], first[v][1] + 1)) and first[v][2] == len(way(parent, v)) - 1
    core = dna(rng, 40)
    refs = [(rng.randrange(60), dna(rng, 60) + rng.choice([core, "", dna(rng, 9)]) + "N" + dna(rng, 20)) for _ in range(40)] + [(999, dna(rng, 50)), (3, None)]
    taxa = defaultdict(set)
    for t, s in refs:
        if t in parent and s:
            for x in canon(s, k):
                taxa[x].add(t)
    known = {x: lca(parent, ts) for x, ts in taxa.items()}
    got = taxonomy.kmer_taxa(spark.createDataFrame(refs, "taxon int, seq string"), tree, k)
    assert {r["km"]: r["taxon"] for r in got.collect()} == known
    reads = [(i, dna(rng, rng.randrange(0, 60)) + rng.choice(refs[:40])[1][:30]) for i in range(60)] + [(100, None), (101, ""), (102, "N" * 30), (5, core)]
    hits = defaultdict(Counter)
    for i, s in reads:
        for x in canon(s or "", k):
            if x in known:
                hits[i][known[x]] += 1
    want = {}
    for i, n in hits.items():
        score = {t: sum(n[a] for a in way(parent, t)) for t in n}
        top = max(score.values())
        want[i] = (lca(parent, [t for t, v in score.items() if v == top]), top, sum(n.values()))
    df = spark.createDataFrame(reads, "read int, seq string")
    found = taxonomy.classify(df, got, tree, k)
    assert {r["read"]: (r["taxon"], r["score"], r["kmers"]) for r in found.collect()} == want
    own = Counter(t for t, _, _ in want.values())
    clade = Counter()
    for t, n in own.items():
        for a in way(parent, t):
            clade[a] += n
    rows = {r["taxon"]: (r["clade"], r["own"]) for r in taxonomy.report(found, tree).collect()}
    assert rows == {t: (n, own[t]) for t, n in clade.items()}
    assert taxonomy.classify(df.limit(0), got, tree, k).count() == 0


def test_sketches_by_prefixes(spark):
    rng, k = random.Random(2), 11
    core, seqs = dna(rng, 900), []
    for i in range(40):
        s = core if i % 2 else dna(rng, 900)
        rate = rng.choice([0, 0.002, 0.02])
        seqs.append((i, "".join(rng.choice("ACGT") if rng.random() < rate else c for c in s)[: rng.randrange(300, 900)]))
    seqs += [(50, None), (51, "ACG"), (52, core), (53, core)]
    sketch = sketches.frac_sketch(spark.createDataFrame(seqs, "id int, s string"), "id", "s", k, 4)
    by = defaultdict(set)
    for r in sketch.collect():
        by[r["id"]].add(r["h"])
    kms = {i: len(set(canon(s or "", k))) for i, s in seqs}
    assert all(abs(len(by[i]) - n / 4) < 5 * (n * 3 / 16) ** 0.5 + 1 for i, n in kms.items())
    for least in (0.8, 0.97):
        want = {(a, b): len(by[a] & by[b]) for a in by for b in by if a < b and by[a] and by[b] and len(by[a] & by[b]) >= least**k * min(len(by[a]), len(by[b])) - 1e-9}
        got = sketches.sketch_ani(sketch, k, least).collect()
        assert {(r["a"], r["b"]): r["shared"] for r in got} == want and len(want) > 100
    truth = {i: set(canon(s or "", k)) for i, s in seqs}
    inside = 0
    for r in got:
        exact = (len(truth[r["a"]] & truth[r["b"]]) / min(len(truth[r["a"]]), len(truth[r["b"]]))) ** (1 / k)
        inside += abs(r["identity"] - exact) <= r["error"] + 0.01
    assert inside >= 0.97 * len(got)


def test_sketches_of_frequent_hashes_are_compared_without_a_shuffle_of_pairs(spark, monkeypatch):
    """Small sketches that share a hash with nearly all others: pairs are counted in blocks, also when a block passes its bound."""
    rng = random.Random(5)
    by = {i: {1} | {rng.randrange(2, 400) for _ in range(rng.choice([0, 1, 3, 40]))} for i in range(300)} | {900: {10**12}, 901: set(range(2, 400))}
    sketch = spark.createDataFrame([(i, h) for i, hs in by.items() for h in hs], "id int, h bigint")
    want = {(a, b): len(by[a] & by[b]) for a in by for b in by if a < b and len(by[a] & by[b]) >= 0.9**15 * min(len(by[a]), len(by[b])) - 1e-9 and by[a] & by[b]}
    for hashes, pairs in ((1 << 19, 1 << 21), (200, 50)):
        monkeypatch.setattr(sketches, "_HASHES", hashes)
        monkeypatch.setattr(sketches, "_PAIRS", pairs)
        x = sketches.sketch_ani(sketch, 15, 0.9)
        got = x.collect()
        assert {(r["a"], r["b"]): r["shared"] for r in got} == want and len(got) == len(want) > 5000
        assert "Exchange" not in x._jdf.queryExecution().executedPlan().toString()
    assert sketches.sketch_ani(sketch.limit(0), 15).count() == 0


def test_hashes_of_most_sketches_are_met_only_by_those_that_need_them(monkeypatch):
    """Sketches of 40 hashes that share four with all others are no pairs: hardly any meeting is counted; those of 12 are, and some share more."""
    rng = random.Random(8)
    by = {i: {1, 2, 3, 4, *rng.sample(range(10, 10**6), 36 if i % 100 else 8)} for i in range(1500)}
    for i in range(0, 1500, 50):
        by[i + 1] |= set(list(by[i])[:9])
    need = lambda a, b: 0.9**15 * min(len(by[a]), len(by[b])) - 1e-9
    want = {(a, b): len(by[a] & by[b]) for a in by for b in by if a < b and len(by[a] & by[b]) >= need(a, b)}
    monkeypatch.setattr(sketches, "_PAIRS", 1000)
    blocks = []
    for part in (0, 1):
        ids = [i for i in by if i % 2 == part]
        t = sketches._block(part, pa.table({"id": ids, "hs": [sorted(by[i]) for i in ids]}), 0.9**15, np.array([3, 1, 2, 4], np.int64)).combine_chunks()
        blocks.append(sketches._Block(*(t.column(j)[0] for j in range(1, t.num_columns))))
    got, steps = {}, 0
    for a, b, same in ((0, 0, True), (1, 1, True), (0, 1, False), (1, 0, False)):
        a, b = blocks[a], blocks[b]
        start = np.arange(1, len(a.n) + 1) if same else np.searchsorted(b.n, a.n, "left" if a is blocks[0] else "right")
        common = np.intersect1d(a.u, b.u)
        for l, r, count in sketches._met(a, b, a.rows(np.searchsorted(a.u, common)), b.rows(np.searchsorted(b.u, common)), start, 0.9**15):
            steps += 1
            for x, y, n in zip(a.ids.take(pa.array(l)).to_pylist(), b.ids.take(pa.array(r)).to_pylist(), count.tolist()):
                assert got.setdefault((min(x, y), max(x, y)), n) == n
    assert got == want and len(want) > 15000
    assert steps < 200  # of 1,000 meetings; all pairs meet 4.5 million times


def test_sketches_by_numbers_are_those_by_bytes(spark):
    """MD5 of many k-mers at a time, other letters, cases, null, short and equal sequences, and names that occur twice."""
    rng = random.Random(9)
    for k in (1, 4, 11, 15, 23, 31):
        numbers = [rng.randrange(4**k) for _ in range(9000 if k == 15 else 50)]
        kms = ["".join("ACGT"[n >> 2 * (k - 1 - i) & 3] for i in range(k)) for n in numbers]
        assert sketches.md5_numbers(np.array(numbers, np.int64), k).tolist() == [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) * 8 for x in kms]
    long = dna(rng, 70000)
    seqs = [(1, long), (1, long[::-1]), (2, long[:200] + "N" + long[200:400].lower()), (3, None), (4, ""), (5, "ACG"), (6, long[:15]), (7, "é" + long[:60]), *((i, long[i : i + 90]) for i in range(10, 600))]
    df = spark.createDataFrame(seqs, "id int, s string").repartition(3)
    md5 = lambda km: F.shiftleft(F.conv(F.substring(F.md5(km.cast("binary")), 1, 15), 16, 10).cast("bigint"), 3)
    for scaled in (1, 5):
        got = [tuple(r) for r in sketches.frac_sketch(df, "id", "s", 15, scaled, numbers=sketches.md5_numbers).collect()]
        assert sorted(got) == sorted(tuple(r) for r in sketches.frac_sketch(df, "id", "s", 15, scaled, md5).collect()) and len(got) == len(set(got)) > 1000
    exact, rounded = (sorted(map(tuple, sketches.sketch_ani(spark.createDataFrame(got, "id int, h bigint"), 15, 0.9, d).collect())) for d in (None, 6))
    assert len(exact) > 1000 and all(x[:3] == y[:3] and all(abs(v - w) <= 5.001e-7 and round(w, 6) == w for v, w in zip(x[3:], y[3:])) for x, y in zip(exact, rounded, strict=True))


def test_numbered_kmers_count_as_their_bytes(spark):
    """Votes and contamination by numbers: other letters and cases as they are, names that repeat count once, k up to 31 and beyond; no k-mer is shuffled where names are a row's own."""
    rng = random.Random(7)
    letters = "ACGT" * 6 + "Nacé"
    ref = [(i % 3, "".join(rng.choice(letters) for _ in range(90))) for i in range(12)]
    cut = lambda: (lambda s, a: s[a : a + rng.randrange(5, 90)])(rng.choice(ref)[1], rng.randrange(40))
    rows = [(i // 2, cut() + cut()) for i in range(60)] + [(90, None), (91, ""), (None, ref[0][1]), (None, ref[1][1])]
    kms = lambda s, k: {s[i : i + k] for b in [(s or "").encode()] for s in [b] for i in range(len(b) - k + 1)}
    reference = spark.createDataFrame(ref, "taxon int, seq string")
    for own in (False, True):
        some = [r for i, r in enumerate(rows) if not own or i % 2 == 0 and r[0] is not None]
        df = spark.createDataFrame(some, "id int, seq string")
        for k in (1, 4, 9, 31, 40):
            by = defaultdict(set)
            for i, s in some:
                by[i] |= kms(s, k)
            known = defaultdict(set)
            for t, s in ref:
                known[t] |= kms(s, k)
            every = set().union(*known.values())
            assert {r["id"]: r["hits"] for r in sketches.contaminated(df, reference, "id", "seq", k).collect()} == {i: len(x & every) for i, x in by.items() if x & every}
            votes = {i: max((len(x & y), -t) for t, y in known.items()) for i, x in by.items() if x & every}
            assert {r["id"]: (r["votes"], -r["taxon"]) for r in sketches.taxon_votes(df, reference, "id", "seq", "taxon", k).collect()} == votes
    x = sketches.kmer_numbers(spark.createDataFrame([("AcGTN" * 3 + "ACGTA",)], "s string"), "s", 4, canonical=True).join(spark.createDataFrame([("ACGT",)], "w string").select(sketches.kmer_number(F.col("w")).alias("km")), "km")
    assert x.count() == 4
