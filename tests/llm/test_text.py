"""Mixing, sharding, decontamination, line and document near-duplicates against brute force and edge cases."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import decontamination, graph, kernels, lines, minhash, mixing, sharding
from strandlake.llm.scratch import Scratch

SCHEMA = "doc_id bigint, text string, source string, row string, size bigint, h bigint, shard string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, rows):
    """Rows (doc_id, text, source) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    long = prose(rng, 20000, 10**6)
    rows = [(None, None, None), (1, "", "a"), (2, " \t\n", "a"), (3, "one", None), (3, "one", None), (4, long, "b"), (5, long, "b"), (6, prose(rng, 30), "a")]
    return docs(spark, rows)


# ---- mixing ---------------------------------------------------------------------------------------------------


def water(sizes, weights, share, cap):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while True:
        level = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if level[s] > cap * sizes[s] + 1e-12]
        if not over:
            return out | level
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)


def test_mix_targets_and_copies(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, int(rng.paretovariate(1.2) * 20)), rng.choice(["a", "a", "a", "b", "é", "Z", None])) for i in range(1500)]
    got = mixing.mix(docs(spark, rows)).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1500))
    sizes = {}
    for r in got:
        assert r["size"] == len(WORD.findall(rows[r["doc_id"]][1])) and 0 <= r["copies"] <= 2
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = water(sizes, (5, 2, 1), 1.5, 2)
    for s, size in sizes.items():
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {size}
        assert mine[0]["target"] == pytest.approx(want[s], rel=1e-9)
        assert sum(r["copies"] * r["size"] for r in mine) == pytest.approx(want[s], rel=0.005)
    again = mixing.mix(docs(spark, rows)).select("row.doc_id", "copies").collect()
    assert dict(map(tuple, again)) == {r["doc_id"]: r["copies"] for r in got}


def test_mix_rates_solve_the_dual(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(1, 200)), "ab"[i % 2]) for i in range(400)]
    got = mixing.mix(docs(spark, rows), weights=(1, 6)).select("row.source", "size", "rate", "target").collect()
    for s in "ab":
        mine = [r for r in got if r["source"] == s and r["size"]]
        assert sum(r["rate"] * r["size"] for r in mine) == pytest.approx(mine[0]["target"], rel=1e-7)
        lam = {round(math.log(r["rate"]) / r["size"], 9) for r in mine if r["rate"] < 2 - 1e-9}
        assert len(lam) <= 1 or max(lam) - min(lam) < 1e-7


def test_mix_edges(spark, odd):
    got = mixing.mix(odd)
    assert got.count() == 8
    assert {r["copies"] for r in got.where("size = 0").collect()} == {1}
    out = mixing.repeated(got, odd.columns)
    assert out.columns == odd.columns and out.where("doc_id = 1").count() == 1
    assert mixing.mix(odd.limit(0)).count() == 0
    hot = docs(spark, [(i, "a b c d", "s") for i in range(3000)] + [(9999, "q " * 30, "t")])
    x = mixing.mix(hot).where("row.source = 't'").first()
    assert x["copies"] * x["size"] == x["target"] == 60


@pytest.mark.parametrize("ids", ["null", "equal", "rows"])
def test_mix_of_rows_without_ids(spark, ids):
    """Null or equal ids, and rows repeated in everything, are told apart: the mix takes what it should."""
    rng = random.Random(3)
    text = [prose(rng, rng.choice([5, 20, 80, 200])) for _ in range(400)]
    rows = [(None if ids == "null" else 5, text[0 if ids == "rows" and i % 3 else i], rng.choice("aaabbc")) for i in range(400)]
    got = mixing.mix(docs(spark, rows))
    by = got.groupBy("row.source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in by) == 400
    for r in by:
        assert r["taken"] == pytest.approx(r["target"], rel=0.005) or abs(r["taken"] - r["target"]) <= 3
    again = lambda: sorted((r["row"]["text"], r["row"]["source"], r["copies"]) for r in mixing.mix(docs(spark, rows)).collect())
    assert again() == again()


# ---- sharding -------------------------------------------------------------------------------------------------


def test_shards_match_the_mixture(spark):
    rows = [(i, "t", "abc"[0 if i % 10 < 6 else 1 if i % 10 < 9 else 2]) for i in range(2403)]
    got = sharding.shard(docs(spark, rows), 24).collect()
    by = {k: list(g) for k, g in itertools.groupby(sorted(got, key=lambda r: r["shard"]), key=lambda r: r["shard"])}
    assert sorted(r["doc_id"] for r in got) == list(range(2403)) and sorted(by) == list(range(24))
    counts = [len(g) for g in by.values()]
    assert max(counts) - min(counts) <= 1
    for g in by.values():
        assert sorted(r["slot"] for r in g) == list(range(len(g)))
    for s in "abc":
        n = sum(r[2] == s for r in rows) / 24
        assert all(abs(sum(r["source"] == s for r in g) - n) <= 2 for g in by.values())


def test_shard_edges(spark, odd):
    got = sharding.shard(odd, 3)
    assert got.count() == 8 and got.columns == [c for c in odd.columns if c != "shard"] + ["shard", "slot"]
    assert len({(r["shard"], r["slot"]) for r in got.collect()}) == 8
    assert sharding.shard(odd.limit(0), 3).count() == 0
    assert sorted((r["shard"], r["slot"]) for r in sharding.shard(odd.limit(2), 24).collect())[0][1] == 0
    a, b = (sorted((r["doc_id"] or 0, r["shard"], r["slot"]) for r in sharding.shard(odd, 3).where("doc_id <> 3").collect()) for _ in range(2))
    assert a == b


def test_shards_follow_fractional_ranks(spark):
    """Rows sorted by the fractional rank of their place in the seeded order of their source, cut by count."""
    rng = random.Random(8)
    rows = [(i, "t", rng.choice("aaab")) for i in range(500)]
    rows += [(None, f"n{i}", "a") for i in range(60)] + [(7, "same", "b")] * 40 + [(8, "x", None)]
    got = sharding.shard(docs(spark, rows), 7)
    df = docs(spark, rows).drop("shard")
    order = df.select("doc_id", "text", "source", F.xxhash64(*df.columns).alias("tie")).withColumn("h", sharding.seeded(17, F.col("doc_id"), F.col("tie"))).collect()
    line = []
    for s in ("a", "b", None):
        mine = sorted((r["h"], r["tie"], r["doc_id"], r["text"]) for r in order if r["source"] == s)
        line += [((2 * k + 1) / (2 * len(mine)), s is None, s or "", k, x[2], x[3]) for k, x in enumerate(mine)]
    line.sort(key=lambda x: x[:4])
    first = [-(-k * len(line) // 7) for k in range(8)]
    want = sorted((str(x[4]), x[5], k, i - first[k]) for k in range(7) for i, x in enumerate(line) if first[k] <= i < first[k + 1])
    assert sorted((str(r["doc_id"]), r["text"], r["shard"], r["slot"]) for r in got.collect()) == want


# ---- decontamination ------------------------------------------------------------------------------------------


def grams(text, width=5):
    ws = WORD.findall((text or "").lower())
    return {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} - {()}


def test_containment(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, n, 5000)) for i, n in enumerate([3, 5, 6, 9, 30, 60, 200, 33, 47])] + [(9, None), (10, " "), (None, prose(rng, 20, 5000))]
    rows = []
    for i in range(300):
        body = prose(rng, rng.randrange(5, 400), 5000)
        _, t = rng.choice(items)
        if t and t.split() and i % 3 == 0:
            ws = t.split()
            for _ in range(rng.choice([0, 0, 1, len(ws) // 12])):
                ws[rng.randrange(len(ws))] = "zz"
            body = f"{body}\n{' '.join(ws).upper()} {prose(rng, 5, 5000)}"
        rows.append((i, body, "s"))
    rows += [(301, items[0][1], "s"), (302, None, "s"), (303, "", "s"), (None, items[4][1], None)]
    want = {(d, i) for d, t, _ in rows for i, q in items if grams(q) and len(grams(q) & grams(t)) >= 0.8 * len(grams(q)) - 1e-9}
    assert len(want) > 40
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for most in (10**6, 0):  # with probes broadcast, and joined by shuffle
        got = decontamination.contained(docs(spark, rows), bench, max_broadcast=most).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert {r["doc_id"] for r in decontamination.clean(docs(spark, rows), bench).collect()} == {r[0] for r in rows} - {d for d, _ in want}
    assert decontamination.contained(docs(spark, rows).limit(0), bench).count() == 0
    assert decontamination.contained(docs(spark, rows), bench.limit(0)).count() == 0


@pytest.mark.parametrize("q", [1, 2, 7, 30, 200])
def test_hits_needed_is_safe(q):
    k = min(24, q)
    need, have = decontamination.hits_needed(q, k, 0.8, 1e-9), math.ceil(0.8 * q)
    miss = sum(math.comb(have, h) * math.comb(q - have, k - h) for h in range(need) if 0 <= k - h <= q - have) / math.comb(q, k)
    assert 1 <= need <= k and miss <= 1e-9


# ---- near-duplicate documents ---------------------------------------------------------------------------------


def components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("percent,n_bands", [(85, 32), (80, 48)])
def test_minhash_is_whole(spark, percent, n_bands):
    rng = random.Random(percent)
    rows = []
    for g in range(25):
        base = prose(rng, rng.randrange(4, 200), 3000).split()
        for _ in range(rng.choice([1, 2, 3, 20])):
            ws = list(base)
            for _ in range(rng.randrange(0, 1 + len(ws) // 40)):
                ws[rng.randrange(len(ws))] = f"n{rng.random()}"
            rows.append((len(rows) + 10, " ".join(ws).title(), "s"))
    rows += [(1, None, "s"), (2, "", "s"), (3, "\n ", "s"), (4, "just four words here", "s"), (5, "Just  four words here", "s"), (6, rows[0][1], "s")]
    sets = {d: grams((t or "").translate(LOWER)) for d, t, _ in rows}
    hit = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(sets, hit)
    got = minhash.near_duplicates(docs(spark, rows), percent=percent, n_bands=n_bands).collect()
    assert {r["id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(sets[r["id"]]) and r["kept"] == (r["id"] == want[r["id"]]) for r in got)
    kept = minhash.deduplicated(docs(spark, rows), percent=percent, n_bands=n_bands)
    assert {r["doc_id"] for r in kept.collect()} == {d for d in sets if want[d] == d} and kept.columns == docs(spark, rows).columns


def test_minhash_edges(spark, odd):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == 8
    by = {r["id"]: r for r in got}
    assert by[5]["component_id"] == 4 and by[4]["n_shingles"] == 19996 and by[1]["n_shingles"] == 0 and by[None]["kept"]
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 800).astype(np.uint64)
    b = np.concatenate([a[:600], rng.integers(0, 2**63, 200).astype(np.uint64)])
    s = kernels.superminhash([a, b, a[::-1], a[:3], a[:0]], 512)
    assert (s[0] == s[2]).all() and (s[4] == ~np.uint64(0)).all() and len(np.unique(s[3])) > 300
    assert (s[0] == s[1]).mean() == pytest.approx(600 / 1000, abs=0.06)


def test_tokens_and_shingles():
    import pyarrow as pa

    texts = ["A b  C", None, "", "a\tb\nc", "É é", "x" * 3000, "a b c d e f"]
    data, off = kernels.utf8(pa.array(texts).slice(0))
    tok, at = kernels.tokens(data, off)
    assert np.diff(at).tolist() == [3, 0, 0, 3, 2, 1, 6]
    assert (tok[:3] == tok[3:6]).all() and tok[6] != tok[7]
    assert [len(x) for x in kernels.shingles(tok, at, 5)] == [1, 0, 0, 1, 1, 1, 2]
    data2, off2 = kernels.utf8(pa.array(texts).slice(3, 2))
    assert (kernels.tokens(data2, off2)[0] == tok[3:8]).all()


def test_rows_are_decided_one_by_one(spark):
    rng = random.Random(12)
    a, b, c, d, item = (prose(rng, 60, 5000) for _ in range(5))
    rows = [(1, a, "s"), (None, a, "s"), (None, b, "s"), (None, c, "s"), (None, c, "s"), (2, d, "s"), (2, d, "s"), (2, b + " " + c + " " + d, "s")]
    kept = minhash.deduplicated(docs(spark, rows)).collect()
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=key) == sorted([rows[i][:2] for i in (0, 2, 3, 5, 7)], key=key)
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    ws = item.split()
    half = [" ".join(ws[:34]), " ".join(ws[26:])]  # only together they hold the item
    rows = [(None, item, "s"), (None, a, "s"), (None, half[0], "s"), (None, half[1], "s"), (7, item, "s"), (7, b, "s")]
    got = decontamination.clean(docs(spark, rows), bench)
    assert got.columns == docs(spark, rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key) == sorted([rows[i][:2] for i in (1, 2, 3, 5)], key=key)


# ---- lines ----------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("t", [1, 2, 3])
def test_edit_distance(spark, t):
    rng = random.Random(t)
    pairs = []
    for _ in range(600):
        a = [rng.choice("abcé") for _ in range(rng.randrange(t + 2, 40))]
        b = list(a)
        for _ in range(rng.randrange(0, t + 2)):
            k = rng.randrange(len(b))
            rng.choice([lambda: b.insert(k, "x"), lambda: b.pop(k) if len(b) > t + 1 else None, lambda: b.__setitem__(k, rng.choice("abcé"))])()
        if abs(len(a) - len(b)) <= t:
            pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("p", F.split("a", "")).withColumn("q", F.split("b", ""))
    for r in df.select("a", "b", lines.edit_distance("p", "q", t).alias("e")).collect():
        d = edits(r["a"], r["b"])
        assert r["e"] == d if d <= t else r["e"] > t


@pytest.mark.parametrize("few,hot", [(10**6, 256), (0, 1), (10**6, 2)])
def test_line_classes(spark, few, hot, monkeypatch):
    monkeypatch.setattr(lines, "_FEW", few)
    monkeypatch.setattr(lines, "_HOT", hot)
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(1, 60))).strip() for _ in range(60)]
    base += ["one template of lines, " + x[:12] for x in base[:30]]
    rows = []
    for d in range(200):
        out = []
        for _ in range(rng.randrange(0, 5)):
            b = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                k = rng.randrange(len(b) + 1)
                rng.choice([lambda: b.insert(k, "z"), lambda: b[k : k + 1] and b.pop(k), lambda: b.__setitem__(slice(k, k + 1), "y")])()
            out.append("".join(b))
        rows.append((d, "\r\n".join([*out, "", "short", "  "]), "s"))
    rows += [(100, None, "s"), (101, "", "s"), (None, "short", None)]
    occ = [(d, n, x.strip(" \t\n\x0b\x0c\r")) for d, t, _ in rows for n, x in enumerate((t or "").split("\n"))]
    occ = [o for o in occ if o[2]]
    texts = sorted({o[2] for o in occ})
    hit = [(a, b) for a, b in itertools.combinations(texts, 2) if abs(len(a) - len(b)) <= 2 and edits(a, b) <= min(2, max(len(a), len(b)) // 10)]
    assert len(hit) > 100 and any(len(a) < 20 for a, _ in hit)
    comp = components(texts, hit)
    order = lambda o: (o[0] is not None, o[0] or 0, o[1])
    first = {}
    for o in sorted(occ, key=order):
        first.setdefault(comp[o[2]], o[:2])
    degree = {t: sum(t in p for p in hit) for t in texts}
    want = sorted(((o[0] or -1, o[1], degree[o[2]], *first[comp[o[2]]], o[:2] == first[comp[o[2]]]) for o in occ), key=repr)
    got = lines.near_duplicates(docs(spark, rows)).collect()
    assert sorted(((r["doc"] or -1, r["line_no"], r["n_links"], r["class_doc"], r["class_line"], r["kept"]) for r in got), key=repr) == want


def test_lines_of_one_template(spark, monkeypatch):
    """Many lines share most of their segments: refined keys leave few pairs to compare, and lose no link."""
    monkeypatch.setattr(lines, "_HOT", 16)
    rng = random.Random(14)
    texts = sorted({f"GET /index.html status 200 for user {rng.randrange(10**7):07d} at {rng.randrange(10**6):06d}" for _ in range(240)})
    texts += [t[:40] + t[41:] for t in texts[:20]]
    hit = [(a, b) for a, b in itertools.combinations(sorted(set(texts)), 2) if edits(a, b) <= 2]
    got = lines.near_duplicates(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert len(hit) >= 20 and {texts[r["doc"]]: r["n_links"] for r in got} == {t: sum(t in p for p in hit) for t in texts}


def test_line_edges(spark, odd):
    assert lines.near_duplicates(odd.limit(0)).count() == 0
    got = {(r["doc"], r["line_no"]): r["kept"] for r in lines.near_duplicates(odd).collect()}
    assert got[4, 0] and not got[5, 0] and (1, 0) not in got
    x = docs(spark, [(1, "same line here\n\nother", "s"), (2, "same line here\nnew", "s"), (3, None, "s")])
    assert {r["doc_id"]: r["text"] for r in lines.without_repeats(x).collect()} == {1: "same line here\n\nother", 2: "new", 3: None}


def test_components(spark):
    rng = random.Random(8)
    e = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2100)]
    df = spark.createDataFrame([*e, (None, 5), (7, None)], "a bigint, b bigint")
    want = components({x for p in e for x in p}, e)
    got = {r["node"]: r["component"] for r in graph.connected_components(Scratch(spark, "t"), df).collect()}
    assert all(got.get(i, i) == c for i, c in want.items())
    assert graph.connected_components(Scratch(spark, "t"), df.limit(0)).count() == 0
