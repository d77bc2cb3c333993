"""Cross-tokenizer alignment, the quality classifier and phrase mining against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandlake.llm import alignment, kernels, phrases, quality

ODD = [None, "", " ", "  two  spaces ", "tab\tand\nline \n next", "<|endoftext|> <s></s> <unk>", "it's 12,000 €… naïve", "a ▁ b", "日本語 テキスト", "é  x  y", "\x00\x01 z", "x" * 300, "end ", "\n", "a\n b"]

# ---- alignment ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def two():
    return alignment.pair(f"{alignment.FOLDER}/{alignment.A_FILE}", f"{alignment.FOLDER}/{alignment.B_FILE}")


def aligned(two, text):
    """Tokens of the whole text and its groups, by walking both sides."""
    if not text:
        return [], []
    a, b, raw = two._a.encode(" " + text, add_special_tokens=False).ids, two._b.encode(text), (" " + text).encode()
    if not b"".join(two.a_bytes[i] for i in a) == raw == b"".join(two.b_bytes[i] for i in b):
        return [], []
    spans = [[], []]
    for side, ids, table in ((0, a, two.a_bytes), (1, b, two.b_bytes)):
        at = 0
        for i in ids:
            spans[side].append((at, at + len(table[i]), i))
            at += len(table[i])
    both = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups = [[[i for s, e, i in side if lo <= s and e <= hi] for side in spans] for lo, hi in zip([0, *both], both)]
    links, j = [], 0
    for s, e, i in spans[0]:
        while spans[1][j][1] <= s:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][0] < e:
            links.append((i, spans[1][k][2]))
            k += 1
    return groups, links


def expected(two, texts):
    found = [aligned(two, t) for t in texts]
    count = Counter(x for _, links in found for x in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for groups, links in found:
        s = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(s.encode()).hexdigest() if s else ""))
    return out


def prose(rng, n):
    return "".join(rng.choice(["the ", "The\n", "naïve ", "straße, ", "don't ", "x  y ", "12345 ", "unbelievably ", "日本 ", "a.b(c) ", "\t", " "]) for _ in range(n))


def test_alignment(spark, two, monkeypatch):
    rng = random.Random(4)
    texts = [*ODD, *ODD, *(prose(rng, rng.randrange(1, 60)) for _ in range(150)), prose(rng, 4000)]
    rows = [(None if i == 3 else i // 2, t, "x") for i, t in enumerate(texts)]  # repeated and null ids, and a column named like one of the result
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_a string").repartition(3)
    got = alignment.measure(df).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted((-1 if r[0] is None else r[0], *x) for r, x in zip(rows, expected(two, texts), strict=True))
    assert alignment.measure(df.limit(0)).count() == 0


def test_alignment_of_pieces(two, monkeypatch):
    """Texts cut into many parts, and tasks that forget, give the same."""
    rng = random.Random(5)
    texts = [prose(rng, 400) for _ in range(5)] + ["▁ " + prose(rng, 200), "", "one"]
    whole = [aligned(two, t) for t in texts]
    for name in ("_PIECE", "_JOIN", "_FLUSH", "_KNOWN"):
        monkeypatch.setattr(alignment, name, 50)
    for t, (groups, links) in zip(texts, whole, strict=True):
        if not t or not groups:
            continue
        doc, known = alignment._Doc(1), alignment._Known(two)
        for us in alignment.units(t):
            u = known.numbers(us)
            known.learn()
            doc.add(known, u)
        s = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        keys, n = doc.pairs()
        assert doc.sha.hexdigest() == hashlib.sha256(s.encode()).hexdigest()
        assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == Counter((a << 32) | b for a, b in links)


def test_groups(spark, two):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id bigint, text string")
    by = defaultdict(list)
    for r in alignment.align(df).orderBy("id", "part", "group").collect():
        by[r["id"]].append(r)
    for i, t in enumerate(ODD):
        groups, _ = aligned(two, t)
        assert [[list(r["a"]), list(r["b"])] for r in by[i]] == groups
        raw = (" " + (t or "")).encode()
        assert all(b"".join(two.a_bytes[x] for x in r["a"]) == raw[r["start"] : r["end"]] for r in by[i])


# ---- quality --------------------------------------------------------------------------------------------------


def plain_features(text):
    b, tok = text.encode(), re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}, {w.lower() for w in tok}, set(zip(tok, tok[1:]))


def test_features(monkeypatch):
    rng = random.Random(6)
    texts = ["", "a", "ab ab ab", "x y x y", *(prose(rng, rng.randrange(1, 50)) for _ in range(30))]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    got = list(quality.Features().of(data, off))
    for t, x in zip(texts, got, strict=True):
        grams, words, pairs = plain_features(t)
        ones = {int.from_bytes(g) for g in grams if len(g) == 1} | {quality._TWO + int.from_bytes(g) for g in grams if len(g) == 2}
        assert set(x[x < quality._AGAIN]) | {i for i in x if quality._TWO <= i < quality._THREE} == ones
        assert 0 <= len(words) - ((x >= quality._WORD) & (x < quality._PAIR)).sum() <= 1  # hashes may meet
        assert 0 <= sum(len(g) == 3 for g in grams) - ((x >= quality._THREE) & (x < quality._WORD)).sum() <= 2
    assert {quality._AGAIN, quality._AGAIN + 1} <= set(got[2]) and quality._AGAIN not in got[3]
    monkeypatch.setattr(quality, "_PIECE", 16)
    for a, b in zip(got, quality.Features().of(data, off), strict=True):
        assert a.tolist() == b.tolist()


def test_ratio_and_descent():
    rng = np.random.default_rng(7)
    n = np.array([[3.0, 0, 5, 0], [1, 4, 5, 0]])
    want = np.log(((n[1] + 1) / (n[1] + 1).sum()) / ((n[0] + 1) / (n[0] + 1).sum()))
    assert np.allclose(quality.log_count_ratio(n), np.where(n.sum(0) > 0, want, 0))
    x = [(np.sort(rng.choice(40, 6, False)), rng.standard_normal(6)) for _ in range(80)]
    x = [(a, v / np.linalg.norm(v)) for a, v in x]
    y, c = rng.choice([-1.0, 1.0], 80), np.full(80, 0.7)
    dense = np.zeros((80, 40))
    for i, (a, v) in enumerate(x):
        dense[i, a] = v

    def gap(alpha):
        w = (alpha * y) @ dense
        return 0.5 * w @ w + (c * np.maximum(0, 1 - y * (dense @ w))).sum() - (alpha.sum() - 0.5 * w @ w)

    alpha, w = quality.descend(x, y, c, np.zeros(40), np.zeros(80), 300, 1.0, 1)
    assert np.allclose(w, (alpha * y) @ dense) and 0 <= gap(alpha) < 1e-3 and (alpha >= 0).all() and (alpha <= c).all()
    # two slabs, each held back by their number, come to the same optimum
    w, alphas = np.zeros(40), [np.zeros(40), np.zeros(40)]
    for r in range(200):
        steps = [quality.descend(x[i::2], y[i::2], c[i::2], w, alphas[i], 2, 2.0, (r, i)) for i in (0, 1)]
        alphas, w = [s[0] for s in steps], w + steps[0][1] + steps[1][1]
    alpha = np.empty(80)
    alpha[::2], alpha[1::2] = alphas
    assert np.allclose(w, (alpha * y) @ dense) and gap(alpha) < 1e-2


def test_logistic():
    rng = np.random.default_rng(8)
    m = rng.standard_normal(4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * m - 1)))).astype(float)
    a, b = quality.logistic(m, y, np.ones(4000))
    assert abs(a - 2) < 0.25 and abs(b + 1) < 0.2


def test_quality(spark):
    rng = random.Random(9)

    def text(good):
        ws = [rng.choice(["ka", "lomi", "sure", "tan", "vei"]) + rng.choice("aeiou") for _ in range(rng.randrange(5, 60))]
        return " ".join(ws) + "." if good else rng.choice([" | ".join(ws), "!! ".join(w.upper() for w in ws), " ".join(w for w in ws for _ in range(4))])

    rows = [(i, text(i % 6 > 0), 0.1) for i in range(900)] + [(2000, None, 0.1), (2001, "", 0.1), (2002, text(True) * 3000, 0.1), (None, text(True), 0.1), (5, text(True), 0.1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score double").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 6 > 0)) for i in range(800)] + [(None, 1), (7, None), (9, 5), (8, 1), (8, 1)], "doc_id bigint, quality int")
    model = quality.fit(df, labels)
    got = quality.score(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] != 5 and (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 or r["doc_id"] >= 800)]
    assert len(held) > 150 and sum(r["predicted"] == int(r["doc_id"] % 6 > 0) for r in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r for r in got}
    assert by[2000]["score"] == by[2001]["score"] and by[2002]["predicted"] == 1
    again = quality.fit(df, labels)
    assert (again.weight == model.weight).all() and again.slope == model.slope
    many = quality.Model(model.ratio, model.weight, model.slope, model.offset)
    quality_slab, quality._SLAB = quality._SLAB, 8000  # several slabs find the same classes
    try:
        many = quality.fit(df, labels)
    finally:
        quality._SLAB = quality_slab
    other = {r["doc_id"]: r["predicted"] for r in quality.score(df, many).collect() if r["doc_id"] is not None}
    assert sum(other[r["doc_id"]] == r["predicted"] for r in held) >= 0.98 * len(held)


def test_quality_without_classes(spark):
    df = spark.createDataFrame([(i, "word " * i) for i in range(20)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r["score"] for r in quality.score(df, quality.fit(df, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, quality int")
    got = {r["score"] for r in quality.score(df, quality.fit(df, ones)).collect()}
    assert len(got) == 1 and got.pop() > 0.8
    assert quality.score(df.limit(0), quality.fit(df.limit(0), none)).count() == 0


# ---- phrases --------------------------------------------------------------------------------------------------


def mined(rows, least=10, share=50, top=2000):
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for n in (1, 2, 3):
                for i in range(len(ws) - n + 1):
                    f["und" if lang is None else lang][tuple(ws[i : i + n])] += 1
    out = []
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        cand = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        hidden = {part for k, v in cand.items() if len(k) == 3 for part in (k[:2], k[1:]) if part in cand and 100 * v >= share * cand[part]}
        found = []
        for k, a in cand.items():
            if k not in hidden:
                score, _, left, right = min((10**6 * a * a // (c[k[:i]] * c[k[i:]]), i, c[k[:i]], c[k[i:]]) for i in range(1, len(k)))
                found.append((-score, -a, " ".join(k).encode(), a, left, right, n, score))
        found.sort()
        out += [(lang, r + 1, x[2].decode(), *x[3:]) for r, x in enumerate(found[:top])]
    return sorted(out)


def spoken(rng, n):
    return "".join(rng.choice(["the", "of", "Of", "new", "york", "city", "é", "rare%d" % rng.randrange(200)]) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\x0b"]) for _ in range(n))


def test_phrases(spark, monkeypatch):
    rng = random.Random(10)
    rows = [(rng.choice(["en", "en", "en", "fr", None, "und"]), spoken(rng, rng.randrange(1, 80)), "z") for _ in range(400)]
    rows += [("en", "New York City. ", "z")] * 60 + [("en", None, "z"), ("xx", "", "z"), ("yy", " ,;.", "z"), ("fr", "w" * 5000 + " " + spoken(rng, 3000), "z")]
    df = spark.createDataFrame(rows, "lang string, text string, phrase string").repartition(5)
    want = mined([r[:2] for r in rows])
    read = lambda d: sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in d.collect())
    assert len(want) > 100 and read(phrases.mine(df)) == want
    assert read(phrases.mine(df, least=3, share=90, top=40)) == mined([r[:2] for r in rows], 3, 90, 40)
    assert phrases.mine(df.limit(0)).count() == 0
    # the two stages of a large input
    monkeypatch.setattr(phrases, "_COARSE", 2)
    monkeypatch.setattr(phrases, "_TOGETHER", 3)
    assert read(phrases.mine(df)) == want


def test_long_texts_are_read_in_runs(monkeypatch):
    rng = random.Random(11)
    texts = [spoken(rng, 300).encode(), b"x" * 100, b" ", b"", b"a" * 40 + b"." + b"b" * 40]
    whole = [[w for run in phrases.tokens(t) for w in run] for t in texts]
    monkeypatch.setattr(phrases, "_PIECE", 16)
    assert [[w for run in phrases.tokens(t) for w in run] for t in texts] == whole


def test_tries():
    rng = np.random.default_rng(12)
    streams = [rng.integers(0, 9, n) for n in (0, 1, 2, 500, 900)]
    blocks = [b for g in streams for b in phrases._blocks(phrases.trie(g), phrases._cuts(0, 0, 3))]
    assert {b["r"] for b in blocks} <= set(range(8))
    two, n2, three, n3 = phrases.merged(blocks)
    want = Counter((int(a), int(b)) for g in streams for a, b in zip(g, g[1:]) if a and b)
    prefix = phrases.unmix64(two)
    assert {(int(p >> np.uint64(32)), int(p & phrases._LOW)): int(n) for p, n in zip(prefix, n2, strict=True)} == want
    want = Counter(tuple(map(int, x)) for g in streams for x in zip(g, g[1:], g[2:]) if all(x))
    at = prefix[(three >> np.uint64(32)).astype(int)]
    assert {(int(p >> np.uint64(32)), int(p & phrases._LOW), int(w & phrases._LOW)): int(n) for p, w, n in zip(at, three, n3, strict=True)} == want
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    assert (phrases.unmix64(kernels.mix64(x)) == x).all()


def test_scores_are_exact(spark):
    rows = [(10**12 + 7, 10**13 + 1, 10**13 + 9), (10, 10, 10), (10, 33, 97), (10**14, 10**14, 10**14 + 1)]
    df = spark.createDataFrame(rows, "a bigint, l bigint, r bigint")
    got = {tuple(r)[:3]: r["s"] for r in df.withColumn("s", phrases._score(df.a, df.l, df.r)).collect()}
    assert all(got[a, x, y] == 10**6 * a * a // (x * y) for a, x, y in rows)
