"""Language identification, language-model scoring, vectors, pages and archives."""

import base64
import gzip
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandlake.llm import html, language, lm, vectors, warc
from strandlake.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = {"aa": "ka ki ku ma mi".split(), "bb": "schwer ung lich keit zu".split(), "cc": "é ção ão nha lhe".split()}


def speak(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(1)
    rows = [(i, speak(rng, lang := rng.choice("aa bb cc".split()), rng.randrange(3, 120)), lang) for i in range(360)]
    rows += [(1000, None, "aa"), (1001, "12 34 !!", "bb"), (1002, "", None), (1003, speak(rng, "cc", 9000), None), (None, speak(rng, "aa", 20), None)]
    return rows


# ---- language -------------------------------------------------------------------------------------------------


def test_language(spark, spoken):
    df = spark.createDataFrame([(*r, "x", 0.5) for r in spoken], "doc_id bigint, text string, lang string, lang_pred string, score double")
    net = language.fit(df)
    assert net.langs == ["aa", "bb", "cc"]
    got = language.predict(df, net).collect()
    assert len(got) == len(spoken)
    held = [r for r in got if r["lang"] and r["text"] and r["doc_id"] < 1000 and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 80 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1002)) and by[1003]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = language.accepted(df, net)
    assert kept.columns == df.columns and {r["lang_pred"] for r in kept.collect()} == {"x"} and {1000, 1001, 1002}.isdisjoint({r["doc_id"] for r in kept.collect()})
    again = language.fit(df)
    assert all((a == b).all() for a, b in zip(net.params(), again.params(), strict=True))
    assert language.predict(df.limit(0), net).count() == 0


def test_whole_texts_against_a_plain_forward_pass(spark, spoken, monkeypatch):
    """Every window of a text counts by its bytes, the last one by those that it has; in any number of windows at a time."""
    df = spark.createDataFrame(spoken, "doc_id bigint, text string, lang string")
    net = language.fit(df)
    e = net.embed

    def plain(text):
        b, total = text.encode(), np.zeros(len(net.langs))
        for at in range(0, len(b), language.WINDOW):
            part = b[at : at + language.WINDOW]
            x = part + bytes(language.WINDOW - len(part))
            pooled = []
            for w, f in zip(language.WIDTHS, net.filters, strict=True):
                for c in range(language.FILTERS):
                    pooled.append(max(sum(e[x[i + k]] @ f[k * language.EMBED : (k + 1) * language.EMBED, c] for k in range(w)) for i in range(language.WINDOW - max(language.WIDTHS) + 1)))
            total += len(part) * (np.maximum(np.array(pooled) + net.bias, 0) @ net.out + net.out_bias)
        p = np.exp(total / len(b) - (total / len(b)).max())
        return p / p.sum()

    texts = [t for _, t, _ in spoken if t][:6] + [spoken[3][1] * 4, "x"]
    want = [plain(t) for t in texts]
    model = language.Predictor(net)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for many in (8192, 3, 1):
        monkeypatch.setattr(language, "_TOGETHER", many)
        best, p = model.predict(data, off)
        assert best.tolist() == [int(w.argmax()) for w in want] and np.allclose(p, [w.max() for w in want], atol=1e-4)


def test_language_without_labels(spark, spoken):
    df = spark.createDataFrame([(i, t, None) for i, t, _ in spoken[:5]], "doc_id bigint, text string, lang string")
    assert {r["lang_pred"] for r in language.predict(df, language.fit(df)).collect()} == {"und"}
    one = df.na.fill("xx", ["lang"])
    assert {r["lang_pred"] for r in language.predict(one, language.fit(one)).collect()} == {"xx"}


def test_unlearned_languages_are_rejected(spark, spoken):
    """Texts of a language that no label has go, whether two or three languages were learned; those of the learned ones stay."""
    rng = random.Random(9)
    other = "szcz przy ąść łów żeń wyk".split()
    foreign = [(2000 + i, " ".join("".join(rng.choice(other) for _ in range(rng.randrange(1, 4))) for _ in range(200)), None) for i in range(40)]
    for langs in ("aa bb cc", "aa bb"):
        own = [(i, speak(rng, lang := rng.choice(langs.split()), rng.randrange(40, 300)), lang) for i in range(600)]
        df = spark.createDataFrame(own + foreign, "doc_id bigint, text string, lang string")
        kept = {r["doc_id"] for r in language.accepted(df, language.fit(df)).collect()}
        assert set(range(600)) <= kept and len(kept - set(range(600))) <= 2


def test_sample_is_bounded(spark, spoken):
    """Null and repeated ids, and repeated texts, bring no more to the driver than the parameters say."""
    rng = random.Random(10)
    rows = [(None if i % 2 else 8, speak(rng, "aa" if i % 3 else "bb", 30), "aa" if i % 3 else "bb") for i in range(3000)]
    rows += [(None, "ka ki ku " * 60, "cc")] * 3000
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    sent = []
    train = language.train
    language.train = lambda texts, labels: sent.append((Counter(labels), max(len(t) for t in texts))) or train(texts, labels)
    try:
        language.fit(df, per_lang=50)
        language.fit(df, per_lang=50, total=20)
    finally:
        language.train = train
    assert sent == [({"aa": 50, "bb": 50, "cc": 1}, 3), ({"aa": 6, "bb": 6, "cc": 1}, sent[1][1])]


def test_tables_equal_the_network():
    rng = np.random.default_rng(2)
    net = language.train([language.cut(t) for t in [b"abc abc abd" * 9, b"xyz xzy zzy" * 9] * 4], ["p", "q"] * 4)
    x = rng.integers(0, 256, (70, language.WINDOW)).astype(np.uint8)
    assert np.allclose(language.Predictor(net).logits(x), language._forward(net, x)[3], atol=1e-4)


# ---- language model -------------------------------------------------------------------------------------------


def reference_counts(rows, held=2):
    tok = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t, *_ in rows}
    c = Counter()
    for i, ts in tok.items():
        if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != held:
            c.update(ts)
    return tok, c


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm(spark, spoken, order):
    df = spark.createDataFrame([(*r, 1.0, 2) for r in spoken], "doc_id bigint, text string, lang string, score double, n bigint")
    got = {r["id"]: r for r in lm.score(df, order=order).collect()}
    tok, c = reference_counts(spoken)
    n, v = sum(c.values()), len(c)
    assert set(got) == set(tok)
    for i, ts in tok.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ts), sum(x in c for x in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ts), abs=1e-8)
        assert r["held_out"] == (zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2) and r["score"] < 0
    out = [r for r in got.values() if r["held_out"]]
    if order == 2:
        assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) - 1e-6


def plain_scores(rows, order, rounds=8):
    """Deleted interpolation over dictionaries: (score by position), by the definitions alone."""
    docs = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t, *_ in rows]
    fold = [zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 for r in rows]
    start = ("<s>",)

    def grams(ts):
        line = [start] * (order - 1) + ts
        return [[tuple(line[i + order - k : i + order]) for k in range(1, order + 1)] for i in range(len(ts))]

    def counted(wanted):
        c, total = Counter(), 0
        for ts, f in zip(docs, fold, strict=True):
            if f in wanted:
                total += len(ts)
                c.update(g for gs in grams(ts) for g in gs)
                c.update((start,) * k for k in range(1, order))
        return c, total

    def parts(gs, c, total, v):
        """(value, usable) of the uniform part and of each order, and the bucket of the longest context."""
        out = [(1 / (v + 1), True)]
        for g in gs:
            h = total if len(g) == 1 else c[g[:-1]]
            out.append((c[g] / h if h else 0.0, h > 0))
        return out, min(47, int(h).bit_length())

    c, total = counted({0, 1, 4, 5, 6})
    v = len({g for g in c if len(g) == 1 and g != (start,)})
    w = np.full((48, order + 1), 1 / (order + 1))
    events = [parts(gs, c, total, v) for ts, f in zip(docs, fold, strict=True) if f == 3 for gs in grams(ts)]
    for _ in range(rounds):
        sums = np.zeros_like(w)
        for ps, b in events:
            e = w[b] * [p for p, _ in ps]
            sums[b] += e / e.sum()
        for b in np.flatnonzero(sums.sum(1)):
            w[b] = np.maximum(sums[b] / sums[b].sum(), 1e-12)
        w /= w.sum(1, keepdims=True)
    c, total = counted({0, 1, 3, 4, 5, 6})
    v = len({g for g in c if len(g) == 1 and g != (start,)})
    out = []
    for ts in docs:
        score = 0.0
        for gs in grams(ts):
            ps, b = parts(gs, c, total, v)
            u = w[b] * [ok for _, ok in ps]
            score += math.log10(sum(u / u.sum() * [p for p, _ in ps]))
        out.append(score)
    return out


@pytest.mark.parametrize("order,coarse", [(1, 8), (2, 8), (3, 8), (2, 2), (3, 0)])
def test_score_against_a_plain_em(spark, spoken, order, coarse, monkeypatch):
    """With few coarse ranges slabs ask together, which gives the same."""
    monkeypatch.setattr(lm, "_COARSE", coarse)
    monkeypatch.setattr(lm, "_TOGETHER", 2)
    rows = [r for r in spoken if r[0] is not None]
    got = {r["id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), order=order).collect()}
    for r, want in zip(rows, plain_scores(rows, order), strict=True):
        assert got[r[0]] == pytest.approx(want, rel=1e-5, abs=1e-5)


def test_lm_is_a_distribution(spark):
    """The probabilities of all words, the end and one unknown word add up to one; of bigrams, those after a repeated word are read off score differences."""
    words = "a b c d".split()
    rng = random.Random(0)
    rows = [(i, " ".join(rng.choice(words) for _ in range(6))) for i in range(200)]
    ids = [i for i in range(10**4, 10**5) if zlib.crc32(str(i).encode()) % 7 == 2]
    probes = ["", *words, "zzz"]
    df = spark.createDataFrame(rows + list(zip(ids, probes, strict=False)), "doc_id bigint, text string")
    got = {r["id"]: r["score"] for r in lm.score(df, order=1).collect()}
    end = got[ids[0]]
    assert 10**end + sum(10 ** (got[i] - end) for i, _ in zip(ids[1:], probes[1:], strict=False)) == pytest.approx(1)

    # p(y | x) * e(y) / e(x) from "x y" and "x", p(x | x) from "x x x" and "x x", where e(x) = p(end | x)
    probes = [" ".join(p) for n in (1, 2) for p in itertools.product([*words, "zzz"], repeat=n)] + [f"{w} {w} {w}" for w in words]
    df = spark.createDataFrame(rows + list(zip(ids, probes, strict=False)), "doc_id bigint, text string")
    by = {r["id"]: r["score"] for r in lm.score(df).collect()}
    score = {p: by[i] for i, p in zip(ids, probes, strict=False)}
    for x in words:
        same = 10 ** (score[f"{x} {x} {x}"] - score[f"{x} {x}"])
        assert same == pytest.approx(10 ** (score[f"{x} {x}"] - score[x])) and 0.1 < same < 0.4


def test_weights_and_packing():
    w = lm.usable(np.array([[0.1, 0.3, 0.6]]), np.array([[1, 1, 0]]))
    assert w[0].tolist() == pytest.approx([0.25, 0.75, 0.0])
    x = np.array([1, 300, 2**40], np.uint64)
    assert (lm._unpack(lm._pack(x), np.uint64) == x).all() and len(lm._unpack(lm._pack(x[:0]), np.uint64)) == 0
    k = np.sort(np.random.default_rng(0).integers(0, 2**63, 50).astype(np.uint64))
    assert (np.cumsum(lm._unpack(lm._pack_keys(k, 0, 0), np.uint64), dtype=np.uint64) == k).all()


def test_lm_edges(spark):
    df = spark.createDataFrame([(2, None), (2, None)], "doc_id bigint, text string")
    assert [r["n_tokens"] for r in lm.score(df).collect()] == [1, 1]
    assert lm.score(df.limit(0)).count() == 0


# ---- vectors --------------------------------------------------------------------------------------------------


def test_vectors(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for label in (1, 2, None):
        for _ in range(60):
            base = rng.standard_normal(16)
            for _ in range(rng.choice([1, 1, 2, 6])):
                x = base + rng.standard_normal(16) * rng.choice([0, 0.05, 0.1, 0.2, 0.3])
                rows.append((n, [float(v) for v in x], label))
                n += 1
    rows += [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [None] + [1.0] * 15, 1), (9005, [float("inf")] + [1.0] * 15, 1), (9006, [1.0] * 15, 1), (None, rows[0][1], 1), (3, [2 * v for v in rows[0][1]], 1)]
    good = [(i, np.array(v) / np.linalg.norm(v), lab) for i, v, lab in rows if v and lab and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {(a, b) for a in range(len(good)) for b in range(len(good)) if a != b and good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= 0.93}
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<double>, label int, node bigint, v int")
    got = vectors.near_duplicates(df).collect()
    assert len(got) == len(rows) and len(links) > 100
    want = Counter((good[a][0]) for a, _ in links)
    have = Counter()
    for r in got:
        have[r["id"]] += r["n_links"]
    assert +have == +want
    root = list(range(len(good)))
    for _ in range(40):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    name = {}
    for k, (i, _, _) in enumerate(good):
        name.setdefault(root[k], []).append(i)
    low = {i: min(x for x in g if x is not None) for g in name.values() for i in g if any(x is not None for x in g)}
    assert all(r["component_id"] == low.get(r["id"], r["id"]) for r in got if r["id"] != 3)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_extreme_size(spark):
    rows = [(1, [1e-200, 2e-200], 1), (2, [3e200, 6e200], 1), (3, [2e200, -1e200], 1)]
    got = {r["id"]: r["component_id"] for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_large_cluster_is_counted_exactly(spark, monkeypatch):
    monkeypatch.setattr(vectors, "_CHUNK", 64)
    rng = np.random.default_rng(4)
    base = rng.standard_normal(32)
    x = [base + rng.standard_normal(32) * 0.15 for _ in range(300)]
    u = np.array([v / np.linalg.norm(v) for v in x])
    want = (u @ u.T >= 0.93).sum(1) - 1
    df = spark.createDataFrame([(i, [float(a) for a in v], 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    got = {r["id"]: r["n_links"] for r in vectors.near_duplicates(df, window=16).collect()}
    assert [got[i] for i in range(300)] == want.tolist()


def alike(rng, n, pairs, cosine, dim=64):
    """n unit vectors with a mutual cosine of about ``cosine``; the last ``pairs`` are copies at 0.95 of the first ones."""
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(math.sqrt(cosine) * unit(rng.standard_normal(dim)) + math.sqrt(1 - cosine) * unit(rng.standard_normal((n - pairs, dim))))
    side = rng.standard_normal((pairs, dim))
    side = unit(side - (side * x[:pairs]).sum(1, keepdims=True) * x[:pairs])
    return np.concatenate([x, 0.95 * x[:pairs] + math.sqrt(1 - 0.95**2) * side])


@pytest.mark.parametrize("window,cosine,whole", [(256, 0.88, True), (256, 0.85, False), (256, 0.0, False), (32, 0.7, False)])
def test_vectors_of_an_alike_label(spark, window, cosine, whole):
    n = 4000
    x = alike(np.random.default_rng(6), n, 1000, cosine)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    got = {r["id"]: r["n_links"] for r in vectors.near_duplicates(df, window=window, passes=None if window == 256 else 40, whole=whole).collect()}
    want = (x @ x.T >= 0.93).sum(1) - 1
    have = np.array([got[i] for i in range(n)])
    assert (have == want).all() if whole else have.sum() >= 0.99 * want.sum()


def test_planted_links_in_the_query(spark, tmp_path):
    """The registered query against its SQL on a table with links, which the given ones have none of."""
    import duckdb

    from strandlake.llm import queries

    rng = np.random.default_rng(8)
    rows = []
    for label in (1, 2, 3, None):
        x = alike(rng, 700, 200, 0.3 if label == 2 else 0.0, 32)
        rows += [(len(rows) + i, v.tolist(), label) for i, v in enumerate(x)]
    rows += [(len(rows) + i, rows[i][1], rows[i][2]) for i in range(0, 300, 7)] + [(90_000, None, 1), (90_001, [0.0] * 32, 1)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(f"select vec_id, n_links, component_id, kept from ({queries.ORACLES['op3_embedding_neardup']})").fetchall()
    got = [tuple(r) for r in queries.QUERIES["op3_embedding_neardup"](spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sum(r[1] for r in want) > 1000 and sorted(got) == sorted(want)


def test_candidates_are_not_thinned():
    import pyarrow as pa

    n = 60
    cols = {c: np.zeros(n, np.int64) for c in ("group", "code", "sketch")}
    t = pa.table(cols | {"node": np.arange(n), "i": np.arange(n), "own": np.ones(n, bool), "moved": np.zeros(n, bool)})
    assert len(vectors._compare(256, 0.93)(t)) == n * (n - 1) // 2


def test_passes_follow_the_data():
    x = {c: alike(np.random.default_rng(7), 2000, 0, c) for c in (0.02, 0.85)}
    hit = {c: vectors._hits(v, v.mean(0) * (c > 0.1), 100000, 256, 0.93, 5) for c, v in x.items()}
    assert 0.2 < hit[0.02] < 0.6 and hit[0.85] < 0.5 * hit[0.02]


# ---- pages ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        ("plain &lt;text&gt; &amp;amp; &eacute;", "plain <text> &amp; é"),
        ("<body><nav>m</nav><article><h1>T</h1><p>a<b>b</b>c<br>d<p>e</article><footer>f</footer>", "T\n\nabc d\n\ne"),
        ("<main><div class='sidebar'>s</div><div class='has-sidebar'>x</div><form>f</form></main>", "x"),
        ("<article>one<script>var a='</p>';</script><style>p{}</style><!-- c --> two<section id=comments><p>no</p></section></article>", "one two"),
        ("<div role=navigation>m</div><div hidden>h</div><div style='display: none'>n</div><p>k</p>", "k"),
        ("<article><header><h1>T</h1></header><p>x</p><aside>s</aside></article><article class='comment'>c</article>", "T\n\nx"),
        ("<div class=cookie-banner>c</div><header>site</header><p>x  \n y</p><ul><li>1<li>2</ul><table><tr><td>a<td>b<tr><td>c</table>", "x y\n\n1\n\n2\n\na b\n\nc"),
        ("<p>a < b and c<d </p>", "a < b and c"),
        ("<div class='header-fixed'><div class=sidebar>s<article>t</article></div><main><p>k</p></main></div>", "k"),
        ("<div class=comments><article class=comment>c</article></div><article hidden>h</article><p>k</p>", "k"),
        ("<head><title>T</title><body><article><p>Hello</article>", "Hello"),
        ("<html><head><meta charset=utf-8><script>s</script><link rel=x><p>Para", "Para"),
        ("<head><style>s</style>\n plain text<p>more", "plain text\n\nmore"),
        ("<!--><p>a</p><!-- a > b --><p>b</p><!---><p>c</p>", "a\n\nb\n\nc"),
        ('<p title="a>b">x</p><div id="ads-top">ad</div></div></p>y', "x\n\ny"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


def test_deep_and_long_pages():
    assert html.main_text("<div>" * 5000 + "x" + "</div>" * 3000) == "x"
    assert len(html.main_text("<p>" + "word " * 200000 + "</p>")) == 5 * 200000 - 1


def test_style_tree_removes_what_repeats(spark):
    page = lambda i, own: f"<body><div class=top><p>Welcome to us</p></div><div class=b><p>{own}</p><p>text {i}</p></div><div class=x1><p>All about us and more</p></div></body>"
    rows = [(i, f"http://site.org/{i}", page(i, f"story {i}"), "t") for i in range(8)] + [(90, "http://other.org/", page(1, "lone"), "t"), (91, None, None, "t"), (92, "http://site.org/x", "<article><p>All about us and more</p></article>", "t")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: r for r in html.extract(df).collect()}
    assert got[3]["text"] == "story 3\n\ntext 3" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[90]["text"].startswith("Welcome to us") and got[91]["text"] == "" and got[92]["text"] == "All about us and more"
    assert html.extract(df.limit(0)).count() == 0
    copies = spark.createDataFrame([(i, "http://c.org/", page(0, "s"), "") for i in range(20)], "page_id bigint, url string, html string, text string")
    assert {r["text"] for r in html.extract(copies).collect()} == {html.main_text(page(0, "s"))}


def test_probes_of_content():
    t = html.main_text
    assert t("<main><h1>Title</h1><p>Lead</p><article>story</article></main>") == "Title\n\nLead\n\nstory"
    assert t("<body><p>Long story that goes on</p><article class=card>teaser</article></body>") == "Long story that goes on\n\nteaser"
    assert t('<article><h2 class="social-history">a</h2><div class="widget-body">b</div><section id="menu-of-options">c</section></article>') == "a\n\nb\n\nc"
    assert t("<body><h1>Title</h1><div class=share-buttons>x</div><article><p>a longer story</p></article><div>some links</div></body>") == "Title\n\na longer story"
    assert t("<form id=aspnetForm><h1>T</h1><p>x</p><input value=a></form><form><p>mail</p></form>") == "T\n\nx"
    assert t("<form class=search-box><main><p>x</p></main></form><p>y</p>") == "x"
    for name in ("reader-comments", "user-comments", "sidebar-panel", "cookie-notice", "google-ad", "ad-container", "relatedStories", "newsletter_signup", "promo-box-2", "share-bar"):
        assert t(f"<article><p>x</p><div class='{name}'>y</div></article>") == "x"
    for name in ("no-sidebar", "has-comments", "notice-of-meeting", "menu-recipes", "shared-history", "adage", "loginess"):
        assert t(f"<article><p>x</p><div class='{name}'>y</div></article>") == "x\n\ny"
    assert t("<article><p>x</p><div data-class='ad'>y</div><div class='ad-slot-3'>z</div></article>") == "x\n\ny"


@pytest.mark.parametrize(
    "piece,tail",
    [("<a ", ""), ("<a ", ">"), ("<div>", "</x>" * 60000), ('<a b="', ""), ('<a ">"', ""), ("<a '>\"", "x"), ("<!", ""), ("<!-", ""), ("<b>", "<hr>" * 60000), ("<div>", "<li></li>" * 60000), ("<p", ">"), ("</", ""), ("<script>", ""), ("<div class=x><main></main>", "")],
)
def test_malformed_pages_take_linear_time(piece, tail):
    import time

    page = piece * (300000 // len(piece)) + tail + "end"
    t = time.process_time()
    html.main_text(page)
    assert time.process_time() - t < 15


SITE = "<body><div class=top><p>Welcome to us</p></div><article><h1>{h}</h1><p>{p}</p><h2>Sources</h2><p>{q}</p><div><p>Subscribe now</p><p>It is free</p></div></article><div class=end><p>{end}</p></div></body>"


def site(n):
    rng = random.Random(2)
    words = lambda k: " ".join(rng.choice(["ka", "lo", "mi", "su"]) + str(rng.randrange(10**6)) for _ in range(k))
    return [SITE.format(h=words(4), p=words(30), q=words(20), end="the end") for _ in range(n)]


def test_style_tree_decides_inside_articles(spark):
    """A branch that all pages of a host share goes, its headings and all; what one page alone has stays, as do headings that repeat."""
    rows = [(i, f"http://a.org/{i}", h) for i, h in enumerate(site(12))]
    copy = rows[0][2].replace("Welcome", "Hello")
    rows += [(100 + i, "http://b.org/", copy.replace("the end", f"end {i}")) for i in range(9)]  # copies of one story: nothing is taken from it
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for i in range(12):
        want = [x for x in html.main_text(rows[i][2]).split("\n\n") if x not in ("Subscribe now", "It is free")]
        assert got[i].split("\n\n") == want and "Sources" in want and len(want) == 4
    assert got[104] == html.main_text(copy)


def test_importance_against_brute_force(spark):
    rng = random.Random(5)
    block = lambda: "<div class=m>" + "".join(rng.choice(["<p>one</p>", "<p>two</p>", "<ul><li>three</ul>", f"<p>own {rng.random()}</p>"]) for _ in range(4)) + "</div>"
    pages = [(i, f"http://{'ab'[i % 2]}.org/{i}", f"<body>{block()}<p>all</p></body>") for i in range(24)] + [(50, None, "<p>all</p>"), (51, "http://c.org", "<p>all</p>")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    base = df.select(html._host(df["url"]).alias("host"), "html", "page_id").withColumn("page", df["page_id"])
    _, said = html.site_tree(base, Scratch(spark, "t"), 5)
    got = {(r["host"], r["path"], r["content"], r["item"]): (r["a"], r["b"]) for r in said.collect()}
    want = {}
    for host in ("a.org", "b.org"):
        items, at = {}, {}
        for i, url, h in pages:
            if url and host in url:
                for path, content, item in html.features(html.boxes(html.parse(h))):
                    items.setdefault((path, content), {}).setdefault(item, set()).add(i)
                    at.setdefault(path, set()).add(i)
        for (path, content), by in items.items():
            m = len(at[path])
            if m < 5:
                continue
            n = [len(x) for x in by.values()]
            if content:
                want |= {(host, path - 2**63, True, item - 2**63): (0.0, 1 - math.log(len(x), m)) for item, x in by.items() if len(x) > 1}
            else:
                entropy = -sum(x / sum(n) * math.log(x / sum(n), m) for x in n)
                want[host, path - 2**63, False, None] = (0.9 ** len(n), (1 - 0.9 ** len(n)) * min(1, entropy))
    assert set(got) == set(want) and len(want) > 12
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


# ---- archives -------------------------------------------------------------------------------------------------


def test_archive_round_trip(spark):
    rows = [(3, "http://a/", "<p>é</p>", 1), (1, "http://b/", "<p>é</p>", 1), (2, "http://c/", None, 1), (5, None, "", 1), (7, "u\r\nv", "x" * 300000, 1), (None, "n", "<p>é</p>", 1), (1, "again", "<p>é</p>", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, sha int")
    got = warc.archive(df).collect()
    assert len(got) == len(rows)
    for r in got:
        match = [x for x in rows if x[0] == r["key"]][0]
        data = (match[2] or "").encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
    kinds = sorted((str(r["key"]), r["record_type"], r["refers_to"]) for r in got)
    assert kinds == [("1", "response", None), ("1", "response", None), ("2", "response", None), ("3", "revisit", 1), ("5", "revisit", 2), ("7", "response", None), ("None", "revisit", 1)]
    assert {r["record_type"] for r in warc.archive(df, least=10).where("key in (3, 5)").collect()} == {"response"}
    assert warc.archive(df.limit(0)).count() == 0


def test_index_of_given_archives(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>" * (i + 1)) for i in range(20)], "page_id bigint, url string, html string")
    scratch = Scratch(spark, "t")
    folder = scratch.folder("archives")
    index = warc.write(warc.plan_records(df, scratch), folder, scratch)
    walked = warc.index_archives(spark, folder)
    assert sorted(map(tuple, walked.collect())) == sorted(map(tuple, index.collect()))
    some = warc.read(index.where("key in (3, 4, 17)"), folder)
    assert {r["key"]: bytes(r["payload"]).decode() for r in some.collect()} == {i: f"<p>{i}</p>" * (i + 1) for i in (3, 4, 17)}
    raw = warc.record(1, "u", b"abc", None, False)
    (tmp_path / "p.warc").write_bytes(raw + warc.record(2, "v", b"", None, False))
    assert [r["offset"] for r in warc.index_archives(spark, f"file://{tmp_path}").orderBy("offset").collect()] == [0, len(raw)]
    assert warc.parse(warc.plain(gzip.compress(raw)))["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(raw[:-1])


def test_ranges_merge():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 20 + (64 << 10) + 1, 5), ("b", 0, 5)]
    assert [(f, s, e, len(i)) for f, s, e, i in warc.merged_ranges(rows)] == [("a", 0, 20, 2), ("a", rows[2][1], rows[2][1] + 5, 1), ("b", 0, 5, 1)]
    assert list(warc.merged_ranges([])) == []
