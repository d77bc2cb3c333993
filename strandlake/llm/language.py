"""Language identification by a convolutional network over bytes, trained in numpy.

A window of WINDOW bytes is embedded byte by byte, convolved with filters of widths 2, 3 and 4, max-pooled
over its positions, and classified by softmax. For prediction the embedding and the filters are folded into
tables over byte pairs, so that a filter bank costs one or two row look-ups a position. A text is
cut into windows from its first to its last byte; the logits of its windows are averaged by their
bytes.

Training takes a bounded sample: of every language at most ``per_lang`` different texts, those with the smallest seeded hashes, and ``total`` texts in all; of a text at most ``per_text`` windows, spread evenly over
it, which are cut where the text is. What reaches the driver is bounded by these parameters, however long texts are and however
often an id or a text repeats.

A softmax must choose, whatever it reads. So the net also keeps which runs of four bytes (letters lower-cased, what is no letter
alike) occur in the sample. A text of which less is known than of the sample's texts to each other is like none of the
languages, both by all its runs and by its different ones: the bound is 1 - 4 * (1 - q) - 0.05, where q is what all but 2 % of a fifth of the sample know of their runs from the other four.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandlake.llm import kernels
from strandlake.llm.columns import seeded

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
_VALID = WINDOW - max(WIDTHS) + 1
_RUN = 64
_TOGETHER = 8192
UNKNOWN = "und"
_RUN_BITS, _SLACK = 22, 24
_KIND = np.full(256, 0x20, np.uint8)  # letters count as lower-case ones, other ASCII characters as a space
_KIND[128:] = np.arange(128, 256)
_KIND[97:123] = _KIND[65:91] = np.arange(97, 123)
_BLANK = np.uint32(0x20202020)


@dataclass
class Net:
    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # one of (width * EMBED, FILTERS) for each width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    runs: np.ndarray | None = None  # one bit for each hash of four bytes that the sample has
    least: float = 0.0  # the share of its runs that a text of a learned language has there

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.out_bias]


def windows(data: np.ndarray) -> np.ndarray:
    """All bytes of a text as rows of WINDOW bytes, the last one filled up with zeros; none for an empty text."""
    n = -(-len(data) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, WINDOW)


def cut(text: bytes, per_text: int = 6) -> np.ndarray:
    """At most ``per_text`` windows of a text, spread evenly over it."""
    w = windows(np.frombuffer(text, np.uint8))
    return w[np.unique(np.linspace(0, len(w) - 1, min(per_text, len(w))).astype(int))] if len(w) else w


def _forward(net: Net, x: np.ndarray):
    e = net.embed[x]
    pooled, at = [], []
    for w, f in zip(WIDTHS, net.filters, strict=True):
        conv = sum(e[:, k : k + _VALID] @ f[k * EMBED : (k + 1) * EMBED] for k in range(w))
        best = conv.argmax(1)
        at.append(best)
        pooled.append(np.take_along_axis(conv, best[:, None], 1)[:, 0])
    hidden = np.maximum(np.concatenate(pooled, 1) + net.bias, 0)
    logits = hidden @ net.out + net.out_bias
    return e, at, hidden, logits


def _gradients(net: Net, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    e, at, hidden, logits = _forward(net, x)
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    dh = (p @ net.out.T) * (hidden > 0)
    d_embed, d_filters = np.zeros_like(net.embed), []
    rows = np.arange(len(x))[:, None]
    for i, (w, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        g = dh[:, i * FILTERS : (i + 1) * FILTERS]
        df = np.zeros_like(f)
        for k in range(w):
            part = slice(k * EMBED, (k + 1) * EMBED)
            df[part] = np.einsum("nfe,nf->ef", e[rows, at[i] + k], g)
            np.add.at(d_embed, x[rows, at[i] + k], g[:, :, None] * f[part].T[None])
        d_filters.append(df)
    return [d_embed, *d_filters, dh.sum(0), hidden.T @ p, p.sum(0)]


def train(texts: list[np.ndarray], labels: list[str], *, epochs: int = 4, batch: int = 64, rate: float = 4e-3, seed: int = 3) -> Net:
    """A net for the labels that occur, from the windows of each text; the same for the same texts in the same order."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    number = {lang: i for i, lang in enumerate(langs)}
    scale = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    n = len(WIDTHS) * FILTERS
    net = Net(langs, rng.standard_normal((256, EMBED)).astype(np.float32) * 0.5, [scale(w * EMBED, FILTERS) for w in WIDTHS], np.zeros(n, np.float32), scale(n, max(1, len(langs))), np.zeros(max(1, len(langs)), np.float32))
    size = [len(w) for w in texts]
    if not sum(size):
        return net
    x, y = np.concatenate(texts), np.repeat([number[lang] for lang in labels], size)
    if len(langs) > 1:
        # short texts teach too: some windows keep only a first part
        part = x.copy()
        for i in rng.permutation(len(x))[: len(x) // 4]:
            part[i, rng.integers(12, WINDOW) :] = 0
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.params()]
        step = 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                step += 1
                for p, g, (m, v) in zip(net.params(), _gradients(net, part[at], y[at]), moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    flat = [w.ravel()[: len(w.ravel()) - int((w[-1] == 0).sum())] if len(w) else w.ravel() for w in texts]
    tests = [t for i, t in enumerate(flat) if i % 5 == 0 and len(t) > 3]
    if len(tests) >= 20:
        table = _table([t for i, t in enumerate(flat) if i % 5])
        q = float(np.quantile([table[_runs(t)].mean() for t in tests], 0.02))
        net.least = max(0.0, 1 - 4 * (1 - q) - 0.05)
    net.runs = np.packbits(_table(flat))
    return net


def _runs(data: np.ndarray) -> np.ndarray:
    """The hash of each run of four bytes."""
    d = _KIND[data].astype(np.uint32)
    return (((d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]) ^ _BLANK) * np.uint32(0x9E3779B1)) >> np.uint32(32 - _RUN_BITS)


def _table(texts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(1 << _RUN_BITS, bool)
    out[0] = True  # no letters
    for t in texts:
        out[_runs(t)] = True
    return out


class Predictor:
    """A net folded into look-up tables over bytes and byte pairs."""

    def __init__(self, net: Net):
        self.net = net
        self.known = np.ones(1 << _RUN_BITS, bool) if net.runs is None else np.unpackbits(net.runs).astype(bool)
        one = lambda w, k: net.embed @ net.filters[WIDTHS.index(w)][k * EMBED : (k + 1) * EMBED]
        pair = lambda w, k: (one(w, k)[:, None] + one(w, k + 1)[None]).reshape(65536, FILTERS)
        self.two, self.three, self.third, self.four, self.rear = pair(2, 0), pair(3, 0), one(3, 2), pair(4, 0), pair(4, 2)

    def hidden(self, x: np.ndarray) -> np.ndarray:
        """Pooled filter outputs for rows of WINDOW bytes; _RUN rows at a time stay in the cache."""
        out = np.empty((len(x), len(self.net.bias)), np.float32)
        for i in range(0, len(x), _RUN):
            w = x[i : i + _RUN].astype(np.int32)
            pair = (w[:, :-1] << 8) | w[:, 1:]
            a = pair[:, :_VALID]
            pooled = [
                self.two.take(a, 0).max(1),
                (self.three.take(a, 0) + self.third.take(w[:, 2 : 2 + _VALID], 0)).max(1),
                (self.four.take(a, 0) + self.rear.take(pair[:, 2 : 2 + _VALID], 0)).max(1),
            ]
            out[i : i + _RUN] = np.maximum(np.concatenate(pooled, 1) + self.net.bias, 0)
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(x) @ self.net.out + self.net.out_bias

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language, probability) of each text."""
        size = np.diff(off)
        n = -(-size // WINDOW)
        first = np.concatenate([[0], np.cumsum(n)])
        total = np.zeros((len(size), len(self.net.out_bias)))
        for s in range(0, int(first[-1]), _TOGETHER):  # windows of a long text are not all held at once
            e = min(int(first[-1]), s + _TOGETHER)
            x = np.zeros((e - s, WINDOW), np.uint8)
            doc = np.searchsorted(first, np.arange(s, e), "right") - 1
            weight = np.minimum(WINDOW, size[doc] - (np.arange(s, e) - first[doc]) * WINDOW)
            for d in range(int(doc[0]), int(doc[-1]) + 1):
                lo, hi = max(s, int(first[d])), min(e, int(first[d + 1]))
                part = data[off[d] + (lo - first[d]) * WINDOW : min(off[d + 1], off[d] + (hi - first[d]) * WINDOW)]
                x.reshape(-1)[(lo - s) * WINDOW : (lo - s) * WINDOW + len(part)] = part
            np.add.at(total, doc, weight[:, None] * self.logits(x))
        total /= np.maximum(size, 1)[:, None]
        p = np.exp(total - total.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return best, p[np.arange(len(best)), best]

    def alike(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Whether the runs of each text are known as the sample's are; _SLACK unknown ones, a name or a key, are free."""
        if len(data) < 4:
            return np.ones(len(off) - 1, bool)
        runs = _runs(data)
        hit = np.concatenate([[0], np.cumsum(self.known[runs])])
        n = np.maximum(0, np.diff(off) - 3)
        first = np.minimum(off[:-1], len(runs))
        enough = lambda known, all_: known + _SLACK >= self.net.least * all_
        out = enough(hit[np.minimum(first + n, len(runs))] - hit[first], n)
        for i in np.flatnonzero(~out):  # a text that repeats itself repeats what is unknown: each run counts once
            own = np.unique(runs[first[i] : first[i] + n[i]])
            out[i] = enough(self.known[own].sum(), len(own))
        return out


def remainder(key: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty name."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def _cut(per_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = kernels.utf8(batch.column(2))
            w = [cut(data[off[i] : off[i + 1]].tobytes(), per_text).tobytes() for i in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(w, pa.binary())], names=["y", "h", "w"])

    return run


def fit(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 3, held: int = 1,
    per_lang: int = 800, per_text: int = 6, total: int = 40_000, seed: int = 11,
) -> Net:
    """Train on a bounded sample of the rows that have a text and a language and are not held out.

    Equal texts of a language count once, whatever their ids; null or repeated ids are told apart by their texts. Every language
    gives a text at least, up to ``total`` languages. A null id counts as an empty name for the
    fold. Empty tables, or tables without labels, give a net without languages.
    """
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("y"))
    rows = rows.where(F.col("t").isNotNull() & F.col("y").isNotNull() & (remainder(F.col("k"), folds) != held))
    rows = rows.select("y", seeded(seed, F.col("t")).alias("h"), "t")
    counts = rows.groupBy("y").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "y").limit(total).collect()
    most = max(1, min(per_lang, total // max(1, len(counts))))
    # twice what is needed, as counts are approximate; the texts beyond are never cut
    share = [(r["y"], min(2**63 - 1, int((2 * most + 200) / max(1, r["n"]) * 2**63))) for r in counts]
    upto = docs.sparkSession.createDataFrame(share, f"y {docs.schema[lang].dataType.simpleString()}, upto bigint")
    some = rows.join(F.broadcast(upto), "y").where("h <= upto").select("y", "h", "t")  # ``total`` rows at most
    some = some.mapInArrow(_cut(per_text), "y string, h bigint, w binary").groupBy("y", "h").agg(F.first("w").alias("w"))
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("h"))).where(F.col("r") <= most)
    sample = sorted((r["y"], r["h"], bytes(r["w"])) for r in some.select("y", "h", "w").collect())  # total texts of per_text windows
    rng = np.random.default_rng(seed)
    sample = [sample[i] for i in rng.permutation(len(sample))]
    return train([np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for _, _, w in sample], [y for y, _, _ in sample])


def _scored(texts: pa.Array, model: Predictor, judge: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs i to j of the texts: the number of each one's language, -1 if it has none or, if judged, is like none, and the probability."""
    data, off = kernels.utf8(texts)
    known = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False) & bool(model.net.langs)
    for i, j in kernels.pieces(off, 2 << 20):
        if not model.net.langs:
            yield i, j, np.full(j - i, -1), np.zeros(j - i)
            continue
        part = data[off[i] : off[j]], off[i : j + 1] - off[i]
        best, p = model.predict(*part)
        ok = known[i:j] & model.alike(*part) if judge else known[i:j]
        yield i, j, np.where(ok, best, -1), np.where(ok, p, 0.0)


def predict(docs: DataFrame, net: Net, *, text: str = "text") -> DataFrame:
    """All columns of docs, and lang_pred and score (columns of docs with these names are replaced).

    Texts that are null or have no letter give ``und`` and 0; so does every text if no language was learned. Every
    window of a text counts, however long it is. Empty tables give no rows.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(net)  # 0.6 MB
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        model = Predictor(net)
        for batch in batches:
            for i, j, best, p in _scored(batch.column(names.index(text)), model):
                lang = pa.array([net.langs[b] if b >= 0 else UNKNOWN for b in best], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, lang, pa.array(p)], names=[*names, "lang_pred", "score"])

    fields = [f for f in docs.schema.fields if f.name in names]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, schema)


def accepted(docs: DataFrame, net: Net, *, text: str = "text", least: float = 0.0) -> DataFrame:
    """The rows of docs whose text has letters and is like a learned language.

    That is: enough of its runs of four bytes occur in the sample, and the probability of its language is ``least`` or
    more. Null, empty and letterless texts go, and everything if no language was learned. Repeated rows are
    decided alike. Columns of docs named lang_pred or score are kept as they are.
    """
    sc = docs.sparkSession.sparkContext
    shared, at = sc.broadcast(net), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Predictor(shared.value)
        for batch in batches:
            for i, j, best, p in _scored(batch.column(at), model, True):
                yield batch.slice(i, j - i).filter(pa.array((best >= 0) & (p >= least)))

    return docs.mapInArrow(run, docs.schema)
