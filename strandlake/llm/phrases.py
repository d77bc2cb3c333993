"""Mining collocations: phrases of two and three words that occur together more often than their parts would by chance.

Per language, f(x) counts all contiguous occurrences of x inside pieces of text. A phrase with a = f(phrase) >= ``least`` is a
candidate; cut after its first k words into parts with l and r occurrences it scores floor(10^6 * a * a / (l * r)), and its
lowest cut counts. A candidate that lies inside a longer one which has a good share of its occurrences is dropped.

How it is spread out. A map task packs its texts into shards: a dictionary of words with their counts, and the tokens as numbers in
that dictionary. The dictionaries add up to the first level of the trie, f of all words. A part of a candidate occurs at least as often as
the candidate, so words below ``least`` end a piece from here on, and no count that is needed is lost. Each shard then builds a count trie of
depth three over its tokens: its nodes of two words in the order of a bijective scramble of the prefix, so that ranges of that
order are even however frequent a word is, and below each the third words in order. The trie is serialised sorted, one block
for each range of prefixes, and a range merges the sorted blocks of all shards. Walking the merged trie, a node
of three words finds its left part one level up; its right part, in another range, is its suffix link, which is a
join on two numbers, as are the words of the first level. From the merge on, only nodes with at least ``least`` occurrences move.

A shard sends 2^_COARSE blocks at most. Where the input needs more ranges, _TOGETHER shards meet in each coarse range first, and what they have together
is split finer.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm import kernels
from strandlake.llm.lm import _pack, _rows, _unpack
from strandlake.llm.scratch import Scratch

_U = np.uint64
_LOW = _U(0xFFFFFFFF)
_SHARD = 4 << 20  # tokens
_PIECE = 1 << 20  # bytes
_COARSE, _TOGETHER = 8, 512
_CELLS = 512
_TABLE = bytearray(range(256))
_TABLE[65:91] = range(97, 123)
_TABLE[9] = 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = 10
_TOKEN = re.compile(rb"[^ \n]+|\n")
_BLOCK = pa.schema([("many", pa.int64()), ("p", pa.int64()), ("f", pa.int64()), ("two", pa.binary()), ("n2", pa.binary()), ("below", pa.binary()), ("three", pa.binary()), ("n3", pa.binary())])
_BLOCK_SCHEMA = "many bigint, p bigint, f bigint, two binary, n2 binary, below binary, three binary, n3 binary"


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The text's words, A-Z lower-cased, with a b"\\n" wherever a piece ends; in runs of some _PIECE bytes, as a text may be very long."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        if end < len(text):
            m = re.compile(rb"[\t-\r !,.:;?]").search(text, end)
            end = m.end() if m else len(text)
        yield _TOKEN.findall(text[at:end].translate(bytes(_TABLE)))
        at = end


def _shards(docs: DataFrame) -> DataFrame:
    """(shard, lang, words, counts, tokens): tokens are 0 where a piece ends, else one more than the word's place in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, size = TaskContext.get().partitionId(), 0, 0

        def fresh() -> tuple[dict, list]:
            known: dict[bytes, int] = defaultdict(itertools.count(1).__next__)
            known[b"\n"] = 0
            return known, []

        open_: dict[str, tuple[dict, list]] = defaultdict(fresh)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count, size
            for lang, (known, runs) in open_.items():
                toks = np.concatenate(runs)
                n = np.bincount(toks, minlength=len(known))[1:]
                words = [w.decode("utf-8", "replace") for w in known][1:]
                row = [(part << 24) + count, lang, words, n, int(n.sum()), _pack(toks)]
                types = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["shard", "lang", "words", "counts", "n", "tokens"])
                count += 1
            open_.clear()
            size = 0

        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, off = kernels.utf8(batch.column(1))
            for i, lang in enumerate(langs):
                known, runs = open_[lang]
                for toks in tokens(data[off[i] : off[i + 1]].tobytes()):
                    runs.append(np.fromiter(map(known.__getitem__, toks), np.uint32, len(toks)))
                    size += len(toks)
                runs.append(np.zeros(1, np.uint32))
                if size >= _SHARD:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "shard bigint, lang string, words array<string>, counts array<bigint>, n bigint, tokens binary")


def unmix64(x: np.ndarray) -> np.ndarray:
    """The inverse of kernels.mix64."""
    x = x ^ (x >> _U(31)) ^ (x >> _U(62))
    x = x * _U(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = x ^ (x >> _U(27)) ^ (x >> _U(54))
    x = x * _U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> _U(30)) ^ (x >> _U(60))


def trie(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The count trie of a token stream in which 0 ends a piece: scrambled prefixes of two in order, their counts, then
    (place of the prefix << 32 | third word) in order and their counts."""
    g = g.astype(_U)
    at = np.flatnonzero((g[:-1] > 0) & (g[1:] > 0)) if len(g) > 1 else np.zeros(0, np.int64)
    two, inv, n2 = np.unique(kernels.mix64((g[at] << _U(32)) | g[at + 1]), return_inverse=True, return_counts=True)
    third = np.append(g, _U(0))[at + 2]
    go = third > 0
    three, n3 = np.unique((inv[go].astype(_U) << _U(32)) | third[go], return_counts=True)
    return two, n2, three, n3


def _blocks(t: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], cuts: np.ndarray) -> Iterator[dict]:
    """A trie as one serialised block for each range of prefixes that it has nodes in; cuts are the ranges' first prefixes."""
    two, n2, three, n3 = t
    ends2 = np.append(np.searchsorted(two, cuts), len(two))
    ends3 = np.searchsorted(three, ends2.astype(_U) << _U(32))
    below = np.bincount((three >> _U(32)).astype(np.int64), minlength=len(two)).astype(np.uint32)
    for r in range(len(cuts)):
        (a, b), (c, d) = ends2[r : r + 2], ends3[r : r + 2]
        if b > a:
            yield {"r": r, "two": _pack(np.diff(two[a:b], prepend=_U(0))), "n2": _pack(n2[a:b].astype(_U)), "below": _pack(below[a:b]), "three": _pack((three[c:d] & _LOW).astype(np.uint32)), "n3": _pack(n3[c:d].astype(_U))}


def _cuts(first: int, bits: int, below: int) -> np.ndarray:
    """The first prefixes of the 2^below ranges inside range ``first`` of 2^bits."""
    base = first << (64 - bits) if bits else 0
    return np.array([base + (i << (64 - bits - below)) if bits + below else 0 for i in range(1 << below)], _U)


def merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sum of serialised tries. Every block is a sorted run, which a stable sort merges."""

    def add(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        at = np.flatnonzero(new)
        place = np.empty(len(s), np.int64)
        place[order] = np.cumsum(new) - 1
        return s[at], np.add.reduceat(n[order], at) if len(at) else n[:0], place

    if not rows:
        return (np.zeros(0, _U),) * 4
    two, n2, place = add(np.concatenate([np.cumsum(_unpack(r["two"], _U), dtype=_U) for r in rows]), np.concatenate([_unpack(r["n2"], _U) for r in rows]))
    parent = np.repeat(place, np.concatenate([_unpack(r["below"], np.uint32) for r in rows]).astype(np.int64))
    three = np.concatenate([_unpack(r["three"], np.uint32) for r in rows]).astype(_U)
    key, n3, _ = add((parent.astype(_U) << _U(32)) | three, np.concatenate([_unpack(r["n3"], _U) for r in rows]))
    return two, n2, key, n3


def _together(coarse: int, fine: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        out = [{"many": None, "p": rows[0]["p"], "f": x.pop("r"), **x} for x in _blocks(merged(rows), _cuts(rows[0]["p"], coarse, fine))]
        return pa.Table.from_pylist(out, _BLOCK)

    return run


_NODE = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("w3", pa.int64()), ("a", pa.int64()), ("left", pa.int64()), ("longer", pa.int64())])


def _walk(least: int) -> Callable[[pa.Table], pa.Table]:
    """The nodes of a range's merged trie that occur often enough: of three words with the count of the node above, of two with the largest count among those below."""

    def run(table: pa.Table) -> pa.Table:
        two, n2, three, n3 = merged(table.to_pylist())
        some = n3 >= least
        parent, third, n3 = (three[some] >> _U(32)).astype(np.int64), (three[some] & _LOW).astype(np.int64), n3[some].astype(np.int64)
        longer = np.zeros(len(two), np.int64)
        np.maximum.at(longer, parent, n3)
        prefix = unmix64(two)
        w1, w2, n2 = (prefix >> _U(32)).astype(np.int64), (prefix & _LOW).astype(np.int64), n2.astype(np.int64)
        keep = n2 >= least
        none = [pa.nulls(int(keep.sum()), pa.int64())] * 2
        pairs = pa.Table.from_arrays([pa.array(w1[keep]), pa.array(w2[keep]), none[0], pa.array(n2[keep]), none[1], pa.array(longer[keep])], schema=_NODE)
        triples = pa.Table.from_arrays([pa.array(x) for x in (w1[parent], w2[parent], third, n3, n2[parent], np.zeros_like(n3))], schema=_NODE)
        return pa.concat_tables([pairs, triples]).combine_chunks()

    return run


def _tries(shards: DataFrame, coarse: int) -> DataFrame:
    """The serialised blocks of each shard's trie; shards come with the numbers that their words have in the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = _cuts(0, 0, coarse)
        for batch in batches:
            for i in range(batch.num_rows):
                shard, toks = batch.column(0)[i].as_py(), _unpack(batch.column(1)[i].as_py(), np.uint32)
                ids = batch.column(2)[i].values
                of = np.zeros(int(toks.max(initial=0)) + 1, np.int64)
                of[ids.field("place").to_numpy()] = ids.field("id").to_numpy()
                out = [{"many": shard, "p": x.pop("r"), "f": 0, **x} for x in _blocks(trie(of[toks]), cuts)]
                if out:
                    yield pa.Table.from_pylist(out, _BLOCK).combine_chunks().to_batches()[0]

    return shards.mapInArrow(run, _BLOCK_SCHEMA)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 * a * a / (left * right)), exact for counts below 10^15."""
    wide = lambda c: c.cast("decimal(15,0)")
    square = (wide(a) * wide(a)).cast("decimal(30,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", square, (wide(left) * wide(right)).cast("decimal(30,0)"))


def mine(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by score, then a, then the phrase's bytes.

    n is the number of the language's words; l and r are the counts of the parts of the cut that counts. A candidate goes if a longer one that holds its words
    in a row has 100 * f >= share * a. A null language counts as ``und``. Null and empty texts and texts of
    separators alone have no words; repeated rows count each; an empty table, and languages without candidates, give no rows. Further columns of any
    name are ignored. A text of any length is read in runs; a word of any length is a word.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    plain = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    shards = scratch.table(_shards(plain), "shards")
    bits = max(6, (2 * plain.rdd.getNumPartitions() - 1).bit_length())  # ranges grow with the input
    words = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("shard", "lang", (F.col("at") + 1).alias("place"), F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    often = words.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    often = scratch.table(often.withColumn("m", F.monotonically_increasing_id()), "words")
    parts, most = often.agg(F.max(F.shiftright("m", 33)), F.max(F.expr("m & 8589934591"))).first()
    parts = 1 + (parts or 0)
    if (1 + (most or 0)) * parts >= 1 << 32:
        raise ValueError("more frequent words than 32 bits can number")
    often = often.select("lang", "word", "f", (F.expr("m & 8589934591") * parts + F.shiftright("m", 33) + 1).alias("id"))
    ids = words.join(often, ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct(F.col("place").cast("bigint").alias("place"), "id")).alias("ids"))  # as many as one shard has words
    coarse = min(bits, _COARSE)
    blocks = _tries(shards.join(ids, "shard").select("shard", "tokens", "ids"), coarse)
    if bits > coarse:
        many = F.pmod(F.xxhash64("many"), F.lit(max(1, -(-shards.count() // _TOGETHER))))
        blocks = blocks.withColumn("many", many).groupBy("many", "p").applyInArrow(_together(coarse, bits - coarse), _BLOCK_SCHEMA)
    nodes = scratch.table(blocks.groupBy("p", "f").applyInArrow(_walk(least), "w1 bigint, w2 bigint, w3 bigint, a bigint, left bigint, longer bigint"), "nodes")
    scratch.sweep()
    pairs, triples = nodes.where("w3 is null"), nodes.where("w3 is not null")
    word = lambda i: often.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"s{i}"), F.col("f").alias(f"f{i}"), *([F.col("lang")] if i == 1 else []))
    ends = triples.groupBy(F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("a").alias("after"))
    two = pairs.join(ends, ["w1", "w2"], "left").where(100 * F.greatest("longer", F.coalesce("after", F.lit(0))) < share * F.col("a"))
    two = two.join(word(1), "w1").join(word(2), "w2").select("lang", F.concat_ws(" ", "s1", "s2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"))
    two = two.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    link = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("right"))
    three = triples.join(link, ["w2", "w3"]).join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
    three = three.withColumn("k1", _score(F.col("a"), F.col("f1"), F.col("right"))).withColumn("k2", _score(F.col("a"), F.col("left"), F.col("f3")))
    first = F.col("k1") <= F.col("k2")
    three = three.select("lang", F.concat_ws(" ", "s1", "s2", "s3").alias("phrase"), "a", F.when(first, F.col("f1")).otherwise(F.col("left")).alias("l"), F.when(first, F.col("right")).otherwise(F.col("f3")).alias("r"), F.least("k1", "k2").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    found = two.union(three).withColumn("cell", F.pmod(F.xxhash64("phrase"), F.lit(_CELLS)))
    found = found.withColumn("i", F.row_number().over(Window.partitionBy("lang", "cell").orderBy(*order))).where(F.col("i") <= top)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    totals = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
