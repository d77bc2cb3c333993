"""Aligning the tokens of two tokenizers, A and B, over the bytes that both stand for.

Each byte of a text gets a label: a token of A ends here, one of B, both, or none. A regular expression scans the labels for spans up to each
label of both; the labels of a span count the tokens of A and B that it groups. Every label but none also ends a stretch of
bytes that belongs to one token of either side, so the stretches are the links: the pairs of tokens whose bytes overlap.

Both tokenizers cut at a space behind a character that is no white space, whatever stands around it: A's pattern never runs over such a place, and
no piece of B has a space behind something else (``Pair`` looks). So a text is cut there into units, a task aligns each different unit once, many
joined to a string, and a text is the sequence of its units. If the bytes of a unit come back changed, its text is aligned whole.

How many documents hold a pair of linked ids is counted corpus-wide: tasks pack documents into slabs with the different pairs of
each document, slabs send their different pairs with the number of their documents, and a join brings the counts back to the slab.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.lm import _pack, _rows, _unpack
from strandlake.llm.scratch import Scratch

_U = np.uint64
#: The folder of tokenizer files on every node, and the files of A and B in it.
FOLDER, A_FILE, B_FILE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
_UNIT_END = re.compile(r"\S(?= )")
_CUT = re.compile(r"(?<=\S)(?= )")
_SPAN = re.compile(rb"[^\x03]*\x03")
_JOIN = 1 << 16  # characters that are encoded together
_PIECE = 1 << 20  # characters of a text that are cut into units together
_FLUSH = 1 << 21  # characters between two rounds of encoding
_KNOWN = 400_000  # units that a task remembers
_SLAB = 3 << 20  # different pairs of documents in a slab


def _byte_chars() -> dict[str, int]:
    """The byte of each character in which byte-level vocabularies are spelled: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Encoded:
    """Units one behind the other: token ids of A and B, the label of each byte, and each unit's last byte + 1; a unit that is not ok has no bytes."""

    a: np.ndarray
    b: np.ndarray
    labels: np.ndarray
    ends: np.ndarray
    ok: np.ndarray

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each group of tokens: its last byte + 1, and how many tokens of A and of B it and those before it have."""
        found = _SPAN.findall(self.labels.tobytes())
        end = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        return end, np.cumsum(self.labels & 1, dtype=np.int64)[end - 1], np.cumsum(self.labels >> 1, dtype=np.int64)[end - 1]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(byte, a << 32 | b) of each pair of tokens that share bytes, by their last shared byte."""
        at = np.flatnonzero(self.labels)
        one, two = (self.labels[at] & 1).astype(np.int64), (self.labels[at] >> 1).astype(np.int64)
        return at, (self.a[np.cumsum(one) - one] << 32) | self.b[np.cumsum(two) - two]


class Pair:
    """The two tokenizers of a task."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(a_path)
        self._a.encode_special_tokens = True  # their strings in a text are ordinary text
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        chars = _byte_chars()
        added = self._a.get_added_tokens_decoder()
        self.a_bytes = [b""] * self._a.get_vocab_size()
        for token, i in self._a.get_vocab().items():
            self.a_bytes[i] = b"" if i in added else bytes(chars[c] for c in token)
        sp = self._b
        pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not sp.is_control(i)):
            raise ValueError("a piece of B runs over a space, so texts cannot be cut there")
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # decimal ids with what follows them: A in a group and at its end, B in a group, at its end and at a unit's end
        spelled = [str(i).encode() + s for n, seps in ((len(self.a_bytes), (b",", b"|")), (len(self.b_bytes), (b",", b";", b"\n"))) for s in seps for i in range(n)]
        self.spelled = np.array(spelled, object)

    def _aligned(self, text: str) -> tuple[list[int], list[int]] | None:
        """Token ids of A and B, or None if the bytes of either are not the text's."""
        a, raw = self._a.encode(text, add_special_tokens=False).ids, text.encode()
        b = self._b.encode(text[1:]) if len(text) > 1 else [self._b.piece_to_id("▁")]  # B adds no space to nothing
        same = b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b])
        return (a, b) if same else None

    def encode(self, units: list[str]) -> Encoded:
        """Each unit begins with the space that is put before a text or that it was cut at."""
        parts: list[list[str]] = []
        size = _JOIN
        for u in units:
            if size >= _JOIN:
                parts.append([])
                size = 0
            parts[-1].append(u)
            size = _JOIN if u[-1].isspace() else size + len(u)  # what ends in white space has no cut behind it
        a_all: list[int] = []
        b_all: list[int] = []
        lengths: list[int] = []
        ok: list[bool] = []
        for part in parts:
            got = self._aligned("".join(part))
            for us, x in [(part, got)] if got or len(part) == 1 else [([u], self._aligned(u)) for u in part]:
                a, b = x or ([], [])
                a_all += a
                b_all += b
                lengths += [len(u.encode()) if x else 0 for u in us]
                ok += [x is not None] * len(us)
        a, b, ends = np.array(a_all, np.int64), np.array(b_all, np.int64), np.cumsum(np.array(lengths, np.int64))
        labels = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        labels[np.cumsum(self.a_len[a]) - 1] = 1
        labels[np.cumsum(self.b_len[b]) - 1] |= 2
        return Encoded(a, b, labels, ends, np.array(ok, bool))

    def spelling(self, e: Encoded) -> list[bytes]:
        """Of each unit its groups as ``a1,a2|b1;a3|b2,b3``."""
        end, a_to, b_to = e.spans()
        last = np.zeros(len(end), np.int64)
        last[np.searchsorted(end, e.ends[e.ok])] = 1  # the group ends its unit
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        a_from, b_from = np.append(0, a_to)[:-1], np.append(0, b_to)[:-1]
        seq = np.empty(len(e.a) + len(e.b), np.int64)
        at_a = np.arange(len(e.a)) + np.repeat(b_from, a_to - a_from)
        at_b = np.arange(len(e.b)) + np.repeat(a_to, b_to - b_from)
        seq[at_a], seq[at_b] = e.a, 2 * n_a + e.b
        seq[at_a[a_to - 1]] += n_a
        seq[at_b[b_to - 1]] += n_b + n_b * last
        out, got = [b""] * len(e.ok), b"".join(self.spelled[seq].tolist()).split(b"\n")
        for i, x in zip(np.flatnonzero(e.ok), got, strict=False):
            out[i] = x
        return out


@functools.lru_cache(1)
def pair(a_path: str, b_path: str) -> Pair:
    """A worker loads the files once."""
    return Pair(a_path, b_path)


def units(text: str) -> Iterator[list[str]]:
    """The units of a text that is not empty, with a space put before it; in runs of some _PIECE characters."""
    text, at = " " + text, 0
    while at < len(text):
        m = _UNIT_END.search(text, at + _PIECE)
        end = m.end() if m else len(text)
        yield _CUT.split(text[at:end])
        at = end


class _Known:
    """What is known of the different units of a task: counts of tokens, groups and links, the groups spelled, and the linked ids."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.n = np.zeros((4, 0), np.int64)
        self.ok = np.zeros(0, bool)
        self.spelled: list[bytes] = []
        self.links = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)

    def numbers(self, us: list[str]) -> np.ndarray:
        know = self.number
        return np.array([know.setdefault(u, len(know)) for u in us], np.int64)

    def learn(self) -> None:
        """Encode the units that have only a number."""
        new = list(self.number)[len(self.ok) :]
        if not new:
            return
        e = self.pair.encode(new)
        end, a_to, b_to = e.spans()
        at, keys = e.links()
        groups, links = (np.append(0, np.searchsorted(x, e.ends, "right")) for x in (end, at + 1))
        upto = lambda x: np.diff(np.append(0, x)[groups])
        self.n = np.concatenate([self.n, [upto(a_to), upto(b_to), np.diff(groups), np.diff(links)]], axis=1)
        self.ok = np.append(self.ok, e.ok)
        self.spelled += self.pair.spelling(e)
        self.first = np.append(self.first, len(self.links) + links[1:])
        self.links = np.append(self.links, keys)

    def linked(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different links of a sequence of units, and how often each occurs."""
        u, often = np.unique(u, return_counts=True)
        n = self.n[3][u]
        at = np.repeat(self.first[u] - np.append(0, np.cumsum(n))[:-1], n) + np.arange(n.sum())
        return _summed(self.links[at], np.repeat(often, n))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


@dataclass
class _Doc:
    id: int | None
    n: np.ndarray = field(default_factory=lambda: np.zeros(4, np.int64))
    sha: object = None
    links: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    bad: bool = False

    def add(self, known: _Known, u: np.ndarray) -> None:
        """The next units of the text."""
        if self.bad or not known.ok[u].all():
            self.bad = True
            return
        self.n += known.n[:, u].sum(1)
        s = b";".join([known.spelled[i] for i in u])
        self.sha = self.sha or hashlib.sha256()
        self.sha.update(b";" + s if self.n[0] > known.n[0, u].sum() else s)
        self.links.append(known.linked(u))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.links) == 1:
            return self.links[0]
        none = np.zeros(0, np.int64)
        return _summed(*(np.concatenate([none, *(x[k] for x in self.links)]) for k in (0, 1)))


_SLAB_FIELDS = [("slab", pa.int64()), ("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("sha", pa.list_(pa.string())), ("keys", pa.binary()), ("docs", pa.binary()), ("sizes", pa.binary()), ("at", pa.binary()), ("often", pa.binary())]
_SLAB_SCHEMA = "slab bigint, ids array<bigint>, n array<bigint>, sha array<string>, keys binary, docs binary, sizes binary, at binary, often binary"


def _slabs(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Documents packed: their counts and digests, the slab's different pairs in order with the number of its documents that have them, and each document's pairs by place among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, known = TaskContext.get().partitionId(), 0, _Known(pair(a_path, b_path))
        waiting: list[tuple[_Doc, np.ndarray]] = []
        done: list[tuple[_Doc, np.ndarray, np.ndarray]] = []
        size = chars = 0

        def settle() -> None:
            nonlocal chars
            known.learn()
            for doc, u in waiting:
                doc.add(known, u)
            waiting.clear()
            if len(known.number) > _KNOWN:
                known.clear()
            chars = 0

        def flush() -> pa.RecordBatch:
            nonlocal count, size
            none = np.zeros(0, np.int64)
            keys, at, docs = np.unique(np.concatenate([none, *(k for _, k, _ in done)]), return_inverse=True, return_counts=True)
            row = [
                (part << 24) + count, [d.id for d, _, _ in done], np.concatenate([d.n for d, _, _ in done]), [d.sha.hexdigest() if d.sha else "" for d, _, _ in done], _pack(np.diff(keys, prepend=0)), _pack(docs.astype(np.uint32)),
                _pack(np.array([len(k) for _, k, _ in done], np.uint32)), _pack(at.astype(np.uint32)), _pack(np.concatenate([none, *(m for _, _, m in done)]).astype(np.uint32)),
            ]
            done.clear()
            count, size = count + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, _SLAB_FIELDS, strict=True)], names=[n for n, _ in _SLAB_FIELDS])

        def close(texts: list[tuple[_Doc, pa.Scalar]]) -> Iterator[pa.RecordBatch]:
            nonlocal size
            settle()
            for doc, text in texts:
                if doc.bad:  # some unit came back changed: only the whole text can tell
                    whole = _Known(known.pair)
                    u = whole.numbers([" " + text.as_py()])
                    whole.learn()
                    doc = _Doc(doc.id)  # noqa: PLW2901
                    doc.add(whole, u)
                    if doc.bad:
                        doc = _Doc(doc.id)  # noqa: PLW2901
                done.append((doc, *doc.pairs()))
                doc.links = []
                size += len(done[-1][1]) + 8
                if size >= _SLAB:
                    yield flush()

        for batch in batches:
            texts: list[tuple[_Doc, pa.Scalar]] = []
            for i in range(batch.num_rows):
                doc, text = _Doc(batch.column(0)[i].as_py()), batch.column(1)[i]
                texts.append((doc, text))
                for us in units(text.as_py()) if text.is_valid and len(text.as_buffer()) else []:
                    waiting.append((doc, known.numbers(us)))
                    chars += sum(map(len, us))
                    if chars >= _FLUSH:
                        settle()
                if chars == 0:
                    yield from close(texts)
                    texts = []
            yield from close(texts)
        if done:
            yield flush()

    return docs.mapInArrow(run, _SLAB_SCHEMA)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        keys = np.cumsum(_unpack(row["keys"], np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row["slab"])), pa.array(keys), pa.array(_unpack(row["docs"], np.uint32).astype(np.int64))], names=["slab", "key", "n"])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in ("ids", "n", "sha", "sizes", "at", "often")}
            got = batch.column("got")[i]
            place = np.zeros(0, np.int64)
            count, best = place, place
            if got.is_valid:
                x = got.values
                order = np.argsort(x.field("key").to_numpy())
                count, best = x.field("count").to_numpy()[order], x.field("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
            at, often, sizes = _unpack(row["at"], np.uint32), _unpack(row["often"], np.uint32).astype(np.int64), _unpack(row["sizes"], np.uint32).astype(np.int64)
            till = np.append(0, np.cumsum(sizes))
            each = lambda v: np.diff(np.append(0, np.cumsum(often * v[at]))[till])  # noqa: B023, E731
            n = np.array(row["n"], np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), *(pa.array(n[:, k]) for k in range(4)), pa.array(each(best)), pa.array(each(count)), pa.array(row["sha"], pa.string())], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def measure(docs: DataFrame, *, key: str = "doc_id", text: str = "text", folder: str = FOLDER, a: str = A_FILE, b: str = B_FILE) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs.

    A encodes a space and the text, B the text, to which it adds the space; both without special tokens. Links are all pairs of an A and a B token whose bytes
    overlap; the count of a pair of ids is the number of rows that have it linked. n_best are the links whose count is the highest of their A id, ties
    included, count_sum adds the counts of all links. groups_sha256 is that of the groups' ids, see ``Pair.spelling``. Texts that are null or empty, and those whose
    bytes either side changes, have no tokens: zeros and ''. Repeated rows and ids count each; a null id stays null; empty tables give no rows;
    further columns of any name are ignored. A text may be as long as memory holds twice.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    plain = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    slabs = scratch.table(_slabs(plain, f"{folder}/{a}", f"{folder}/{b}"), "slabs")
    asked = slabs.select("slab", "keys", "docs").mapInArrow(_keys, "slab bigint, key bigint, n bigint")
    counts = scratch.table(asked.groupBy("key").agg(F.sum("n").alias("count")), "counts")
    first = F.shiftright("key", 32).alias("a")
    most = counts.groupBy(first).agg(F.max("count").alias("most"))  # a row for each id of A at most
    counts = counts.withColumn("a", first).join(F.broadcast(most), "a").select("key", "count", (F.col("count") == F.col("most")).alias("best"))
    got = asked.select("slab", "key").join(counts, "key").groupBy("slab").agg(F.collect_list(F.struct("key", "count", "best")).alias("got"))  # a slab's different pairs
    return slabs.drop("keys", "docs").join(got, "slab", "left").mapInArrow(_measured, "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")


def align(docs: DataFrame, *, key: str = "doc_id", text: str = "text", folder: str = FOLDER, a: str = A_FILE, b: str = B_FILE) -> DataFrame:
    """(id, part, group, start, end, a, b): the groups of every text, with their bytes in the space and the text, and the token ids of both sides.

    A text's groups are numbered from 0; a very long text comes in several parts of bytes and groups of their own numbers. Texts without tokens, see ``measure``, have no rows.
    """
    a_path, b_path = f"{folder}/{a}", f"{folder}/{b}"
    ints = pa.list_(pa.int32())

    def groups(id_: int | None, part: int, e: Encoded) -> pa.RecordBatch:
        end, a_to, b_to = e.spans()
        lists = [pa.ListArray.from_arrays(pa.array(np.append(0, to), pa.int32()), pa.array(ids, pa.int32())) for to, ids in ((a_to, e.a), (b_to, e.b))]
        cols = [pa.array([id_] * len(end), pa.int64()), pa.array([part] * len(end), pa.int32()), pa.array(np.arange(len(end))), pa.array(np.append(0, end)[:-1]), pa.array(end), *lists]
        return pa.RecordBatch.from_arrays(cols, schema=pa.schema([("id", pa.int64()), ("part", pa.int32()), ("group", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("a", ints), ("b", ints)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = pair(a_path, b_path)
        for batch in batches:
            for i in range(batch.num_rows):
                id_, t = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                parts = [two.encode(us) for us in units(t)] if t else []
                if not all(e.ok.all() for e in parts):
                    parts = [two.encode([" " + t])]
                for k, e in enumerate(parts):
                    if e.ok.all():
                        yield groups(id_, k, e)

    plain = docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"))
    return plain.mapInArrow(run, "id bigint, part int, group bigint, start bigint, end bigint, a array<int>, b array<int>")
