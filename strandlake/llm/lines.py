"""Near-duplicate lines by a segment-partition edit join (Pass-Join); DataFrame functions only.

Two lines are linked if their edit distance is at most ``edits`` and at most one for every ``per`` characters of the longer
one, so that the same rule holds for lines of any length: t(n) = min(edits, n div per). Lines that may be linked
within t edits are split into t + 1 segments; of two such lines one
has a segment that the other contains unchanged, near the same place. A segment is filed under t, its line's
length and its number; a line of n characters probes with t(n), for each length from its own down to t less, the few start
positions at which a match can matter (multi-match-aware selection of Li, Deng, Wang and Feng, 2011). Segment
and probe are 64-bit hashes, so the index is a table of small rows, and lines' texts never travel with it.

A grouped least and greatest line for each key tells which keys more than one line has; it combines before the shuffle, so that
no key is hot in it. Only the rows of such keys are made again. A key that more than _HOT rows share, as with lines of one template,
is refined: what is left of two linked lines without the matched segment is within t edits as well, so that the rest is
segmented by the same rule, up to _LEVELS times. Lines that share a key are candidates if their
counts of eight frequent letters and the parities of all their characters differ by 2 t at most, which the join
itself checks, and are verified by the banded bit-parallel edit distance (Hyyro, 2003): a word of
2 t + 1 bits slides down the diagonal, one step a character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.graph import connected_components
from strandlake.llm.scratch import Scratch

_FEW = 500_000
_HOT, _LEVELS = 256, 4
_LETTERS = "etaonirs"


def probes(t: int) -> list[tuple[int, int, int]]:
    """(difference of lengths, segment, shift of the start) of every probe; difference and shift 0 is the segment itself."""
    return [(d, i, o) for d in range(t + 1) for i in range(1, t + 2) for o in range(max(1 - i, d - (t + 1 - i)), min(i - 1, d + t + 1 - i) + 1)]


def _table(ts: range) -> Column:
    """The probes of thresholds as rows of a constant, so that the code for one key is small enough to be compiled."""
    return F.array(*(F.struct(F.lit(t).alias("t"), F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(o).alias("o")) for t in ts for d, i, o in probes(t)))


#: Of a line of n characters, seen as one of m = n - z.d: where the segment or probe z begins, and its size. The last segments have one character more.
_M = "(n - z.d)"
_SHORT = f"cast({_M} div (z.t + 1) as int)"
_LONG = f"({_M} % (z.t + 1))"
_SIZE = f"({_SHORT} + if(z.i > z.t + 1 - {_LONG}, 1, 0))"
_START = f"({_SHORT} * (z.i - 1) + greatest(0, z.i - 1 - (z.t + 1) + {_LONG}) + z.o)"
#: Lines are cut as four bytes a character: a substring of a text is searched from its start, one of bytes is not.
_CODE = "UTF-32"
_CUT = f"substring(raw, 1 + 4 * {_START}, 4 * {_SIZE})"


def _keyed(rows: DataFrame, edits: int, per: int) -> DataFrame:
    """rows (node, raw and n, its characters) once for each segment and probe z, with key and v.

    v is the node with two bits: 2 if the row is one of the line's own segments, 1 if it is a probe.
    """
    allow = lambda n: f"least({edits}, {n} div {per})"
    own = f"z.d = 0 and z.o = 0 and {allow('n')} <= z.t and {allow('(n + z.t)')} >= z.t"
    some = F.expr(f"filter(every, z -> ({own}) or {allow('n')} = z.t)")
    x = rows.withColumn("every", _table(range(1, edits + 1)))
    x = x.withColumn("z", F.explode(F.when(F.col("n") >= edits * per, _table(range(edits, edits + 1))).otherwise(some))).drop("every")
    x = x.withColumn("key", F.expr(f"xxhash64(({_M} * 8 + z.i) * 8 + z.t, {_CUT})"))
    return x.withColumn("v", F.expr(f"node | if({own}, 2, 0) | if({allow('n')} = z.t, 1, 0)"))


def _rest() -> Column:
    """The line without the matched segment."""
    return F.expr(f"concat(substring(raw, 1, 4 * {_START}), substring(raw, 1 + 4 * ({_START} + {_SIZE})))")


def _refined(rows: DataFrame) -> DataFrame:
    """rows (key, v, t, d, raw) of hot keys, keyed by segments of what is left of the line; a rest too short to be cut has one key."""
    fits = "z.t = t and z.d = d and ((v & 1) = 1 or z.o = 0)"
    x = rows.withColumn("n", F.expr("cast(octet_length(raw) / 4 as int)")).withColumn("every", _table(range(1, 8)))
    one = F.expr("array(named_struct('t', t, 'd', d, 'i', 0, 'o', 0))")
    x = x.withColumn("z", F.explode(F.when(F.expr("n - d <= t"), one).otherwise(F.expr(f"filter(every, z -> {fits})")))).drop("every")
    x = x.withColumn("key", F.when(F.expr("z.i = 0"), F.xxhash64("key", F.expr("n - d"))).otherwise(F.expr(f"xxhash64(key, z.i, {_CUT})")))
    x = x.withColumn("v", F.expr("if(z.o = 0, v, v & ~2L)"))
    rest = F.when(F.expr("z.i = 0"), F.unhex(F.lit(""))).otherwise(_rest())
    return x.withColumn("raw", rest).select("key", "v", "t", "d", "raw").distinct()


def _shared(rows: DataFrame) -> DataFrame:
    """(key, lo, hi, c) of the keys that two lines have, one as a segment."""
    by = rows.groupBy("key").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.max(F.expr("v & 2")).alias("own"), F.count("*").alias("c"))
    return by.where("lo >> 2 <> hi >> 2 and own > 0").select("key", "lo", "hi", "c")


def _letters(line: Column) -> Column:
    """Counts of eight letters, each modulo 256, in one long."""
    out = F.lit(0).cast("bigint")
    for k, c in enumerate(_LETTERS):
        count = F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
        out = out.bitwiseOR(F.shiftleft(count.cast("bigint").bitwiseAND(F.lit(255)), 8 * k))
    return out


def _parities(chars: Column) -> Column:
    """Whether the characters of each of 64 kinds are odd in number, as the bits of one long."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(c).bitwiseAND(F.lit(63)))
    return F.aggregate(chars, F.lit(0).cast("bigint"), lambda s, c: s.bitwiseXOR(bit(c)))


def _apart(x: str, y: str) -> Column:
    """Sum of the differences of the letter counts."""
    one = lambda c, k: f"(shiftright({c}, {8 * k}) & 255)"
    return F.expr(" + ".join(f"least(abs({one(x, k)} - {one(y, k)}), 256 - abs({one(x, k)} - {one(y, k)}))" for k in range(8)))


def edit_distance(x: str, y: str, t: int) -> Column:
    """Edit distance of two columns of character arrays if it is t at most, else a larger number; both are longer than t, lengths differ by t at most.

    A word of 2 t + 1 bits holds the vertical differences of the rows from i - t to i + t of column i;
    vp and vn are those of +1 and -1. Along the diagonal the distance grows where bit 2 t of d0 is unset; in the
    last columns, where the band leaves the pattern, it follows the horizontal differences in the last row.
    """
    w = 2 * t + 1
    full, top = (1 << w) - 1, 1 << (w - 1)
    p, q, m = F.col(x), F.col(y), F.size(x)
    long = lambda v: F.lit(v).cast("bigint")

    def step(s: Column, i: Column) -> Column:
        c = F.get(q, i)
        match = sum((F.when(F.get(p, i + (k - t)) == c, long(1 << k)).otherwise(long(0)) for k in range(1, w)), F.when(F.get(p, i - t) == c, long(1)).otherwise(long(0)))
        # what a step computes is used several times below, so it is bound by a one-element transform
        first = F.transform(F.array(F.struct(match.alias("x"), s["vp"].alias("vp"), s["vn"].alias("vn"))), lambda z: F.struct(
            (((z["x"].bitwiseAND(z["vp"]) + z["vp"]).bitwiseXOR(z["vp"])).bitwiseOR(z["x"]).bitwiseOR(z["vn"])).bitwiseAND(long(full)).alias("d0"), z["vp"].alias("vp"), z["vn"].alias("vn")))
        second = F.transform(first, lambda z: F.struct(
            z["vn"].bitwiseOR(F.bitwise_not(z["d0"].bitwiseOR(z["vp"])).bitwiseAND(long(full))).alias("hp"), z["d0"].bitwiseAND(z["vp"]).alias("hn"), z["d0"].alias("d0")))
        last = F.transform(second, lambda z: F.struct(
            z["hn"].bitwiseOR(F.bitwise_not(F.shiftright(z["d0"], 1).bitwiseOR(z["hp"])).bitwiseAND(long(full))).alias("vp"),
            F.shiftright(z["d0"], 1).bitwiseAND(z["hp"]).alias("vn"),
            F.when(i < m - t, s["dist"] + F.when(z["d0"].bitwiseAND(long(top)) == 0, 1).otherwise(0))
            .otherwise(s["dist"] + F.when(z["hp"].bitwiseAND(s["low"]) != 0, 1).otherwise(0) - F.when(z["hn"].bitwiseAND(s["low"]) != 0, 1).otherwise(0)).alias("dist"),
            F.when(i < m - t, s["low"]).otherwise(F.shiftright(s["low"], 1)).alias("low")))
        return F.get(last, F.lit(0))

    start = F.struct(long(full & ~((1 << t) - 1)).alias("vp"), long(0).alias("vn"), long(t).alias("dist"), long(top >> 1).alias("low"))
    return F.aggregate(F.sequence(F.lit(0), F.size(q) - 1), start, step, lambda s: s["dist"])


def occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, no, line): every line that is not blank, without the white space around it; no counts all lines from 0."""
    rows = docs.select(F.col(f"`{key}`").alias("doc"), F.posexplode(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n")).alias("no", "line"))
    return rows.withColumn("line", F.btrim("line", F.lit(" \t\n\x0b\x0c\r"))).where("line <> ''")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", edits: int = 2, per: int = 10) -> DataFrame:
    """(doc, line_no, n_links, class_doc, class_line, kept) for every line that is not blank.

    Lines are compared without the white space around them. Two different lines are linked if their edit distance is at most
    ``edits`` (1 to 7) and at most one for every ``per`` (more than edits) characters of the longer one, so that lines of less than
    ``per`` characters have exact copies only. n_links counts the different lines linked with this one. A class is what links and equality
    connect; it is named by its first occurrence (smallest document, then line), which alone is kept. Null
    texts have no lines; a null document id is smaller than all others; rows that repeat a document
    repeat its lines, and of occurrences with equal document and line number all are kept or none. Empty tables
    give no rows; other columns, of any name, are ignored.
    """
    if not 1 <= edits <= 7 or per <= edits:
        raise ValueError("edits must be from 1 to 7 and less than per")
    scratch = Scratch(docs.sparkSession, "lines")
    t = edits
    occ = occurrences(docs, key, text).withColumn("node", F.expr("xxhash64(line) & ~3L")).withColumn("node2", F.xxhash64(F.lit(1), "line"))
    light = scratch.table(occ.select("doc", "no", "node", "node2"), "occurrences")
    first = scratch.table(light.groupBy("node", "node2").agg(F.min(F.struct("doc", "no")).alias("first"), F.count("*").alias("c")), "first")
    few = lambda x: F.broadcast(x) if x.count() <= _FEW else x
    long = occ.select("doc", "no", "node", "line", F.length("line").alias("n")).where(F.col("n") >= per - 1)
    again = first.where("c > 1").groupBy("node").agg(F.min(F.struct("first.doc", "first.no")).alias("f")).select("node", F.col("f.doc").alias("d0"), F.col("f.no").alias("n0"))
    rows = long.join(few(again), "node", "left").where(F.col("n0").isNull() | (F.col("doc").eqNullSafe(F.col("d0")) & (F.col("no") == F.col("n0"))))
    rows = scratch.table(rows.select("node", "n", "line"), "lines")  # each line once, but for rows that repeat a document
    keyed = _keyed(rows.select("node", "n", F.encode("line", _CODE).alias("raw")), t, per)
    shared = scratch.table(_shared(keyed.select("key", "v")), "shared")
    two = shared.where("c = 2").select("key", F.explode(F.array("lo", "hi")).alias("v"))
    more = scratch.table(shared.where("c > 2").select("key"), "more")
    again = keyed.join(few(more), "key")
    again = scratch.table(again.select("key", "v", "z.t", "z.d", _rest().alias("raw")).distinct(), "again")
    parts = [two]
    for level in range(_LEVELS):
        hot = scratch.table(again.groupBy("key").count().where(F.col("count") > _HOT).select("key"), f"hot{level}")
        n_hot = hot.count()
        if not n_hot or level == _LEVELS - 1:
            parts.append(again.select("key", "v"))
            break
        hot = F.broadcast(hot) if n_hot <= _FEW else hot
        parts.append(again.join(hot, "key", "left_anti").select("key", "v"))
        again = scratch.table(_refined(again.join(hot, "key", "left_semi")), f"refined{level}")
        again = scratch.table(again.join(_shared(again).select("key"), "key", "left_semi"), f"again{level}")
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.union(p)
    hits = scratch.table(hits.withColumn("node", F.expr("v & ~3L")).withColumn("own", F.expr("v & 2 > 0")).withColumn("probe", F.expr("v & 1 > 0")).drop("v").distinct(), "hits")

    ids = scratch.table(hits.select("node").distinct(), "ids")
    texts = rows.select("node", "line").join(few(ids), "node", "left_semi").withColumn("letters", _letters(F.col("line")))
    texts = texts.select("node", F.split("line", "").alias("chars"), "letters")
    texts = scratch.table(texts, "texts")  # characters as stored columns: an expression would be computed again at every step
    marks = texts.select("node", F.size("chars").alias("n"), "letters", _parities(F.col("chars")).alias("odd"))
    hits = scratch.table(hits.join(marks, "node"), "marked")
    x, y = hits.where("own").alias("x"), hits.where("probe").alias("y")
    most = F.expr(f"least({t}, y.n div {per})")
    near = F.expr(f"y.n - x.n between 0 and least({t}, y.n div {per})") & (F.bit_count(F.col("x.odd").bitwiseXOR(F.col("y.odd"))) <= 2 * most) & (_apart("x.letters", "y.letters") <= 2 * most)
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")) & near)
    pairs = scratch.table(pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct(), "pairs")
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("chars").alias("p")), "a").join(texts.select(F.col("node").alias("b"), F.col("chars").alias("q")), "b")
    within = F.expr(f"least({t}, greatest(size(p), size(q)) div {per})")
    links = scratch.table(both.where(edit_distance("p", "q", t) <= within).select("a", "b"), "links")
    comp = scratch.table(connected_components(scratch, links), "components")
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))

    named = first.join(comp.join(degree, "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    name = named.where("n_links is not null").groupBy("component").agg(F.min("first").alias("name"))
    named = named.join(name, "component", "left").select("node", "node2", F.coalesce("name", "first").alias("name"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    out = light.select("doc", F.col("no").alias("line_no"), "node", "node2").join(named, ["node", "node2"])
    out = out.select("doc", "line_no", "n_links", F.col("name.doc").alias("class_doc"), F.col("name.no").alias("class_line"))
    return out.withColumn("kept", F.col("doc").eqNullSafe(F.col("class_doc")) & (F.col("line_no") == F.col("class_line")))


def without_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with only the kept lines and the blank ones; the key must be unique and not null. A null text stays null."""
    gone = near_duplicates(docs, key=key, text=text, **how).where("not kept").groupBy("doc").agg(F.collect_set("line_no").alias("__gone"))
    out = docs.join(gone.withColumnRenamed("doc", "__doc"), F.col(f"`{key}`") == F.col("__doc"), "left")
    lines = F.filter(F.split(F.col(f"`{text}`"), "\n"), lambda x, i: F.col("__gone").isNull() | ~F.array_contains("__gone", i))
    return out.withColumn(text, F.array_join(lines, "\n")).drop("__gone", "__doc")
