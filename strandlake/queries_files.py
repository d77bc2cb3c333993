"""Queries that write files and read them back, read made-up files of every format, and run planned transforms, with their SQL."""

from __future__ import annotations

import io
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake import workspace
from strandlake.functions import colors, geometry, scalars
from strandlake.functions import sequence as S
from strandlake.operators import centroids, intervals, kv, mixture, pangenome, proteins, reads, reports, sketches
from strandlake.plans import catalogue
from strandlake.plans.library import DataLibrary
from strandlake.plans.planner import Item, Planner, attached, lineage
from strandlake.plans.types import standard
from strandlake.queries import _CANON, _DNA, _matrix, _KM, _PIECES, _fasta, _flags, _pieces, _qualities, _QUAL, long, query, sequences, table
from strandlake.sources import external, fastq, records, sinks, tables
from strandlake.streaming import centroids as arriving

# ---- readers ----------------------------------------------------------------------------------------------------


@query(f"""
with x as (select doc_id, lang, source, {_DNA} seq, {_QUAL} qual from documents)
select source || '/' || lang file, doc_id || '/1' id, md5(seq) seq, md5(qual) qual, length(seq)::bigint length from x where seq <> ''""")
def fastq_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A FASTQ file for each source and language."""
    x = _qualities(spark, sf_dir).where("seq <> ''")
    rec = F.concat(F.lit("@"), F.col("doc_id").cast("string"), F.lit("/1 x\n"), "seq", F.lit("\n+\n"), "qual", F.lit("\n"))
    files = x.groupBy(F.concat_ws("/", F.col("source"), F.col("lang")).alias("source")).agg(F.array_join(F.collect_list(rec), "").alias("content"))
    out = records.fastq(files)
    return out.select(F.col("source").alias("file"), "id", F.md5("seq").alias("seq"), F.md5("qual").alias("qual"), F.length("seq").cast("bigint").alias("length"))


@query("""select doc_id, trim(split_part(text, chr(10), 1), E' ') first_line from documents""")
def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source"), F.col("text").alias("content"))
    return records.first_line(x).select(F.col("source").cast("bigint").alias("doc_id"), F.col("value").alias("first_line"))


@query("""
with l as (select p_partkey, (p_partkey % 20)::int k, 'DEFINITION  ' || p_name || ' strain ' || p_brand d from part)
select p_partkey, case when k < 16 then d end definition from l""")
def genbank_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definition stands on line 1 to 20; only the first sixteen are looked at."""
    p = table(spark, sf_dir, "part")
    head = F.repeat(F.lit("LOCUS\n"), (F.col("p_partkey") % 20).cast("int"))
    text = F.concat(head, F.lit("DEFINITION  "), "p_name", F.lit(" strain "), "p_brand", F.lit("\nDEFINITION later\n"))
    x = records.genbank_definition(p.select(F.col("p_partkey").cast("string").alias("source"), text.alias("content")))
    return x.select(F.col("source").cast("bigint").alias("p_partkey"), "definition")


def _gfa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph for each item: a segment of its sequence and one of its reverse complement, with a header and a link."""
    x = sequences(spark, sf_dir, "benchmark").where("seq <> ''")
    i = F.col("item_id").cast("string")
    text = F.concat(F.lit("H\tVN:Z:1.0\nS\ta"), i, F.lit("\t"), "seq", F.lit("\tLN:i:1\nL\ta\t+\tb\t-\t0M\nS\tb"), i, F.lit("\t"), S.reverse_complement(F.col("seq")), F.lit("\n"))
    return x.select(i.alias("source"), text.alias("content"))


@query(f"""
with s as (select item_id, {_DNA} seq from benchmark)
select item_id::varchar source, name, md5('>' || name || chr(10) || q) fasta, length(q)::bigint length, (200 * length(q))::bigint target_bases
from (select item_id, 'a' || item_id name, seq q from s where seq <> '' union all select item_id, 'b' || item_id, translate(reverse(seq), 'ACGT', 'TGCA') from s where seq <> '')""")
def gfa_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments, their FASTA text, and a hundred times the bases of the graph."""
    seg = records.gfa_segments(_gfa(spark, sf_dir))
    size = seg.groupBy("source").agg((F.sum(F.length("seq")) * 100).cast("bigint").alias("target_bases"))
    text = records.gfa_to_fasta(seg).select("source", "pos", F.md5("value").alias("fasta"))
    x = seg.join(text, ["source", "pos"]).join(size, "source")
    return x.select("source", "name", "fasta", F.length("seq").cast("bigint").alias("length"), "target_bases")


@query("""
with l as (select event_id, case when event_id % 3 = 0 then '[INFO] start' || chr(10) || '[INFO] guessed quality encoding: ' || upper(event_type) || ' ' || chr(10) || 'guessed quality encoding: late' else 'nothing found' end t from events)
select event_id, case when event_id % 3 = 0 then lower(event_type) else 'sanger' end encoding from events""")
def encoding_from_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.concat(F.lit("[INFO] start\n[INFO] guessed quality encoding: "), F.upper("event_type"), F.lit(" \nguessed quality encoding: late"))
    log = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("source"), F.when(F.col("event_id") % 3 == 0, found).otherwise("nothing found").alias("content"))
    return tables.grep_or(log, "guessed quality encoding:", "sanger").select(F.col("source").cast("bigint").alias("event_id"), F.col("value").alias("encoding"))


@query("""select category, passed::varchar passed, failed::varchar failed from (
with f as (select (l_orderkey * 7 + l_partkey) % 4096 flag from lineitem), k as (select flag, (flag & 512) <> 0 qc from f)
select 'total' category, count(*) filter (where not qc) passed, count(*) filter (where qc) failed from k
union all select 'mapped', count(*) filter (where not qc and (flag & 4) = 0), count(*) filter (where qc and (flag & 4) = 0) from k)""")
def flagstat_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A headerless table whose key is its last column, written, read and turned into two maps."""
    from strandlake.operators import coverage

    at = workspace.folder(spark, "flagstat")
    sinks.write_tsv(coverage.flag_counts(_flags(spark, sf_dir)).select("passed", "failed", "category"), at, header=False)
    m = tables.key_last(tables.tsv(spark, at, "passed string, failed string, category string"), "passed", "failed", "category")
    x = m.select(F.explode(F.array(F.lit("total"), F.lit("mapped"))).alias("category"), "first", "second")
    return x.select("category", F.col("first")[F.col("category")].alias("passed"), F.col("second")[F.col("category")].alias("failed"))


@query("""select p_brand family, n_name genome, count(*) filter (where hit) n from (
select p_brand, n_name, n_nationkey = p_partkey % 25 hit from part, nation) group by all""")
def gene_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix of quoted gene names, written as CSV with its fourteen columns before the genomes, and read back."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("Gene"), F.concat(F.lit('"'), F.col("p_partkey").cast("string"), F.lit('"')).alias("g"), (F.col("p_partkey") % 25).cast("int").alias("k"))
    names = [r[0] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]
    cells = [F.nullif(F.array_join(F.collect_list(F.when(F.col("k") == i, F.col("g"))), " "), F.lit("")).alias(n) for i, n in enumerate(names)]
    wide = p.groupBy("Gene").agg(*cells)
    meta = [F.lit("shell").alias("Non-unique Gene name"), *(F.lit("").alias(f"m{i}") for i in range(12))]
    at = workspace.folder(spark, "matrix")
    wide.select("Gene", *meta, *(F.col(f"`{n}`") for n in names)).write.option("header", True).option("escape", '"').csv(at)
    return tables.matrix(spark, at).select("family", "genome", "n")


@query("""select s_suppkey, case when s_suppkey % 2 = 0 then 'a' else 'b' end || s_suppkey || '.x' stem, s_nationkey from supplier""")
def summary_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genomes by file, their rows from two summary tables keyed by the files' stems."""
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "a").otherwise("b"), F.col("s_suppkey").cast("string"), F.lit(".x"))
    s = s.select("s_suppkey", "s_nationkey", name.alias("stem"))
    whole = tables.union_by_key([s.where(f"s_suppkey % 2 = {i}").select("stem", "s_nationkey") for i in (0, 1)], "stem")
    paths = s.select("s_suppkey", F.concat(F.lit("/data/"), "stem", F.lit(".fna")).alias("path"))
    return tables.split_by_stem(whole, paths, "stem").select("s_suppkey", "stem", "s_nationkey")


# ---- writers, read back -----------------------------------------------------------------------------------------


@query("""select c_custkey, c_name, c_acctbal from customer""")
def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gzip, with a header."""
    at = workspace.folder(spark, "tsv")
    sinks.write_tsv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), at, gzip=True)
    return tables.tsv(spark, at, "c_custkey bigint, c_name string, c_acctbal double", header=True)


@query("""with m as (select min(n_nationkey)::varchar lo, max(n_nationkey)::varchar hi, count(*)::varchar n from nation) unpivot m on lo, hi, n into name k value v""")
def tsv_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = workspace.folder(spark, "row")
    sinks.write_tsv(table(spark, sf_dir, "nation").agg(F.min("n_nationkey").alias("lo"), F.max("n_nationkey").alias("hi"), F.count("*").alias("n")), at)
    return tables.first_row(tables.tsv(spark, at, header=True)).select(F.explode("row").alias("k", "v"))


@query("""select o_orderkey, o_orderpriority, case when o_orderkey % 5 > 0 then o_totalprice end price from orders""")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls are written."""
    at = workspace.folder(spark, "json")
    o = table(spark, sf_dir, "orders")
    sinks.write_json(o.select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).alias("price")), at)
    return spark.read.schema("o_orderkey bigint, o_orderpriority string, price double").json(at)


@query(f"""
with s as (select doc_id, lang, {_DNA} seq from documents)
select doc_id::varchar id, doc_id || ' ' || lang header, md5(seq) seq from s union all select 'b', E'b\\tx', md5('ACGTAC') from s union all select doc_id::varchar, doc_id || ' again', md5('TT') from s union all select 'empty', 'empty', md5('') from s""")
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all documents' files, written as gzipped FASTA in order and read back."""
    at = workspace.folder(spark, "fasta")
    sinks.write_fasta(records.fasta(_fasta(spark, sf_dir)), at, "source", "rec", gzip=True)
    return records.fasta_parts(spark, at).select("id", "header", F.md5("seq").alias("seq"))


@query("""select o_orderstatus status, o_orderpriority priority, count(*) n, min(o_orderkey) first_key from orders group by all""")
def scatter_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder for each status and priority."""
    at = workspace.folder(spark, "scatter")
    sinks.write_by(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")), at, "status", "priority")
    return spark.read.parquet(at).groupBy("status", "priority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("""select r_name || '.txt' path, length(r_name)::bigint size, 'regions' || chr(9) || r_name || '.txt' line from region""")
def tar_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small archive, its members and the lines of its manifest."""
    parts = {f"{r[0]}.txt": r[0].encode() for r in table(spark, sf_dir, "region").select("r_name").collect()}
    with tarfile.open(fileobj=io.BytesIO(sinks.tar_of(parts)), mode="r:gz") as tar:
        members = spark.createDataFrame([(m.name, m.size, "regions") for m in tar.getmembers()], "path string, size bigint, kind string")
    lines = sinks.manifest_lines(members, "kind", "path").withColumnRenamed("value", "line")
    return members.join(lines, F.endswith("line", F.concat(F.lit("\t"), "path"))).select("path", "size", "line")


@query("""select n_nationkey, n_name from nation""")
def written_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second write finds the output there and does nothing."""
    at = workspace.folder(spark, "once")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sinks.write_once(n, at)
    sinks.write_once(n.where("n_nationkey < 3"), at)
    return spark.read.parquet(at)


@query("""select l_suppkey contig, l_orderkey as "start", l_linenumber line from lineitem""")
def sorted_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of files whose ranges overlap would be lost."""
    at = workspace.folder(spark, "sorted")
    sinks.write_sorted(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("contig"), F.col("l_orderkey").alias("start"), F.col("l_linenumber").alias("line")), at)
    x = spark.read.parquet(at).withColumn("file", F.col("_metadata.file_name"))
    return x.join(F.broadcast(sinks.overlapping(x)), "file", "left_anti").select("contig", "start", "line")


@query("""select 'in' part, count(*) n, sum(l_quantity) q from lineitem where l_quantity >= 25 union all select 'out', count(*), sum(l_quantity) from lineitem where l_quantity < 25""")
def two_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two outputs of one scan."""
    a, b = (workspace.folder(spark, n) for n in ("in", "out"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    sinks.write_many(li, {a: li.where("l_quantity >= 25"), b: li.where("l_quantity < 25")})
    part = lambda name, at: spark.read.parquet(at).agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return part("in", a).union(part("out", b))


@query("""
with s as (select r_regionkey z, 'M ' || r_regionkey || ',0 L 1,' || r_regionkey || ' Z' p, '#00000' || r_regionkey f from region)
select '<svg xmlns="http://www.w3.org/2000/svg" width="800" height="800" viewBox="-0.5 -0.5 1 1"><g transform="scale(1,-1)">' || string_agg('<path d="' || p || '" fill="' || f || '"/>', '' order by z) || '</g></svg>' drawing from s""")
def drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes in the order of their layers."""
    k = F.col("r_regionkey").cast("string")
    shapes = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("z"), F.concat(F.lit("M "), k, F.lit(",0 L 1,"), k, F.lit(" Z")).alias("path"), F.concat(F.lit("#00000"), k).alias("fill"))
    return spark.createDataFrame([(sinks.svg(shapes),)], "drawing string")


@query("""
select user_id::varchar id, case when max(event_id) % 4 = 0 then 'null' else max_by(props, event_id) end json, max(event_id) % 4 <> 0 found,
case when max(event_id) % 4 = 0 then '{}' else max_by(props, event_id) end got from events group by user_id""")
def key_value_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions put, the later wins; a stored null counts as absent."""
    store = kv.Store(spark, workspace.folder(spark, "store"))
    e = table(spark, sf_dir, "events")
    last = e.groupBy(F.col("user_id").cast("string").alias("id")).agg(F.max("event_id").alias("n"), F.max_by("props", "event_id").alias("json"))
    store.put(last.select("id", F.lit('{"old": 1}').alias("json")), 1)
    store.put(last.select("id", F.when(F.col("n") % 4 == 0, "null").otherwise(F.col("json")).alias("json")), 2)
    have = store.contains(last.select("id")).withColumnRenamed("known", "found")
    return store.items().join(have, "id").join(store.get(last.select("id"), "{}").withColumnRenamed("json", "got"), "id")


# ---- scalar functions -------------------------------------------------------------------------------------------


@query("""
select p_partkey, p_name || '.' || p_size || '.gz' path, p_name || '.' || p_size stem, '.gz' suffix, greatest(1, (p_size - 8) // 40)::bigint cpus,
p_retailprice / 100 - p_size / 2.0e0 as l, p_retailprice / 100 + p_size / 2.0e0 r, p_size - 1.5e0 b, p_size + 1.5e0 t,
sha256('["' || p_partkey || '","' || p_brand || '"]') content_key, (p_partkey % 41) q,
case when p_partkey % 41 >= 20 then 'pacbio-hifi' else 'nano-corr' end || ' --read-error ' || printf('%.6f', pow(10, -least(33, p_partkey % 41) / 10)) args from part""")
def path_and_rule_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("path", F.concat("p_name", F.lit("."), F.col("p_size").cast("string"), F.lit(".gz")))
    left, right, bottom, top = geometry.box(F.col("p_retailprice") / 100, F.col("p_size").cast("double"), F.col("p_size"), F.lit(3.0))
    cpus = F.greatest(F.lit(1), F.floor((F.col("p_size") - 8) / 40)).cast("bigint")
    q = F.col("p_partkey") % 41
    return p.select(
        "p_partkey", "path", scalars.path_stem(F.col("path")).alias("stem"), scalars.path_suffix(F.col("path")).alias("suffix"), cpus.alias("cpus"), left.alias("l"), right.alias("r"), bottom.alias("b"), top.alias("t"),
        scalars.content_key(F.col("p_partkey"), F.col("p_brand")).alias("content_key"), q.alias("q"), S.corrected_args(q).alias("args"),
    )


@query("""
with p as (select event_id, json_extract(props, '$.k')::bigint k, event_type from events)
select event_id, '_raw=x,k=' || k || ',type=' || event_type merged, 'k=' || k || ',type=' || event_type public, event_type got, 'none' missing, '{"k": ' || k || '}' back, true later from p""")
def map_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.queries import _entries

    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k bigint").getField("k").cast("string").alias("k"))
    m = scalars.map_update(F.create_map(F.lit("_raw"), F.lit("x"), F.lit("type"), F.lit("old")), F.create_map(F.lit("k"), F.col("k"), F.lit("type"), F.col("event_type")))
    e = e.withColumn("m", m)
    return e.select(
        "event_id", _entries(F.col("m")).alias("merged"), _entries(scalars.public_keys(F.col("m"))).alias("public"), scalars.get_or(F.col("m"), "type", "none").alias("got"), scalars.get_or(F.col("m"), "absent", "none").alias("missing"),
        scalars.unpack_json(scalars.pack_json(F.concat(F.lit('{"k":'), "k", F.lit("}")))).alias("back"), (scalars.now_millis() > 1_700_000_000_000).alias("later"),
    )


@query("""
with o as (select conv_id, list(role order by turn, text) roles, list(length(text) order by turn, text) lens from conversations group by conv_id),
z as (select conv_id, roles, list_sort(list_transform(range(1, len(roles) + 1), lambda i: {'k': lens[i], 'i': i})) s from o)
select conv_id, array_to_string(list_transform(s, lambda x: roles[x.i]), ',') sorted, array_to_string(list_sort(list_distinct(roles)), ',') distinct_roles, list_contains(roles, 'user') has_user from z""")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in the order of parallel keys, distinct values of two lists, and what both have."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text", "role"))).alias("z"))
    roles = F.transform("z", lambda x: x["role"])
    both = scalars.common(roles, F.array(F.lit("user")))
    return c.select(
        "conv_id", F.array_join(scalars.sorted_by_keys(roles, F.transform("z", lambda x: F.length(x["text"]))), ",").alias("sorted"),
        F.array_join(F.array_sort(scalars.chosen(roles, roles, lambda x: x.isNotNull())), ",").alias("distinct_roles"), (F.size(both) > 0).alias("has_user"),
    )


@query("""
with h as (select p_partkey, (p_partkey * 7919) % 16777216 v from part), c as (select p_partkey, (v // 65536)::double r, ((v // 256) % 256)::double g, (v % 256)::double b from h),
m as (select *, greatest(r, g, b) hi, least(r, g, b) lo from c),
t as (select *, case when hi = lo then 0 when hi = r then (g - b) / (hi - lo) when hi = g then 2 + (b - r) / (hi - lo) else 4 + (r - g) / (hi - lo) end / 6 x from m)
select p_partkey, round(x - floor(x), 6) + 0.0 h, round(case when hi = 0 then 0 else (hi - lo) / hi end, 6) s, round(hi / 255, 6) v,
'rgba(' || printf('%.4f', r) || ',' || printf('%.4f', g) || ',' || printf('%.4f', b) || ',0.5000)' faded, '#' || lower(printf('%02x%02x%02x', r::int, g::int, b::int)) back from t""")
def color_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex to hue, saturation and value and back, and half faded."""
    x = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("#"), F.lpad(F.lower(F.hex((F.col("p_partkey") * 7919) % 16777216)), 6, "0")).alias("c"))
    r, g, b = (colors.hex_channel(F.col("c"), i).cast("double") for i in range(3))
    x = x.withColumn("z", colors.hsv(r, g, b))
    x = x.withColumn("y", colors.from_hsv(F.col("z.h"), F.col("z.s"), F.col("z.v")))
    return x.select("p_partkey", (F.round("z.h", 6) + 0.0).alias("h"), F.round("z.s", 6).alias("s"), F.round("z.v", 6).alias("v"), colors.fade(F.col("c"), 0.5).alias("faded"), colors.hex_of(F.col("y.r"), F.col("y.g"), F.col("y.b")).alias("back"))


@query("""select n_name name, 'docker://quay.io/' || lower(n_name) pointer, 'quay.io/' || lower(n_name) image from nation""")
def image_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = {r[0]: f"docker://quay.io/{r[0].lower()}\n" for r in table(spark, sf_dir, "nation").select("n_name").collect()}
    x = external.containers(spark, rows)
    return x.select("name", F.concat(F.lit("docker://"), "image").alias("pointer"), "image")


# ---- sequences --------------------------------------------------------------------------------------------------

_CODE = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in S.CODONS.items()) + "}"


@query(f"""
with s as (select item_id, {_DNA} seq from benchmark), t as (select item_id, '+' strand, seq from s union all select item_id, '-', translate(reverse(seq), 'ACGT', 'TGCA') from s),
f as (select item_id, strand, f as frame, seq[f + 1:] seq from t, (select unnest([0, 1, 2]) f)),
p as (select item_id, strand, frame, array_to_string(list_transform(range(0, length(seq) // 3), lambda i: code[substr(seq, 3 * i + 1, 3)]), '') protein from f, (select {_CODE} code))
select item_id, strand, frame, rtrim(unnest(regexp_extract_all(protein, 'M[^*]{{9,}}\\*')), '*') orf from p""")
def six_frame_orfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sequences(spark, sf_dir, "benchmark").select("item_id", F.explode(sketches.six_frames(F.col("seq"), 10)).alias("o"))
    return x.select("item_id", "o.strand", "o.frame", F.col("o.protein").alias("orf"))


@query(f"""
with s as (select item_id, {_DNA} seq from benchmark), t as (select item_id, '+' strand, seq from s union all select item_id, '-', translate(reverse(seq), 'ACGT', 'TGCA') from s),
f as (select seq[f + 1:] seq from t, (select unnest([0, 1, 2]) f)),
p as (select array_to_string(list_transform(range(0, length(seq) // 3), lambda i: code[substr(seq, 3 * i + 1, 3)]), '') protein from f, (select {_CODE} code)),
o as (select distinct rtrim(unnest(regexp_extract_all(protein, 'M[^*]{{9,}}\\*')), '*') s from p),
e as (select md5(s) id, s, length(s) n, len(list_filter(range(8, greatest(length(s) - 7, 8), 15), lambda i: translate(s[i + 1], 'LIVMSTFYWEDNQKR', 'ILMVTSYWFDNQERK') <> s[i + 1])) e from o),
h as (select e.id query, x.id subject, 5 * (e.n - e.e) + e.e score, 1 - e.e / e.n as identity, e.n q_end, strpos(x.s, e.s) - 1 s_start from e join e x on contains(x.s, e.s))
select query, subject, score::bigint score, round(identity, 6) as identity, 1::double cover, q_end::bigint q_end, s_start::bigint s_start from h qualify row_number() over (partition by query order by subject) = 1""")
def scored_protein_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items' open frames with every 15th residue replaced by one of its class find the frames that they are from."""
    orfs = sequences(spark, sf_dir, "benchmark").select(F.explode(sketches.six_frames(F.col("seq"), 10)).alias("o")).select(F.col("o.protein").alias("seq")).distinct()
    orfs = workspace.table(orfs.select(F.md5(F.col("seq").cast("binary")).alias("id"), "seq"), "frames")
    swap = lambda c: F.translate(c, "LIVMSTFYWEDNQKR", "ILMVTSYWFDNQERK")
    changed = F.transform(F.split("seq", ""), lambda c, i: F.when((i % 15 == 8) & (i <= F.length("seq") - 8), swap(c)).otherwise(c))
    x = proteins.search(orfs.select("id", F.array_join(changed, "").alias("seq")), orfs).where("pos = 1")
    return x.select("query", "subject", "score", F.round("identity", 6).alias("identity"), "cover", "q_end", "s_start")


@query(f"""
with q as (select distinct item_id * 1000 + p as query, unnest({_KM.format(k=5).replace('seq', 's')}) km from {_PIECES}), c as (select distinct item_id subject, unnest({_KM.format(k=5)}) km from (select item_id, {_DNA} seq from benchmark)),
nq as (select query, count(*) nq from q group by query), nc as (select subject, count(*) nc from c group by subject),
h as (select query, subject, count(*) n from q join c using (km) group by all),
i as (select query, subject, n / least(nq, nc) as identity from h join nq using (query) join nc using (subject) where n / least(nq, nc) >= 0.5 and n >= 0.8 * nq)
select query, subject, round(identity, 6) as identity, row_number() over (partition by query order by identity desc, subject) pos from i""")
def protein_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the items against the items."""
    pieces = _pieces(spark, sf_dir).select((F.col("item_id") * 1000 + F.col("p")).alias("id"), "seq")
    x = centroids.search(pieces, sequences(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "seq"), 0.5)
    return x.withColumn("identity", F.round("identity", 6)).withColumn("pos", long("pos"))


@query(f"""
with a as (select distinct unnest({_KM.format(k=23)}) km from (select {_DNA} seq from benchmark)),
d as (select doc_id, {_DNA} seq from documents), k as (select doc_id, unnest(range(0, greatest(length(seq) - 22, 0))) p, substr(seq, p + 1, 23) km from d), m as (select doc_id, min(p) p from k join a using (km) group by doc_id)
select doc_id, coalesce(p, length(seq))::bigint kept_bases from d left join m using (doc_id)""")
def adapter_trimming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items stand for adapters; exact matches of 23 bases."""
    ad = sequences(spark, sf_dir, "benchmark").select("seq")
    x = reads.trim_adapters(sequences(spark, sf_dir).select("doc_id", "seq"), ad, "doc_id", "seq", 23, 23, 0)
    return x.select("doc_id", F.length("trimmed").cast("bigint").alias("kept_bases"))


@query(f"""
with a as (select {_DNA} a from benchmark), k as (select unnest({_KM.format(k=15).replace('seq', 'a')}) km from a),
near(n, km) as (select 15, km from k union all select n, substr(a, 1, n) from a, (select unnest(range(9, 15)) n) where length(a) >= n),
known as (select distinct n, substr(km, 1, i) || c || substr(km, i + 2) km from near, (select unnest(range(0, 15)) i), (select unnest(['A', 'C', 'G', 'T']) c) where i < n),
r as (select item_id, p, s from {_PIECES}), w as (select item_id, p, substr(s, 3, 40) || 'A' || substr(s, 1, 12) s from r),
z as (select item_id, p, s, 15 n, unnest(range(0, greatest(length(s) - 14, 0))) o from w union all select item_id, p, s, n, length(s) - n from w, (select unnest(range(9, 15)) n) where length(s) >= n),
m as (select item_id, p, min(o) o from z join known on known.n = z.n and known.km = substr(z.s, z.o + 1, z.n) group by all)
select item_id, p, coalesce(o, length(s))::bigint kept_bases from w left join m using (item_id, p)""")
def adapter_trimming_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items stand for adapters, turned pieces of them for reads: k-mers and short ends in which one base may differ."""
    ad = sequences(spark, sf_dir, "benchmark").select("seq")
    s = F.col("seq")
    r = _pieces(spark, sf_dir).select("item_id", "p", F.concat(s.substr(3, 40), F.lit("A"), s.substr(1, 12)).alias("seq"), F.concat_ws(":", "item_id", "p").alias("id"))
    x = reads.trim_adapters(r, ad, "id", "seq", 15, 9, 1)
    return x.select("item_id", "p", F.length("trimmed").cast("bigint").alias("kept_bases"))


@query(f"""
with r as (select item_id, p, s from {_PIECES} where length(s) = 60),
f as (select item_id, p, 30 + (item_id * 7 + p) % 45 n, s from r),
g as (select item_id, p, n, substr(s, 1, n) || case when n < 60 then 'ACCA' else '' end fwd, translate(reverse(substr(s, 1, n)), 'ACGT', 'TGCA') || case when n < 60 then 'GGTT' else '' end rev from f),
m as (select *, list_filter(range(least(length(fwd), length(rev)) - 1, 23, -1), lambda m: substr(fwd, 1, m) = translate(reverse(substr(rev, 1, m)), 'ACGT', 'TGCA')) ms from g)
select item_id, p, length(substr(fwd, 1, coalesce(ms[1], length(fwd))))::bigint n_forward, length(substr(rev, 1, coalesce(ms[1], length(rev))))::bigint n_reverse from m""")
def pair_trimming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of fragments that are shorter than their reads; nothing is known of the adapter."""
    r = _pieces(spark, sf_dir).where(F.length("seq") == 60).withColumn("n", (30 + (F.col("item_id") * 7 + F.col("p")) % 45).cast("int"))
    part = F.col("seq").substr(F.lit(1), F.col("n"))
    more = lambda a: F.when(F.col("n") < 60, F.lit(a)).otherwise(F.lit(""))
    fwd = r.select("item_id", "p", F.concat(part, more("ACCA")).alias("seq"))
    rev = r.select("item_id", "p", F.concat(S.reverse_complement(part), more("GGTT")).alias("seq"))
    none = sequences(spark, sf_dir, "benchmark").select("seq").where("seq = ''")
    x = reads.trim_pairs(fwd, rev, none, ["item_id", "p"], "seq")
    return x.select("item_id", "p", F.length("forward").cast("bigint").alias("n_forward"), F.length("reverse").cast("bigint").alias("n_reverse"))


@query("""
select n_nationkey, case when max(length(p_name)) >= 20 then 'long' else '{"records":[],"version":"mock","input_file":"' || n_nationkey || '","note":"Skipped: all contigs < 20 bp"}' end as value
from nation join part on p_partkey % 25 = n_nationkey group by n_nationkey""")
def gate_or_mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose contigs are all too short get the substitute document."""
    contigs = table(spark, sf_dir, "part").select((F.col("p_partkey") % 25).cast("int").alias("n_nationkey"), F.col("p_name").alias("seq"))
    gate = reports.length_gate(contigs, 20, "n_nationkey")
    done = gate.where("ok").select("n_nationkey", F.lit("long").alias("value"))
    return reports.gated(done, gate, "n_nationkey", 20)


@query("""select c_custkey, ((row_number() over (order by c_custkey) - 1) // 100)::bigint batch from customer""")
def batches_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.batches(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 100)


@query("""
with l as (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) k from orders)
select a.o_orderkey id, b.o_orderkey ancestor from l a join l b on a.o_custkey = b.o_custkey and b.k <= a.k""")
def lineage_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order came from the customer's last one before it, in chains of dozens."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").withColumn("p", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    return lineage(o.select(F.col("o_orderkey").alias("id"), F.lit("t").alias("type"), F.when(F.col("p").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("p")).alias("parents")))


@query("""
with a as (select user_id, event_type, row_number() over w - 1 i, (event_type is distinct from lag(event_type) over w)::int ch from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(ch) over (partition by user_id order by i rows unbounded preceding) run from a), g as (select user_id, event_type, min(i) l, max(i) + 1 r from s group by user_id, event_type, run),
n as (select user_id, count(*) n from events group by user_id), c as (select event_type, row_number() over (order by count(*), event_type) draw_order from g group by event_type)
select user_id, event_type, l, r, draw_order, round(l / n + 0.5 / n, 6) as "start", round(r / n + 0.5 / n, 6) as "end", 4::bigint corners
from g join n using (user_id) join c using (event_type)""")
def categorical_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A straight bar for each user, a color for each event type."""
    x = pangenome.categorical_bar(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "user_id", circular=False)
    corners = F.size(F.split("path", "[ML] ")) - 1
    return x.select("user_id", "event_type", "l", "r", "draw_order", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), corners.cast("bigint").alias("corners"))


# ---- transforms that run ----------------------------------------------------------------------------------------


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the items, and the same read backwards, as reads of three samples, with qualities."""
    x = _pieces(spark, sf_dir).withColumn("seq", F.explode(F.array("seq", F.concat(F.lit("-"), F.reverse("seq"))))).withColumn("back", F.startswith("seq", F.lit("-")).cast("int"))
    x = x.select((F.col("item_id") % 3).cast("string").alias("sample"), (F.col("item_id") * 1000 + 2 * F.col("p") + F.col("back")).alias("id"), F.replace("seq", F.lit("-"), F.lit("")).alias("seq"))
    return x.withColumn("qual", F.when(F.col("sample") == "1", F.translate("seq", "ACGT", "hTdf")).otherwise(F.translate("seq", "ACGT", "5?IF")))


_SAMPLE_READS = f"(select (item_id % 3)::varchar sample, item_id * 1000 + 2 * p + back id, s, length(s) len, translate(s, 'ACGT', case when item_id % 3 = 1 then 'hTdf' else '5?IF' end) qual from (select item_id, p, 0 back, s from {_PIECES} union all select item_id, p, 1, reverse(s) from {_PIECES}))"


@query(f"""
with r as (select * from {_SAMPLE_READS}), a as (select (item_id % 3)::varchar sample, item_id contig, {_DNA} seq from benchmark),
q as (select sample, id, len, unnest(range(0, greatest(len - 14, 0))) qp, substr(s, qp + 1, 15) km from r), k as (select sample, contig, unnest(range(0, greatest(length(seq) - 14, 0))) cp, substr(seq, cp + 1, 15) km from a),
v as (select sample, id, contig, len, cp - qp d, count(*) seeds from q join k using (sample, km) group by all),
h as (select * from v qualify row_number() over (partition by sample, id order by seeds desc, contig, d) = 1),
i as (select h.sample, h.contig, greatest(d, 0) s, least(d + len, length(seq)) e from h join a on a.sample = h.sample and a.contig = h.contig),
c as (select sample, contig, sum(e - s)::double bases from i where s < e group by all), l as (select a.sample, a.contig, length(seq) length, coalesce(bases, 0) bases from a left join c on c.sample = a.sample and c.contig = a.contig),
m as (select sample, count(*) reads, sum(len)::bigint read_bases, min(list_min(list_transform(string_split(qual, ''), lambda c: ord(c)))) code, sum(list_sum(list_transform(string_split(qual, ''), lambda c: ord(c))))::double / sum(len) q from r group by sample),
f as (select r.sample, round(count(h.id) / count(*), 6) fraction_reads_mapped from r left join h on h.sample = r.sample and h.id = r.id group by r.sample)
select sample, fraction_reads_mapped, sum(length)::bigint length, count(*) number_of_contigs, round(sum(bases), 3) covered, any_value(reads) reads, any_value(read_bases) read_bases,
any_value(case when code < 59 then 'sanger' when code < 64 then 'solexa' else 'illumina-1.3+' end) phred_encoding, any_value(round(q - case when code < 59 then 33 else 64 end, 6)) mean_quality
from l join m using (sample) join f using (sample) group by sample, fraction_reads_mapped""")
def reads_to_assembly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans the statistics of given assemblies and of their reads, for three samples at once, and runs the plan."""
    asm = sequences(spark, sf_dir, "benchmark").select((F.col("item_id") % 3).cast("string").alias("sample"), F.col("item_id").alias("id"), "seq")
    x = _reads(spark, sf_dir)
    meta = x.select("sample").distinct().withColumn("length_class", F.lit("short")).withColumn("parity", F.lit("single"))
    items = [Item("meta", "sequences::read_metadata"), Item("reads", "sequences::long_reads", frozenset({"meta"})), Item("asm", "sequences::flye_assembly", frozenset({"meta", "reads"}))]
    p = Planner(standard(), catalogue.standard())
    plan = p.plan(items, [("sequences::read_qc_stats", ["reads"]), ("sequences::assembly_stats", ["reads"]), ("sequences::assembly_per_contig_coverage", ["reads"])])
    got = p.run(plan, {"meta": meta, "reads": x, "asm": asm})
    stats, qc, cov = (got[f"sequences::{k}"] for k in ("assembly_stats", "read_qc_stats", "assembly_per_contig_coverage"))
    cov = cov.groupBy("sample").agg(F.round(F.sum(F.col("fold_coverage") * F.col("contig_length")), 3).alias("covered"))
    out = stats.select("sample", F.round("fraction_reads_mapped", 6).alias("fraction_reads_mapped"), "length", "number_of_contigs").join(cov, "sample")
    return out.join(qc.select("sample", "reads", F.col("bases").alias("read_bases"), "phred_encoding", F.round("mean_quality", 6).alias("mean_quality")), "sample")


@query(f"""
with r as (select *, list_sum(list_transform(string_split(qual, ''), lambda c: ord(c)))::double / len q from {_SAMPLE_READS}),
h as (select sample, len, count(*) n from r group by all), c as (select *, sum(len * n) over (partition by sample order by len desc rows unbounded preceding) cum, sum(len * n) over (partition by sample) total from h), n as (select sample, max(len) n50 from c where 2 * cum >= total group by sample)
select sample, id, len >= least(51, greatest(n50 // 3 + 1, 20)) and q - case when sample = '1' then 64 else 33 end >= 3 is_clean from r join n using (sample)""")
def reads_to_clean_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of short reads, then the rules that keep or discard them."""
    x = _reads(spark, sf_dir)
    p = Planner(standard(), [t for t in catalogue.standard() if t.name in ("seqkit_reads", "bbduk")])
    items = [Item("meta", "sequences::read_metadata"), Item("reads", "sequences::short_reads_se", frozenset({"meta"}))]
    plan = p.plan(items, [("sequences::clean_short_reads", ["reads"]), ("sequences::discarded_short_reads", ["reads"])])
    got = p.run(plan, {"meta": x.select("sample").distinct(), "reads": x})
    part = lambda k, v: got[f"sequences::{k}"].select("sample", "id", F.lit(v).alias("is_clean"))
    return part("clean_short_reads", True).union(part("discarded_short_reads", False))


@query("""select c_custkey sample, r_name image, 'docker://' || lower(r_name) pointer from customer, region""")
def samples_with_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers stand for samples, regions for images."""
    images = table(spark, sf_dir, "region").select(F.col("r_name").alias("image"), F.concat(F.lit("docker://"), F.lower("r_name")).alias("pointer"))
    x = attached(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample")), images)
    return x.select("sample", "resource.image", "resource.pointer")


@query("""

select r_regionkey::varchar region, r_name || '.json' id, 'sequences::read_metadata' as type, 0::bigint ancestors from region
union all select n_regionkey::varchar, n_name || '.acc', 'ncbi::assembly_accession', 1 from nation""")
def sample_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library of one metadata value for each region and an accession for each nation, saved, loaded and split into samples."""
    lib = DataLibrary(workspace.folder(spark, "library"), standard())
    names = {}
    for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect():
        names[r["r_regionkey"]] = lib.add_value(f"{r['r_name']}.json", {"acc": r["r_name"]}, "sequences::read_metadata")
    for n in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        lib.add_value(f"{n['n_name']}.acc", n["n_name"], "ncbi::assembly_accession", [names[n["n_regionkey"]]])
    lib.save(spark)
    again = DataLibrary.load(spark, lib.path)
    heads = {v: str(k) for k, v in names.items()}
    rows = [(heads[min(i.id for i in v.instances() if i.id in heads)], i.id, i.type, len(i.ancestors)) for v in again.as_samples("sequences::read_metadata") for i in v.items()]
    return spark.createDataFrame(rows, "region string, id string, type string, ancestors bigint")


@query(f"""
with k as (select doc_id, seq, list_sort(list_distinct({_CANON.format(k=15)})) ks from (select doc_id, {_DNA} seq from documents)),
g as (select doc_id, case when len(ks) > 0 then md5(array_to_string(ks, ',')) else 'short ' || seq end g from k),
f as (select doc_id orf_id, min(doc_id) over (partition by g) centroid_id from g)
select orf_id, centroid_id, case when orf_id = centroid_id then 'new_centroid' else 'matched' end status from f""")
def stream_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in four parts by their ids, each of as many files as tasks write; a document whose k-mers are those of an earlier one finds it in the stream's state, which the restarted stream has from its checkpoint."""
    d = sequences(spark, sf_dir).select(F.col("doc_id").alias("orf_id"), "seq")
    at = workspace.folder(spark, "stream")
    step = (d.agg(F.max("orf_id")).first()[0] or 0) // 4 + 1
    for i in range(4):
        d.where((F.col("orf_id") >= i * step) & (F.col("orf_id") < (i + 1) * step)).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(d.schema).parquet(f"{at}/in")
        arriving.assign_stream(stream, f"{at}/out", f"{at}/checkpoint", k=15, least=1.0).awaitTermination()
    return spark.read.schema("orf_id bigint, centroid_id bigint, status string").parquet(f"{at}/out")


@query("""
with i as (select l_linenumber::bigint contig, l_orderkey::bigint id, floor(l_extendedprice)::bigint as "start", floor(l_extendedprice)::bigint + (l_quantity * 40)::bigint as "end" from lineitem),
r as (select n_nationkey region, (n_nationkey % 7 + 1)::bigint contig, n_nationkey * 4000 a, n_nationkey * 4000 + 1500 b from nation)
select region, count(*) n, min(id) first_id, sum("end" - "start")::bigint bases from r join i on i.contig = r.contig and i."start" < r.b and i."end" > r.a group by region""")
def region_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as alignments, written with their index; nations as regions."""
    at = F.floor(F.col("l_extendedprice")).cast("bigint")
    x = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("contig"), F.col("l_orderkey").cast("bigint").alias("id"), at.alias("start"), (at + (F.col("l_quantity") * 40).cast("bigint")).alias("end"))
    path = workspace.folder(spark, "index")
    intervals.write(x, path)
    n = F.col("n_nationkey").cast("bigint")
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("region"), (n % 7 + 1).alias("contig"), (n * 4000).alias("r_start"), (n * 4000 + 1500).alias("r_end"))
    found = intervals.overlapping(spark.read.parquet(path), regions)
    return found.groupBy("region").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.sum(F.col("end") - F.col("start")).alias("bases"))


@query(f"""
with d as (select doc_id, {_DNA} seq from documents)
select '@' || doc_id header, length(seq)::bigint bases, md5(seq) seq, md5(repeat('@', length(seq)::int)) quality from d""")
def fastq_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as FASTQ files, whose headers and qualities begin with the mark of a record, read back in ranges of 64 kB."""
    x = sequences(spark, sf_dir).select(F.concat(F.lit("@@"), "doc_id", F.lit("\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("@"), F.length("seq"))).alias("value"))
    at = workspace.folder(spark, "fastq")
    x.write.text(at)
    paths = [r[0] for r in spark.read.format("binaryFile").load(at).select("path").where("path like '%.txt'").collect()]  # one a written part
    y = fastq.read(spark, paths, 1 << 16)
    return y.select("header", F.length("seq").cast("bigint").alias("bases"), F.md5(F.col("seq").cast("binary")).alias("seq"), F.md5(F.col("quality").cast("binary")).alias("quality"))


@query()
def gene_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as contigs, frames of 20 codons or more; no SQL, as the choice is a dynamic programme."""
    x = proteins.genes(sequences(spark, sf_dir).select(F.col("doc_id").alias("contig"), "seq"), least=20, long=40)
    return x.withColumn("score", F.round("score", 6))


@query()
def family_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of the families by expectation-maximisation, which SQL has no loop for."""
    x = mixture.partition(_matrix(spark, sf_dir).where("n > 0"))
    return x.withColumn("p", F.transform("p", lambda v: F.round(v, 4)))
