"""Queries over the test tables, one or more for each operator, each with the SQL that must give the same rows.

The tables are no biological files, so columns stand in: texts for sequences (letters to bases), order lines for
reads with qualities, events for alignments, parts by nation for gene families by genome.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake import workspace
from strandlake.functions import colors, geometry, scalars
from strandlake.functions import sequence as S
from strandlake.operators import assembly, centroids, clustering, coverage, kv, mapping, pangenome, reads, reports, sketches, taxonomy
from strandlake.plans import catalogue
from strandlake.plans.planner import Item, Planner
from strandlake.plans.types import standard
from strandlake.sources import records, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c: str) -> Column:
    return F.col(c).cast("bigint").alias(c)


_DNA = "regexp_replace(translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC'), '[^ACGT]', '', 'g')"
_GC = "len(regexp_extract_all({}, '[GC]'))"


def sequences(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return table(spark, sf_dir, name).withColumn("seq", S.dna(F.col("text")))


# ---- statistics -------------------------------------------------------------------------------------------------


@query(f"""
with s as (select lang, {_DNA} seq from documents), x as (select lang, length(seq) len, {_GC.format('seq')} gc from s),
h as (select lang, len, count(*) n from x group by all),
c as (select *, sum(len * n) over (partition by lang order by len desc rows unbounded preceding) cum, sum(len * n) over (partition by lang) total from h),
n as (select lang, max(len) n50 from c where 2 * cum >= total group by lang)
select lang, count(*) num_seqs, sum(len)::bigint sum_len, min(len) min_len, round(avg(len), 6) avg_len, max(len) max_len,
quantile_cont(len, 0.25) q1, quantile_cont(len, 0.5) q2, quantile_cont(len, 0.75) q3, round(sum(gc) * 100.0e0 / sum(len), 6) gc, any_value(n50) n50
from x join n using (lang) group by lang""")
def seq_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = reads.stats(sequences(spark, sf_dir), "seq", "lang")
    return x.withColumn("gc", F.round("gc", 6)).withColumn("avg_len", F.round("avg_len", 6))


@query("""
with h as (select source, length(text) len, count(*) n from documents group by all),
c as (select *, sum(len * n) over (partition by source order by len desc rows unbounded preceding) cum, sum(len * n) over (partition by source) total from h)
select source, max(len) n50 from c where 2 * cum >= total group by source""")
def n50_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", F.length("text").cast("bigint").alias("len"))
    return reads.n50(d, "len", "source")


@query("""
with h as (select source, length(text) len, count(*) n from documents group by all),
c as (select *, sum(len * n) over (partition by source order by len desc rows unbounded preceding) cum, sum(len * n) over (partition by source) total from h),
n as (select source, max(len) n50 from c where 2 * cum >= total group by source),
m as (select source, min(list_min(list_transform(string_split(text, ''), lambda c: ord(c)))) least_code from documents where text <> '' group by source)
select source, n50, least(51, greatest(n50 // 3 + 1, 20)) min_length,
       case when least_code < 59 then 'sanger' when least_code < 64 then 'solexa' else 'illumina-1.3+' end phred_encoding,
       case when least_code < 59 then 33 else 64 end::bigint phred_offset
from n join m using (source)""")
def adaptive_min_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", F.length("text").cast("bigint").alias("len"), F.ascii(F.array_min(F.split("text", ""))).alias("code"))
    x = reads.n50(d, "len", "source").join(d.groupBy("source").agg(S.quality_encoding(F.min("code")).alias("phred_encoding")), "source")
    return x.withColumn("min_length", S.adaptive_min_length(F.col("n50"))).withColumn("phred_offset", S.phred_offset(F.col("phred_encoding")).cast("bigint"))


@query(f"""
with s as (select doc_id, {_DNA} seq from documents)
select doc_id, length(seq) len, {_GC.format('seq')} gc, md5(translate(reverse(seq), 'ACGT', 'TGCA')) revcomp from s""")
def revcomp_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir).select("doc_id", F.length("seq").cast("bigint").alias("len"), S.gc_count(F.col("seq")).alias("gc"), F.md5(S.reverse_complement(F.col("seq"))).alias("revcomp"))


@query(f"""
with s as (select doc_id, {_DNA} seq from documents), o as (select doc_id, unnest(regexp_extract_all(seq, 'ATG(?:[ACGT]{{3}}){{10,}}?(?:TAA|TAG|TGA)')) orf from s)
select doc_id, count(*) orfs, sum(length(orf))::bigint orf_bases, max(length(orf)) longest from o group by doc_id""")
def orf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sequences(spark, sf_dir).select("doc_id", F.explode(sketches.open_frames(F.col("seq"))).alias("orf"))
    return x.groupBy("doc_id").agg(F.count("*").alias("orfs"), F.sum(F.length("orf")).alias("orf_bases"), F.max(F.length("orf")).cast("bigint").alias("longest"))


# ---- scans and scalar parsing -----------------------------------------------------------------------------------


@query("""
with l as (select doc_id, generate_subscripts(ls, 1) - 1 pos, unnest(ls) line from (select doc_id, string_split(text, chr(10)) ls from documents)),
r as (select *, sum((line like 'T%')::int) over (partition by doc_id order by pos rows unbounded preceding) rec from l)
select doc_id, rec::bigint rec, count(*) n_lines, sum(case when line like 'T%' then 0 else length(line) end)::bigint body_len, max(case when line like 'T%' then regexp_extract(line, '^(\\S*)', 1) end) id
from r where rec > 0 group by all""")
def record_scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin with T stand for headers."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    head = F.startswith("line", F.lit("T"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("rec", F.sum(head.cast("bigint")).over(w)).where("rec > 0")
    return x.groupBy("doc_id", "rec").agg(F.count("*").alias("n_lines"), F.sum(F.when(head, 0).otherwise(F.length("line"))).alias("body_len"), F.max(F.when(head, F.regexp_extract("line", r"^(\S*)", 1))).alias("id"))


def _fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document a FASTA file: its sequence in lines of 60 under its id, two short records, of which one has the id again, and an empty one."""
    d = sequences(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source"), "lang", F.regexp_replace("seq", "(.{60})", "$1\n").alias("seq"))
    parts = F.concat(F.lit(">"), "source", F.lit(" "), "lang", F.lit("\n"), "seq", F.lit("\n>b\tx\nACGT\nAC\n>"), "source", F.lit(" again\nTT\n>empty\n"))
    return d.select("source", parts.alias("content"))


@query("""
select doc_id::varchar source, unnest([{'id': doc_id::varchar, 'n': 2}, {'id': E'b\\tx', 'n': 6}, {'id': 'empty', 'n': 0}]).id id,
unnest([{'id': doc_id::varchar, 'n': 2}, {'id': E'b\\tx', 'n': 6}, {'id': 'empty', 'n': 0}]).n::bigint length from documents""")
def fasta_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of records with equal ids the last counts."""
    return records.lengths(records.lines(_fasta(spark, sf_dir)), "source")


@query(f"""
with s as (select doc_id, lang, {_DNA} seq from documents)
select doc_id::varchar source, 1::bigint rec, doc_id::varchar id, doc_id || ' ' || lang header, md5(seq) seq, length(seq)::bigint length, ceil(length(seq) / 60)::bigint n_lines from s
union all select doc_id::varchar, 2, 'b', E'b\\tx', md5('ACGTAC'), 6, 2 from s
union all select doc_id::varchar, 3, doc_id::varchar, doc_id || ' again', md5('TT'), 2, 1 from s
union all select doc_id::varchar, 4, 'empty', 'empty', md5(''), 0, 0 from s""")
def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = records.fasta(_fasta(spark, sf_dir))
    n = F.size(F.filter("seq_lines", lambda v: v != "")).cast("bigint")
    return x.select("source", "rec", "id", "header", F.md5("seq").alias("seq"), F.length("seq").cast("bigint").alias("length"), n.alias("n_lines"))


@query("""
with l as (select p_partkey, case p_partkey % 4 when 0 then 'DEFINITION  ' || p_name || ' str. K-12 substr. ' || p_brand || ', complete genome.' when 1 then 'DEFINITION  ' || p_name || ' strain ' || p_brand
  when 2 then 'DEFINITION ' || p_type || '.' else 'DEFINITION' end line from part)
select p_partkey, case p_partkey % 4 when 3 then 'unnamed' when 2 then translate(replace(trim(replace(line, 'DEFINITION', '')), ' ', '-'), ',.''"', '')
  else translate(regexp_extract(line, '(?:substr\\.?\\s?|strain\\s?)(\\S+)', 1), ',.''"', '') end strain from l""")
def strain_name_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts stand for organisms."""
    k = F.col("p_partkey") % 4
    line = F.when(k == 0, F.concat(F.lit("DEFINITION  "), "p_name", F.lit(" str. K-12 substr. "), "p_brand", F.lit(", complete genome."))).when(k == 1, F.concat(F.lit("DEFINITION  "), "p_name", F.lit(" strain "), "p_brand"))
    line = line.when(k == 2, F.concat(F.lit("DEFINITION "), "p_type", F.lit("."))).otherwise(F.lit("DEFINITION"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.strain_name(line, F.lit("unnamed")).alias("strain"))


@query("""
with v as (select o_orderkey, case o_orderkey % 6 when 0 then o_custkey::varchar when 1 then o_custkey || '.0' when 2 then o_custkey || '.25%' when 3 then o_custkey || 'e3' when 4 then o_orderpriority end x from orders),
s as (select *, regexp_replace(x, '%$', '') t from v)
select o_orderkey, x, case when x is null then null when position('.' in t) = 0 and regexp_matches(t, '^[+-]?[0-9]+$') and try_cast(t as bigint) is not null then 'int' when try_cast(t as double) is not null then 'float' else 'string' end kind, try_cast(t as double) v from s""")
def numeric_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    x = F.when(k == 0, c).when(k == 1, F.concat(c, F.lit(".0"))).when(k == 2, F.concat(c, F.lit(".25%"))).when(k == 3, F.concat(c, F.lit("e3"))).when(k == 4, F.col("o_orderpriority"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", x.alias("x"))
    return o.select("o_orderkey", "x", scalars.numeric_kind(F.col("x")).alias("kind"), scalars.numeric_value(F.col("x")).alias("v"))


@query("""
select user_id, count(*) n, sum(json_extract(props, '$.k')::bigint)::bigint sum_k, max(json_extract(props, '$.k')::bigint) max_k from events group by user_id""")
def json_field_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select("user_id", F.from_json("props", "k bigint").getField("k").alias("k"))
    return x.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k"))


@query("""
select user_id, event_type || chr(9) || event_id::varchar report, event_type k, event_id::varchar v from events""")
def kv_report_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select("user_id", F.concat("event_type", F.lit("\t"), F.col("event_id").cast("string")).alias("report"))
    return x.select("user_id", "report", F.explode(tables.key_values(F.col("report"))).alias("k", "v"))


@query("""
with e as (select user_id, event_type, count(*) n, round(avg(value), 3) m from events group by all), b as (select *, row_number() over (partition by user_id order by event_type) no from e)
select user_id::varchar source, no::bigint no, event_type block, 'Measure' first_header, list_transform(['count', 'mean'], lambda x: x)[i] measure, case i when 1 then 'int' else 'float' end kind, case i when 1 then n::double else m end v
from b, (select unnest([1, 2]) i)""")
def block_report_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each user, with a block for each event type; values are typed as they read."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("m"))
    one = F.concat(F.lit(">>"), "event_type", F.lit("\tpass\n#Measure\tValue\ncount\t"), "n", F.lit("\nmean\t"), F.format_string("%.3f", "m"), F.lit("\n>>END_MODULE"))
    text = e.groupBy(F.col("user_id").cast("string").alias("source")).agg(F.array_join(F.array_sort(F.collect_list(one)), "\n").alias("content"))
    x = tables.blocks(text).select("source", F.col("no").cast("bigint").alias("no"), "block", F.get("header", F.lit(0)).alias("first_header"), F.explode("rows").alias("cells"))
    cell = F.get("cells", F.lit(1))
    return x.select("source", "no", "block", "first_header", F.get("cells", F.lit(0)).alias("measure"), scalars.numeric_kind(cell).alias("kind"), scalars.numeric_value(cell).alias("v"))


@query(f"""select doc_id::varchar source, length({_DNA}) >= 1000 any_long from documents""")
def long_record_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.any_longer(records.lines(_fasta(spark, sf_dir)), 1000, "source")


@query("""select p_partkey, split_part(split_part(p_name, '.', 1), '_', 1) accession, regexp_extract_all(p_type, '\\w+')[1] first_word, len(regexp_extract_all(p_type, '\\w+')) words from part""")
def accession_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scalars.all_matches(F.col("p_type"), r"\w+")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.accession_of(F.col("p_name")).alias("accession"), F.get(found, F.lit(0)).alias("first_word"), F.size(found).cast("bigint").alias("words"))


@query("""
with n as (select s_suppkey, s_suppkey || '/' || ['genomic.gff', 'genomic.gbff', 'protein.faa', 'GCF_' || s_suppkey || '_genomic.fna', 'cds_from_genomic.fna', 'README'][1 + s_suppkey % 6] path from supplier)
select ['gff', 'gbk', 'orfs', 'assembly', null, null][1 + s_suppkey % 6] as role, path from n""")
def file_role_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("genomic.gff", "genomic.gbff", "protein.faa", "GCF_%_genomic.fna", "cds_from_genomic.fna", "README")))
    name = F.replace(F.get(names, (F.col("s_suppkey") % 6).cast("int")), F.lit("%"), F.col("s_suppkey").cast("string"))
    return tables.by_role(table(spark, sf_dir, "supplier").select(F.concat("s_suppkey", F.lit("/"), name).alias("path"))).select("role", "path")


@query("""
with a as (select n_name k, 'a' v, 0 o from nation where n_regionkey < 3), b as (select n_name k, 'b' v, 1 o from nation where n_regionkey > 1), u as (select * from a union all select * from b)
select k, max_by(v, o) v from u group by k""")
def summary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("k"), "n_regionkey")
    return tables.union_by_key([n.where("n_regionkey < 3").select("k", F.lit("a").alias("v")), n.where("n_regionkey > 1").select("k", F.lit("b").alias("v"))], "k")


# ---- filtering and budgets --------------------------------------------------------------------------------------


@query("""
with r as (select l_orderkey read, count(*) len, avg(l_quantity) q, count(*) filter (where l_returnflag = 'N') ns from lineitem group by all)
select read, len, ns, (len >= 3 and q >= 20 and ns <= 4) is_clean from r""")
def read_qc_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _order_reads(spark, sf_dir)
    return reads.qc_split(r, F.col("len"), F.col("q"), F.col("ns"), F.lit(3), 20, 4).select("read", "len", "ns", "is_clean")


def _order_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("read"))
    return li.agg(F.count("*").alias("len"), F.avg("l_quantity").alias("q"), F.count_if(F.col("l_returnflag") == "N").alias("ns"))


@query("""
with r as (select l_orderkey read, avg(l_quantity) q from lineitem group by all)
select read, case when q >= 30 then 'asm5' when q >= 20 then 'asm10' else 'asm20' end aligner, case when q >= 20 then 'ava-pb' else 'ava-ont' end overlap, round(pow(10, -least(33, q) / 10), 6) error from r""")
def read_error_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("q")
    return _order_reads(spark, sf_dir).select("read", S.aligner_preset(F.lit("long"), q).alias("aligner"), S.overlap_preset(q).alias("overlap"), F.round(S.error_rate(q), 6).alias("error"))


@query("""
with v as (select c_custkey, ['long', 'short', 'other'][1 + c_custkey % 3] length_class, ['single', 'paired', 'other'][1 + c_nationkey % 3] parity from customer)
select c_custkey, case when length_class = 'long' then 'long_reads' when length_class = 'short' and parity = 'paired' then 'short_reads_pe' when length_class = 'short' then 'short_reads_se' end product,
case parity when 'paired' then '--12' when 'single' then '-r' end flag from v""")
def read_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c, *v: F.get(F.array(*(F.lit(x) for x in v)), (F.col(c) % 3).cast("int"))
    x = table(spark, sf_dir, "customer").select("c_custkey", pick("c_custkey", "long", "short", "other").alias("length_class"), pick("c_nationkey", "single", "paired", "other").alias("parity"))
    known = F.when(F.col("parity") != "other", F.col("parity"))
    return x.select("c_custkey", S.read_route(F.col("length_class"), F.col("parity")).alias("product"), F.when(known.isNotNull(), S.interleaved_flag(F.coalesce(known, F.lit("single")))).alias("flag"))


_BUDGET = """
with r as (select l_orderkey read, count(*) len, round(avg(l_quantity), 6) q from lineitem group by all),
c as (select *, sum(len) over (order by q desc, read rows unbounded preceding) - len before, sum(len) over () total from r)
select read, len, q from c where before < {}"""


@query(_BUDGET.format("0.9 * total"))
def keep_best_90pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _order_reads(spark, sf_dir).withColumn("q", F.round("q", 6))
    return reads.best_bases(r, "len", "q", "read", share=0.9).select("read", "len", "q")


@query(_BUDGET.format("(select count(*) * 5 from part)"))
def keep_target_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budget is five times the size of another table, as a target is so many times the size of an assembly."""
    r = _order_reads(spark, sf_dir).withColumn("q", F.round("q", 6))
    size = table(spark, sf_dir, "part").agg((F.count("*") * 5).alias("goal"))  # one row
    return reads.best_bases(r.crossJoin(F.broadcast(size)), "len", "q", "read", target=F.col("goal")).select("read", "len", "q")


@query("""select o_orderkey, o_orderstatus from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')""")
def discarded_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return reads.discarded(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), kept, "o_orderkey")


@query("""
with t as (select conv_id, role, turn, text, row_number() over (partition by conv_id, role order by turn, text) rn from conversations where role in ('user', 'assistant')),
p as (select conv_id, rn from t where role = 'user' intersect select conv_id, rn from t where role = 'assistant')
select conv_id, rn::bigint rn, case when role = 'user' then 1 else 2 end side, turn from t join p using (conv_id, rn)""")
def interleave_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", "text")
    c = c.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "text")).cast("bigint"))
    part = lambda role: c.where(F.col("role") == role).select("conv_id", "rn", "turn")
    return reads.interleave(part("user"), part("assistant"), ["conv_id", "rn"]).select("conv_id", "rn", "side", "turn")


# ---- coverage ---------------------------------------------------------------------------------------------------


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("timestampdiff(MINUTE, timestamp_ntz'2024-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("contig"), start.alias("start"), (start + F.floor("value").cast("bigint") + 1).alias("end"))


_RUNS = """
iv as (select user_id contig, floor(epoch(ts) / 60)::bigint - 28401120 s, floor(epoch(ts) / 60)::bigint - 28401120 + floor(value)::bigint + 1 e from events),
ev as (select contig, pos, sum(d) d from (select contig, s pos, 1 d from iv union all select contig, e, -1 from iv) group by all having sum(d) <> 0),
rn as (select contig, pos as "start", lead(pos) over w as "end", sum(d) over (partition by contig order by pos rows unbounded preceding)::bigint depth from ev window w as (partition by contig order by pos)),
runs as (select * from rn where depth > 0)"""


@query(f"""with {_RUNS} select contig, "start", "end", depth from runs""")
def coverage_bedgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.depth_runs(_intervals(spark, sf_dir))


@query(f"""
with {_RUNS}, c as (select c_custkey contig, 50000 + c_custkey contig_length from customer union select user_id, 50000 + user_id from events),
s as (select contig, sum(("end" - "start") * depth::double) s from runs group by contig)
select contig, round(coalesce(s / contig_length, 0), 6) fold_coverage, contig_length from c left join s using (contig)""")
def contig_mean_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs are customers and users; most customers have no events."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("contig")).union(table(spark, sf_dir, "events").select("user_id")).distinct()
    out = coverage.mean_coverage(coverage.depth_runs(_intervals(spark, sf_dir)), ids.withColumn("contig_length", F.col("contig") + 50000))
    return out.withColumn("fold_coverage", F.round("fold_coverage", 6))


@query("""select c_custkey contig from customer where c_custkey not in (select user_id from events)""")
def uncovered_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.uncovered(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("contig")), _intervals(spark, sf_dir))


_FLAGS = """
f as (select (l_orderkey * 7 + l_partkey) % 4096 flag from lineitem),
k as (select flag, (flag & 512) <> 0 qc from f),
c as (select unnest([{'category': 'total', 'p': true}, {'category': 'secondary', 'p': (flag & 256) <> 0}, {'category': 'supplementary', 'p': (flag & 2048) <> 0}, {'category': 'duplicates', 'p': (flag & 1024) <> 0},
    {'category': 'mapped', 'p': (flag & 4) = 0}, {'category': 'paired', 'p': (flag & 1) <> 0}, {'category': 'properly paired', 'p': (flag & 1) <> 0 and (flag & 2) <> 0 and (flag & 4) = 0}]) z, qc from k),
n as (select z.category category, count(*) filter (where z.p and not qc) passed, count(*) filter (where z.p and qc) failed from c group by all)"""


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(((F.col("l_orderkey") * 7 + F.col("l_partkey")) % 4096).alias("flag"))


@query(f"with {_FLAGS} select * from n")
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.flag_counts(_flags(spark, sf_dir))


@query(f"""with {_FLAGS} select max(passed) filter (where category = 'mapped') mapped, max(passed) filter (where category = 'total') total,
round(max(passed) filter (where category = 'mapped') / max(passed) filter (where category = 'total'), 6) fraction_mapped from n""")
def fraction_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = coverage.fraction_mapped(coverage.flag_counts(_flags(spark, sf_dir)))
    return x.withColumn("fraction_mapped", F.round("fraction_mapped", 6))


@query(f"""
with {_FLAGS}, s as (select {_DNA} seq from benchmark), x as (select length(seq) len, {_GC.format('seq')} gc from s), hh as (select len, count(*) n from x group by len),
cu as (select *, sum(len * n) over (order by len desc rows unbounded preceding) cum, sum(len * n) over () total from hh)
select (select round(max(passed) filter (where category = 'mapped') / max(passed) filter (where category = 'total'), 6) from n) fraction_reads_mapped,
(select sum(len)::bigint from x) length, (select max(len) from cu where 2 * cum >= total) N50, (select round(sum(gc) * 100.0e0 / sum(len), 6) from x) GC, (select count(*) from x) number_of_contigs,
(select string_agg(category || '=' || passed, ',' order by category) from n) raw_mapping, (select 'max_len=' || max(len) || ',min_len=' || min(len) || ',num_seqs=' || count(*) || ',sum_len=' || sum(len) from x) raw_seqkit""")
def assembly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = reports.assembly_stats(sequences(spark, sf_dir, "benchmark"), "seq", _flags(spark, sf_dir))
    x = x.withColumn("raw_mapping", _entries(F.col("_raw_mapping"))).withColumn("raw_seqkit", _entries(F.map_filter("_raw_seqkit", lambda k, v: k.isin("num_seqs", "sum_len", "min_len", "max_len"))))
    return x.drop("_raw_mapping", "_raw_seqkit").withColumn("fraction_reads_mapped", F.round("fraction_reads_mapped", 6)).withColumn("GC", F.round("GC", 6))


def _entries(m: Column) -> Column:
    """A map as text, in the order of its keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


#: Reads with a quality for each base: odd sources count from 64, even ones from 33.
_QUAL = f"translate({_DNA}, 'ACGT', case when source[4:]::int % 2 = 0 then '5?IF' else 'hTdf' end)"


def _qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.substring("source", 4, 10).cast("int") % 2 == 0
    return sequences(spark, sf_dir).withColumn("qual", F.when(even, F.translate("seq", "ACGT", "5?IF")).otherwise(F.translate("seq", "ACGT", "hTdf")))


@query(f"""
with x as (select source, length({_DNA}) len, {_GC.format(_DNA)} gc, {_QUAL} qual from documents),
y as (select *, list_transform(string_split(qual, ''), lambda c: ord(c)) codes from x),
e as (select source, min(list_min(codes)) c, sum(list_sum(codes))::double / sum(len) m from y where len > 0 group by source),
h as (select source, len, count(*) n from x group by all),
c as (select *, sum(len * n) over (partition by source order by len desc rows unbounded preceding) cum, sum(len * n) over (partition by source) total from h), n as (select source, max(len) n50 from c where 2 * cum >= total group by source)
select source, count(*) reads, sum(len)::bigint bases, round(any_value(m - case when c < 59 then 33 else 64 end), 6) mean_quality, any_value(case when c < 59 then 'sanger' when c < 64 then 'solexa' else 'illumina-1.3+' end) phred_encoding,
any_value(n50) N50, round(sum(gc) * 100.0e0 / sum(len), 6) GC, max(len)::varchar raw_max_len, count(*)::varchar raw_num_seqs from x join n using (source) join e using (source) group by source""")
def read_qc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = reports.read_qc_stats(_qualities(spark, sf_dir), "seq", "qual", "source")
    x = x.withColumn("raw_max_len", F.col("_raw")["max_len"]).withColumn("raw_num_seqs", F.col("_raw")["num_seqs"]).drop("_raw")
    return x.withColumn("GC", F.round("GC", 6)).withColumn("mean_quality", F.round("mean_quality", 6))


_MEDIAN = """
with p as (select l_returnflag, l_quantity, count(*) w from lineitem group by all),
c as (select *, sum(w) over (partition by l_returnflag order by l_quantity rows unbounded preceding) cum, sum(w) over (partition by l_returnflag) total from p)
select l_returnflag, {}(l_quantity) as median from c where 2 * cum >= total group by l_returnflag"""


@query(_MEDIAN.format("min"))
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", F.lit(1).alias("w"))
    return reports.weighted_median(li, "l_quantity", "w", "l_returnflag")


@query(_MEDIAN.format("max"))
def weighted_median_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", F.lit(1).alias("w"))
    return reports.weighted_median(li, "l_quantity", "w", "l_returnflag", compat=True)


# ---- centroids and groups ---------------------------------------------------------------------------------------

_HITS = "h as (select l_orderkey query, l_suppkey subject, l_shipdate, l_partkey from lineitem where l_quantity >= 25)"
_BEST = f"{_HITS}, b as (select query, min_by(subject, (l_shipdate, l_partkey, subject)) subject from h group by query)"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_quantity >= 25")
    return li.select(F.col("l_orderkey").alias("query"), F.col("l_suppkey").alias("subject"), F.struct("l_shipdate", "l_partkey", "l_suppkey").alias("pos"))


@query(f"with {_HITS} select p_partkey, p_name from part where p_partkey in (select distinct subject from h)")
def centroid_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return centroids.centroid_records(p, _hits(spark, sf_dir), "p_partkey", "subject")


@query(f"with {_BEST} select o_orderkey orf_id, coalesce(subject, o_orderkey) centroid_id, case when subject is null then 'new_centroid' else 'matched' end status from orders left join b on query = o_orderkey")
def assign_to_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.assign(table(spark, sf_dir, "orders").select("o_orderkey"), _hits(spark, sf_dir), "o_orderkey")


@query(f"with {_BEST} select s_suppkey id, 0 src from supplier union all select o_orderkey, 1 from orders where o_orderkey not in (select query from b)")
def augmented_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orfs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    assigned = centroids.assign(orfs, _hits(spark, sf_dir), "id")
    return centroids.augment(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), orfs, assigned)


@query("""
select c_nationkey, c_mktsegment, min(c_custkey) as "first", count(*) n, min_by(c_name, c_custkey) || case when count(*) > 1 then '+' || (count(*) - 1)::varchar else '' end as label from customer group by all""")
def exact_dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.identical(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey", "c_name")


@query("""select doc_id, generate_subscripts(ls, 1) - 1 item_no, unnest(ls) item from (select doc_id, string_split(text, chr(10)) ls from documents)""")
def scatter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return records.items(x, "doc_id").withColumn("item_no", F.col("item_no").cast("bigint"))


@query("""select n_regionkey, array_to_string(list(n_name order by n_nationkey), ',') items, count(*) n from nation group by n_regionkey""")
def gather_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = reads.gather(table(spark, sf_dir, "nation"), "n_name", "n_nationkey", "n_regionkey")
    return x.select("n_regionkey", F.array_join("items", ",").alias("items"), F.size("items").cast("bigint").alias("n"))


@query("""select c_custkey, c_nationkey, ((row_number() over (partition by c_nationkey order by c_custkey) - 1) // 10)::bigint batch from customer""")
def batch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.batches(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", 10, "c_nationkey")


@query("""select user_id id, max_by(props, event_id) json, max(event_id) version from events group by user_id""")
def kv_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("props").alias("json"), F.col("event_id").alias("version"))
    return kv.latest(e, "id", "version")


# ---- pangenome --------------------------------------------------------------------------------------------------

_MATRIX = """m as (select l_partkey family, c_nationkey genome, count(*) n from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey group by all)"""
_CLASSES = f"{_MATRIX}, p as (select family, count(*) n_genomes, case when count(*) >= 20 then 'persistent' when count(*) >= 15 then 'shell' else 'cloud' end as class from m group by family)"
_ORDER = f"""{_CLASSES}, o as (select family, class, n_genomes, row_number() over (order by case class when 'persistent' then 0 when 'shell' then 1 else 2 end, n_genomes, family) - 1 ord from p)"""
_CELLS = f"""{_ORDER}, c as (select ord r, g c, least(coalesce(n, 0), 2) v from o cross join (select unnest(range(25)) g) left join m on m.family = o.family and m.genome = g)"""


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    x = li.select("l_orderkey", F.col("l_partkey").alias("family")).join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(c.select("c_custkey", F.col("c_nationkey").alias("genome")), F.col("o_custkey") == F.col("c_custkey"))
    return x.groupBy("family", "genome").agg(F.count("*").alias("n"))


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = pangenome.presence(_matrix(spark, sf_dir), 20, 15)
    return pangenome.row_order(x, group="n_genomes", idx="family")


@query(f"with {_MATRIX} select * from m")
def pangenome_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir)


@query(f"with {_CLASSES} select * from p")
def presence_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pangenome.presence(_matrix(spark, sf_dir), 20, 15)


@query(f"with {_ORDER} select family, class, n_genomes, ord from o")
def pangenome_row_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark, sf_dir).select("family", "class", "n_genomes", long("ord"))


def _blocks(spark: SparkSession, sf_dir: str, compat: bool) -> DataFrame:
    matrix = workspace.table(_matrix(spark, sf_dir), "matrix")  # read three times
    o = pangenome.row_order(pangenome.presence(matrix, 20, 15), group="n_genomes", idx="family").select("family", F.col("ord").cast("bigint").alias("r"))
    grid = o.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(24))))
    m = matrix.select("family", F.col("genome").alias("c"), "n")
    cells = grid.join(m, ["family", "c"], "left").select("r", "c", pangenome.clip(F.coalesce("n", F.lit(0))).cast("double").alias("v"))
    return pangenome.block_mean(cells, o.count(), 25, 10, compat).withColumn("value", F.round("value", 6))


@query(f"with {_CELLS}, t as (select 10 * (count(*) // 10) n from o) select (r // 10)::bigint out_row, c::bigint out_col, round(avg(v), 6) \"value\" from c, t where r < n group by all")
def pangenome_block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir, False)


@query(f"with {_CELLS}, t as (select 10 * (count(*) // 10) n from o), b as (select (r * 25 + c) // 10 k, v from c, t where r < n) select (k // 25)::bigint out_row, (k % 25)::bigint out_col, round(avg(v), 6) \"value\" from b group by all")
def pangenome_block_mean_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir, True)


@query(f"""with {_MATRIX}, s as (select genome, count(*) n from m group by genome), i as (select a.genome g1, b.genome g2, count(*) as "inter" from m a join m b on a.family = b.family and a.genome < b.genome group by all)
select g1, g2, "inter", round(1 - "inter" / (x.n + y.n - "inter"), 6) distance from i join s x on x.genome = g1 join s y on y.genome = g2""")
def genome_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pangenome.jaccard(_matrix(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


_SEGMENTS = """
i as (select user_id, event_type, row_number() over w - 1 i, (event_type is distinct from lag(event_type) over w)::int ch from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(ch) over (partition by user_id order by i rows unbounded preceding) run from i),
g as (select user_id, event_type, min(i) l, max(i) + 1 r from s group by user_id, event_type, run)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pangenome.label_runs(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "user_id")


@query(f"with {_SEGMENTS} select * from g")
def run_length_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


@query(f"with {_SEGMENTS}, c as (select event_type, count(*) segments from g group by event_type) select *, row_number() over (order by segments, event_type) draw_order from c")
def segment_color_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pangenome.color_order(_runs(spark, sf_dir), "event_type")


@query(f"""with {_SEGMENTS}, n as (select user_id, count(*) n from events group by user_id) select user_id, l, r, round(l / n + 0.5 / n, 6) as "start", round(r / n + 0.5 / n, 6) as "end" from g join n using (user_id)""")
def bar_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = e.groupBy("user_id").agg(F.count("*").alias("n"))
    x = pangenome.bar_positions(_runs(spark, sf_dir).join(n, "user_id"), F.col("n"))
    return x.select("user_id", "l", "r", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


# ---- figures ----------------------------------------------------------------------------------------------------


@query("""
select s_suppkey, round(2 * cos(0.5) * (s_suppkey % 7) - 2 * sin(0.5) * s_nationkey + 2 * 0.25, 6) x, round(3 * sin(0.5) * (s_suppkey % 7) + 3 * cos(0.5) * s_nationkey + 3 * -1.5, 6) y from supplier""")
def affine_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geometry.Affine.of(dx=0.25, dy=-1.5, rotation=0.5, sx=2, sy=3).apply(F.col("s_suppkey") % 7, F.col("s_nationkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("""select s_suppkey, round(cos(pi() / 2 - s_acctbal / 1000) * s_nationkey, 6) + 0.0 x, round(sin(pi() / 2 - s_acctbal / 1000) * s_nationkey, 6) + 0.0 y, round(atan2(s_acctbal, s_nationkey + 1), 6) angle,
round(case when s_acctbal < 0 then s_acctbal + 2 * pi() * ceil(-s_acctbal / (2 * pi())) else s_acctbal end, 6) turned from supplier""")
def polar_to_cart(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geometry.to_cart(F.col("s_acctbal") / 1000, F.col("s_nationkey"))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", (F.round(x, 6) + 0.0).alias("x"), (F.round(y, 6) + 0.0).alias("y"), F.round(geometry.to_rad(F.col("s_nationkey") + 1, F.col("s_acctbal")), 6).alias("angle"),
        F.round(geometry.rectify_angle(F.col("s_acctbal")), 6).alias("turned"),
    )


@query("""select c_custkey, round(sign(c_acctbal) * log10(abs(c_acctbal) + 1), 6) v from customer""")
def signed_log10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(scalars.signed_log10(F.col("c_acctbal")), 6).alias("v"))


@query("""
with h as (select p_partkey, lpad(to_hex((p_partkey * 7919) % 16777216), 6, '0') x from part)
select p_partkey, '#' || lower(x) color, ('0x' || substr(x, 1, 2))::int r, ('0x' || substr(x, 3, 2))::int g, ('0x' || substr(x, 5, 2))::int b from h""")
def hex_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("#"), F.lpad(F.lower(F.hex((F.col("p_partkey") * 7919) % 16777216)), 6, "0")).alias("color"))
    return x.select("p_partkey", "color", *(colors.hex_channel(F.col("color"), i).alias(c) for i, c in enumerate("rgb")))


@query("""select p_partkey, round((p_size - min(p_size) over ()) / (max(p_size) over () - min(p_size) over ()), 6) v from part""")
def min_max_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("v"))
    return pangenome.normalised(x, "v").withColumn("v", F.round("v", 6))


# ---- k-mers -----------------------------------------------------------------------------------------------------

_KM = "list_transform(range(1, greatest(length(seq) - {k} + 2, 1)), lambda i: substr(seq, i, {k}))"


@query(f"""
with b as (select distinct unnest({_KM.format(k=23)}) km from (select {_DNA} seq from benchmark)),
d as (select distinct doc_id, unnest({_KM.format(k=23)}) km from (select doc_id, {_DNA} seq from documents))
select doc_id, count(*) hits from d join b using (km) group by doc_id""")
def kmer_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.contaminated(sequences(spark, sf_dir), sequences(spark, sf_dir, "benchmark"), "doc_id", "seq", 23)


@query(f"""
with k as (select distinct item_id id, unnest({_KM.format(k=12)}) km from (select item_id, {_DNA} seq from benchmark)), n as (select id, count(*) n from k group by id),
p as (select x.id a, y.id b, count(*) shared from k x join k y using (km) group by all),
j as (select a, b, shared, shared / (na.n + nb.n - shared) jaccard from p join n na on na.id = a join n nb on nb.id = b)
select a, b, shared, round(jaccard, 6) jaccard, round(1 + ln(2 * jaccard / (1 + jaccard)) / 12, 6) identity from j""")
def pairwise_ani_mash(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sketches.mash(sequences(spark, sf_dir, "benchmark"), "item_id", "seq", 12)
    return x.withColumn("jaccard", F.round("jaccard", 6)).withColumn("identity", F.round("identity", 6))


@query(f"""
with r as (select distinct item_id % 7 taxon, unnest({_KM.format(k=10)}) km from (select item_id, {_DNA} seq from benchmark)),
d as (select distinct doc_id, unnest({_KM.format(k=10)}) km from (select doc_id, {_DNA} seq from documents)),
v as (select doc_id, taxon, count(*) votes from d join r using (km) group by all)
select doc_id, taxon, votes from v qualify row_number() over (partition by doc_id order by votes desc, taxon) = 1""")
def taxon_kmer_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = sequences(spark, sf_dir, "benchmark").withColumn("taxon", F.col("item_id") % 7)
    return sketches.taxon_votes(sequences(spark, sf_dir), ref, "doc_id", "seq", "taxon", 10)


@query("""
with q as (select vec_id "query", embedding e from embeddings where vec_id % 20 = 0),
s as (select "query", vec_id, list_sum(list_transform(list_zip(e, embedding), lambda z: z[1]::double * z[2]::double)) s from q join embeddings on vec_id <> "query"),
r as (select "query", vec_id, s, row_number() over (partition by "query" order by s desc, vec_id) as rank from s)
select "query", vec_id, round(s, 5) similarity, rank from r where rank <= 5""")
def embedding_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector is a query, against all vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    x = sketches.top_similar(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)
    return x.select("query", "vec_id", F.round("similarity", 5).alias("similarity"), long("rank"))


#: All of an item's sequence as reads of 60 bases; the last one is shorter.
_PIECES = f"(select item_id, p, substr(seq, 60 * p + 1, 60) s from (select item_id, seq, unnest(range(0, ceil(length(seq) / 60)::bigint)) p from (select item_id, {_DNA} seq from benchmark)))"


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sequences(spark, sf_dir, "benchmark").where(F.length("seq") > 0)
    c = c.select("item_id", "seq", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / 60).cast("int"))).alias("p"))
    return c.select("item_id", F.col("p").cast("bigint").alias("p"), F.col("seq").substr(60 * F.col("p") + 1, F.lit(60)).alias("seq"))


@query(f"""
with r as (select item_id * 1000 + p as "read", length(s) len, s from {_PIECES}), c as (select item_id contig, {_DNA} seq from benchmark),
q as (select "read", len, unnest(range(0, greatest(len - 14, 0))) qp, substr(s, qp + 1, 15) km from r), k as (select contig, unnest(range(0, greatest(length(seq) - 14, 0))) cp, substr(seq, cp + 1, 15) km from c),
v as (select "read", contig, len, cp - qp d, count(*) seeds from q join k using (km) group by all)
select "read", contig, greatest(d, 0)::bigint as "start", (d + len)::bigint as "end", seeds from v qualify row_number() over (partition by "read" order by seeds desc, contig, d) = 1""")
def seed_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the items as reads, the items as contigs."""
    c = sequences(spark, sf_dir, "benchmark").select(F.col("item_id").alias("contig"), "seq")
    return reports.placements(_pieces(spark, sf_dir).select((F.col("item_id") * 1000 + F.col("p")).alias("read"), "seq"), c, 15)


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads cut from the items at every 40th base, 140 bases each, in turn as they are, with a base changed and three left out, complemented with three put in, complemented with both."""
    c = sequences(spark, sf_dir, "benchmark").where(F.length("seq") >= 140)
    c = c.select("item_id", "seq", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 140) / 40).cast("int"))).alias("p"))
    s = F.col("seq").substr(40 * F.col("p") + 1, F.lit(140))
    part = lambda a, b: s.substr(a + 1, b - a)
    changed = F.concat(part(0, 60), F.translate(part(60, 61), "ACGT", "CATG"), part(61, 100), part(103, 140))
    longer = F.concat(part(0, 80), F.translate(part(80, 83), "ACGT", "TGAC"), part(80, 140))
    both = F.concat(part(0, 30), F.translate(part(30, 33), "ACGT", "TGAC"), part(30, 60), F.translate(part(60, 61), "ACGT", "CATG"), part(61, 100), part(103, 140))
    kind = F.col("p") % 4
    read = F.when(kind == 0, s).when(kind == 1, changed).when(kind == 2, S.reverse_complement(longer)).otherwise(S.reverse_complement(both))
    return c.select((F.col("item_id") * 1000 + F.col("p")).alias("read"), read.alias("seq"))


@query(f"""
with c as (select item_id, {_DNA} seq from benchmark),
p as (select item_id, unnest(range(0, (length(seq) - 140) // 40 + 1)) p, seq from c where length(seq) >= 140),
s as (select item_id * 1000 + p as "read", p % 4 kind, substr(seq, 40 * p + 1, 140) s from p),
r as (select "read", kind, s, case kind when 0 then s when 1 then s[1:60] || translate(s[61:61], 'ACGT', 'CATG') || s[62:100] || s[104:140] when 2 then s[1:80] || translate(s[81:83], 'ACGT', 'TGAC') || s[81:140]
  else s[1:30] || translate(s[31:33], 'ACGT', 'TGAC') || s[31:60] || translate(s[61:61], 'ACGT', 'CATG') || s[62:100] || s[104:140] end q from s),
h as (select r.*, c.item_id contig, strpos(c.seq, r.s) - 1 as "start" from r join c on contains(c.seq, r.s))
select "read", contig, case when kind < 2 then '+' else '-' end strand, "start"::bigint as "start", "start" + 140 as "end", levenshtein(q, s)::bigint edits
from h qualify row_number() over (partition by "read" order by contig) = 1""")
def read_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the items with known changes come back to where they are from; the edit distance is that of SQL."""
    contigs = sequences(spark, sf_dir, "benchmark").select(F.col("item_id").alias("contig"), "seq")
    return mapping.align(_planted(spark, sf_dir), contigs, k=11).select("read", "contig", "strand", "start", "end", "edits")


@query(f"""
with x as (select distinct item_id i, unnest({_KM.format(k=9)}) km from (select item_id, {_DNA} seq from benchmark))
select x.i a, y.i b, count(*) shared from x join x y using (km) where x.i < y.i group by all having count(*) >= 2""")
def read_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.overlaps(sequences(spark, sf_dir, "benchmark").select(F.col("item_id").alias("read"), "seq"), 9, 2)


def _tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of 120 bases from every 40th base of the items, while 30 bases are left, every other one reverse-complemented."""
    c = sequences(spark, sf_dir, "benchmark").where(F.length("seq") > 0)
    c = c.select("item_id", "seq", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("seq") - 30, F.lit(0)) / 40).cast("int"))).alias("p"))
    s = F.col("seq").substr(40 * F.col("p") + 1, F.lit(120))
    return c.select((F.col("item_id") * 1000 + F.col("p")).alias("read"), F.when(F.col("p") % 2 == 1, S.reverse_complement(s)).otherwise(s).alias("seq"))


_TILED = f"""c as (select item_id, length({_DNA}) size from benchmark), p as (select item_id, size, unnest(range(0, greatest(size - 30, 0) // 40 + 1)) p from c where size > 0),
r as (select item_id, item_id * 1000 + p as "read", p, p % 2 = 1 rev, 40 * p s, least(40 * p + 120, size) e, size from p)"""


@query(f"""
with {_TILED},
o as (select x.read a, x.rev ar, x.s sa, x.e ea, y.read b, y.rev br, y.s sb, y.e eb, greatest(x.s, y.s) s, least(x.e, y.e) e from r x join r y on x.item_id = y.item_id and x.read < y.read)
select a, (ea - sa)::bigint a_len, (case when ar then ea - e else s - sa end)::bigint a_start, (case when ar then ea - s else e - sa end)::bigint a_end, ar <> br rev,
       b, (eb - sb)::bigint b_len, (case when ar then eb - e else s - sb end)::bigint b_start, (case when ar then eb - s else e - sb end)::bigint b_end
from o where e - s >= 30""")
def minimizer_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of exact reads come out with the places they were cut from."""
    reads_ = _tiled(spark, sf_dir)
    x = assembly.exact(assembly.overlaps(reads_, k=11), reads_).where("a_end - a_start >= 30")
    return x.drop("seeds")


@query(f"""
with {_TILED}, w as (select *, max(p) over (partition by item_id) last, max(e) over (partition by item_id) tail from r where p = 0 or 40 * (p - 1) + 120 < size)
select read, rev, item_id * 1000 head, false head_rev, p::bigint n, (40 * p)::bigint "at" from w
union all select read, not rev, item_id * 1000 + last, last % 2 = 0, last - p, tail - e from w""")
def string_graph_unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads of an item, which overlap their next two neighbours, come back in a row, in both orientations."""
    reads_ = _tiled(spark, sf_dir)
    found = workspace.table(assembly.exact(assembly.overlaps(reads_, k=11), reads_).where("a_end - a_start >= 30"), "overlaps")
    return assembly.unitigs(assembly.string_graph(found), reads_.join(assembly.contained(found), "read", "left_anti"))


_RC = "translate(reverse({}), 'ACGT', 'TGCA')"


@query(f"""
with recursive s as (select {_DNA} seq from benchmark), f as (select distinct unnest(list_transform(range(1, length(seq) - 19), lambda i: substr(seq, i, 21))) km from s where length(seq) >= 21),
v as materialized (select km v from f union select {_RC.format('km')} from f),
e as (select x.v, y.v w from v x join v y on substr(x.v, 2) = substr(y.v, 1, 20)),
g as materialized (select v, w from e where v in (select v from e group by v having count(*) = 1) and w in (select w from e group by w having count(*) = 1)),
r as (select v head, v, 0 n from v where v not in (select w from g) union all select r.head, g.w, n + 1 from r join g on g.v = r.v),
u as (select head, substr(head, 1, 20) || string_agg(substr(v, 21, 1), '' order by n) seq, count(*) kmers from r group by head having min(v) <= min({_RC.format('v')}))
select least(seq, {_RC.format('seq')}) seq, kmers from u""")
def debruijn_unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.debruijn_unitigs(sequences(spark, sf_dir, "benchmark").select("seq"), 21)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of nations (from 100) in regions (from 1) in the world (0)."""
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("bigint").alias("node"), (F.col("n_regionkey") + 1).cast("bigint").alias("parent"))
    regions = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("parent"))
    return nations.union(regions).union(regions.select("parent", F.lit(None).cast("bigint").alias("parent")).distinct())


def _classified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, taxonomy.Tree]:
    """Documents as reads; the items are references of the nations in turn."""
    tree = taxonomy.Tree(_places(spark, sf_dir))
    reference = sequences(spark, sf_dir, "benchmark").select((F.col("item_id") % 25 + 100).alias("taxon"), "seq")
    reads_ = sequences(spark, sf_dir).select(F.col("doc_id").alias("read"), "seq")
    return taxonomy.classify(reads_, taxonomy.kmer_taxa(reference, tree, 15), tree, 15), tree


_CANON = f"list_transform({_KM.format(k='{k}')}, lambda x: least(x, {_RC.format('x')}))"
_TAXA = f"""
recursive t as (select n_nationkey::bigint + 100 node, n_regionkey::bigint + 1 parent from nation union all select r_regionkey::bigint + 1, 0 from region union all select 0, null),
u as (select node, node ancestor, 0 up from t union all select u.node, t.parent, up + 1 from u join t on t.node = u.ancestor where t.parent is not null),
deep as materialized (select node, max(up) depth from u group by node),
b as (select distinct item_id % 25 + 100 taxon, unnest({_CANON.format(k=15)}) km from (select item_id, {_DNA} seq from benchmark)),
bn as (select km, count(*) n from b group by km),
ca as (select km, ancestor from b join u on u.node = b.taxon join bn using (km) group by km, ancestor, n having count(*) = n),
ref as materialized (select km, ancestor taxon from ca join deep on deep.node = ca.ancestor qualify row_number() over (partition by km order by depth desc) = 1),
q as (select doc_id "read", unnest({_CANON.format(k=15)}) km from (select doc_id, {_DNA} seq from documents)),
hit as materialized (select "read", taxon, count(*) n from q join ref using (km) group by all),
sc as (select h."read", h.taxon, sum(g.n)::bigint score from hit h join u on u.node = h.taxon join hit g on g."read" = h."read" and g.taxon = u.ancestor group by all),
top as (select * from sc qualify score = max(score) over (partition by "read")),
tn as (select "read", score, count(*) n from top group by all),
tc as (select "read", tn.score, ancestor from top join u on u.node = top.taxon join tn using ("read") group by "read", tn.score, ancestor, tn.n having count(*) = tn.n),
best as (select "read", score, ancestor taxon from tc join deep on deep.node = tc.ancestor qualify row_number() over (partition by "read" order by depth desc) = 1),
cl as (select "read", taxon, score, kmers from best join (select "read", sum(n)::bigint kmers from hit group by "read") using ("read"))"""


@query(f"with {_TAXA} select * from cl")
def taxon_of_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir)[0]


@query(f"""with {_TAXA}, own as (select taxon, count(*) own from cl group by taxon)
select ancestor taxon, depth, sum(own)::bigint clade, coalesce(max(case when ancestor = taxon then own end), 0) own from own join u on u.node = own.taxon join deep on deep.node = u.ancestor group by ancestor, depth""")
def taxon_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, tree = _classified(spark, sf_dir)
    return taxonomy.report(workspace.table(found, "classified"), tree)


@query(f"""
with k as (select doc_id id, unnest({_CANON.format(k=15)}) km from (select doc_id, {_DNA} seq from documents)),
s as materialized (select distinct id, ('0x' || substr(md5(km), 1, 15))::bigint * 8 h from k where ('0x' || substr(md5(km), 1, 15))::bigint * 8 < 461168601842738791),
n as (select id, count(*) n from s group by id), p as (select x.id a, y.id b, count(*) shared from s x join s y using (h) where x.id < y.id group by all),
c as (select a, b, shared, least(na.n, nb.n) n, shared / least(na.n, nb.n) c from p join n na on na.id = a join n nb on nb.id = b)
select a, b, shared, round(c, 6) containment, round(pow(c, 1 / 15), 6) as identity, round(3 * sqrt(c * (1 - c) / n) * pow(c, 1 / 15 - 1) / 15, 6) as error from c where shared >= n * pow(0.9, 15) - 1e-9""")
def sketch_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as genomes, one in twenty of their 15-mers; the hash is one that SQL has."""
    return sketches.sketch_ani(sketches.frac_sketch(sequences(spark, sf_dir), "doc_id", "seq", 15, 20, numbers=sketches.md5_numbers), 15, digits=6)


@query(f"""
with s as (select doc_id id, {_DNA} seq from documents), k as (select id, length(seq) len, unnest({_KM.format(k=10)}) km from s),
h as (select id, len, ('0x' || substr(md5(km), 1, 15))::bigint h from k), f as (select id, any_value(len) len, h % 8 b, min(h) h from h group by id, h % 8),
c as (select h, min_by(id, (-len, id)) centroid from f group by h), v as (select id, centroid, count(*) v from f join c using (h) group by all),
b as (select id, centroid from v qualify row_number() over (partition by id order by v desc, centroid) = 1)
select id, centroid from b union all select id, id from s where id not in (select id from b)""")
def minhash_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = lambda km: F.conv(F.substring(F.md5(km), 1, 15), 16, 10).cast("bigint")
    return centroids.minhash_clusters(sequences(spark, sf_dir).select("doc_id", "seq"), "doc_id", "seq", hashed=hashed)


# ---- trees ------------------------------------------------------------------------------------------------------

#: Complete linkage as a recursion over the pairs of clusters that are left; nodes are then told apart by their paths from the root.
_TREE = f"""
{_MATRIX}, g as (select genome, lpad(genome::varchar, 3, '0') as label, row_number() over (order by lpad(genome::varchar, 3, '0')) - 1 id, count(*) over () n from (select distinct genome from m)),
sz as (select genome, count(*) n from m group by genome), i as (select a.genome g1, b.genome g2, count(*) as k from m a join m b on a.family = b.family and a.genome < b.genome group by all),
dist as (select least(x.id, y.id) a, greatest(x.id, y.id) b, coalesce(1 - k / (s.n + t.n - k), 1.0e0) d from g x join g y on x.genome < y.genome join sz s on s.genome = x.genome join sz t on t.genome = y.genome left join i on g1 = x.genome and g2 = y.genome),
r as (select 0::bigint step, a, b, d, (select max(n) from g) n from dist
  union all select step + 1, least(p, q), greatest(p, q), max(d), any_value(n) from (
    select step, n, d, case when a in (i, j) then n + step else a end p, case when b in (i, j) then n + step else b end q from (select *, first_value(a) over w i, first_value(b) over w j from r window w as (order by d, a, b)) where not (a = i and b = j))
  group by step, least(p, q), greatest(p, q)),
merges as (select n + step id, arg_min(a, (d, a, b)) l, arg_min(b, (d, a, b)) rr, min(d) y from r group by n, step),
nodes as (select id node_id, l left_id, rr right_id, y, false is_leaf, null::varchar as label from merges union all select id, null::bigint, null::bigint, 0, true, label from g),
paths as (select node_id, null::bigint parent_id, '' path from (select max(node_id) node_id from nodes) union all
  select c.node_id, p.node_id, p.path || case when c.node_id = m.left_id then 'a' else 'z' end from paths p join nodes m on m.node_id = p.node_id join nodes c on c.node_id = m.left_id or c.node_id = m.right_id),
places as (select nodes.*, parent_id, path, row_number() over (order by path) - 1 pre_pos, row_number() over (order by path || 'm') - 1 in_pos, row_number() over (order by path || '~') - 1 post_pos,
  case when is_leaf then count(*) filter (where is_leaf) over (order by path) - 1 end leaf_pos from nodes join paths using (node_id))"""


def _dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = workspace.table(_matrix(spark, sf_dir), "matrix")
    name = lambda c: F.lpad(F.col(c).cast("string"), 3, "0")
    pairs = pangenome.jaccard(m).select(F.lit("all").alias("grp"), name("g1").alias("a"), name("g2").alias("b"), "distance")
    members = m.select(F.lit("all").alias("grp"), name("genome").alias("label")).distinct()
    return clustering.dendrograms(pairs, members, "grp")


@query(f"with recursive {_TREE} select node_id, left_id, right_id, round(y, 6) height from nodes where not is_leaf")
def hierarchical_cluster_genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dendrogram(spark, sf_dir).where("not is_leaf").select("node_id", "left_id", "right_id", F.round("y", 6).alias("height"))


@query(f"""with recursive {_TREE} select p.node_id, p.left_id, p.right_id, p.parent_id,
(select round(sum(l.leaf_pos / pow(2, length(l.path) - length(p.path))), 6) from places l where l.is_leaf and starts_with(l.path, p.path)) x, round(p.y, 6) y, p.is_leaf, p.pre_pos, p.in_pos, p.post_pos, p.leaf_pos, p.label from places p""")
def dendrogram_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dendrogram(spark, sf_dir).drop("grp").withColumn("y", F.round("y", 6)).withColumn("x", F.round("x", 6))


@query(f"with recursive {_TREE} select label, leaf_pos from places where is_leaf")
def leaf_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dendrogram(spark, sf_dir).where("is_leaf").select("label", "leaf_pos")


# ---- types and plans --------------------------------------------------------------------------------------------


@query("""select * from (values
('sequences::short_reads_pe', 'sequences::reads', true), ('sequences::clean_reads', 'sequences::reads', false), ('sequences::forward_short_reads', 'sequences::reads', false),
('sequences::100x_long_reads', 'sequences::clean_long_reads', true), ('sequences::flye_assembly', 'sequences::assembly', true), ('ncbi::accession', 'ncbi::assembly_accession', false)) t(have, want, fits)""")
def type_subsumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("short_reads_pe", "reads"), ("clean_reads", "reads"), ("forward_short_reads", "reads"), ("100x_long_reads", "clean_long_reads"), ("flye_assembly", "assembly")]
    names = [(f"sequences::{a}", f"sequences::{b}") for a, b in pairs] + [("ncbi::accession", "ncbi::assembly_accession")]
    r = standard()
    return spark.createDataFrame([(a, b, r.satisfies(a, b)) for a, b in names], "have string, want string, fits boolean")


@query("""select * from (values ('Data', 'nucleic acid sequence'), ('Format', 'FASTQ'), ('_', 'DNA reads'), ('compression', 'gzip'), ('coverage', '100x'), ('ext', 'fq.gz'), ('parity', 'single'), ('qc', 'filtered'), ('read_length', 'long')) t("key", "value")""")
def type_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = standard().flat("sequences::100x_long_reads")
    return spark.createDataFrame([(k, v) for k, vs in sorted(flat.items()) for v in sorted(vs)], "key string, value string")


@query("""select * from (values (0, 'seqkit_reads'), (1, 'miniasm'), (2, 'filtlong_targeted'), (3, 'hifiasm'), (4, 'assembly_stats')) t(step, "transform")""")
def workflow_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long reads of one isolate, to an assembly and its statistics."""
    items = [Item("meta", "sequences::read_metadata"), Item("reads", "sequences::long_reads", frozenset({"meta"}))]
    plan = Planner(standard(), catalogue.standard()).plan(items, [("sequences::isolate_assembly", ["reads"]), ("sequences::assembly_stats", ["sequences::isolate_assembly"])])
    return plan.frame(spark).select("step", "transform")


@query(f"""with recursive {_TREE}, pc as (select family, count(*) n_genomes from m group by family),
oc as (select family, row_number() over (order by case when n_genomes >= 20 then 0 when n_genomes >= 15 then 1 else 2 end, n_genomes, family) - 1 ord from pc),
c as (select ord r, leaf_pos c, least(coalesce(m.n, 0), 2) v from oc cross join (select label::int genome, leaf_pos from places where is_leaf) l left join m on m.family = oc.family and m.genome = l.genome)
select r, c, v, case v when 0 then '#ffffff' when 1 then '#212121' else '#ff0000' end fill from c""")
def pangenome_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plot-ready cells: families by class, genomes by leaf order."""
    leaves = leaf_order(spark, sf_dir).select(F.col("label").cast("int").alias("genome"), "leaf_pos")
    return reports.heatmap_cells(_matrix(spark, sf_dir), _ordered(spark, sf_dir), leaves)
