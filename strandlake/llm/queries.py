"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import alignment, decontamination, html, language, lines, lm, minhash, mixing, phrases, quality, sharding, vectors, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


def op2_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")).withColumnRenamed("id", "vec_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("doc").alias("doc_id"), "line_no", "n_links", "class_doc", "class_line", "kept")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    net = language.fit(docs, folds=3, held=1)
    out = language.predict(docs.select("doc_id", "text"), net)
    return out.select("doc_id", (language.remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op8_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    pairs = decontamination.contained(docs.select("doc_id", "text"), items.select("item_id", "text"))
    return pairs.select("doc_id", "item_id", F.col("n_item").cast("bigint").alias("n_item"), F.col("n_shared").cast("bigint").alias("n_shared"), F.round("containment", 6).alias("containment"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    light = _read(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    # an order that SQL can tell: 60 bits of an md5 of the whole row
    row = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit("")), F.col("size").cast("string"), F.col("text_crc32").cast("string"))
    order = F.shiftleft(F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("bigint"), 3)
    return sharding.shard(light, 24, order=order).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.measure(_read(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"), label="quality", folds=5, held=0)
    return quality.score(docs, model, least=0.3).select("doc_id", (language.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_extract_html": op2_extract_html,
    "op3_embedding_neardup": op3_embedding_neardup,
    "op4_line_dedup": op4_line_dedup,
    "op5_warc": op5_warc,
    "op6_language_id": op6_language_id,
    "op7_lm_score": op7_lm_score,
    "op8_minhash_neardup": op8_minhash_neardup,
    "op9_decontaminate": op9_decontaminate,
    "op10_shard": op10_shard,
    "op11_align_tokenizers": op11_align_tokenizers,
    "op12_quality": op12_quality,
    "op13_phrases": op13_phrases,
}

_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_GRAMS = "case when len(ws) = 0 then []::varchar[] when len(ws) <= 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) end"

_ASCII_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: From links l(a, b) in both directions, the smallest id reachable from each a.
_REACH = "r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a), c as (select a, min(least(a, b)) m from r group by a)"



def _crc_table() -> list[int]:
    """The table of CRC-32 with the reflected polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)), lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295::bigint)"

ORACLES: dict[str, str] = {
    "op10_shard": f"""
        with t as (select [{", ".join(map(str, _crc_table()))}]::bigint[] tab), d as (select doc_id, source, strlen(coalesce(text, '')) + 8 size, hex(encode(coalesce(text, ''))) h from documents),
             c as (select doc_id, source, size, {_CRC} text_crc32 from d, t),
             o as (select *, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || coalesce(source, '') || '|' || size || '|' || text_crc32), 1, 15))::bigint k from c),
             r as (select *, row_number() over (partition by source order by k) - 1 r, count(*) over (partition by source) n from o),
             p as (select *, row_number() over (order by (2 * r + 1) / (2 * n)::double, source is null, source, r) - 1 pos, count(*) over () total from r)
        select doc_id, size::bigint size, text_crc32, 'rows' law, (pos * 24 // total)::int shard, pos - ((pos * 24 // total) * total + 23) // 24 slot, null::int grown_shard from p""",
    "op13_phrases": r"""
        with p as (select doc_id, coalesce(lang, 'und') lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') ps from documents),
             w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') ws from (select lang, unnest(ps) piece from p)),
             g as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i+k-1])) ws from w, (values (1), (2), (3)) t(k) where len(ws) >= k),
             f as materialized (select lang, k, ws, count(*) f from g group by all having k = 1 or count(*) >= 10),
             n as (select lang, sum(f)::bigint n from f where k = 1 group by lang),
             c as (select * from f where k > 1),
             d as (select lang, k, ws, f, unnest(range(1, k)) k1 from c),
             cut as (select d.lang, d.ws, d.f a, x.f l, y.f r, k1, (1000000::hugeint * d.f * d.f // (x.f::hugeint * y.f))::bigint score
                     from d join f x on x.lang = d.lang and x.ws = d.ws[1:k1] join f y on y.lang = d.lang and y.ws = d.ws[k1+1:d.k]),
             best as (select * from cut qualify row_number() over (partition by lang, ws order by score, k1) = 1),
             h as (select lang, ws[1:2] ws, f from c where k = 3 union all select lang, ws[2:3], f from c where k = 3),
             m as (select lang, ws, max(f) f from h group by all),
             o as (select b.lang, array_to_string(b.ws, ' ') phrase, b.a, b.l, b.r, b.score from best b left join m using (lang, ws) where m.f is null or 100 * m.f < 50 * b.a),
             t as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from o)
        select lang, rank, phrase, a, l, r, n, score from t join n using (lang) where rank <= 2000""",
    "op3_embedding_neardup": f"""
        with recursive v as (select vec_id, label, embedding::double[] e from embeddings
                             where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
             l as (select x.vec_id a, y.vec_id b from v x join v y on x.label = y.label and len(x.e) = len(y.e) and x.vec_id <> y.vec_id where list_cosine_similarity(x.e, y.e) >= 0.93),
             {_REACH}, n as (select a, count(*) n from l group by a)
        select vec_id, coalesce(n.n, 0) n_links, coalesce(least(vec_id, m), vec_id) component_id, coalesce(least(vec_id, m), vec_id) = vec_id kept
        from embeddings left join n on n.a = vec_id left join c on c.a = vec_id""",
    "op5_warc": """
        with p as (select page_id, coalesce(html, '') h from pages),
             d as (select page_id, strlen(h) payload_bytes, sha1(h) x from p),
             f as (select *, min(page_id) over (partition by payload_bytes, x) as first_id from d),
             q as (select *, list_transform(range(0, 8), lambda i: ('0x' || substr(x, (5 * i + 1)::int, 5))::bigint) v from f)
        select page_id, payload_bytes::bigint payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v[1 + i // 4] >> (5 * (3 - i % 4)))::int & 31), 1)), '') payload_digest,
               case when page_id = first_id then 'response' else 'revisit' end record_type,
               case when page_id <> first_id then first_id end refers_to
        from q""",
    "op8_minhash_neardup": f"""
        with recursive g as (select doc_id, {_GRAMS} sh from (select doc_id, {_ASCII_WORDS} ws from documents)),
             d as (select distinct doc_id, unnest(sh) s from g),
             n as (select doc_id, count(*) n from d group by doc_id),
             i as (select x.doc_id a, y.doc_id b, count(*) i from d x join d y on x.s = y.s and x.doc_id <> y.doc_id group by all),
             l as (select a, b from i join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 85 * (na.n + nb.n - i)),
             {_REACH}
        select doc_id, coalesce(n.n, 0) n_shingles, coalesce(least(doc_id, m), doc_id) component_id, coalesce(least(doc_id, m), doc_id) = doc_id kept
        from documents left join n using (doc_id) left join c on c.a = doc_id""",
    "op9_decontaminate": f"""
        with d as (select distinct doc_id, unnest({_GRAMS}) sh from (select doc_id, {_WORDS} ws from documents)),
             b as (select distinct item_id, unnest({_GRAMS}) sh from (select item_id, {_WORDS} ws from benchmark)),
             n as (select item_id, count(*) n_item from b group by item_id),
             s as (select doc_id, item_id, count(*) n_shared from d join b using (sh) group by all)
        select doc_id, item_id, n_item, n_shared, round(n_shared / n_item, 6) containment
        from s join n using (item_id) where n_shared >= 0.8 * n_item - 1e-9""",
}
