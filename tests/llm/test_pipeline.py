"""Every stage of the pipeline on its own input, against brute force; and the registered queries."""

import itertools
import re

import __spark_entry__
import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from strandlake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    ws = WORD.findall((text or "").lower())
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} - {()}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, input, output) of each stage, as lists of rows."""
    at = tmp_path_factory.mktemp("stages")
    df = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120")
    extra = spark.createDataFrame([(5000, None, None, None, None), (5001, "12 !!", None, "src1", 5), (5002, "", "en", None, 0)], df.schema)
    df = df.unionByName(extra)
    out = []
    for k, (name, f) in enumerate(cp.STAGES):
        f(spark, df, SF).write.parquet(str(at / str(k)))
        new = spark.read.parquet(str(at / str(k)))
        out.append((name, df.columns, df.collect(), new.columns, new.collect()))
        df = new
    return {x[0]: x[1:] for x in out}


def test_columns_and_order(stages):
    assert list(stages) == ["language", "near_dedup", "decontaminate", "mix", "shard"]
    for name, (a, _, b, _) in stages.items():
        assert b == (a + ["shard", "slot"] if name == "shard" else a)


def test_language_keeps_clean_documents(stages):
    _, before, _, after = stages["language"]
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert {5000, 5001, 5002} <= gone and len(gone) <= 5


def test_one_of_each_group_stays(stages):
    _, before, _, after = stages["near_dedup"]
    sets = {r["doc_id"]: grams(r["text"]) for r in before}
    root = {d: d for d in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if v == old else v for k, v in root.items()}
    assert {r["doc_id"] for r in after} == set(root.values())


def test_benchmark_passages_go(spark, stages):
    _, before, _, after = stages["decontaminate"]
    items = [grams(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r["doc_id"] for r in before if any(q and len(q & grams(r["text"])) >= 0.8 * len(q) for q in items)}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - bad


def test_mix_repeats_whole_documents(stages):
    _, before, _, after = stages["mix"]
    known, count = {r["doc_id"]: r for r in before}, {}
    for r in after:
        assert r == known[r["doc_id"]]
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in before}
    assert max(count.values()) <= 2
    assert sum(size[d] * n for d, n in count.items()) == pytest.approx(1.5 * sum(size.values()), rel=0.02)


def test_shards_hold_all_rows(stages):
    _, before, _, after = stages["shard"]
    key = lambda r: (r["doc_id"], r["text"])
    assert sorted(map(key, before)) == sorted(map(key, after))
    n = [sum(r["shard"] == s for r in after) for s in range(24)]
    assert max(n) - min(n) <= 1
    assert all(sorted(r["slot"] for r in after if r["shard"] == s) == list(range(n[s])) for s in range(24))


def test_registered(spark):
    names = set(__spark_entry__.queries())
    assert {"pipeline", *QUERIES} <= names and set(ORACLES) <= names
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    got = sorted(repr(tuple(r[c] for c in order)) for r in df.select(*order).collect())
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_digest_columns(spark):
    x = QUERIES["op10_shard"](spark, SF)
    assert dict(x.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.octet_length("text").alias("b"))
    assert x.join(docs, "doc_id").where("size <> b + 8").count() == 0
    y = QUERIES["op1_mix_sources"](spark, SF)
    assert {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}.items() <= dict(y.dtypes).items()
