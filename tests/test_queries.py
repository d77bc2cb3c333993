"""Every query of the core library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from strandlake import queries, queries_files  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    norm = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) and not math.isnan(v) else repr(v)
    return sorted(tuple(norm(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    want = db.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_entry_lists_all():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_tree_of_genomes(spark):
    t = queries.QUERIES["dendrogram_nodes"](spark, SF).toPandas()
    n = int(t.is_leaf.sum())
    assert len(t) == 2 * n - 1
    for c in ("pre_pos", "in_pos", "post_pos"):
        assert sorted(t[c]) == list(range(len(t)))
    y = t.set_index("node_id").y
    inner = t[~t.is_leaf]
    assert all(y[r.node_id] >= max(y[r.left_id], y[r.right_id]) - 1e-9 for r in inner.itertuples())


def test_minhash_clusters_cover_all(spark):
    t = queries.QUERIES["minhash_clusters"](spark, SF).toPandas()
    assert t.id.is_unique and set(t.centroid) <= set(t.id)
