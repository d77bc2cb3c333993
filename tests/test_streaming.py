"""Centroids as state of a stream, against the batch, also after a restart."""

import random

from strandlake.streaming import centroids


def test_state_survives_a_restart(spark, tmp_path):
    rng = random.Random(1)
    base = ["".join(rng.choice("ACGT") for _ in range(120)) for _ in range(12)]
    rows = []
    for i in range(160):
        s = rng.choice(base)
        at = rng.randrange(120)
        rows.append((i * 7 % 160, s if rng.random() < 0.5 else s[:at] + rng.choice("ACGT") + s[at + 1 :], i // 40))
    rows += [(500 + i, s, i % 4) for i, s in enumerate(["", None, "ACG", "acg", "ACG"])]
    df = spark.createDataFrame(rows, "orf_id bigint, seq string, at int")
    want = {tuple(r) for r in centroids.assign_batch(df, "at", k=11, least=0.6).collect()}
    assert len(want) == len(rows) and 12 <= sum(r[2] == "new_centroid" for r in want) < 100

    def run(batch):
        df.where(f"at = {batch}").drop("at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("orf_id bigint, seq string").parquet(f"{tmp_path}/in")
        centroids.assign_stream(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", k=11, least=0.6).awaitTermination()

    for batch in range(4):  # every call is a new query that goes on from the checkpoint
        run(batch)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_state_of_equal_sets_does_not_grow_with_their_length(spark):
    """Where only equal sets match, two numbers stand for a set of any size; same k-mers in another order are the same set."""
    rng = random.Random(3)
    base = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (40, 400, 4000)]
    unit = base[0] * 3
    rows = [(i, s) for i, s in enumerate([*base, *base, unit, unit + base[0], base[2][:-1], "", None, "ACG", "acg"])]
    df = spark.createDataFrame(rows, "orf_id bigint, seq string")
    assert max(len(r["h"]) for r in centroids._filed(df, 11, 1.0).collect()) == 2
    sets = {i: frozenset(min(s[j : j + 11], s[j : j + 11][::-1].translate(str.maketrans("ACGT", "TGCA"))) for j in range(len(s) - 10)) or (s or "").upper() for i, s in ((i, s or "") for i, s in rows)}
    got = {r["orf_id"]: r["centroid_id"] for r in centroids.assign_batch(df.selectExpr("*", "0 at"), "at", k=11, least=1.0).collect()}
    assert got == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets} and got[5] == 2 and got[7] == 6
