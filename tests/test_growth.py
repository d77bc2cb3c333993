"""Steps whose time and memory must not outgrow their input."""

import random

from pyspark.sql import functions as F


def test_minhash_clusters_look_hashes_up(spark, monkeypatch):
    import hashlib

    from strandlake.operators import centroids

    rng = random.Random(3)
    letters = lambda n, a="ACGT": "".join(rng.choice(a) for _ in range(n))
    some = [letters(60) for _ in range(4)]
    rows = [(i, rng.choice(some)[rng.randrange(9) :] + letters(rng.randrange(20))) for i in range(40)] + [(50, None), (51, ""), (52, "ACGT"), (53, some[0]), (54, letters(40, "ACGTN")), (55, letters(50, "MKLVA")), (56, letters(40, "acgT"))]
    h = lambda km: int(hashlib.md5(km.encode()).hexdigest()[:15], 16)
    files = {}
    for i, s in rows:
        for x in {h(s[j : j + 5]) for j in range(len(s or "") - 4)}:
            files[i, x % 8] = min(x, files.get((i, x % 8), x))
    size, centre = {i: len(s or "") for i, s in rows}, {}
    for (i, _), x in files.items():
        centre[x] = min(centre.get(x, (0, 99)), (-size[i], i))
    want = {i: i for i, _ in rows}
    for i in {i for i, _ in files}:
        votes = [centre[x][1] for (j, _), x in files.items() if j == i]
        want[i] = min(votes, key=lambda c: (-votes.count(c), c))
    hashed = lambda km: F.conv(F.substring(F.md5(km), 1, 15), 16, 10).cast("bigint")
    df = spark.createDataFrame(rows, "doc int, s string")
    assert {r["id"]: r["centroid"] for r in centroids.minhash_clusters(df, "doc", "s", k=5, hashed=hashed).collect()} == want
    with monkeypatch.context() as m:
        m.setattr(centroids, "_KNOWN", 1)  # every k-mer is hashed
        assert {r["id"]: r["centroid"] for r in centroids.minhash_clusters(df, "doc", "s", k=5, hashed=hashed).collect()} == want
    monkeypatch.setattr(centroids, "kmer_rows", None)  # no row for each k-mer
    monkeypatch.setattr(centroids, "_BLOCK", 7)
    assert {r["id"]: r["centroid"] for r in centroids.minhash_clusters(df, "doc", "s", k=5, hashed=hashed).collect()} == want
    assert centroids.minhash_clusters(df.limit(0), "doc", "s", hashed=hashed).count() == 0


def test_genes_read_contigs_once(spark, monkeypatch):
    """The contigs are made once, not for the model and again for the genes, and blocks of any size find the same genes."""
    from strandlake.operators import proteins

    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ACGTACGTACGTACGTacgtN") for _ in range(rng.randrange(900)))) for i in range(30)] + [(40, None), (41, ""), (42, "AT"), (43, "ATGTAA")]
    made = spark.sparkContext.accumulator(0)

    def same(s):
        made.add(1)
        return s

    df = spark.createDataFrame(rows, "contig int, seq string").withColumn("seq", F.udf(same)("seq"))
    got = sorted(map(tuple, proteins.genes(df, least=5, long=10).collect()))
    assert got and made.value == len(rows)
    plain = spark.createDataFrame(rows, "contig int, seq string")
    model = proteins.coding_model(plain, least=5, long=10)
    for size in (1, 700):
        monkeypatch.setattr(proteins, "_BLOCK", size)
        assert sorted(map(tuple, proteins.genes(plain, least=5, long=10).collect())) == got
        assert sorted(map(tuple, proteins.genes(plain, least=5, long=10, model=model).collect())) == got


def test_sorted_files_follow_the_rows(spark, tmp_path, monkeypatch):
    """More rows make more files, not larger ones, even of one place; files whose ranges overlap are found."""
    from strandlake.sources import sinks

    monkeypatch.setattr(sinks, "_ROWS", 100, raising=False)
    rng = random.Random(5)
    rows = [(rng.randrange(5), rng.randrange(50), i) for i in range(800)] + [(2, 25, 800 + i) for i in range(1200)]
    sinks.write_sorted(spark.createDataFrame(rows, "contig int, start int, line int"), str(tmp_path / "a"))
    x = spark.read.parquet(str(tmp_path / "a")).withColumn("file", F.col("_metadata.file_name"))
    got = x.collect()
    assert sorted((r["contig"], r["start"], r["line"]) for r in got) == sorted(rows)
    files = {}
    for r in got:
        files.setdefault(r["file"], []).append((r["contig"], r["start"]))
    assert len(files) > 10 and max(map(len, files.values())) <= 300
    assert all(f == sorted(f) for f in files.values())
    assert sinks.overlapping(x).count() == 0
    some = [("a", 1, 1), ("a", 1, 5), ("b", 1, 5), ("b", 2, 3), ("c", 2, 2), ("c", 2, 9), ("d", 2, 9), ("e", 3, 1), ("e", 5, 1), ("f", 4, 7)]
    lap = sinks.overlapping(spark.createDataFrame(some, "file string, contig int, start int"))
    assert sorted(r["file"] for r in lap.collect()) == ["b", "e"]
    sinks.write_sorted(spark.createDataFrame([], "contig int, start int"), str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 0
