"""FASTQ ranges and the index of intervals."""

import gzip
import random
import struct
import zlib

from strandlake.operators import intervals
from strandlake.sources import fastq


def bgzf(data, rng):
    out, at = [], 0
    while at < len(data):
        part = data[at : at + rng.randrange(1, 400)]
        at += len(part)
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        size = 12 + 6 + len(body) + 8
        out.append(struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, size - 1) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out) + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def test_fastq_ranges(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        n = rng.randrange(0, 90)
        rows.append((f"r{i} @+", "".join(rng.choice("ACGT") for _ in range(n)), "".join(rng.choice("@+!I\x7e") for _ in range(n))))
    text = "".join(f"@{h}\n{s}\n+{h if i % 3 else ''}\n{q}\n" for i, (h, s, q) in enumerate(rows)).encode()
    (tmp_path / "a.fq").write_bytes(text)
    (tmp_path / "b.fq").write_bytes(text.replace(b"\n", b"\r\n")[:-2])
    (tmp_path / "c.fq.gz").write_bytes(bgzf(text, rng))
    (tmp_path / "d.fq.gz").write_bytes(gzip.compress(text[:5000] + b"") + gzip.compress(text[5000:]))
    (tmp_path / "e.fq").write_bytes(b"")
    for name in "a.fq b.fq c.fq.gz d.fq.gz e.fq".split():
        path = str(tmp_path / name)
        for size in (1, 7, 100, 999, 1 << 20):
            if size < 100 and name != "a.fq":
                continue
            parts = fastq._Reader([path], size).partitions()
            got = [tuple(x.decode() for x in r[1:]) for p in parts if p.kind != "none" for r in fastq.records(p)]
            assert got == (rows if name != "e.fq" else []), (name, size)
    df = fastq.read(spark, [str(tmp_path / n) for n in ("a.fq", "c.fq.gz")], 2000)
    assert df.rdd.getNumPartitions() > 10
    assert sorted((r["header"], r["seq"], r["quality"]) for r in df.collect()) == sorted(rows * 2)


def test_intervals(spark, tmp_path):
    rng = random.Random(2)
    place = lambda: rng.choice([rng.randrange(1 << 12), rng.randrange(1 << 20), rng.randrange(1 << 30), (1 << rng.randrange(10, 33)) - rng.randrange(3)])
    rows = [(i, rng.choice("xyz"), s := place(), s + rng.choice([0, 1, 50, 20_000, 1 << 22, 1 << 31])) for i in range(3000)]
    rows += [(9000, None, 1, 2), (9001, "x", None, 5), (9002, "x", 5, None)]
    intervals.write(spark.createDataFrame(rows, "id int, contig string, start bigint, end bigint"), f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    good = [r for r in rows if None not in r]
    regions = [(i, rng.choice("xyz"), s := place(), s + rng.choice([0, 1, 300, 100_000, 1 << 27])) for i in range(60)]
    want = {(r[0], x[0]) for r in regions for x in good if r[1] == x[1] and x[2] < r[3] and x[3] > r[2] and r[3] > r[2]}
    df = spark.createDataFrame(regions, "r int, contig string, r_start bigint, r_end bigint")
    assert {(r["r"], r["id"]) for r in intervals.overlapping(index, df).collect()} == want and len(want) > 100
    for r, c, a, b in regions[:12]:
        one = intervals.within(index, c, a, b)
        assert {x["id"] for x in one.collect()} == {i for q, i in want if q == r} | ({x[0] for x in good if x[1] == c and x[2] < b and x[3] > a} if b > a else set())
    plan = intervals.within(index, "x", 100, 5000)
    assert "PartitionFilters: [slice" in plan._jdf.queryExecution().toString()
    files = lambda d: len({f for f in d.select("_metadata.file_path").distinct().toPandas()["file_path"]})
    assert files(index.where(index.slice.isin([-1, 3]))) < files(index) / 3


def test_small_ranges_share_tasks(spark, tmp_path):
    """Ranges stay as small as asked for; the tasks follow the bytes and the cores."""
    text = "".join(f"@@{i}\n{'ACGT' * 30}\n+\n{'@' * 120}\n" for i in range(3000)).encode()
    for name in "ab":
        (tmp_path / f"{name}.fq").write_bytes(text)
    paths = [str(tmp_path / f"{n}.fq") for n in "ab"]
    ranges, tasks = fastq._Reader(paths, 500).partitions(), fastq._Reader(paths, 500, 32).partitions()
    assert len(ranges) > 2900 and [(r.path, r.begin, r.end) for t in tasks for r in t.ranges] == [(r.path, r.begin, r.end) for r in ranges] and 32 <= len(tasks) <= 34
    df = fastq.read(spark, paths, 500)
    assert df.rdd.getNumPartitions() < 8 * spark.sparkContext.defaultParallelism
    assert sorted((r["source"][-4:], r["header"]) for r in df.select("source", "header").collect()) == sorted((f"{n}.fq", f"@{i}") for n in "ab" for i in range(3000))
    assert [len(p.ranges) for p in fastq._Reader([], 500, 32).partitions()] == [0]
