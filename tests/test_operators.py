"""Small fixtures for quirks and edge cases of the core operators."""

import gzip
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import colors, geometry, scalars
from strandlake.functions import sequence as S
from strandlake.operators import centroids, clustering, coverage, kv, pangenome, reads, reports, sketches
from strandlake.sources import external, records, sinks, tables


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first().asDict()


def content(spark, text, name="a"):
    return spark.createDataFrame([(name, text)], "source string, content string")


@pytest.mark.parametrize("text,want", [(">a b\nAC\nG", {"a": 3}), (">a\r\nAC\r\n\r\nG\r\n", {"a": 3}), ("", {}), ("junk\n>a\n", {"a": 0}), (">a\nA\n>a\nCC\n", {"a": 2})])
def test_fasta_lengths(spark, text, want):
    got = records.lengths(records.lines(content(spark, text)), "source")
    assert {r["id"]: r["length"] for r in got.collect()} == want


def test_fasta_round_trip(spark):
    text = ">x first\tone\nACG\nT\n>y\nGG"
    recs = records.fasta(content(spark, text))
    assert [(r["id"], r["seq"]) for r in recs.orderBy("rec").collect()] == [("x", "ACGT"), ("y", "GG")]
    assert "\n".join(r["value"] for r in sinks.fasta_text(recs, "rec").collect()) == text


def test_fastq_gfa_genbank(spark, tmp_path):
    fq = tmp_path / "r.fq.gz"
    fq.write_bytes(gzip.compress(b"@1/1 x\nACGT\n+\nIIII\n@1/2\nGG\n+\n##\n"))
    got = records.fastq(records.files(spark, str(fq))).orderBy("rec").collect()
    assert [(r["id"], r["seq"], r["qual"]) for r in got] == [("1/1", "ACGT", "IIII"), ("1/2", "GG", "##")]
    seg = records.gfa_segments(content(spark, "H\tx\nS\tc1\tACG\tLN:i:3\nL\tc1\nS\tc2\tTT\n"))
    assert [r["value"] for r in records.gfa_to_fasta(seg).orderBy("pos").collect()] == [">c1\nACG", ">c2\nTT"]
    gb = records.genbank_definition(content(spark, "LOCUS\nDEFINITION E. coli strain X1\nDEFINITION later\n"))
    assert gb.first()["definition"] == "DEFINITION E. coli strain X1"
    assert records.genbank_definition(content(spark, "x\n" * 20 + "DEFINITION late\n")).first()["definition"] is None
    assert records.any_longer(records.lines(content(spark, ">a\nACGT\n")), 4).first()[0] is True


def test_fasta_files_are_split(spark, tmp_path):
    (tmp_path / "a.fa").write_text("".join(f">r{i} x{i}\nACGT\nAC{'G' * i}\n" for i in range(40)))
    (tmp_path / "b.fa").write_bytes(b">z\tq\r\nAC\r\nGT\r\n>last\nAA")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        df = records.fasta_parts(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 4
        got = {r["id"]: (r["header"], r["seq"]) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"r{i}": (f"r{i} x{i}", "ACGTAC" + "G" * i) for i in range(40)} | {"z": ("z\tq", "ACGT"), "last": ("last", "AA")}


def test_preset_grid(spark):
    q = lambda x: F.lit(float(x))
    assert [one(spark, x=S.adaptive_min_length(F.lit(n)))["x"] for n in (1, 57, 60, 150, 153, 10000)] == [20, 20, 21, 51, 51, 51]
    assert [one(spark, x=S.aligner_preset(F.lit("long"), q(v)))["x"] for v in (0, 19.99, 20, 29.99, 30)] == ["asm20", "asm20", "asm10", "asm10", "asm5"]
    assert one(spark, x=S.aligner_preset(F.lit("short"), q(40)))["x"] == "sr"
    assert one(spark, x=S.assembler_args(q(40)))["x"] == "pacbio-hifi --read-error 0.000501"
    assert one(spark, x=S.assembler_args(q(10)))["x"] == "nano-raw"
    assert one(spark, x=S.corrected_args(q(10)))["x"] == "nano-corr --read-error 0.100000"
    with pytest.raises(Exception, match="unknown parity"):
        one(spark, x=S.interleaved_flag(F.lit("both")))


def test_sequence_functions(spark):
    got = one(spark, r=S.reverse_complement(F.lit("ACGN")), p=S.translate_codons(F.lit("ATGTTTTAAG")), k=S.kmers(F.lit("ACGT"), 3), none=S.kmers(F.lit("AC"), 3))
    assert got == {"r": "NCGT", "p": "MF*", "k": ["ACG", "CGT"], "none": []}
    assert len(S.CODONS) == 64 and S.CODONS["ATG"] == "M" and S.CODONS["TGA"] == "*"


def test_scalars(spark):
    got = one(
        spark, stem=scalars.path_stem(F.lit("/a/b.x.fna")), suffix=scalars.path_suffix(F.lit("/a/b.x.fna")), acc=scalars.accession_of(F.lit("SRR1_2.fq.gz")),
        sort=scalars.sorted_by_keys(F.array(*map(F.lit, "abc")), F.array(F.lit(3), F.lit(1), F.lit(2))),
        upd=scalars.map_update(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("b"), F.lit("2"))),
        pub=scalars.public_keys(F.create_map(F.lit("_raw"), F.lit("1"), F.lit("n"), F.lit("2"))), dflt=scalars.get_or(F.create_map(F.lit("a"), F.lit("1")), "z", "none"),
        j=scalars.unpack_json(scalars.pack_json(F.lit('{"k": [1, null]}'))),
    )
    assert got["stem"] == "b.x" and got["suffix"] == ".fna" and got["acc"] == "SRR1" and got["sort"] == ["b", "c", "a"]
    assert got["upd"] == {"a": "1", "b": "2"} and got["pub"] == {"n": "2"} and got["dflt"] == "none" and json.loads(got["j"]) == {"k": [1, None]}
    assert scalars.memory_params(120) == {"placement_cpus": 2, "search_gb": 114, "cluster_gb": 112}


def test_strain_fallbacks(spark):
    f = lambda s, d=None: one(spark, x=scalars.strain_name(F.lit(s), F.lit(d) if d else None))["x"]
    assert f("DEFINITION E. coli substr. MG1655, complete") == "MG1655"
    assert f("DEFINITION Some \"odd\" name.") == "Some-odd-name"
    assert f("DEFINITION", "file.gbk") == "file.gbk"


def test_depth_does_not_split_touching_runs(spark):
    iv = spark.createDataFrame([("c", 0, 5), ("c", 5, 9), ("c", 7, 8), ("d", 3, 3)], "contig string, start bigint, end bigint")
    got = sorted(tuple(r) for r in coverage.depth_runs(iv).collect())
    assert got == [("c", 0, 7, 1), ("c", 7, 8, 2), ("c", 8, 9, 1)]
    contigs = spark.createDataFrame([("c", 10), ("e", 4)], "contig string, contig_length bigint")
    assert sorted(tuple(r) for r in coverage.depth_runs(iv, tile=3).collect()) == got
    assert sorted(tuple(r) for r in coverage.mean_coverage(coverage.depth_runs(iv), contigs).collect()) == [("c", 1.0, 10), ("e", 0.0, 4)]
    with pytest.raises(Exception, match="unknown contig"):
        coverage.mean_coverage(coverage.depth_runs(iv), contigs.where("contig = 'e'")).collect()
    empty = spark.createDataFrame([], "flag bigint")
    assert coverage.fraction_mapped(coverage.flag_counts(empty)).first()["fraction_mapped"] is None


def test_centroids(spark):
    hits = spark.createDataFrame([("o1", "c1", 2), ("o1", "c2", 1)], "query string, subject string, pos int")
    orfs = spark.createDataFrame([("o1",), ("o2",)], "id string")
    a = centroids.assign(orfs, hits, "id")
    assert sorted(tuple(r) for r in a.collect()) == [("o1", "c2", "matched"), ("o2", "o2", "new_centroid")]
    out = centroids.augment(spark.createDataFrame([("c1",)], "id string"), orfs, a)
    assert sorted((r["src"], r["id"]) for r in out.collect()) == [(0, "c1"), (1, "o2")]
    seqs = spark.createDataFrame([("a", "MKVLAAGGTW"), ("b", "QQQQQQQQQQ")], "id string, seq string")
    found = centroids.search(seqs, spark.createDataFrame([("z", "XMKVLAAGGTWX")], "id string, seq string"), 0.9)
    assert [(r["query"], r["subject"]) for r in found.collect()] == [("a", "z")]


def test_budget_boundaries(spark):
    r = spark.createDataFrame([(i, 10, float(i % 3)) for i in range(10)], "read int, len bigint, q double")
    kept = {x["read"] for x in reads.best_bases(r, "len", "q", "read", share=0.5).collect()}
    assert kept == {2, 5, 8, 1, 4}
    assert reads.best_bases(r, "len", "q", "read", target=0).count() == 0
    assert reads.best_bases(r, "len", "q", "read", target=1000).count() == 10
    ad = spark.createDataFrame([("ACGTACGT",)], "seq string")
    rows = spark.createDataFrame([(1, "GGGACGTAC"), (2, "GGG"), (3, "GGGGACTTACGT"), (4, "TTTTTTTACG"), (None, None)], "id int, s string")
    trim = lambda n: {x["id"]: x["trimmed"] for x in reads.trim_adapters(rows, ad, "id", "s", 6, 3, n).collect()}
    assert trim(0) == {1: "GGG", 2: "GGG", 3: "GGGGACTT", 4: "TTTTTTT", None: None}
    assert trim(1)[1] == "G" and trim(1)[3] == "GGGG"  # GGACGT is one base from GTACGT


def test_block_means(spark):
    m = np.arange(60).reshape(20, 3)
    cells = spark.createDataFrame([(r, c, float(m[r, c])) for r in range(20) for c in range(3)], "r bigint, c bigint, v double")
    grid = lambda compat: {(x["out_row"], x["out_col"]): x["value"] for x in pangenome.block_mean(cells, 20, 3, 10, compat).collect()}
    assert [grid(False)[0, c] for c in range(3)] == [13.5, 14.5, 15.5]
    assert [grid(True)[0, c] for c in range(3)] == [4.5, 14.5, 24.5]
    assert pangenome.block_mean(cells.where("r < 9"), 9, 3).count() == 0


def test_runs_with_nulls(spark):
    x = spark.createDataFrame(list(enumerate(["a", "a", None, "a", "b"])), "i int, v string")
    assert sorted(tuple(r) for r in pangenome.label_runs(x, "v", ["i"]).collect()) == [("a", 0, 2), ("a", 3, 4), ("b", 4, 5)]
    assert pangenome.label_runs(x.limit(0), "v", ["i"]).count() == 0


@pytest.mark.parametrize("method", clustering.METHODS)
def test_linkage(method):
    p = np.array([[0.0], [1], [5], [7]])
    d = np.abs(p - p.T)
    m = clustering.linkage(d, method)
    assert m[0][:2].tolist() == [0, 1] and m[1][:2].tolist() == [2, 3] and len(m) == 3 and m[2][3] == 4
    top = {"single": 4, "complete": 7, "average": 5.5, "weighted": 5.5, "centroid": 5.5, "median": 5.5, "ward": math.sqrt(2 * 2 * 2 / 4) * 5.5}[method]
    assert m[2][2] == pytest.approx(top)
    t = clustering.tree(m, 4)
    assert t[t.is_leaf].sort_values("leaf_pos").node_id.tolist() == [0, 1, 2, 3]
    s = clustering.sorted_by(t, {0: 3, 1: 2, 2: 1, 3: 0}).set_index("node_id")
    assert s.x[3] == 0 and s.x[0] == 1 and s.left_id[6] == 5


def test_linkage_ties_and_small():
    assert clustering.linkage(np.zeros((3, 3)))[:, 2].tolist() == [0, 0]
    assert len(clustering.linkage(np.zeros((1, 1)))) == 0 and len(clustering.tree(clustering.linkage(np.zeros((1, 1))), 1)) == 1
    with pytest.raises(ValueError):
        clustering.linkage(np.zeros((2, 2)), "best")


def test_colors(spark):
    assert len(colors.CSS) == 141 and colors.coerce("Tomato") == "#ff6347"
    with pytest.raises(ValueError):
        colors.coerce("#12345")
    x = F.lit("#80FF0040")
    got = one(spark, a=colors.rgba(x), f=colors.fade(x, 0.5), bad=colors.hex_channel(F.lit("zz"), 0), hsv=colors.hsv(F.lit(0.0), F.lit(255.0), F.lit(0.0)), back=colors.from_hsv(F.lit(1 / 3), F.lit(1.0), F.lit(1.0)), h=colors.hex_of(F.lit(1.0), F.lit(16.0), F.lit(255.0)))
    assert got["a"] == "rgba(128.0000,255.0000,0.0000,0.2510)" and got["f"].endswith(",0.5000)") and got["bad"] is None and got["h"] == "#0110ff"
    assert got["hsv"]["h"] == pytest.approx(1 / 3) and got["back"]["g"] == pytest.approx(255)


def test_geometry(spark):
    a = geometry.Affine.of(dx=1, dy=2, rotation=math.pi / 2, sx=2)
    x, y = a.then(geometry.Affine.of(dx=1)).apply(F.lit(1.0), F.lit(0.0))
    got = one(spark, x=x, y=y, q=geometry.line_quad(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(0.0), 1.0), arc=geometry.arc_points(F.lit(0.0), F.lit(math.pi)), t=geometry.text_angle(F.lit(0.0)), r=geometry.rectify_angle(F.lit(-7.0)))
    assert got["x"] == pytest.approx(3) and got["y"] == pytest.approx(6)
    assert sorted((round(p["x"], 6), round(p["y"], 6)) for p in got["q"]) == [(0, -0.5), (0, 0.5), (2, -0.5), (2, 0.5)]
    assert len(got["arc"]) == 2 * 65 and got["t"] == pytest.approx(270) and 0 <= got["r"] < 2 * math.pi


def test_reports_and_tables(spark, tmp_path):
    assert tables.grep_or(content(spark, "x\n[INFO] guessed quality encoding: Illumina-1.8+ \n"), "guessed quality encoding:", "sanger").first()["value"] == "illumina-1.8+"
    assert tables.grep_or(content(spark, "x\n"), "Encoding", "sanger").first()["value"] == "sanger"
    (tmp_path / "f.tsv").write_text("10\t0\tmapped\n12\t1\ttotal\n")
    df = tables.tsv(spark, str(tmp_path / "f.tsv"), "passed string, failed string, category string")
    assert tables.key_last(df, "passed", "failed", "category").first()["first"] == {"mapped": "10", "total": "12"}
    head = ["Gene", "Non-unique Gene name", *(f"m{i}" for i in range(12)), "g1", "g2"]
    (tmp_path / "m.csv").write_text(",".join(head) + "\nf1,shell," + "," * 11 + ',"""a"" ""b""",\n')
    got = {r["genome"]: r["n"] for r in tables.matrix(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {"g1": 2, "g2": 0}
    assert tables.first_row(df).first()["row"]["passed"] == "10"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    sinks.write_json(df, str(tmp_path / "j"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"k":"a","v":1}', '{"k":"b","v":null}']
    sinks.write_by(df, str(tmp_path / "p"), "k")
    assert sorted(p.name for p in (tmp_path / "p").glob("k=*")) == ["k=a", "k=b"]
    sinks.write_once(df, str(tmp_path / "o"))
    sinks.write_once(df.limit(0), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    sinks.write_many(df, {str(tmp_path / "x"): df.where("v = 1"), str(tmp_path / "y"): df})
    assert spark.read.parquet(str(tmp_path / "x")).count() == 1
    assert sinks.tar_of({})[:2] == b"\x1f\x8b"
    assert "<path" in sinks.svg(spark.createDataFrame([(0, "M 0,0 Z", "#000000")], "z int, path string, fill string"))


def test_store(spark, tmp_path):
    s = kv.Store(spark, str(tmp_path / "kv"))
    put = lambda rows, v: s.put(spark.createDataFrame(rows, "id string, json string"), v)
    put([("a", "1"), ("b", "null")], 1)
    put([("a", '{"x": 2}')], 2)
    got = s.get(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), "0")
    assert {r["id"]: r["json"] for r in got.collect()} == {"a": '{"x": 2}', "b": "0", "c": "0"}


def test_external_is_off(spark):
    with pytest.raises(external.ToolMissing):
        external.run_tool(spark.createDataFrame([("a", "x")], "k string, t string"), ["cat"], key="k", stdin="t")
    got = external.run_tool(spark.createDataFrame([("a", "x")], "k string, t string"), ["cat"], key="k", stdin="t", enabled=True).first()
    assert got["output"] == "x" and got["returncode"] == 0
    with pytest.raises(external.ToolMissing):
        external.download("GCF_1", "assembly")
    assert external.containers(spark, {"a.oci": "docker://x/y:1\n"}).first()["image"] == "x/y:1"


def test_mash_of_equal_sets(spark):
    s = spark.createDataFrame([(1, "ACGTACGGT"), (2, "ACGTACGGT"), (3, "TTTTTTTTT")], "id int, seq string")
    got = {(r["a"], r["b"]): r["identity"] for r in sketches.mash(s, "id", "seq", 4).collect()}
    assert got[1, 2] == pytest.approx(1) and (1, 3) not in got


def test_gate_and_mock(spark):
    result, mock = spark.createDataFrame([("r",)], "v string"), spark.createDataFrame([("none",)], "v string")
    gate = lambda text: records.any_longer(records.lines(content(spark, text)), 4)
    assert [r["v"] for r in reports.or_mock(result, gate(">a\nACGT\n"), "any_long", mock).collect()] == ["r"]
    assert [r["v"] for r in reports.or_mock(result, gate(">a\nAC\n"), "any_long", mock).collect()] == ["none"]
    assert reports.document(mock).first()["value"] == '{"v":"none"}'
    cached = reports.cached_paths(spark.createDataFrame([("A",), ("B",)], "accession string"), spark.createDataFrame([("A", "/x")], "accession string, path string"))
    assert {r["accession"]: r["path"] for r in cached.collect()} == {"A": "/x", "B": None}


def test_ranks_over_ranges(spark):
    from strandlake.operators import ordering

    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("g"), (F.col("id") % 5).alias("w")).repartition(7)
    got = sorted((r["g"], r["k"], r["w"], r["r"], r["b"]) for r in ordering.running(ordering.ranked(rows, [F.col("g"), F.col("k")], "r"), [F.col("g"), F.col("k")], F.col("w"), "b").collect())
    before = 0
    for i, (_, _, w, r, b) in enumerate(got):
        assert (r, b) == (i, before)
        before += w
    assert ordering.ranked(rows.limit(0), [F.col("k")], "r").count() == 0


def test_budget_by_group(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "ab"[int(i % 4 == 0)], int(rng.integers(1, 50)), float(rng.choice([1.0, 2.0, 2.0, 2.0, 100.0]))) for i in range(400)] + [(1000, None, 5, 1.0), (1001, "a", 9, None)]
    df = spark.createDataFrame(rows, "read int, s string, len bigint, q double")
    want = set()
    for s in ("a", "b", None):
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))
        cum, goal = 0, 0.6 * sum(r[2] for r in mine)
        for r in mine:
            if cum < goal:
                want.add(r[0])
            cum += r[2]
    got = reads.best_bases(df, "len", "q", "read", share=0.6, key="s")
    assert got.columns == df.columns and {r["read"] for r in got.collect()} == want


def test_cluster_options():
    z = np.array([[0.0, 0], [0, 1], [5, 5], [5, 6.5], [5, 5.2], [20, 20]])
    plain = clustering.hierarchical_cluster(z, list("abcdef"), "average")
    assert sorted(plain.labels) == list("abcdef") and plain.mat.shape == z.shape and (z[plain.order] == plain.mat).all()
    leaves = lambda t, v: 1 if t.is_leaf[v] else leaves(t, int(t.left_id[v])) + leaves(t, int(t.right_id[v]))
    for how, sign in (("ascending", 1), ("descending", -1)):
        t = clustering.tree(clustering.linkage(clustering.distances(z), "average"), 6, count_sort=how).set_index("node_id")
        assert all(sign * (leaves(t, int(r.left_id)) - leaves(t, int(r.right_id))) <= 0 for _, r in t[~t.is_leaf].iterrows())
        t = clustering.tree(clustering.linkage(clustering.distances(z), "average"), 6, distance_sort=how).set_index("node_id")
        assert all(sign * (t.y[int(r.left_id)] - t.y[int(r.right_id)]) <= 1e-9 for _, r in t[~t.is_leaf].iterrows())
    d = clustering.distances(z)
    assert clustering.hierarchical_cluster(d, method="average", metric="precomputed").order == plain.order
    turned = clustering.hierarchical_cluster(z, method="average", sort_order=[5, 4, 3, 2, 1, 0]).tree.set_index("node_id")
    assert all(turned.x[int(r.left_id)] <= turned.x[int(r.right_id)] for _, r in turned[~turned.is_leaf].iterrows())
    assert clustering.distances(np.array([[1, 0, 2], [1, 1, 0]]), "jaccard")[0, 1] == pytest.approx(2 / 3)
    rows, labels, groups = clustering.deduplicate(np.array([[1, 2], [3, 4], [1, 2]]), ["a", "b", "c"])
    assert labels == ["a+1", "b"] and groups == [["a", "c"], ["b"]] and rows.tolist() == [[1, 2], [3, 4]]
    with pytest.raises(ValueError):
        clustering.tree(clustering.linkage(d), 6, True, True)


def test_bars_as_outlines(spark):
    rows = spark.createDataFrame([(i, "ab"[i // 3 % 2]) for i in range(8)], "i int, v string")
    line = pangenome.categorical_bar(rows, "v", ["i"], circular=False, position=0.0, thickness=0.5).orderBy("l").collect()
    assert [(r["v"], r["l"], r["r"], r["draw_order"]) for r in line] == [("a", 0, 3, 2), ("b", 3, 6, 1), ("a", 6, 8, 2)]
    assert line[0]["path"] == "M -0.437500,-0.250000 L -0.437500,0.250000 L -0.062500,0.250000 L -0.062500,-0.250000 Z"
    ring = pangenome.categorical_bar(rows, "v", ["i"]).orderBy("l").collect()
    assert all(r["path"].startswith("M ") and r["path"].endswith(" Z") and r["path"].count(" L ") > 20 for r in ring)


def test_nearest_vectors_hold_k_candidates_a_query_in_steps_of_any_size(spark, monkeypatch):
    """Steps of a few rows give what all rows at once give; copies tie and go to the smaller key; a step keeps no more than k a query."""
    rng = np.random.default_rng(4)
    base = rng.integers(-3, 4, (150, 6)).astype(float)
    vectors = np.concatenate([base, base[::3], base[::5]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, [None] * 6)], "id int, v array<double>")
    sim = vectors @ vectors.T
    want = {(q, r + 1, int(j)) for q in range(0, len(vectors), 20) for r, j in enumerate([j for j in np.lexsort((np.arange(len(vectors)), -sim[:, q])) if j != q][:4])}
    for cells in (1 << 20, 64):
        monkeypatch.setattr(sketches, "_SIMILAR", cells)
        got = sketches.top_similar(df, df.where("id % 20 = 0 and id < 900"), "id", "v", 4, block=5).collect()
        assert {(r["query"], r["rank"], r["id"]) for r in got} == want and len(got) == len(want)
    held, floor = None, np.full(10, -np.inf)
    for at in range(0, len(vectors), 7):
        held, floor = sketches._nearest(held, floor, np.arange(at, min(at + 7, len(vectors))), vectors[at : at + 7], np.arange(10), vectors[:10], 4)
        assert len(held[0]) <= 40


@pytest.mark.parametrize("k", [12, 31, 33])
def test_adapters_are_met_as_numbers(spark, k, monkeypatch):
    """Exact adapters of any length and with other letters, in reads of either case; up to 31 bases no k-mer is cut as a string."""
    import random

    rng = random.Random(k)
    adapters = ["".join(rng.choice("ACGTACGTN") for _ in range(n)) for n in (34, 50, 20, 5)]
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 30))) + rng.choice(adapters)[rng.randrange(3) :] + "acgt" * rng.randrange(3)) for i in range(80)] + [(90, None), (91, "")]
    ends = {a.upper()[i : i + k] for a in adapters for i in range(len(a) - k + 1)}
    want = {}
    for i, s in rows:
        s = s and s.upper()
        want[i] = s and next((s[:p] for p in range(len(s)) if s[p : p + k] in ends), s)
    if k <= 31:
        monkeypatch.setattr(reads, "kmer_rows", None)
    got = reads.trim_adapters(spark.createDataFrame(rows, "id int, seq string"), spark.createDataFrame([(a,) for a in adapters], "seq string"), "id", "seq", k, k, 0)
    assert {r["id"]: r["trimmed"] and r["trimmed"].upper() for r in got.collect()} == want
