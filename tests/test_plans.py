import random

import pytest
from pyspark.sql import functions as F

from strandlake.plans import catalogue, planner
from strandlake.plans.planner import Item, Planner, Resources, Transform
from strandlake.plans.types import TypeRegistry, parse_types, standard


def test_counts():
    r = standard()
    assert len(r.declared) == 104
    assert len(catalogue.standard()) == 32


@pytest.mark.parametrize("have,want,fits", [("short_reads_pe", "short_reads", True), ("short_reads_pe", "reads", True), ("clean_reads", "reads", False), ("forward_short_reads", "reads", False), ("100x_long_reads", "clean_long_reads", True), ("flye_assembly", "assembly", True), ("isolate_assembly", "assembly", True)])
def test_matching(have, want, fits):
    assert standard().satisfies(f"sequences::{have}", f"sequences::{want}") is fits


def test_compiled_forms():
    r = standard()
    assert r.compiled("ref::genomad") == ["for geNomad"]
    assert r.compiled("sequences::reads")["_"] == ["DNA reads"] and r.compiled("sequences::reads")["qc"] == "none"
    assert r.compiled("containers::seqkit.oci")["provides"] == ["seqkit", "seqkit/stat"]
    assert r.compiled("containers::flye.oci") == {"Format": "OCI", "provides": "flye"}


def test_parse_types():
    text = "types:\n  a:\n    properties:\n      x: 1   # note\n  # comment\n  b:\n    extends:\n    - a\n    properties:\n      y:\n      - q\n      - p\n  c:\n    extends: b\n    properties:\n      x: 2\n"
    r = TypeRegistry().add("n", parse_types(text))
    assert r.compiled("n::b") == {"x": "1", "y": ["p", "q"]} and r.compiled("n::c") == {"x": "2", "y": ["p", "q"]}


def isolate(*drop):
    return Planner(standard(), [t for t in catalogue.standard() if t.name not in drop])


def test_isolate_plan():
    items = [Item("meta", "sequences::read_metadata"), Item("reads", "sequences::long_reads", frozenset({"meta"}))]
    plan = isolate().plan(items, [("sequences::isolate_assembly", ["reads"])])
    assert plan.ok and [s.transform for s in plan.steps] == ["seqkit_reads", "miniasm", "filtlong_targeted", "hifiasm"]
    assert '"hifiasm"' in plan.dot()


def test_lineage_is_respected_and_scatter_does_not_chain():
    items = [Item("meta", "sequences::read_metadata"), Item("reads", "sequences::long_reads")]
    assert not isolate().plan(items, [("sequences::miniasm_gfa", [])]).ok
    plan = isolate("megahit").plan([Item("list", "ncbi::accession_list")], [("sequences::gbk", ["list"])])
    assert not plan.ok and plan.missing == ["sequences::gbk"]


def test_pangenome_plan():
    items = [Item("pan", "pangenome::pangenome"), Item("acc", "ncbi::assembly_accession", frozenset({"pan"}))]
    plan = isolate().plan(items, [("pangenome::heatmap", ["pan"])])
    assert [s.transform for s in plan.steps] == ["get_ncbi_assembly", "ppanggolin", "heatmap"]


def test_run_is_lazy_and_typed(spark):
    types = TypeRegistry().add("t", {"a": {"properties": {"k": "a"}}, "b": {"properties": {"k": "b"}}})
    double = Transform("double", fn=lambda x: {"y": x.selectExpr("id * 2 as id")}).need("x", "t::a").product("y", "t::b")
    p = Planner(types, [double], free=())
    plan = p.plan([Item("i", "t::a")], [("t::b", ["i"])])
    out = p.run(plan, {"i": spark.range(3)})
    assert sorted(r[0] for r in out["t::b"].collect()) == [0, 2, 4]
    assert Resources(1, 2, 3).override(Resources(memory_gb=9)) == Resources(1, 9, 3)
    with pytest.raises(NotImplementedError):
        Planner(types, [Transform("z").need("x", "t::a").product("y", "t::b")], free=()).run(Planner(types, [Transform("z").need("x", "t::a").product("y", "t::b")], free=()).plan([Item("i", "t::a")], [("t::b", [])]), {})


def test_lineage_table(spark):
    n = 15
    c = spark.createDataFrame([(str(i), "t", [str(i - 1)] if i else []) for i in range(n)] + [("x", "t", ["y"]), ("y", "t", ["x"])], "id string, type string, parents array<string>")
    got = sorted((r["id"], r["ancestor"]) for r in planner.lineage(c).collect())
    assert got == sorted([(str(i), str(j)) for i in range(n) for j in range(i + 1)] + [(a, b) for a in "xy" for b in "xy"])


def test_lineage_of_long_ways_takes_few_rounds(spark, monkeypatch):
    """Items with one parent each: rounds are the logarithm of the longest way, rings and parents outside the catalog included."""
    rng = random.Random(4)
    parent = {i: i - 1 for i in range(1, 70)} | {i: rng.choice([rng.randrange(100, i), 999]) for i in range(101, 160)} | {200 + i: 200 + (i + 1) % 5 for i in range(5)} | {205: 201}
    ids = [*range(70), *range(100, 160), *range(200, 206)]
    want = set()
    for i in ids:
        at, seen = i, []
        while at is not None and at not in seen:
            seen.append(at)
            at = parent.get(at)
        want |= {(i, a) for a in seen}
    written, table = [], planner.workspace.table
    monkeypatch.setattr(planner.workspace, "table", lambda df, name: written.append(name) or table(df, name))
    c = spark.createDataFrame([(i, "t", [parent[i]] if i in parent else []) for i in ids], "id int, type string, parents array<int>")
    got = planner.lineage(c).collect()
    assert {(r["id"], r["ancestor"]) for r in got} == want and len(got) == len(want)
    assert written.count("lineage") <= 9


def test_stream(spark, tmp_path):
    from strandlake.streaming import records as st

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">x\nACG\n")
    run = lambda: st.each_batch(st.file_stream(spark, str(tmp_path / "in")), st.record_lengths, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in" / "b.fa").write_text(">y\nACGT\n")
    run()
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "length").collect()
    assert sorted(map(tuple, got)) == [("x", 3), ("y", 4)]


def test_catalogue_has_functions():
    have = {t.name for t in catalogue.standard() if t.fn is not None}
    assert {"seqkit_reads", "assembly_stats", "bbduk", "filtlong", "filtlong_targeted", "add_orfs_to_centroids", "scatter_ncbi_accession", "interleave_short_reads", "ppanggolin", "heatmap"} <= have
    own = lambda **_: {}
    assert {t.name: t.fn for t in catalogue.standard({"flye": own})}["flye"] is own


def test_overrides_go_by_name():
    p = isolate()
    t = {x.name: x for x in p.transforms}["flye"]
    got = p.limits({"*": Resources(cpus=3), "bbduk": Resources(memory_gb=1), t: Resources(cpus=9)})
    assert got["bbduk"] == Resources(3, 1, 12) and got["flye"].cpus == 9 and got["heatmap"] == Resources(3, 8, 1)
    assert p.limits({"all": Resources(memory_gb=5)})["flye"].memory_gb == 5
    with pytest.raises(KeyError):
        p.limits({"nothing": Resources()})


def fasta(spark, rows):
    return spark.createDataFrame(rows, "sample string, id string, seq string")


def test_groups_batches_and_post_conditions(spark):
    types = TypeRegistry().add("t", {k: {"properties": {"k": k}} for k in "abcd"})
    seen = {}

    def gather(pan, asm):
        seen["columns"] = asm.columns
        return {"out": asm.groupBy("group").count().withColumnRenamed("group", "sample")}

    def number(asm):
        return {"out": asm.select("sample", "batch")}

    p = Planner(types, [Transform("gather", group_by="pan", fn=gather).need("pan", "t::a").need("asm", "t::b", "pan").product("out", "t::c").check("out", "count > 1"), Transform("number", group_by="asm", batch_size=2, fn=number).need("asm", "t::b").product("out", "t::d")], free=())
    items = [Item("P", "t::a"), Item("A", "t::b", frozenset({"P"}))]
    plan = p.plan(items, [("t::c", ["P"]), ("t::d", ["A"])])
    asm = spark.createDataFrame([("g1",), ("g2",), ("g3",)], "sample string")
    up = spark.createDataFrame([("g1", "p"), ("g2", "p"), ("g3", "q")], "id string, ancestor string")
    got = p.run(plan, {"P": spark.createDataFrame([("p",), ("q",)], "sample string"), "A": asm}, lineage=up)
    assert {tuple(r) for r in got["t::c"].collect()} == {("p", 2), ("q", 1)} and "group" in seen["columns"]
    assert sorted(map(tuple, got["t::d"].collect())) == [("g1", 0), ("g2", 0), ("g3", 1)]
    assert {(n, ok) for n, _, ok in p.verify()} == {("gather", False), ("number", True)}
    bad = Planner(types, [Transform("z", fn=lambda asm: {}).need("asm", "t::b").product("out", "t::c")], free=())
    with pytest.raises(RuntimeError, match="did not make out"):
        bad.run(bad.plan(items, [("t::c", ["A"])]), {"A": asm})


def test_steps_of_the_catalogue(spark):
    from strandlake.plans import steps

    dna = lambda n, k: "".join("ACGT"[(i * i * k + i // 7) % 4] for i in range(n))
    reads = spark.createDataFrame([("s", i, dna(1000 + 10 * i, i + 1), chr(50 + i) * (1000 + 10 * i)) for i in range(10)] + [("s", 99, "ACGT", "IIII")], "sample string, id int, seq string, qual string").withColumn("group", F.col("sample"))
    out = steps.filtlong(reads=reads)
    kept, lost = {r["id"] for r in out["out"].collect()}, {r["id"] for r in out["disc"].collect()}
    assert kept | lost == {*range(10), 99} and not kept & lost and 9 in kept and {0, 99} <= lost
    gfa = spark.createDataFrame([("s", "S\ta\t" + "A" * 25)], "sample string, content string").withColumn("group", F.col("sample"))
    assert {r["id"] for r in steps.filtlong_targeted(reads=reads, gfa=gfa)["out"].collect()} == {99, 9, 8, 7}
    acc = steps.scatter_ncbi_accession(dep=spark.createDataFrame([("l", "GCF_1\nGCF_2\n")], "sample string, content string"))["acc"]
    assert sorted(r["value"] for r in acc.collect()) == ["GCF_1", "GCF_2"]
    pair = lambda k: spark.createDataFrame([("s", i, f"{i}/{k}") for i in range(3)], "sample string, rec bigint, id string").withColumn("group", F.col("sample"))
    assert [r["id"] for r in steps.interleave(r1=pair(1), r2=pair(2))["out"].orderBy("rec").collect()] == [f"{i}/{k}" for i in range(3) for k in (1, 2)]
    orfs = fasta(spark, [("s", "o1", "MKLVVVAAGHHKLM"), ("s", "o2", "WWWWYYYYPPPPQQQQ")]).withColumn("group", F.col("sample"))
    got = steps.add_orfs_to_centroids(centroids=fasta(spark, [("c", "c1", "MKLVVVAAGHHKLM")]), orfs=orfs, identity=spark.createDataFrame([("0.9",)], "value string"))
    assert {(r["orf_id"], r["centroid_id"], r["status"]) for r in got["assign"].collect()} == {("o1", "c1", "matched"), ("o2", "o2", "new_centroid")}
    assert {r["id"] for r in got["aug"].collect()} == {"c1", "o2"}
    gbk = lambda s, name, *p: (s, f"LOCUS x\nDEFINITION  E. coli strain {name}, complete\n" + "".join(f'     /translation="{q}"\n' for q in p))
    texts = spark.createDataFrame([gbk("a", "K12", "MKLVAAGHHKLM", "WWWWYYYYPPPP"), gbk("b", "DH1", "MKLVAAGHHKLM")], "sample string, content string").withColumn("group", F.lit("pan"))
    pan = steps.ppanggolin(gbk=texts)
    assert {(r["genome"], r["n"]) for r in pan["matrix"].collect()} == {("K12", 1), ("DH1", 1)} and pan["matrix"].count() == 3
    cells = steps.heatmap(matrix=pan["matrix"])["heatmap"].collect()
    assert len(cells) == 4 and sorted(r["v"] for r in cells) == [0, 1, 1, 1]
    tax = steps.gtdbtk(asm=fasta(spark, [("g1", "c", "A")]).withColumn("group", F.col("sample")), summaries=[spark.createDataFrame([("g1", "Bacteria")], "user_genome string, tax string")])["tax"]
    assert [tuple(r) for r in tax.select("sample", "tax").collect()] == [("g1", "Bacteria")]
    short = fasta(spark, [("x", "c", "ACGT")]).withColumn("group", F.col("sample"))
    assert "Skipped" in steps.antismash_gate(assembly=short)["json"].first()["value"]
    with pytest.raises(NotImplementedError):
        steps.antismash_gate(assembly=reads.select("sample", "group", "seq"))
    cds = steps.prodigal(asm=fasta(spark, [("s", "c", "CC" + "ATG" + "GCT" * 40 + "TAA")]).withColumn("group", F.col("sample")))
    assert any(r["seq"].startswith("MAAA") for r in cds["cds"].collect()) and cds["gff"].count() == cds["cds"].count()
    ani = steps.fastani(asm=fasta(spark, [("a", "c", dna(200, 3)), ("b", "c", dna(200, 3))]).withColumn("group", F.lit("p")))["out"]
    assert {(r["sample"], r["a"], r["b"], round(r["identity"], 6)) for r in ani.collect()} == {("p", x, y, 1.0) for x in "ab" for y in "ab"}


def test_library(spark, tmp_path):
    from strandlake.plans.library import DataLibrary, Targets, TransformLibrary

    (tmp_path / "r.fq").write_text("@1\nA\n+\nI\n")
    lib = DataLibrary(str(tmp_path / "lib"), standard())
    m = {k: lib.add_value(f"{k}.json", {"parity": "single"}, "sequences::read_metadata") for k in "ab"}
    r = lib.add_item(str(tmp_path / "r.fq"), "sequences::long_reads", [m["a"]])
    with pytest.raises(KeyError):
        lib.add_value("z", 1, "no::type")
    with pytest.raises(KeyError):
        lib.add_value("z", 1, "sequences::read_metadata", ["nobody"])
    lib.localize(spark, f"file://{tmp_path}/copy").save(spark)
    again = DataLibrary.load(spark, lib.path)
    assert len(again) == 3 and again[r] == lib[r] and (tmp_path / "copy" / "r.fq").exists() and again.get_type(m["b"]) == "sequences::read_metadata"
    assert [i.id for i in again.as_view([r]).items()] == [m["a"], r] and len(again.as_samples("sequences::read_metadata")) == 2
    lineage = {(x["id"], x["ancestor"]) for x in planner.lineage(again.frame(spark)).collect()}
    assert (r, m["a"]) in lineage and len(lineage) == 4
    tl = TransformLibrary().add(*catalogue.standard())
    assert tl.add_stub("mine").name == "mine" and tl["flye"].resources.cpus == 8 and len(list(tl)) == 33
    plan = Planner(standard(), tl.transforms()).plan(again.as_view([r]).items(), Targets().add("sequences::read_qc_stats", [r]))
    assert [s.transform for s in plan.steps] == ["seqkit_reads"]
    again.purge()
    assert len(again) == 0
