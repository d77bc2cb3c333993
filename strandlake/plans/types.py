"""Data types as bags of properties: inheritance, compiled form and matching."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

Props = dict[str, frozenset[str]]


def parse_types(text: str) -> dict[str, dict]:
    """Declarations from the YAML subset that type files use: nested mappings, lists of scalars, comments."""
    root: dict = {}
    stack: list[tuple[int, object]] = [(-1, root)]
    lines = [x.split(" #")[0].rstrip() for x in text.splitlines()]
    lines = [x for x in lines if x.strip() and not x.lstrip().startswith("#")]
    for n, line in enumerate(lines):
        indent, body = len(line) - len(line.lstrip()), line.strip()
        if body.startswith("- "):
            while stack[-1][0] > indent or not isinstance(stack[-1][1], list):
                stack.pop()
            stack[-1][1].append(body[2:].strip())
            continue
        while stack[-1][0] >= indent:
            stack.pop()
        key, _, value = body.partition(":")
        at = stack[-1][1]
        if value.strip():
            at[key] = value.strip()
        else:
            follows = lines[n + 1].strip() if n + 1 < len(lines) else ""
            at[key] = [] if follows.startswith("- ") else {}
            stack.append((indent if isinstance(at[key], dict) else indent - 1, at[key]))
            if isinstance(at[key], list):
                stack[-1] = (indent, at[key])
    return root.get("types", root)


@dataclass
class TypeRegistry:
    """Types by ``namespace::name``."""

    declared: dict[str, dict] = field(default_factory=dict)

    def add(self, namespace: str, types: Mapping[str, dict]) -> TypeRegistry:
        for name, body in types.items():
            self.declared[f"{namespace}::{name}"] = body
        return self

    def flat(self, name: str) -> Props:
        """Properties with those of all parents; a child's key replaces its parents'."""
        namespace = name.split("::")[0]
        body = self.declared[name]
        parents = body.get("extends", [])
        out: Props = {}
        for p in [parents] if isinstance(parents, str) else parents:
            out |= self.flat(p if "::" in p else f"{namespace}::{p}")
        for k, v in (body.get("properties") or {}).items():
            out[k] = frozenset([v] if isinstance(v, str) else v)
        return out

    def compiled(self, name: str) -> object:
        """The stored form: sorted lists, single values bare, the free text a list, or the whole block if it is alone."""
        flat = self.flat(name)
        if set(flat) == {"_"}:
            return sorted(flat["_"])
        return {k: sorted(v) if len(v) > 1 or k == "_" else next(iter(v)) for k, v in sorted(flat.items())}

    def satisfies(self, have: str | Props, want: str | Props) -> bool:
        """Whether every property asked for is there, with every value asked for."""
        have = self.flat(have) if isinstance(have, str) else have
        want = self.flat(want) if isinstance(want, str) else want
        return all(v <= have.get(k, frozenset()) for k, v in want.items())


def _t(extends: str | None = None, **props: object) -> dict:
    out: dict = {"properties": {k.rstrip("_") or "_": v for k, v in props.items()}}
    if extends:
        out["extends"] = extends
    return out


def _doc(text: str, ext: str | None = None, **more: object) -> dict:
    return {"properties": {"_": text, **more, **({"ext": ext} if ext else {})}}


# The types whose names and properties workflows refer to.
SEQUENCES = {
    "assembly": _t(Format="FASTA", Data="nucleic acid sequence", ext="fna"),
    "gbk": _t(Format="genbank file", ext="gbk"),
    "gff": _t(Format="gene feature format", ext="gff"),
    "reads": {"properties": {"_": "DNA reads", "qc": "none", "Format": "FASTQ", "Data": "nucleic acid sequence", "compression": "gzip", "ext": "fq.gz"}},
    "clean_reads": _t("reads", qc="filtered"),
    "discarded_reads": _t("reads", qc="discarded"),
    "short_reads": _t("reads", read_length="short"),
    "short_reads_pe": _t("short_reads", parity="interleaved"),
    "short_reads_se": _t("short_reads", parity="single"),
    "read_pair": _t(atomic="a pair of read files"),
    "forward_short_reads": _t("reads", parity="paired end", direction="forward", read_length="short", ext="fq", compression="none"),
    "zipped_forward_short_reads": _t("reads", parity="paired end", direction="forward", read_length="short"),
    "reverse_short_reads": _t("reads", parity="paired end", direction="reverse", qc="none", read_length="short", ext="fq", compression="none"),
    "zipped_reverse_short_reads": _t("reads", parity="paired end", direction="reverse", read_length="short"),
    "clean_short_reads": _t("clean_reads", read_length="short"),
    "discarded_short_reads": _t("discarded_reads", read_length="short"),
    "clean_short_reads_pe": _t("clean_short_reads", parity="interleaved"),
    "clean_short_reads_se": _t("clean_short_reads", parity="single"),
    "long_reads": _t("reads", parity="single", read_length="long"),
    "clean_long_reads": _t("clean_reads", parity="single", read_length="long"),
    "100x_long_reads": _t("clean_long_reads", coverage="100x"),
    "discarded_long_reads": _t("discarded_reads", parity="single", read_length="long"),
    "read_metadata": _doc("read metadata", "json", fields=["parity", "length_class"]),
    "read_qc_stats": _doc("read QC stats", "json", fields=["reads", "bases", "mean_quality", "phred_encoding", "N50", "GC"]),
    "fastqc_html_report": _doc("fastqc html report", "html"),
    "fastqc_raw_report": _doc("fastqc raw report", "zip"),
    "nanoplot_html_report": _doc("nanoplot html report", "html"),
    "nanoplot_raw_report": _doc("nanoplot raw report", "gz"),
    "assembly_stats": _doc("assembly stats", "json", fields=["fraction_reads_mapped", "length", "N50", "GC", "number_of_contigs"]),
    "assembly_per_contig_coverage": _doc("assembly per contig coverage", "tsv"),
    "assembly_per_bp_coverage": _doc("assembly per bp coverage", "gz"),
    "miniasm_gfa": _doc("miniasm rough assembly", "gfa", Format="graphical fragment assembly"),
    "isolate_assembly": _t("assembly", subject="isolate"),
    "hifiasm_meta_assembly": _t("assembly", method="hifiasm-meta"),
    "flye_assembly": _t("assembly", method="flye"),
    "flye_raw_assembly": _t("assembly", method="flye using raw reads"),
    "open_reading_frames": _t(Format="FASTA", Data="protein sequence", content="open reading frames", ext="faa"),
}
NCBI = {
    "accession_list": _t(database="NCBI", arity="N", ext="csv"),
    "accession": _t(Data="NCBI accession", arity="1", ext="txt"),
    "assembly_accession": _t("accession", database="assemblies"),
    "sra_accession": _t("accession", database="SRA"),
    "sra_cache": _doc("sra prefetch cache"),
}
REF = {"reference_database": _doc("reference database"), "genomad": {"extends": ["reference_database"], **_doc("for geNomad")}, "antismash": {"extends": ["reference_database"], **_doc("for antiSMASH")}}
PANGENOME = {
    "pangenome": _t(logistics="to group genomes into a pangenome"),
    "ppanggolin_raw": _t(Data="raw ppanggolin outputs", ext="ppanggolin"),
    "ppanggolin_matrix": _t(Data="ppanggolin matrix", ext="csv"),
    "heatmap": _t(Data="pangenome matrix", ext="svg"),
}
LIB = {
    "hierarchical_clustering.py": _t(src="hierarchical_clustering", usage="library"),
    "local": _t(src="local", usage="library"),
    "pangenome_heatmap.py": _t(src="pangenome_heatmap", usage="command line"),
}
ALIGNMENT = {"bam": _doc("binary alignment map", "bam"), "csi": _doc("coordinate sorted index", "csi")}
CLUSTERING = {
    "min_identity": _t(Data="minimum percent identity threshold for clustering", arity="1", ext="txt"),
    "centroids": _t(Format="FASTA", Data="representative AA sequences from clustering", ext="faa"),
    "cluster_table": _t(Data="diamond linclust cluster membership assignments", Format="TSV", ext="tsv"),
    "augmented_centroids": _t(Format="FASTA", Data="representative AA sequences augmented with new ORFs", ext="faa"),
    "new_cluster_assignments": _t(Data="cluster assignments for newly added ORFs", Format="TSV", ext="tsv"),
}
FUNCTIONAL_ANNOTATION = {
    "antismash_json": _doc("antiSMASH JSON results per assembly", "json", Format="JSON"),
    "antismash_regions_gbk": _doc("antiSMASH GenBank region files (tar)", "tar.gz", Format="GenBank"),
    "antismash_db": _doc("antiSMASH database directory (Pfam, ClusterBlast, MIBiG, Resfams)"),
    "antismash_source": _doc("Marker for antiSMASH database download"),
}
TAXONOMY = {
    "metabuli_ref": _doc("metabuli reference database"),
    "metabuli": _doc("metabuli per contig classifications", "tsv"),
    "metabuli_report": _doc("metabuli report", "tsv"),
    "metabuli_krona": _doc("metabuli krona report", "html"),
    "genomad_virus_summary": _doc("genomad virus summary", "tsv"),
    "genomad_plasmid_summary": _doc("genomad plasmid summary", "tsv"),
    "checkm_stats": _doc("checkm quality stats", "csv"),
    "checkm_raw": _doc("checkm workspace"),
    "gtdb": _doc("genome taxonomy database"),
    "gtdbtk": _doc("gtdbtk per contig classifications", "tsv"),
    "gtdbtk_raw": _doc("gtdbtk raw workspace"),
    "ani_table": _doc("fastani pairwise average nucleotide identity", "tsv"),
}
_PROVIDES = {
    "bbtools": "bbtools/reformat.sh bbtools/bbduk.sh bbtools/filterbyname.sh", "seqkit": "seqkit seqkit/stat", "bedtools": "bedtools bedtools/genomecov",
    "sra-tools": "fasterq-dump sratk/prefetch sratk/vdb-validate", "diamond": "diamond diamond/makedb diamond/blastp diamond/linclust",
    "python_for_data_science": "python=3.12 py/numpy py/scipy py/pandas py/numba py/yaml py/requests py/xmltodict py/plotly py/matplotlib py/biopython py/jupyter py/notebook",
}
_IMAGES = "fastp fastqc nanoplot filtlong bbtools seqkit minimap2 bedtools samtools flye megahit miniasm hifiasm-meta hifiasm gfatools ncbi-datasets sra-tools checkm metabuli gtdbtk fastani genomad pprodigal diamond ppanggolin antismash python_for_data_science"
CONTAINERS = {
    "container": _t(Format="OCI"),
    "pulled_container": _t(ext="log", atomic_description="pulled OCI container"),
    **{f"{i}.oci": _t("container", provides=_PROVIDES.get(i, i).split()) for i in _IMAGES.split()},
}


def standard() -> TypeRegistry:
    """All types of the ten namespaces."""
    r = TypeRegistry()
    for namespace, types in {
        "sequences": SEQUENCES, "ncbi": NCBI, "ref": REF, "pangenome": PANGENOME, "lib": LIB, "alignment": ALIGNMENT,
        "clustering": CLUSTERING, "functional_annotation": FUNCTIONAL_ANNOTATION, "taxonomy": TAXONOMY, "containers": CONTAINERS,
    }.items():
        r.add(namespace, types)
    return r
