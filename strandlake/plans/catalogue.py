"""The transforms of the workflow library by signature. Those that data logic alone can do have their function from
``strandlake.plans.steps``; those that wrap outside research programs have none unless one is registered.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from strandlake.plans.planner import Resources, Transform
from strandlake.plans.steps import FUNCTIONS

# Signatures, one transform a line: name | needs (name=type, ^ names of parents) | products (/ begins another group) | group_by cpus memory hours
_TABLE = """
assembly_stats | meta=sequences::read_metadata reads=sequences::reads^meta rstats=sequences::read_qc_stats^reads asm=sequences::assembly^reads | stats=sequences::assembly_stats concov=sequences::assembly_per_contig_coverage bpcov=sequences::assembly_per_bp_coverage | meta 4 64 12
bbduk | meta=sequences::read_metadata reads=sequences::short_reads^meta rstats=sequences::read_qc_stats^reads | out=sequences::clean_short_reads disc=sequences::discarded_short_reads | meta 2 32 12
filtlong | reads=sequences::long_reads | out=sequences::clean_long_reads disc=sequences::discarded_long_reads | reads 2 32 12
flye | oreads=sequences::long_reads reads=sequences::clean_long_reads^oreads stats=sequences::read_qc_stats^oreads | out=sequences::flye_assembly | oreads 8 32 18
flye_raw | oreads=sequences::long_reads stats=sequences::read_qc_stats^oreads | out=sequences::flye_raw_assembly | oreads 8 32 18
filtlong_targeted | rmeta=sequences::read_metadata reads=sequences::long_reads^rmeta gfa=sequences::miniasm_gfa^rmeta | out=sequences::100x_long_reads | reads 2 32 12
hifiasm | reads=sequences::100x_long_reads | out=sequences::isolate_assembly | reads 8 32 3
hifiasm_meta | reads=sequences::long_reads | out=sequences::hifiasm_meta_assembly | reads 8 32 12
miniasm | rmeta=sequences::read_metadata reads=sequences::long_reads^rmeta rstats=sequences::read_qc_stats^rmeta | out=sequences::miniasm_gfa | rmeta 8 64 12
megahit | meta=sequences::read_metadata reads=sequences::clean_short_reads^meta | out=sequences::assembly | meta 8 32 18
seqkit_reads | reads=sequences::reads | stats=sequences::read_qc_stats | reads 4 8 1
add_orfs_to_centroids | centroids=clustering::centroids orfs=sequences::open_reading_frames identity=clustering::min_identity | aug=clustering::augmented_centroids assign=clustering::new_cluster_assignments | orfs 4 16 3
antismash | assembly=sequences::assembly db=ref::antismash | json=functional_annotation::antismash_json gbk=functional_annotation::antismash_regions_gbk | assembly 8 16 4
diamond_linclust | orfs=sequences::open_reading_frames identity=clustering::min_identity | centroids=clustering::centroids table=clustering::cluster_table | identity 16 32 12
corrected_long_assembly | oreads=sequences::long_reads reads=sequences::clean_long_reads^oreads stats=sequences::read_qc_stats^oreads | out=sequences::assembly | oreads 8 64 24
download_antismash_db | image=containers::antismash.oci | out=ref::antismash | image 2 8 12
dump_ncbi_sra | meta=sequences::read_metadata dep=ncbi::sra_accession^meta cache=ncbi::sra_cache^meta | long=sequences::long_reads / short_pe=sequences::short_reads_pe / short_se=sequences::short_reads_se | meta 4 64 6
get_ncbi_assembly | dep=ncbi::assembly_accession | fna=sequences::assembly faa=sequences::open_reading_frames gff=sequences::gff gbk=sequences::gbk | dep 1 1 -
get_ncbi_sra | meta=sequences::read_metadata dep=ncbi::sra_accession^meta | out=ncbi::sra_cache | dep 1 64 12
interleave_short_reads | pair=sequences::read_pair r1=sequences::forward_short_reads^pair r2=sequences::reverse_short_reads^pair | out=sequences::short_reads | r1 2 4 3
interleave_zipped_short_reads | pair=sequences::read_pair r1=sequences::zipped_forward_short_reads^pair r2=sequences::zipped_reverse_short_reads^pair | out=sequences::short_reads | pair 2 4 3
pull_container | image=containers::container | log=containers::pulled_container | image 1 1 1
ref_genomad | image=containers::genomad.oci | ref=ref::genomad | image 1 8 2
scatter_ncbi_accession | dep=ncbi::accession_list | acc=ncbi::accession | dep 1 1 1
checkm | asm=sequences::assembly | out=taxonomy::checkm_stats raw=taxonomy::checkm_raw | asm 2 44 1
prodigal | asm=sequences::assembly | cds=sequences::open_reading_frames gff=sequences::gff | asm 4 16 3
fastani | pan=pangenome::pangenome asm=sequences::assembly^pan | out=taxonomy::ani_table | pan 4 8 3
genomad | assembly=sequences::assembly ref=ref::genomad | virus=taxonomy::genomad_virus_summary plasmid=taxonomy::genomad_plasmid_summary | assembly 16 32 12
gtdbtk | ref=taxonomy::gtdb asm=sequences::assembly | tax=taxonomy::gtdbtk | asm 2 120 12
metabuli | ref=taxonomy::metabuli_ref asm=sequences::assembly | tax=taxonomy::metabuli rep=taxonomy::metabuli_report html=taxonomy::metabuli_krona | asm 4 64 4
heatmap | matrix=pangenome::ppanggolin_matrix | heatmap=pangenome::heatmap | matrix 1 8 1
ppanggolin | pan=pangenome::pangenome gbk=sequences::gbk^pan | matrix=pangenome::ppanggolin_matrix pg=pangenome::ppanggolin_raw | pan 4 8 3
"""


def standard(functions: Mapping[str, Callable] | None = None) -> list[Transform]:
    """All transforms; ``functions`` adds to or replaces those of ``steps``."""
    known = FUNCTIONS | dict(functions or {})
    out = []
    for line in _TABLE.strip().splitlines():
        name, needs, products, how = (x.strip() for x in line.split("|"))
        group_by, *limits = how.split()
        cpus, memory, hours = (None if x == "-" else float(x) for x in limits)
        t = Transform(name, group_by=group_by, batch_size=100 if name == "gtdbtk" else 1, resources=Resources(int(cpus), int(memory), hours), fn=known.get(name))
        for n in needs.split():
            key, _, kind = n.partition("=")
            kind, *parents = kind.split("^")
            t.need(key, kind, *parents)
        t.products = [dict(p.split("=") for p in g.split()) for g in products.split(" / ")]
        out.append(t)
    return out
