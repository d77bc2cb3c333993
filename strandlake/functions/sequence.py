"""Column functions on sequences and read statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code, codons in TCAG order.
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: _AMINO[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def dna(text: Column) -> Column:
    """Any text as a sequence: letters a to z become A, C, G, T in turn, all else is left out."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    letters = F.translate(F.lower(text), alphabet, ("ACGT" * 7)[: len(alphabet)])
    return F.regexp_replace(letters, "[^ACGT]", "")


def gc_count(seq: Column) -> Column:
    return F.regexp_count(seq, F.lit("[GCgc]")).cast("bigint")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def kmers(seq: Column, k: int) -> Column:
    """Array of all substrings of length k; empty for shorter sequences. Sequences are ASCII.

    Cut from bytes: a substring of a string is searched from its start, which would make this quadratic.
    """
    raw = seq.cast("binary")
    n = F.octet_length(seq) - k + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(raw, i, F.lit(k)).cast("string"))).otherwise(F.array().cast("array<string>"))


def translate_codons(seq: Column) -> Column:
    """Protein of the first frame; a codon with other letters is X, a rest of one or two bases is left out."""
    n = F.floor(F.length(seq) / 3).cast("int")
    code = F.create_map(*(F.lit(x) for kv in CODONS.items() for x in kv))
    codons = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.coalesce(F.element_at(code, F.upper(F.substring(seq, i * 3 + 1, F.lit(3)))), F.lit("X")))
    return F.when(n > 0, F.array_join(codons, "")).otherwise(F.lit(""))


def phred_offset(encoding: Column) -> Column:
    """33 for ``sanger``; every other guess counts as 64."""
    return F.when(encoding == "sanger", 33).otherwise(64)


def quality_encoding(least_ascii: Column) -> Column:
    """Name of the quality encoding from the smallest character code."""
    return F.when(least_ascii < 59, "sanger").when(least_ascii < 64, "solexa").otherwise("illumina-1.3+")


def adaptive_min_length(n50: Column) -> Column:
    """At least 20, at most 51, else one more than a third of N50."""
    return F.least(F.lit(51), F.greatest(F.floor(n50 / 3) + 1, F.lit(20))).cast("bigint")


def aligner_preset(length_class: Column, quality: Column) -> Column:
    long = F.when(quality >= 30, "asm5").when(quality >= 20, "asm10").otherwise("asm20")
    return F.when(length_class == "long", long).otherwise("sr")


def overlap_preset(quality: Column) -> Column:
    return F.when(quality >= 20, "ava-pb").otherwise("ava-ont")


def error_rate(quality: Column) -> Column:
    """Probability of a wrong base; qualities above 33 count as 33."""
    return F.pow(F.lit(10.0), -F.least(F.lit(33.0), quality) / 10)


def assembler_args(quality: Column) -> Column:
    """Mode and, for accurate reads, the error rate with six decimals."""
    return F.when(quality >= 20, F.concat(F.lit("pacbio-hifi --read-error "), F.format_string("%.6f", error_rate(quality)))).otherwise(F.lit("nano-raw"))


def corrected_args(quality: Column) -> Column:
    """Variant that always states the error rate and falls back to corrected reads."""
    mode = F.when(quality >= 20, "pacbio-hifi").otherwise("nano-corr")
    return F.concat(mode, F.lit(" --read-error "), F.format_string("%.6f", error_rate(quality)))


def interleaved_flag(parity: Column) -> Column:
    """``--12`` for paired reads, ``-r`` for single ones; other values raise an error."""
    return F.when(parity == "paired", "--12").when(parity == "single", "-r").otherwise(F.raise_error(F.concat(F.lit("unknown parity "), parity)))


def read_route(length_class: Column, parity: Column) -> Column:
    """Product type of a read set; an unknown parity behaves as single, an unknown length class has none."""
    short = F.when(parity == "paired", "short_reads_pe").otherwise("short_reads_se")
    return F.when(length_class == "long", "long_reads").when(length_class == "short", short)
