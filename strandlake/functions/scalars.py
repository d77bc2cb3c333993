"""Scalar column functions: text, numbers, maps, JSON and packed values."""

from __future__ import annotations

import gzip
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how a strain is named in a DEFINITION line.
STRAIN = r"(?:substr\.?\s?|strain\s?)(\S+)"


def numeric_kind(x: Column) -> Column:
    """``int``, ``float``, ``string`` or null: text without a point is tried as an integer, then as a number; a trailing % is ignored."""
    t = strip_percent(x)
    whole = (F.instr(t, ".") == 0) & t.try_cast("bigint").isNotNull()
    return F.when(x.isNull(), None).when(whole, "int").when(t.try_cast("double").isNotNull(), "float").otherwise("string")


def numeric_value(x: Column) -> Column:
    return strip_percent(x).try_cast("double")


def strip_percent(x: Column) -> Column:
    return F.regexp_replace(x, "%$", "")


def strain_name(definition: Column, fallback: Column | None = None) -> Column:
    """Strain of a DEFINITION line: what follows ``substr.`` or ``strain``, else the line without its keyword; spaces become hyphens and , . ' \" go."""
    found = F.regexp_extract(definition, STRAIN, 1)
    name = F.when(found != "", found).otherwise(F.replace(definition, F.lit("DEFINITION"), F.lit("")))
    clean = F.translate(F.replace(F.trim(name), F.lit(" "), F.lit("-")), ",.'\"", "")
    return clean if fallback is None else F.when(F.coalesce(clean, F.lit("")) == "", fallback).otherwise(clean)


def accession_of(filename: Column) -> Column:
    """The part before the first point, of that the part before the first underscore."""
    return F.split_part(F.split_part(filename, F.lit("."), F.lit(1)), F.lit("_"), F.lit(1))


def path_stem(path: Column) -> Column:
    """The last path element without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)/*$", 1), r"(?<=.)\.[^.]*$", "")


def path_suffix(path: Column) -> Column:
    return F.regexp_extract(F.regexp_extract(path, r"([^/]+)/*$", 1), r".(\.[^.]*)$", 1)


def all_matches(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(0))


def signed_log10(x: Column) -> Column:
    return F.signum(x) * F.log10(F.abs(x) + 1)


def sorted_by_keys(values: Column, keys: Column) -> Column:
    """The array values in the order of the parallel array keys; equal keys keep their order."""
    zipped = F.transform(values, lambda v, i: F.struct(F.get(keys, i).alias("k"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(zipped), lambda z: z["v"])


def map_update(left: Column, right: Column) -> Column:
    """Entries of both maps; of equal keys the right one wins."""
    kept = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def chosen(a: Column, b: Column, keep) -> Column:
    """The distinct values of two arrays that ``keep`` holds for, in the order of the first, then the second."""
    return F.filter(F.array_union(a, b), keep)


def common(a: Column, b: Column) -> Column:
    """The distinct values that both arrays have."""
    return F.array_intersect(a, b)


def get_or(m: Column, key: str, default: str) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def public_keys(m: Column) -> Column:
    """The map without the keys that begin with an underscore."""
    return F.map_filter(m, lambda k, v: ~F.startswith(k, F.lit("_")))


def content_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256)


def now_millis() -> Column:
    return F.unix_millis(F.current_timestamp())


def memory_params(memory_gb: int) -> dict[str, int]:
    """Arguments that steps derive from a memory limit."""
    return {"placement_cpus": max(1, (memory_gb - 8) // 40), "search_gb": memory_gb - 6, "cluster_gb": memory_gb - 8}


def pack_json(x: Column) -> Column:
    """gzip of the JSON text, without a time stamp."""

    def pack(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else gzip.compress(json.dumps(json.loads(v)).encode(), mtime=0))

    return F.pandas_udf(pack, "binary")(x)


def unpack_json(x: Column) -> Column:
    def unpack(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else gzip.decompress(v).decode())

    return F.pandas_udf(unpack, "string")(x)
