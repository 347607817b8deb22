"""Column expressions that read item names and class labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which labels belong to which group; any other label, and no label, is 'excluded'.
NATURAL = ("veins", "broken-rock", "float", "bedrock", "meteorite")
ROVER = ("drt", "dump-pile", "drill-hole", "scuff")
EXCLUDED = ("other", "edge_cases")
TYPICAL_SPLIT = "test_typical"
# Name patterns.
SOL = r"(?i)sol[_\-]?(\d{1,6})"
CAMERA = (r"(?i)mcam\d+[_\-]([A-Za-z]{1,3})", r"(?i)[_\-]([MLR]{1,2})[_\-]?\d*[_\-]sol")
SEQUENCE = r"(?i)mcam(\d+)"


def _first(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def parse_sol(name: Column) -> Column:
    """Day number in a name: the first match, at most six digits, else null."""
    return _first(name, SOL).try_cast("bigint")


def parse_camera(name: Column) -> Column:
    """Camera code, upper case, from the first pattern that finds one; the word SOL is none."""
    found = [F.upper(_first(name, p)) for p in CAMERA]
    return F.coalesce(*[F.when(f != "SOL", f) for f in found])


def parse_sequence(name: Column) -> Column:
    return _first(name, SEQUENCE).try_cast("bigint")


def frame_meta(name: Column) -> Column:
    return F.struct(name.alias("source_filename"), parse_sol(name).alias("sol"), parse_camera(name).alias("camera"), parse_sequence(name).alias("sequence"))


def split_labels(c: Column) -> Column:
    """Labels of a |-joined field, without empty ones; none for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), "[|]"), lambda x: x != "")


def group_of(label: Column) -> Column:
    return F.when(label.isin(*NATURAL), "natural").when(label.isin(*ROVER), "rover").otherwise("excluded")


def groups_for_labels(labels: Column) -> Column:
    """Distinct groups of the labels; {excluded} for none."""
    found = F.array_sort(F.array_distinct(F.transform(labels, group_of)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("excluded")))


def mission_group(split: Column, groups: Column) -> Column:
    """One group: typical for the typical split, else natural before rover before excluded."""
    return F.when(split == TYPICAL_SPLIT, "typical").when(F.array_contains(groups, "natural"), "natural").when(F.array_contains(groups, "rover"), "rover").otherwise("excluded")


def join_labels(labels: Column) -> Column:
    """Sorted distinct labels joined by |, 'unknown' without any."""
    return F.coalesce(F.nullif(F.array_join(F.array_sort(F.array_distinct(labels)), "|"), F.lit("")), F.lit("unknown"))


def is_novel(split: Column) -> Column:
    return split != TYPICAL_SPLIT
