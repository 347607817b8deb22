"""Expressions over report text: numbers, placeholders, markers, formatted values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number, a placeholder, a published marker, a list marker; what may stand around a figure
# (a hyphen may not: it can be a sign) and around a placeholder.
NUMBER = r"(?<![\w.])\d+(?:,\d{3})*(?:\.\d+)?"
PLACEHOLDER = r"\{\{([A-Z0-9_]+)\}\}"
NUMERAL, LIST_MARKER = r"(?U)[\w.,%+-]*\d[\w.,%+-]*", r"(?m)^(\s*)\d+[.)](\s)"
MARKER = r"([^<>\n]*)<!--@([A-Za-z0-9_.]+)-->"
LEFT, RIGHT, AROUND = r"[\s*_`~(\[{<«–—]", r"[\s*_`~)\]}>».,;:–—]", r"[\s\-*_•.;:,]"


def numbers(text: Column) -> Column:
    """Distinct number tokens, thousands separators removed."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), 0), lambda x: F.replace(x, F.lit(","), F.lit(""))))


def number_forms(v: Column) -> Column:
    """How a value may be printed: 0 to 6 decimals of it and of 100 times it, and as KiB over 1000."""
    shown = [F.format_string(f"%.{p}f", x) for p in range(7) for x in (v, v * 100)]
    kib = F.when(F.abs(v) > 1000, F.array(F.format_string("%.1f", v / 8192), F.format_string("%.0f", v / 8192))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(*shown), kib))


def placeholders(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), 1))


def markers(line: Column) -> Column:
    """(shown text, key) of each marker on a line."""
    return F.zip_with(F.regexp_extract_all(line, F.lit(MARKER), 1), F.regexp_extract_all(line, F.lit(MARKER), 2), lambda t, k: F.struct(t.alias("text"), k.alias("key")))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def last_words(shown: Column, value: Column) -> Column:
    """As many last words of ``shown`` as ``value`` has, without decoration around them."""
    words, n = _words(shown), F.size(_words(value))
    tail = F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), n), " ")
    return F.regexp_replace(F.regexp_replace(tail, f"^{LEFT}+", ""), f"{RIGHT}+$", "")


def misplaced(text: Column) -> Column:
    """Lines that mix placeholders with words of their own; bullets, emphasis and stops are none."""

    def own(line: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(line, PLACEHOLDER, ""), f"^{AROUND}+|{AROUND}+$", "") != ""

    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\r\n]"), lambda x: x.rlike(PLACEHOLDER) & own(x)), F.trim)


def placed(key: Column) -> Column:
    """A key as its placeholder."""
    return F.concat(F.lit("{{"), key, F.lit("}}"))


def unsanctioned(text: Column) -> Column:
    """Tokens with a digit outside placeholders and list markers, stops and commas at their ends taken off."""
    masked = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), PLACEHOLDER, "\u0000PLACEHOLDER\u0000"), LIST_MARKER, "$1-$2")
    return F.transform(F.regexp_extract_all(masked, F.lit(NUMERAL), 0), lambda x: F.regexp_replace(x, r"^[.,]+|[.,]+$", ""))


def percent(x: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f%%", x * 100)


def kib(bits: Column) -> Column:
    return F.format_string("%.1f KiB", bits / 8192)


def mean_sd(mean: Column, sd: Column, places: int = 3) -> Column:
    return F.format_string(f"%.{places}f ± %.{places}f", mean, sd)


def human_bytes(n: Column) -> Column:
    units = ["B", "KiB", "MiB", "GiB", "TiB"]
    out = F.format_string("%.1f TiB", n / float(1 << 40))
    for k in range(3, -1, -1):
        out = F.when(n < float(1 << 10 * (k + 1)), F.format_string(f"%.{1 if k else 0}f {units[k]}", n / float(1 << 10 * k))).otherwise(out)
    return out
