"""Reports over run records: figures with their lineage, wide tables by pivot, and documents as numbered lines.

Every figure is a row: what it is of, its mean and spread over seeds, how it is written, and the records, filter and
column that it comes from. A table of a report is a pivot of such rows over a fixed list of columns; a document is
the lines of its sections in one order over all of them, so no section is gathered to be written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import numbered

#: More columns than a reader has use for are an error of the caller.
MOST_COLUMNS = 200


def spread(mean: Column, sd: Column, n: Column, digits: int = 3) -> Column:
    """'mean ± sd' of several seeds, the value alone of one, '-' of none."""
    one = F.format_string(f"%.{digits}f", mean)
    return F.when(n.isNull() | (n == 0), "-").when(n == 1, one).otherwise(F.concat(one, F.lit(" ± "), F.format_string(f"%.{digits}f", sd)))


def figures(values: DataFrame, rows: list[str], column: str, table: str, digits: int = 3) -> DataFrame:
    """One figure for each (rows, column) of ``values`` (rows, column, seed, value): mean, population sd, n, text, source.

    A null value is a run that doesn't state it: it is left out of the figure, and counted in ``n_missing``.
    """
    keys = [*rows, column]
    v = F.col("value")
    made = values.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.count(v).alias("n"), F.count_if(v.isNull()).alias("n_missing"))
    named = [F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("null"))) for k in keys]
    source = F.concat(F.lit(f"{table} where "), F.concat_ws(" and ", *named), F.lit(": mean of value over "), F.col("n").cast("string"), F.lit(" runs"))
    return made.withColumn("text", spread(F.col("mean"), F.col("sd"), F.col("n"), digits)).withColumn("source", source)


def wide(made: DataFrame, rows: list[str], column: str, columns: Sequence, cell: str = "text", missing: str = "-") -> DataFrame:
    """``rows`` and a column for each of ``columns`` (values of ``column``), holding ``cell``."""
    if len(columns) > MOST_COLUMNS:
        raise ValueError(f"{len(columns)} columns in one table")
    table = made.groupBy(*rows).pivot(column, list(columns)).agg(F.first(cell))
    return table.select(*rows, *(F.coalesce(F.col(f"`{c}`"), F.lit(missing)).alias(str(c)) for c in columns))


def columns_of(made: DataFrame, column: str) -> list:
    """The distinct values of ``column`` in order, for a pivot."""
    found = [r[0] for r in made.select(column).distinct().orderBy(column).limit(MOST_COLUMNS + 1).collect()]
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns in one table")
    return found


def table_lines(table: DataFrame, heads: dict[str, str], *order: str, section: int, place: int = 0) -> DataFrame:
    """section, place, sort, line of a Markdown table: ``heads`` names the columns to show and how; rows in ``order``."""
    spark = table.sparkSession
    head = [(section, place, "", f"| {' | '.join(heads.values())} |"), (section, place + 1, "", "|" + "---|" * len(heads))]
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in heads)), F.lit(" |"))
    # One sort text over all sections: numbers at one width, so that they order as numbers do.
    kinds = dict(table.dtypes)
    sort = F.concat_ws("\u0001", *(F.lpad(F.col(c).cast("string"), 20, "0") if kinds[c] in ("int", "bigint") else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order))
    body = table.select(F.lit(section).alias("section"), F.lit(place + 2).alias("place"), sort.alias("sort"), cells.alias("line"))
    return spark.createDataFrame(head, "section int, place int, sort string, line string").unionByName(body)


def text_lines(spark, lines: Sequence[str], section: int, place: int = 0) -> DataFrame:
    return spark.createDataFrame([(section, place + k, "", x) for k, x in enumerate(lines)], "section int, place int, sort string, line string")


def document(parts: Sequence[DataFrame]) -> DataFrame:
    """line_no, line of all parts in order of section, place and sort; equal rows are in order of their text."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return numbered(whole, "section", "place", "sort", "line", name="line_no").select("line_no", "line")


def incomplete(runs: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Runs that lack a field that a report needs, and which."""
    lacking = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f.rpartition(".")[2])) for f in fields]))
    return runs.select(*keys, lacking.alias("missing")).filter(F.size("missing") > 0)


def run_figures(runs: DataFrame) -> dict[str, DataFrame]:
    """The figures of nested run records (``sources.records.RUN``): precision by k, AUC by group and by class, and costs."""
    each = lambda c, name: runs.select("tier", "seed", F.explode_outer(c).alias(name, "_v"))
    ks = each("metrics.precision_at_k", "k").filter("k is not null").select("tier", "seed", F.col("k").cast("long").alias("k"), F.col("_v").alias("value"))
    groups = each("decomposed", "grp").filter("grp is not null").select("tier", "seed", "grp", F.col("_v.roc_auc").alias("value"))
    whole = runs.select("tier", "seed", F.lit("all").alias("grp"), F.col("metrics.roc_auc").alias("value"))
    classes = each("per_class_roc_auc", "class").filter("class is not null").select("tier", "seed", "class", F.col("_v.n").alias("n_rows"), F.col("_v.roc_auc").alias("value"))
    return {
        "curve": figures(ks, ["tier"], "k", "runs.metrics.precision_at_k"),
        "groups": figures(groups.unionByName(whole), ["tier"], "grp", "runs.decomposed.roc_auc"),
        "classes": figures(classes, ["tier"], "class", "runs.per_class_roc_auc").join(classes.groupBy("class").agg(F.max("n_rows").alias("n_rows")), "class"),
        "costs": runs.groupBy("tier").agg(F.max("cost.param_count").alias("params"), F.max("cost.flops_per_inference").alias("flops"), F.avg("cost.wall_clock_seconds").alias("seconds")),
    }


def tier_report(runs: DataFrame, window: int, cycles_per_flop: float, budget: float, groups: dict[str, str], own: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """line_no, line: the headline of each tier, its precision by k, and AUC by class within each group.

    ``groups`` deals classes; one that it doesn't name is excluded. ``own`` has the cycles per operation and budget of
    the processor that a tier was sized for; the shared processor's columns stand beside those.
    """
    spark, made = runs.sparkSession, run_figures(runs)
    at_window = made["curve"].filter(F.col("k") == window).select("tier", F.col("text").alias("p_window"))
    by_group = wide(made["groups"], ["tier"], "grp", ["natural", "rover", "all"])
    rate = F.coalesce(*[F.when(F.col("tier") == t, F.lit(float(r))) for t, (r, _) in (own or {}).items()], F.lit(None).cast("double"))
    room = F.coalesce(*[F.when(F.col("tier") == t, F.lit(float(b))) for t, (_, b) in (own or {}).items()], F.lit(None).cast("double"))
    share = F.col("flops") * cycles_per_flop / budget
    shown = F.format_string("%.0f%%", share * 100)
    head = made["costs"].join(at_window, "tier", "left").join(by_group, "tier", "left").select(
        "tier", F.coalesce("p_window", F.lit("-")).alias("p_window"), "natural", "rover", "all", F.coalesce(F.format_number("params", 0), F.lit("-")).alias("params"), F.coalesce(F.format_number("flops", 0), F.lit("-")).alias("flops_text"),
        F.coalesce(F.format_string("%.2f%%", F.col("flops") * rate / room * 100), F.lit("-")).alias("own"), F.coalesce(F.format_number(F.col("flops") * cycles_per_flop, 0), F.lit("-")).alias("cycles"),
        F.when(share > 1, F.concat(F.lit("**"), shown, F.lit("**"))).otherwise(F.coalesce(shown, F.lit("-"))).alias("share"),
    )
    heads = {"tier": "tier", "p_window": "p@window", "natural": "ROC AUC natural", "rover": "ROC AUC rover", "all": "ROC AUC aggregate", "params": "params", "flops_text": "FLOPs/inf", "own": "% of own tier budget", "cycles": "cycles on the shared processor", "share": "% of the shared budget"}
    ks = columns_of(made["curve"], "k")
    curve = wide(made["curve"], ["tier"], "k", ks)
    tiers = columns_of(runs, "tier")
    classes = wide(made["classes"], ["class", "n_rows"], "tier", tiers).withColumn("grp", F.coalesce(*[F.when(F.col("class") == c, F.lit(g)) for c, g in groups.items()], F.lit("excluded")))
    titles = {"natural": "natural", "rover": "rover", "excluded": "excluded: too few to rate"}
    parts = [
        text_lines(spark, ["# Accuracy and onboard compute", "", "## Headline", ""], 0),
        table_lines(head, heads, "tier", section=1),
        text_lines(spark, ["", "Shares of a tier's own budget have their own denominators and can't be compared between rows; shares of the shared budget can.", "", "## Precision at k", ""], 2),
        table_lines(curve, {"tier": "tier"} | {str(k): f"p@{k} (window)" if k == window else f"p@{k}" for k in ks}, "tier", section=3),
        text_lines(spark, ["", "## ROC AUC by class", ""], 4),
    ]
    for n, (grp, title) in enumerate(titles.items()):
        own_classes = classes.filter(F.col("grp") == grp)
        if own_classes.take(1):
            parts += [text_lines(spark, [f"### {title}", ""], 5 + 3 * n), table_lines(own_classes, {"class": "class", "n_rows": "n"} | {t: t for t in tiers}, "class", section=6 + 3 * n), text_lines(spark, [""], 7 + 3 * n)]
    return document(parts)
