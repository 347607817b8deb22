"""Fact sheets over replayed missions: the only figures that a report may state, as rows, and the audit of texts against them.

A sheet is a declared list of (key, unit, amount or text, condition); a log of any length becomes rows in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.cost import provisional

#: Fixed values, as are the sheets' keys below: from here on a summary recommends something (share of bits wasted, frames expired).
WASTE_LIMIT, EXPIRY_LIMIT = 0.10, 50


def _shown(amount: Column, unit: str) -> Column:
    forms = {"%": lambda: T.percent(amount), "bits": lambda: T.kib(amount), "x": lambda: F.format_string("%.1f×", amount), "pp": lambda: F.format_string("%+.1f", amount * 100), "rate": lambda: F.format_string("%.1f", amount)}
    return forms.get(unit, lambda: F.format_number(amount, 0))()


def _sheet(df: DataFrame, keys: list[str], facts: list[tuple]) -> DataFrame:
    """keys, place, key, unit, amount (null for texts), shown; facts without an amount, or whose condition fails, are left out."""
    rows = []
    for place, (key, unit, value, *on) in enumerate(facts):
        amount = F.lit(None).cast("double") if unit == "text" else value.cast("double")
        shown = value.cast("string") if unit == "text" else _shown(amount, unit)
        on = F.coalesce(on[0], F.lit(False)) if on else F.lit(True)
        rows.append(F.struct(F.lit(place).alias("place"), F.lit(key).alias("key"), F.lit(unit).alias("unit"), amount.alias("amount"), F.when(on, shown).alias("shown")))
    return df.select(*keys, F.inline(F.array(*rows))).filter("shown is not null")


def window_facts(log: DataFrame, total: Column | None = None) -> DataFrame:
    """Facts of each window of each run; ``total`` is the mission's number of frames of interest, where known."""
    c, sent, available = F.col, F.col("cum_sent_natural"), F.col("cum_natural_available")
    total = F.lit(None).cast("bigint") if total is None else total
    share = lambda a, b: F.when(c(b) > 0, c(a) / c(b))
    return _sheet(
        log, ["run", "window"],
        [
            ("WINDOW", "count", c("window")),
            ("SOLS", "text", F.concat_ws("-", c("first_sol"), c("last_sol"))),
            ("ARRIVED", "frames", c("n_arrived")),
            ("BUFFERED", "frames", c("n_buffered")),
            ("SELECTED", "frames", c("n_selected")),
            ("SENT_BREAKDOWN", "text", F.concat_ws(", ", c("sent_natural"), c("sent_rover"), c("sent_typical"))),
            ("BINDING_CONSTRAINT", "text", c("binding_constraint")),
            ("BITS_SHARE", "%", share("bits_used", "bits_budget"), c("bits_budget") > 0),
            ("CYCLES_SHARE", "%", share("cycles_used", "cycles_budget"), c("cycles_budget") > 0),
            ("SCORED", "frames", c("n_scored")),
            ("UNSCORED", "frames", c("n_unscored")),
            ("EXPIRED", "frames", c("n_expired"), c("n_expired") > 0),
            ("EVICTED", "frames", c("n_evicted"), c("n_evicted") > 0),
            ("PREFILTER_RECALL", "%", c("prefilter_recall"), c("prefilter_recall").isNotNull()),
            ("CUM_YIELD", "%", F.when(available > 0, F.coalesce(F.nullif(c("cum_science_yield"), F.lit(0.0)), sent / available)).otherwise(0.0), sent.isNotNull()),
            ("CUM_YIELD_PROVISIONAL", "text", F.lit("provisional"), (available > 0) & provisional(available, total)),
            ("REFIT", "text", F.lit("true"), c("refit")),
        ],
    )


def roll_up(log: DataFrame) -> DataFrame:
    """What a mission's facts need of its windows, a row a run; the three windows of heaviest expiry come from a bounded rank."""
    bound = F.col("binding_constraint")
    all_ = log.groupBy("run").agg(
        F.count("*").alias("n_windows"), F.min("first_sol").alias("sol_min"), F.max("last_sol").alias("sol_max"), F.count_if(bound == "bits").alias("n_bits"), F.count_if(bound == "cycles").alias("n_cycles"),
        F.avg("prefilter_recall").alias("recall_mean"), F.count("prefilter_recall").alias("n_recall"),
    )
    worst = log.filter("n_expired > 0").select("run", "window", "n_expired", F.row_number().over(W.partitionBy("run").orderBy(F.desc("n_expired"), "window")).alias("k")).filter("k <= 3")
    three = worst.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "window", "n_expired"))), lambda x: F.concat_ws(":", x.window, x.n_expired)), ", ").alias("worst"))
    return all_.join(three, "run", "left")


def mission_facts(log: DataFrame, runs: DataFrame, fifo: str = "fifo", tier: str = "unknown", adaptation: str = "frozen") -> DataFrame:
    """Facts of each run of ``runs`` (summaries) and its windows, compared with the run named ``fifo`` where there is one."""
    c = F.col
    base = runs.filter(c("run") == fifo).select(c("science_yield").alias("fifo_yield"), c("wasted_bit_share").alias("fifo_wasted"), c("n_sent_natural").alias("fifo_natural")).limit(1)
    both = runs.join(roll_up(log), "run").join(F.broadcast(base), F.lit(True), "left")  # one row
    gain = c("science_yield") - c("fifo_yield")
    known = c("fifo_yield").isNotNull()
    return _sheet(
        both, ["run"],
        [
            ("POLICY", "text", c("method")),
            ("TIER", "text", F.lit(tier)),
            ("ADAPTATION", "text", F.lit(adaptation)),
            ("N_WINDOWS", "count", c("n_windows")),
            ("SOL_RANGE", "text", F.concat_ws("-", "sol_min", "sol_max")),
            ("SCIENCE_YIELD", "%", c("science_yield")),
            ("FIFO_SCIENCE_YIELD", "%", c("fifo_yield"), known),
            ("YIELD_DELTA_VS_FIFO", "pp", gain, known),
            ("YIELD_RATIO_VS_FIFO", "x", F.try_divide(c("science_yield"), c("fifo_yield")), c("fifo_yield") > 0),
            ("BITS_USED", "bits", c("bits_used")),
            ("BITS_AVAILABLE", "bits", c("bits_available")),
            ("BITS_UTILISATION", "%", F.try_divide(c("bits_used"), c("bits_available")), c("bits_available") != 0),
            ("WASTED_BIT_SHARE", "%", c("wasted_bit_share")),
            ("FIFO_WASTED_BIT_SHARE", "%", c("fifo_wasted"), known),
            ("N_SENT", "frames", c("n_sent")),
            ("N_EXPIRED_TOTAL", "frames", c("n_expired")),
            ("N_EXPIRED_NATURAL", "frames", c("n_expired_natural"), c("n_expired_natural").isNotNull()),
            ("BANDWIDTH_LIMITED", "count", c("n_bits")),
            ("COMPUTE_LIMITED", "count", c("n_cycles")),
            ("PREFILTER_RECALL_MISSION", "%", c("prefilter_recall_natural"), c("prefilter_recall_natural").isNotNull()),
            ("PREFILTER_RECALL_WINDOW_MEAN", "%", c("recall_mean"), c("n_recall") > 0),
            ("N_UNSCORED", "count", c("n_unscored"), c("n_unscored").isNotNull()),
            ("SCORES_PER_WINDOW", "rate", c("scores_affordable_per_window"), c("scores_affordable_per_window") > 0),
            ("N_REFITS", "count", c("n_refits")),
            ("TOP_EXPIRY_WINDOWS", "text", c("worst"), c("worst").isNotNull()),
        ],
    )


def catalogue(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The placeholders that a text may use, in order, a row a sheet (a sheet has a fixed number of facts)."""
    return facts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "key"))), lambda x: T.placed(x.key)), " ").alias("placeholders"))


def rendered(texts: DataFrame, facts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, text with its {{KEY}}s replaced by what the facts show, and the keys that no fact has (these stay as they are)."""
    sheet = facts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("key", "shown"))).alias("_of"))
    both = texts.join(sheet, keys, "left").withColumn("_of", F.coalesce("_of", F.create_map().cast("map<string,string>")))
    used = T.placeholders(F.coalesce(F.col(text), F.lit("")))
    filled = F.aggregate(used, F.coalesce(F.col(text), F.lit("")), lambda s, k: F.when(F.element_at("_of", k).isNull(), s).otherwise(F.replace(s, T.placed(k), F.element_at("_of", k))))
    return both.select(*keys, filled.alias(text), F.filter(used, lambda k: F.element_at("_of", k).isNull()).alias("unknown"))


def unsupported(texts: DataFrame, facts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, number: what a text states that neither a fact's form nor the difference or ratio of two of its sheet's amounts gives.

    A sheet's pairs are a fixed number, whatever the log's length.
    """
    amounts = facts.filter("amount is not null").select(*keys, "place", "amount")
    a, b = amounts.withColumnsRenamed({"place": "_p", "amount": "_x"}), amounts.withColumnsRenamed({"place": "_q", "amount": "_y"})
    pairs = a.join(b, keys).filter("_p <> _q").select(*keys, F.explode(F.array(F.col("_x") - F.col("_y"), F.try_divide("_x", "_y"))).alias("amount")).filter("amount is not null")
    forms = amounts.select(*keys, "amount").unionByName(pairs).select(*keys, F.explode(T.number_forms(F.col("amount"))).alias("number"))
    stated = facts.select(*keys, F.explode(T.numbers(F.col("shown"))).alias("number"))
    known = forms.unionByName(stated).withColumn("number", F.ltrim(F.col("number"), F.lit("-"))).distinct()
    return texts.select(*keys, F.explode(T.numbers(F.col(text))).alias("number")).join(known, [*keys, "number"], "left_anti")


def advice(log: DataFrame, runs: DataFrame) -> DataFrame:
    """run, advice: what a run's figures call for, in a fixed order; 'No change.' where nothing does."""
    both = runs.join(roll_up(log), "run")
    wasted, starved, expired = F.col("wasted_bit_share") > WASTE_LIMIT, F.col("n_cycles") > 0, F.col("n_expired") > EXPIRY_LIMIT
    parts = [
        F.when(wasted, F.concat(F.lit("Screen out the craft's own frames: they took "), T.percent(F.col("wasted_bit_share")), F.lit(" of the bits sent."))),
        F.when(starved, F.concat(F.lit("Provide more compute: it bound "), F.format_number("n_cycles", 0), F.lit(" of "), F.format_number("n_windows", 0), F.lit(" windows."))),
        F.when(expired, F.concat(F.lit("Keep frames for longer: "), F.format_number("n_expired", 0), F.lit(" expired unsent."))),
        F.when(~wasted & ~starved & ~expired, F.lit("No change.")),
    ]
    return both.select("run", F.concat_ws(" ", *parts).alias("advice"))
