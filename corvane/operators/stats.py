"""Statistics: regression gate for measurements, counters and gauges, tabular helpers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import display_width

#: Unit, most ratio, floor, whether significance is asked for.
GATES = [("sec/op", 2.0, 100e-6, True), ("allocs/op", 1.2, 8.0, False), ("B/op", 1.25, 4096.0, False)]
MIN_SAMPLES, ALPHA = 5, 0.05
#: Samples on each side up to which the p-value is exact.
EXACT = 20


def u_test(x: np.ndarray, y: np.ndarray) -> float:
    """Two-sided p-value of the Mann-Whitney U test: exact without ties and up to EXACT samples, else normal."""
    n, m = len(x), len(y)
    both = np.concatenate((x, y))
    ranks = pd.Series(both).rank().to_numpy()
    u = ranks[:n].sum() - n * (n + 1) / 2
    low = min(u, n * m - u)
    _, counts = np.unique(both, return_counts=True)
    if (counts == 1).all() and n <= EXACT and m <= EXACT:
        # ways[s]: how many choices of ranks for x give U = s, one more rank at a time
        ways = {(0, 0): 1.0}
        for _ in range(n):
            step: dict[tuple[int, int], float] = {}
            for (last, s), w in ways.items():
                for k in range(last, m + 1):
                    step[k, s + k] = step.get((k, s + k), 0) + w
            ways = step
        return min(1.0, 2 * sum(w for (_, s), w in ways.items() if s <= low) / math.comb(n + m, n))
    var = n * m / 12 * ((n + m + 1) - (counts**3 - counts).sum() / ((n + m) * (n + m - 1)))
    return 1.0 if var <= 0 else min(1.0, math.erfc(max(0.0, abs(u - n * m / 2) - 0.5) / math.sqrt(2 * var)))


def compare(old: DataFrame, new: DataFrame, gates: list[tuple[str, float, float, bool]] = GATES) -> DataFrame:
    """Medians of (name, unit, value) on both sides and the verdict: new, missing, skipped, ok or regression.

    A unit without a gate is skipped, as is an old median of 0 or less or below the floor, and too few samples where
    significance is asked for. Medians and counts are built-in aggregates; only series that exceed their ratio and
    need it are gathered for the U test, one group for each series.
    """
    o = old.groupBy("name", "unit").agg(F.median("value").alias("old"), F.count("*").alias("old_n"))
    n = new.groupBy("name", "unit").agg(F.median("value").alias("new"), F.count("*").alias("new_n"))
    gate = F.broadcast(old.sparkSession.createDataFrame(gates, "unit string, most double, floor double, sig boolean"))
    both = o.join(n, ["name", "unit"], "full_outer").join(gate, "unit", "left")
    few = F.col("sig") & ((F.col("old_n") < MIN_SAMPLES) | (F.col("new_n") < MIN_SAMPLES))
    verdict = (
        F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "missing").when(F.col("most").isNull() | (F.col("old") <= 0) | (F.col("old") < F.col("floor")) | few, "skipped")
        .when(F.col("new") / F.col("old") <= F.col("most"), "ok").when(F.col("sig"), "test").otherwise("regression")
    )
    both = both.withColumn("verdict", verdict)
    wanted = both.filter("verdict = 'test'").select("name", "unit")
    samples = old.withColumn("side", F.lit(0)).unionByName(new.withColumn("side", F.lit(1))).join(wanted, ["name", "unit"], "left_semi")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (pdf.loc[pdf["side"] == s, "value"].to_numpy() for s in (0, 1))
        return pd.DataFrame([(*key, u_test(x, y))], columns=["name", "unit", "p"])

    p = samples.groupBy("name", "unit").applyInPandas(run, "name string, unit string, p double")
    out = both.join(p, ["name", "unit"], "left")
    final = F.when(F.col("verdict") != "test", F.col("verdict")).when(F.col("p") < ALPHA, "regression").otherwise("ok")
    return out.select("name", "unit", "old", "new", final.alias("verdict"))


def counters(instruments: DataFrame, samples: DataFrame) -> DataFrame:
    """Total of each instrument's samples by attribute; an instrument without samples gives a zero without attribute."""
    s = samples.groupBy("instrument", "attr").agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return instruments.join(s, "instrument", "left").select("instrument", "attr", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))


def gauges(samples: DataFrame) -> DataFrame:
    """Latest value of each instrument and attribute."""
    return samples.groupBy("instrument", "attr").agg(F.max_by("value", "seq").alias("value"))


def column_widths(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Largest width of each column position in cells of a terminal."""
    return rows.select(F.posexplode(cells).alias("col", "cell")).groupBy("col").agg(F.max(display_width(F.col("cell"))).alias("width"))


def canonical_options(options: DataFrame) -> DataFrame:
    """name=value of each name in order of appearance, names sorted: (name, options)."""
    v = options.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    return v.select("name", F.transform("v", lambda x: F.concat(F.col("name"), F.lit("="), x["value"])).alias("options"))


def expand_routes(routes: DataFrame, config: DataFrame) -> DataFrame:
    """Hops of each route in order with their endpoints; `problem` for unknown hops and those that have a route themselves."""
    hops = routes.select("route", F.posexplode(F.split("hops", ",")).alias("pos", "hop"))
    c = config.select(F.col("name").alias("hop"), "endpoint", "proxy")
    problem = F.when(F.col("endpoint").isNull(), "unknown").when(F.coalesce("proxy", F.lit("")) != "", "nested")
    return hops.join(c, "hop", "left").select("route", "pos", "hop", "endpoint", problem.alias("problem"))


def reflow(rows: DataFrame, available: int, gap: int = 2) -> DataFrame:
    """rows(layout, row, cells) in the most columns whose widths fit `available`: (layout, columns, width).

    With k columns a row's cell i stands in column i % k; k runs from the longest row's cells down to 1, which is taken
    where nothing fits. Cells are folded to the widest of each place, of which a layout has as many as its longest row;
    the k are tried on these in place. A k whose gaps alone don't fit is not tried.
    """
    gap = max(gap, 0)
    cells = rows.filter(F.col("layout").isNotNull()).select("layout", F.posexplode("cells").alias("i", "cell"))
    places = cells.groupBy("layout", "i").agg(F.max(display_width(F.col("cell"))).alias("w"))
    w = F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"])
    at = places.groupBy("layout").agg(w.alias("w")).withColumn("n", F.size("w"))

    def width(k: Column) -> Column:
        """With k columns, null where no cell has a width."""
        column = F.transform(F.sequence(F.lit(0), k - 1), lambda c: F.array_max(F.transform(F.sequence(c, F.col("n") - 1, k), lambda i: F.get("w", i))))
        total = F.aggregate(column, F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
        return F.when(F.array_max("w").isNotNull(), total + gap * (k - 1))

    most = F.least(F.col("n"), F.lit(available // gap + 1)) if gap and available > 0 else F.col("n")
    best = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), most), lambda k: width(k) <= available)), F.lit(1)) if available > 0 else F.col("n")
    return at.select("layout", "w", "n", best.alias("columns")).select("layout", "columns", width(F.col("columns")).alias("width"))


def histogram(samples: DataFrame, bounds: list[float]) -> DataFrame:
    """Counts by instrument, attribute and bucket; bucket i holds values up to bounds[i], the last one what is above all."""
    bucket = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b < F.col("value")))
    return samples.groupBy("instrument", "attr", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def strip_prefix(rows: DataFrame, prefixes: DataFrame, column: str) -> DataFrame:
    """rows whose column lost the longest of prefixes(prefix), each of which ends in a slash.

    Each distinct value meets the prefixes that end at one of its own slashes, an equi-join whatever their number.
    """
    value = rows.select(column).distinct()
    parts = F.split(column, "/")
    own = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    at = value.select(column, F.explode(F.when(F.size(parts) > 1, own)).alias("prefix")).join(prefixes.select("prefix"), "prefix")
    best = at.groupBy(column).agg(F.max(F.length("prefix")).alias("__n"))
    cut = F.substring(F.col(column), F.coalesce("__n", F.lit(0)) + 1, F.length(column))
    return rows.join(best, column, "left").withColumn(column, cut).drop("__n").select(rows.columns)
