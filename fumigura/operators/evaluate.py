"""Measures of predictions, latencies and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def confusion(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row: tp, fp, fn, tn and precision, recall and F1 in per cent; 0 where undefined. Null counts as negative."""
    t, g = F.coalesce(truth, F.lit(False)), F.coalesce(guess, F.lit(False))
    c = df.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))
    share = lambda a, b: F.when(b > 0, a * 100.0 / b).otherwise(0.0)
    c = c.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return c.select("tp", "fp", "fn", "tn", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round(f1, 4).alias("f1"))


def by_category(df: DataFrame, category: str, passed: Column) -> DataFrame:
    """Passed, total and accuracy by category, and over all (category null)."""
    rows = df.select(category, passed.cast("int").alias("ok")).rollup(category).agg(F.count("*").alias("total"), F.sum(F.coalesce("ok", F.lit(0))).alias("passed"))
    return rows.select(category, "total", "passed", F.round(F.col("passed") / F.col("total"), 6).alias("accuracy"))


def nearest_rank(df: DataFrame, value: str, shares: list[float], buckets: int = 4096, small: int = 50_000) -> DataFrame:
    """(p, value): the value at place floor(n p) of the sorted numbers, exactly; nulls don't count, no numbers give no rows.

    Counts by range narrow each place down to a range of at most ``small`` rows,
    which alone is sorted; nothing is ordered as a whole.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    n, lo, hi = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    out = []
    for p in shares if n else []:
        place, a, b, part, size = min(int(n * p), n - 1), lo, hi, rows, n
        while size > small and b > a:
            width = (b - a) / buckets
            if a + width == a:
                break
            slot = F.least(F.floor((F.col("v") - a) / width), F.lit(buckets - 1)).cast("int")
            counts = sorted(part.groupBy(slot.alias("s")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect())  # at most ``buckets`` rows
            for s in counts:
                if place < s["n"]:
                    break
                place -= s["n"]
            a, b, size = s["a"], s["b"], s["n"]
            part = rows.where(F.col("v").between(a, b))
        # equal values are folded, so that a value of many rows is one
        for r in part.groupBy("v").count().orderBy("v").collect():
            if place < r["count"]:
                out.append((float(p), r["v"]))
                break
            place -= r["count"]
    return df.sparkSession.createDataFrame(out, "p double, value double")


def masked_accuracy(truth: Column, guess: Column, ignore: int = -100) -> Column:
    """Share of equal labels among those that count, null if none does."""
    pairs = F.filter(F.arrays_zip(truth.alias("t"), guess.alias("g")), lambda x: x["t"] != ignore)
    return F.when(F.size(pairs) > 0, F.size(F.filter(pairs, lambda x: x["t"] == x["g"])) / F.size(pairs))


def argmax(values: Column) -> Column:
    """Place of the largest value, the first of equals, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    e = F.transform(values, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def running_mean(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(group, order, F.avg(value).over(w).alias("running_mean"))


def guard_rates(df: DataFrame, confession: Column, change: Column, recollection: Column, truth: Column, least: float = 65.0, guarded: float = 80.0, rise: float = 0.30) -> DataFrame:
    """False positives and negatives of a threshold rule, before and after a higher threshold guards recollections; null where no case can be wrong."""
    rows = df.select(truth.alias("t"), ((confession >= least) & (change >= rise)).alias("plain"), ((confession >= F.when(F.coalesce(recollection, F.lit(False)), guarded).otherwise(least)) & (change >= rise)).alias("guard"))
    rate = lambda p, of: F.round(F.sum((p & of).cast("int")) / F.nullif(F.sum(of.cast("int")), F.lit(0)), 6)
    t, plain, guard = F.col("t"), F.coalesce("plain", F.lit(False)), F.coalesce("guard", F.lit(False))
    return rows.agg(rate(plain, ~t).alias("fp"), rate(~plain, t).alias("fn"), rate(guard, ~t).alias("fp_guarded"), rate(~guard, t).alias("fn_guarded"))


# Classes of the trials: share, truth, recollection, mean and deviation of confession and of the change in tension.
TRIALS = [(0.25, True, False, 78.0, 8.0, 0.48, 0.12), (0.50, False, False, 35.0, 16.0, 0.15, 0.10), (0.25, False, True, 71.0, 5.5, 0.38, 0.10)]


def perturbation_trials(spark, n: int = 50_000, seed: int = 42) -> DataFrame:
    """The rates of ``guard_rates`` over ``n`` random states; normal numbers by seed, so tolerance counts, not the last digit."""
    base = spark.range(n).select("id", F.randn(seed).alias("a"), F.randn(seed + 1).alias("b"))
    upto, cols = 0.0, {}
    for k, name in enumerate(("truth", "past", "cm", "cs", "tm", "ts"), 1):
        upto, c = 0.0, None
        for row in TRIALS:
            upto += row[0]
            hit = F.col("id") < int(n * upto)
            c = F.when(hit, row[k]) if c is None else c.when(hit, row[k])
        cols[name] = c.otherwise(TRIALS[-1][k])
    r = base.withColumns(cols)
    cut = lambda c, most: F.least(F.lit(most), F.greatest(F.lit(0.0), c))
    return guard_rates(r, cut(F.col("cm") + F.col("a") * F.col("cs"), 100.0), cut(F.col("tm") + F.col("b") * F.col("ts"), 1.0), F.col("past"), F.col("truth"))
