"""Problem 7: a sample that matches target proportions of categories.

Swap repair: a random sample that satisfies the floors is counted by category
signature; as long as it lowers the deviation from the targets, members of one
signature are exchanged for members of another, in counts; at the end the
counts are filled with random records, and the report counts those.

Labels compare without letter case, width form and outer blanks. A record with
a null label is in no stratum; one id counts once. An empty table gives targets
with nothing available.
"""

from __future__ import annotations

import random
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fumigura.llm.common import dice, first_by_dice, materialize
from fumigura.llm.unify import per_distinct

LABELS = ("gold_category", "subcategory", "expected_modality")


def label(text: str) -> str:
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).strip()


def _with_signature(df: DataFrame) -> DataFrame:
    named = {c: f"_{c}" for c in LABELS}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(per_distinct(label, named), schema + "".join(f", {c} string" for c in named.values()))


def repair(available: list[int], targets: list[float], floors: list[int], size: int, seed: int = 0) -> list[int]:
    """Counts by stratum: a random start that satisfies the floors, then exchanges while the squared deviation falls."""
    rng = random.Random(seed)
    n = len(available)
    take = [min(a, f) for a, f in zip(available, floors, strict=True)]
    room = [a - t for a, t in zip(available, take, strict=True)]
    left = max(0, min(size, sum(available)) - sum(take))
    while left:  # at random, in shares of what there is
        open_ = [i for i in range(n) if room[i]]
        weights = [rng.random() * room[i] for i in open_]
        total = sum(weights)
        before = left
        for i, w in zip(open_, weights, strict=True):
            k = min(room[i], int(before * w / total), left)
            take[i], room[i], left = take[i] + k, room[i] - k, left - k
        if left == before:
            i = rng.choice(open_)
            take[i], room[i], left = take[i] + 1, room[i] - 1, left - 1
    floor = [min(a, f) for a, f in zip(available, floors, strict=True)]
    while True:
        # an exchange of one lowers the deviation if the surpluses differ by more than one; the widest pair does most
        surplus = [t - x for t, x in zip(take, targets, strict=True)]
        over = max((i for i in range(n) if take[i] > floor[i]), key=lambda i: surplus[i], default=None)
        under = min((i for i in range(n) if take[i] < available[i]), key=lambda i: surplus[i], default=None)
        if over is None or under is None or surplus[over] - surplus[under] <= 1 + 1e-9:
            return take
        k = max(1, min(take[over] - floor[over], available[under] - take[under], int((surplus[over] - surplus[under]) / 2)))
        take[over], take[under] = take[over] - k, take[under] + k


def _plan(items: DataFrame, targets: DataFrame, seed: int) -> tuple[DataFrame, list[dict]]:
    wanted = [r.asDict() for r in targets.orderBy(*LABELS).collect()]  # a target for each stratum: as many as are asked for
    keys = [tuple(label(r[c]) if r[c] is not None else None for c in LABELS) for r in wanted]
    spark = items.sparkSession
    strata = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], ", ".join(f"_{c} string" for c in LABELS) + ", stratum int")
    rows = _with_signature(items.select("id", *LABELS).where(" and ".join(f"{c} is not null" for c in ("id", *LABELS))))
    members = materialize(rows.join(F.broadcast(strata), [f"_{c}" for c in LABELS]).select("id", "stratum").distinct(), "strata")
    count = dict(members.groupBy("stratum").count().collect())
    have = [count.get(i, 0) for i in range(len(keys))]
    sizes = {r["sample_size"] for r in wanted}
    if len(sizes) > 1:
        raise ValueError("sample_size differs between targets")
    size = sizes.pop() if sizes else 0
    floors = [r["min_rows"] for r in wanted]
    take = repair(have, [r["sample_size"] * r["target_share"] for r in wanted], floors, size, seed)
    return members, [r | {"stratum": i, "available": have[i], "drawn": take[i]} for i, r in enumerate(wanted)]


def _drawn(members: DataFrame, plan: list[dict], seed: int) -> DataFrame:
    """(id, stratum) of the members drawn at random, as many by stratum as the plan says."""
    rows = materialize(members.withColumn("dice", dice(F.lit(seed), "id")), "strata-dice")
    return first_by_dice(rows, "stratum", ["id"], None, {r["stratum"]: r["drawn"] for r in plan}).where("first").select("id", "stratum")


_REPORT = "stratum int, gold_category string, subcategory string, expected_modality string, target_rows double, min_rows int, available long"


def sample_report(items: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """By stratum of ``targets``: rows aimed at, available and drawn, and how the sample falls short.

    ``drawn`` counts the records of the sample. ``missed``: they are fewer than
    the target or the floor (also by less than one record, or because the floors
    of others take their place); ``short``: and there are not enough records.
    """
    members, plan = _plan(items, targets, seed)
    rows = [(r["stratum"], *(r[c] for c in LABELS), float(round(r["sample_size"] * r["target_share"], 9)), r["min_rows"], r["available"]) for r in plan]
    counts = _drawn(members, plan, seed).groupBy("stratum").agg(F.count("*").alias("drawn"))
    out = items.sparkSession.createDataFrame(rows, _REPORT).join(F.broadcast(counts), "stratum", "left").drop("stratum").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    out = out.withColumn("missed", (F.col("drawn") < F.col("target_rows")) | (F.col("drawn") < F.col("min_rows")))
    return out.withColumn("short", F.col("missed") & ((F.col("available") < F.col("target_rows")) | (F.col("available") < F.col("min_rows"))))


def stratified_sample(items: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(id, and the labels of its stratum) of the records drawn."""
    members, plan = _plan(items, targets, seed)
    names = items.sparkSession.createDataFrame([(r["stratum"], *(r[c] for c in LABELS)) for r in plan], "stratum int, " + ", ".join(f"{c} string" for c in LABELS))
    return _drawn(members, plan, seed).join(F.broadcast(names), "stratum").select("id", *LABELS)
