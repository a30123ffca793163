"""Exact quantiles and merged sketches against all values."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliodor.operators import quantiles


@pytest.mark.parametrize("values", ["even", "hot", "few"])
def test_quantiles_are_exact(spark, values):
    rnd = random.Random(6)
    draw = {"even": lambda: rnd.random() * 1e6, "hot": lambda: rnd.choice([7.0, 7.0, 7.0, rnd.gauss(0, 3)]), "few": lambda: float(rnd.randrange(3))}[values]
    rows = [(rnd.choice(["a", "b", None]), draw() if rnd.random() > 0.1 else None) for _ in range(3000)] + [("one", -2.5), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 0.98, 1.0]
    got = {(r.g, r.prob): r.quantile for r in quantiles.quantiles(df, "v", probs, "g").collect()}
    own = lambda g: [v for k, v in rows if k == g and v is not None]
    want = {(g, p): np.quantile(own(g), p) for g in ("a", "b", None, "one") for p in probs}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-9 * max(1, abs(want[k])) for k in want)
    whole = {r.prob: r.quantile for r in quantiles.quantiles(df, "v", [0.5]).collect()}
    assert abs(whole[0.5] - np.quantile([v for _, v in rows if v is not None], 0.5)) < 1e-6
    assert quantiles.quantiles(df.where("g = 'none'"), "v", probs).count() == 0
    assert quantiles.quantile_columns(df, "v", {"low": 0.25, "high": 0.9}, "g").where("g = 'one'").first()[:] == ("one", -2.5, -2.5)


def test_no_task_holds_all_values(spark):
    plan = quantiles.quantiles(spark.range(1000).selectExpr("id AS v"), "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    # values are ordered inside their ranges; what one task orders is the ranges' counts
    assert re.search(r"Window \[sum\(__n#\d+L?\) windowspecdefinition\(__range", plan) and "percentile" not in plan


def test_months_merge_into_years(spark):
    rows = spark.range(60_000).select((F.col("id") % 24).alias("month"), (F.col("id") * 7919 % 9001).alias("who"), (F.col("id") * 31 % 1000).cast("double").alias("x"))
    months = quantiles.sketched(rows, "month", distinct="who", value="x")
    years = quantiles.merged(months.withColumn("year", F.floor(F.col("month") / 12)), "year")
    out = years.select("year", "n", quantiles.sketch_count(F.col("users")).alias("who"), quantiles.sketch_quantile("values", 0.9).alias("p"), quantiles.sketch_rank("values", "500").alias("r")).orderBy("year").collect()
    exact = rows.groupBy(F.floor(F.col("month") / 12).alias("year")).agg(F.count_distinct("who").alias("who")).orderBy("year").collect()
    for r, e in zip(out, exact, strict=True):
        assert r.n == 30_000 and abs(r.who - e.who) < 0.05 * e.who and abs(r.p - 900) < 25 and abs(r.r - 0.5) < 0.03
