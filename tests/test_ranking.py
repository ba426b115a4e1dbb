"""Exact order statistics on skewed groups against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapewise.operators import ranking as R


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    hot = pd.DataFrame({"k": "hot", "v": np.where(rng.random(4000) < 0.35, -1.0, rng.normal(size=4000)).round(4)})
    cold = pd.DataFrame({"k": [f"c{i % 7}" for i in range(600)], "v": rng.normal(size=600).round(2)})
    pdf = pd.concat([hot, cold], ignore_index=True)
    pdf["id"] = range(len(pdf))
    pdf.loc[::50, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return pdf, df


def _with_partitions(spark, n, f):
    """Run with ``n`` shuffle partitions that are not merged."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return f()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_hot_group_takes_many_partitions(spark, skewed):
    pdf, df = skewed
    order = F.struct(F.col("v").alias("a"), F.col("id").alias("b"))

    def parts():
        laid = R.laid_out(df.withColumn("o", order), ["k", "o"])
        return laid.where("k = 'hot'").select(F.spark_partition_id().alias("p")).groupBy("p").count().toPandas()["count"]

    sizes = _with_partitions(spark, 16, parts)
    assert len(sizes) >= 10 and sizes.max() < 800  # 4,000 rows


def test_several_ranks_in_one_pass_with_null_keys(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", None], 500), "u": rng.integers(0, 9, 500).astype(float), "v": rng.normal(size=500), "id": range(500)})
    pdf.loc[rng.random(500) < 0.4, "u"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k string, u double, v double, id int")
    got = R.average_pct_ranks(df, ["k"], {"u": "pu", "v": "pv"}).toPandas().sort_values("id")
    assert len(got) == 500
    g = pdf.groupby("k", dropna=False)
    np.testing.assert_allclose(got.pu.to_numpy(float), g.u.rank(pct=True), rtol=1e-12)
    np.testing.assert_allclose(got.pv.to_numpy(float), g.v.rank(pct=True), rtol=1e-12)


def test_average_rank_matches_pandas(skewed):
    pdf, df = skewed
    got = R.average_pct_rank(df, ["k"], "v", "p").select("id", "p").toPandas().set_index("id")["p"].sort_index()
    want = pdf.groupby("k")["v"].rank(pct=True)
    np.testing.assert_allclose(got.to_numpy(dtype=float), want.to_numpy(), rtol=1e-12)


def test_quantiles_match_numpy(skewed):
    pdf, df = skewed
    got = R.exact_quantiles(df, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}).toPandas().set_index("k").sort_index()
    want = pdf.dropna().groupby("k")["v"].quantile([0.05, 0.5, 0.95]).unstack().sort_index()
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("ranges", [1, 5, 64])
def test_position_is_a_permutation_for_any_number_of_ranges(spark, skewed, ranges):
    pdf, df = skewed
    order = F.struct(F.col("v").alias("a"), F.col("id").alias("b"))
    got = _with_partitions(spark, ranges, lambda: R.with_position(df.where("v is not null").withColumn("o", order), ["k"], "o").select("k", "id", "position", "group_rows").toPandas())
    want = pdf.dropna().sort_values(["k", "v", "id"])
    want["position"] = want.groupby("k").cumcount() + 1
    m = got.merge(want, on=["k", "id"])
    assert (m["position_x"] == m["position_y"]).all() and len(m) == len(want)
    assert (got.groupby("k")["group_rows"].first() == want.groupby("k").size()).all()


def test_positions_do_not_depend_on_partitioning(skewed):
    _, df = skewed
    order = F.struct(F.col("v").alias("a"), F.col("id").alias("b"))
    one, many = (R.with_position(df.repartition(n).withColumn("o", order), ["k"], "o").select("id", "position")
                 .toPandas().sort_values("id").reset_index(drop=True) for n in (1, 16))
    pd.testing.assert_frame_equal(one, many)


def _longest(flags):
    best = cur = 0
    for f in flags:
        cur = cur + 1 if f else 0
        best = max(best, cur)
    return best


@pytest.mark.parametrize("share", [0.5, 0.9, 1.0])
def test_longest_run(spark, share):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": 1, "o": range(900), "f": rng.random(900) < share})
    got = R.longest_run(spark.createDataFrame(pdf), ["g"], "o", F.col("f"), "n").first()["n"]
    assert got == _longest(pdf["f"])
