"""Sentiment as known at decision time, and the size penalty it causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewise.functions.exprs import is_true
from tapewise.params import SentimentParams

VIEW_COLUMNS = ("score", "confidence", "sample_size", "freshness_bars", "source_count", "disagreement", "is_stale")
DAY = 86_400.0


def check_bitemporal(obs: DataFrame) -> DataFrame:
    """Fail on an observation that would be known before it happened."""
    return obs.where(F.assert_true(F.col("available_ts") >= F.col("event_ts"),
                                   F.lit("observation available before its event")).isNull())


def visible_observations(decisions: DataFrame, obs: DataFrame, p: SentimentParams = SentimentParams()) -> DataFrame:
    """Observations each decision may use: available, and not older than the limit.

    Decisions are spread over the days their look-back touches and observations
    over their own day, so the equi key is (symbol, day): a symbol holding a third
    of the observations is divided by time, and each observation meets only the
    decisions of the following days.
    """
    reach = int(p.max_age_hours // 24) + 1
    day = lambda c: F.floor(F.unix_micros(c) / F.lit(86_400_000_000))
    probe = decisions.select("symbol", "ts").distinct().withColumn(
        "_day", F.explode(F.sequence(day(F.col("ts")) - reach, day(F.col("ts")))))
    o = obs.select(F.col("symbol").alias("_osym"), "source", "available_ts", "score", "source_weight", "sample_size",
                   day(F.col("available_ts")).alias("_oday"))
    age = (F.unix_micros("ts") - F.unix_micros("available_ts")) / F.lit(3_600_000_000.0)
    hit = probe.join(o, (F.col("symbol") == F.col("_osym")) & (F.col("_day") == F.col("_oday"))
                     & (F.col("available_ts") <= F.col("ts")))
    return hit.withColumn("age_hours", age).where(F.col("age_hours") <= p.max_age_hours).drop("_osym", "_day", "_oday")


def observation_weight(p: SentimentParams) -> Column:
    return (F.pow(F.lit(0.5), F.col("age_hours") / p.half_life_hours) * F.col("source_weight")
            * F.log1p(F.col("sample_size").cast("double")))


def decayed_totals(decisions: DataFrame, obs: DataFrame, p: SentimentParams = SentimentParams()) -> DataFrame:
    """Totals (sw, sw2, sws, newest, samples) of the usable observations per (symbol, ts, source).

    Time is cut into blocks as long as the look-back, so a decision sees the front of its
    own block and the rear of the block before. A weight that halves every half life is
    a product: one factor for the observation's place in its block, one for the decision's.
    So the decayed totals of a front (or rear) are running totals of the first factor per
    (symbol, source, block), read where the look-back ends and scaled by the second. Decisions
    enter that timeline as two rows for each source that the block has; no decision is
    paired with an observation, and the totals add only observations of the look-back.
    Observations of one instant are summed before the shuffle.
    """
    reach, half = round(p.max_age_hours * 3_600_000_000), p.half_life_hours * 3_600_000_000
    if reach > 400 * half:
        raise ValueError("the look-back is longer than 400 half lives: weights at its end can't be told from zero")
    start = F.col("blk") * F.lit(reach)
    base = F.col("source_weight") * F.log1p(F.col("sample_size").cast("double"))
    o = (obs.select("symbol", "source", F.unix_micros("available_ts").alias("t"), base.alias("b"), "score", "sample_size")
         .where("b > 0").groupBy("symbol", "source", "t")
         .agg(F.sum("b").alias("b"), F.sum(F.col("b") * F.col("b")).alias("b2"), F.sum(F.col("b") * F.col("score")).alias("bs"), F.sum("sample_size").alias("n"))
         .withColumn("blk", F.floor(F.col("t") / F.lit(reach))))
    grow = F.pow(F.lit(2.0), (F.col("t") - start) / half)
    seen = o.select("symbol", "source", "blk", "t", F.lit(1).alias("side"), (F.col("b") * grow).alias("g"), (F.col("b2") * grow * grow).alias("g2"),
                    (F.col("bs") * grow).alias("gs"), "n", F.col("t").alias("at"))
    d = decisions.select("symbol", F.unix_micros("ts").alias("t")).distinct()
    ends = d.select("symbol", F.explode(F.array(F.struct(F.col("t").alias("t"), F.lit(2).alias("side")),
                                                F.struct((F.col("t") - reach).alias("t"), F.lit(0).alias("side")))).alias("e")).select(
        "symbol", "e.*").withColumn("blk", F.floor(F.col("t") / F.lit(reach)))
    sources = o.select("symbol", "blk", "source").distinct()  # a small closed set
    asks = ends.join(sources, ["symbol", "blk"]).select(
        "symbol", "source", "blk", "t", "side", *[F.lit(None).cast("double").alias(c) for c in ("g", "g2", "gs")],
        *[F.lit(None).cast("long").alias(c) for c in ("n", "at")])
    by = Window.partitionBy("symbol", "source", "blk")
    front = by.orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    rear = by.orderBy(F.col("t").desc(), F.col("side").desc()).rowsBetween(Window.unboundedPreceding, 0)
    line = seen.unionByName(asks)
    for w, end in ((front, "f"), (rear, "r")):
        line = line.select("*", *[F.sum(c).over(w).alias(f"{end}_{c}") for c in ("g", "g2", "gs", "n")], F.max("at").over(w).alias(f"{end}_at"))
    own = {c: F.when(F.col("side") == 2, F.col(f"f_{c}")).otherwise(F.col(f"r_{c}")) for c in ("g", "g2", "gs", "n", "at")}
    at = F.when(F.col("side") == 2, F.col("t")).otherwise(F.col("t") + reach)
    shrink = F.pow(F.lit(0.5), (at - start) / half)
    return line.where("side <> 1").where(own["at"].isNotNull()).groupBy("symbol", F.timestamp_micros(at).alias("ts"), "source").agg(
        F.sum(shrink * own["g"]).alias("sw"), F.sum(shrink * shrink * own["g2"]).alias("sw2"), F.sum(shrink * own["gs"]).alias("sws"),
        F.timestamp_micros(F.max(own["at"])).alias("newest"), F.sum(own["n"]).alias("samples"))


def sentiment_views(decisions: DataFrame, obs: DataFrame, p: SentimentParams = SentimentParams()) -> DataFrame:
    """One aggregated view per (symbol, ts); no usable observation gives a neutral one."""
    per_source = decayed_totals(decisions, obs, p)
    # sources are a small closed set, so their means travel as one short list
    per = per_source.groupBy("symbol", "ts").agg(
        F.sum("sw").alias("_sw"), F.sum("sw2").alias("_sw2"), F.sum("sws").alias("_sws"), F.max("newest").alias("_newest"),
        F.sum("samples").alias("sample_size"), F.count(F.lit(1)).alias("source_count"),
        F.array_sort(F.collect_list(F.struct("source", (F.col("sws") / F.col("sw")).alias("m"), "sw"))).alias("_src"))
    mean = F.col("_sws") / F.col("_sw")
    spread = F.aggregate("_src", F.lit(0.0), lambda a, s: a + s["sw"] * (s["m"] - mean) * (s["m"] - mean)) / F.col("_sw")
    stdev = F.when(F.col("source_count") < 2, 0.0).otherwise(F.sqrt(F.greatest(spread, F.lit(0.0))))
    per = per.withColumns({
        "score": mean, "_neff": F.col("_sw") * F.col("_sw") / F.col("_sw2"),
        "disagreement": F.least(F.lit(1.0), stdev),
        "freshness_bars": (F.unix_micros("ts") - F.unix_micros("_newest")) / F.lit(DAY * 1e6),
    })
    conf = (F.least(F.lit(1.0), F.col("_neff") / p.n_eff_full) * (1.0 - F.col("disagreement"))
            * F.pow(F.lit(0.5), F.col("freshness_bars") / p.freshness_half_life_bars))
    per = per.withColumn("confidence", conf).withColumn(
        "is_stale", (F.col("freshness_bars") > p.max_freshness_bars) | (F.col("_neff") < p.min_n_eff)
        | (F.col("confidence") < p.min_confidence)).select("symbol", "ts", *VIEW_COLUMNS)
    out = decisions.select("symbol", "ts").distinct().join(per, ["symbol", "ts"], "left")
    neutral = {"score": 0.0, "confidence": 0.0, "sample_size": 0, "freshness_bars": 0.0, "source_count": 0,
               "disagreement": 0.0}
    return out.fillna(neutral).withColumn("is_stale", F.coalesce("is_stale", F.lit(False)))


def is_neutral() -> Column:
    return F.col("is_stale") | (F.col("sample_size") <= 0) | (F.col("source_count") == 0)


def sentiment_multiplier(sign: Column, p: SentimentParams = SentimentParams()) -> Column:
    """Penalty only: 1 when neutral, disabled or aligned, 0 is a veto."""
    aligned = F.col("score") * sign
    severity = F.abs(aligned) * F.col("confidence")
    out = F.when(F.lit(not p.enabled) | F.coalesce(is_neutral(), F.lit(True)), 1.0).when(aligned >= 0, 1.0)
    return out.when(severity >= p.veto, 0.0).otherwise(F.greatest(F.lit(p.min_multiplier), 1.0 - severity * p.slope))


def with_sentiment(decisions: DataFrame, obs: DataFrame, p: SentimentParams = SentimentParams()) -> DataFrame:
    """Attach the view and the multiplier to decisions with symbol, ts and sign."""
    views = sentiment_views(decisions, obs, p)
    return decisions.join(views, ["symbol", "ts"], "left").withColumn(
        "sentiment_multiplier", sentiment_multiplier(F.col("sign"), p)).withColumn(
        "sentiment_veto", is_true(F.col("sentiment_multiplier") <= 0))
