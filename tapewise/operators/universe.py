"""Candidate seeding and point-in-time universe snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewise.functions import sliding as SL
from tapewise.functions.exprs import first_reason, is_true, trailing
from tapewise.operators.asof import asof_backward, keep_one, many_to_one
from tapewise.operators.indicators import final_spread, over_asset, with_bar_number, with_bars_since_gap, with_corwin_schultz
from tapewise.operators.panel import first_session_of_period
from tapewise.operators.ranking import with_position
from tapewise.operators.series import add_series, in_series
from tapewise.params import MIN_DELISTED_SHARE, SEED_CATEGORIES, SEED_EXCHANGES, UniverseParams
from tapewise.session import broadcast_rows, staged

SNAPSHOT_COLUMNS = ("ts", "asset_id", "symbol", "eligible", "reason", "adv_usd_60", "adv_rank",
                    "spread_bps_est", "close_raw", "bars_available", "sector", "is_etf")


def lifetime_dollar_volume(bars: DataFrame) -> DataFrame:
    """Greatest dollar volume of an asset's bars, which are raw ones or a panel's."""
    traded = F.col("dollar_volume") if "dollar_volume" in bars.columns else F.col("close") * F.col("volume")
    return bars.groupBy("asset_id").agg(F.max(traded).alias("max_dollar_volume_usd"))


def seed_candidates(tickers: DataFrame, bars: DataFrame, p: UniverseParams) -> DataFrame:
    """Names on an allowed venue and category that once traded enough."""
    names = keep_one(tickers.select("asset_id", "symbol", "exchange", "category"), ["asset_id"], [F.col("symbol")])
    names = names.where(F.col("exchange").isin(*SEED_EXCHANGES) & F.col("category").isin(*SEED_CATEGORIES))
    joined = names.join(lifetime_dollar_volume(bars), "asset_id", "left")
    enough = F.coalesce("max_dollar_volume_usd", F.lit(0.0)) >= p.min_lifetime_dollar_volume
    return joined.where(enough).select("asset_id", "symbol")


def append_new(existing: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected rows whose asset is not listed yet, once each."""
    return keep_one(selected.join(existing.select("asset_id").distinct(), "asset_id", "left_anti"),
                    ["asset_id"], [F.col("symbol")])


def delisted_share(candidates: DataFrame, tickers: DataFrame) -> DataFrame:
    """Share of candidates with a delisting date, 0 for no candidates."""
    j = many_to_one(candidates.select("asset_id"), tickers.select("asset_id", "delisted_date"), ["asset_id"])
    return j.agg(F.count(F.lit(1)).alias("candidates"),
                 F.coalesce(F.avg(F.col("delisted_date").isNotNull().cast("double")), F.lit(0.0)).alias("delisted_share"))


def require_delisted(share: DataFrame, least: float = MIN_DELISTED_SHARE) -> DataFrame:
    """The one row of :func:`delisted_share`; reading it fails below the least share.

    A universe with too few delisted names has survivors only.
    """
    return share.where(F.assert_true(F.col("delisted_share") >= least, F.lit("too few delisted candidates")).isNull())


def last_before(bars: DataFrame, stamps: DataFrame) -> DataFrame:
    """Add ``_last``: the row is its asset's last at or before some stamp, so a look-up at a stamp can find it."""
    points = stamps.agg(F.array_sort(F.collect_list("ts")).alias("_points")).withColumn("_one", F.lit(1))
    slot = F.size(F.filter("_points", lambda t: t < F.col("ts")))  # stamps before the row
    out = bars.withColumn("_one", F.lit(1)).join(F.broadcast(points), "_one").withColumn("_slot", slot)
    following = F.lead("_slot").over(over_asset())
    found = (F.col("_slot") < F.size("_points")) & (following.isNull() | (following != F.col("_slot")))
    return out.withColumn("_last", found).drop("_points", "_one", "_slot")


def panel_metrics(panel: DataFrame, p: UniverseParams, stamps: DataFrame | None = None) -> DataFrame:
    """Liquidity, spread, history and continuity of each asset at each bar; with ``stamps``, of its last bar before each only."""
    df = with_corwin_schultz(with_bars_since_gap(with_bar_number(in_series(panel))), p.spread_window)
    if stamps is not None:
        df = last_before(df, stamps)
    recent = F.max(F.col("is_suspect").cast("int")).over(trailing(over_asset(), p.suspect_lookback))
    df = df.withColumn("suspect_in_lookback", recent == 1)
    df = add_series(df, [lambda m: {"adv_usd_60": SL.median(m["dollar_volume"], p.adv_bars)}], ["dollar_volume"], ["adv_usd_60"])
    if stamps is not None:
        df = df.where("_last").drop("_last")
    return df.withColumn("spread_bps_est", final_spread(F.col("cs_bps"), F.col("adv_usd_60"), p))


METRICS = ["close_raw", "session_index", "adv_usd_60", "spread_bps_est", "bars_available",
           "bars_since_gap", "suspect_in_lookback"]


def snapshot_grid(candidates: DataFrame, stamps: DataFrame) -> DataFrame:
    """One row per (candidate, snapshot session).

    The stamps travel as one array (bounded by the months of the calendar) that
    each candidate row unpacks.
    """
    one = stamps.agg(F.collect_list(F.struct("ts", "session", "session_index")).alias("_stamps")).withColumn("_one", F.lit(1))
    grid = candidates.select("asset_id", "symbol").withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one")
    return grid.select("asset_id", "symbol", F.explode("_stamps").alias("_s")).select(
        "asset_id", "symbol", F.col("_s.ts").alias("ts"), F.col("_s.session").alias("session"),
        F.col("_s.session_index").alias("snapshot_index"))


def eligibility_reason(p: UniverseParams) -> Column:
    """First failing rule, empty when all pass; a missing number fails its rule."""
    def fails(ok: Column) -> Column:
        return ~is_true(ok)

    return first_reason([
        (F.col("bars_available") < p.min_history_bars, "INSUFFICIENT_HISTORY"),
        (~F.col("has_session_at_ts") | F.col("is_delisted"), "STALE_DATA"),
        (F.col("suspect_in_lookback"), "DATA_SUSPECT"),
        (F.col("bars_since_gap") < p.min_bars_since_gap, "DATA_GAP"),
        (fails(F.col("close_raw") >= p.min_price_usd), "LOW_PRICE"),
        (fails(F.col("adv_usd_60") >= p.min_adv_usd), "LOW_LIQUIDITY"),
        (fails(F.col("adv_rank") <= p.size), "NOT_IN_UNIVERSE"),
        (fails(F.col("spread_bps_est") <= p.max_spread_bps), "WIDE_SPREAD"),
    ], F.lit(""))


def liquidity_rank(grid: DataFrame) -> DataFrame:
    """Add ``adv_rank``: 1 is the most liquid at its snapshot, ties by asset. Rows without ADV come last and have none."""
    known = F.col("adv_usd_60").isNotNull()
    order = F.struct((~known).alias("last"), (-F.col("adv_usd_60")).alias("neg"), F.col("asset_id").alias("tie"))
    ranked = with_position(grid.withColumn("_ord", order), ["ts"], "_ord", name="adv_rank").drop("_ord", "group_rows")
    return ranked.withColumn("adv_rank", F.when(known, F.col("adv_rank")).cast("int"))


def build_snapshots(panel: DataFrame, candidates: DataFrame, tickers: DataFrame, calendar: DataFrame,
                    p: UniverseParams, start=None, end=None) -> DataFrame:
    """Every candidate at every snapshot session, eligible or not, with the reason."""
    stamps = first_session_of_period(calendar, p.frequency, start, end)
    grid = snapshot_grid(candidates, stamps)
    meta = keep_one(tickers.select("asset_id", "sector", "is_etf", "delisted_date", "symbol"), ["asset_id"],
                    [F.col("symbol")]).drop("symbol")
    grid = grid.join(meta, "asset_id", "left")
    metrics = staged(panel_metrics(panel, p, stamps).select("asset_id", "ts", *METRICS))  # the as-of join reads it twice
    got = asof_backward(grid, metrics, ["asset_id"], "ts", "ts", METRICS, right_ts_as="panel_ts")
    got = got.where(F.assert_true(F.coalesce(F.col("panel_ts") <= F.col("ts"), F.lit(True)),
                                  F.lit("snapshot used a later bar")).isNull())
    gone = is_true(F.col("delisted_date") <= F.col("session"))
    stale = is_true(F.col("session_index") < F.col("snapshot_index") - p.delisting_grace)
    got = got.withColumns({
        "has_session_at_ts": is_true(F.col("panel_ts") == F.col("ts")),
        "bars_available": F.coalesce("bars_available", F.lit(0)),
        "bars_since_gap": F.coalesce("bars_since_gap", F.lit(0)),
        "suspect_in_lookback": is_true(F.col("suspect_in_lookback")),
        "is_delisted": gone | stale,
        "sector": F.coalesce("sector", F.lit("")),
        "is_etf": is_true(F.col("is_etf")),
    })
    out = liquidity_rank(got).withColumn("reason", eligibility_reason(p))
    return out.withColumn("eligible", F.col("reason") == "").select(*SNAPSHOT_COLUMNS)


def snapshot_at(snapshots: DataFrame, ts) -> DataFrame:
    """The rows of the newest snapshot at or before ``ts``."""
    upto = snapshots.where(F.col("ts") <= F.lit(ts).cast("timestamp"))
    return upto.join(F.broadcast(upto.agg(F.max("ts").alias("ts"))), "ts", "left_semi")


def eligible_by_year(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy(F.year("ts").alias("year")).agg(
        F.sum(F.col("eligible").cast("long")).alias("eligible"))


def rejection_reasons(snapshots: DataFrame) -> DataFrame:
    return snapshots.where(~F.col("eligible") & (F.col("reason") != "")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"))


def ever_eligible(snapshots: DataFrame) -> DataFrame:
    return snapshots.where("eligible").select("asset_id").distinct()


#: Assets up to which their ids are sent to the rows that are restricted.
IDS_SENT = 1_000_000


def restrict_to(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the assets in ``ids``, without a shuffle of ``df`` unless there are very many."""
    return df.join(broadcast_rows(staged(ids.select("asset_id").distinct()), IDS_SENT), "asset_id", "left_semi")


def asset_dimension(candidates: DataFrame, tickers: DataFrame) -> DataFrame:
    """Trading attributes per candidate with their defaults."""
    t = tickers.select("asset_id", "exchange", "sector", "is_etf")
    d = many_to_one(candidates, t, ["asset_id"])
    blank = F.coalesce(F.length(F.trim("sector")) == 0, F.lit(True))
    return d.select(
        "asset_id", "symbol", F.coalesce("exchange", F.lit("NYSE")).alias("exchange"), F.lit("USD").alias("currency"),
        F.when(blank, "OTHER").otherwise(F.col("sector")).alias("cluster"), is_true(F.col("is_etf")).alias("is_etf"),
        F.lit(0.01).alias("tick_size"), F.lit(1.0).alias("step_size"), F.lit(0.0).alias("min_notional_usd"))


def without_cluster(assets: DataFrame, clusters: DataFrame) -> DataFrame:
    """Assets whose cluster has no entry in the cluster table."""
    return assets.join(clusters.select("cluster").distinct(), "cluster", "left_anti")
