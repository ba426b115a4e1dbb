"""Walk-forward edge: outcome statistics per bin at each as-of date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewise.functions.exprs import is_true, present
from tapewise.operators.bootstrap import bootstrap_means
from tapewise.operators.ranking import exact_quantiles, split_points
from tapewise.params import EdgeParams

BIN = ["strategy_id", "direction", "vol_bucket"]
STATS = ("n", "mean_r", "std_r", "ev_r_lcb", "mean_bars_held", "win_rate", "avg_win_r", "avg_loss_r",
         "target_rate", "stop_rate", "time_rate", "median_r", "p05_r", "p95_r")
QUANTILES = {"median_r": 0.5, "p05_r": 0.05, "p95_r": 0.95}


def usable_labels(labels: DataFrame) -> DataFrame:
    """Resolved labels with a finite outcome."""
    return labels.where(F.col("resolution_ts").isNotNull() & present("realised_r_gross"))


def normal_lcb(mean: Column, std: Column, n: Column, z: float) -> Column:
    return F.when(n >= 1, mean - z * std / F.sqrt(n))


def _totals(c: Column) -> dict[str, Column]:
    """Mergeable sums of outcomes; ``c`` is a centre that keeps the squares small."""
    r = F.col("realised_r_gross")
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    return {
        "n": F.count(F.lit(1)), "s1": F.sum(r - c), "s2": F.sum((r - c) * (r - c)), "hold": F.sum(F.col("bars_held")),
        "wins": one(r > 0), "losses": one(r < 0),
        "win_r": F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)), "loss_r": F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0)),
        "targets": one(F.col("outcome") == "TARGET"), "stops": one(F.col("outcome") == "STOP"),
        "times": one(F.col("outcome") == "TIME"),
    }


def _statistics(z: float) -> dict[str, Column]:
    n = F.when(F.col("n") > 0, F.col("n"))
    mean = F.col("centre") + F.col("s1") / n
    var = (F.col("s2") - F.col("s1") * F.col("s1") / n) / F.when(F.col("n") > 1, F.col("n") - 1)
    std = F.sqrt(F.when(var.isNotNull(), F.greatest(var, F.lit(0.0))))

    def part(total: str, count: str) -> Column:
        return F.when(n.isNotNull(), F.when(F.col(count) > 0, F.col(total) / F.when(F.col(count) > 0, F.col(count)))
                      .otherwise(0.0))
    return {
        "mean_r": mean, "std_r": std, "ev_r_lcb": normal_lcb(mean, std, F.col("n"), z),
        "mean_bars_held": F.col("hold") / n, "win_rate": F.col("wins") / n,
        "avg_win_r": part("win_r", "wins"), "avg_loss_r": part("loss_r", "losses"),
        "target_rate": F.col("targets") / n, "stop_rate": F.col("stops") / n, "time_rate": F.col("times") / n,
    }


def bin_statistics(labels: DataFrame, keys: list[str] | None = None, p: EdgeParams = EdgeParams()) -> DataFrame:
    """Statistics of all usable labels per bin."""
    keys = keys or BIN
    use = usable_labels(labels)
    centre = use.groupBy(*keys).agg(F.avg("realised_r_gross").alias("centre"))  # one row per bin
    sums = use.join(F.broadcast(centre), keys).groupBy(*keys, "centre").agg(
        *[v.alias(k) for k, v in _totals(F.col("centre")).items()])
    quant = exact_quantiles(use.select(*keys, "realised_r_gross"), keys, "realised_r_gross", QUANTILES)
    return sums.withColumns(_statistics(p.z)).join(F.broadcast(quant), keys).select(*keys, *STATS)


def check_edge_params(p: EdgeParams) -> None:
    if p.grid != "monthly":
        raise ValueError(f"the as-of grid must be 'monthly', got {p.grid!r}")
    if tuple(p.dimensions) != tuple(BIN):
        raise ValueError(f"bin dimensions must be {BIN}, got {list(p.dimensions)}")
    if p.lcb_method not in ("normal", "bootstrap"):
        raise ValueError(f"unknown lcb_method {p.lcb_method!r}")


def _with_slot(labels: DataFrame, grid: DataFrame) -> DataFrame:
    """Index of the first grid point strictly after the resolution, NULL past the end."""
    points = grid.agg(F.array_sort(F.collect_list("as_of")).alias("_grid")).withColumn("_one", F.lit(1))
    out = labels.withColumn("_one", F.lit(1)).join(F.broadcast(points), "_one")
    slot = F.size(F.filter("_grid", lambda g: g <= F.col("resolution_ts")))
    return out.withColumn("slot", F.when(slot < F.size("_grid"), slot)).drop("_grid", "_one")


def prefix_quantiles(use: DataFrame, keys: list[str], slots: DataFrame, value: str, probs: dict[str, float],
                     ranges: int = 256) -> DataFrame:
    """Exact quantiles of the rows with ``slot <= g`` for every grid slot ``g``.

    Rows are merged to (bin, value, slot) counts and cut into value ranges. Range
    totals per slot locate the range of every wanted position, and only the rows
    of those ranges are looked at again, so neither a bin nor a prefix of it is
    ever gathered.
    """
    counts = use.where("slot is not null").groupBy(*keys, value, "slot").agg(F.count(F.lit(1)).alias("copies"))
    splits = split_points(counts, keys, value, ranges)
    counts = counts.join(F.broadcast(splits), keys).withColumn(
        "_range", F.size(F.filter("_splits", lambda s: s < F.col(value)))).drop("_splits")
    # totals per (bin, range) at every slot: bins x ranges x months rows
    per = counts.groupBy(*keys, "_range", "slot").agg(F.sum("copies").alias("_c"))
    dense = per.select(*keys, "_range").distinct().withColumn("_one", F.lit(1)).join(
        F.broadcast(slots.agg(F.array_sort(F.collect_set("slot")).alias("_all")).withColumn("_one", F.lit(1))), "_one"
    ).select(*keys, "_range", F.explode("_all").alias("slot"))
    upto = Window.partitionBy(*keys, "_range").orderBy("slot")
    below = Window.partitionBy(*keys, "slot").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tot = dense.join(per, [*keys, "_range", "slot"], "left").withColumn("_c", F.coalesce("_c", F.lit(0))).withColumn(
        "_cum", F.sum("_c").over(upto)).withColumn("_below", F.coalesce(F.sum("_cum").over(below), F.lit(0))).withColumn(
        "_n", F.sum("_cum").over(Window.partitionBy(*keys, "slot"))).where("_cum > 0")
    h = {k: (F.col("_n") - 1) * F.lit(float(q)) for k, q in probs.items()}
    wanted = F.array(*[f for k in probs for f in (F.floor(h[k]), F.ceil(h[k]))])
    hits = tot.withColumn("_want", F.array_distinct(F.filter(
        wanted, lambda x: (x >= F.col("_below")) & (x < F.col("_below") + F.col("_cum"))))).where("size(_want) > 0")
    hits = hits.select(*keys, "_range", F.col("slot").alias("at"), "_below", "_n", "_want")
    near = counts.join(hits, [*keys, "_range"]).where("slot <= at").groupBy(*keys, "_range", "at", "_below", "_n", "_want", value).agg(
        F.sum("copies").alias("copies"))
    w = Window.partitionBy(*keys, "_range", "at").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_last", F.col("_below") + F.sum("copies").over(w) - 1)
    got = near.withColumn("_k", F.explode(F.filter(
        "_want", lambda x: (x <= F.col("_last")) & (x > F.col("_last") - F.col("copies")))))
    aggs = [F.max("_n").alias("_n")]
    for i, q in enumerate(probs.values()):
        hh = (F.col("_n") - 1) * F.lit(float(q))
        aggs += [F.max(F.when(F.col("_k") == F.floor(hh), F.col(value))).alias(f"_lo{i}"),
                 F.max(F.when(F.col("_k") == F.ceil(hh), F.col(value))).alias(f"_hi{i}")]
    out = got.groupBy(*keys, F.col("at").alias("slot")).agg(*aggs)
    cols = []
    for i, (name, q) in enumerate(probs.items()):
        hh = (F.col("_n") - 1) * F.lit(float(q))
        cols.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (hh - F.floor(hh))).alias(name))
    return out.select(*keys, "slot", *cols)


def build_edge(labels: DataFrame, grid: DataFrame, p: EdgeParams = EdgeParams(), config_hash: str = "",
               snapshot_id: str = "", row_key: Column | None = None) -> DataFrame:
    """One row per (bin, as-of): statistics of the labels resolved strictly before.

    ``grid`` has one ``as_of`` timestamp per month. Labels are reduced to one row
    per (bin, month) before anything is accumulated; early as-of dates get n = 0.
    ``row_key`` is the integer key of a label that seeds its bootstrap weights.
    """
    check_edge_params(p)
    resolved = labels.where(F.col("resolution_ts").isNotNull())
    use = usable_labels(labels)
    centre = use.groupBy(*BIN).agg(F.avg("realised_r_gross").alias("centre"))  # one row per bin
    use = _with_slot(use, grid)
    sums = use.where("slot is not null").join(F.broadcast(centre), BIN).groupBy(*BIN, "slot").agg(
        *[v.alias(k) for k, v in _totals(F.col("centre")).items()])
    slots = grid.select("as_of", (F.row_number().over(Window.orderBy("as_of")) - 1).alias("slot"))  # one row per month
    bins = resolved.select(*BIN).distinct().join(F.broadcast(centre), BIN, "left").withColumn("_one", F.lit(1))
    all_slots = slots.agg(F.collect_list(F.struct("slot", "as_of")).alias("_all")).withColumn("_one", F.lit(1))
    frame = bins.join(F.broadcast(all_slots), "_one").select(*BIN, "centre", F.explode("_all").alias("_s")).select(
        *BIN, "centre", "_s.slot", "_s.as_of")
    w = Window.partitionBy(*BIN).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    cum = frame.join(F.broadcast(sums), [*BIN, "slot"], "left")  # bins x months rows
    for k in _totals(F.lit(0.0)):
        cum = cum.withColumn(k, F.coalesce(F.sum(k).over(w), F.lit(0)))
    stats = cum.withColumns(_statistics(p.z))
    quant = prefix_quantiles(use.select(*BIN, "realised_r_gross", "slot"), BIN, slots, "realised_r_gross", QUANTILES)
    out = stats.join(F.broadcast(quant), [*BIN, "slot"], "left")
    if p.lcb_method == "bootstrap":
        out = _with_bootstrap_lcb(out, use, slots, p, row_key)
    return out.select(*BIN, "as_of", *STATS, F.lit(config_hash).alias("config_hash"),
                      F.lit(snapshot_id).alias("data_snapshot_id"))


def _with_bootstrap_lcb(table: DataFrame, use: DataFrame, slots: DataFrame, p: EdgeParams,
                        row_key: Column | None) -> DataFrame:
    """Replace the bound by a quantile of resampled means, per bin and as-of date.

    A resample of a prefix is the prefix of a resample: weights are summed per
    (bin, month, replicate) and accumulated over the months.
    """
    names = ["asset_id", "setup_ts", *BIN] if "asset_id" in use.columns else use.columns
    key = F.pmod(F.xxhash64(*names), F.lit(2147483629)) if row_key is None else row_key
    sums = bootstrap_means(use.where("slot is not null"), [*BIN, "slot"], F.col("realised_r_gross"),
                           key, p.bootstrap_iterations, p.bootstrap_seed, sums_only=True)
    all_slots = slots.agg(F.collect_list("slot").alias("_all")).withColumn("_one", F.lit(1))
    dense = sums.select(*BIN, "replicate").distinct().withColumn("_one", F.lit(1)).join(
        F.broadcast(all_slots), "_one").select(*BIN, "replicate", F.explode("_all").alias("slot"))
    w = Window.partitionBy(*BIN, "replicate").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    cum = dense.join(sums, [*BIN, "slot", "replicate"], "left").withColumn("_w", F.sum("weight").over(w)).withColumn(
        "_x", F.sum("weighted").over(w)).where("_w > 0").withColumn("_m", F.col("_x") / F.col("_w"))
    q = cum.groupBy(*BIN, "slot").agg(F.percentile("_m", F.lit(p.lcb_quantile)).alias("_lcb"))  # iterations rows per group
    return table.drop("ev_r_lcb").join(F.broadcast(q), [*BIN, "slot"], "left").withColumn(
        "ev_r_lcb", F.when(F.col("n") >= 2, F.col("_lcb"))).drop("_lcb")


def usable_bin(p: EdgeParams = EdgeParams(), prefix: str = "") -> Column:
    """Enough samples, positive spread, every statistic finite."""
    ok = is_true(F.col(f"{prefix}n") >= p.min_samples) & is_true(F.col(f"{prefix}std_r") > 0)
    for c in STATS[1:]:
        ok = ok & present(f"{prefix}{c}")
    return ok


def edge_at(rows: DataFrame, edge: DataFrame, ts: str = "ts") -> DataFrame:
    """Attach the newest bin statistics at or before each row's timestamp.

    The edge table is bins x months long; each row looks up its month slot.
    """
    points = edge.select("as_of").distinct().agg(F.array_sort(F.collect_list("as_of")).alias("_grid")).withColumn(
        "_one", F.lit(1))
    out = rows.withColumn("_one", F.lit(1)).join(F.broadcast(points), "_one", "left")
    at = F.element_at(F.filter("_grid", lambda g: g <= F.col(ts)), -1)
    pick = F.when(F.size(F.filter("_grid", lambda g: g <= F.col(ts))) > 0, at)
    out = out.withColumn("as_of", pick).drop("_grid", "_one")
    stats = edge.select(*BIN, "as_of", *[F.col(c).alias(f"bin_{c}") for c in STATS])
    return out.join(F.broadcast(stats), [*BIN, "as_of"], "left")


def check_provenance(edge: DataFrame, config_hash: str, snapshot_id: str) -> DataFrame:
    """Fail while reading when the table was built for another configuration or snapshot."""
    same = (F.col("config_hash") == config_hash) & (F.col("data_snapshot_id") == snapshot_id)
    return edge.where(F.assert_true(same, F.lit("edge table belongs to another run")).isNull())


def used_bins(decisions: DataFrame) -> DataFrame:
    return decisions.where(F.col("as_of").isNotNull()).select(*BIN, "as_of").distinct()
