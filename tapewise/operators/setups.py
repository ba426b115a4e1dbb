"""Rule-based setups as column expressions.

A strategy is a Python object that hands out conditions and price levels as
columns; all strategies are evaluated in one pass over the feature rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewise.functions.exprs import is_true, present

OPEN_MARKETS = ("RISK_ON", "NEUTRAL")


class _Params:
    @classmethod
    def from_params(cls, params: dict):
        """Build from a plain mapping, refusing unknown names and bad numbers."""
        known = {f.name: f for f in fields(cls)}
        for name, value in params.items():
            if name not in known:
                raise ValueError(f"unknown parameter {name!r} for {cls.strategy_id}; known: {sorted(known)}")
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
                raise ValueError(f"{name}: expected a finite number, got {value!r}")
            if name == "max_hold_bars" and (not isinstance(value, int) or value < 1):
                raise ValueError("max_hold_bars: expected an integer of at least 1")
            if name in ("stop_atr", "target_rr") and value <= 0:
                raise ValueError(f"{name}: must be above 0")
            if name in ("entry_buffer_atr", "min_ema_spread_atr") and value < 0:
                raise ValueError(f"{name}: must not be negative")
        return cls(**params)

    def ready(self) -> Column:
        return F.col("is_warm") & present("close") & present("atr_14") & (F.col("atr_14") > 0)

    def known_before_ranks(self) -> Column:
        """False where no setup can follow, whatever the ranks and the market are."""
        return self.ready() & (self.long_if() | self.short_if())

    def stop(self, sign: int) -> Column:
        return F.col("close") - sign * self.stop_atr * F.col("atr_14")


@dataclass(frozen=True)
class CrossSectionMomentum(_Params):
    strategy_id: ClassVar[str] = "xsec_momentum_v1"
    allowed_markets: ClassVar[tuple[str, ...]] = OPEN_MARKETS
    allowed_regimes: ClassVar[tuple[str, ...]] = ()
    warmup_bars: ClassVar[int] = 273
    xs_threshold: float = 0.90
    exit_xs_threshold: float = 0.70  # accepted, without effect on detection
    stop_atr: float = 5.0
    max_hold_bars: int = 21

    def known_before_ranks(self) -> Column:
        return self.ready() & F.col("eligible")  # only eligible rows have ranks

    def long_if(self) -> Column:
        return self.ready() & (F.col("mom_252_xs_pct") >= self.xs_threshold)

    def short_if(self) -> Column:
        return self.ready() & (F.col("mom_252_xs_pct") <= 1.0 - self.xs_threshold)

    def target(self, sign: int) -> Column:
        return F.lit(None).cast("double")


@dataclass(frozen=True)
class ChannelBreakout(_Params):
    strategy_id: ClassVar[str] = "donchian_breakout_v1"
    allowed_markets: ClassVar[tuple[str, ...]] = OPEN_MARKETS
    allowed_regimes: ClassVar[tuple[str, ...]] = ("TREND_UP", "TREND_DOWN")
    warmup_bars: ClassVar[int] = 260
    entry_buffer_atr: float = 0.10
    stop_atr: float = 3.0
    target_rr: float = 2.0
    max_hold_bars: int = 40
    min_ema_spread_atr: float = 0.20

    def _broke(self, sign: int, edge: str, name: str) -> Column:
        level = F.col(edge) + sign * self.entry_buffer_atr * F.col("atr_14")
        return (self.ready() & (F.col("regime") == name) & (sign * F.col("ema_spread_atr") >= self.min_ema_spread_atr)
                & (sign * F.col("close") > sign * level))

    def long_if(self) -> Column:
        return self._broke(1, "donchian_high_55", "TREND_UP")

    def short_if(self) -> Column:
        return self._broke(-1, "donchian_low_55", "TREND_DOWN")

    def target(self, sign: int) -> Column:
        return F.col("close") + sign * self.target_rr * self.stop_atr * F.col("atr_14")


REGISTRY = {c.strategy_id: c for c in (CrossSectionMomentum, ChannelBreakout)}


def make_strategy(strategy_id: str, params: dict | None = None):
    if strategy_id not in REGISTRY:
        raise ValueError(f"unknown strategy {strategy_id!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[strategy_id].from_params(params or {})


def market_allows(s) -> Column:
    return is_true(F.col("market_regime").isin(*s.allowed_markets))


def regime_allows(s) -> Column:
    """An empty set of asset regimes allows any."""
    return is_true(F.col("regime").isin(*s.allowed_regimes)) if s.allowed_regimes else F.lit(True)


def may_set_up(strategies: list) -> Column:
    """Condition on an asset's own feature columns that holds on every row where a strategy can have a setup."""
    out = F.lit(False)
    for s in strategies:
        out = out | is_true(s.known_before_ranks() & regime_allows(s))
    return F.col("is_warm") & out


def setup_of(s) -> Column:
    """The strategy's setup on a feature row as a struct, NULL when there is none."""
    def side(sign: int, name: str) -> Column:
        return F.struct(
            F.lit(s.strategy_id).alias("strategy_id"), F.lit(name).alias("direction"), F.lit(sign).alias("sign"),
            F.col("close").alias("reference_price"), s.stop(sign).alias("stop_price"),
            s.target(sign).alias("target_price"), F.lit(s.max_hold_bars).alias("max_hold_bars"))
    return F.when(is_true(s.long_if()), side(1, "LONG")).when(is_true(s.short_if()), side(-1, "SHORT"))


def valid_setup() -> Column:
    """Stop on the losing side, target on the winning side, finite positive risk."""
    sign, ref = F.col("sign"), F.col("reference_price")
    risk = sign * (ref - F.col("stop_price"))
    gain = sign * (F.col("target_price") - ref)
    return is_true(risk > 0) & (F.col("target_price").isNull() | is_true(gain > 0))


def detect_setups(features: DataFrame, strategies: list, gate_regime: bool = True) -> DataFrame:
    """Feature rows with a valid setup, one row per strategy that fires."""
    found = [F.when(market_allows(s) & regime_allows(s), setup_of(s)) if gate_regime else setup_of(s)
             for s in strategies]
    out = features.where("is_warm").withColumn("_setup", F.explode(F.array_compact(F.array(*found))))
    out = out.select("*", "_setup.*").drop("_setup").where(valid_setup())
    return out.withColumn("risk_per_unit", F.abs(F.col("reference_price") - F.col("stop_price"))).withColumn(
        "reward_per_unit", F.abs(F.col("target_price") - F.col("reference_price"))).withColumn(
        "reward_risk_ratio", F.col("reward_per_unit") / F.col("risk_per_unit"))
