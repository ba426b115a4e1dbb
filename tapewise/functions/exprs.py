"""Column helpers shared by the operators.

Missing is NULL throughout: NaN compares greater than every number in Spark and
poisons averages, so sources convert it once with :func:`null_if_nan`.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c: str | Column) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def present(c: str | Column) -> Column:
    """True for a finite number, false (never null) otherwise."""
    c = col(c)
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False))


def is_true(c: Column) -> Column:
    """A comparison against a missing value counts as not satisfied."""
    return F.coalesce(c, F.lit(False))


def strict_greatest(*cs: Column) -> Column:
    """``greatest`` that is NULL when any argument is (Spark skips NULLs)."""
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in cs]), F.greatest(*cs))


def strict_least(*cs: Column) -> Column:
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in cs]), F.least(*cs))


def ratio(num: Column, den: Column) -> Column:
    """Division that yields NULL on a zero denominator."""
    return num / F.when(den != 0, den)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    """The last ``n`` rows including the current one."""
    return w.rowsBetween(-(n - 1), 0)


# Trailing windows are written as SQL text over an ``over`` clause such as
# "PARTITION BY asset_id ORDER BY ts": one parsed expression per column instead of
# dozens of calls into the JVM. ``x`` is the SQL of the value. Each window call is
# marked, so that ``windowed`` can compute equal calls once.

def call_over(agg: str, over: str, frame: str = "") -> str:
    return f"«{agg} OVER ({over} {frame})»"


def windowed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add columns given as SQL with marked window calls, each distinct call once.

    Spark evaluates a window call as often as it is written; here all calls of the
    group are columns of one projection and the formulas use those columns.
    """
    calls: dict[str, str] = {}

    def name(m: re.Match) -> str:
        return calls.setdefault(m.group(1), f"_win{len(calls)}")

    formulas = {k: re.sub("«(.*?)»", name, v) for k, v in columns.items()}
    kept = [c for c in df.columns if c not in columns]
    out = df.selectExpr("*", *[f"{sql} AS {alias}" for sql, alias in calls.items()])
    return out.selectExpr(*[f"`{c}`" for c in kept], *[f"{v} AS {k}" for k, v in formulas.items()])


def column(sql: str) -> Column:
    return F.expr(sql.replace("«", "").replace("»", ""))


def _moving(agg: str, over: str, n: int) -> str:
    """Trailing-window total as a difference of two running totals.

    Spark recomputes a sliding frame for every row; running totals cost a constant
    per row whatever the window, which is what long windows need.
    """
    now = call_over(agg, over, "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    then = call_over(agg, over, f"ROWS BETWEEN UNBOUNDED PRECEDING AND {n} PRECEDING")
    return f"(coalesce({now}, 0) - coalesce({then}, 0))"


def _need(n: int, min_periods: int | None) -> int:
    return n if min_periods is None else min_periods


def rolling(agg: str, x: str, over: str, n: int, min_periods: int | None = None) -> str:
    """Aggregate of the frame itself (an extreme, say); NULL below ``min_periods`` values."""
    frame = call_over(agg, over, f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")
    return f"CASE WHEN {_moving(f'count({x})', over, n)} >= {_need(n, min_periods)} THEN {frame} END"


def rolling_sum(x: str, over: str, n: int, min_periods: int | None = None) -> str:
    return f"CASE WHEN {_moving(f'count({x})', over, n)} >= {_need(n, min_periods)} THEN {_moving(f'sum({x})', over, n)} END"


def rolling_mean(x: str, over: str, n: int, min_periods: int | None = None) -> str:
    c = _moving(f"count({x})", over, n)
    return f"CASE WHEN {c} >= {max(1, _need(n, min_periods))} THEN {_moving(f'sum({x})', over, n)} / {c} END"


def rolling_std(x: str, over: str, n: int, scale: float = 1.0) -> str:
    """Sample deviation of a full frame, of the frame's rows alone. Costs ``n`` for each
    row: for tables of one row per session; assets use :mod:`tapewise.operators.series`."""
    return f"{rolling(f'stddev_samp({x})', x, over, n)} * {scale!r}D"


def first_reason(rules: list[tuple[Column, str]], otherwise: Column | None = None) -> Column:
    """Name of the first rule whose condition holds, in the order given."""
    out = None
    for cond, name in rules:
        cond = is_true(cond)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out if otherwise is None else out.otherwise(otherwise)


def lookup(c: Column, mapping: dict[str, str], otherwise: Column | None = None) -> Column:
    out = None
    for k, v in mapping.items():
        hit = c == k
        out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
    return out if otherwise is None else out.otherwise(otherwise)


# -- decimals ---------------------------------------------------------------

MONEY = T.DecimalType(38, 12)
CENTS = T.DecimalType(20, 2)


def to_decimal(c: str | Column, kind: T.DecimalType = MONEY) -> Column:
    """Exact decimal of the shortest text of a double, never its binary value."""
    return col(c).cast("string").cast(kind)


def to_step(value: Column, step: Column, up: bool) -> Column:
    """Round a non-negative decimal to a multiple of ``step``."""
    n = value / step
    n = F.ceil(n) if up else F.floor(n)
    return F.when((value >= 0) & (step > 0), (n * step).cast(MONEY))


def round_qty(qty: Column, step: Column) -> Column:
    return to_step(qty, step, up=False)


def round_stop(price: Column, tick: Column, is_long: Column) -> Column:
    return F.when(is_long, to_step(price, tick, False)).otherwise(to_step(price, tick, True))


def round_entry(price: Column, tick: Column, is_long: Column) -> Column:
    return F.when(is_long, to_step(price, tick, True)).otherwise(to_step(price, tick, False))


def round_target(price: Column, tick: Column, is_long: Column) -> Column:
    return F.when(is_long, to_step(price, tick, False)).otherwise(to_step(price, tick, True))


def round_cents(amount: Column) -> Column:
    """Round a non-negative amount down to cents; a negative one is refused."""
    return F.when(amount >= 0, (F.floor(amount * 100) / 100).cast(CENTS))


# -- dates and text ---------------------------------------------------------

NEW_YORK = "America/New_York"


def session_close_utc(session: Column, hour: int = 16) -> Column:
    """UTC instant of ``hour`` o'clock New York on a session date."""
    local = F.to_timestamp(F.concat(F.date_format(session, "yyyy-MM-dd"), F.lit(f" {hour:02d}:00:00")))
    return F.to_utc_timestamp(local, NEW_YORK)


def session_of(ts: Column) -> Column:
    """New York calendar date of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(ts, NEW_YORK))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def iso_week_key(ts: Column) -> Column:
    return F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.weekofyear(ts).cast("string"))


def has_code(codes: Column, code: str) -> Column:
    """True when a comma- or pipe-separated code list holds ``code``."""
    parts = F.split(F.regexp_replace(F.coalesce(codes, F.lit("")), ",", "|"), r"\|")
    return F.array_contains(F.transform(parts, lambda p: F.trim(p)), code)


def blank_to(c: Column, fallback: Column) -> Column:
    return F.when(F.length(F.trim(c)) > 0, c).otherwise(fallback)
