"""Two vendors' bulk tables mapped to the common raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewise.functions.exprs import has_code, lookup
from tapewise.operators.asof import keep_one, next_on_or_after

# Vendor codes and the common names they map to.
ACTION_NAMES = {"split": "SPLIT", "dividend": "DIVIDEND", "spinoff": "SPINOFF", "merger": "MERGER",
                "acquisition": "MERGER", "tickerchangefrom": "TICKER_CHANGE", "tickerchangeto": "TICKER_CHANGE"}
EXCHANGE_NAMES = {"NYSEMKT": "NYSE", "NYSE MKT": "NYSE"}
PRICE_TABLES = ("stocks", "funds", "sep", "sfp")
EARNINGS_CODE = "22"


def text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


# -- vendor A: split-adjusted bulk tables ------------------------------------------

def a_tickers(raw: DataFrame) -> DataFrame:
    """One row per permanent id among the price tables; the first listed row wins.

    ``ord`` numbers the vendor's rows in file order.
    """
    rows = raw.where(F.lower("table").isin(*PRICE_TABLES))
    first = keep_one(rows, ["permaticker"], [F.col("ord")])
    cat = text("category")
    etf = (F.upper(cat) == "ETF") | F.contains(F.lower(cat), F.lit("exchange traded fund"))
    ex = text("exchange")
    return first.select(
        F.col("permaticker").cast("string").alias("asset_id"), F.col("ticker").cast("string").alias("symbol"),
        lookup(ex, EXCHANGE_NAMES, ex).alias("exchange"), cat.alias("category"), text("sector").alias("sector"),
        etf.alias("is_etf"), F.to_date("firstpricedate").alias("listed_date"),
        F.when(F.upper(text("isdelisted")) == "Y", F.to_date("lastpricedate")).alias("delisted_date"),
        F.lit("").alias("delist_reason"))


def unadjust(bars: DataFrame) -> DataFrame:
    """Undo split adjustment with the unadjusted close; unusable rows are dropped."""
    ok = bars.where(F.col("close").isNotNull() & F.col("closeunadj").isNotNull() & (F.col("close") != 0))
    f = F.col("closeunadj") / F.col("close")
    back = F.col("volume") / F.when(F.col("closeunadj") != 0, f)
    return ok.withColumns({"open": F.col("open") * f, "high": F.col("high") * f, "low": F.col("low") * f,
                           "volume": back, "close": F.col("closeunadj")})


def a_bars(stocks: DataFrame, funds: DataFrame, tickers: DataFrame, start: str, end: str) -> DataFrame:
    """Stocks and funds under permanent ids, unadjusted, inside the period."""
    ids = tickers.select("asset_id", F.col("symbol").alias("ticker"))
    rows = unadjust(stocks.unionByName(funds).join(ids, "ticker"))
    return rows.withColumn("session", F.to_date("date")).where(
        F.col("session").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(
        "asset_id", F.col("ticker").alias("symbol"), "session", "open", "high", "low", "close", "volume",
        F.lit(0.0).alias("dividend"), F.lit(1.0).alias("split_ratio"))


def a_actions(raw: DataFrame, tickers: DataFrame, start: str, end: str) -> DataFrame:
    ids = tickers.select("asset_id", F.col("symbol").alias("ticker"))
    kind = lookup(F.lower("action"), ACTION_NAMES)
    rows = raw.join(ids, "ticker").withColumn("action_type", kind).where("action_type is not null").withColumn(
        "ex_date", F.to_date("date")).where(F.col("ex_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    v = F.coalesce(F.col("value").cast("double"), F.lit(0.0))
    t = F.col("action_type")
    return rows.select(
        "asset_id", "ex_date", "action_type",
        F.when(t.isin("SPLIT", "SPINOFF") & (v != 0), v).otherwise(1.0).alias("split_ratio"),
        F.when(t == "DIVIDEND", v).otherwise(0.0).alias("cash_amount"),
        F.when(t.isin("SPLIT", "DIVIDEND"), "").otherwise(text("contraticker")).alias("new_symbol"))


def a_earnings(raw: DataFrame, tickers: DataFrame, start: str, end: str) -> DataFrame:
    ids = tickers.select("asset_id", F.col("symbol").alias("ticker"))
    rows = raw.where(has_code(F.col("eventcodes"), EARNINGS_CODE)).join(ids, "ticker").withColumn(
        "earnings_date", F.to_date("date"))
    return rows.where(F.col("earnings_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(
        "asset_id", "earnings_date", F.lit(True).alias("is_confirmed"), F.lit(None).cast("timestamp").alias("available_ts"),
        F.lit("UNKNOWN").alias("timing"))


# -- vendor B: unadjusted bars with entitlement dates --------------------------------

def b_category(subtype1: Column, subtype2: Column) -> tuple[Column, Column]:
    s1, s2 = F.coalesce(subtype1, F.lit("")), F.coalesce(subtype2, F.lit(""))
    etf = F.contains(s2, F.lit("Exchange Traded Fund")) | (s1 == "Exchange Traded Product")
    common = (s1 == "Equity") & (s2 == "Operating/Holding Company")
    rest = F.when(s2 != "", s2).when(s1 != "", s1).otherwise("UNKNOWN")
    return F.when(etf, "ETF").when(common, "Domestic Common Stock").otherwise(rest), etf


def b_tickers(listed: DataFrame, delisted: DataFrame) -> DataFrame:
    """Both lists together; a name on both counts as listed."""
    both = listed.withColumn("_gone", F.lit(False)).unionByName(delisted.withColumn("_gone", F.lit(True)))
    one = keep_one(both, ["asset_id"], [F.col("_gone"), F.col("symbol")])
    cat, etf = b_category(F.col("subtype1"), F.col("subtype2"))
    ex = text("exchange")
    return one.select(
        "asset_id", text("symbol").alias("symbol"), lookup(ex, EXCHANGE_NAMES, ex).alias("exchange"), cat.alias("category"),
        text("sector").alias("sector"), etf.alias("is_etf"), F.to_date("first_quoted").alias("listed_date"),
        F.when(F.col("_gone"), F.to_date("last_quoted")).alias("delisted_date"),
        F.when(F.col("_gone"), "OTHER").otherwise("").alias("delist_reason"))


def b_bars(raw: DataFrame) -> DataFrame:
    """Daily bars; the close may come under its longer column name."""
    names = {c.lower(): c for c in raw.columns}
    close = F.col(f"`{names['close']}`") if "close" in names else F.col(f"`{names['unadjusted close']}`")
    pick = lambda c, default: F.coalesce(F.col(names[c]).cast("double"), F.lit(default)) if c in names else F.lit(default)
    return raw.select(
        "asset_id", "symbol", F.to_date(names["date"]).alias("session"),
        *[F.col(names[c]).cast("double").alias(c) for c in ("open", "high", "low")], close.cast("double").alias("close"),
        (F.col(names["volume"]).cast("double") if "volume" in names else F.lit(0.0)).alias("volume"),
        pick("dividend", 0.0).alias("dividend"), F.lit(1.0).alias("split_ratio"),
    ).dropna(subset=["open", "high", "low", "close"])


def ex_date_of(rows: DataFrame, calendar: DataFrame, entitlement: str, name: str = "ex_date") -> DataFrame:
    """The first session strictly after an entitlement date."""
    nxt = rows.withColumn("_after", F.date_add(entitlement, 1))
    return next_on_or_after(nxt, calendar, "_after", [("session", name)]).drop("_after")


def b_dividends(bars: DataFrame, calendar: DataFrame, start: str, end: str) -> DataFrame:
    paid = bars.where((F.col("dividend") != 0) & F.col("dividend").isNotNull())
    rows = ex_date_of(paid.select("asset_id", "session", "dividend"), calendar, "session")
    return rows.where(F.col("ex_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(
        "asset_id", "ex_date", F.lit("DIVIDEND").alias("action_type"), F.lit(1.0).alias("split_ratio"),
        F.col("dividend").alias("cash_amount"), F.lit("").alias("new_symbol"))


def split_ratio(raw_ent: Column, raw_ex: Column, cap_ent: Column, cap_ex: Column) -> Column:
    """Split factor: the raw jump without the ordinary return; 1 when undefined."""
    ok = (raw_ex != 0) & (cap_ent != 0) & (raw_ent != 0)
    f = (cap_ex / F.when(cap_ent != 0, cap_ent)) * (raw_ent / F.when(raw_ex != 0, raw_ex))
    return F.coalesce(F.when(ok, f), F.lit(1.0))


def b_splits(flags: DataFrame, raw: DataFrame, capital: DataFrame, calendar: DataFrame, start: str, end: str) -> DataFrame:
    """Splits from capital-event flags on bars that have a following bar."""
    w = Window.partitionBy("asset_id").orderBy("session")
    line = raw.select("asset_id", "session", F.col("close").alias("_r")).join(
        capital.select("asset_id", "session", F.col("close").alias("_c")), ["asset_id", "session"], "left")
    line = line.withColumns({"_next": F.lead("session").over(w), "_rx": F.lead("_r").over(w), "_cx": F.lead("_c").over(w)})
    hit = flags.where((F.col("flag") != 0) & F.col("flag").isNotNull()).select("asset_id", "session").join(
        line.where("_next is not null"), ["asset_id", "session"])
    hit = ex_date_of(hit, calendar, "session")
    return hit.where(F.col("ex_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select(
        "asset_id", "ex_date", F.lit("SPLIT").alias("action_type"),
        split_ratio(F.col("_r"), F.col("_rx"), F.col("_c"), F.col("_cx")).alias("split_ratio"),
        F.lit(0.0).alias("cash_amount"), F.lit("").alias("new_symbol"))
