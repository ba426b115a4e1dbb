import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[8]").appName("tapewise-tests").config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if s.sparkContext.getCheckpointDir() is None:
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    return s


@pytest.fixture(scope="session")
def market(spark):
    """Synthetic calendar, names, bars, actions, panel and benchmark, staged once."""
    from pyspark.sql import functions as F

    from tapewise.operators.panel import build_calendar, processed_panel
    from tapewise.session import staged
    from tapewise.sources import synthetic as SY

    hol = spark.createDataFrame([("2004-01-01",), ("2004-07-05",)], "session string").select(F.to_date("session").alias("session"))
    early = spark.createDataFrame([("2004-11-26",)], "session string").select(F.to_date("session").alias("session"))
    cal = staged(build_calendar(spark, "2004-01-01", "2005-12-30", hol, early))
    names = SY.tickers(spark, 10, 2)
    planted = {"hole": (SY.asset_id(4), 52, 58), "split": (SY.asset_id(7), 75, 2.0), "dividend": (SY.asset_id(1), 33, 0.4)}
    bars = staged(SY.bars(names, cal, holes=[planted["hole"]], splits=[planted["split"]]))
    acts = SY.actions(cal, [planted["split"]], [planted["dividend"]])
    panel = staged(processed_panel(bars, acts, cal, keep=("session",)))
    bench = staged(panel.groupBy("ts", "session_index").agg(
        *[F.avg(c).alias(c) for c in ("open", "high", "low", "close")], F.lit(20.0).alias("vix_close")))
    return {"calendar": cal, "names": names, "bars": bars, "actions": acts, "panel": panel, "bench": bench,
            "earnings": SY.earnings(names, cal), "planted": planted}
