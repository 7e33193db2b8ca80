import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    entry.ship(spark)
    return spark


@pytest.fixture
def chat(spark):
    """Builds a message table from ``(chat_id, seq, time, user, message)`` rows."""
    import datetime as dt

    from convolens.schema import MESSAGE_SCHEMA

    def build(rows):
        start = dt.datetime(2024, 1, 1)
        full = [
            (c, s, None if t is None else start + dt.timedelta(seconds=t), u, "Text", m)
            for c, s, t, u, m in rows
        ]
        return spark.createDataFrame(full, MESSAGE_SCHEMA)

    return build


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
