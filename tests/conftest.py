import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from sentrank.session import build_session

    s = build_session(
        "sentrank-tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def alert_rows(spark):
    """Build an alerts frame from short tuples (id, time text, agent, rule, level, decoder)."""
    from pyspark.sql import functions as F

    def make(rows):
        df = spark.createDataFrame(
            rows, "event_id string, t string, agent string, rule_id string, rule_level int, decoder string")
        return df.select("event_id", F.col("t").cast("timestamp_ntz").alias("timestamp"), "agent", "rule_id",
                         "rule_level", "decoder")

    return make
