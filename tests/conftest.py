from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


STATEMENT = "id string, entity_id string, canonical_id string, prop string, prop_type string, schema string, value string, original_value string, dataset string, origin string, lang string, external boolean, first_seen timestamp_ntz, last_seen timestamp_ntz"


@pytest.fixture(scope="session")
def make_statements(spark):
    """Statements from (id, entity_id, canonical_id, prop, schema, value, dataset, last_seen) rows."""
    from datetime import datetime

    def make(rows, extra: bool = False):
        full = [(i, e, c, p, "string", s, v, None, d, None, None, False, None, datetime.fromisoformat(t) if t else None) for i, e, c, p, s, v, d, t in rows]
        frame = spark.createDataFrame(full, STATEMENT)
        if extra:
            from pyspark.sql import functions as F

            for name in ("name", "trust", "k", "key", "node", "label", "text", "block", "e", "count", "token", "g", "a", "b", "h", "words"):
                frame = frame.withColumn(name, F.lit("clash"))
        return frame

    return make
