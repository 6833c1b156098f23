"""A local session; Python workers find the package in this repository."""

import os
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (HERE, os.environ.get("PYTHONPATH")) if x)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def hand(spark, rows, image=0):
    """A hand-written map as (image_id, y, x, v)."""
    return spark.createDataFrame([(image, y, x, v) for y, row in enumerate(rows) for x, v in enumerate(row)], "image_id long, y long, x long, v long")


def as_rows(df, value="v"):
    found = {(r["y"], r["x"]): r[value] for r in df.collect()}
    h, w = max(y for y, _ in found) + 1, max(x for _, x in found) + 1
    return [[found[y, x] for x in range(w)] for y in range(h)]
