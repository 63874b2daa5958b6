import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from precis.session import local_session

    s = local_session(4, "precis-tests", {"spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()


def one(spark, expr, text, schema="t string"):
    """Evaluate a Column function on one literal value."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(text,)], schema)
    return df.select(expr(F.col("t")).alias("r")).first()["r"]
