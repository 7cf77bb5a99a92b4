import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ledgerscope.session import get_session
    s = get_session("local[4]", app="ledgerscope-tests", shuffle_partitions=4,
                    extra={"spark.driver.memory": "6g"})
    yield s
    s.stop()


def tx_frame(spark, rows, with_label=True):
    """Hand-made transactions: tuples of (id, period, operation, amount, origin,
    ob_before, ob_after, dest, db_before, db_after[, label])."""
    from ledgerscope import schema as S
    from pyspark.sql import types as T
    schema = S.transaction_schema(with_label, id_type=T.LongType(), account_type=T.LongType())
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module", autouse=True)
def nothing_stays_cached():
    """Frames that a module's tests cache go with it: other tests look at what the session keeps."""
    yield
    from pyspark.sql import SparkSession
    session = SparkSession.getActiveSession()
    if session is not None:
        session.catalog.clearCache()
