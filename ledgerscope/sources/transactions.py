"""Transaction sources: CSV reader with a fixed schema, and the adapter that
turns the ``events`` table into transactions (see FIXTURES.md part 2)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from .sinks import path_exists

# Period length of the adapter: 5 hours in microseconds, counted from
# 2024-01-01 00:00:00 (fixed values of the fixture definition).
PERIOD_MICROS = 18_000_000_000
EPOCH_LITERAL = "timestamp_ntz'2024-01-01 00:00:00'"
EVENT_TO_OPERATION = {
    "click": "op_01",
    "view": "op_02",
    "error": "op_03",
    "purchase": "op_04",
    "signup": "op_05",
}


def first_existing(spark: SparkSession, candidates) -> str:
    """A2: the first of the candidate paths that exists; fails when none does."""
    for path in candidates:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"none of these exists: {', '.join(candidates)}")


def read_csv_transactions(spark: SparkSession, path, with_label: bool = True, **key_types) -> DataFrame:
    """Read a train/test CSV (or the first that exists of several) with an explicit
    schema; malformed rows fail the job.  ``key_types`` go to :func:`schema.transaction_schema`."""
    path = path if isinstance(path, str) else first_existing(spark, path)
    return (spark.read.schema(S.transaction_schema(with_label, **key_types))
            .option("header", True).option("mode", "FAILFAST").csv(path))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _operation(event_type: Column) -> Column:
    expr = None
    for ev, op in EVENT_TO_OPERATION.items():
        expr = F.when(event_type == ev, F.lit(op)) if expr is None else expr.when(event_type == ev, F.lit(op))
    return expr


def events_to_transactions(events: DataFrame) -> DataFrame:
    """All transactions (train and test periods) with the label on every row."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    ev = events.select(
        F.col("event_id").alias(S.ID),
        F.floor(F.expr(f"timestampdiff(MICROSECOND, {EPOCH_LITERAL}, ts)") / F.lit(PERIOD_MICROS))
        .cast("int").alias(S.PERIOD),
        F.col("event_type"),
        F.col("value").alias(S.AMOUNT),
        F.col("user_id").alias(S.ORIGIN),
        k.alias(S.DEST),
    )
    ob = ((F.col(S.ORIGIN) * 37 + F.col(S.ID) * 13) % 700 - 50).cast("double")
    db = ((F.col(S.DEST) * 53 + F.col(S.ID) * 7) % 900).cast("double")
    et = F.col("event_type")
    amount = F.col(S.AMOUNT)
    return ev.select(
        S.ID,
        S.PERIOD,
        _operation(et).alias(S.OPERATION),
        S.AMOUNT,
        S.ORIGIN,
        ob.alias(S.OB_BEFORE),
        F.when(et == "error", F.lit(0.0)).when(et == "signup", ob).otherwise(ob - amount).alias(S.OB_AFTER),
        S.DEST,
        db.alias(S.DB_BEFORE),
        F.when(et == "view", db).otherwise(db + amount).alias(S.DB_AFTER),
        F.when((et == "error") & (((amount > 60) & (F.col(S.ID) % 10 < 7)) | (F.col(S.ID) % 20 == 0)), 1)
        .otherwise(0).alias(S.LABEL),
    )


def load_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All adapted transactions, label kept (for derivations that need it)."""
    return events_to_transactions(read_table(spark, sf_dir, "events"))


def load_train_test(spark: SparkSession, sf_dir: str,
                    test_start: int = S.TEST_PERIOD_START) -> tuple[DataFrame, DataFrame]:
    """Train (``period < test_start``, labelled) and test (label dropped)."""
    tx = load_transactions(spark, sf_dir)
    train = tx.filter(F.col(S.PERIOD) < test_start)
    test = tx.filter(F.col(S.PERIOD) >= test_start).drop(S.LABEL)
    return train, test


def sample_ids(test: DataFrame) -> DataFrame:
    """Sample-submission id list of the fixture: test ids except ``id % 97 = 0``,
    plus three ids that are not in test."""
    spark = test.sparkSession
    extra = spark.createDataFrame([(-1,), (-2,), (-3,)], f"{S.ID} bigint")
    return test.select(S.ID).filter(F.col(S.ID) % 97 != 0).unionByName(extra)


def scored_rows(tx: DataFrame) -> DataFrame:
    """Deterministic base-model scores over labelled rows (metrics/fusion fixture)."""
    i = F.col(S.ID)
    y = F.col(S.LABEL)
    p_a = (i * 7919 % 997) / F.lit(2000.0) + 0.3 * y
    p_b = (i * 104729 % 991) / F.lit(2000.0) + 0.2 * y
    p_c = F.least(F.col(S.AMOUNT), F.lit(500.0)) / F.lit(1000.0)
    return tx.select(
        S.ID, S.PERIOD, S.OPERATION, S.LABEL,
        p_a.alias("p_a"), p_b.alias("p_b"), p_c.alias("p_c"),
        (8 * p_a - 4).alias("x"),
    )
