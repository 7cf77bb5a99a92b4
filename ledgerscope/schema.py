"""Transaction data model and fixed parameters."""
from __future__ import annotations

from pyspark.sql import types as T

ID = "id"
PERIOD = "period"
OPERATION = "operation"
AMOUNT = "amount"
ORIGIN = "origin_account"
DEST = "destination_account"
OB_BEFORE = "origin_balance_before"
OB_AFTER = "origin_balance_after"
DB_BEFORE = "destination_balance_before"
DB_AFTER = "destination_balance_after"
LABEL = "fraud_flag"
TARGET = "target"
SPLIT = "split"

RAW_FEATURES = [PERIOD, OPERATION, AMOUNT, OB_BEFORE, OB_AFTER, DB_BEFORE, DB_AFTER]
KEY_COLUMNS = [ID, LABEL, ORIGIN, DEST]

# --- fixed values that must equal the reference's for equal results ---------
EPS = 1e-6                       # ratio denominators
PERIODS_PER_CYCLE = 144          # period_sin / period_cos
TE_SMOOTHING = 50.0              # Bayesian smoothing weight m
TE_COLUMNS = [OPERATION, ORIGIN, DEST]
VAL_PERIOD_CUTOFF = 96
TEST_PERIOD_START = 106
ROLLING_CUTOFFS = [75, 81, 87, 93, 99]
BOUNDED_FOLD_WIDTH = 6
RANDOM_STATE = 42
ROLLING_WINDOWS = (5, 20)
OPERATIONS = ["op_01", "op_02", "op_03", "op_04", "op_05"]
POSITIVE_OPERATION = "op_03"
OPERATION_PRIOR_SHRINK = 0.01
TWO_STAGE_FLOOR_RATIO = 0.05
TWO_STAGE_MIN_SCORE = 1e-8
TWO_STAGE_RANK_WEIGHT = 0.38
RANK_BLEND_WEIGHT = 0.45
PAGERANK_DAMPING = 0.85
PAGERANK_TOL = 1e-6
PAGERANK_MAX_ITER = 50
ISO_TREES = 200
ISO_SAMPLES_PER_TREE = 256
ISO_SUBSAMPLE = 200_000
ISO_FEATURES = [
    "amount",
    "amount_log1p",
    "origin_balance_before",
    "origin_balance_after",
    "destination_balance_before",
    "destination_balance_after",
    "origin_balance_mismatch",
    "dest_balance_mismatch",
    "amount_to_origin_before",
    "amount_to_destination_before",
]
# -----------------------------------------------------------------------------

# Amounts are money: sums and means are taken over exact integer units of
# 10**-AMOUNT_SCALE, so they do not depend on the order in which partitions are
# combined.  ``None`` selects plain double sums.
AMOUNT_SCALE: int | None = 2


def transaction_schema(with_label: bool = True, id_type: T.DataType = T.StringType(),
                       account_type: T.DataType = T.StringType()) -> T.StructType:
    """Explicit schema of the train / test CSVs (no inference)."""
    fields = [
        T.StructField(ID, id_type, False),
        T.StructField(PERIOD, T.IntegerType(), False),
        T.StructField(OPERATION, T.StringType(), True),
        T.StructField(AMOUNT, T.DoubleType(), True),
        T.StructField(ORIGIN, account_type, True),
        T.StructField(OB_BEFORE, T.DoubleType(), True),
        T.StructField(OB_AFTER, T.DoubleType(), True),
        T.StructField(DEST, account_type, True),
        T.StructField(DB_BEFORE, T.DoubleType(), True),
        T.StructField(DB_AFTER, T.DoubleType(), True),
    ]
    if with_label:
        fields.append(T.StructField(LABEL, T.IntegerType(), True))
    return T.StructType(fields)


SUBMISSION_SCHEMA = T.StructType([
    T.StructField(ID, T.StringType(), False),
    T.StructField(TARGET, T.DoubleType(), True),
])
