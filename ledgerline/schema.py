"""Names and types that all modules share."""

from __future__ import annotations

from pyspark.sql import types as T

TRANSACTION = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("amount", T.DoubleType()), T.StructField("label", T.BooleanType())])
EDGE_COLUMNS = ["snapshot_id", "src", "dst", "weight", "amount_trans", "num_trans"]

BLOCKS = [f"{i}{j}" for i in range(3) for j in range(3)]
VALUES = ["amount_trans", "num_trans"]
STATS = ["sum", "mean", "max", "std"]

#: The 90 feature columns in their frozen order: 9 densities, 9 sizes, 72 block statistics.
FEATURES = (
    [f"measure_{b}" for b in BLOCKS]
    + [f"size_{b}" for b in BLOCKS]
    + [f"transaction_{v}_summary_{s}_{b}" for v in VALUES for s in STATS for b in BLOCKS]
)


def missing_features(columns: list[str]) -> list[str]:
    """Feature columns that ``columns`` lacks, in order."""
    return [c for c in FEATURES if c not in set(columns)]


def require_features(columns: list[str]) -> None:
    if lacking := missing_features(columns):
        raise ValueError(f"{len(lacking)} feature columns are missing, among them {lacking[:5]}")
