"""Validation of a table of run configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The limits a configuration has to keep.
SESSION_TIMEOUT_MS = (6000, 1800000)
REPLICA_LAG_MAX_MS = 30000
COMPRESSIONS = ["None", "gzip", "snappy", "lz4"]
MAX_MESSAGE_RATE = 100.0


def config_violations(df: DataFrame) -> DataFrame:
    """Add ``violations``, the names of the settings that break a rule.

    Looks at those of ``acks``, ``compression``, ``message_rate``,
    ``session_timeout_ms`` and ``replica_max_wait_ms`` that the table has; an
    unset value breaks nothing.
    """
    low, high = SESSION_TIMEOUT_MS
    broken = {
        "acks": lambda c: ~c.isin(0, 1, 2),
        "compression": lambda c: ~c.isin(*COMPRESSIONS),
        "message_rate": lambda c: c > MAX_MESSAGE_RATE,
        "session_timeout_ms": lambda c: ~c.between(low, high),
        "replica_max_wait_ms": lambda c: c >= REPLICA_LAG_MAX_MS,
    }
    named = [F.when(rule(F.col(c)), F.lit(c)) for c, rule in broken.items() if c in df.columns]
    if not named:
        raise ValueError("the table has none of the checked settings")
    return df.withColumn("violations", F.array_compact(F.array(*named)))
