"""Messages that arrive more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def distinct_messages(df: DataFrame, keys: Sequence[str], ts: str | None = None, within: str | None = None) -> DataFrame:
    """One row per message.

    With ``ts`` and ``within`` a stream forgets a message after that time;
    without them the state grows with the number of distinct messages.
    """
    if ts and within:
        return df.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys))
    return df.dropDuplicates(list(keys))
