"""Jobs over experiment tables: plan the runs, audit them, prepare their metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamjobs.operators.experiments import prepare_schedule, prepare_states
from streamjobs.operators.sampling import latin_hypercube
from streamjobs.operators.sets import duplicate_rows, missing_runs, pending_runs

INDEX = "run_index"

# The compression options in the order of their codes.
COMPRESSIONS = ["None", "gzip", "snappy", "lz4"]
COMPRESSION_KNOB = "producer->compression_type"


def knob_schedule(samples: DataFrame, knobs: DataFrame, seed: int, use_min: bool = False, index: str = INDEX,
                  max_knobs: int = 1000) -> DataFrame:
    """One set of settings per row of ``samples``, spread evenly over every knob's range.

    ``knobs`` has a row (knob, min, max) per knob; their number is checked, as
    each becomes a column.
    """
    listed = [(r["knob"], r["min"], r["max"]) for r in knobs.select("knob", "min", "max").limit(max_knobs + 1).collect()]
    if not 0 < len(listed) <= max_knobs:
        raise ValueError(f"{len(listed)} knobs, expected 1 to {max_knobs}")
    named = {COMPRESSION_KNOB: COMPRESSIONS} if any(k == COMPRESSION_KNOB for k, _, _ in listed) else None
    return latin_hypercube(samples, index, listed, seed, use_min, named)


def audit(schedule: DataFrame, results: DataFrame, index: str = INDEX) -> dict[str, DataFrame]:
    """Runs without a result, results without a run, repeated results, and what is still to run; by index."""
    tables = {"missing": missing_runs(schedule, results, index), "unplanned": missing_runs(results, schedule, index),
              "repeated": duplicate_rows(results, index), "pending": pending_runs(schedule, results, index)}
    return {name: table.orderBy(F.col(index).try_cast("long")) for name, table in tables.items()}


def prepare(schedule: DataFrame, states: DataFrame, order: Sequence[str], index: str = INDEX) -> tuple[DataFrame, DataFrame]:
    """Schedule with option codes, and the varying metrics of each run's last row."""
    return (prepare_schedule(schedule, COMPRESSION_KNOB, COMPRESSIONS), prepare_states(states, order, index))


def rows_of(table: DataFrame, wanted: DataFrame, index: str = INDEX) -> DataFrame:
    """The rows of ``table`` whose index occurs in ``wanted``."""
    return table.join(wanted.select(index), index, "left_semi")
