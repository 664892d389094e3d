"""Column functions shared by the log, experiment and network jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_TIME = "yyyy-MM-dd HH:mm:ss,SSS"


def zero_pad(value: Column, width: int) -> Column:
    """Left-pad with zeros; text that is already longer stays whole."""
    text = value.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def log_time(text: Column) -> Column:
    """Timestamp of a log line's leading time; null when it does not parse."""
    return F.try_to_timestamp(text, F.lit(LOG_TIME))


def format_log_time(ts: Column) -> Column:
    return F.date_format(ts, LOG_TIME)


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds with fraction, from whole microseconds."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def duration_seconds(text: Column, trunc: bool = False) -> Column:
    """``H:MM:SS[.ffffff]``, with an optional sign and ``N day(s), `` in front, in seconds.

    ``trunc`` drops the fraction.
    """
    pattern = r"^(?:(-?\d+) days?, )?(-?)(\d+):(\d\d):(\d\d)(\.\d+)?$"

    def part(group: int) -> Column:
        return F.coalesce(F.regexp_extract(text, pattern, group).try_cast("double"), F.lit(0.0))

    fraction = F.lit(0.0) if trunc else part(6)
    inner = part(3) * 3600 + part(4) * 60 + part(5) + fraction
    signed = F.when(F.regexp_extract(text, pattern, 2) == "-", -inner).otherwise(inner)
    return F.when(text.rlike(pattern), part(1) * 86400 + signed)


def option_code(value: Column, options: Sequence[str]) -> Column:
    """0-based position of an option; ``none`` in any case counts as ``None``."""
    normal = F.when(F.lower(value) == "none", F.lit("None")).otherwise(value)
    position = F.array_position(F.array(*[F.lit(o) for o in options]), normal)
    return F.when(position > 0, (position - 1).cast("int"))


def option_name(code: Column, options: Sequence[str]) -> Column:
    """Option for a 1-based code; null outside the list."""
    return F.get(F.array(*[F.lit(o) for o in options]), code.cast("int") - 1)


def after_last(text: Column, separator: str = ":") -> Column:
    return F.substring_index(text, separator, -1)


def topic_colour(topic: Column, n_topics: Column | int) -> Column:
    """Shade of a topic on a 0..255 scale; 255 itself is kept for delivered."""
    n = F.lit(n_topics) if isinstance(n_topics, int) else n_topics
    return (F.bround(F.lit(255.0) / n, 0) * topic).cast("int")


def megabytes(value: Column) -> Column:
    return value / F.lit(1e6)


def port_spec(text: Column) -> tuple[Column, Column]:
    """Switch and port number of ``S<i>-P<j>``."""
    return (F.regexp_extract(text, r"S(\d+)-P(\d+)", 1).try_cast("int"),
            F.regexp_extract(text, r"S(\d+)-P(\d+)", 2).try_cast("int"))


def round_half_even(value: Column, digits: int = 2) -> Column:
    """Round the way numeric Python libraries do: scale, round half to even, scale back."""
    scale = F.lit(float(10 ** digits))
    return F.rint(value * scale) / scale


def rescale_knob(u: Column, high: Column, low: Column | None = None) -> Column:
    """Unit value to an integer knob: ``ceil(u * max)``, or from ``low`` upwards when given."""
    if low is None:
        return F.ceil(u * high).cast("long")
    return F.greatest(low.cast("long"), F.ceil(low + u * (high - low)).cast("long"))
