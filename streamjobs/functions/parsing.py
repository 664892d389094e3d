"""Turning message text into typed columns. All work on batch and stream alike."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _split(text: Column, separator: str) -> Column:
    return F.split(text, re.escape(separator))


def _cut(text: Column, separator: str) -> Column:
    """The first two parts of ``_split`` by searching bytes from both ends: no pattern, and no copy of the other parts."""
    before, last = F.substring_index(text, separator, 1), F.substring_index(text, separator, -1)
    rest = F.octet_length(text) - F.octet_length(before)
    after = F.substr(text, F.char_length(before) + len(separator) + 1)
    only = rest == F.octet_length(last) + len(separator.encode())
    return F.array(before, F.when(only, last).when(rest > 0, F.substring_index(after, separator, 1)))


_MARK = "\u0001"


def unpack(df: DataFrame, parts: Column, fields: Callable[[Column], Sequence[Column]], keep: Sequence[str] = (),
           when: Callable[[Column], Column] | None = None) -> DataFrame:
    """Compute ``parts`` once per row and make columns of it; rows that fail ``when`` are dropped.

    Plain columns would be copied by the optimizer into every later filter, and
    the text parsed again for each of them. A generator keeps the parsing in
    one place.
    """
    row = F.array(F.struct(*fields(F.col("_parts"))))
    if when is not None:
        row = F.when(when(F.col("_parts")), row)
    return df.select(*keep, parts.alias("_parts")).select(*keep, F.inline(row))


def match_groups(text: Column, pattern: str, n: int) -> Column:
    """All ``n`` groups of a pattern from a single match, as an array after an empty first element.

    Text that does not match gives an array of another size (see ``matched``).
    """
    whole = f"(?s)\\A.*?{pattern}.*\\z" if not pattern.startswith("^") else f"(?s){pattern}.*\\z"
    marked = F.regexp_replace(text, whole, "".join(f"{_MARK}${i}" for i in range(1, n + 1)))
    return F.split(marked, _MARK)


def matched(n: int) -> Callable[[Column], Column]:
    """Whether ``match_groups`` with ``n`` groups found the pattern."""
    return lambda parts: (F.size(parts) == n + 1) & (F.get(parts, F.lit(0)) == "")


def split_tags(df: DataFrame, tags: Sequence[tuple[str, str]], col: str = "value",
               rest: str | None = None, strip: bool = False) -> DataFrame:
    """Peel trailing ``<separator><content>`` tags off a text column.

    ``tags`` are given from the last tag of the text to the first, each as
    (separator, new column). What stands before the first tag remains in
    ``rest`` (``col`` when not given). A missing tag gives null.
    """
    others = [c for c in df.columns if c != col]
    body = rest or col
    peeled = df.select(*others, F.col(col).alias(body))
    for separator, name in tags:
        def pair(parts: Column, name: str = name) -> list[Column]:
            content = F.get(parts, F.lit(1))
            return [F.get(parts, F.lit(0)).alias(body), (F.trim(content) if strip else content).alias(name)]

        kept = [c for c in peeled.columns if c != body]
        peeled = unpack(peeled, _cut(F.col(body), separator), pair, kept)
    return peeled.select(*others, body, *[name for _, name in tags])


def split_positions(df: DataFrame, names: Sequence[str], col: str = "value", sep: str = ",") -> DataFrame:
    """Positional split into string columns; absent positions are null."""
    return unpack(df, _split(F.col(col), sep),
                  lambda parts: [F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(names)])


def parse_delimited(df: DataFrame, schema: T.StructType, col: str = "value", sep: str = ",",
                    keep: Sequence[str] = ()) -> DataFrame:
    """Split by position and cast each part to its field's type; bad text is null."""
    return unpack(df, _split(F.col(col), sep),
                  lambda parts: [F.get(parts, F.lit(i)).try_cast(f.dataType).alias(f.name)
                                 for i, f in enumerate(schema.fields)], keep)


def parse_csv_ddl(df: DataFrame, ddl: str, col: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Parse CSV text by a DDL schema; a field that does not fit is null."""
    names = T.StructType.fromDDL(ddl).names
    return unpack(df, F.from_csv(F.col(col), ddl), lambda row: [row[n].alias(n) for n in names], keep)


def extract_json(df: DataFrame, fields: Sequence[str], col: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Top-level JSON fields as string columns; an absent field is null."""
    return df.select(*keep, F.json_tuple(F.col(col), *fields).alias(*fields))


def decode_fixed_width(df: DataFrame, col: str = "value") -> DataFrame:
    """Two characters producer id, six characters message id, and the length."""
    text = F.col(col)
    return (df.withColumn("prod_id", F.substring(text, 1, 2))
              .withColumn("msg_id", F.substring(text, 3, 6))
              .withColumn("size", F.length(text)))


def file_tag(text: Column) -> Column:
    """The text between the first and second ``File: `` tag, or the whole text without a tag."""
    return F.when(text.contains("File: "), F.get(_split(text, "File: "), F.lit(1))).otherwise(text)


def to_doubles(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Cast columns to double; text that is no number becomes null."""
    return df.withColumns({n: F.col(n).try_cast("double") for n in names})


def drop_blank(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Empty text counts as null; rows with a null in ``names`` are dropped."""
    return df.replace("", None, subset=list(names)).dropna("any", subset=list(names))


def drop_text_none(df: DataFrame, col: str) -> DataFrame:
    """Remove rows whose column holds the word ``None``; nulls stay."""
    return df.filter(F.col(col).isNull() | (F.col(col) != "None"))
