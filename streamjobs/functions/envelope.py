"""Rows as JSON inside a schema envelope, the format that table sinks expect."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _type_name(data_type: T.DataType, typed: bool) -> str:
    if not typed:
        return "string"
    known = {T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64",
             T.FloatType: "float", T.DoubleType: "double", T.BooleanType: "boolean"}
    return known.get(type(data_type), "string")


def schema_envelope(df: DataFrame, typed: bool = False, name: str = "value") -> DataFrame:
    """One JSON text per row: the schema of the row, then the row as payload.

    All fields are declared as strings unless ``typed``.
    """
    fields = [{"field": f.name, "type": _type_name(f.dataType, typed), "optional": True}
              for f in df.schema.fields]
    schema = json.dumps({"type": "struct", "optional": False, "version": 1, "fields": fields},
                        separators=(",", ":"))
    return df.select(F.concat(F.lit('{"schema":' + schema + ',"payload":'),
                              F.to_json(F.struct(*df.columns)), F.lit("}")).alias(name))
