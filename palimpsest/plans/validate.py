"""Whether new values fit their columns: as native expressions over rows, and in Python for constants."""

from __future__ import annotations

import enum
import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import jsonpaths
from ..functions.scalars import INTEGERS
from ..sources.catalog import ColumnInfo

NOT_NULL, TYPE, ALLOWED, LENGTH = "not_nullable", "type_mismatch", "not_in_allowed_set", "too_long"


def stored(value: Any) -> Any:
    """What is written for a constant: enums their value, nested data JSON text."""
    if isinstance(value, enum.Enum):
        return value.value if isinstance(value.value, (str, int)) else value.name
    if isinstance(value, (list, tuple, dict)):
        return jsonpaths.encode(json.loads(json.dumps(value, default=stored)))
    return value


def _text(value: Any) -> str:
    return ("1" if value else "") if isinstance(value, bool) else str(value)


def static_error(info: ColumnInfo, value: Any) -> str | None:
    if value is None:
        return None if info.nullable else NOT_NULL
    whole = isinstance(value, int) and not isinstance(value, bool) or isinstance(value, str) and re.fullmatch(r"-?[0-9]+", value) is not None
    fits = {
        "integer": whole,
        "decimal": isinstance(value, (int, float)) and not isinstance(value, bool) or isinstance(value, str) and re.fullmatch(r"\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*", value) is not None,
        "boolean": isinstance(value, bool) or value in (0, 1, "0", "1") or (info.native_type or "").lower() == "tinyint(1)" and whole and -128 <= int(value) <= 127,
        "datetime": isinstance(value, (str, int)) and not isinstance(value, bool),
        "json": isinstance(value, str) and jsonpaths.is_valid(value),
    }.get(info.family, True)
    if not fits:
        return TYPE
    if info.allowed is not None:
        members = ([] if _text(value) == "" else _text(value).split(",")) if info.family == "set" else [_text(value)]
        if any(m not in info.allowed for m in members):
            return ALLOWED
    return LENGTH if info.max_length is not None and len(_text(value)) > info.max_length else None


@F.pandas_udf(T.BooleanType())
def is_valid_json(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else jsonpaths.is_valid(x))


def error_of(info: ColumnInfo, c: Column, kind: T.DataType) -> Column:
    """Error code of a new value of type ``kind``, or null: missing, wrong family, not allowed, too long, in this order."""
    text = c.cast("string") if not isinstance(kind, T.BinaryType) else c
    textual = isinstance(kind, T.StringType)
    whole = F.lit(True) if isinstance(kind, INTEGERS) else text.rlike(r"^-?[0-9]+\z") if textual else F.lit(False)
    if info.family == "integer":
        fits = whole
    elif info.family == "decimal":
        fits = text.rlike(r"^\s*[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\s*\z") if textual else F.lit(not isinstance(kind, (T.BooleanType, T.BinaryType)))
    elif info.family == "boolean":
        fits = F.lit(True) if isinstance(kind, T.BooleanType) else text.isin("0", "1")
        if (info.native_type or "").lower() == "tinyint(1)":
            fits = fits | whole & F.coalesce(F.expr("true") & text.try_cast("int").between(-128, 127), F.lit(False))
    elif info.family == "json":
        fits = is_valid_json(text) if textual else F.lit(True)
    else:
        fits = F.lit(True)
    code = F.when(c.isNull(), F.lit(None if info.nullable else NOT_NULL)).when(~F.coalesce(fits, F.lit(False)), TYPE)
    if info.allowed is not None:
        allowed = F.array(*map(F.lit, info.allowed)) if info.allowed else F.array().cast("array<string>")
        bad = (text != "") & (F.size(F.array_except(F.split(text, ","), allowed)) > 0) if info.family == "set" else ~F.array_contains(allowed, text)
        code = code.when(bad, ALLOWED)
    if info.max_length is not None:
        code = code.when(F.char_length(text) > info.max_length, LENGTH)
    return code.otherwise(F.lit(None).cast("string"))
