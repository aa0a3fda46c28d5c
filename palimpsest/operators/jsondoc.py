"""Rewriting JSON documents of a column in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidReplacementValue
from ..functions.jsonpaths import INDEX, SURROGATE, JsonPaths
from ..functions.scalars import INTEGERS

RESULT = T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())])
#: Bits of an integer beside its sign.
BITS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}
#: ``replace(path, leaf, mapping, identity)``
Replace = Callable[[str, Any, dict[str, str], str], Any]


def leaf_text(leaf: Any) -> str | None:
    """Canonical text of a leaf, as of a column's value; containers and fractions have none."""
    if leaf is None:
        return None
    if isinstance(leaf, bool):
        return "1" if leaf else "0"
    if isinstance(leaf, (int, str)):
        return str(leaf)
    raise InvalidReplacementValue(f"a keyed value has no canonical text for a {type(leaf).__name__}")


def rewrite_column(paths: JsonPaths, replace: Replace, text: Column, mapping: Column, identity: Column) -> Column:
    """A struct of the new document and, where it can't be rewritten, the error. Untouched documents come back unchanged."""

    @F.pandas_udf(RESULT)
    def rewrite(texts: pd.Series, mappings: pd.Series, identities: pd.Series) -> pd.DataFrame:
        values, errors = [], []
        for t, m, i in zip(texts, mappings, identities):
            known = dict(m) if m is not None else {}
            try:
                values.append(paths.rewrite(t, lambda path, leaf, known=known, i=i: replace(path, leaf, known, i)))
                errors.append(None)
            except InvalidReplacementValue as e:
                values.append(t)
                errors.append(str(e))
        return pd.DataFrame({"value": pd.Series(values, dtype=object), "error": pd.Series(errors, dtype=object)})

    return rewrite(text, mapping, identity)


def constant_column(paths: JsonPaths, constants: Mapping[str, Any], c: Column, kind: T.DataType) -> Column | None:
    """A column of arrays or structs with a constant at every path, as a native expression: nothing is turned into text and back.

    None where that isn't the same as through the text: maps, members whose names differ in case alone, and constants of another
    type than their place, which the text may hold or refuse.
    """
    if not _plain(kind) or not all(_fits(kind, paths.segments[p], v) for p, v in constants.items()):
        return None
    for p, v in constants.items():
        c = _placed(c, kind, paths.segments[p], v)
    return c


def _plain(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _plain(kind.elementType)
    if isinstance(kind, T.StructType):
        names = {f.name.lower() for f in kind.fields}
        return 0 < len(kind.fields) == len(names) and not any(n.startswith("\0") for n in names) and all(_plain(f.dataType) for f in kind.fields)
    return not isinstance(kind, T.MapType)


def _fits(kind: T.DataType, segments: list[str], value: Any) -> bool:
    """Whether all places that the segments may reach are of the value's own type."""
    if segments:
        here, rest = segments[0], segments[1:]
        if isinstance(kind, T.StructType):
            return all(_fits(f.dataType, rest, value) for f in kind.fields if here in ("*", f.name))
        return not (isinstance(kind, T.ArrayType) and (here == "*" or INDEX.fullmatch(here))) or _fits(kind.elementType, rest, value)
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, int):
        return isinstance(kind, INTEGERS) and -(1 << BITS[type(kind)]) <= value < 1 << BITS[type(kind)]
    return type(value) is str and kind == T.StringType() and not SURROGATE.search(value)


def _placed(c: Column, kind: T.DataType, segments: list[str], value: Any) -> Column:
    if not segments:  # nulls stay
        return F.when(c.isNotNull(), F.lit(value).cast(kind))
    here, rest = segments[0], segments[1:]
    if isinstance(kind, T.StructType) and (here == "*" or here in kind.names):
        members = [(_placed(c[f.name], f.dataType, rest, value) if here in ("*", f.name) else c[f.name]).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*members))
    if isinstance(kind, T.ArrayType) and here == "*":
        return F.transform(c, lambda x: _placed(x, kind.elementType, rest, value))
    if isinstance(kind, T.ArrayType) and INDEX.fullmatch(here) and int(here) < 1 << 31:
        return F.transform(c, lambda x, i: F.when(i == int(here), _placed(x, kind.elementType, rest, value)).otherwise(x))
    return c


def leaf_inputs(paths: JsonPaths, wanted: list[str], text: Column) -> Column:
    """Canonical texts of the leaves of the wanted paths, in document order; none for a document that can't be read."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def collect(texts: pd.Series) -> pd.Series:
        def of(t: str | None) -> list[str]:
            out: list[str] = []

            def see(path: str, leaf: Any) -> Any:
                if path in wanted and not isinstance(leaf, (float, list, dict)):
                    out.append(leaf_text(leaf))
                return leaf

            try:
                paths.rewrite(t, see)
            except InvalidReplacementValue:
                return []
            return out

        return texts.map(of)

    return collect(text)
