"""Scalar functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidReplacementValue

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def canonical(c: Column, kind: T.DataType, name: str = "column") -> Column:
    """Text that a keyed value is derived from: integers and strings as they are, booleans as 1 and 0, null as null."""
    if isinstance(kind, T.BooleanType):
        return F.when(c.isNull(), None).otherwise(F.when(c, "1").otherwise("0"))
    if isinstance(kind, (*INTEGERS, T.StringType)):
        return c.cast("string")
    raise InvalidReplacementValue(f"{name}: a keyed value needs an integer, text or boolean input, not {kind.simpleString()}")


def comparison_key(c: Column) -> Column:
    """Texts are compared without regard to case; text that isn't UTF-8 stays apart from all other."""
    text = c.cast("string")
    return F.when(F.is_valid_utf8(text), F.lower(text)).otherwise(F.concat(F.lit("\0bin:"), F.hex(text)))


def canonical_number(c: Column) -> Column:
    """One text for equal numbers of any length ('+05', '5.0' and 5 are '5'), null for what is no plain number."""
    text = c.cast("string")
    pattern = r"^([+-]?)(\d*)(?:\.(\d*))?$"
    whole = F.ltrim(F.regexp_extract(text, pattern, 2), F.lit("0"))
    part = F.rtrim(F.regexp_extract(text, pattern, 3), F.lit("0"))
    digits = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    signed = F.when((F.regexp_extract(text, pattern, 1) == "-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)
    return F.when(text.rlike(r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)\z"), signed)


def tuple_member(c: Column, numeric: bool) -> Column:
    """What a member of a unique tuple is compared by."""
    return F.coalesce(F.concat(F.lit("n:"), canonical_number(c)), F.concat(F.lit("s:"), comparison_key(c))) if numeric else comparison_key(c)


def mask_characters(c: Column, mask: str) -> Column:
    """Letters and numbers become the mask."""
    return F.regexp_replace(c, r"[\p{N}\p{L}]", mask.replace("\\", "\\\\").replace("$", "\\$"))


def printable_key(c: Column, kind: T.DataType) -> Column:
    """Whether an identity may stand in a summary: integers, UUIDs and ULIDs alone."""
    if isinstance(kind, INTEGERS):
        return c.isNotNull()
    return F.coalesce(c.cast("string").rlike(r"(?i)^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9A-HJKMNP-TV-Z]{26})\z"), F.lit(False))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hexadecimal HMAC-SHA256 of a text. The key shows in the plan: for public test keys only."""
    block = key.ljust(64, b"\0")

    def pad(byte: int) -> Column:
        return F.unhex(F.lit(bytes(b ^ byte for b in block).hex()))

    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def attempted(c: Column) -> Column:
    """A struct of the value, v; null where the evaluation fails. Of an expression with Python functions these alone aren't guarded."""
    jvm = SparkSession.active()._jvm
    util = jvm.org.apache.spark.sql.classic.ExpressionUtils
    return Column(util.column(jvm.org.apache.spark.sql.catalyst.expressions.TryEval(util.expression(F.struct(c.alias("v"))._jc))))
