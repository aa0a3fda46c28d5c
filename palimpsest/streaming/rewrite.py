"""Rewriting rows of a stream. Only replacements that need no other row are possible here."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Secret
from ..errors import InvalidConfiguration
from ..functions.jsonpaths import JsonPaths
from ..functions.scalars import canonical
from ..operators import jsondoc
from ..operators.keyed import candidates, keyed_column
from ..plans import validate
from ..plans.rules import Expression, Keyed, RuleSet, is_static, resolve


def rewrite_stream(df: DataFrame, rules: RuleSet, key: Secret) -> DataFrame:
    """Pure keyed values, native expressions, constants and JSON paths of these; works on batches as well.

    A namespace that has to stay unique, a random value or a resampled column needs the whole table and is refused.
    """
    new: dict[str, Any] = {}
    for c, given in rules.fields.items():
        d = resolve(given)
        if c in rules.categorical:
            raise InvalidConfiguration(f"{c}: a stream can't be resampled")
        if isinstance(d, Keyed):
            new[c] = keyed_column(key, d.namespace, d.shape, canonical(F.col(c), df.schema[c].dataType, c)).cast(df.schema[c].dataType)
        elif isinstance(d, Expression):
            new[c] = d.fn(F.col(c))
        elif isinstance(d, JsonPaths):
            inner = d.definitions
            if any(not isinstance(x, Keyed) and not is_static(x) for x in inner.values()):
                raise InvalidConfiguration(f"{c}: paths of a stream hold constants or keyed values")
            new[c] = jsondoc.rewrite_column(d, _leaf_rule(inner, key), F.col(c), F.lit(None).cast("map<string,string>"), F.lit(""))["value"]
        elif is_static(d):
            new[c] = F.lit(validate.stored(d)).cast(df.schema[c].dataType)
        else:
            raise InvalidConfiguration(f"{c}: a stream has no identity to draw a random value from")
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def _leaf_rule(inner: Mapping[str, Any], key: Secret) -> jsondoc.Replace:
    def replace(path: str, leaf: Any, mapping: dict[str, str], identity: str) -> Any:
        d = inner[path]
        return candidates(key, d.namespace, d.shape, [jsondoc.leaf_text(leaf)], [0])[0] if isinstance(d, Keyed) else d

    return replace


def start(df: DataFrame, rules: RuleSet, key: Secret, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """``write(batch, epoch)`` gets each rewritten batch; writing one epoch twice must be harmless for exactly-once results."""
    return df.writeStream.foreachBatch(lambda batch, epoch: write(rewrite_stream(batch, rules, key), epoch)).option("checkpointLocation", checkpoint).start()
