"""URL filters by pattern rules. DataFrame functions only.

A rule is an action, a host and a path prefix (``*`` in the path stands for any characters). Each rule is indexed
under the rarest of its literal tokens, counted over all urls. The tokens of a url fetch candidate rules from a hash
table held as a constant of the plan, and only those candidates run their regular expressions. No shuffle is needed.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of one table; more rules make more tables, whose best rules meet.
TABLE_RULES = 2_000


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    def tokens(self) -> list[str]:
        """Literal tokens that every fitting url has: host labels, and path segments that the rule closes by ``/``."""
        closed = [s for s in self.path.split("/")[:-1] if s and "*" not in s]
        return [f"h:{x}" for x in self.host.split(".") if x] + [f"p:{x}" for x in closed]

    def regex(self) -> str:
        def quoted(s: str) -> str:
            return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", s)

        return r"(?s)^(?:[^/]*\.)?" + quoted(self.host) + ".*".join(map(quoted, self.path.split("*")))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path. Both empty where the url is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, parts))


def _rarest_tokens(tokens: DataFrame, rules: Sequence[Rule]) -> dict[int, str | None]:
    """Index token of each rule. The counts cover all urls; at most one row per rule token comes back."""
    literal = sorted({t for r in rules for t in r.tokens()})
    counts = {}
    if literal:
        found = tokens.select(F.explode("__tokens").alias("t")).where(F.col("t").isin(literal)).groupBy("t").count()
        counts = {r["t"]: r["count"] for r in found.collect()}
    return {i: min(r.tokens(), key=lambda t: (counts.get(t, 0), t), default=None) for i, r in enumerate(rules)}


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of those names in the input are replaced.

    The longest fitting rule wins, an earlier rule on ties. Where none fits, rule is null and the verdict is
    ``default``. A null url, or one without ``://``, has an empty host and path. Repeated rows are judged alike; an empty
    table gives an empty table. Any number of rules will do, as long as the plan, which holds them, fits the driver.
    """
    host, path = split_url(F.col(url))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(*kept, host.alias("host"), path.alias("path"))
    split = split.withColumn("__tokens", url_tokens(F.col("host"), F.col("path")))
    index = _rarest_tokens(split.select("__tokens"), rules)

    def entry(i: int) -> Column:
        r = rules[i]
        return F.struct(
            F.lit(len(r.text)).alias("size"), F.lit(-i).alias("place"), F.lit(index[i] or "").alias("token"),
            F.lit(r.regex()).alias("regex"), F.lit(r.text).alias("rule"), F.lit(r.action).alias("action"),
        )

    subject = F.concat(F.col("host"), F.col("path"))

    def best_among(part: Sequence[int]) -> Column:
        """The best fitting rule of a part of them, as a struct, or null."""
        nothing = F.filter(F.array(entry(part[0])), lambda e: F.lit(False))
        keyed = [i for i in part if index[i] is not None]
        buckets = max(1, len({index[i] for i in keyed}))
        held: dict[int, list[int]] = {}
        for i in keyed:
            held.setdefault(_slot(index[i], buckets), []).append(i)
        table = F.array(*[F.array(*map(entry, held[b])) if b in held else nothing for b in range(buckets)])
        fetched = F.flatten(F.transform(F.col("__tokens"), lambda t: F.filter(
            F.element_at(table, (F.pmod(F.xxhash64(t), F.lit(buckets)) + 1).cast("int")), lambda e: e["token"] == t)))
        loose = [entry(i) for i in part if index[i] is None]
        candidates = F.concat(fetched, F.array(*loose)) if loose else fetched
        return F.array_max(F.filter(candidates, lambda e: F.regexp_like(subject, e["regex"])))

    if rules:
        parts = [range(at, min(at + TABLE_RULES, len(rules))) for at in range(0, len(rules), TABLE_RULES)]
        found = [best_among(p) for p in parts]
        split = split.withColumn("__best", found[0] if len(found) == 1 else F.array_max(F.array(*found)))
        rule, action = F.col("__best.rule"), F.col("__best.action")
    else:
        rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    return split.select(*kept, "host", "path", rule.alias("rule"), F.coalesce(action, F.lit(default)).alias("verdict"))


def _slot(token: str, buckets: int) -> int:
    """Bucket of a token, by the same function as in the plan."""
    signed = xxhash.xxh64_intdigest(token.encode(), 42)
    return (signed - (1 << 64) if signed >> 63 else signed) % buckets
