"""A run: guards, boot probes, one plan per target, the cut at the first bad chunk, writing and reporting."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import replace
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EngineConfig, ProgressEvent, RunOptions, Secret, assert_environment
from ..errors import InvalidReplacementValue, PalimpsestError
from ..functions.jsonpaths import JsonPaths
from ..functions.prng import Mersenne, cell_seed
from ..functions.scalars import attempted, canonical
from ..functions.shapes import Shape
from ..operators import jsondoc, relational
from ..operators.keyed import candidates, keyed_column, unique_mapping
from ..operators.unique import random_column, redraw_until_unique
from ..sources.catalog import SchemaCatalog, Spelling
from ..sources.tables import durable, scratch
from . import guards, validate
from .identity import Identity, chunk_of, resolve_identity, with_position
from .report import COMMITTED, DRY_RUN, ROLLED_BACK, ChunkReport, RunReport, TargetReport
from .rules import Expression, Generator, Keyed, PerRow, RuleSet, Target, deterministic, is_static, keyed_of, resolve

Sink = Callable[[str, DataFrame], None]
#: Columns that JSON paths rewrite as documents and turn back.
NESTED = (T.ArrayType, T.StructType, T.MapType)


def readable(text: Column) -> Column:
    """A text that Python can be given; null where its bytes are no UTF-8."""
    return F.when(F.is_valid_utf8(text), text)


def unreadable(text: Column) -> Column:
    return F.when(~F.is_valid_utf8(text), "the value is not valid UTF-8")


class Engine:
    """``frames`` maps table names to their data; ``sink(table, snapshot)`` stores what a run has made of a table."""

    def __init__(self, spark: SparkSession, config: EngineConfig, catalog: SchemaCatalog, frames: Mapping[str, DataFrame], sink: Sink | None = None, checks: guards.Guards = guards.Guards()) -> None:
        self.spark, self.config, self.catalog, self.sink, self.checks = spark, config, catalog, sink, checks
        self.frames = dict(frames)

    def targets(self, options: RunOptions) -> list[Target]:
        """Models first, then tables; a choice of targets is one of models."""
        by_name = self.config.sanitizers
        ruled = {name: by_name.get(f"{name.rpartition('.')[2]}Sanitizer") if rules is None else rules for name, rules in self.config.models.items()}
        models = [Target(name, (rules.table if isinstance(rules, RuleSet) else None) or name, rules, rules.key_name if isinstance(rules, RuleSet) else None) for name, rules in ruled.items()]
        if options.targets is not None:
            return [t for t in models if t.label in options.targets]
        return models + [Target(f"table:{name}", name, rules) for name, rules in self.config.tables.items()]

    def run(self, options: RunOptions = RunOptions()) -> RunReport:
        """Intermediate tables, which hold old values, are deleted when the run ends; the new snapshots of ``frames`` stay."""
        with scratch(self.spark) as kept:
            return self._run(options, kept)

    def _spelled(self, t: Target) -> Target:
        if not isinstance(t.rules, RuleSet) or t.table not in self.catalog.tables:
            return t
        names = Spelling(self.catalog.tables[t.table].columns)
        return replace(t, rules=t.rules.spelled(names), key_name=t.key_name and names.one(t.key_name))

    def _run(self, options: RunOptions, kept: list[str]) -> RunReport:
        assert_environment(self.config, options)
        targets = self.targets(options)
        self.checks.targets(self.config.models, self.config.tables, targets)
        targets = [self._spelled(t) for t in targets]
        ruled = [t for t in targets if t.rules is not None]
        for t in ruled:
            self.checks.schema(t, t.rules, self.catalog)
            self.checks.quality(t, t.rules, self.catalog)
        groups = self.checks.mirrors(ruled, self.catalog)
        spaces = self.checks.namespaces(ruled)
        self.key = self.config.secret() if spaces else Secret(b"")
        self.run_seed = Secret(self.config.run_seed or os.urandom(32))
        for t in ruled:
            for column, _, _ in keyed_of(t.rules):
                if not isinstance(t.rules.fields[column], JsonPaths) and column not in t.rules.codecs:
                    canonical(F.col(column), self.frames[t.table].schema[column].dataType, f"{t.label}: {column}")
        identities = {t.label: resolve_identity(self.frames[t.table], t, t.rules, self.catalog.tables[t.table]) for t in ruled}
        placed = {t.label: with_position(self.frames[t.table], identities[t.label].columns, "__row") for t in ruled}
        mappings = {ns: self._mapping(d, ruled, placed) for ns, d in spaces.items() if self._unique_bound(ns, ruled)}
        report, begun = RunReport(options.dry_run), dict(self.frames)
        for t in targets:
            if report.failed:
                report.not_attempted.append(t.label)
            elif t.rules is None:
                report.targets.append(TargetReport(t.label, t.table, skipped="no-sanitizer"))
            else:
                if self.frames[t.table] is not begun[t.table]:  # an earlier target has rewritten this table
                    placed[t.label] = with_position(self.frames[t.table], identities[t.label].columns, "__row")
                one = self._run_target(t, t.rules, identities[t.label], placed[t.label], mappings, options, kept)
                one.fk_enforcement = not any(t.table == table for g in groups for table, _ in g) or options.dry_run
                report.targets.append(one)
        return report

    # -- namespaces ----------------------------------------------------------------------------------------------------

    def _unique_bound(self, namespace: str, targets: list[Target]) -> bool:
        return any(
            path is None and d.namespace == namespace and any(column in u for u in self.catalog.tables[t.table].constraints())
            for t in targets for column, path, d in keyed_of(t.rules)
        )

    def _mapping(self, definition: Keyed, targets: list[Target], placed: Mapping[str, DataFrame]) -> DataFrame:
        """Inputs of a namespace by the place they are first seen at, resolved to outputs that no original has."""
        inputs, originals = [], []
        for index, t in enumerate(targets):
            for order, (column, path, d) in enumerate(keyed_of(t.rules)):
                if d.namespace != definition.namespace:
                    continue
                frame, kind = placed[t.label], placed[t.label].schema[column].dataType
                old = self._decoded(t.rules, column)
                if path is None:
                    found = frame.select(readable(canonical(old, kind)).alias("canonical"), F.lit(0).alias("element"), "__row")
                    if any(column in u for u in self.catalog.tables[t.table].constraints()):
                        originals.append((frame, column))
                else:
                    leaves = jsondoc.leaf_inputs(t.rules.fields[column], [path], readable(self._document(old, kind)))
                    found = frame.select(F.posexplode(leaves).alias("element", "canonical"), "__row")
                rank = F.struct(F.lit(index).alias("target"), F.col("__row").alias("row"), F.lit(order).alias("field"), F.col("element").alias("element"))
                inputs.append(found.where("canonical is not null").select("canonical", rank.alias("rank")))
        merged = reduce(DataFrame.unionByName, inputs).groupBy("canonical").agg(F.min("rank").alias("rank"))
        return durable(unique_mapping(merged, relational.forbidden_originals(originals), self.key, definition.namespace, definition.shape))

    # -- one target ----------------------------------------------------------------------------------------------------

    @staticmethod
    def _decoded(rules: RuleSet, column: str) -> Column:
        """The value that rules read; null where a codec fails, which is an error of the row."""
        return attempted(rules.codecs[column].decode(F.col(column)))["v"] if column in rules.codecs else F.col(column)

    @staticmethod
    def _document(old: Column, kind: T.DataType) -> Column:
        """Text of a document, which nested columns are too."""
        return F.to_json(old, {"ignoreNullFields": "false"}) if isinstance(kind, NESTED) else old.cast("string")

    def _run_target(self, t: Target, rules: RuleSet, identity: Identity, frame: DataFrame, mappings: Mapping[str, DataFrame], options: RunOptions, kept: list[str]) -> TargetReport:
        columns = self.frames[t.table].columns
        rows = frame.count()
        size = self.config.chunk.size_for(rows, options.chunk_size)
        report = TargetReport(t.label, t.table, rows, size, -(-rows // size), status=DRY_RUN if options.dry_run else COMMITTED)
        self._tell(options, t, None, report, 0)
        names = list(rules.fields)
        place = {c: i for i, c in enumerate(names)}
        made = self._planned(t, rules, identity, frame, mappings)
        # the old values of rewritten columns aren't written
        out = [F.col(f"__new{place[c]}").alias(c) if c in place else F.col(c) for c in columns]
        planned = durable(made.select(*out, "__row", chunk_of(F.col("__row"), size).alias("__chunk"), "__error", *(f"__changed{i}" for i in range(len(names)))))
        first_bad = planned.where("__error is not null").agg(F.min(F.struct("__chunk", "__row", "__error")).alias("e")).first()["e"]
        cut = first_bad["__chunk"] if first_bad else None
        attempted_rows = planned if cut is None else planned.where(F.col("__chunk") <= cut)
        bounds = relational.chunk_bounds(attempted_rows, "__chunk", identity.columns)
        report.chunk_rows = durable(bounds.select(F.col("__chunk").alias("chunk"), "n_rows", "first", "last"))
        kept.append(report.chunk_rows._palimpsest_path)
        report.attempted = report.expected_chunks if cut is None else cut
        report.done_rows = rows if cut is None else (cut - 1) * size
        if cut is not None:
            b = report.chunk_rows.where(F.col("chunk") == cut).first()
            report.failed_chunk = ChunkReport(cut, b["n_rows"], b["first"].asDict(), b["last"].asDict(), ROLLED_BACK, first_bad["__error"])
        if options.on_progress:  # one event at a time: the driver never holds them all
            told = 0
            for b in report.chunk_rows.orderBy("chunk").toLocalIterator():
                told += b["n_rows"]
                self._tell(options, t, b["chunk"], report, told)
        good = planned if cut is None else planned.where(F.col("__chunk") < cut)
        report.changed = good.agg(*[F.count_if(f"__changed{i}").alias(c) for i, c in enumerate(names)]).first().asDict()
        if not options.dry_run and (cut is None or cut > 1):
            snapshot = good.select(*columns)
            kept.append(planned._palimpsest_path)
            if cut is not None:  # that chunk and later ones are as they were
                snapshot = snapshot.unionByName(frame.where(F.col("__row") >= (cut - 1) * size).select(*columns))
                kept.append(frame._palimpsest_path)
            self.frames[t.table] = snapshot
            if self.sink:
                self.sink(t.table, snapshot)
        return report

    @staticmethod
    def _tell(options: RunOptions, t: Target, chunk: int | None, report: TargetReport, rows: int) -> None:
        if options.on_progress:
            options.on_progress(ProgressEvent(t.label, chunk, report.expected_chunks, rows))

    def _planned(self, t: Target, rules: RuleSet, identity: Identity, frame: DataFrame, mappings: Mapping[str, DataFrame]) -> DataFrame:
        """``frame`` with __new, __changed of each field, and __error, the first of its row."""
        info = self.catalog.tables[t.table]
        names = list(rules.fields)
        frame = frame.withColumn("__id", F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity.columns]))
        frame = self._with_mappings(rules, frame, mappings)
        frame = frame.withColumn("__attempt", F.lit(0))
        frame, fails = self._resolve_unique(t, rules, frame)
        errors: list[Column] = [fails] if fails is not None else []
        made = self._with_values(t, rules, frame, names)
        for i, c in enumerate(names):
            kind = frame.schema[c].dataType
            value, raw_kind = F.col(f"__value{i}"), made.schema[f"__value{i}"].dataType
            code = validate.error_of(info.columns[c], value, raw_kind)
            as_text = isinstance(kind, NESTED) and self._in_place(t, rules, c, kind) is None
            if c in rules.codecs:
                encoded = attempted(rules.codecs[c].encode(value).cast(kind))
                new = encoded["v"]
                unread = F.col(c).isNotNull() & attempted(rules.codecs[c].decode(F.col(c))).isNull()
                checks = [F.when(unread, "the codec can't decode the stored value (message withheld)"), F.col(f"__broken{i}"), F.when(encoded.isNull(), "the codec can't encode the new value (message withheld)")]
            elif as_text:
                same = value.eqNullSafe(self._document(F.col(c), kind))
                new = F.when(same, F.col(c)).otherwise(attempted(F.from_json(value, kind, {"mode": "FAILFAST"}))["v"])
                checks = [F.col(f"__broken{i}"), F.when(value.isNotNull() & new.isNull(), validate.TYPE)]
            elif isinstance(kind, NESTED):
                new, checks = value, [F.col(f"__broken{i}")]
            else:
                new = value if raw_kind == kind else value.try_cast(kind) if isinstance(raw_kind, T.StringType) else value.cast(kind)
                checks = [F.col(f"__broken{i}"), code, F.when(value.isNotNull() & new.isNull(), validate.TYPE)]
            errors += [F.concat(F.lit(f"{c}: "), x) for x in checks]
            old = self._decoded(rules, c)
            if as_text:
                old, raw_kind = self._document(old, kind), T.StringType()
            changed = ~value.eqNullSafe(old.cast(raw_kind)) if c in rules.codecs or as_text else ~new.eqNullSafe(F.col(c))
            made = made.withColumns({f"__new{i}": new, f"__changed{i}": changed})
        return made.withColumn("__error", F.coalesce(*errors, F.lit(None).cast("string")))

    def _with_mappings(self, rules: RuleSet, frame: DataFrame, mappings: Mapping[str, DataFrame]) -> DataFrame:
        """Outputs of unique-bound namespaces: __m of flat columns, __j maps of documents."""
        for i, (c, d) in enumerate(rules.fields.items()):
            if isinstance(d, Keyed) and d.namespace in mappings:
                m = mappings[d.namespace].select(F.col("canonical").alias("__c"), F.col("output").alias(f"__m{i}"))
                own = canonical(self._decoded(rules, c), frame.schema[c].dataType)
                frame = frame.join(m, own == F.col("__c"), "left").drop("__c")
            if isinstance(d, JsonPaths):
                bound = [(p, x) for p, x in d.definitions.items() if isinstance(x, Keyed) and x.namespace in mappings]
                if bound:
                    parts = []
                    for p, x in bound:
                        leaves = frame.select("__row", F.explode(jsondoc.leaf_inputs(d, [p], readable(self._document(self._decoded(rules, c), frame.schema[c].dataType)))).alias("canonical"))
                        parts.append(leaves.distinct().join(mappings[x.namespace], "canonical").select("__row", F.concat(F.lit(x.namespace + "\x1f"), "canonical").alias("k"), "output"))
                    pairs = reduce(DataFrame.unionByName, parts).where("output is not null").distinct()
                    maps = pairs.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("k", "output"))).alias(f"__j{i}"))
                    frame = frame.join(maps, "__row", "left")
                else:
                    frame = frame.withColumn(f"__j{i}", F.lit(None).cast("map<string,string>"))
        return frame

    def _resolve_unique(self, t: Target, rules: RuleSet, frame: DataFrame) -> tuple[DataFrame, Column | None]:
        """Attempts at which random values of unique tuples collide with nothing."""
        info = self.catalog.tables[t.table]
        touched = [u for u in info.constraints() if set(u) & set(rules.fields)]
        # one flat keyed column of its own is unique by its mapping
        touched = [u for u in touched if not (len(u) == 1 and isinstance(rules.fields[u[0]], Keyed))]
        if not touched:
            return frame, None
        members = [c for c in rules.fields if any(c in u for u in touched)]
        numeric = {c: info.columns[c].family in ("integer", "decimal", "boolean") for u in touched for c in u}
        names = list(rules.fields)
        new = {c: f"__value{names.index(c)}" for c in members}
        retry = any(not deterministic(rules.fields[c]) or c in rules.categorical for c in members)
        keep = frame.select("*")
        found = redraw_until_unique(keep, frame, touched, numeric, new, lambda df: self._with_values(t, rules, df, members), retry)
        found = durable(found).select(F.col("__row").alias("__r"), F.col("__attempt").alias("__a"), "__fails")
        frame = frame.drop("__attempt").join(found, F.col("__row") == F.col("__r"), "left").withColumn("__attempt", F.coalesce("__a", F.lit(0))).drop("__r", "__a")
        why = "no free value was found" if retry else "keyed or constant values collide"
        return frame, F.when(F.col("__fails"), f"{', '.join(touched[-1])}: unique: {why}")

    def _with_values(self, t: Target, rules: RuleSet, frame: DataFrame, wanted: list[str]) -> DataFrame:
        """__value and __broken (an error or null) of the wanted fields, for the attempt in __attempt."""
        names, out = list(rules.fields), {}
        for c in wanted:
            i = names.index(c)
            value, broken = self._value(t, rules, frame, i, c)
            out[f"__pair{i}"] = F.struct(value.alias("v"), broken.alias("e"))
        made = frame.withColumns(out)
        more = {f"__value{names.index(c)}": F.col(f"__pair{names.index(c)}.v") for c in wanted} | {f"__broken{names.index(c)}": F.col(f"__pair{names.index(c)}.e") for c in wanted}
        return made.withColumns(more).drop(*out)

    def _value(self, t: Target, rules: RuleSet, frame: DataFrame, i: int, c: str) -> tuple[Column, Column]:
        definition, fine = resolve(rules.fields[c]), F.lit(None).cast("string")
        kind, old = frame.schema[c].dataType, self._decoded(rules, c)
        if c in rules.categorical:
            profile = relational.bounded_profile(self.frames[t.table], c)
            if profile:
                total = sum(n for _, n in profile)
                seed = cell_seed(self.run_seed.reveal(), t.label, c)
                r = F.pmod(F.xxhash64(F.lit(seed), F.col("__id"), F.col("__attempt")), F.lit(total)) + 1
                return relational.weighted_pick(r, profile, kind), fine
        if isinstance(definition, Keyed):
            text = canonical(old, kind, f"{t.label}: {c}")
            if f"__m{i}" in frame.columns:
                return F.col(f"__m{i}"), F.coalesce(unreadable(text), F.when(text.isNotNull() & F.col(f"__m{i}").isNull(), f"the namespace {definition.namespace} has no free value"))
            return keyed_column(self.key, definition.namespace, definition.shape, readable(text)), unreadable(text)
        if isinstance(definition, Shape):
            fills = isinstance(definition, Generator)
            text = old.cast("string") if fills else canonical(old, kind, f"{t.label}: {c}")
            return random_column(self.run_seed, t.label, c, definition, readable(text), F.col("__id"), F.col("__attempt"), fills), unreadable(text)
        if isinstance(definition, JsonPaths):
            in_place = self._in_place(t, rules, c, kind)
            if in_place is not None:
                return in_place, fine
            text = self._document(old, kind)
            done = jsondoc.rewrite_column(definition, self._leaf_rule(t, c, definition), readable(text), F.col(f"__j{i}"), F.col("__id"))
            return done["value"], F.coalesce(unreadable(text), done["error"])
        if isinstance(definition, Expression):
            done = attempted(definition.fn(old))
            return done["v"], F.when(done.isNull(), "the expression fails (message withheld)")
        if isinstance(definition, PerRow):
            done = self._per_row(definition, frame, old)
            return done["value"], done["error"]
        value = validate.stored(definition)
        return F.lit(value) if value is not None else F.lit(None).cast(kind), fine

    def _in_place(self, t: Target, rules: RuleSet, c: str, kind: T.DataType) -> Column | None:
        """A nested column with constants at its paths as a native expression; None where its text has to be rewritten."""
        paths = resolve(rules.fields[c])
        if not isinstance(paths, JsonPaths) or not isinstance(kind, NESTED) or c in rules.codecs or c in rules.categorical or any(c in u for u in self.catalog.tables[t.table].constraints()):
            return None
        if not all(map(is_static, paths.definitions.values())):
            return None
        return jsondoc.constant_column(paths, {p: self._constant(resolve(d)) for p, d in paths.definitions.items()}, F.col(c), kind)

    @staticmethod
    def _constant(d: Any) -> Any:
        return d.value if hasattr(d, "value") and hasattr(d, "name") else d

    def _leaf_rule(self, t: Target, column: str, paths: JsonPaths) -> jsondoc.Replace:
        key, run_seed, label, constant = self.key, self.run_seed, t.label, self._constant
        definitions = {p: resolve(d) for p, d in paths.definitions.items()}
        constants = {p for p, d in paths.definitions.items() if is_static(d)}

        def new_leaf(path: str, leaf: Any, mapping: dict[str, str], identity: str) -> Any:
            d = definitions[path]
            if path in constants:
                return constant(d)
            if isinstance(d, Keyed):
                text = jsondoc.leaf_text(leaf)
                known = mapping.get(f"{d.namespace}\x1f{text}")
                return known if known is not None else candidates(key, d.namespace, d.shape, [text], [0])[0]
            if isinstance(d, Shape):
                text = str(leaf) if isinstance(d, Generator) else jsondoc.leaf_text(leaf)
                return d.generate([text], Mersenne([cell_seed(run_seed.reveal(), label, column, path, identity, text)]))[0]
            if isinstance(d, PerRow):
                return d.fn(leaf, {})
            raise InvalidReplacementValue(f'path "{path}": this kind of definition needs a column')

        return new_leaf

    @staticmethod
    def _per_row(definition: PerRow, frame: DataFrame, old: Column) -> Column:
        """A struct of value and error. Of an exception only its class is told: its message may hold the row's values."""
        fields = [c for c in frame.columns if not c.startswith("__")]

        @F.pandas_udf(jsondoc.RESULT)
        def call(values: pd.Series, rows: pd.DataFrame) -> pd.DataFrame:
            records = rows.astype(object).where(rows.notna(), None).to_dict("records")
            made, errors = [], []
            for v, r in zip(values, records):
                try:
                    x = definition.fn(None if pd.api.types.is_scalar(v) and pd.isna(v) else v, r)
                    made.append(None if x is None else str(validate.stored(x)))
                    errors.append(None)
                except PalimpsestError as e:
                    made.append(None)
                    errors.append(str(e))
                except Exception as e:  # any failure of a caller's function is an error of its row
                    made.append(None)
                    errors.append(f"{type(e).__name__} (message withheld)")
            return pd.DataFrame({"value": pd.Series(made, dtype=object), "error": pd.Series(errors, dtype=object)})

        return call(old, F.struct(*fields))
