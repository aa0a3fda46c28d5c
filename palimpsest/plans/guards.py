"""Checks that run before any row is read."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from ..errors import ConstraintViolation, InvalidCategoricalColumn, InvalidConfiguration, UnsafeColumn
from ..functions.jsonpaths import JsonPaths, unwritable
from ..sources.catalog import SchemaCatalog
from . import validate
from .rules import Keyed, RuleSet, Target, is_static, keyed_of, resolve


def check_mirrors(target: Target, rules: RuleSet) -> None:
    for column, listed in rules.mirrors.items():
        where = f"{target.label}: mirrors of {column}"
        if column not in rules.fields:
            raise InvalidConfiguration(f"{where}: the column is not declared in fields")
        if isinstance(listed, str) or not isinstance(listed, Sequence) or not listed:
            raise InvalidConfiguration(f"{where}: not a list of table.column names, or an empty one")
        for entry in listed:
            table, _, name = entry.rpartition(".") if isinstance(entry, str) else ("", "", "")
            if not table or not name:
                raise InvalidConfiguration(f"{where}: an entry is not of the form table.column")
            if (table, name) == (target.table, column):
                raise InvalidConfiguration(f"{where}: an entry names the column itself")
    for column in rules.mirrors:
        if not isinstance(rules.fields[column], Keyed):
            raise InvalidConfiguration(f"{target.label}: the mirrored column {column} is not keyed")


def check_schema(target: Target, rules: RuleSet, catalog: SchemaCatalog) -> None:
    """Empty rules, mirrors, existence, foreign keys on either side, keys, JSON columns and constants, in this order."""
    if not rules.fields:
        raise InvalidConfiguration(f"{target.label}: no fields are declared")
    check_mirrors(target, rules)
    if target.table not in catalog.tables:
        raise InvalidConfiguration(f"{target.label}: the catalog has no table {target.table}")
    info = catalog.tables[target.table]
    for column in rules.fields:
        if column not in info.columns:
            raise UnsafeColumn(f"{target.label}: {target.table} has no column {column}")
    free = [c for c in rules.fields if c not in rules.mirrors]
    for column in free:
        for _, child, child_column, parent, _ in catalog.touching(target.table, column):
            if (child, child_column) == (target.table, column):
                raise UnsafeColumn(f"{target.label}: {column} is a foreign key to {parent}")
    own: list[str] = []
    for column in free:
        for _, child, _, parent, parent_column in catalog.touching(target.table, column):
            if (parent, parent_column) == (target.table, column):
                if child == target.table:
                    own.append(column)
                else:
                    raise UnsafeColumn(f"{target.label}: {column} is referenced by {child}")
    for column in free:
        if column in info.primary_key or column == target.key_name:
            raise UnsafeColumn(f"{target.label}: {column} is part of the primary key")
    if own:
        raise UnsafeColumn(f"{target.label}: {own[0]} is referenced by its own table")
    for column, definition in rules.fields.items():
        if not isinstance(definition, JsonPaths):
            continue
        if info.columns[column].family not in ("json", "string", "nested"):
            raise InvalidConfiguration(f"{target.label}: {column} is of family {info.columns[column].family}, not json, string or nested")
        if column in rules.codecs and not rules.codecs[column].json:
            raise InvalidConfiguration(f"{target.label}: the codec of {column} doesn't hold JSON")
        for path, inner in definition.definitions.items():
            kind = unwritable(resolve(inner)) if is_static(inner) else None
            if kind:
                raise InvalidConfiguration(f'{target.label}: path "{path}" of {column} has a {kind}, which JSON lacks')
    for column, definition in rules.fields.items():
        if is_static(definition) and column not in rules.categorical and column not in rules.codecs:
            code = validate.static_error(info.columns[column], validate.stored(resolve(definition)))
            if code:
                raise ConstraintViolation(f"{target.label}: the constant of {column} in {target.table}: {code}")


def check_quality(target: Target, rules: RuleSet, catalog: SchemaCatalog) -> None:
    for column in rules.categorical:
        definition = rules.fields.get(column)
        if column not in rules.fields:
            raise InvalidCategoricalColumn(f"{target.label}: {column} is not declared in fields")
        if isinstance(definition, Keyed):
            raise InvalidCategoricalColumn(f"{target.label}: {column} is keyed")
        if isinstance(definition, JsonPaths):
            raise InvalidCategoricalColumn(f"{target.label}: {column} has JSON paths")
    for column in rules.categorical:
        if any(column in u for u in catalog.tables[target.table].constraints()):
            raise InvalidCategoricalColumn(f"{target.label}: {column} is part of a unique constraint")
    for column in rules.categorical:
        if column in rules.codecs and not rules.codecs[column].preserves_samples:
            raise InvalidCategoricalColumn(f"{target.label}: the codec of {column} would change a sampled value")


Node = tuple[str, str]


def components(edges: Sequence[tuple[Node, Node]]) -> list[set[Node]]:
    """Connected components of declared mirrors; as many as rules declare, so the driver holds them."""
    parent: dict[Node, Node] = {}

    def find(x: Node) -> Node:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups: dict[Node, set[Node]] = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return list(groups.values())


def check_mirror_groups(targets: Sequence[Target], catalog: SchemaCatalog) -> list[set[Node]]:
    """Every mirror is declared once in the run and keyed in one namespace, and foreign keys stay within a group."""
    edges = []
    for t in targets:
        for column, listed in (t.rules.mirrors if t.rules else {}).items():
            for entry in listed:
                table, _, name = entry.rpartition(".")
                edges.append(((t.table, column), (table, name)))
    if not edges:
        return []
    owners: dict[Node, list[Target]] = {}
    for t in targets:
        for column in t.rules.fields if t.rules else ():
            owners.setdefault((t.table, column), []).append(t)
    for _, mirror in edges:
        if mirror not in owners:
            raise InvalidConfiguration(f"the mirror {'.'.join(mirror)} is not in this run")
        if len(owners[mirror]) > 1:
            raise InvalidConfiguration(f"the mirror {'.'.join(mirror)} is declared by several targets")
    groups = components(edges)
    for group in groups:
        spaces = {}
        for node in sorted(group):
            definition = owners[node][0].rules.fields[node[1]]
            if not isinstance(definition, Keyed):
                raise InvalidConfiguration(f"the mirrored column {'.'.join(node)} is not keyed")
            spaces[definition.namespace] = node
        if len(spaces) > 1:
            raise InvalidConfiguration(f"mirrors of one group use the namespaces {', '.join(sorted(spaces))}")
        for table, column in sorted(group):
            for fk, child, child_column, parent, parent_column in catalog.touching(table, column):
                if len(fk.child_columns) != len(fk.parent_columns):
                    raise UnsafeColumn(f"a foreign key of {child} to {parent} has unequal numbers of columns")
                for end in ((child, child_column), (parent, parent_column)):
                    if end not in group:
                        raise UnsafeColumn(f"{table}.{column}: {'.'.join(end)} at the other end of a foreign key is not in its mirror group")
    return groups


def check_namespaces(targets: Sequence[Target]) -> dict[str, Keyed]:
    """One shape for each namespace."""
    found: dict[str, Keyed] = {}
    for t in targets:
        for _, _, definition in keyed_of(t.rules) if t.rules else ():
            known = found.setdefault(definition.namespace, definition)
            if known.signature != definition.signature:
                raise InvalidConfiguration(f"the namespace {definition.namespace} is declared with two shapes")
    return found


def check_targets(models: Mapping[str, Any], tables: Mapping[str, Any], targets: Sequence[Target]) -> None:
    if not isinstance(models, Mapping) or not isinstance(tables, Mapping):
        raise InvalidConfiguration("models and tables map names to rule sets")
    for t in targets:
        if not t.table or t.rules is not None and not isinstance(t.rules, RuleSet):
            raise InvalidConfiguration(f"{t.label or 'a target'}: not a rule set")


@dataclass(frozen=True)
class Guards:
    """What a run checks before any row is read; an engine takes others in their place."""

    targets: Callable[..., None] = check_targets
    schema: Callable[..., None] = check_schema
    quality: Callable[..., None] = check_quality
    mirrors: Callable[..., list[set[Node]]] = check_mirror_groups
    namespaces: Callable[..., dict[str, Keyed]] = check_namespaces
