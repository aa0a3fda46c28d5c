"""What files don't say about tables: keys, uniqueness, foreign keys and limits of columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# Native types of each family.
FAMILIES = {
    "boolean": ("bool", "boolean"),
    "integer": ("int", "integer", "tinyint", "smallint", "mediumint", "bigint", "int2", "int4", "int8", "serial", "bigserial", "smallserial"),
    "decimal": ("decimal", "numeric", "float", "double", "real", "float4", "float8", "double precision"),
    "datetime": ("date", "datetime", "timestamp", "timestamptz", "time", "timetz", "year"),
    "json": ("json", "jsonb"),
    "set": ("set",),
    "enum": ("enum",),
    "string": ("varchar", "char", "character varying", "character", "bpchar", "text", "tinytext", "mediumtext", "longtext", "uuid", "citext"),
    "binary": ("blob", "tinyblob", "mediumblob", "longblob", "binary", "varbinary", "bytea"),
}
FAMILY_OF = {name: family for family, names in FAMILIES.items() for name in names}


def family_of(native: str) -> str:
    native = native.strip().lower()
    return "boolean" if native == "tinyint(1)" else FAMILY_OF.get(native.partition("(")[0].strip(), "other")


def declared_length(native: str) -> int | None:
    """Characters of a text type that says how many, as varchar(12) does."""
    name, _, rest = native.strip().partition("(")
    size, _, after = rest.partition(")")
    return int(size) if family_of(name) == "string" and size.strip().isdigit() and not after.strip() else None


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    family: str = "other"
    nullable: bool = True
    max_length: int | None = None
    allowed: tuple[str, ...] | None = None
    native_type: str | None = None


class Spelling:
    """Names as a table spells them, whatever the case they are asked for in; as Spark resolves columns."""

    def __init__(self, names: Iterable[str]) -> None:
        self.names = list(names)
        self.folded: dict[str, str] = {}
        for n in self.names:
            self.folded.setdefault(n.lower(), n)

    def one(self, name: str) -> str:
        return name if name in self.names else self.folded.get(name.lower(), name)

    def of(self, names: Iterable[str]) -> tuple[str, ...]:
        return tuple(map(self.one, names))


@dataclass(frozen=True)
class ForeignKey:
    """Without ``parent_columns`` it points at the parent's primary key."""

    child_table: str
    child_columns: tuple[str, ...]
    parent_table: str
    parent_columns: tuple[str, ...] = ()

    def pairs(self) -> list[tuple[str, str]]:
        return list(zip(self.child_columns, self.parent_columns))


@dataclass(frozen=True)
class TableInfo:
    columns: Mapping[str, ColumnInfo]
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()

    def constraints(self) -> list[tuple[str, ...]]:
        """Unique tuples, the primary key among them, without repeats."""
        return list(dict.fromkeys(t for t in (self.primary_key, *self.unique) if t))


def _from_spark(field_: T.StructField) -> ColumnInfo:
    kind, meta = field_.dataType, field_.metadata or {}
    families = {
        T.BooleanType: "boolean", T.ByteType: "integer", T.ShortType: "integer", T.IntegerType: "integer", T.LongType: "integer",
        T.DecimalType: "decimal", T.FloatType: "decimal", T.DoubleType: "decimal", T.DateType: "datetime", T.TimestampType: "datetime",
        T.TimestampNTZType: "datetime", T.StringType: "string", T.VarcharType: "string", T.CharType: "string", T.BinaryType: "binary", T.VariantType: "json",
        T.ArrayType: "nested", T.StructType: "nested", T.MapType: "nested",
    }
    native = meta.get("native_type") or meta.get("__CHAR_VARCHAR_TYPE_STRING") or kind.simpleString()
    family = family_of(meta["native_type"]) if "native_type" in meta else families.get(type(kind), "other")
    length = meta.get("max_length", declared_length(native))
    allowed = tuple(meta["allowed"]) if "allowed" in meta else None
    return ColumnInfo(field_.name, family, field_.nullable, length, allowed, native)


@dataclass(frozen=True)
class SchemaCatalog:
    tables: Mapping[str, TableInfo] = field(default_factory=dict)
    foreign_keys: tuple[ForeignKey, ...] = ()

    @classmethod
    def of(
        cls, schemas: Mapping[str, T.StructType], primary_keys: Mapping[str, Sequence[str]] | None = None, unique: Mapping[str, Iterable[Sequence[str]]] | None = None,
        foreign_keys: Iterable[ForeignKey] = (), columns: Mapping[str, Mapping[str, Mapping[str, object]]] | None = None,
    ) -> SchemaCatalog:
        """From the schemas of frames, with what a sidecar adds to them by table and column."""
        tables = {}
        for name, schema in schemas.items():
            own = {f.name: _from_spark(f) for f in schema.fields}
            for column, more in (columns or {}).get(name, {}).items():
                column, more = Spelling(own).one(column), dict(more)
                if "native_type" in more:
                    more.setdefault("family", family_of(str(more["native_type"])))
                own[column] = replace(own[column], **more)
            spelled = Spelling(own)
            tables[name] = TableInfo(own, spelled.of((primary_keys or {}).get(name, ())), tuple(map(spelled.of, (unique or {}).get(name, ()))))
        edges = []
        for fk in foreign_keys:
            parent = tables.get(fk.parent_table)
            ends = fk.parent_columns or (parent.primary_key if parent else ())  # a key that names no columns means the primary key
            child = Spelling(tables[fk.child_table].columns if fk.child_table in tables else ()).of(fk.child_columns)
            edges.append(ForeignKey(fk.child_table, child, fk.parent_table, Spelling(parent.columns if parent else ()).of(ends)))
        return cls(tables, tuple(edges))

    def touching(self, table: str, column: str) -> list[tuple[ForeignKey, str, str, str, str]]:
        """Edges with the column on either side: (key, child table, child column, parent table, parent column)."""
        out = []
        for fk in self.foreign_keys:
            for child, parent in fk.pairs():
                if (fk.child_table, child) == (table, column) or (fk.parent_table, parent) == (table, column):
                    out.append((fk, fk.child_table, child, fk.parent_table, parent))
        return out

    def referencing(self, table: str) -> list[ForeignKey]:
        """Foreign keys of any table that point at this one."""
        return [fk for fk in self.foreign_keys if fk.parent_table == table]
