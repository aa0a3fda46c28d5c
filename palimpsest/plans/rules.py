"""Rule sets: which columns of a table are rewritten, and how."""

from __future__ import annotations

import enum
import importlib
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column

from ..errors import InvalidConfiguration
from ..functions.jsonpaths import JsonPaths
from ..functions.prng import Draws
from ..functions.shapes import BankAccount, KeepLength, Nric, Pattern, Shape, Sst, State, is_namespace
from ..sources.catalog import Spelling


DOTTED = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+")


@dataclass(frozen=True)
class Keyed:
    """Equal inputs of one namespace get equal outputs, over rows, columns and tables."""

    namespace: str
    shape: Shape

    def __post_init__(self) -> None:
        if not is_namespace(self.namespace):
            raise InvalidConfiguration("a namespace has 1 to 64 of A-Z a-z 0-9 _ . : -")

    @property
    def signature(self) -> str:
        return self.shape.signature


def keyed(namespace: str, shape: Shape) -> Keyed:
    return Keyed(namespace, shape)


def keyed_pattern(namespace: str, pattern: str) -> Keyed:
    return Keyed(namespace, Pattern(pattern))


@dataclass(frozen=True)
class Expression:
    """A native expression of the current value: ``fn(column) -> Column``. Nulls reach it too."""

    fn: Callable[[Column], Column]


@dataclass(frozen=True)
class PerRow:
    """A Python function of the current value and the row as a dict, run in Arrow batches."""

    fn: Callable[[Any, dict[str, Any]], Any]


@dataclass(frozen=True)
class Generator(Shape):
    """A named generator; unlike a bare shape it also replaces nulls."""

    name: str
    shape: Shape

    @property
    def signature(self) -> str:
        return f"generator:{self.name}"

    def generate(self, values: Sequence[str], draws: Draws) -> list[str]:
        return self.shape.generate(values, draws)


@dataclass(frozen=True)
class Words(Shape):
    """``template`` with {w} for a word, {W} for a capitalised one and {#} for a digit."""

    template: str

    @property
    def signature(self) -> str:
        return f"words:{self.template}"

    def generate(self, values: Sequence[str], draws: Draws) -> list[str]:
        out, rest = [""] * len(values), self.template
        while rest:
            if rest[:3] in ("{w}", "{W}"):
                parts = [WORDS[i] for i in draws.integers(0, len(WORDS) - 1).tolist()]
                parts = [p.capitalize() for p in parts] if rest[1] == "W" else parts
                rest = rest[3:]
            elif rest[:3] == "{#}":
                parts, rest = [str(i) for i in draws.integers(0, 9).tolist()], rest[3:]
            else:
                parts, rest = [rest[0]] * len(values), rest[1:]
            out = [a + b for a, b in zip(out, parts)]
        return out


WORDS = "amber basil cedar delta ember fjord grove hazel indigo juniper kestrel lumen maple nectar olive pebble quartz river sable tundra umber violet willow xenon yarrow zephyr".split()

REGISTRY: dict[str, Generator] = {
    name: Generator(name, shape)
    for name, shape in {
        "word": Words("{w}"), "name": Words("{W} {W}"), "firstName": Words("{W}"), "lastName": Words("{W}"), "userName": Words("{w}{#}{#}{#}"),
        "safeEmail": Words("{w}.{w}{#}{#}{#}@example.com"), "email": Words("{w}.{w}{#}{#}{#}@{w}.example"), "sentence": Words("{W} {w} {w} {w} {w} {w}."),
        "city": Words("{W}"), "phoneNumber": Words("0{#}{#}-{#}{#}{#}{#}{#}{#}{#}"),
        "title": Words("{W}"), "company": Words("{W} {W} Ltd"), "jobTitle": Words("{W} {w}"), "country": Words("{W}"), "streetName": Words("{W} Street"), "streetAddress": Words("{#}{#} {W} Street"),
        "address": Words("{#}{#} {W} Street, {#}{#}{#}{#}{#} {W}"), "postcode": Words("{#}{#}{#}{#}{#}"), "domainName": Words("{w}{#}{#}.example"), "url": Words("https://{w}.example/{w}/{w}"),
        "slug": Words("{w}-{w}-{w}{#}"), "password": Words("{w}{W}{#}{#}{#}{#}"), "randomDigit": Words("{#}"), "text": Words("{W} {w} {w} {w} {w} {w}. {W} {w} {w} {w} {w}."),
        "malaysiaNric": Nric(), "malaysiaSst": Sst(), "malaysiaState": State(), "malaysiaBankAccount": BankAccount(),
    }.items()
}


def register(name: str, shape: Shape) -> None:
    REGISTRY[name] = Generator(name, shape)


def _imported(definition: Any) -> type[Shape] | None:
    """The shape class that a text like ``package.module.Class`` names, if there is one."""
    if not isinstance(definition, str) or not DOTTED.fullmatch(definition):
        return None
    module, _, name = definition.rpartition(".")
    try:
        found = getattr(importlib.import_module(module), name, None)
    except ImportError:  # some other text with dots
        return None
    return found if isinstance(found, type) and issubclass(found, Shape) else None


def resolve(definition: Any) -> Any:
    """The definition behind a class, the dotted path of one, or a generator's name; or the definition itself."""
    definition = _imported(definition) or definition
    if isinstance(definition, type) and issubclass(definition, Shape):
        return definition()
    if isinstance(definition, str) and definition in REGISTRY:
        return REGISTRY[definition]
    if callable(definition) and not isinstance(definition, (Shape, Keyed, JsonPaths, Expression, PerRow, enum.Enum)):
        return PerRow(definition)
    return definition


def is_static(definition: Any) -> bool:
    return not isinstance(resolve(definition), (Keyed, Shape, JsonPaths, Expression, PerRow))


def deterministic(definition: Any) -> bool:
    """Whether a retry would give the same value again."""
    d = resolve(definition)
    return is_static(d) or isinstance(d, (Keyed, Expression, PerRow, JsonPaths)) or isinstance(d, KeepLength) and d.mask is not None


@dataclass(frozen=True)
class Codec:
    """How a column's values are stored: ``decode`` before rules read them, ``encode`` before they are written."""

    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column] = lambda c: c
    preserves_samples: bool = False
    json: bool = False


@dataclass(frozen=True)
class RuleSet:
    """``table`` and ``key_name``: of a model whose table or key is named otherwise."""

    fields: Mapping[str, Any] = field(default_factory=dict)
    categorical: Sequence[str] = ()
    paging_key: Sequence[str] = ()
    mirrors: Mapping[str, Sequence[str]] = field(default_factory=dict)
    codecs: Mapping[str, Codec] = field(default_factory=dict)
    table: str | None = None
    key_name: str | None = None


    def spelled(self, names: Spelling) -> RuleSet:
        """The rules with columns named as their table spells them."""
        one = names.one
        return replace(
            self, fields={one(c): d for c, d in self.fields.items()}, categorical=[one(c) for c in self.categorical], paging_key=[one(c) for c in self.paging_key],
            mirrors={one(c): m for c, m in self.mirrors.items()}, codecs={one(c): d for c, d in self.codecs.items()},
        )


@dataclass(frozen=True)
class Target:
    """``label`` is the model's name, or ``table:<name>``."""

    label: str
    table: str
    rules: RuleSet | None
    key_name: str | None = None


def keyed_of(rules: RuleSet) -> list[tuple[str, str | None, Keyed]]:
    """(column, path or None, definition) of every keyed value, in the order of declaration."""
    out: list[tuple[str, str | None, Keyed]] = []
    for column, definition in rules.fields.items():
        if isinstance(definition, Keyed):
            out.append((column, None, definition))
        elif isinstance(definition, JsonPaths):
            out += [(column, path, d) for path, d in definition.definitions.items() if isinstance(d, Keyed)]
    return out
