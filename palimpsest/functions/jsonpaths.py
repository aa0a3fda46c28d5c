"""Rewriting single paths of JSON documents, all else kept as it stands.

A path is made of segments joined by ``->``: member names, array indexes, or ``*`` for all. Documents in which nothing was
rewritten come back unchanged to the byte; others are encoded compactly, with the order of members and the difference between
1 and 1.0 kept.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Mapping
from json.encoder import encode_basestring
from typing import Any

from ..errors import InvalidReplacementValue

MAX_DEPTH = 512
INDEX = re.compile(r"0|[1-9]\d*")
SURROGATE = re.compile("[\ud800-\udfff]")


class Members(dict):
    """An object of a document; plain dicts and lists alike come from replacements."""


def parse_path(path: str) -> list[str]:
    segments = path.split("->")
    for s in segments:
        if not s:
            raise ValueError(f'nothing stands between two arrows, or at an end, of "{path}"')
        if re.search(r"\[\d*\]", s):
            raise ValueError(f'"{s}" of "{path}": elements are reached by ->0 or ->*, not by brackets')
    return segments


def overlap(a: list[str], b: list[str]) -> bool:
    """Whether two paths may name one place, or one a place inside the other's."""
    return all(x == y or "*" in (x, y) for x, y in zip(a, b))


def _integer(text: str) -> int | float:
    n = int(text)
    return 0.0 * -1 if text == "-0" else n if -(1 << 63) <= n < 1 << 63 else float(text)


def _refuse(name: str) -> Any:
    raise ValueError(name)


DECODER = json.JSONDecoder(object_pairs_hook=Members, parse_int=_integer, parse_float=float, parse_constant=_refuse)


def _depth(text: str) -> int:
    deepest = depth = 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]', text, re.DOTALL):
        if m[0] in "[{":
            depth += 1
            deepest = max(deepest, depth)
        elif m[0] in "]}":
            depth -= 1
    return deepest


def decode(text: str) -> Any:
    """The document, or ValueError. Later members win over earlier ones of the same name."""
    if text.count("[") + text.count("{") > MAX_DEPTH and _depth(text) > MAX_DEPTH:
        raise ValueError("too deep")
    tree = DECODER.decode(text)
    if "\\" in text or not text.isascii() and SURROGATE.search(text):  # without escapes there is neither NUL nor a surrogate of its own
        _check(tree)
    return tree


def _check(node: Any) -> None:
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str) and SURROGATE.search(x):
            raise ValueError("lone surrogate")
        if isinstance(x, dict):
            stack.extend(x.values())
            for k in x:
                if k.startswith("\0"):
                    raise KeyError("member name that begins with NUL")
                if SURROGATE.search(k):
                    raise ValueError("lone surrogate")
        elif isinstance(x, list):
            stack.extend(x)


def is_valid(text: str | None) -> bool:
    if text is None:
        return False
    try:
        decode(text)
    except KeyError:
        return True
    except (ValueError, RecursionError):
        return False
    return True


def _number(x: float) -> str:
    if x == int(x) and abs(x) < 1e15:
        return f"{'-' if math.copysign(1, x) < 0 else ''}{abs(int(x))}.0"
    text = repr(x)
    if "e" in text:
        digits, power = text.split("e")
        return f"{digits if '.' in digits else digits + '.0'}e{int(power):+d}"
    return text


def _quoted(s: str) -> str:
    text = encode_basestring(s)
    return text if text.isascii() else text.replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


def encode(node: Any) -> str:
    if node is None:
        return "null"
    if isinstance(node, bool):
        return "true" if node else "false"
    if isinstance(node, int):
        return str(node)
    if isinstance(node, float):
        return _number(node)
    if isinstance(node, str):
        return _quoted(node)
    if isinstance(node, dict):
        return "{" + ",".join(f"{_quoted(str(k))}:{encode(v)}" for k, v in node.items()) + "}"
    return "[" + ",".join(map(encode, node)) + "]"


def unwritable(value: Any) -> str | None:
    """Name of the type that JSON can't hold, if there is one in the value."""
    if value is None or isinstance(value, (bool, int, str)):
        return None
    if isinstance(value, float):
        return None if math.isfinite(value) else "float"
    if isinstance(value, (list, tuple)):
        return next((t for t in map(unwritable, value) if t), None)
    if isinstance(value, Mapping):
        return next((t for t in map(unwritable, value.values()) if t), None)
    return type(value).__name__


class JsonPaths:
    """Definitions of replacements by path. Each place of a document may be declared once."""

    def __init__(self, paths: Mapping[str, Any]) -> None:
        if not paths:
            raise ValueError("at least one path is needed")
        self.definitions = {str(k): v for k, v in paths.items()}
        self.segments = {p: parse_path(p) for p in self.definitions}
        for p, d in self.definitions.items():
            if isinstance(d, JsonPaths):
                raise ValueError(f'path "{p}" holds paths itself')
        names = list(self.segments)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                if overlap(self.segments[a], self.segments[b]):
                    raise ValueError(f'paths "{a}" and "{b}" overlap')

    def leaves(self, tree: Any, path: str) -> list[tuple[Any, Any]]:
        """(container, key) of every place of a path that holds something but null, in document order."""
        segments, level = self.segments[path], [tree]
        out: list[tuple[Any, Any]] = []
        for at, segment in enumerate(segments):
            found: list[tuple[Any, Any]] = []
            for node in level:
                if isinstance(node, dict):
                    found += [(node, k) for k in node] if segment == "*" else [(node, segment)] if segment in node else []
                elif isinstance(node, list):
                    if segment == "*":
                        found += [(node, i) for i in range(len(node))]
                    elif INDEX.fullmatch(segment) and int(segment) < len(node):
                        found.append((node, int(segment)))
            if at == len(segments) - 1:
                out = [(n, k) for n, k in found if n[k] is not None]
            level = [n[k] for n, k in found]
        return out

    def rewrite(self, text: str | None, replace: Callable[[str, Any], Any]) -> str | None:
        """``replace(path, leaf)`` at every leaf of every path, in the order of declaration."""
        if not text:
            return text
        try:
            tree = decode(text)
        except KeyError:
            raise InvalidReplacementValue("a JSON member name begins with a NUL byte") from None
        except (ValueError, RecursionError):
            raise InvalidReplacementValue("not a valid JSON document") from None
        hit = False
        for path in self.segments:
            for node, key in self.leaves(tree, path):
                value = replace(path, node[key])
                kind = unwritable(value)
                if kind:
                    raise InvalidReplacementValue(f'path "{path}": JSON has no {kind}')
                node[key] = value
                hit = True
        return encode(tree) if hit else text
