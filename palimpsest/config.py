"""Configuration of the engine and options of a run."""

from __future__ import annotations

import base64
import binascii
import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from .errors import InvalidConfiguration, UnsafeEnvironment

if TYPE_CHECKING:
    from .plans.rules import RuleSet

MIN_KEY_BYTES = 32


class Secret:
    """Key bytes that no repr, traceback or plan shows."""

    def __init__(self, value: bytes) -> None:
        self._value = value

    def reveal(self) -> bytes:
        return self._value

    def __repr__(self) -> str:
        return "Secret(...)"


def load_key(raw: str | bytes | None) -> Secret:
    """A key of at least 32 bytes, as text, bytes, or text after ``base64:``."""
    if not raw:
        raise InvalidConfiguration("no key is set, but a keyed value is declared")
    value = raw.encode() if isinstance(raw, str) else raw
    if value.startswith(b"base64:"):
        try:
            value = base64.b64decode(value[7:], validate=True)
        except binascii.Error:
            raise InvalidConfiguration("the key is not valid base64") from None
    if len(value) < MIN_KEY_BYTES:
        raise InvalidConfiguration(f"the key has fewer than {MIN_KEY_BYTES} bytes")
    return Secret(value)


@dataclass(frozen=True)
class ChunkConfig:
    size: int | None = None
    min: int = 500
    max: int = 5000
    target_chunks: int = 20

    def size_for(self, rows: int, override: int | None = None) -> int:
        """An option wins over the configuration, and both over the automatic size."""
        for given in (override, self.size):
            if given is not None and given >= 1:
                return given
        if rows <= self.min:
            return max(rows, 1)
        return max(self.min, min(self.max, -(-rows // self.target_chunks)))


@dataclass(frozen=True)
class EngineConfig:
    """``models`` and ``tables`` map a target to its rules. Models run first, then tables.

    A model without rules has those that ``sanitizers`` holds under its name (what follows the last dot) with "Sanitizer" added, and is skipped if there are none.
    """

    models: Mapping[str, RuleSet | None] = field(default_factory=dict)
    tables: Mapping[str, RuleSet] = field(default_factory=dict)
    sanitizers: Mapping[str, RuleSet] = field(default_factory=dict)
    environments: Sequence[str] = ("local", "testing")
    environment: str = "local"
    chunk: ChunkConfig = ChunkConfig()
    key: Secret | str | bytes | None = None
    run_seed: bytes | None = None

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, **given: Any) -> EngineConfig:
        env = os.environ if env is None else env
        size = env.get("PII_CHUNK_SIZE")
        given.setdefault("chunk", ChunkConfig(size=int(size) if size and size.isdigit() else None))
        given.setdefault("key", env.get("PII_SANITIZER_KEY"))
        given.setdefault("environment", env.get("APP_ENV", "production"))
        return cls(**given)

    def secret(self) -> Secret:
        return self.key if isinstance(self.key, Secret) else load_key(self.key)


@dataclass(frozen=True)
class ProgressEvent:
    """``chunk`` is None when a target starts."""

    target: str
    chunk: int | None
    chunks: int
    rows: int


@dataclass(frozen=True)
class RunOptions:
    chunk_size: int | None = None
    dry_run: bool = False
    force: bool = False
    confirmed: bool = False
    targets: Sequence[str] | None = None
    on_progress: Callable[[ProgressEvent], None] | None = None


def assert_environment(config: EngineConfig, options: RunOptions) -> None:
    allowed = list(config.environments) or ["local", "testing"]
    if config.environment in allowed:
        return
    if not options.force:
        raise UnsafeEnvironment(f'environment "{config.environment}" is not one of {", ".join(allowed)}')
    if not options.confirmed:
        raise UnsafeEnvironment(f'environment "{config.environment}" needs a confirmation besides force')
