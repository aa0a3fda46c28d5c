"""Errors of the engine. Messages name targets, tables and columns, never values or keys."""


class PalimpsestError(Exception):
    """Base of all errors that the engine raises on purpose; their messages are safe to show."""


class UnsafeEnvironment(PalimpsestError):
    """The environment isn't allowed, or an override wasn't confirmed."""


class InvalidConfiguration(PalimpsestError):
    """Rules, targets or the key are declared wrongly."""


class UnsafeColumn(PalimpsestError):
    """A column must not be rewritten: unknown, part of a key, or on either side of a foreign key."""


class InvalidCategoricalColumn(PalimpsestError):
    """A column can't be resampled from its own distribution."""


class UnpageableTable(PalimpsestError):
    """A table has no stable identity."""


class ConstraintViolation(PalimpsestError):
    """A new value doesn't fit its column."""


class InvalidReplacementValue(PalimpsestError):
    """A value has no canonical text, or a document can't be rewritten."""
