"""Memory of Python workers, which outlive their tasks and share an executor with the next stage's."""

from __future__ import annotations

import ctypes
import gc
import sys


def give_back() -> None:
    """Hand what the allocator holds free back to the system; does nothing but collect garbage where the C library can't."""
    gc.collect()
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
