"""Byte classes and 64-bit mixing, shared by the operators that hash words inside tasks."""

from __future__ import annotations

import numpy as np

U = np.uint64
M1, M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
#: Which bytes are ASCII white space.
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, *range(9, 14)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on all bits of the 64-bit number."""
    h = (h ^ (h >> U(30))) * M1
    h = (h ^ (h >> U(27))) * M2
    return h ^ (h >> U(31))
