"""Let a Python worker give memory back: large blocks get pages of their own, which go when the block goes.

By default the C library raises that size with each block that is freed, and Arrow keeps its own pool; a worker that lives
through many stages then holds what its largest one needed. Smaller free blocks go by ``trim``, which is called after each batch
of texts. Where the C library has no such settings, nothing changes.
"""

from __future__ import annotations

import ctypes

import pyarrow as pa

#: The library's numbers of its settings for the trim and the page threshold.
TRIM, PAGES = -1, -3
BLOCK = 4 << 20


def give_back() -> None:
    """Applies to the process that calls it, from then on."""
    pa.set_memory_pool(pa.system_memory_pool())
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        mallopt(PAGES, BLOCK)
        mallopt(TRIM, 4 * BLOCK)


def trim() -> None:
    """Give every free page of the process back, also those between blocks in use."""
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free is not None:
        free(0)


give_back()
