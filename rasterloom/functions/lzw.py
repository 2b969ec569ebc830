"""LZW code streams as whole arrays.

After a clear code, the k-th code makes an entry of itself and the first byte of
the next one; that entry stands in the output as one piece.  So each code
copies a stretch that begins where an earlier code began, one byte longer, and a
run of codes can be expanded without a table: every byte is followed back, in
steps that double, to a code of its own.
"""

from __future__ import annotations

import numpy as np

#: Codes have at most 12 bits.
FULL = 4096


def expanded(codes: np.ndarray, free: int) -> bytes:
    """The bytes of the codes between two clear codes; ``free`` is the first code that is an entry."""
    n = len(codes)
    if not n:
        return b""
    entry = codes.astype(np.int64) - free
    own, places = entry < 0, np.arange(n)
    if int((entry - places).max()) > -1:
        raise IndexError("a code that is no entry yet")
    up, steps = np.where(own, places, entry), (~own).astype(np.int64)
    while (more := steps[up]).any():
        steps, up = steps + more, up[up]
    sizes = steps + 1
    starts = np.cumsum(sizes) - sizes
    whole = int(sizes.sum())
    back = np.where(own, 0, starts - starts[np.where(own, places, entry)])
    source = np.arange(whole) - np.repeat(back, sizes)
    value = np.zeros(whole, np.uint8)
    value[starts[own]] = codes[own]
    while not np.array_equal(further := source[source], source):
        source = further
    return value[source].tobytes()


def parsed(data: bytes, most: int, clear: int) -> list[list[int]]:
    """``data`` as codes, a list for each table; a table is left when it has ``most`` entries."""
    runs: list[list[int]] = []
    if not data:
        return runs
    free, prefix, table, codes = clear + 2, data[0], {}, []
    find = table.get
    for byte in memoryview(data)[1:]:
        key = prefix << 8 | byte
        code = find(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        if free - clear - 2 < most:
            table[key] = free
            free += 1
        else:
            runs.append(codes)
            codes, free = [], clear + 2
            table.clear()
        prefix = byte
    return [*runs, [*codes, prefix]]
