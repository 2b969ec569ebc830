"""Files rewritten with another compression or layout: strips, one single strip, or tiles."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from rasterloom.sources import scenes, tiff
from rasterloom.sources.tiff import Refused


def transcoded(source: str | Path, target: str | Path, compression: str = "zlib", tile: int | None = 256, single_strip: bool = False) -> tiff.Header:
    """``source`` as 16 bits, as it is shown, with what describes the image; band by band unless a single strip is asked for."""
    head = tiff.header(str(source))
    if Path(source).resolve() == Path(target).resolve():
        raise Refused("a file cannot be rewritten in its own place")
    h, w = head.shown
    step = h if single_strip else tile or tiff.strip_rows(w)

    def segments() -> Iterator[bytes]:
        for y in range(0, h, step):
            rows = tiff.window(head, y, min(y + step, h), 0, w).astype("<u2", copy=False)
            for part in scenes.cut(rows, step) if tile and not single_strip else [rows]:
                yield tiff.packed(part.tobytes(), compression)

    with open(target, "wb") as f:
        tiff.write(f, segments(), h, w, compression, head.meta, rows=step, tile=None if single_strip else tile)
    return tiff.header(str(target))
