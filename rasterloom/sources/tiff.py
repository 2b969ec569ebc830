"""RGB TIFF files: headers, windows of pixels, strips.

Reads classic and big files of either byte order, strips and tiles, 8 and 16
bits, stored plainly or compressed with zlib, LZW or zstd, with or without
horizontal differencing.  Only the segments that a window touches are read.
Everything else is refused with a reason.  A file is a local or mounted path,
or the bytes that Spark's ``binaryFile`` source has read from anywhere.
"""

from __future__ import annotations

import io
import os
import struct
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import zstandard

from rasterloom.functions import lzw

# Fixed values of the file format: tag numbers, field types, compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIPS, ORIENTATION = 256, 257, 258, 259, 262, 270, 273, 274
SAMPLES, ROWS, COUNTS, X_RESOLUTION, Y_RESOLUTION, PLANAR, UNIT, PREDICTOR = 277, 278, 279, 282, 283, 284, 296, 317
TILE_W, TILE_H, TILES, TILE_COUNTS, SUB_IFDS, FORMAT, PROFILE = 322, 323, 324, 325, 330, 339, 34675
TEXTS = {"document": 269, "time": 306, "artist": 315, "copyright": 33432}
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
CODES = {"none": 1, "lzw": 5, "zlib": 8, "zstd": 50000}
OLD_ZLIB = 32946
#: For each orientation, whether rows and columns run backwards; from 5 on they have changed places before.
BACKWARDS = {1: (0, 0), 2: (0, 1), 3: (1, 1), 4: (1, 0), 5: (0, 0), 6: (0, 1), 7: (1, 1), 8: (1, 0)}


class Refused(ValueError):
    """A file, stack or setting that cannot be used, and why."""


@dataclass(frozen=True)
class Header:
    path: str
    order: str
    h: int
    w: int
    depth: int
    orientation: int
    compression: int
    predictor: int
    seg_h: int
    seg_w: int
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    meta: dict = field(default_factory=dict)
    content: bytes | None = field(default=None, repr=False)

    def open(self) -> BinaryIO:
        return open(self.path, "rb") if self.content is None else io.BytesIO(self.content)

    @property
    def shown(self) -> tuple[int, int]:
        return (self.w, self.h) if self.orientation >= 5 else (self.h, self.w)

    @property
    def plain(self) -> bool:
        """Rows can be read where they lie: uncompressed strips."""
        return self.compression == 1 and self.predictor == 1 and self.seg_w == self.w


def _directory(f: BinaryIO) -> tuple[str, dict[int, tuple], int, int]:
    """Byte order, the tags of the first directory, where the next one is, the file's size."""
    size = f.seek(0, os.SEEK_END)
    f.seek(0)
    order = {b"II": "<", b"MM": ">"}.get(f.read(2))
    if order is None:
        raise Refused("not a TIFF file")

    def get(fmt: str, at: int | None = None) -> tuple:
        if at is not None:
            f.seek(at)
        raw = f.read(struct.calcsize(order + fmt))
        return struct.unpack(order + fmt, raw)

    version = get("H")[0]
    if version not in (42, 43):
        raise Refused("not a TIFF file")
    big = version == 43
    at = get("HHQ")[2] if big else get("I")[0]
    n = get("Q" if big else "H", at)[0]
    if n > 4096:
        raise Refused("corrupt directory")
    entry, head, inline = (20, "HHQ", 8) if big else (12, "HHI", 4)
    first = at + (8 if big else 2)
    tags: dict[int, tuple] = {}
    for k in range(n):
        tag, kind, count = get(head, first + k * entry)
        if kind not in TYPES:
            continue
        fmt = f"{count}s" if TYPES[kind] == "s" else TYPES[kind] * count if len(TYPES[kind]) == 2 else f"{count}{TYPES[kind]}"
        length = struct.calcsize(order + fmt)
        place = first + k * entry + (12 if big else 8)
        if length > inline:
            place = get("Q" if big else "I", place)[0]
        if length > size or place + length > size:
            raise Refused("corrupt directory")
        tags[tag] = get(fmt, place)
    return order, tags, get("Q" if big else "I", first + n * entry)[0], size


def _text(raw: bytes) -> str:
    return raw.split(b"\0")[0].decode("utf-8", "replace")


def _meta(tags: dict[int, tuple], swap: bool) -> dict:
    """What is handed on to the output: profile, resolution, texts; never what describes the file itself."""
    out: dict = {}
    if PROFILE in tags:
        raw = tags[PROFILE]
        out["icc"] = raw[0] if isinstance(raw[0], bytes) else bytes(raw)
    if X_RESOLUTION in tags and Y_RESOLUTION in tags:
        x, y = (t[0] / t[1] if len(t) == 2 and t[1] else float(t[0]) for t in (tags[X_RESOLUTION], tags[Y_RESOLUTION]))
        out["resolution"] = [y, x] if swap else [x, y]
        out["unit"] = int(tags.get(UNIT, (1,))[0])
    out |= {name: _text(tags[code][0]) for name, code in TEXTS.items() if code in tags}
    said = _text(tags[DESCRIPTION][0]) if DESCRIPTION in tags else ""
    if said and said.lstrip()[:1] not in ("{", "<"):
        out["description"] = said
    return out


def header(path: str, content: bytes | None = None) -> Header:
    """A file's header, checked; no pixel is read."""
    try:
        with open(path, "rb") if content is None else io.BytesIO(content) as f:
            order, t, following, size = _directory(f)
    except (struct.error, OSError, OverflowError, MemoryError) as e:
        raise Refused(f"{path}: cannot be read: {e}") from e
    except Refused as e:
        raise Refused(f"{path}: {e}") from e

    def need(ok: bool, why: str) -> None:
        if not ok:
            raise Refused(f"{path}: {why}")

    one = lambda tag, default=0: int(t[tag][0]) if tag in t and len(t[tag]) else default
    need(not following, "more than one page")
    need(SUB_IFDS not in t, "pages within the page")
    h, w = one(HEIGHT), one(WIDTH)
    need(h > 0 and w > 0, "no size")
    need(one(PHOTOMETRIC, -1) == 2 and one(SAMPLES, 1) == 3 and one(PLANAR, 1) == 1, "not three interleaved channels of RGB")
    bits = set(t.get(BITS, (1,)))
    need(bits in ({8}, {16}) and set(t.get(FORMAT, (1,))) == {1}, "not 8 or 16 unsigned bits a sample")
    orientation = one(ORIENTATION, 1)
    need(1 <= orientation <= 8, f"orientation {orientation}")
    compression, predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
    need(compression in (*CODES.values(), OLD_ZLIB), f"compression {compression}")
    need(predictor in (1, 2), f"predictor {predictor}")
    tiled = TILES in t
    seg_h, seg_w = (one(TILE_H), one(TILE_W)) if tiled else (min(one(ROWS, h), h), w)
    need(seg_h > 0 and seg_w > 0, "no segment size")
    offsets = t.get(TILES if tiled else STRIPS, ())
    counts = t.get(TILE_COUNTS if tiled else COUNTS, ())
    need(len(offsets) == len(counts) == -(-h // seg_h) * -(-w // seg_w), "wrong number of segments")
    need(all(n > 0 and at > 0 and at + n <= size for at, n in zip(offsets, counts)), "sparse, corrupt or cut segments")
    depth = bits.pop()
    if compression == 1:
        full = [min(seg_h, h - i * seg_h) if not tiled else seg_h for i in range(-(-h // seg_h)) for _ in range(-(-w // seg_w))]
        need(all(n >= rows * seg_w * 3 * depth // 8 for n, rows in zip(counts, full)), "cut segments")
    return Header(path, order, h, w, depth, orientation, compression, predictor, seg_h, seg_w, tuple(offsets), tuple(counts), _meta(t, orientation >= 5), content)


CLEAR, END, FREE = 256, 257, 258
#: Width of the k-th code after a clear code, wider a step early, and where it begins; entries of a table before it is left.
_WIDTHS = np.clip(np.floor(np.log2(FREE + np.arange(lzw.FULL))).astype(np.int64) + 1, 9, 12)
_PLACES = np.concatenate([[0], np.cumsum(_WIDTHS)])
_MOST = 3837


def lzw_decode(data: bytes) -> bytes:
    """The format's LZW: codes from the high bit on."""
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int32)
    words = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    total, bit, run, out = 8 * len(data), 0, [], []
    while True:
        begun = sum(map(len, run))
        widths = _WIDTHS[begun:] if begun < lzw.FULL else np.full(lzw.FULL, 12)
        starts = np.cumsum(widths) - widths
        n = int(np.searchsorted(starts + widths, total - bit, side="right"))
        at = bit + starts[:n]
        codes = words[at >> 3] >> (24 - (at & 7) - widths[:n]) & ((1 << widths[:n]) - 1)
        marks = np.flatnonzero((codes == CLEAR) | (codes == END))
        used = int(marks[0]) if len(marks) else n
        run.append(codes[:used])
        if len(marks) or not n:
            out.append(lzw.expanded(np.concatenate(run), FREE))
            if not len(marks) or codes[used] == END:
                return b"".join(out)
            bit, run = bit + int(starts[used] + widths[used]), []
        else:
            bit += int(starts[n - 1] + widths[n - 1])


def lzw_encode(data: bytes) -> bytes:
    runs = lzw.parsed(data, _MOST - 1, CLEAR) or [[]]
    codes, widths = [[CLEAR]], [[9]]
    for k, run in enumerate(runs):
        codes.append([*run, END if k == len(runs) - 1 else CLEAR])
        widths.append(_WIDTHS[: len(run) + 1])
    code, width = np.concatenate(codes).astype(np.int64), np.concatenate(widths).astype(np.int64)
    ends = np.cumsum(width)
    starts = ends - width
    moved, at, size = code << (24 - (starts & 7) - width), starts >> 3, int(ends[-1] + 7 >> 3)
    out = sum(np.bincount(at + k, moved >> 16 - 8 * k & 255, size + 2) for k in range(3))
    return out[:size].astype(np.uint8).tobytes()


def _unpacked(data: bytes, compression: int, most: int) -> bytes:
    if compression in (CODES["zlib"], OLD_ZLIB):
        stream = zlib.decompressobj()
        out = stream.decompress(data, most + 1)
        while not stream.eof and stream.unconsumed_tail:  # the check sum comes at the end, wherever that is
            stream.decompress(stream.unconsumed_tail, 1 << 20)
        return out[:most]
    if compression == CODES["zstd"]:
        return zstandard.ZstdDecompressor().decompress(data, max_output_size=most)
    return lzw_decode(data) if compression == CODES["lzw"] else data


def packed(data: bytes, compression: str) -> bytes:
    if compression == "zlib":
        return zlib.compress(data, 6)
    if compression == "zstd":
        return zstandard.ZstdCompressor().compress(data)
    return lzw_encode(data) if compression == "lzw" else data


def segment(f: BinaryIO, head: Header, k: int) -> np.ndarray:
    """One strip or tile, in the machine's byte order."""
    rows = head.seg_h if head.seg_w != head.w or head.h % head.seg_h == 0 else min(head.seg_h, head.h - k * head.seg_h)
    length = rows * head.seg_w * 3 * head.depth // 8
    f.seek(head.offsets[k])
    try:
        data = _unpacked(f.read(head.counts[k]), head.compression, length)
    except (zlib.error, zstandard.ZstdError, IndexError) as e:
        raise Refused(f"{head.path}: segment {k}: {e}") from e
    if len(data) < length:
        raise Refused(f"{head.path}: segment {k} is cut")
    kind = np.dtype(f"{head.order}u{head.depth // 8}")
    a = np.frombuffer(data, kind, rows * head.seg_w * 3).reshape(rows, head.seg_w, 3).astype(kind.newbyteorder("="))
    return np.cumsum(a, axis=1, dtype=a.dtype) if head.predictor == 2 else a


def stored_window(head: Header, y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
    """A window in stored places, from the segments that it touches; of plain strips only its rows."""
    kind = np.dtype(f"u{head.depth // 8}")
    out = np.empty((y1 - y0, x1 - x0, 3), kind)
    with head.open() as f:
        if head.plain:
            row = head.w * 3 * kind.itemsize
            for y in range(y0, y1):
                f.seek(head.offsets[y // head.seg_h] + y % head.seg_h * row + x0 * 3 * kind.itemsize)
                out[y - y0] = np.frombuffer(f.read((x1 - x0) * 3 * kind.itemsize), kind.newbyteorder(head.order)).reshape(-1, 3)
            return out
        across = -(-head.w // head.seg_w)
        for i in range(y0 // head.seg_h, (y1 - 1) // head.seg_h + 1):
            for j in range(x0 // head.seg_w, (x1 - 1) // head.seg_w + 1):
                part = segment(f, head, i * across + j)
                ty, tx = i * head.seg_h, j * head.seg_w
                a, b, c, d = max(y0, ty), min(y1, ty + part.shape[0]), max(x0, tx), min(x1, tx + part.shape[1])
                out[a - y0 : b - y0, c - x0 : d - x0] = part[a - ty : b - ty, c - tx : d - tx]
    return out


def turned(a: np.ndarray, orientation: int) -> np.ndarray:
    """A stored block as it is shown."""
    if orientation >= 5:
        a = a.swapaxes(0, 1)
    rows, columns = BACKWARDS[orientation]
    return a[:: -1 if rows else 1, :: -1 if columns else 1]


def window(head: Header, y0: int, y1: int, x0: int, x1: int) -> np.ndarray:
    """A window in shown places, of 16 bits: 8-bit samples are widened."""
    h, w = head.shown
    rows, columns = BACKWARDS[head.orientation]
    ys = (h - y1, h - y0) if rows else (y0, y1)
    xs = (w - x1, w - x0) if columns else (x0, x1)
    box = (*xs, *ys) if head.orientation >= 5 else (*ys, *xs)
    a = turned(stored_window(head, *box), head.orientation)
    return a.astype(np.uint16) * np.uint16(257) if head.depth == 8 else np.ascontiguousarray(a)


def strip_rows(w: int) -> int:
    """Rows of an output strip: about a megabyte, 64 at most."""
    return max(1, min(64, (1 << 20) // (6 * w)))


def _tag(code: int, kind: int, values: Iterable | bytes) -> tuple[int, int, int, bytes]:
    if isinstance(values, bytes):
        return code, kind, len(values), values
    values = list(values)
    n = len(values) // 2 if kind == 5 else len(values)
    return code, kind, n, struct.pack("<" + {3: "H", 4: "I", 5: "I", 16: "Q"}[kind] * len(values), *values)


def _rational(x: float) -> list[int]:
    bottom = 1 if x == int(x) or x > 4000 else 1_000_000
    return [round(x * bottom), bottom]


def big_file(h: int, w: int) -> bool:
    """Whether an output could outgrow the classic form."""
    return h * w * 6 * 1.1 + (1 << 20) > 0xFFFFFFFF


def preamble(big: bool) -> bytes:
    """What stands before the segments; the place of the directory is still 0."""
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if big else struct.pack("<2sHI", b"II", 42, 0)


def pointer(big: bool, directory: int) -> tuple[int, bytes]:
    """Where in the preamble the directory's place goes, and its bytes."""
    return (8, struct.pack("<Q", directory)) if big else (4, struct.pack("<I", directory))


def directory(at: int, offsets: Sequence[int], counts: Sequence[int], h: int, w: int, compression: str, meta: dict, big: bool, rows: int | None = None, tile: int | None = None) -> tuple[bytes, int]:
    """What stands behind the segments, which end at ``at``, and where in the file the directory itself is.

    16-bit RGB in strips of ``rows`` rows, or in square tiles of side ``tile``.
    """
    wide = 16 if big else 4
    tags = [
        _tag(WIDTH, 4, [w]), _tag(HEIGHT, 4, [h]), _tag(BITS, 3, [16] * 3), _tag(COMPRESSION, 3, [CODES[compression]]), _tag(PHOTOMETRIC, 3, [2]), _tag(ORIENTATION, 3, [1]), _tag(SAMPLES, 3, [3]), _tag(PLANAR, 3, [1]),
        _tag(FORMAT, 3, [1] * 3),
    ]
    if tile:
        tags += [_tag(TILE_W, 4, [tile]), _tag(TILE_H, 4, [tile]), _tag(TILES, wide, offsets), _tag(TILE_COUNTS, wide, counts)]
    else:
        tags += [_tag(ROWS, 4, [rows or strip_rows(w)]), _tag(STRIPS, wide, offsets), _tag(COUNTS, wide, counts)]
    if "icc" in meta:
        tags.append(_tag(PROFILE, 7, meta["icc"]))
    if "resolution" in meta:
        tags += [_tag(X_RESOLUTION, 5, _rational(meta["resolution"][0])), _tag(Y_RESOLUTION, 5, _rational(meta["resolution"][1])), _tag(UNIT, 3, [meta.get("unit", 1)])]
    for name, code in {**TEXTS, "description": DESCRIPTION}.items():
        if name in meta:
            tags.append(_tag(code, 2, meta[name].encode() + b"\0"))
    inline, places, out = 8 if big else 4, {}, bytearray()
    for code, _, _, raw in tags:
        if len(raw) > inline:
            out += b"\0" * ((at + len(out)) % 2)
            places[code] = at + len(out)
            out += raw
    out += b"\0" * (-(at + len(out)) % 8)
    here = at + len(out)
    out += struct.pack("<Q" if big else "<H", len(tags))
    for code, kind, n, raw in sorted(tags):
        out += struct.pack("<HHQ" if big else "<HHI", code, kind, n)
        out += struct.pack("<Q" if big else "<I", places[code]) if code in places else raw.ljust(inline, b"\0")
    return bytes(out + struct.pack("<Q" if big else "<I", 0)), here


def write(f: BinaryIO, segments: Iterable[bytes], h: int, w: int, compression: str, meta: dict, big: bool | None = None, rows: int | None = None, tile: int | None = None) -> None:
    """A file of 16-bit RGB; ``segments`` are packed already and in order: strips of ``rows`` rows (by default ``strip_rows``), or tiles."""
    big = big_file(h, w) if big is None else big
    f.write(preamble(big))
    offsets, counts = [], []
    for data in segments:
        offsets.append(f.tell())
        counts.append(len(data))
        f.write(data)
    tail, here = directory(f.tell(), offsets, counts, h, w, compression, meta, big, rows, tile)
    f.write(tail)
    place, value = pointer(big, here)
    f.seek(place)
    f.write(value)
