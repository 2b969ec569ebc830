"""GIF as a media column: LZW coding, palettes, disposal, transparency, timed frames.

``decode`` reads GIF87a/89a: global and local palettes, graphic control
extensions, interlaced images, any minimum code size, several images; it draws
each image through its palette on a canvas, under its transparent index, and
applies its disposal (keep, clear to background, restore) afterwards.
``encode`` writes such files.  ``timed`` is the DataFrame operator: a row for each
frame, with its time, its canvas and the canvas's colour histogram.

``store`` puts a payload into frames of ``ROWS`` rows, one byte a pixel, under a
palette of 256 different colours.  A pixel that the canvas already shows as it
should be is coded as transparent where that makes a run, and frames are disposed
of in all three ways; ``stored`` draws the file again and takes the payload and
the colour histogram from the canvases.

Defined results: a null or empty cell has no frames, and so does a file that
holds none: one row without a number; bytes that break off or break the rules
give the frames before that place and a further row with the reason in
``__loom_error``; a screen of more than ``MOST_PIXELS`` is not drawn; a null text is
stored as the empty text; texts of any length are stored whole, in as many frames
as they need; equal texts give equal bytes; ids are whole numbers or null;
repeated rows each get a row; an empty table gives an empty result; other
columns, whatever their names, are kept by ``timed`` and passed by by ``stored``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rasterloom.llm.common import OWN, light

WIDTH = 192
#: Rows of a stored payload in a frame; longer payloads take further frames.
ROWS = 64
#: Hundredths of a second that a stored frame is shown, and how frames are disposed of in turn.
DELAY, DISPOSALS = 10, (1, 3, 2)
#: The byte that no UTF-8 text has, and how long a run of pixels must be to be left transparent.
CLEAR, RUN = 255, 8
#: Pixels of the largest screen that is drawn.
MOST_PIXELS = 1 << 24
#: 256 different colours: three bits of red, three of green, two of blue.
PALETTE = np.stack([(np.arange(256) >> 5) * 36, (np.arange(256) >> 2 & 7) * 36, (np.arange(256) & 3) * 85], axis=1).astype(np.uint8)
#: Codes have at most 12 bits.
FULL = 4096


def _widths(bits: int) -> np.ndarray:
    """Width of the k-th code after a clear code, as a decoder that has added one entry for each code but the first expects it."""
    free = (1 << bits) + 2 + np.maximum(np.arange(FULL) - 1, 0)
    return np.clip(np.floor(np.log2(free)).astype(np.int64) + 1, bits + 1, 12)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _layout(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear code, and where each starts."""
    if bits not in _TABLES:
        w = _widths(bits)
        _TABLES[bits] = w, np.concatenate([[0], np.cumsum(w)])
    return _TABLES[bits]


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of the given widths, least significant bit first."""
    ends = np.cumsum(widths)
    starts = ends - widths
    shifted = codes.astype(np.int64) << (starts & 7)
    at = starts >> 3
    n = int(ends[-1] + 7 >> 3)
    out = np.zeros(n + 2, np.int64)
    for k in range(3):
        out += np.bincount(at + k, (shifted >> 8 * k) & 255, n + 2).astype(np.int64)
    return out[:n].astype(np.uint8).tobytes()


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    clear = 1 << bits
    codes, starts = [clear], [0]
    if data:
        table: dict[int, int] = {}
        find, put = table.get, codes.append
        free, prefix = clear + 2, data[0]
        for byte in memoryview(data)[1:]:
            key = prefix << 8 | byte
            code = find(key)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            if free < FULL:
                table[key] = free
                free += 1
            else:
                starts.append(len(codes))
                put(clear)
                table.clear()
                free = clear + 2
            prefix = byte
        put(prefix)
    codes.append(clear + 1)
    # The k-th code after a clear code has that place's width; a clear code has the place after the codes before it.
    width = _layout(bits)[0]
    n = len(codes)
    begins = np.array(starts)
    place = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n))) - 1
    lengths = np.diff(np.append(begins, n))
    place[begins[1:]] = lengths[:-1] - 1
    place[0] = 0
    return _pack(np.array(codes), width[np.minimum(place, FULL - 1)])


def _codes(data: bytes, bits: int) -> list[np.ndarray]:
    """The codes between clear codes, up to the end code or the end of the data."""
    clear, stop = 1 << bits, (1 << bits) + 1
    width, offset = _layout(bits)
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.int32)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    total, bit, out = 8 * len(data), 0, []
    while True:
        parts, place = [], 0
        while True:
            if place < FULL:
                starts, widths = offset[place:FULL] - offset[place], width[place:]
            else:  # a full table that was not cleared
                starts, widths = np.arange(FULL) * 12, np.full(FULL, 12)
            n = int(np.searchsorted(starts + widths, total - bit, side="right"))
            at = bit + starts[:n]
            codes = words[at >> 3] >> (at & 7) & ((1 << widths[:n]) - 1)
            special = np.flatnonzero((codes == clear) | (codes == stop))
            used = int(special[0]) if len(special) else n
            parts.append(codes[:used])
            if len(special):
                bit += int(starts[used] + widths[used])
                break
            if not n:
                return [*out, np.concatenate(parts)]
            bit += int(starts[n - 1] + widths[n - 1])
            place += n
        out.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
        if codes[used] == stop:
            return out


def _expanded(codes: np.ndarray, bits: int, most: int) -> bytes:
    """The bytes of the codes between two clear codes, up to the code that makes them ``most``.

    The k-th code after a clear code makes an entry of itself and the first byte
    of the next one, which stands in the output as one piece; so each code
    copies a stretch that begins where an earlier code began, one byte longer.  Where
    each byte comes from is followed back to a code of its own, in steps that double.
    """
    n = len(codes)
    if not n:
        return b""
    free = (1 << bits) + 2
    parent = codes - free
    own = parent < 0
    places = np.arange(n, dtype=np.int32)
    if int((parent - places).max()) > -1 or int(parent.max()) >= FULL - free:
        raise ValueError("code beyond the table")
    up = np.where(own, places, parent).astype(np.int32)
    sizes = (~own).astype(np.int32)
    while True:
        more = sizes[up]
        if not more.any():
            break
        sizes, up = sizes + more, up[up]
    sizes += 1
    ends = np.cumsum(sizes, dtype=np.int64)
    if int(ends[-1]) > most:
        n = int(np.searchsorted(ends, most)) + 1
        codes, parent, own, places, sizes, ends = codes[:n], parent[:n], own[:n], places[:n], sizes[:n], ends[:n]
    starts = ends - sizes
    back = np.where(own, 0, starts - starts[np.where(own, places, parent)])
    source = np.arange(int(ends[-1]), dtype=np.int32) - np.repeat(back.astype(np.int32), sizes)
    value = np.zeros(int(ends[-1]), np.uint8)
    value[starts[own]] = codes[own]
    while True:
        further = source[source]
        if np.array_equal(further, source):
            return value[source].tobytes()
        source = further


def lzw_decode(data: bytes, bits: int = 8, most: int = 1 << 30) -> bytes:
    """The bytes of a code stream, up to the code with which they are ``most``."""
    out, held = [], 0
    for codes in _codes(data, bits):
        if held >= most:
            break
        out.append(_expanded(codes, bits, most - held))
        held += len(out[-1])
    return b"".join(out)


@dataclass
class Frame:
    """pixels: palette indices, height x width; palette: colours; time and delay in hundredths of a second."""

    pixels: np.ndarray
    palette: np.ndarray
    left: int = 0
    top: int = 0
    delay: int = 0
    disposal: int = 0
    transparent: int | None = None
    time: int = 0
    shown: np.ndarray | None = None  # the whole screen, red, green, blue and alpha in a word

    @property
    def canvas(self) -> np.ndarray:
        """Height x width x RGBA of the whole screen as shown."""
        return self.shown.view(np.uint8).reshape(*self.shown.shape, 4)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def encode(frames: list[Frame], width: int, height: int, palette: np.ndarray = PALETTE, bits: int = 8) -> bytes:
    """A GIF with one palette of 256 colours."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.astype(np.uint8).tobytes()]
    for f in frames:
        flags = f.disposal << 2 | (f.transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", flags, f.delay, f.transparent or 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, f.pixels.shape[1], f.pixels.shape[0], 0) + bytes([bits]))
        out.append(_blocks(lzw_encode(f.pixels.astype(np.uint8).tobytes(), bits)))
    return b"".join(out) + b"\x3b"


def _rows(height: int) -> np.ndarray:
    """Where the rows of an interlaced image go."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


class Broken(ValueError):
    """A file that breaks off or breaks the rules; ``frames`` come before that place."""

    def __init__(self, why: str, frames: list[Frame]):
        super().__init__(why)
        self.frames = frames


def decode(data: bytes, most_pixels: int = MOST_PIXELS) -> list[Frame]:
    """The frames of a GIF, drawn."""
    frames: list[Frame] = []
    try:
        for f in _frames(data, most_pixels):
            frames.append(f)
    except (ValueError, IndexError, struct.error) as e:
        raise Broken("cut off" if isinstance(e, (IndexError, struct.error)) else str(e), frames) from e
    return frames


def _words(palette: np.ndarray) -> np.ndarray:
    """Colours as words of red, green, blue and full alpha."""
    return np.column_stack([palette, np.full(len(palette), 255, np.uint8)]).astype(np.uint8).view("<u4")[:, 0]


def _frames(data: bytes, most_pixels: int) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > most_pixels:
        raise ValueError("screen too large")
    at = 13

    def colours(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        if at + 3 * n > len(data):
            raise IndexError
        table = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return table

    def sub_blocks() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    common = colours(flags)
    canvas = np.zeros((height, width), "<u4")
    delay, disposal, transparent, time = 0, 0, None, 0
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            at += 1
            body = sub_blocks()
            if label == 0xF9:
                f, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = f >> 2 & 7, index if f & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at)
        at += 9
        own = colours(flags)
        palette = own if own is not None else common
        if palette is None:
            raise ValueError("no palette")
        if w * h > most_pixels:
            raise ValueError("image too large")
        bits = data[at]
        at += 1
        if not 1 <= bits <= 8:
            raise ValueError("code size")
        pixels = lzw_decode(sub_blocks(), bits, w * h)
        if len(pixels) < w * h:
            raise ValueError("too few pixels")
        image = np.frombuffer(pixels, np.uint8, w * h).reshape(h, w)
        if flags & 0x40:
            whole = np.empty_like(image)
            whole[_rows(h)] = image
            image = whole
        before = canvas.copy() if disposal == 3 else None
        part = canvas[top : top + h, left : left + w]
        drawn = image[: part.shape[0], : part.shape[1]]
        if len(palette) < 256 and drawn.size and int(np.where(drawn == transparent, 0, drawn).max() if transparent is not None else drawn.max()) >= len(palette):
            raise ValueError("index beyond the palette")
        ink = _words(palette) if len(palette) == 256 else np.append(_words(palette), np.zeros(256 - len(palette), "<u4"))
        if transparent is None:
            part[:] = ink[drawn]
        else:
            np.copyto(part, ink[drawn], where=drawn != transparent)
        yield Frame(image, palette, left, top, delay, disposal, transparent, time, canvas.copy())
        if disposal == 2:
            part[:] = 0
        elif disposal == 3:
            canvas = before
        time += delay
        delay, disposal, transparent = 0, 0, None


def histogram(shown: np.ndarray) -> np.ndarray:
    """Counts of 64 colour classes (the two high bits of red, green and blue) of the words that are not clear."""
    c = shown.reshape(-1)
    c = c[c >> 24 > 0] if (c >> 24 == 0).any() else c
    return np.bincount((c >> 2 & 48) | (c >> 12 & 12) | (c >> 22 & 3), minlength=64)


FRAME_FIELDS = [
    ("number", T.IntegerType()), ("time", T.IntegerType()), ("delay", T.IntegerType()), ("left", T.IntegerType()), ("top", T.IntegerType()), ("width", T.IntegerType()), ("height", T.IntegerType()),
    ("disposal", T.IntegerType()), ("transparent", T.IntegerType()), ("rgba", T.BinaryType()), ("histogram", T.ArrayType(T.LongType())), ("error", T.StringType()),
]


def timed(df: DataFrame, column: str = "media", most_pixels: int = MOST_PIXELS) -> DataFrame:
    """A row for each frame of each cell, with the columns of ``df``: its time, place and rules, the screen as it shows it (``__loom_rgba``) and the colours of that screen."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(OWN + n, t) for n, t in FRAME_FIELDS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = list(to_arrow_schema(schema))[-len(FRAME_FIELDS) :]
        for b in batches:
            names = pa.schema([*b.schema, *target])

            def rows(k: int, values: list[tuple]) -> pa.RecordBatch:
                whole = [pa.array(v, t.type) for v, t in zip(zip(*values), target)]
                return pa.RecordBatch.from_arrays([*[c.take(pa.array([k] * len(values))) for c in b.columns], *whole], schema=names)  # noqa: B023

            for k, cell in enumerate(b.column(b.schema.names.index(column))):
                held, number = [], 0
                try:
                    for f in _frames(cell.as_py(), most_pixels) if cell.is_valid and len(cell.as_py()) else ():
                        held.append((number, f.time, f.delay, f.left, f.top, f.pixels.shape[1], f.pixels.shape[0], f.disposal, f.transparent, f.shown.tobytes(), histogram(f.shown).tolist(), None))
                        number += 1
                        if sum(len(x[9]) for x in held) > 1 << 24:  # screens leave as they come
                            yield rows(k, held)
                            held = []
                except (ValueError, IndexError, struct.error) as e:
                    held.append((*[None] * 11, "cut off" if isinstance(e, (IndexError, struct.error)) else str(e)))
                    number += 1
                if held or not number:
                    yield rows(k, held or [(None,) * 12])

    return light(df).mapInArrow(run, schema)


def _runs(mask: np.ndarray, least: int) -> np.ndarray:
    """Where ``mask`` holds for ``least`` places or more on end; a flat array."""
    edge = np.flatnonzero(np.diff(mask, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    out = np.zeros(len(mask), bool)
    for a, b in zip(starts[ends - starts >= least].tolist(), ends[ends - starts >= least].tolist()):
        out[a:b] = True
    return out


def store(payload: bytes, width: int = WIDTH) -> bytes:
    """A payload of whole rows, of bytes below ``CLEAR``, as palette indices of a GIF, in frames of at most ``ROWS`` rows."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    if len(image) <= ROWS:
        return encode([Frame(image, PALETTE, delay=DELAY, disposal=DISPOSALS[0])], width, len(image))
    canvas, frames = np.full((ROWS, width), -1, np.int16), []
    for k in range(0, len(image), ROWS):
        part, disposal = image[k : k + ROWS], DISPOSALS[len(frames) % len(DISPOSALS)]
        same = _runs((canvas[: len(part)] == part).reshape(-1), RUN).reshape(part.shape)
        frames.append(Frame(np.where(same, CLEAR, part).astype(np.uint8), PALETTE, delay=DELAY, disposal=disposal, transparent=CLEAR))
        if disposal == 1:
            canvas[: len(part)] = part
        elif disposal == 2:
            canvas[: len(part)] = -1
    return encode(frames, width, ROWS)


#: For each pair of red and green, and of blue and alpha, the bits that they give to the index of ``PALETTE``.
_RED_GREEN = ((np.arange(1 << 16) & 255) // 36 << 5 | (np.arange(1 << 16) >> 8) // 36 << 2).astype(np.uint8)
_BLUE = ((np.arange(1 << 16) & 255) // 85).astype(np.uint8)


def taken_back(frames: list[Frame]) -> tuple[bytes, np.ndarray]:
    """The payload that the canvases show, and the colour classes of all of it."""
    payload, classes = [], np.zeros(64, np.int64)
    for f in frames:
        shown = np.ascontiguousarray(f.shown[f.top : f.top + f.pixels.shape[0], f.left : f.left + f.pixels.shape[1]])
        halves = shown.view("<u2").reshape(-1, 2)
        payload.append((_RED_GREEN[halves[:, 0]] | _BLUE[halves[:, 1]]).tobytes())
        classes += histogram(shown)
    return b"".join(payload), classes


def padded(text: bytes, width: int = WIDTH) -> bytes:
    return text.ljust(max(1, -(-len(text) // width)) * width, b" ")


#: Bytes of texts whose results a task remembers, for their copies.
REMEMBER = 16 << 20


def stored(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """Each text stored as a GIF, drawn and read back: ``doc_id``, the stored bytes (``media``) and what is known of either form."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, shown_for int, histogram array<long>, media binary"

    def row(text: bytes) -> tuple:
        media = store(padded(text))
        frames = decode(media)
        back, classes = taken_back(frames)
        return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), ",".join(map(str, classes.tolist())), len(frames), frames[-1].time + frames[-1].delay, classes.tolist(), media if with_media else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "shown_for", "histogram", "media"]
        known: dict[bytes, tuple] = {}
        held = 0
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part, rows = b.slice(k, 500), []
                for t in part.column(1).cast(pa.binary()):
                    text = t.as_py() or b""
                    found = known.get(text)
                    if found is None:
                        found = row(text)
                        held += len(text) + len(found[-1] or b"") + 1000
                        if held > REMEMBER:
                            known, held = {}, len(text) + 1000
                        known[text] = found
                    rows.append(found)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], names=names)

    return light(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
