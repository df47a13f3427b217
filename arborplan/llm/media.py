"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, utf8

WIDTH = 192
#: Rows of a frame; a longer payload goes on in further frames.
ROWS = 65535
#: Codes after a clear code while nine bits are enough: a 256-colour stream stays at nine bits for 254 codes.
LITERALS = 254
DELAY_CS = 10
BINS = 8


def _bits9(codes: np.ndarray) -> bytes:
    """Nine-bit codes, least significant bit first, in bytes."""
    bits = np.unpackbits(codes.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")[:, :9]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def lzw_literal(indices: np.ndarray) -> bytes:
    """A valid 8-bit LZW stream in which each code stands for one sample, with a clear code before the codes would widen."""
    out = []
    step = LITERALS * 4096 * 8  # a multiple of eight codes, so parts end on a byte
    for at in range(0, max(1, len(indices)), step):
        part = indices[at : at + step]
        whole = len(part) // LITERALS
        grid = np.full((whole, LITERALS + 1), 256, np.uint16)
        grid[:, 1:] = part[: whole * LITERALS].reshape(whole, LITERALS)
        rest = part[whole * LITERALS :].astype(np.uint16)
        codes = [grid.ravel()] + ([np.array([256], np.uint16), rest] if len(rest) or not whole else [])
        if at + step >= len(indices):
            codes.append(np.array([256, 257], np.uint16) if len(rest) == 0 else np.array([257], np.uint16))
        out.append(_bits9(np.concatenate(codes)))
    return b"".join(out)


def lzw_packed(indices: bytes, least: int = 8) -> bytes:
    """A compressed LZW stream, one sample after another: for small images and as a partner for the reader in tests."""
    clear, stop = 1 << least, (1 << least) + 1
    acc = n_acc = 0
    out, width = bytearray(), least + 1
    table: dict[bytes, int] = {bytes([i]): i for i in range(clear)}

    def put(code: int) -> None:
        nonlocal acc, n_acc
        acc |= code << n_acc
        n_acc += width
        while n_acc >= 8:
            out.append(acc & 255)
            acc >>= 8
            n_acc -= 8

    put(clear)
    nxt, held = stop + 1, b""
    for x in indices:
        longer = held + bytes([x])
        if longer in table:
            held = longer
            continue
        put(table[held])
        if nxt < 4096:
            table[longer] = nxt
            nxt += 1
            if nxt - 1 == 1 << width and width < 12:
                width += 1
        else:
            put(clear)
            table = {bytes([i]): i for i in range(clear)}
            nxt, width = stop + 1, least + 1
        held = bytes([x])
    if held:
        put(table[held])
        if nxt == 1 << width and width < 12:
            width += 1
    put(stop)
    if n_acc:
        out.append(acc & 255)
    return bytes(out)


def lzw_read(data: bytes, least: int, want: int) -> bytes:
    """The samples of an LZW code stream, at most `want`.

    Runs of plain literals after a clear code are read as an array; everything else code by code. A stream that
    ends early gives what it has; a code that no table entry has raises ValueError.
    """
    clear, stop = 1 << least, (1 << least) + 1
    base = least + 1
    head = (1 << base) - stop - 1  # codes after a clear code before they widen
    weights = (1 << np.arange(base)).astype(np.int32)
    out = bytearray()
    n_bits, at = len(data) * 8, 0
    window, w_from, w_to = np.zeros(0, np.uint8), 0, 0

    def bits(a: int, b: int) -> np.ndarray:
        nonlocal window, w_from, w_to
        if not (w_from <= a and b <= w_to):
            w_from = a // 8 * 8
            w_to = min(n_bits, max(b, w_from + (1 << 20)))
            w_to = min(n_bits, -(-w_to // 8) * 8)
            window = np.unpackbits(np.frombuffer(data, np.uint8, (w_to - w_from) // 8, w_from // 8), bitorder="little")
        return window[a - w_from : b - w_from]

    entries: list[bytes] = []
    plain = [bytes([i]) for i in range(clear)]
    width, prev = base, None
    fresh = True
    while at + width <= n_bits and len(out) < want:
        if fresh:
            n = min(head + 1, (n_bits - at) // base)
            codes = bits(at, at + n * base).reshape(n, base) @ weights
            special = np.flatnonzero(codes >= clear)
            stops = int(special[0]) if len(special) else n
            if stops < n and codes[stops] == clear:
                out += codes[:stops].astype(np.uint8).tobytes()
                at += (stops + 1) * base
                prev = None
                continue
            if stops < n and codes[stops] == stop:
                out += codes[:stops].astype(np.uint8).tobytes()
                break
            fresh, entries, width, prev = False, [], base, None
        code = int.from_bytes(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7) & ((1 << width) - 1)
        at += width
        if code == clear:
            fresh, prev, entries, width = True, None, [], base
            continue
        if code == stop:
            break
        if code < clear:
            now = plain[code]
        elif code - stop - 1 < len(entries):
            now = entries[code - stop - 1]
        elif prev is not None and code - stop - 1 == len(entries) and len(entries) + stop + 1 < 4096:
            now = prev + prev[:1]
        else:
            raise ValueError("LZW code without an entry")
        if prev is not None and len(entries) + stop + 1 < 4096:
            entries.append(prev + now[:1])
        if len(entries) + stop + 1 == 1 << width and width < 12:
            width += 1
        out += now
        prev = now
    return bytes(out[:want])


def _sub_blocks(data: bytes) -> bytes:
    whole = len(data) // 255
    grid = np.full((whole, 256), 255, np.uint8)
    grid[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return grid.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


@dataclass
class Frame:
    """One image of a GIF: its place, samples, palette, and what becomes of it. interlaced is undone already."""

    left: int
    top: int
    width: int
    height: int
    indices: np.ndarray
    palette: np.ndarray
    delay_cs: int = DELAY_CS
    disposal: int = 0
    transparent: int | None = None


def grey_palette() -> np.ndarray:
    return np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


def write_gif(width: int, height: int, frames: list[Frame], pack: bool = False) -> bytes:
    """GIF89a with a palette for each frame that differs from the grey one."""
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), bytes([0xF7, 0, 0]), grey_palette().tobytes()]
    for f in frames:
        own = not np.array_equal(f.palette, grey_palette())
        colours = np.zeros((256, 3), np.uint8)
        colours[: len(f.palette)] = f.palette
        out.append(b"\x21\xf9\x04" + bytes([f.disposal << 2 | (f.transparent is not None)]) + f.delay_cs.to_bytes(2, "little") + bytes([f.transparent or 0, 0]))
        out.append(b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (f.left, f.top, f.width, f.height)) + bytes([0x87 if own else 0]))
        out += [colours.tobytes()] if own else []
        flat = f.indices.astype(np.uint8).ravel()
        out.append(b"\x08" + _sub_blocks(lzw_packed(flat.tobytes()) if pack else lzw_literal(flat)))
    return b"".join(out) + b"\x3b"


def read_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """Canvas size and frames of a GIF87a or GIF89a; ValueError if it is none or is cut short before its first image ends."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    at, common, frames = 13, None, []
    delay, disposal, transparent = 0, 0, None

    def colours(flags: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flags & 7)
        got = np.frombuffer(data[at : at + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(n, 3)
        at += 3 * n
        return got

    def payload() -> bytes:
        nonlocal at
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        at += 1
        return b"".join(parts)

    if flags & 0x80:
        common = colours(flags)
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = data[at]
            at += 1
            body = payload()
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                transparent = body[3] if body[0] & 1 else None
        elif kind == 0x2C:
            left, top, w, h = (int.from_bytes(data[at + 2 * i : at + 2 * i + 2], "little") for i in range(4))
            own = data[at + 8]
            at += 9
            palette = colours(own) if own & 0x80 else common if common is not None else grey_palette()
            least = data[at]
            at += 1
            samples = lzw_read(payload(), least, w * h)
            grid = np.frombuffer(samples.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            if own & 0x40:  # interlaced: rows 0, 8, ..; 4, 12, ..; 2, 6, ..; 1, 3, ..
                order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
                straight = np.empty_like(grid)
                straight[order] = grid
                grid = straight
            frames.append(Frame(left, top, w, h, grid, palette, delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("broken GIF")
    return width, height, frames


def composed(width: int, height: int, frames: list[Frame]) -> Iterator[tuple[int, np.ndarray]]:
    """(start in ms, RGBA canvas) of each frame, by the disposal and transparency rules."""
    canvas = np.zeros((height, width, 4), np.uint8)
    clock = 0
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        bottom, right = min(height, f.top + f.height), min(width, f.left + f.width)
        grid = f.indices[: max(0, bottom - f.top), : max(0, right - f.left)]
        full = np.zeros((256, 3), np.uint8)
        full[: len(f.palette)] = f.palette
        seen = np.ones(grid.shape, bool) if f.transparent is None else grid != f.transparent
        area = canvas[f.top : bottom, f.left : right]
        area[seen] = np.concatenate((full[grid], np.full((*grid.shape, 1), 255, np.uint8)), axis=2)[seen]
        yield clock, canvas.copy()
        clock += f.delay_cs * 10
        if f.disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before


def histogram(rgba: np.ndarray, bins: int = BINS) -> list[int]:
    """Counts of red, green and blue values of the visible pixels in equal bins, one colour after another."""
    seen = rgba[rgba[..., 3] > 0]
    return [int(x) for c in range(3) for x in np.bincount(seen[:, c] // (256 // bins), minlength=bins)]


_FRAMES = "id string, ok boolean, frame int, start_ms long, delay_ms long, width int, height int, histogram array<long>, rgba_sha256 string"


def gif_frames(media: DataFrame, id_col: str = "id", content_col: str = "content") -> DataFrame:
    """A row for each frame of each GIF; what is null, empty or no GIF gives one row with ok false. Ids come as strings; repeated rows each count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    w, h, frames = read_gif(data or b"")
                    for i, (f, (start, rgba)) in enumerate(zip(frames, composed(w, h, frames), strict=True)):
                        rows.append((key, True, i, start, f.delay_cs * 10, w, h, histogram(rgba), hashlib.sha256(rgba.tobytes()).hexdigest()))
                except (ValueError, IndexError):
                    rows = []
                rows = rows or [(key, False, None, None, None, None, None, None, None)]
                kinds = [pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _FRAMES.split(", ")])

    return media.select(F.col(id_col).cast("string").alias("id"), F.col(content_col).alias("content")).mapInArrow(run, _FRAMES)


def store_bytes(payload: bytes) -> bytes:
    """A payload whose length is a positive multiple of WIDTH as the samples of a grey GIF, WIDTH to a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames = [Frame(0, 0, WIDTH, len(p := rows[i : i + ROWS]), p, grey_palette(), disposal=2) for i in range(0, len(rows), ROWS)]
    return write_gif(WIDTH, min(ROWS, len(rows)), frames)


def padded(raw: bytes) -> bytes:
    return raw + b" " * (WIDTH - len(raw) if not raw else -len(raw) % WIDTH)


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Every whole text stored as a GIF and read back, with features of its frames (with keep_media also the GIF itself).

    The stored stream has one code per sample, which any GIF reader takes; it is an eighth larger than the payload.
    Null and empty texts become one row of blanks. Equal texts have equal values; repeated rows each get a row; very long texts go on in further frames;
    other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                media = store_bytes(padded(raw))
                w, h, frames = read_gif(media)
                back = b"".join(f.indices.tobytes() for f in frames)
                # Each frame as it is shown, one canvas at a time; in grey frames the three colours' counts are alike.
                hist = sum(np.array(histogram(rgba)[:BINS]) for _, rgba in composed(w, h, frames))
                feature = f"gif;{w}x{h};frames={len(frames)};ms={sum(f.delay_cs for f in frames) * 10};grey={','.join(map(str, hist.tolist()))}"
                rows.append((doc_id, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature) + ((media,) if keep_media else ()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * keep_media
            names = [x.split()[0] for x in _DIGEST.split(", ")] + ["media"] * keep_media
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select("doc_id", utf8().alias("t")).mapInArrow(run, _DIGEST + ", media binary" * keep_media)


def op7_gif_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(documents(spark, sf_dir))
