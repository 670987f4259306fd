"""FITS images and tables: header blocks, pixel decoding, compressed tiles, table encoding."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import numpy as np

from . import rice

BLOCK, CARD = 2880, 80
PIXEL = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}  # BITPIX
WCS_KEYS = ("CRPIX1", "CRPIX2", "CRVAL1", "CRVAL2", "CD1_1", "CD1_2", "CD2_1", "CD2_2")


class FitsError(ValueError):
    """``kind`` is ``io``, ``fits``, ``no_image`` or ``bad_shape``."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def _value(text: str):
    text = text.strip()
    if text.startswith("'"):
        body, i = [], 1
        while i < len(text):
            if text[i] == "'":
                if text[i + 1 : i + 2] != "'":
                    break
                i += 1
            body.append(text[i])
            i += 1
        return "".join(body).rstrip()
    text = text.partition("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    for kind in (int, lambda x: float(x.upper().replace("D", "E"))):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def header(data: bytes, at: int) -> tuple[dict, int]:
    """Cards from ``at`` on and where the data start."""
    cards: dict = {}
    while True:
        if at + BLOCK > len(data):
            raise FitsError("fits", "header without END")
        block = data[at : at + BLOCK].decode("latin-1")
        at += BLOCK
        for i in range(0, BLOCK, CARD):
            name, card = block[i : i + 8].strip(), block[i : i + CARD]
            if name == "END":
                return cards, at
            if card[8:10] == "= ":
                cards.setdefault(name, _value(card[10:]))


def hdus(data: bytes) -> Iterator[tuple[dict, int, int]]:
    """``(cards, data start, data bytes)`` of every unit."""
    at = 0
    while at < len(data):
        h, start = header(data, at)
        n = h.get("NAXIS", 0)
        cells = 1 if n else 0
        for k in range(1, n + 1):
            cells *= h.get(f"NAXIS{k}", 0)
        size = abs(h.get("BITPIX", 8)) // 8 * h.get("GCOUNT", 1) * (h.get("PCOUNT", 0) + cells)
        yield h, start, size
        at = start + -(-size // BLOCK) * BLOCK


def wcs(h: dict) -> dict | None:
    """The eight linear terms; all or nothing."""
    v = [h.get(k) for k in WCS_KEYS]
    if any(not isinstance(x, (int, float)) or isinstance(x, bool) for x in v):
        return None
    return {k.lower(): float(x) for k, x in zip(WCS_KEYS, v)}


def read_image(data: bytes) -> tuple[np.ndarray, dict | None]:
    """First usable image of a file as float32 rows, and its coordinates."""
    if len(data) < BLOCK or not data.startswith(b"SIMPLE"):
        raise FitsError("fits", "not a FITS file")
    for h, start, size in hdus(data):
        kind = h.get("XTENSION", "IMAGE")
        if kind == "IMAGE":
            n = [h.get(f"NAXIS{k}", 0) for k in range(1, h.get("NAXIS", 0) + 1)]
            if len(n) < 2 or not n[0] or not n[1]:
                continue
            return _plain(h, data[start : start + size], n), wcs(h)
        if kind == "BINTABLE":
            nc, nr = h.get("ZNAXIS1"), h.get("ZNAXIS2")
            if isinstance(nc, int) and isinstance(nr, int) and nc > 0 and nr > 0:
                return _tiles(h, data[start : start + size], nr, nc), wcs(h)
    raise FitsError("no_image", "no image in the file")


def _scaled(h: dict, x: np.ndarray, prefix: str = "") -> np.ndarray:
    blank, scale, zero = h.get(prefix + "BLANK"), h.get("BSCALE", 1), h.get("BZERO", 0)
    y = x.astype(np.float64) * scale + zero
    if blank is not None and x.dtype.kind in "iu":
        y[x == blank] = np.nan
    return y.astype(np.float32)


def _plain(h: dict, raw: bytes, n: list[int]) -> np.ndarray:
    bitpix = h.get("BITPIX")
    if bitpix not in PIXEL:
        raise FitsError("fits", f"BITPIX {bitpix}")
    x = np.frombuffer(raw, PIXEL[bitpix])
    if len(x) != n[0] * n[1]:
        raise FitsError("bad_shape", f"{len(x)} pixels for {n[1]} x {n[0]}")
    return _scaled(h, x.astype(x.dtype.newbyteorder("="))).reshape(n[1], n[0])


def dither_table(n: int = 10_000) -> np.ndarray:
    """The random numbers of subtractive dithering: a linear congruential generator, by the convention."""
    out, seed = np.empty(n), 1
    for i in range(n):
        seed = 16807 * seed % 2147483647
        out[i] = seed / 2147483647
    return out


_DITHER: list[np.ndarray] = []
FORMAT_BYTES = {"L": 1, "X": 1, "B": 1, "I": 2, "J": 4, "K": 8, "A": 1, "E": 4, "D": 8, "C": 8, "M": 16, "P": 8, "Q": 16}


def columns(h: dict) -> dict[str, tuple[int, str, int]]:
    """Name to (offset in a row, format letter, repeat)."""
    out, at = {}, 0
    for k in range(1, h.get("TFIELDS", 0) + 1):
        form = str(h[f"TFORM{k}"])
        digits = len(form) - len(form.lstrip("0123456789"))
        repeat, letter = int(form[:digits] or 1), form[digits]
        out[str(h.get(f"TTYPE{k}", f"COL{k}")).strip()] = (at, letter, repeat)
        at += -(-repeat // 8) if letter == "X" else repeat * FORMAT_BYTES[letter]
    return out


def _tiles(h: dict, raw: bytes, nr: int, nc: int) -> np.ndarray:
    """A tile-compressed image."""
    width, rows = h["NAXIS1"], h["NAXIS2"]
    heap = h.get("THEAP", width * rows)
    cols = columns(h)
    th, tw = h.get("ZTILE2", 1), h.get("ZTILE1", nc)
    kind, zbit = str(h.get("ZCMPTYPE", "RICE_1")).strip(), h.get("ZBITPIX", -32)
    names = {str(h.get(f"ZNAME{k}", "")).strip(): h.get(f"ZVAL{k}") for k in range(1, 10)}
    out = np.full((nr, nc), np.nan, np.float32)
    across = -(-nc // tw)
    if rows != across * -(-nr // th):
        raise FitsError("bad_shape", f"{rows} tiles for {nr} x {nc}")

    def cell(name: str, row: int, default):
        if name not in cols:
            return h.get(name, default)
        at, letter, _ = cols[name]
        at += row * width
        return np.frombuffer(raw, {"E": ">f4", "D": ">f8", "J": ">i4", "I": ">i2"}[letter], 1, at)[0]

    def stream(name: str, row: int) -> bytes:
        if name not in cols:
            return b""
        at, letter, _ = cols[name]
        n, off = np.frombuffer(raw, ">i4" if letter == "P" else ">i8", 2, at + row * width)
        # the element size of a variable-length column follows its letter, bytes here
        return raw[heap + off : heap + off + n]

    size, block = names.get("BYTEPIX") or 4, names.get("BLOCKSIZE") or 32
    packed: dict[int, list[int]] = {}  # RICE tiles by their number of pixels, decoded together
    streams = [stream("COMPRESSED_DATA", t) for t in range(rows)]

    def place(t: int) -> tuple[int, int, int, int]:
        r0, c0 = t // across * th, t % across * tw
        return r0, c0, min(th, nr - r0), min(tw, nc - c0)

    def fill(t: int, x: np.ndarray) -> None:
        r0, c0, hh, ww = place(t)
        out[r0 : r0 + hh, c0 : c0 + ww] = np.asarray(x, np.float32).reshape(hh, ww)

    for t, data in enumerate(streams):
        _, _, hh, ww = place(t)
        count = hh * ww
        if not data and (data := stream("GZIP_COMPRESSED_DATA", t)):
            fill(t, np.frombuffer(_unzip(data), PIXEL[zbit], count).astype(np.float64))
        elif kind in ("RICE_1", "RICE_ONE"):
            packed.setdefault(count, []).append(t)
        elif kind == "GZIP_1":
            form = PIXEL[zbit] if zbit > 0 or "ZSCALE" not in cols else ">i4"
            x = np.frombuffer(_unzip(data), form, count)
            fill(t, _unquantised(h, x.astype(x.dtype.newbyteorder("=")), cell, t, zbit))
        else:
            raise FitsError("fits", f"compression {kind}")
    for count, some in packed.items():
        for i in range(0, len(some), rice.TILES):
            part = some[i : i + rice.TILES]
            try:
                values = rice.decode_tiles([streams[t] for t in part], count, block, size)
            except rice.RiceError as e:
                raise FitsError("fits", str(e)) from e
            for t, x in zip(part, values):
                fill(t, _unquantised(h, x, cell, t, zbit))
    return out


def _unzip(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else zlib.decompress(data)


def _unquantised(h: dict, x: np.ndarray, cell, tile: int, zbit: int) -> np.ndarray:
    if zbit > 0:
        return _scaled(h, x, "Z")
    if x.dtype.kind == "f":
        return x
    scale, zero, blank = float(cell("ZSCALE", tile, 1.0)), float(cell("ZZERO", tile, 0.0)), cell("ZBLANK", tile, None)
    method = str(h.get("ZQUANTIZ", "NO_DITHER")).strip()
    if method.startswith("SUBTRACTIVE_DITHER"):
        if not _DITHER:
            _DITHER.append(dither_table())
        table = _DITHER[0]
        row = (tile + int(h.get("ZDITHER0", 1)) - 1) % len(table)
        # each tile starts at its own place; at the table's end the next row's place follows
        noise, at, left = [], int(table[row] * 500), len(x)
        while left > 0:
            part = table[at : at + left]
            noise.append(part)
            left -= len(part)
            row = (row + 1) % len(table)
            at = int(table[row] * 500)
        y = (x - np.concatenate(noise) + 0.5) * scale + zero
        if method == "SUBTRACTIVE_DITHER_2":
            y[x == -2147483646] = 0.0
    else:
        y = x * scale + zero
    y[x == (-2147483647 if blank is None else blank)] = np.nan
    return y


# ---------------------------------------------------------------- writing


def card(name: str, value=None, comment: str = "") -> bytes:
    """One 80-byte card: value to column 30 (strings from column 11), then a comment if there is one."""
    if value is None:
        text = name
    else:
        shown = f"{'T' if value else 'F':>20}" if isinstance(value, bool) else f"{value!r:>20}" if isinstance(value, (int, float)) else f"'{value:<8}'"
        text = f"{name:<8}= {shown:<20} / {comment}" if comment else f"{name:<8}= {shown}"
    return text.encode("ascii", "replace")[:CARD].ljust(CARD)


def header_block(cards: list[bytes]) -> bytes:
    data = b"".join([*cards, card("END")])
    return data.ljust(-(-len(data) // BLOCK) * BLOCK)


def write_image(x: np.ndarray, bitpix: int, coords: dict | None = None, extra: list[bytes] = (), leading_empty: bool = False) -> bytes:
    """A plain image file."""
    cards = [card("BITPIX", bitpix), card("NAXIS", x.ndim), *[card(f"NAXIS{k + 1}", n) for k, n in enumerate(reversed(x.shape))]]
    cards += [card(k.upper(), float(v)) for k, v in (coords or {}).items()] + list(extra)
    data = x.astype(PIXEL[bitpix]).tobytes()
    data += b"\0" * (-len(data) % BLOCK)
    if leading_empty:
        return header_block([card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0), card("EXTEND", True)]) + header_block([card("XTENSION", "IMAGE"), *cards, card("PCOUNT", 0), card("GCOUNT", 1)]) + data
    return header_block([card("SIMPLE", True), *cards]) + data


def write_rice_image(x: np.ndarray, coords: dict | None = None, scale: float | None = None) -> bytes:
    """A tile-compressed image, a tile a row: integers, or floats quantised by ``scale`` without dithering."""
    nr, nc = x.shape
    bad = ~np.isfinite(x)
    ints = np.where(bad, 0, np.round(x / scale) if scale else x).astype(np.int64)
    if scale:
        ints[bad] = -2147483647
    tiles = [rice.encode(row) for row in ints]
    off = np.cumsum([0, *map(len, tiles)])
    table = np.zeros(nr, [("n", ">i4"), ("o", ">i4"), ("s", ">f8"), ("z", ">f8")])
    table["n"], table["o"], table["s"] = [len(t) for t in tiles], off[:-1], scale or 1.0
    cards = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", 24), card("NAXIS2", nr), card("PCOUNT", int(off[-1])), card("GCOUNT", 1), card("TFIELDS", 3)]
    for k, (name, form) in enumerate((("COMPRESSED_DATA", "1PB"), ("ZSCALE", "1D"), ("ZZERO", "1D")), 1):
        cards += [card(f"TTYPE{k}", name), card(f"TFORM{k}", form)]
    cards += [card("ZIMAGE", True), card("ZBITPIX", -32 if scale else 32), card("ZNAXIS", 2), card("ZNAXIS1", nc), card("ZNAXIS2", nr), card("ZTILE1", nc), card("ZTILE2", 1), card("ZCMPTYPE", "RICE_1"), card("ZNAME1", "BLOCKSIZE"), card("ZVAL1", 32), card("ZNAME2", "BYTEPIX"), card("ZVAL2", 4)]
    cards += [card(k.upper(), float(v)) for k, v in (coords or {}).items()]
    data = table.tobytes() + b"".join(tiles)
    return header_block([card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0), card("EXTEND", True)]) + header_block(cards) + data + b"\0" * (-len(data) % BLOCK)


#: Fixed values of the catalog format: column, format, unit; then the catalog field and numpy type.
CATALOG = (
    ("RA", "1D", "deg", "ra", ">f8"), ("DEC", "1D", "deg", "dec", ">f8"), ("X_IMAGE", "1D", "pix", "x", ">f8"), ("Y_IMAGE", "1D", "pix", "y", ">f8"),
    ("FLUX_ISO", "1E", "nmg", "flux_iso", ">f4"), ("FLUX_AUTO", "1E", "nmg", "flux_auto", ">f4"), ("A_IMAGE", "1E", "pix", "a", ">f4"), ("B_IMAGE", "1E", "pix", "b", ">f4"),
    ("THETA", "1E", "deg", "theta", ">f4"), ("ELLIP", "1E", "", "ellipticity", ">f4"), ("KRON_RAD", "1E", "", "kron_radius", ">f4"), ("NPIX", "1J", "pix", "npix", ">i4"), ("FLAGS", "1I", "", "flags", ">i2"),
)


def table_dtype(multi: bool) -> np.dtype:
    return np.dtype([("BRICK", "S12")] * multi + [(n, t) for n, _, _, _, t in CATALOG])


def table_rows(rows, multi: bool) -> bytes:
    """Rows (with attribute or item access by field name through ``get``) as table bytes."""
    out = np.zeros(len(rows), table_dtype(multi))
    if multi:
        out["BRICK"] = [str(r["brick"]).encode("utf-8")[:12].ljust(12) for r in rows]
    for name, _, _, field, kind in CATALOG:
        out[name] = [np.nan if r[field] is None else r[field] for r in rows] if kind[1] == "f" else [r[field] for r in rows]
    return out.tobytes()


def table_header(n: int, multi: bool, band: str, brick: str = "") -> bytes:
    first = [card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", 0), card("EXTEND", True), card("ORIGIN", "skyframe"), card("FILTER", band)]
    cols = ([("BRICK", "12A", "")] if multi else []) + [c[:3] for c in CATALOG]
    cards = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", table_dtype(multi).itemsize, "Bytes in a row"), card("NAXIS2", n, "Rows"), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(cols))]
    if not multi:
        first.append(card("OBJECT", brick, "Brick"))
        cards.append(card("OBJECT", brick, "Brick"))
    cards.append(card("FILTER", band))
    for k, (name, form, unit) in enumerate(cols, 1):
        cards += [card(f"TTYPE{k}", name), card(f"TFORM{k}", form)] + ([card(f"TUNIT{k}", unit)] if unit else [])
    return header_block(first) + header_block(cards)


def read_table(data: bytes) -> np.ndarray:
    """The catalog table of a file."""
    for h, start, _ in hdus(data):
        if h.get("XTENSION") == "BINTABLE":
            return np.frombuffer(data, table_dtype("BRICK" in columns(h)), h["NAXIS2"], start)
    raise FitsError("no_image", "no table in the file")
