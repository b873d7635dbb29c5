"""Progressive JPEG: scans accumulate into coefficient arrays; the inverse transform is numpy.

The decoder reads DC and AC scans, first passes and refinements, interleaved or
not, with any sampling factors of 1 or 2, into one int16 coefficient array a
component.  Scans whose bits have a fixed layout (every DC difference zero, every
coefficient of the band already non-zero) are decoded as whole bit arrays; any
other scan goes through the symbol decoder.  The encoder writes such scans, so a
payload of bytes held in coefficients costs 9 bits a byte and no symbol loop.

A payload byte b is an AC coefficient of magnitude 128 + (b mod 128), negative
from 128 up; DC stays 0.  Quantisation is 1, so coefficients come back exactly;
they are the unit in which the storage is lossless.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

#: The zigzag order of an 8 x 8 block, from its rule.
ZIGZAG = np.array(
    sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)), np.int64
)
SAMPLING = ((2, 2), (1, 1), (1, 1))
UNIT_BLOCKS = 6
UNIT_BYTES = UNIT_BLOCKS * 63
MOST_WIDE = 4095  # units of 16 pixels
#: Bands of each component: first and last coefficient in zigzag order.
BANDS = ((0, 1, 5), (0, 6, 63), (1, 1, 63), (2, 1, 63))
DC_CODE, FIRST_CODE, REFINE_CODE = 0, 0, 1


def cosine_basis(scale: int = 1 << 13) -> np.ndarray:
    """Integer 64 x 64 inverse transform, zigzag coefficient to pixel; sums of it are exact in float64."""
    k, x = np.arange(8)[:, None], np.arange(8)[None]
    one = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.5), 1) / 2
    return np.round(np.kron(one, one)[ZIGZAG] * scale)


BASIS_SCALE = 1 << 13
BASIS = cosine_basis(BASIS_SCALE)


# ---------------------------------------------------------------- bits and markers


def to_stream(bits: np.ndarray) -> bytes:
    """Bits to entropy-coded bytes: padded with ones, every 255 followed by 0."""
    padded = np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])
    return np.packbits(padded).tobytes().replace(b"\xff", b"\xff\x00")


def from_stream(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman(kind: int, slot: int, codes: dict[int, list[int]]) -> bytes:
    counts = bytes(len(codes.get(n, ())) for n in range(1, 17))
    return segment(0xC4, bytes([kind << 4 | slot]) + counts + bytes(s for n in sorted(codes) for s in codes[n]))


def scan_header(parts: list[tuple[int, int, int]], first: int, last: int, high: int, low: int) -> bytes:
    body = bytes([len(parts)]) + b"".join(bytes([c, dc << 4 | ac]) for c, dc, ac in parts)
    return segment(0xDA, body + bytes([first, last, high << 4 | low]))


# ---------------------------------------------------------------- encoding


def grid(units: int) -> tuple[int, int]:
    wide = min(units, MOST_WIDE)
    return wide, -(-units // wide)


def block_order(wide: int, tall: int) -> np.ndarray:
    """Of the luma plane: position in raster order of every block in unit order."""
    unit = np.arange(wide * tall)
    row, col = unit // wide, unit % wide
    y, x = (2 * row)[:, None] + np.array([0, 0, 1, 1]), (2 * col)[:, None] + np.array([0, 1, 0, 1])
    return (y * (2 * wide) + x).reshape(-1)


def coefficients_of(payload: bytes) -> tuple[list[np.ndarray], int, int]:
    """AC coefficients of each component, blocks in raster order, and the grid of units."""
    wide, tall = grid(max(1, -(-len(payload) // UNIT_BYTES)))
    if tall > MOST_WIDE:
        raise ValueError("the payload is larger than one image can hold")
    data = np.full(wide * tall * UNIT_BYTES, 255, np.uint8)
    data[: len(payload)] = np.frombuffer(payload, np.uint8)
    value = data.astype(np.int16).reshape(-1, UNIT_BLOCKS, 63)
    value = np.where(value < 128, value + 128, -value)
    luma = np.empty((wide * tall * 4, 63), np.int16)
    luma[block_order(wide, tall)] = value[:, :4].reshape(-1, 63)
    return [luma, value[:, 4], value[:, 5]], wide, tall


HEAD = segment(0xDB, b"\0" + b"\1" * 64)
CODES = (
    huffman(0, DC_CODE, {1: [0]})  # a DC difference of zero: one bit
    + huffman(1, FIRST_CODE, {1: [7]})  # run 0, size 7: one bit, then seven
    + huffman(1, REFINE_CODE, {1: [14 << 4], 2: [0]} | {i + 2: [i << 4] for i in range(1, 14)})  # ends of band
)
ALL_PARTS = [(c + 1, DC_CODE, 0) for c in range(3)]


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload; its length is in a comment segment."""
    planes, wide, tall = coefficients_of(payload)
    frame = struct.pack(">BHHB", 8, tall * 16, wide * 16, 3)
    frame += b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(SAMPLING))
    out = [b"\xff\xd8", segment(0xFE, b"bytes=%d" % len(payload)), HEAD, segment(0xC2, frame), CODES]
    level = to_stream(np.zeros(wide * tall * UNIT_BLOCKS, np.uint8))
    out += [scan_header(ALL_PARTS, 0, 0, 0, 1), level, scan_header(ALL_PARTS, 0, 0, 1, 0), level]
    for c, first, last in BANDS:
        band = planes[c][:, first - 1 : last]
        # a code bit 0, then the seven bits of the value without its lowest bit, inverted where negative
        size = np.abs(band)
        seven = np.where(band > 0, size >> 1, (size >> 1) ^ 127).astype(np.uint8)
        out += [scan_header([(c + 1, 0, FIRST_CODE)], first, last, 0, 1), to_stream(np.unpackbits(seven))]
        out += [scan_header([(c + 1, 0, REFINE_CODE)], first, last, 1, 0), to_stream(refinement(size & 1))]
    return b"".join([*out, b"\xff\xd9"])


def end_of_band(blocks: int) -> np.ndarray:
    """The code and extra bits of an end-of-band run over ``blocks`` blocks."""
    power = blocks.bit_length() - 1
    code = "0" if power == 14 else "10" if power == 0 else "1" * (power + 1) + "0"
    extra = format(blocks - (1 << power), f"0{power}b") if power else ""
    return np.array([int(b) for b in code + extra], np.uint8)


def refinement(bits: np.ndarray) -> np.ndarray:
    """Nothing new becomes non-zero: end-of-band runs, each followed by one bit a coefficient."""
    parts, most = [], (1 << 15) - 1
    for at in range(0, len(bits), most):
        part = bits[at : at + most]
        parts += [end_of_band(len(part)), part.reshape(-1).astype(np.uint8)]
    return np.concatenate(parts)


# ---------------------------------------------------------------- decoding


class Component:
    def __init__(self, ident: int, h: int, v: int, table: int) -> None:
        self.ident, self.h, self.v, self.table = ident, h, v, table
        self.blocks = np.zeros((0, 64), np.int16)
        self.wide = self.tall = self.own_wide = self.own_tall = 0


class Image:
    """What the markers of one file say, with coefficients filled in by its scans."""

    def __init__(self, data: bytes) -> None:
        self.comment, self.quantisers, self.codes = b"", {}, {}
        self.components: list[Component] = []
        self.width = self.height = self.restart = 0
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        at = 2
        while at < len(data):
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker = data[at + 1]
            if marker == 0xD9:
                break
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xFE:
                self.comment = body
            elif marker == 0xDB:
                self.read_quantisers(body)
            elif marker == 0xC4:
                self.read_codes(body)
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xC2:
                self.read_frame(body)
            elif marker in (0xC0, 0xC1):
                raise ValueError("a sequential file; only progressive ones are read")
            elif marker == 0xDA:
                end = at
                while True:
                    end = data.find(b"\xff", end)
                    if end < 0:
                        raise ValueError("the file ends inside a scan")
                    if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                        end += 2
                        continue
                    break
                self.read_scan(body, data[at:end])
                at = end

    def read_quantisers(self, body: bytes) -> None:
        while body:
            wide, slot = body[0] >> 4, body[0] & 15
            n = 128 if wide else 64
            self.quantisers[slot] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else "u1").astype(np.int32)
            body = body[1 + n :]

    def read_codes(self, body: bytes) -> None:
        while body:
            n = 17 + sum(body[1:17])
            self.codes[body[0] >> 4, body[0] & 15] = code_table(body[1:n])
            body = body[n:]

    def read_frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        self.components = [Component(*(x := body[6 + 3 * i : 9 + 3 * i])[:1], x[1] >> 4, x[1] & 15, x[2]) for i in range(n)]
        self.h, self.v = max(c.h for c in self.components), max(c.v for c in self.components)
        self.units_wide, self.units_tall = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.components:
            c.wide, c.tall = self.units_wide * c.h, self.units_tall * c.v
            c.own_wide = -(-(-(-self.width * c.h // self.h)) // 8)
            c.own_tall = -(-(-(-self.height * c.v // self.v)) // 8)
            c.blocks = np.zeros((c.wide * c.tall, 64), np.int16)

    def read_scan(self, head: bytes, data: bytes) -> None:
        n = head[0]
        parts = [(next(c for c in self.components if c.ident == head[1 + 2 * i]), head[2 + 2 * i]) for i in range(n)]
        first, last, step = head[1 + 2 * n : 4 + 2 * n]
        scan = Scan(self, parts, first, last, step >> 4, step & 15)
        if self.restart:
            scan.slow(data)
        else:
            bits = from_stream(data)
            if not scan.whole(bits):
                scan.slow(data)


@lru_cache(256)
def code_table(spec: bytes) -> dict[tuple[int, int], int]:
    """(length, code) to symbol, from the counts by length and the symbols."""
    at, code, found = 16, 0, {}
    for n in range(1, 17):
        for _ in range(spec[n - 1]):
            found[n, code] = spec[at]
            at, code = at + 1, code + 1
        code <<= 1
    return found


class Scan:
    """One scan over (component, table slots) pairs, band first..last, bit planes high to low."""

    def __init__(self, image: Image, parts: list, first: int, last: int, high: int, low: int) -> None:
        self.image, self.parts = image, parts
        self.first, self.last, self.high, self.low = first, last, high, low

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """For every block in coding order: which part, and its row in that component."""
        image = self.image
        if len(self.parts) == 1:
            c = self.parts[0][0]
            rows = (np.arange(c.own_tall)[:, None] * c.wide + np.arange(c.own_wide)).reshape(-1)
            return np.zeros(len(rows), np.int64), rows
        unit = np.arange(image.units_wide * image.units_tall)
        row, col = unit // image.units_wide, unit % image.units_wide
        which, rows = [], []
        for k, (c, _) in enumerate(self.parts):
            for y in range(c.v):
                for x in range(c.h):
                    which.append(np.full(len(unit), k))
                    rows.append((row * c.v + y) * c.wide + col * c.h + x)
        return np.stack(which, 1).reshape(-1), np.stack(rows, 1).reshape(-1)

    def whole(self, bits: np.ndarray) -> bool:
        """Decode a scan whose bit layout doesn't depend on its data; False if it isn't one."""
        if self.first == 0:
            n = sum(c.wide * c.tall if len(self.parts) > 1 else c.own_wide * c.own_tall for c, _ in self.parts)
            if self.high:
                if bits[:n].any():
                    self.add_dc(*self.places(), bits[:n].astype(np.int16))
                return True
            slots = {s >> 4 for _, s in self.parts}
            return all(self.image.codes[0, s].get((1, 0)) == 0 for s in slots) and not bits[:n].any()
        c = self.parts[0][0]
        if (c.own_wide, c.own_tall) != (c.wide, c.tall):
            return False
        n, wide = c.wide * c.tall, self.last + 1 - self.first
        codes = self.image.codes[1, self.parts[0][1] & 15]
        band = c.blocks[:, self.first : self.last + 1]
        if not self.high:
            size = codes.get((1, 0), 0)
            if not 1 <= size <= 7 or len(bits) < n * wide * (size + 1):
                return False
            fields = bits[: n * wide * (size + 1)].reshape(n * wide, size + 1)
            if fields[:, 0].any():
                return False
            packed = fields.reshape(-1) if size == 7 else np.pad(fields, ((0, 0), (7 - size, 0))).reshape(-1)
            got = np.packbits(packed).astype(np.int16)
            # the point transform divides towards zero, so negative values are shifted by magnitude
            negative = got < 1 << (size - 1)
            got[negative] -= (1 << size) - 1
            band[:] = (got * (1 << self.low)).reshape(n, wide)
            return True
        if not band.all():
            return False
        at = done = 0
        while done < n:
            symbol, at = read_symbol(codes, bits, at)
            if symbol & 15 or symbol >> 4 == 15:
                return False
            power = symbol >> 4
            run = 1 << power
            for bit in bits[at : at + power].tolist():
                power -= 1
                run += bit << power
            at += symbol >> 4
            part = band[done : done + run]
            got = bits[at : at + run * wide].reshape(run, wide).astype(np.int16)
            part += got * np.where(part > 0, 1 << self.low, -1 << self.low).astype(np.int16)
            at, done = at + run * wide, done + run
        return True

    def add_dc(self, which: np.ndarray, rows: np.ndarray, bits: np.ndarray) -> None:
        for k, (c, _) in enumerate(self.parts):
            own = which == k
            c.blocks[rows[own], 0] |= bits[own] << self.low

    def slow(self, data: bytes) -> None:
        """Symbol by symbol, for any scan."""
        which, rows = self.places()
        pieces = split_restarts(data) if self.image.restart else [data]
        per_unit = sum(c.h * c.v for c, _ in self.parts) if len(self.parts) > 1 else 1
        step = self.image.restart * per_unit or len(rows)
        for k, piece in enumerate(pieces):
            part = slice(k * step, (k + 1) * step)
            self.symbols(which[part], rows[part], Bits(from_stream(piece)))

    def symbols(self, which: np.ndarray, rows: np.ndarray, bits: Bits) -> None:
        last_dc, run = [0] * len(self.parts), 0
        for k, row in zip(which.tolist(), rows.tolist(), strict=True):
            component, slots = self.parts[k]
            block = component.blocks[row]
            if self.first == 0:
                if self.high:
                    block[0] |= bits.take(1) << self.low
                else:
                    last_dc[k] += bits.value(bits.symbol(self.image.codes[0, slots >> 4]))
                    block[0] = last_dc[k] << self.low
            elif self.high:
                run = self.refine(block, self.image.codes[1, slots & 15], bits, run)
            else:
                run = self.fresh(block, self.image.codes[1, slots & 15], bits, run)

    def fresh(self, block: np.ndarray, codes: dict, bits: Bits, run: int) -> int:
        if run:
            return run - 1
        at = self.first
        while at <= self.last:
            symbol = bits.symbol(codes)
            skip, size = symbol >> 4, symbol & 15
            if size:
                at += skip
                block[at] = bits.value(size) << self.low
                at += 1
            elif skip == 15:
                at += 16
            else:
                return (1 << skip) + bits.take(skip) - 1
        return 0

    def refine(self, block: np.ndarray, codes: dict, bits: Bits, run: int) -> int:
        at, one = self.first, 1 << self.low
        while not run and at <= self.last:
            symbol = bits.symbol(codes)
            skip, fresh = symbol >> 4, 0
            if symbol & 15:
                fresh = one if bits.take(1) else -one
            elif skip < 15:
                run = (1 << skip) + bits.take(skip)
                break
            while at <= self.last:
                if block[at]:
                    correct(block, at, bits, one)
                elif skip:
                    skip -= 1
                else:
                    block[at] = fresh
                    at += 1
                    break
                at += 1
        if not run:
            return 0
        for i in range(at, self.last + 1):
            if block[i]:
                correct(block, i, bits, one)
        return run - 1


def correct(block: np.ndarray, at: int, bits: Bits, one: int) -> None:
    if bits.take(1):
        block[at] += one if block[at] > 0 else -one


def read_symbol(codes: dict, bits: np.ndarray, at: int) -> tuple[int, int]:
    code = 0
    for n in range(1, 17):
        code = code << 1 | int(bits[at + n - 1])
        if (n, code) in codes:
            return codes[n, code], at + n
    raise ValueError("no such code")


class Bits:
    """A cursor over entropy-coded bits; ones follow the end, as in padding."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.at = bits.tolist(), 0

    def take(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | (self.bits[self.at] if self.at < len(self.bits) else 1)
            self.at += 1
        return out

    def symbol(self, codes: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code")

    def value(self, size: int) -> int:
        got = self.take(size)
        return got if not size or got >> (size - 1) else got - (1 << size) + 1


def split_restarts(data: bytes) -> list[bytes]:
    parts, at = [], 0
    for i in range(len(data) - 1):
        if data[i] == 0xFF and 0xD0 <= data[i + 1] <= 0xD7:
            parts.append(data[at:i])
            at = i + 2
    return [*parts, data[at:]]


def payload_of(image: Image) -> bytes:
    """The bytes that ``encode`` stored."""
    wide, tall = image.units_wide, image.units_tall
    luma, *chroma = (c.blocks[:, 1:] for c in image.components)
    value = np.empty((wide * tall, UNIT_BLOCKS, 63), np.int16)
    value[:, :4] = luma[block_order(wide, tall)].reshape(-1, 4, 63)
    value[:, 4], value[:, 5] = chroma
    data = np.where(value > 0, value - 128, -value)
    n = int(image.comment.removeprefix(b"bytes="))
    return data.astype(np.uint8).tobytes()[:n]


def pixels(component: Component, quantiser: np.ndarray) -> np.ndarray:
    """The inverse transform of one plane, as float64 before clipping; exact, so equal on any machine."""
    flat = (component.blocks * quantiser).astype(np.float64) @ BASIS
    plane = flat.reshape(component.tall, component.wide, 8, 8).swapaxes(1, 2)
    return np.floor(plane.reshape(component.tall * 8, component.wide * 8) / BASIS_SCALE + 0.5)


def to_rgb(image: Image) -> np.ndarray:
    """The full-resolution uint8 tensor, height x width x 3; chroma is upsampled by repetition."""
    planes = []
    for c in image.components:
        level = np.clip(pixels(c, image.quantisers[c.table]) + 128, 0, 255).astype(np.int32)
        planes.append(level)
    if len(planes) == 1:
        return np.repeat(planes[0][: image.height, : image.width, None], 3, 2).astype(np.uint8)

    def full(level: np.ndarray, c: Component) -> np.ndarray:
        down, across = image.v // c.v, image.h // c.h
        level = level.repeat(across, 1) if across > 1 else level
        level = level.repeat(down, 0) if down > 1 else level
        return level[: image.height, : image.width]

    y, (cb, cr) = full(planes[0], image.components[0]), (p - 128 for p in planes[1:])
    # 16-bit fixed point of 1.402, 0.344136, 0.714136 and 1.772, worked out before upsampling
    shifts = (91881 * cr + 32768 >> 16, -(22554 * cb + 46802 * cr + 32768 >> 16), 116130 * cb + 32768 >> 16)
    out = np.empty((image.height, image.width, 3), np.uint8)
    for k, (shift, c) in enumerate(zip(shifts, image.components[1:2] * 3, strict=True)):
        level = y + full(shift, c)
        out[..., k] = np.minimum(np.maximum(level, 0), 255)
    return out
