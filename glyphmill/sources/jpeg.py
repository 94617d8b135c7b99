"""Pixels of baseline JPEG files, for workers without an imaging library.

Sequential files of 8-bit samples with Huffman codes, grey or of three components, with any whole sampling factors and
restart markers. What else there is (progressive, arithmetic, 12 bits, four components) raises ValueError, as broken files do.
"""

from __future__ import annotations

import struct

import numpy as np

# The order in which a block's coefficients stand in the file, along its diagonals.
DIAGONALS = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
PLACES = [8 * y + x for y, x in DIAGONALS]
#: Rows are the cosines of a block's frequencies.
_FREQUENCY, _PLACE = np.mgrid[0:8, 0:8]
COSINES = np.cos((2 * _PLACE + 1) * _FREQUENCY * np.pi / 16) / 2
COSINES[0] = np.sqrt(1 / 8)


def codes(counts: bytes, values: bytes) -> dict[tuple[int, int], int]:
    """(length, code) and what it stands for, from the numbers of codes of each length."""
    found, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            found[length, code] = values[at]
            code, at = code + 1, at + 1
        code <<= 1
    return found


def lookup(table: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """For each 16 bits that may come: length and value of the code they begin with; length 0 for none."""
    out = [(0, 0)] * (1 << 16)
    for (length, code), value in table.items():
        first = code << (16 - length)
        out[first : first + (1 << (16 - length))] = [(length, value)] * (1 << (16 - length))
    return out


class Bits:
    """Bits of a scan's part between markers, without the zero bytes that follow 0xFF. Beyond the end come ones."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def fill(self) -> None:
        some = self.data[self.at : self.at + 6]
        if self.at > len(self.data) + 64:
            raise ValueError("scan too short")
        self.held = (self.held << 48) | int.from_bytes(some + b"\xff" * (6 - len(some)), "big")
        self.n += 48
        self.at += 6

    def symbol(self, table: list[tuple[int, int]]) -> int:
        if self.n < 16:
            self.fill()
        length, value = table[self.held >> (self.n - 16) & 0xFFFF]
        if not length:
            raise ValueError("no such code")
        self.n -= length
        self.held &= (1 << self.n) - 1
        return value

    def number(self, size: int) -> int:
        """A number of so many bits: those with a leading zero are negative."""
        if not size:
            return 0
        if self.n < size:
            self.fill()
        self.n -= size
        v = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return v if v >> (size - 1) else v - (1 << size) + 1


class Part:
    """A component: sampling factors, quantisation, codes and the coefficients read so far."""

    def __init__(self, across: int, down: int, quantisation: int):
        self.across, self.down, self.quantisation = across, down, quantisation
        self.dc = self.ac = None
        self.before, self.blocks = 0, []

    def read(self, bits: Bits) -> None:
        block = [0] * 64
        self.before += bits.number(bits.symbol(self.dc))
        block[0] = self.before
        k = 1
        while k < 64:
            value = bits.symbol(self.ac)
            zeros, size = value >> 4, value & 15
            if not size:
                if zeros < 15:
                    break
                k += 16
                continue
            k += zeros
            if k > 63:
                raise ValueError("too many coefficients")
            block[PLACES[k]] = bits.number(size)
            k += 1
        self.blocks.append(block)

    def samples(self, table: np.ndarray, wide: int, high: int) -> np.ndarray:
        """The plane of all blocks; units (wide by high of them) hold across by down blocks each."""
        held = np.array(self.blocks, np.float64).reshape(-1, 8, 8) * table
        pixels = COSINES.T @ held @ COSINES + 128
        shaped = pixels.reshape(high, wide, self.down, self.across, 8, 8).transpose(0, 2, 4, 1, 3, 5)
        return np.clip(shaped.reshape(high * self.down * 8, wide * self.across * 8), 0, 255)


def widened(plane: np.ndarray, factor: int, axis: int) -> np.ndarray:
    """A plane with factor times the samples, linear between the centres of its own."""
    if factor == 1:
        return plane
    n = plane.shape[axis]
    at = ((np.arange(n * factor) + 0.5) / factor - 0.5).clip(0, n - 1)
    low = np.minimum(at.astype(int), max(0, n - 2))
    share = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
    return np.take(plane, low, axis) * (1 - share) + np.take(plane, np.minimum(low + 1, n - 1), axis) * share


def jpeg_pixels(data: bytes) -> np.ndarray:
    """Height by width by 3 samples, red first."""
    at, tables, dc, ac, interval = 2, {}, {}, {}, 0
    parts: dict[int, Part] = {}
    width = height = 0
    while at + 4 <= len(data):
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        if marker == 0xFF:  # a filling byte
            at += 1
            continue
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                values = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1")
                tables[name] = np.zeros(64)
                tables[name][PLACES] = values
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = lookup(codes(body[1:17], body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3) or not width or not height:
                raise ValueError("unsupported samples")
            for k in range(n):
                name, factors, table = body[6 + 3 * k : 9 + 3 * k]
                parts[name] = Part(factors >> 4, factors & 15, table)
            if n == 1:  # its blocks stand one by one, whatever its factors
                next(iter(parts.values())).across = next(iter(parts.values())).down = 1
        elif marker == 0xDD:
            interval = struct.unpack(">H", body[:2])[0]
        elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a baseline file")
        elif marker == 0xDA:
            if not parts or body[0] != len(parts):
                raise ValueError("parts in scans of their own")
            for k in range(body[0]):
                part, name = parts[body[1 + 2 * k]], body[2 + 2 * k]
                part.dc, part.ac = dc[name >> 4], ac[name & 15]
            return _scan(data, at, list(parts.values()), tables, interval, width, height)
        elif marker == 0xD9:
            break
    raise ValueError("no scan")


def _scan(data: bytes, at: int, parts: list[Part], tables: dict, interval: int, width: int, height: int) -> np.ndarray:
    across, down = max(p.across for p in parts), max(p.down for p in parts)
    wide, high = -(-width // (8 * across)), -(-height // (8 * down))
    left = wide * high
    while left:
        end = data.find(b"\xff", at)
        while end >= 0 and data[end + 1 : end + 2] == b"\0":
            end = data.find(b"\xff", end + 2)
        if end < 0:
            raise ValueError("scan without an end")
        bits = Bits(data[at:end])
        for part in parts:
            part.before = 0
        for _ in range(min(left, interval or left)):
            for part in parts:
                for _ in range(part.across * part.down):
                    part.read(bits)
        left -= min(left, interval or left)
        if left and data[end + 1] not in range(0xD0, 0xD8):
            raise ValueError("restart expected")
        at = end + 2
    planes = []
    for part in parts:
        if across % part.across or down % part.down:
            raise ValueError("unsupported sampling")
        plane = part.samples(tables[part.quantisation].reshape(8, 8), wide, high)
        used = plane[: -(-height * part.down // down), : -(-width * part.across // across)]
        planes.append(widened(widened(used, down // part.down, 0), across // part.across, 1)[:height, :width])
    if len(planes) == 1:
        pixels = np.repeat(planes[0][:, :, None], 3, 2)
    else:
        y, blue, red = planes[0], planes[1] - 128, planes[2] - 128
        pixels = np.stack([y + 1.402 * red, y - 0.344136 * blue - 0.714136 * red, y + 1.772 * blue], 2)
    return np.clip(np.floor(pixels + 0.5), 0, 255).astype(np.uint8)
