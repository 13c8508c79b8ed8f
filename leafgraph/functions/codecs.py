"""Byte codecs: Flate, PNG prediction, ITU-T T.6 (G4) and T.88 (JBIG2 generic regions), both ways.

Images of one bit are lists of rows of 0 and 1; 1 is black in G4 and JBIG2 alike.
"""

from __future__ import annotations

import struct
import zlib

#: Fixed values (ITU-T T.4, tables 2 and 3): codes of white and black runs of 0 to 63, then of 64, 128 and so on to 1728.
WHITE = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 "
    "101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 "
    "00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 "
    "00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100 "
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 "
    "011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
).split()
BLACK = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 "
    "0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 "
    "000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 "
    "000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111 "
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 "
    "0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
).split()
#: Codes of runs of 1792, 1856 and so on to 2560 of either colour.
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
#: Fixed values (T.6): modes by the distance a1 - b1, pass and horizontal; the end of a block.
VERTICAL = {0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
PASS, HORIZONTAL, END = "0001", "001", "000000000001" * 2


def deflate(data: bytes, level: int = 9) -> bytes:
    return zlib.compress(data, level)


def inflate(data: bytes) -> bytes:
    return zlib.decompress(data)


def _guess(kind: int, a: int, b: int, c: int) -> int:
    if kind == 4:
        p = a + b - c
        return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
    return (0, a, b, (a + b) // 2)[kind]


def png_predict(data: bytes, row_bytes: int, step: int = 1) -> bytes:
    """Each row with the filter of least cost, its number ahead."""
    out, above = bytearray(), bytes(row_bytes)
    for start in range(0, len(data), row_bytes):
        row = data[start : start + row_bytes]
        tries = []
        for kind in range(5):
            line = bytearray()
            for i, v in enumerate(row):
                a, c = (row[i - step], above[i - step]) if i >= step else (0, 0)
                line.append((v - _guess(kind, a, above[i], c)) & 255)
            tries.append((sum(v if v < 128 else 256 - v for v in line), kind, line))
        _, kind, line = min(tries)
        out.append(kind)
        out += line
        above = row
    return bytes(out)


def png_restore(data: bytes, row_bytes: int, step: int = 1) -> bytes:
    out, above = bytearray(), bytes(row_bytes)
    for start in range(0, len(data), row_bytes + 1):
        kind, line, row = data[start], data[start + 1 : start + 1 + row_bytes], bytearray()
        for i, v in enumerate(line):
            a, c = (row[i - step], above[i - step]) if i >= step else (0, 0)
            row.append((v + _guess(kind, a, above[i], c)) & 255)
        out += row
        above = row
    return bytes(out)


def _bytes(bits: list[str]) -> bytes:
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""


def _run(length: int, black: int) -> str:
    codes, out = (BLACK if black else WHITE), ""
    while length > 2623:
        out, length = out + LONG[-1], length - 2560
    if length >= 1792:
        k = (length - 1792) // 64
        out, length = out + LONG[k], length - 1792 - 64 * k
    elif length >= 64:
        out, length = out + codes[63 + length // 64], length % 64
    return out + codes[length]


def _changes(row: list[int]) -> list[int]:
    """Where the colour changes, beginning at white."""
    return [i for i, v in enumerate(row) if v != (row[i - 1] if i else 0)]


def _reference(changes: list[int], a0: int, color: int, width: int) -> tuple[int, int]:
    """b1: the first change on the line above right of a0 to the colour opposite to ``color``; and b2 after it."""
    k = next((k for k, p in enumerate(changes) if p > a0 and k % 2 == color), None)
    if k is None:
        return width, width
    return changes[k], changes[k + 1] if k + 1 < len(changes) else width


def g4_encode(rows: list[list[int]], width: int) -> bytes:
    out, above = [], []
    for row in rows:
        changes, a0, color = _changes(row), -1, 0
        while a0 < width:
            b1, b2 = _reference(above, a0, color, width)
            later = [p for p in changes if p > a0 or a0 == -1 and p == 0]
            # changes to the other colour alternate: the first one right of a0 is a1
            a1 = later[0] if later else width
            if b2 < a1:
                out.append(PASS)
                a0 = b2
            elif abs(a1 - b1) <= 3:
                out.append(VERTICAL[a1 - b1])
                a0, color = a1, 1 - color
            else:
                a2 = later[1] if len(later) > 1 else width
                out += [HORIZONTAL, _run(a1 - max(a0, 0), color), _run(a2 - a1, 1 - color)]
                a0 = a2
            if a0 >= width:
                break
        above = changes
    return _bytes([*out, END])


class _Bits:
    def __init__(self, data: bytes):
        self.text, self.at = "".join(f"{b:08b}" for b in data), 0

    def code(self, codes: dict[str, int | str]) -> int | str:
        for n in range(1, 14):
            found = codes.get(self.text[self.at : self.at + n])
            if found is not None:
                self.at += n
                return found
        raise ValueError(f"no code at bit {self.at}")


_RUNS = [
    {code: (i if i < 64 else (i - 63) * 64) for i, code in enumerate(codes)} | {code: 1792 + 64 * i for i, code in enumerate(LONG)} for codes in (WHITE, BLACK)
]
_MODES = {code: d for d, code in VERTICAL.items()} | {PASS: "pass", HORIZONTAL: "horizontal"}


def g4_decode(data: bytes, width: int, height: int) -> list[list[int]]:
    bits, rows, above = _Bits(data), [], []

    def run(color: int) -> int:
        total = 0
        while (part := bits.code(_RUNS[color])) >= 64:
            total += part
        return total + part

    for _ in range(height):
        row, a0, color = [], -1, 0
        while len(row) < width:
            b1, b2 = _reference(above, a0, color, width)
            mode = bits.code(_MODES)
            if mode == "pass":
                row += [color] * (b2 - len(row))
                a0 = b2
            elif mode == "horizontal":
                for c in (color, 1 - color):
                    row += [c] * run(c)
                a0 = len(row)
            else:
                row += [color] * (b1 + mode - len(row))
                a0, color = b1 + mode, 1 - color
        rows.append(row)
        above = _changes(row)
    return rows


#: Fixed values (ITU-T T.88, table E.1): probability, next state after the likelier and the less likely symbol, and whether
#: the likelier symbol changes.
STATES = [
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0),
    (0x5601, 7, 6, 1), (0x5401, 8, 14, 0), (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0),
    (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0), (0x5101, 17, 15, 0), (0x4801, 18, 16, 0),
    (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0),
    (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0), (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0),
    (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0), (0x0049, 41, 38, 0), (0x0025, 42, 39, 0),
    (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
]
#: Fixed value: the context of the bit that says whether a row repeats the one above.
REPEAT = 0x9B25


class _Coder:
    """The arithmetic coder; ``contexts`` has (state, likelier symbol) by context."""

    def __init__(self):
        self.contexts: dict[int, tuple[int, int]] = {}

    def learn(self, context: int, state: int, likely: int, rare: bool) -> None:
        _, more, less, flips = STATES[state]
        self.contexts[context] = (less, likely ^ flips) if rare else (more, likely)


class _Encoder(_Coder):
    def __init__(self):
        super().__init__()
        self.a, self.c, self.count, self.out = 0x8000, 0, 12, bytearray(b"\0")  # a byte ahead takes no carry

    def put(self, bit: int, context: int) -> None:
        state, likely = self.contexts.get(context, (0, 0))
        q = STATES[state][0]
        self.a -= q
        if bit == likely:
            if self.a & 0x8000:
                self.c += q
                return
            if self.a < q:
                self.a = q
            else:
                self.c += q
        elif self.a < q:
            self.c += q
        else:
            self.a = q
        self.learn(context, state, likely, bit != likely)
        while True:
            self.a, self.c, self.count = self.a << 1, self.c << 1, self.count - 1
            if not self.count:
                self._byte()
            if self.a & 0x8000:
                return

    def _byte(self) -> None:
        if self.out[-1] != 0xFF and self.c >= 0x8000000:
            self.out[-1] += 1
            self.c &= 0x7FFFFFF
        stuffed = self.out[-1] == 0xFF
        shift = 20 if stuffed else 19
        self.out.append(self.c >> shift & 0xFF)
        self.c &= (1 << shift) - 1
        self.count = 7 if stuffed else 8

    def end(self) -> bytes:
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.count
            self._byte()
        if self.out[-1] != 0xFF:
            self.out.append(0xFF)
        return bytes(self.out[1:]) + b"\xac"


class _Decoder(_Coder):
    def __init__(self, data: bytes):
        super().__init__()
        self.data, self.at, self.count = data, 0, 0
        self.c = self._at(0) << 16
        self._byte()
        self.c, self.count, self.a = self.c << 7, self.count - 7, 0x8000

    def _at(self, i: int) -> int:
        return self.data[i] if i < len(self.data) else 0xFF

    def _byte(self) -> None:
        after = self._at(self.at + 1)
        if self._at(self.at) != 0xFF:
            self.c, self.count = self.c + (after << 8), 8
        elif after > 0x8F:
            self.c, self.count = self.c + 0xFF00, 8
            return
        else:
            self.c, self.count = self.c + (after << 9), 7
        self.at += 1

    def get(self, context: int) -> int:
        state, likely = self.contexts.get(context, (0, 0))
        q = STATES[state][0]
        self.a -= q
        if self.c >> 16 < q:
            rare, self.a = self.a >= q, q
        else:
            self.c -= q << 16
            if self.a & 0x8000:
                return likely
            rare = self.a < q
        self.learn(context, state, likely, rare)
        while True:
            if not self.count:
                self._byte()
            self.a, self.c, self.count = self.a << 1, self.c << 1, self.count - 1
            if self.a & 0x8000:
                return likely ^ rare


def _context(rows: list[list[int]], y: int, x: int, width: int) -> int:
    """Template 0 with its usual adaptive pixels: five of two rows above, seven of the row above, four of this row."""
    out = 0
    for up, low, high in ((2, -2, 2), (1, -3, 3), (0, -4, -1)):
        for i in range(x + low, x + high + 1):
            out = out << 1 | (rows[y - up][i] if y >= up and 0 <= i < width else 0)
    return out


def jbig2_region(rows: list[list[int]], width: int) -> bytes:
    coder, repeated = _Encoder(), 0
    for y, row in enumerate(rows):
        same = int(row == (rows[y - 1] if y else [0] * width))
        coder.put(same ^ repeated, REPEAT)
        repeated = same
        if not same:
            for x, bit in enumerate(row):
                coder.put(bit, _context(rows, y, x, width))
    return coder.end()


def jbig2_region_rows(data: bytes, width: int, height: int) -> list[list[int]]:
    coder, same, rows = _Decoder(data), 0, []
    for y in range(height):
        same ^= coder.get(REPEAT)
        if same:
            rows.append(list(rows[-1]) if rows else [0] * width)
            continue
        rows.append([0] * width)
        for x in range(width):
            rows[y][x] = coder.get(_context(rows, y, x, width))
    return rows


def jbig2_encode(rows: list[list[int]], width: int) -> bytes:
    """A page (segment type 48) and an immediate generic region (38) that fills it."""

    def segment(number: int, kind: int, data: bytes) -> bytes:
        return struct.pack(">IBBBI", number, kind, 0, 1, len(data)) + data

    page = struct.pack(">IIIIBH", width, len(rows), 0, 0, 0, 0)
    region = struct.pack(">IIIIB", width, len(rows), 0, 0, 0) + struct.pack(">B8b", 0x08, 3, -1, -3, -1, 2, -2, -2, -2)
    return segment(0, 48, page) + segment(1, 38, region + jbig2_region(rows, width))


def jbig2_decode(data: bytes) -> list[list[int]]:
    """The rows of what :func:`jbig2_encode` makes."""
    at = 0
    while at < len(data):
        _, kind, _, _, length = struct.unpack_from(">IBBBI", data, at)
        body, at = data[at + 11 : at + 11 + length], at + 11 + length
        if kind == 38:
            width, height = struct.unpack_from(">II", body)
            return jbig2_region_rows(body[26:], width, height)
    raise ValueError("no generic region")
