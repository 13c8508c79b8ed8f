"""Page content: tokens, where images are drawn, and the same content in gray."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

#: Kinds of tokens by the group that matches.
_TOKEN = re.compile(
    rb"(?P<space>[\x00\t\n\x0c\r ]+)|(?P<comment>%[^\r\n]*)|(?P<name>/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(?P<real>[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|$))"
    rb"|(?P<integer>[+-]?[0-9]+(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|$))|(?P<string>\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>)|(?P<mark><<|>>|[\[\]{}])|(?P<word>[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)|(?P<other>.)",
    re.S,
)
#: Operands that are remembered.
OPERANDS = 64


def tokens(content: bytes) -> Iterator[tuple[str, bytes]]:
    """(kind, text) of every token, blanks and comments too: their texts joined are the content."""
    for m in _TOKEN.finditer(content):
        yield m.lastgroup, m[0]


def operations(content: bytes) -> Iterator[tuple[str, list]]:
    """(operator, operands): numbers as floats, names and others as text."""
    operands: list = []
    for kind, text in tokens(content):
        if kind in ("space", "comment"):
            continue
        if kind == "word":
            yield text.decode("latin-1"), operands
            operands = []
            continue
        operands = [*operands[1 - OPERANDS :], float(text) if kind in ("real", "integer") else text.decode("latin-1")]


def product(m: tuple, n: tuple) -> tuple:
    """The matrix that applies m, then n."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u


ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def draws(content: bytes) -> Iterator[tuple[str, tuple]]:
    """(name, matrix) of each object that the content draws by its name, in order; the matrix is relative to the content's own
    start. What is within drawn forms is theirs: :func:`leafgraph.operators.pages.resolutions` follows them by joins."""
    at, stack = ONE, []
    for op, operands in operations(content):
        if op == "q":
            stack.append(at)
        elif op == "Q" and stack:
            at = stack.pop()
        elif op == "cm":
            numbers = [x for x in operands[-6:] if isinstance(x, float)]
            if len(numbers) == 6:
                at = product(tuple(numbers), at)
        elif op == "Do" and operands and isinstance(operands[-1], str):
            yield operands[-1][1:], at


def dpi(width: int, height: int, matrix: tuple, unit: float = 1.0) -> float | None:
    """The lower resolution of both directions; None where nothing is drawn."""
    scale = (unit if unit > 0 else 1.0) / 72
    across, down = math.hypot(*matrix[:2]) * scale, math.hypot(*matrix[2:4]) * scale
    return None if across < 1e-4 or down < 1e-4 else min(width / across, height / down)


def number(x: float) -> bytes:
    text = f"{min(1.0, max(0.0, x)):.4f}".rstrip("0").rstrip(".")
    return text.encode()


#: Operators that set colours by numbers, with how many they take; gray operators for filling and stroking.
COLOR = {b"rg": (3, b"g"), b"RG": (3, b"G"), b"k": (4, b"g"), b"K": (4, b"G")}
SPACES = {b"/DeviceRGB": "rgb", b"/RGB": "rgb", b"/DeviceCMYK": "cmyk", b"/CMYK": "cmyk", b"/DeviceGray": "gray", b"/G": "gray"}
PARTS = {"rgb": 3, "cmyk": 4, "gray": 1}


def gray_of(values: list[float]) -> float:
    if len(values) == 3:
        return 0.299 * values[0] + 0.587 * values[1] + 0.114 * values[2]
    if len(values) == 4:
        return 1.0 - min(1.0, 0.3 * values[0] + 0.59 * values[1] + 0.11 * values[2] + values[3])
    return values[0]


def grayed(content: bytes, named: dict[bytes, str] | None = None) -> bytes:
    """The content with device colours turned to gray; ``named``: kinds of colour spaces by name (``rgb``, ``cmyk``, and
    ``pattern rgb`` for uncoloured patterns), whose resources become gray apart from this. What is not understood stays as it is, byte by byte."""
    spaces = SPACES | (named or {})
    state = {"fill": "gray", "stroke": "gray"}
    stack: list[dict] = []
    out: list[bytes] = []
    operands: list[tuple[str, bytes, int]] = []  # kind, text, place in out

    def replace(text: bytes) -> None:
        del out[operands[0][2] if operands else len(out) :]
        out.append(text)

    for kind, text in tokens(content):
        if kind != "word":
            if kind not in ("space", "comment"):
                operands.append((kind, text, len(out)))
            out.append(text)
            continue
        numbers = [float(t) for k, t, _ in operands if k in ("real", "integer")]
        side = "fill" if text in (b"rg", b"k", b"g", b"cs", b"sc", b"scn") else "stroke"
        plain = len(numbers) == len(operands)
        if text == b"q":
            stack.append(dict(state))
            out.append(text)
        elif text == b"Q":
            state = stack.pop() if stack else state
            out.append(text)
        elif text in COLOR:
            parts, op = COLOR[text]
            state[side] = "rgb" if parts == 3 else "cmyk"  # a later sc means this space still
            if plain and len(numbers) == parts:
                replace(number(gray_of(numbers)) + b" " + op)
            else:
                out.append(text)
        elif text in (b"g", b"G"):
            state[side] = "gray"
            out.append(text)
        elif text in (b"cs", b"CS") and operands and operands[-1][0] == "name":
            space = spaces.get(operands[-1][1])
            state[side] = space or "other"
            if space in ("rgb", "cmyk") and operands[-1][1] in SPACES:
                replace(b"/DeviceGray " + text)
            else:
                out.append(text)
        elif text in (b"scn", b"SCN") and state[side].startswith("pattern ") and operands and operands[-1][0] == "name" and len(numbers) == len(operands) - 1 == PARTS[state[side][8:]]:
            replace(number(gray_of(numbers)) + b" " + operands[-1][1] + b" " + text)
        elif text in (b"sc", b"scn", b"SC", b"SCN") and plain and len(numbers) == PARTS.get(state[side]) and state[side] != "gray":
            replace(number(gray_of(numbers)) + b" " + text)
        else:
            out.append(text)
        operands = []
    return b"".join(out)
