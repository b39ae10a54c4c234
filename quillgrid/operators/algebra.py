"""Equality of mathematical answers: expressions in plain or LaTeX notation, compared by value at fixed points."""

from __future__ import annotations

import cmath
import math
import re
from collections.abc import Callable

#: Points at which two expressions must agree, and how many of them must be defined for both.
POINTS, DEFINED = 6, 3
_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?|\.\d+)|\\([A-Za-z]+)|([A-Za-z])|(.))")
_FUNCTIONS: dict[str, Callable] = {"sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "ln": cmath.log, "log": cmath.log10, "exp": cmath.exp, "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan}
_SILENT = {"left", "right", "displaystyle", "text", "mathrm", "quad"}
Value = Callable[[dict[str, complex]], complex]


class _Parser:
    """A reader of one expression; what it can't read raises ValueError."""

    def __init__(self, text: str):
        text = re.sub(r"\\[,;:! ]|\$|\\%|%|°|\^\\circ|\\circ", " ", text).replace("\\dfrac", "\\frac").replace("\\tfrac", "\\frac").replace("−", "-").replace("·", "*").replace("×", "*").replace("÷", "/").replace("π", "\\pi ")
        text = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", text)
        self.items = [t for m in _TOKEN.finditer(text.strip()) for t in [self._item(m)] if t is not None]
        self.at = 0
        self.names: set[str] = set()

    @staticmethod
    def _item(m: re.Match) -> tuple[str, str] | None:
        number, command, letter, sign = m.groups()
        if number:
            return "number", number
        if command:
            return None if command in _SILENT else ("sign", {"cdot": "*", "times": "*", "div": "/"}[command]) if command in ("cdot", "times", "div") else ("command", command)
        return ("letter", letter) if letter else ("sign", sign)

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, sign: str | None = None) -> tuple[str, str]:
        item = self.peek()
        if item[0] == "end" or sign is not None and item != ("sign", sign):
            raise ValueError(f"expected {sign}")
        self.at += 1
        return item

    def sum(self) -> Value:
        value = self.product()
        while self.peek() in (("sign", "+"), ("sign", "-")):
            sign, other = self.take()[1], self.product()
            value = (lambda a, b: lambda e: a(e) + b(e))(value, other) if sign == "+" else (lambda a, b: lambda e: a(e) - b(e))(value, other)
        return value

    def product(self) -> Value:
        value = self.signed()
        while True:
            kind, text = self.peek()
            if kind == "sign" and text in "*/":
                self.take()
                other = self.signed()
                value = (lambda a, b: lambda e: a(e) * b(e))(value, other) if text == "*" else (lambda a, b: lambda e: a(e) / b(e))(value, other)
            elif kind in ("number", "letter", "command") or (kind, text) in (("sign", "("), ("sign", "{")):
                value = (lambda a, b: lambda e: a(e) * b(e))(value, self.power())
            else:
                return value

    def signed(self) -> Value:
        if self.peek() in (("sign", "-"), ("sign", "+")):
            minus, value = self.take()[1] == "-", self.signed()
            return (lambda a: lambda e: -a(e))(value) if minus else value
        return self.power()

    def power(self) -> Value:
        base = self.atom()
        if self.peek() == ("sign", "^"):
            self.take()
            exponent = self.group() if self.peek() == ("sign", "{") else self.signed()
            return lambda e: base(e) ** exponent(e)
        return base

    def group(self, opening: str = "{", closing: str = "}") -> Value:
        self.take(opening)
        value = self.sum()
        self.take(closing)
        return value

    def atom(self) -> Value:
        kind, text = self.peek()
        if kind == "number":
            number = float(self.take()[1])
            return lambda e: number
        if kind == "letter":
            self.take()
            self.names.add(text)
            return lambda e: e[text]
        if (kind, text) == ("sign", "("):
            return self.group("(", ")")
        if (kind, text) == ("sign", "{"):
            return self.group()
        if kind != "command":
            raise ValueError(text)
        self.take()
        if text == "pi":
            return lambda e: math.pi
        if text == "frac":
            top, bottom = self.group(), self.group()
            return lambda e: top(e) / bottom(e)
        if text == "sqrt":
            root = self.group("[", "]") if self.peek() == ("sign", "[") else (lambda e: 2.0)
            inner = self.group() if self.peek() == ("sign", "{") else self.atom()
            return lambda e: inner(e) ** (1 / root(e))
        if text in _FUNCTIONS:
            function = _FUNCTIONS[text]
            inner = self.atom()
            return lambda e: function(inner(e))
        self.names.add("\\" + text)
        return lambda e: e["\\" + text]

    def whole(self) -> Value:
        value = self.sum()
        if self.peek()[0] != "end":
            raise ValueError(self.peek()[1])
        return value


def _parts(text: str) -> list[str]:
    """An answer without the name it is given to, and a list or pair as its members."""
    text = re.sub(r"^\s*[A-Za-z](?:_\{?\w+\}?)?\s*=\s*", "", text.strip()).strip()
    inner = re.fullmatch(r"(?:\\left)?[(\[](.*?)(?:\\right)?[)\]]", text, re.S)
    body = inner.group(1) if inner and re.search(r",(?!\d{3}(?!\d))", inner.group(1)) else text
    out, depth, start = [], 0, 0
    for k, c in enumerate(body):
        depth += (c in "({[") - (c in ")}]")
        if c == "," and depth == 0 and not re.match(r",\d{3}(?!\d)", body[k:]):
            out.append(body[start:k])
            start = k + 1
    return [*out, body[start:]]


def _equal(a: str, b: str) -> bool:
    x, y = _Parser(a), _Parser(b)
    left, right = x.whole(), y.whole()
    names = sorted(x.names | y.names)
    agreed = 0
    for p in range(POINTS):
        # Fixed irrational points, other ones for each name.
        at = {n: complex(0.3 + math.modf(math.sqrt(2) * (p + 1) * (k + 2))[0], 0.1 * (p % 2) * (k + 1)) for k, n in enumerate(names)}
        try:
            u, v = left(at), right(at)
        except (ZeroDivisionError, OverflowError, ValueError):
            continue
        if cmath.isfinite(u) and cmath.isfinite(v):
            if abs(u - v) > 1e-9 * max(1.0, abs(u), abs(v)):
                return False
            agreed += 1
    return agreed >= (DEFINED if names else 1)


def same_answer(a: str | None, b: str | None) -> bool:
    """Whether two answers are the same text or expression, member by member; what can't be read equals only its own text."""
    if not a or not b:
        return False
    if re.sub(r"\s", "", a) == re.sub(r"\s", "", b):
        return True
    xs, ys = _parts(a), _parts(b)
    try:
        return len(xs) == len(ys) and all(_equal(x, y) for x, y in zip(xs, ys))
    except (ValueError, RecursionError, KeyError, TypeError):
        return False
