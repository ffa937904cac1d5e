"""Scalar expressions: an infix grammar, strict evaluation, derivatives, simplification, and compilation to columns.

Grammar: sums of products of powers; ^ is right-associative and takes its left operand after unary minus, so -x^2 is
(-x)^2; functions exp, log, sin, cos. Nodes are tuples: ("num", v), ("sym", name), (unary, a), (binary, a, b).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Node = tuple
UNARY, BINARY = ("neg", "exp", "log", "sin", "cos"), ("+", "-", "*", "/", "^")
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_][A-Za-z0-9_]*)|([-+*/^()]))")
_LEVEL = {"+": 1, "-": 1, "*": 2, "/": 2, "^": 4}


def parse(text: str) -> Node:
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        tokens.append(m)
        at = m.end()
    k = 0

    def peek() -> str | None:
        return tokens[k][3] or tokens[k][2] or tokens[k][1] if k < len(tokens) else None

    def take() -> re.Match:
        nonlocal k
        if k >= len(tokens):
            raise ValueError(f"{text!r} ends too soon")
        k += 1
        return tokens[k - 1]

    def chain(ops: str, below) -> Node:
        a = below()
        while peek() in tuple(ops):
            a = (take()[3], a, below())
        return a

    def total() -> Node:
        return chain("+-", lambda: chain("*/", power))

    def power() -> Node:
        a = unary()
        if peek() == "^":
            take()
            return ("^", a, power())
        return a

    def unary() -> Node:
        if peek() == "-":
            take()
            return ("neg", unary())
        m = take()
        if m[1]:
            return ("num", float(m[1]))
        if m[2]:
            if peek() == "(":
                if m[2] not in UNARY[1:]:
                    raise ValueError(f"no function {m[2]}")
                take()
                a = total()
                if take()[3] != ")":
                    raise ValueError("missing )")
                return (m[2], a)
            return ("sym", m[2])
        if m[3] == "(":
            a = total()
            if take()[3] != ")":
                raise ValueError("missing )")
            return a
        raise ValueError(f"unexpected {m[0].strip()!r}")

    out = total()
    if k < len(tokens):
        raise ValueError(f"unexpected {tokens[k][0].strip()!r}")
    return out


def to_text(e: Node, level: int = 0) -> str:
    kind = e[0]
    if kind == "num":
        s = f"{e[1]:.17g}"
        return f"({s})" if e[1] < 0 and level else s
    if kind == "sym":
        return e[1]
    if kind == "neg":
        s = f"-{to_text(e[1], 5)}"
        return f"({s})" if level else s
    if kind in UNARY:
        return f"{kind}({to_text(e[1])})"
    own = _LEVEL[kind]
    left, right = (own + 1, own) if kind == "^" else (own, own + 1)
    s = f"{to_text(e[1], left)} {kind} {to_text(e[2], right)}"
    return f"({s})" if level > own else s


def symbols(e: Node) -> set[str]:
    return {e[1]} if e[0] == "sym" else set().union(*(symbols(x) for x in e[1:] if isinstance(x, tuple)))


def size(e: Node) -> int:
    return 1 + sum(size(x) for x in e[1:] if isinstance(x, tuple))


def evaluate(e: Node, at: dict[str, float]) -> float:
    """Strict: the logarithm of what is not positive, a division by zero and any value that is not finite are errors."""
    kind = e[0]
    if kind == "num":
        v = e[1]
    elif kind == "sym":
        v = at[e[1]]
    elif kind in UNARY:
        a = evaluate(e[1], at)
        if kind == "log" and a <= 0:
            raise ValueError("log of a value that is not positive")
        v = -a if kind == "neg" else getattr(math, kind)(a)
    else:
        a, b = evaluate(e[1], at), evaluate(e[2], at)
        if kind == "/" and b == 0:
            raise ValueError("division by zero")
        v = a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else a / b if kind == "/" else math.pow(a, b)
    if not math.isfinite(v):
        raise ValueError("not finite")
    return v


def to_column(e: Node, strict: bool = True) -> Column:
    """The expression as built-in functions of the columns that its symbols name; strict: raise as evaluate does."""
    kind = e[0]
    if kind == "num":
        return F.lit(e[1])
    if kind == "sym":
        return F.col(e[1])
    stop = lambda why: F.raise_error(F.lit(why)).cast("double")
    if kind in UNARY:
        a = to_column(e[1], strict)
        v = -a if kind == "neg" else {"exp": F.exp, "log": F.ln, "sin": F.sin, "cos": F.cos}[kind](a)
        return F.when(a <= 0, stop("log of a value that is not positive")).otherwise(v) if strict and kind == "log" else v
    a, b = to_column(e[1], strict), to_column(e[2], strict)
    if kind == "/":
        return F.when(b == 0, stop("division by zero") if strict else F.lit(None).cast("double")).otherwise(a / b)
    return a + b if kind == "+" else a - b if kind == "-" else a * b if kind == "*" else F.pow(a, b)


def num(v: float) -> Node:
    return ("num", float(v))


def simplify(e: Node) -> Node:
    """Constants folded and identities applied, from the leaves up, until nothing changes."""
    if e[0] in ("num", "sym"):
        return e
    e = (e[0], *(simplify(x) for x in e[1:]))
    kind = e[0]
    if all(x[0] == "num" for x in e[1:]):
        try:
            return num(evaluate(e, {}))
        except (ValueError, OverflowError):
            return e
    zero, one = num(0), num(1)
    if kind == "neg" and e[1][0] == "neg":
        return e[1][1]
    if kind in UNARY:
        return e
    a, b = e[1:]
    rules = {
        "+": [(a == zero, b), (b == zero, a)],
        "-": [(b == zero, a), (a == b, zero), (a == zero, ("neg", b))],
        "*": [(a == zero or b == zero, zero), (a == one, b), (b == one, a)],
        "/": [(b == one, a), (a == zero and b != zero, zero)],
        "^": [(b == zero, one), (b == one, a)],
    }
    return next((new for holds, new in rules[kind] if holds), e)


def derivative(e: Node, by: str) -> Node:
    def d(e: Node) -> Node:
        kind = e[0]
        if kind == "num":
            return num(0)
        if kind == "sym":
            return num(e[1] == by)
        a = e[1]
        if kind in UNARY:
            return {"neg": ("neg", d(a)), "exp": ("*", e, d(a)), "log": ("/", d(a), a), "sin": ("*", ("cos", a), d(a)), "cos": ("neg", ("*", ("sin", a), d(a)))}[kind]
        b = e[2]
        if kind in "+-":
            return (kind, d(a), d(b))
        if kind == "*":
            return ("+", ("*", d(a), b), ("*", a, d(b)))
        if kind == "/":
            return ("/", ("-", ("*", d(a), b), ("*", a, d(b))), ("^", b, num(2)))
        if b[0] == "num":
            return ("*", ("*", b, ("^", a, num(b[1] - 1))), d(a))
        return ("*", e, ("+", ("*", d(b), ("log", a)), ("*", b, ("/", d(a), a))))

    return simplify(d(e))


def jacobian(laws: dict[str, Node]) -> dict[str, dict[str, Node]]:
    return {x: {y: derivative(e, y) for y in laws} for x, e in laws.items()}


def lie_derivative(phi: Node, laws: dict[str, Node]) -> Node:
    out = num(0)
    for x, f in laws.items():
        out = ("+", out, ("*", derivative(phi, x), f))
    return simplify(out)


def substitute(e: Node, values: dict[str, Node]) -> Node:
    return values.get(e[1], e) if e[0] == "sym" else e if e[0] == "num" else (e[0], *(substitute(x, values) for x in e[1:]))
