"""Sums of products: one form for expressions that are equal as polynomials of their symbols, functions and quotients."""

from __future__ import annotations

from .expressions import Node, num, simplify, size, to_text

#: A product: its factors, each a text and a whole power, in order of text.
Product = tuple[tuple[str, int], ...]
#: Terms beyond which an expansion is given up and the expression stays a factor of its own.
MOST_PRODUCTS = 2000


def products(e: Node, atoms: dict[str, Node]) -> dict[Product, float]:
    """The expression as coefficients of products; atoms gets what each factor stands for."""

    def atom(x: Node) -> dict[Product, float]:
        atoms[to_text(x)] = x
        return {((to_text(x), 1),): 1.0}

    def times(a: dict[Product, float], b: dict[Product, float]) -> dict[Product, float]:
        out: dict[Product, float] = {}
        for p, u in a.items():
            for q, v in b.items():
                powers = dict(p)
                for f, k in q:
                    powers[f] = powers.get(f, 0) + k
                key = tuple(sorted(powers.items()))
                out[key] = out.get(key, 0.0) + u * v
        return out

    kind = e[0]
    if kind == "num":
        return {(): e[1]} if e[1] else {}
    if kind == "sym":
        return atom(e)
    if kind == "neg":
        return {p: -v for p, v in products(e[1], atoms).items()}
    if kind in ("+", "-"):
        out = dict(products(e[1], atoms))
        for p, v in products(e[2], atoms).items():
            out[p] = out.get(p, 0.0) + (v if kind == "+" else -v)
        return {p: v for p, v in out.items() if v}
    if kind == "*":
        a, b = products(e[1], atoms), products(e[2], atoms)
        return {p: v for p, v in times(a, b).items() if v} if len(a) * len(b) <= MOST_PRODUCTS else atom(("*", normal(e[1]), normal(e[2])))
    if kind == "^" and e[2][0] == "num" and float(e[2][1]).is_integer() and 0 <= e[2][1] <= 16:
        a = products(e[1], atoms)
        if len(a) ** int(e[2][1]) <= MOST_PRODUCTS:
            out: dict[Product, float] = {(): 1.0}
            for _ in range(int(e[2][1])):
                out = times(out, a)
            return {p: v for p, v in out.items() if v}
    if kind == "/":
        below = products(e[2], atoms)
        if list(below) == [()]:  # by a number that is not zero
            return {p: v / below[()] for p, v in products(e[1], atoms).items()}
    return atom((kind, *(normal(x) for x in e[1:])))


def normal(e: Node) -> Node:
    """The sum of products, highest powers first, like terms collected; what is no polynomial is a factor, itself in this form."""
    atoms: dict[str, Node] = {}
    out = None
    for p, v in sorted(products(e, atoms).items(), key=lambda t: (-sum(k for _, k in t[0]), t[0])):
        term = None
        for f, k in p:
            factor = atoms[f] if k == 1 else ("^", atoms[f], num(k))
            term = factor if term is None else ("*", term, factor)
        size_ = abs(v)
        term = num(size_) if term is None else term if size_ == 1 else ("*", num(size_), term)
        out = (("neg", term) if v < 0 else term) if out is None else ("-" if v < 0 else "+", out, term)
    return num(0) if out is None else out


def cheapest(choices: list[Node]) -> Node | None:
    """The one of fewest nodes; of several, the first by text."""
    return min(choices, key=lambda e: (size(e), to_text(e)), default=None)


def shortest(e: Node) -> Node:
    """The cheapest of an expression, its simplification and its sum of products."""
    return cheapest([e, simplify(e), normal(e), simplify(normal(e))])


def same(a: Node, b: Node) -> bool:
    """Whether two expressions have one normal form."""
    return products(("-", a, b), {}) == {}
