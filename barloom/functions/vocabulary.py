"""Token ids: features first, then operators; the version is a hash of the names in order."""

from __future__ import annotations

import hashlib

from .features import FEATURES
from .formula import OPERATORS


def names() -> list[str]:
    return [*FEATURES, *OPERATORS]


def version(of: list[str] | None = None) -> str:
    return "v" + hashlib.sha256("\n".join(of or names()).encode()).hexdigest()[:12]


def arity(token: int) -> int:
    return 0 if token < len(FEATURES) else OPERATORS[names()[token]].arity


def decode(tokens: list[int], sep: str = " → ") -> str:
    n = names()
    return sep.join(n[t] for t in tokens)


def depths(tokens: list[int]) -> list[int] | None:
    """Stack depth after each token; None if an operator lacks operands or a token is unknown."""
    out, depth = [], 0
    for t in tokens:
        if not 0 <= t < len(FEATURES) + len(OPERATORS) or depth < arity(t):
            return None
        depth += 1 - arity(t)
        out.append(depth)
    return out


def feasible(tokens: list[int]) -> bool:
    d = depths(tokens)
    return bool(d) and d[-1] == 1


def repeats(tokens: list[int]) -> int:
    return sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))


def hamming(a: list[int], b: list[int]) -> int:
    return sum(x != y for x, y in zip(a, b, strict=False)) + abs(len(a) - len(b))
