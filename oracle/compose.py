"""Compose one SQL statement from named common table expressions.

``sql(body)`` looks up which named expressions the body mentions, and which
those mention in turn, and puts them in front of the body in order.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def define(name: str, body: str) -> str:
    CTES[name] = body.strip()
    return name


def _needs(text: str) -> list[str]:
    seen: list[str] = []
    for word in _WORD.findall(text):
        if word in CTES and word not in seen:
            seen.append(word)
    return seen


def sql(body: str) -> str:
    ordered: list[str] = []

    def visit(name: str, trail: tuple[str, ...] = ()) -> None:
        if name in ordered or name in trail:
            return
        for need in _needs(CTES[name]):
            if need != name:
                visit(need, (*trail, name))
        ordered.append(name)

    for name in _needs(body):
        visit(name)
    if not ordered:
        return body.strip()
    head = ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in ordered)
    return f"WITH {head}\n{body.strip()}"


def exact(num: str, den: str, scale: int = 4, out: int = 4) -> str:
    """num / den rounded half away from zero at ``scale`` decimals, by integer
    arithmetic (decimal division is floating point in the checking engine)."""
    n = f"(CAST(({num}) * 10000 AS HUGEINT) * {10 ** scale})"
    d = f"CAST(({den}) * 10000 AS HUGEINT)"
    unit = f"CAST('{10 ** -scale:.{scale}f}' AS DECIMAL({scale + 1},{scale}))"
    q = f"(sign({n}) * sign({d}) * ((2 * abs({n}) + abs({d})) // (2 * abs({d}))))"
    return (
        f"(CASE WHEN ({den}) = 0 THEN NULL ELSE "
        f"CAST(CAST({q} AS DECIMAL({37 - scale},0)) * {unit} AS DECIMAL(38,{out})) END)"
    )


def per_unit(total: str, count: str) -> str:
    """Money per unit at four decimals, zero where there is nothing to divide by."""
    return f"COALESCE({exact(total, count)}, CAST(0 AS DECIMAL(38,4)))"


def rate(num: str, den: str) -> str:
    return (
        f"(CASE WHEN ({den}) = 0 THEN 0.0::DOUBLE "
        f"ELSE CAST(({num}) AS DOUBLE) / CAST(({den}) AS DOUBLE) END)"
    )


def money(expr: str) -> str:
    return f"CAST(COALESCE({expr}, 0) AS DECIMAL(38,4))"
