"""Put a query body together with exactly the CTEs it needs."""

from __future__ import annotations

import re

from oracle.inputs import INPUTS, NOW
from oracle.layers import LAYERS


def _expand() -> dict[str, str]:
    ctes = dict(INPUTS)
    for name, body in LAYERS.items():
        if "@S" not in name:
            ctes[name] = body
            continue
        for s in (0, 2):
            if name.replace("@S", str(s)) in LAYERS:
                continue
            ctes[name.replace("@S", str(s))] = body.replace("@S", str(s)).replace(
                "@NOW", f"{NOW[s]}::bigint"
            )
    return ctes


CTES = _expand()


def _used(text: str) -> list[str]:
    words = set(re.findall(r"\w+", text))
    return [n for n in CTES if n in words]


def _ordered(text: str) -> list[str]:
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for dep in _used(CTES[name]):
            if dep != name:
                visit(dep)
        done.append(name)

    for name in _used(text):
        visit(name)
    return done


def column(spec: str) -> str:
    """``name`` as is, ``name~`` rounded to 4 digits, ``name~6`` to 6."""
    name, mark, digits = spec.partition("~")
    return f"round({name}, {digits or 4}) + 0e0 as {name}" if mark else name


def sql(body: str, columns: str) -> str:
    """Full SQL: the CTEs behind ``body`` and the listed columns of it."""
    names = _ordered(body)
    head = ",\n".join(f"{n} as ({CTES[n].strip()})" for n in names)
    source = body if re.fullmatch(r"\w+", body) else f"({body}) q"
    picked = ", ".join(column(c) for c in columns.split())
    return (f"with {head}\n" if head else "") + f"select {picked} from {source}"
