"""Expressions of sketch programs: typed trees without behaviour."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass


@dataclass(frozen=True)
class Item:
    """The stream item that a program is applied to."""

    def text(self) -> str:
        return "e"


@dataclass(frozen=True, eq=False)
class Const:
    value: int | bool

    def __eq__(self, other: object) -> bool:
        # True and 1 are different constants: they read differently in a salt
        return isinstance(other, Const) and type(other.value) is type(self.value) and other.value == self.value

    def __hash__(self) -> int:
        return hash((type(self.value), self.value))

    def text(self) -> str:
        return str(self.value)


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple

    def text(self) -> str:
        return f"{self.name}({', '.join(a.text() for a in self.args)})"


Node = Item | Const | Call


def walk(node: Node) -> Iterator[Node]:
    """Every node, parents before children."""
    yield node
    if isinstance(node, Call):
        for a in node.args:
            yield from walk(a)


def names(node: Node) -> dict[str, int]:
    found: dict[str, int] = {}
    for n in walk(node):
        if isinstance(n, Call):
            found[n.name] = found.get(n.name, 0) + 1
    return found


def uses_item(node: Node) -> bool:
    return any(isinstance(n, Item) for n in walk(node))


def height(node: Node) -> int:
    return 1 + max(map(height, node.args), default=0) if isinstance(node, Call) else 0


def size(node: Node) -> int:
    return sum(1 for _ in walk(node))


def call(name: str, *args) -> Call:
    return Call(name, tuple(Const(a) if isinstance(a, (int, bool)) else a for a in args))
