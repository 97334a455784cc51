"""Rewrites of program expressions. Each keeps every effect: a rule that drops or repeats a part asks that it be pure."""

from __future__ import annotations

import functools

from .grammar import HASHES, LANE, WRITES, Dialect
from .nodes import Call, Const, Node, walk
from .semantics import pure as pure_table

COMMUTATIVE = {"safe_add", "safe_mul", "safe_min", "safe_max", "eq", "equal", "sum3", "median3", "bit_xor", "bit_and", "bit_or", "and_bool", "or_bool"}
TERNARY = {"if_then_else", "if_then_else_int", "if_then_else_str", "if_then_else_bool"}
#: Conditional effects: what they are if the condition holds, and the read they are if it does not.
CONDITIONAL = {"updatecount_if": ("update_count", "query_count"), "writecount_if": ("write_count", "query_count"), "writestate_if": ("update_state", "query_state"), "update_if": ("update_count", "query_count")}
_FOLD = {"safe_add", "safe_sub", "safe_mul", "safe_div", "safe_mod", "abs_int", "lt", "gt", "eq", "less", "greater", "equal", "safe_min", "safe_max", "sum3", "median3", "bit_xor", "bit_and", "bit_or", "and_bool", "or_bool", "not_bool", "bit_test"}


def is_pure(node: Node) -> bool:
    return not any(isinstance(n, Call) and n.name in WRITES for n in walk(node))


def _is(node: Node, value: int) -> bool:
    return isinstance(node, Const) and not isinstance(node.value, bool) and node.value == value


def _rule(n: Call, dialect: Dialect) -> Node:
    """One step at the top of a node whose parts are simplified."""
    a, name = n.args, n.name
    if name in HASHES and isinstance(a[0], Const) and a[0].value not in (0, 1, 2):
        return Call(name, (Const(a[0].value % 3), *a[1:]))
    lane = LANE.get(name)
    if lane is not None and isinstance(a[lane], Const) and a[lane].value not in (0, 1, 2):
        return Call(name, (*a[:lane], Const(a[lane].value % 3), *a[lane + 1 :]))
    if name in TERNARY:
        c, yes, no = a
        if isinstance(c, Const) and is_pure(no if c.value else yes):
            return yes if c.value else no
        if yes == no and is_pure(n):
            return yes
    if name in CONDITIONAL and isinstance(a[0], Const):
        if a[0].value:
            return Call(CONDITIONAL[name][0], a[1:])
        if is_pure(a[3]):
            return Call(CONDITIONAL[name][1], a[1:3])
    if name == "abs_int" and isinstance(a[0], Call) and a[0].name in HASHES | {"abs_int"}:
        return a[0]
    if name == "safe_add":
        if _is(a[1], 0):
            return a[0]
        if _is(a[0], 0):
            return a[1]
    if name == "safe_sub":
        if _is(a[1], 0):
            return a[0]
        if a[0] == a[1] and is_pure(n):
            return Const(0)
    if name == "safe_mul":
        for x, y in (a, a[::-1]):
            if _is(x, 1):
                return y
            if _is(x, 0) and is_pure(y):
                return Const(0)
    if name == "safe_div" and (_is(a[1], 1) or _is(a[1], 0)):
        return a[0]
    if name in ("safe_div", "safe_mod") and _is(a[0], 0) and is_pure(a[1]):
        return Const(0)
    if name == "safe_mod":
        if (_is(a[1], 1) or _is(a[1], 0) or _is(a[1], -1)) and is_pure(a[0]):
            return Const(0)
        if isinstance(a[0], Call) and a[0].name == "safe_mod" and a[0].args[1] == a[1] and is_pure(a[1]):
            return a[0]
    if len(a) == 2 and a[0] == a[1] and is_pure(n):
        if name in ("safe_min", "safe_max", "bit_and", "bit_or", "and_bool", "or_bool"):
            return a[0]
        if name in ("eq", "equal"):
            return Const(True)
        if name in ("lt", "gt", "less", "greater"):
            return Const(False)
    if name == "base_sel" and is_pure(n):
        mode, *arms = a
        if arms[0] == arms[1] == arms[2] and mode != Const(0):
            return Call(name, (Const(0), *arms))
        if isinstance(mode, Const) and mode.value not in (0, 1, 2, 3):
            return Call(name, (Const(abs(mode.value) % 4), *arms))
        if mode == Const(2) and len(set(arms)) == 2:
            twice = next(x for x in arms if arms.count(x) == 2)
            return Call(name, (Const(0), twice, twice, twice))
        if isinstance(mode, Const) and arms != sorted(arms, key=lambda x: x.text()):
            return Call(name, (mode, *sorted(arms, key=lambda x: x.text())))
    if name in _FOLD and all(isinstance(x, Const) for x in a):
        value = pure_table(dialect.geometry)[name](*(x.value for x in a))
        if abs(value) < 1 << 62:
            return Const(value)
    if name in COMMUTATIVE and is_pure(n):
        ordered = tuple(sorted(a, key=lambda x: x.text()))
        if ordered != a:
            return Call(name, ordered)
    return n


def simplify(node: Node, dialect: Dialect) -> Node:
    """The expression with all rules applied, from its leaves up."""

    @functools.cache
    def go(n: Node) -> Node:
        if not isinstance(n, Call):
            return n
        new = Call(n.name, tuple(go(x) for x in n.args))
        stepped = _rule(new, dialect)
        return new if stepped == new else go(stepped)

    return go(node)


def canonical_text(node: Node, dialect: Dialect) -> str:
    return simplify(node, dialect).text()
