"""The three grammars of a sketch program, in the wide (102 x 102) and the compact (16 x 16) geometry, and their parser.

A program is three expressions over the item e: init_dex (a list of three cell addresses), update and query (floats).
bool may stand where int is asked for; int stands for bool only where the parser is told to coerce."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from .nodes import Call, Const, Item, Node

PLANES = 3
COUNTER_MAX = (1 << 32) - 1
WRITES = {"update_count", "write_count", "update_state", "updatecount_if", "writecount_if", "writestate_if", "update_if", "wrtstate_if", "cu_update", "cu_update_if"}
READS = {"query_count", "query_state", "query_date", "cnt_rdstate"}
#: Where the lane stands among the arguments.
LANE = dict.fromkeys(("query_count", "query_state", "query_date", "cnt_rdstate", "update_count", "write_count", "update_state"), 1) | dict.fromkeys(("updatecount_if", "writecount_if", "writestate_if", "update_if", "wrtstate_if"), 2)
HASHES = {"select_hash", "hash_salt", "hash_on_slice"}


@dataclass(frozen=True)
class Geometry:
    rows: int
    cols: int
    overflow_read: int
    #: Moduli of columns are held to 1..cap, if there is a cap.
    cap: int | None = None
    #: A slice with a negative bound counts from the end (wide) or from 0 (compact).
    slice_wraps: bool = True
    #: An update by 0 counts as an update by 1.
    zero_is_one: bool = False


WIDE = Geometry(102, 102, 1 << 32)
COMPACT = Geometry(16, 16, 1 << 60, cap=16, slice_wraps=False, zero_is_one=True)


class ProgramError(ValueError):
    """The text is no expression of the grammar."""


@dataclass
class Grammar:
    name: str
    root: str
    signatures: dict[str, tuple[tuple[str, ...], str]] = field(default_factory=dict)
    #: Behaviour of primitives added by register(): on Python values, and on columns if it can be lowered.
    python: dict[str, Callable] = field(default_factory=dict)
    columns: dict[str, Callable] = field(default_factory=dict)

    def register(self, name: str, args: tuple[str, ...], returns: str, python: Callable, column: Callable | None = None) -> None:
        """Add a pure primitive."""
        self.signatures[name] = (tuple(args), returns)
        self.python[name] = python
        if column is not None:
            self.columns[name] = column

    def allowed(self) -> list[str]:
        return sorted(self.signatures)

    def parse(self, text: str, coerce: bool = False, fixes: list[str] | None = None) -> Node:
        """The typed tree of an expression. coerce: 0 and 1 may stand for bool, each noted in fixes."""
        return _Parser(self, text, coerce, fixes).whole()


def _table(text: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """Lines `name name: args > result`, args as letters: i int, b bool, s str, f float, l list."""
    kinds = {"i": "int", "b": "bool", "s": "str", "f": "float", "l": "list"}
    out = {}
    for line in text.split("\n"):
        if line.strip():
            left, _, result = line.partition(">")
            heads, _, args = left.partition(":")
            for name in heads.split():
                out[name] = (tuple(kinds[a] for a in args.strip()), kinds[result.strip()])
    return out


_ARITHMETIC = """
safe_add safe_sub safe_mul safe_div safe_mod: ii > i
abs_int: i > i
"""
_COMPARE = "lt gt eq: ii > b"
_COMPARE_COMPACT = "greater less equal: ii > b"
_HASH = """
select_hash: is > i
hash_salt: isi > i
hash_on_slice: isii > i
"""
_BITS = "bit_xor bit_and bit_or shl shr: ii > i"
_SLICE = "str_slice: sii > s"

INIT = Grammar("init_dex", "list", _table(_HASH + _ARITHMETIC + _COMPARE + "\nif_then_else_int: bii > i\nlist_3: iiiiiiiii > l\n" + _SLICE))
UPDATE = Grammar("update", "float", _table(_ARITHMETIC + _COMPARE + """
if_then_else: bii > i
base: iii > f
write_count update_count: sii > i
update_state: sib > i
query_count: si > i
query_state: si > b
updatecount_if writecount_if: bsii > i
writestate_if: bsib > i
""" + _SLICE))
QUERY = Grammar("query", "float", _table(_ARITHMETIC + _COMPARE + """
safe_min safe_max: ii > i
sum3 median3: iii > i
if_then_else: bii > i
base_sel: iiii > f
query_date: si > i
cnt_rdstate: si > b
""" + _SLICE))
COMPACT_INIT = Grammar("init_dex", "list", _table(_HASH + _ARITHMETIC + _COMPARE_COMPACT + "\n" + _BITS + """
affine seg_row_index row_route: iii > i
seg_id cap2_4_16 cap2_8_16: ii > i
cap_half: iiii > i
cap_quartile: iiiiii > i
str_concat: ss > s
str_len: s > i
int_to_str: i > s
and_bool or_bool: bb > b
not_bool: b > b
if_then_else_int: bii > i
if_then_else_str: bss > s
if_then_else_bool: bbb > b
list_3: iiiiiiiii > l
""" + _SLICE))
COMPACT_UPDATE = Grammar("update", "float", _table(_HASH + _ARITHMETIC + _COMPARE_COMPACT + "\n" + _BITS + """
bit_test: ii > b
if_then_else_int: bii > i
cnt_rdstate: si > b
query_count: si > i
update_count: sii > i
update_if: bsii > i
wrtstate_if: bsib > b
cu_update: si > i
cu_update_if: bsi > i
base: iii > f
""" + _SLICE))
COMPACT_QUERY = Grammar("query", "float", _table("safe_add safe_sub safe_mul safe_div safe_mod safe_min safe_max: ii > i\n" + _COMPARE + """
if_then_else_int: bii > i
query_date: si > i
base_sel: iiii > f
""" + _SLICE))


@dataclass(frozen=True)
class Dialect:
    name: str
    init: Grammar
    update: Grammar
    query: Grammar
    geometry: Geometry


MAIN = Dialect("wide", INIT, UPDATE, QUERY, WIDE)
BUSY = Dialect("compact", COMPACT_INIT, COMPACT_UPDATE, COMPACT_QUERY, COMPACT)


class _Parser:
    TOKEN = re.compile(r"\s*(?:(-?\d+)(?![\w.])|([A-Za-z_]\w*)|([(),]))")

    def __init__(self, grammar: Grammar, text: str, coerce: bool, fixes: list[str] | None):
        self.grammar, self.text, self.coerce, self.fixes, self.at = grammar, text, coerce, fixes, 0

    def token(self, peek: bool = False) -> str:
        m = self.TOKEN.match(self.text, self.at)
        if not m:
            raise ProgramError(f"unreadable at {self.at}: {self.text[self.at : self.at + 20]!r}")
        if not peek:
            self.at = m.end()
        return m.group().strip()

    def take(self, want: str) -> None:
        got = self.token()
        if got != want:
            raise ProgramError(f"{want!r} is missing before {got!r}")

    def whole(self) -> Node:
        node, kind = self.expression(self.grammar.root)
        if self.text[self.at :].strip():
            raise ProgramError(f"text after the expression: {self.text[self.at :][:20]!r}")
        if kind != self.grammar.root:
            raise ProgramError(f"the root is {kind}, not {self.grammar.root}")
        return node

    def expression(self, want: str) -> tuple[Node, str]:
        head = self.token()
        if re.fullmatch(r"-?\d+", head):
            node, kind = Const(int(head)), "int"
            if want == "bool" and self.coerce and node.value in (0, 1):
                if self.fixes is not None:
                    self.fixes.append(f"{head} read as {bool(node.value)}")
                node, kind = Const(bool(node.value)), "bool"
        elif head in ("True", "False"):
            node, kind = Const(head == "True"), "bool"
        elif head == "e":
            node, kind = Item(), "str"
        elif head in self.grammar.signatures:
            args, kind = self.grammar.signatures[head]
            self.take("(")
            parts = []
            for i, a in enumerate(args):
                if i:
                    self.take(",")
                parts.append(self.expression(a)[0])
            self.take(")")
            node = Call(head, tuple(parts))
        else:
            raise ProgramError(f"{head!r} is no primitive of {self.grammar.name}")
        if kind != want and not (want == "int" and kind == "bool"):
            raise ProgramError(f"{node.text()} is {kind}, not {want}")
        return node, kind
