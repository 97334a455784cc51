"""Parser, rewrites, primitives and classifiers, without Spark."""

import random

import pytest
from programs import PROGRAMS, SALTED

from sketchloom.plans.analyze import MECHANISM_PROGRAMS, architecture, families, legality, lint, mechanism, mechanism_distance, motif, motif_distance, numeric_risk, role_entropy, structural_penalty
from sketchloom.plans.grammar import BUSY, MAIN, WIDE, Grammar, ProgramError
from sketchloom.plans.nodes import Call, Const, Item
from sketchloom.plans.program import Program, classify
from sketchloom.plans.rewrite import simplify
from sketchloom.plans.semantics import fuse, pure, segment_row, tier
from sketchloom.search.trees import Trees

T, C = pure(WIDE), pure(BUSY.geometry)


@pytest.mark.parametrize(
    "name, args, want",
    [
        ("safe_div", (-7, 3), -3), ("safe_div", (7, 0), 7), ("safe_mod", (7, -3), -2), ("safe_mod", (-7, 3), 2), ("safe_mod", (5, 0), 0),
        ("abs_int", (-4,), 4), ("safe_add", (True, 2), 3), ("median3", (3, 1, 2), 2), ("sum3", (1, 2, 3), 6), ("lt", (1, 2), True),
        ("if_then_else", (False, 1, 2), 2), ("str_slice", ("abcdef", -3, -1), "de"), ("str_slice", ("abc", False, True), "a"),
        ("select_hash", (3, "a"), 0x0CC175B9C0F1B6A831C399E269772661), ("bit_xor", (6, 3), 5), ("shl", (1, 33), 4), ("shr", (-8, 1), -4),
        ("bit_test", (5, 2), True), ("affine", (2, 3, 4), 14), ("seg_id", (-7, 4), 3), ("seg_id", (7, 0), 0),
    ],
)
def test_primitives(name, args, want):
    assert T[name](*args) == want


def test_compact_slice_and_salts():
    assert C["str_slice"]("abcdef", -3, 2) == "ab"
    assert T["hash_salt"](0, "x", True) == T["select_hash"](0, "x|True")
    assert T["hash_on_slice"](1, "abcd", 1, -1) == T["select_hash"](1, "bc")


def test_segments_cover_rows():
    for n in range(1, 20):
        seen = {segment_row(16, h, s, n) for s in range(n) for h in range(16)}
        assert seen == set(range(16))
    assert [tier(s, 8, (2, 4, 8, 99), 16) for s in range(8)] == [2, 2, 4, 4, 8, 8, 16, 16]
    assert [fuse(m, 3, 1, 8) for m in range(5)] == [1.0, 8.0, 3.0, 4.0, 1.0]


def test_parser_is_strict():
    assert MAIN.init.parse(SALTED).text() == SALTED
    assert MAIN.update.parse(" base( 1,True ,-1) ").text() == "base(1, True, -1)"
    for bad in ("base(1, 2)", "base(1, 2, 3) x", "update_state(e, 0, True)", "base(update_state(e, 0, 1), 0, 0)", "base(foo(1), 2, 3)", "base(e, 1, 2)", "", "base(1.5, 1, 1)", "[]"):
        with pytest.raises(ProgramError):
            MAIN.update.parse(bad)
    notes = []
    node = MAIN.update.parse("base(update_state(e, 0, 1), 0, 0)", coerce=True, fixes=notes)
    assert node.args[0].args[2] == Const(True) and notes


def test_register_adds_a_primitive():
    g = Grammar("init_dex", "list", dict(MAIN.init.signatures))
    g.register("twice", ("int",), "int", lambda x: 2 * x)
    assert "twice" in g.allowed() and g.parse("list_3(twice(1), 1, 1, 1, 1, 1, 1, 1, 1)").args[0].name == "twice"


@pytest.mark.parametrize(
    "grammar, before, after",
    [
        (MAIN.init, "select_hash(7, e)", "select_hash(1, e)"),
        (MAIN.init, "if_then_else_int(True, 5, select_hash(0, e))", "5"),
        (MAIN.init, "abs_int(abs_int(safe_sub(1, 4)))", "3"),
        (MAIN.init, "safe_mod(safe_mod(select_hash(0, e), 7), 7)", "safe_mod(select_hash(0, e), 7)"),
        (MAIN.init, "safe_sub(select_hash(0, e), select_hash(0, e))", "0"),
        (MAIN.init, "safe_add(3, select_hash(0, e))", "safe_add(3, select_hash(0, e))"),
        (MAIN.init, "safe_add(select_hash(0, e), 3)", "safe_add(3, select_hash(0, e))"),
        (MAIN.update, "updatecount_if(True, e, 4, 1)", "update_count(e, 1, 1)"),
        (MAIN.update, "updatecount_if(False, e, 0, 1)", "query_count(e, 0)"),
        (MAIN.update, "updatecount_if(False, e, 0, update_count(e, 1, 1))", "updatecount_if(False, e, 0, update_count(e, 1, 1))"),
        (MAIN.update, "safe_mul(update_count(e, 0, 1), 0)", "safe_mul(update_count(e, 0, 1), 0)"),
        (MAIN.update, "if_then_else(True, 1, update_count(e, 0, 1))", "if_then_else(True, 1, update_count(e, 0, 1))"),
        (MAIN.update, "safe_mod(0, update_count(e, 0, 1))", "safe_mod(0, update_count(e, 0, 1))"),
        (MAIN.query, "safe_min(query_date(e, 1), query_date(e, 4))", "query_date(e, 1)"),
        (MAIN.query, "base_sel(2, query_date(e, 1), query_date(e, 0), query_date(e, 0))", "base_sel(0, query_date(e, 0), query_date(e, 0), query_date(e, 0))"),
    ],
)
def test_rewrites(grammar, before, after):
    root = {"init_dex": "list_3({}, 1, 1, 1, 1, 1, 1, 1, 1)", "update": "base({}, 0, 0)", "query": "base_sel({}, 0, 1, 2)"}[grammar.name]
    if before.startswith("base_sel"):
        assert simplify(grammar.parse(before), MAIN).text() == after
    else:
        assert simplify(grammar.parse(root.format(before)), MAIN).args[0].text() == after


def test_rewrites_keep_meaning():
    """Random programs mean the same before and after simplification."""
    trees = Trees(random.Random(5))
    init = MAIN.init.parse(SALTED)
    items = [f"k{i % 7}" for i in range(40)]
    for _ in range(250):
        p = Program(init, trees.ramped("update", 2, 4), trees.ramped("query", 2, 4))
        a, b = p.machine(), p.simplified().machine()
        for e in items:
            a.update(e), b.update(e)
        assert {c: v for c, v in a.count.items() if v} == {c: v for c, v in b.count.items() if v}, p.update.text()
        assert {c for c, v in a.flag.items() if v} == {c for c, v in b.flag.items() if v}, p.update.text()
        assert [a.query(e) for e in items] == [b.query(e) for e in items], p.query.text()


def test_random_addresses_keep_meaning():
    trees = Trees(random.Random(6))
    for _ in range(150):
        n = trees.ramped("init_dex", 2, 4)
        p = Program(n, MAIN.update.parse("base(0, 0, 0)"), MAIN.query.parse("base_sel(0, 0, 0, 0)"))
        for e in ("", "abc", "Customer#000000042"):
            assert p.machine().places_of(e) == p.simplified().machine().places_of(e), n.text()


def test_classes_of_examples():
    for name, (kind, p) in PROGRAMS.items():
        assert classify(p).overall == kind, name


def test_legality_penalty_and_lint():
    p = PROGRAMS["triple"][1]
    assert structural_penalty(p).penalty == 0 and not lint(p) and numeric_risk(p) == (0.0, [])
    grows = Program.parse(SALTED, "base(update_count(e, 0, safe_mul(query_count(e, 0), 3)), update_count(e, 1, safe_div(9, query_count(e, 2))), update_count(e, 2, query_count(e, 2)))", "base_sel(0, safe_mul(query_date(e, 0), query_date(e, 1)), 1, 2)")
    assert numeric_risk(grows) == (2.0 + 1.0 + 3.0 + 2.0, ["wide_estimate", "variable_divisor", "self_product", "self_sum"])
    bad = Program(p.init, Call("base", (Call("query_date", (Item(), Const(0))), Const(0), Const(0))), p.query)
    assert legality("update", bad.update) and structural_penalty(bad).cut
    none = Program.parse(SALTED, "base(0, 0, 0)", "base_sel(0, 1, 2, 3)")
    assert structural_penalty(none).cut
    diagonal = Program.parse("list_3(select_hash(0, e), safe_mod(select_hash(0, e), 102), 102, 1, 2, 3, 4, 5, 6)", "base(update_count(e, 0, 1), 0, 0)", "base_sel(0, query_date(e, 0), 1, 2)")
    assert lint(diagonal) == ["lane 0 is diagonal: x and y come from the same hash"]


def test_families_and_schemas():
    a, b = PROGRAMS["triple"][1], PROGRAMS["flags"][1]
    assert families(a).update == "triple-write" and families(a).query == "median-query"
    assert mechanism(a).mechanism_family == "cms_like" and mechanism_distance(mechanism(a)) < mechanism_distance(mechanism(b))
    assert motif_distance(motif(a), motif(a)) == 0 < motif_distance(motif(a), motif(b))
    for family, (update, query) in MECHANISM_PROGRAMS.items():
        assert mechanism(Program.parse(SALTED, update, query)).mechanism_family == family
    m = mechanism(PROGRAMS["promotion"][1])
    assert m.lane_roles == ["scout", "promotion", "promotion"] and m.lane_relations == ["lane0->lane1:on_threshold", "lane0->lane2:on_threshold", "lane1->lane2:on_threshold"]
    assert architecture(a).arch_type == "regular" and architecture(b).arch_type == "overflow" and architecture(PROGRAMS["promotion"][1]).arch_type == "pyramid"
    assert mechanism_distance(mechanism(a)) == 0 and motif(PROGRAMS["conservative"][1])["has_handoff"] and not motif(a)["has_handoff"]
    assert role_entropy(["a", "a", "a"]) == 0 and abs(role_entropy(["a", "b", "c"]) - 1) < 1e-9
