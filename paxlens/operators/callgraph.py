"""From a syntax tree to a call graph that carries argument values.

One pure function per file, driven by tables: ``ROUTES`` says which children of a node are visited and in what context,
``RENDER`` how an argument's value is written down.  The walk is breadth first, by level, at most ``LEVELS`` deep; node
ids count upwards in the order of creation.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas

LEVELS = 50
DIRECT = ("top_level", "function_body")  # contexts whose calls hang on their parent by ``calls``
CALLBACK = ("call_argument", "array_element", "object_property")
POSITIONS = ("loc", "start", "end", "range", "comments")  # keys of a tree that hold no code

#: children visited, in order, with their context; None keeps the node's own
ROUTES = {
    "AssignmentExpression": (("left", "assignment_left"), ("right", "assignment_right")),
    "MemberExpression": (("object", "member_object"), ("property", "member_property")),
    "ExpressionStatement": (("expression", None),),
    "IfStatement": (("test", "condition"), ("consequent", "branch"), ("alternate", "branch")),
    "ForStatement": (("init", "loop_init"), ("test", "loop_condition"), ("update", "loop_update"), ("body", "loop_body")),
    "WhileStatement": (("test", "loop_condition"), ("body", "loop_body")),
    "BlockStatement": (("body", "function_body"),),
}


def name_of(expr: dict | None) -> str:
    """Dotted name of a callee's object or a constructor."""
    if expr is None:
        return "unknown"
    kind = expr.get("type")
    if kind == "Identifier":
        return expr.get("name", "unknown")
    if kind == "MemberExpression":
        return f"{name_of(expr.get('object', {}))}.{(expr.get('property') or {}).get('name', 'unknown')}"
    return "this" if kind == "ThisExpression" else (kind or "unknown").lower()


def call_chain(call: dict) -> tuple[str, int, str, dict | None]:
    """(name, chain depth, position, base call) of a CallExpression."""
    callee = call.get("callee") or {}
    if callee.get("type") == "Identifier":
        return callee.get("name", "unknown"), 0, "simple_call", None
    if callee.get("type") != "MemberExpression":
        return "unknown", 0, "unknown", None
    base, prop = callee.get("object") or {}, (callee.get("property") or {}).get("name", "unknown")
    if base.get("type") == "CallExpression":
        name, depth, _, _ = call_chain(base)
        return f"{name}.{prop}", depth + 1, "chained", base
    return f"{name_of(base)}.{prop}", 0, "member_call", None


def _literal(node: dict) -> tuple[str, str]:
    value = node.get("value")
    if isinstance(value, str):
        return "string", value
    if isinstance(value, (bool, int, float)):  # booleans among them: "True" and "False", as numbers
        return "number", str(value)
    return "literal", "null" if value is None else str(value)


def _update(node: dict, text) -> str:
    sign, inner = node.get("operator", "++"), text(node.get("argument") or {})
    return sign + inner if node.get("prefix", True) else inner + sign


def _member(node: dict) -> str:
    inner, prop = value_of(node.get("object")), value_of(node.get("property"))
    return f"{inner}[{prop}]" if node.get("computed") else f"{inner}.{prop}"


def _property(prop: dict) -> str:
    key, value = prop.get("key") or {}, prop.get("value") or {}
    if key.get("type") == "Identifier":
        left = key.get("name", "unknown")
    elif key.get("type") in ("Literal", "StringLiteral"):
        left = f'"{key["value"]}"' if isinstance(key.get("value"), str) else str(key.get("value"))
    else:
        left = "unknown"
    if value.get("type") == "BooleanLiteral":
        return f"{left}: {'true' if value.get('value') else 'false'}"
    return f"{left}: {value_of(value)}"


def _object(node: dict) -> str:
    return "{" + ", ".join(_property(p) for p in node.get("properties", []) if p.get("type") in ("Property", "ObjectProperty")) + "}"


def _template(node: dict) -> str:
    out, holes = [], iter(node.get("expressions", []))
    for quasi in node.get("quasis", []):
        out.append((quasi.get("value") or {}).get("raw", ""))
        if (hole := next(holes, _template)) is not _template:
            out.append("${" + in_template(hole) + "}")
    return "".join(out)


def in_template(expr: dict | None) -> str:
    """An expression as it is written inside a template's ${}."""
    kind = (expr or {}).get("type")
    if kind is None:
        return "unknown"
    if kind == "Identifier":
        return expr.get("name", "unknown")
    if kind == "UpdateExpression":
        return _update({"operator": "", **expr}, in_template)
    if kind in ("Literal", "StringLiteral", "NumericLiteral"):
        return f'"{expr["value"]}"' if isinstance(expr.get("value"), str) else str(expr.get("value"))
    if kind == "BooleanLiteral":
        return "true" if expr.get("value") else "false"
    if kind == "CallExpression":
        return f"{call_chain(expr)[0]}({', '.join(in_template(a) for a in expr.get('arguments', []) if a is not None)})"
    if kind == "MemberExpression":
        prop = (expr.get("property") or {}).get("name", "unknown")
        return in_template(expr.get("object")) + (f"[{prop}]" if expr.get("computed") else f".{prop}")
    if kind == "BinaryExpression":
        return f"{in_template(expr.get('left'))} {expr.get('operator', '')} {in_template(expr.get('right'))}"
    return kind


#: label and text of an argument by its node type; other types are ("unknown", type)
RENDER = {
    **dict.fromkeys(("Literal", "StringLiteral", "NumericLiteral", "BooleanLiteral"), _literal),
    "Identifier": lambda n: ("variable", n.get("name", "unknown")),
    "TemplateLiteral": lambda n: ("template", _template(n)),
    "CallExpression": lambda n: ("function_call", call_chain(n)[0]),
    "ObjectExpression": lambda n: ("object", _object(n)),
    "ArrayExpression": lambda n: ("array", "[" + ", ".join("null" if e is None else value_of(e) for e in n.get("elements", [])) + "]"),
    "MemberExpression": lambda n: ("member_access", _member(n)),
    "BinaryExpression": lambda n: ("binary_expression", f"{value_of(n.get('left'))} {n.get('operator', '?')} {value_of(n.get('right'))}"),
    "UpdateExpression": lambda n: ("update_expression", _update(n, value_of)),
    "RegExpLiteral": lambda n: ("regex", f"/{n.get('pattern', '')}/{n.get('flags', '')}"),
}


def rendered(arg: dict | None) -> tuple[str, str]:
    if not arg:
        return "null", "null"
    kind = arg.get("type")
    return RENDER[kind](arg) if kind in RENDER else ("unknown", kind)


def value_of(arg: dict | None) -> str:
    return rendered(arg)[1]


class _Walk:
    def __init__(self, program: dict):
        self.nodes: list[dict] = []
        self.edges: dict[tuple[str, str, str], None] = {}  # ordered, each once
        self.calls: dict[int, str] = {}  # CALL of a tree node, by identity
        self.functions: dict[str, str] = {}  # FUNCTION_DEF by name, the last one
        self.queue: deque[tuple[dict, str, str]] = deque()
        root = self.node("FILE", "file")
        self.push(program.get("body"), root, "top_level")
        for _ in range(LEVELS):
            for _ in range(len(self.queue)):
                self.visit(*self.queue.popleft())
            if not self.queue:
                break

    def node(self, kind: str, label: str, **fields) -> str:
        node_id = f"n{len(self.nodes)}"
        self.nodes.append({"node_seq": len(self.nodes), "node_id": node_id, "type": kind, "label": label, **fields})
        return node_id

    def edge(self, src: str, dst: str, kind: str) -> None:
        self.edges.setdefault((src, dst, kind))

    def push(self, child, parent: str, context: str) -> None:
        for c in child if isinstance(child, list) else [child]:
            if isinstance(c, dict) and c.get("type"):
                self.queue.append((c, parent, context))

    def body(self, body: dict | None, parent: str) -> None:
        if body:
            self.push(body.get("body") if body.get("type") == "BlockStatement" else body, parent, "function_body")

    def visit(self, node: dict, parent: str, context: str) -> None:
        kind = node["type"]
        if special := getattr(self, f"on_{kind}", None):
            special(node, parent, context)
        elif kind in ROUTES:
            for key, inner in ROUTES[kind]:
                self.push(node.get(key), parent, inner or context)
        else:  # anything else: all children in the tree's own order
            for key, value in node.items():
                if key not in POSITIONS:
                    self.push(value, parent, context)

    def hang(self, parent: str, call: str, context: str) -> None:
        self.edge(parent, call, "calls" if context in DIRECT else "nested_in")

    def arguments(self, args: list, call: str) -> None:
        for i, arg in enumerate(args or []):
            label, content = rendered(arg)
            at = self.node("ARGUMENT", label, arg_index=i, content=content)
            self.edge(call, at, "has_arg")
            self.push(arg, at, "call_argument")

    def on_CallExpression(self, node: dict, parent: str, context: str) -> None:
        name, depth, position, base = call_chain(node)
        call = self.node("CALL", "call", callee_name=name, is_chained=base is not None, is_member_call=position in ("chained", "member_call"), call_depth=depth, chain_position=position)
        self.calls[id(node)] = call
        if base is not None:  # the base is handled first, and stands in for the parent
            if id(base) not in self.calls:
                self.on_CallExpression(base, parent, context)
            self.edge(self.calls[id(base)], call, "chained_call")
        else:
            self.hang(parent, call, context)
        callee = node.get("callee") or {}
        if callee.get("type") == "Identifier" and callee.get("name") in self.functions:
            self.edge(call, self.functions[callee["name"]], "resolves_to_def")
        self.arguments(node.get("arguments"), call)
        if callee.get("type") in ("FunctionExpression", "ArrowFunctionExpression"):
            self.body(callee.get("body"), call)
        elif callee.get("type") in ("CallExpression", "MemberExpression"):
            self.push(callee, call, "callee")

    def on_NewExpression(self, node: dict, parent: str, context: str) -> None:
        call = self.node("CALL", "call", callee_name=f"new {name_of(node.get('callee', {}))}", is_constructor=True)
        self.hang(parent, call, context)
        self.arguments(node.get("arguments"), call)

    def on_FunctionDeclaration(self, node: dict, parent: str, context: str) -> None:
        name = (node.get("id") or {}).get("name", "anonymous")
        at = self.node("FUNCTION_DEF", "function_def", function_name=name, is_async=bool(node.get("async")), is_generator=bool(node.get("generator")))
        if name != "anonymous":
            self.functions[name] = at
        self.edge(parent, at, "defines")
        self.parameters(node, at)

    def on_FunctionExpression(self, node: dict, parent: str, context: str) -> None:
        callback = context in CALLBACK
        at = self.node("ANONYMOUS_FUNCTION", "anonymous_function", is_callback=callback, is_async=bool(node.get("async")))
        self.edge(parent, at, "callback" if callback else "defines")
        self.parameters(node, at)

    on_ArrowFunctionExpression = on_FunctionExpression

    def parameters(self, node: dict, function: str) -> None:
        short = {"ObjectPattern": "{...}", "ArrayPattern": "[...]"}
        for p in node.get("params") or []:
            if p is not None:
                kind = p.get("type", "unknown")
                name = p.get("name", "unknown") if kind == "Identifier" else short.get(kind, kind)
                self.edge(function, self.node("PARAMETER", "parameter", parameter_name=name), "has_param")
        self.body(node.get("body"), function)

    def on_ClassDeclaration(self, node: dict, parent: str, context: str) -> None:
        at = self.node("CLASS", "class", class_name=(node.get("id") or {}).get("name", "anonymous"))
        self.edge(parent, at, "defines")
        body = node.get("body") or {}
        if body.get("type") == "ClassBody":
            self.push(body.get("body"), at, "class_member")

    def on_VariableDeclaration(self, node: dict, parent: str, context: str) -> None:
        for d in node.get("declarations") or []:
            self.push((d or {}).get("init"), parent, "variable_init")


def call_graph(program: dict) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of one file's program."""
    walk = _Walk(program)
    return walk.nodes, [{"edge_seq": i, "src": s, "dst": d, "type": t} for i, (s, d, t) in enumerate(walk.edges)]


def graphs(asts: DataFrame) -> DataFrame:
    """One row per tree: nodes, edges, error, the seconds it took and when.  A tree that failed, or can't be read, keeps its row with an error."""
    import time

    import pandas as pd

    def run(batches):
        for pdf in batches:
            nodes, edges, errors, took, at = [], [], [], [], []
            for ok, tree, error in zip(pdf.success, pdf.ast, pdf.error):
                n = e = None
                began = time.perf_counter()
                try:
                    if not ok:
                        raise ValueError(error or "no tree")
                    n, e = call_graph(json.loads(tree)["program"])
                    error = None
                except (ValueError, KeyError, TypeError, AttributeError, RecursionError) as x:
                    error = f"{type(x).__name__}: {x}"
                nodes.append(n)
                edges.append(e)
                errors.append(error)
                took.append(time.perf_counter() - began)
                at.append(pd.Timestamp.now(tz="UTC"))
            yield pd.DataFrame({"package_id": pdf.package_id, "data_type": pdf.data_type, "rel_path": pdf.rel_path, "nodes": _filled(nodes, schemas.NODE_FIELDS), "edges": edges, "error": errors, "seconds": took, "at": pd.Series(at, dtype="datetime64[us, UTC]")})

    return asts.mapInPandas(run, schemas.GRAPHS)


def _filled(lists: list[list[dict] | None], fields: str) -> list:
    names = [x.split()[0] for x in fields.split(", ")]
    return [None if rows is None else [{k: r.get(k) for k in names} for r in rows] for rows in lists]


def graph_tables(files: DataFrame, file_key: str = "basename") -> tuple[DataFrame, DataFrame]:
    """(graph_nodes, graph_edges) of graphs(), one row per node or edge; ``file_key`` is basename or path."""
    key = F.col("rel_path") if file_key == "path" else F.element_at(F.split("rel_path", "/"), -1)
    base = files.where("error is null").withColumn("file_key", key)
    nodes = base.select("package_id", "file_key", "rel_path", F.inline("nodes"))
    edges = base.select("package_id", "file_key", "rel_path", F.inline("edges"))
    return nodes, edges


def tree_check(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """package_id, file_key, roots, valid: a file's graph is valid with exactly one FILE node that no edge enters."""
    by = ["package_id", "file_key"]
    roots = nodes.where("type = 'FILE'").join(edges.select(*by, F.col("dst").alias("node_id")), [*by, "node_id"], "left_anti")
    counted = roots.groupBy(*by).agg(F.array_sort(F.collect_list("node_id")).alias("roots"))
    return nodes.select(*by).distinct().join(counted, by, "left").withColumn("roots", F.coalesce("roots", F.array().cast("array<string>"))).withColumn("valid", F.size("roots") == 1)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per file: totals, functions, calls, classes, chained calls, distinct base calls."""
    by = ["package_id", "file_key"]
    n = nodes.groupBy(*by).agg(
        F.count("*").alias("total_nodes"),
        F.count_if(F.col("type").isin("FUNCTION_DEF", "ANONYMOUS_FUNCTION")).alias("functions"),
        F.count_if(F.col("type") == "CALL").alias("calls"),
        F.count_if(F.col("type") == "CLASS").alias("classes"),
    )
    e = edges.groupBy(*by).agg(F.count("*").alias("total_edges"), F.count_if(F.col("type") == "chained_call").alias("total_calls"), F.countDistinct(F.when(F.col("type") == "chained_call", F.col("src"))).alias("base_calls"))
    return n.join(e, by, "left").fillna(0, ["total_edges", "total_calls", "base_calls"]).withColumn("has_calls", F.col("total_calls") > 0)
