"""A JavaScript parser (ES2020, modules, decorators and JSX included) that emits trees in Babel's shape and key order.

Top-down operator precedence over an on-demand scanner.  Unknown syntax raises ``SyntaxError`` with a position; nothing
is guessed.  Return and await are allowed everywhere, as are imports below other statements; HTML comments count as
comments in scripts.  TypeScript is not covered; ``parse_files`` takes any other parser in place of this one.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from .. import schemas

MOST_BYTES = 10 * 1024 * 1024
TOO_LARGE = "File too large (>10MB)"
MOST_SECONDS = 30.0  # for one file

_SPACE = re.compile(r"(?:[\s\ufeff]|//[^\n\r\u2028\u2029]*|/\*.*?\*/)+", re.S)
_HTML_OPEN = re.compile(r"<!--[^\n\r\u2028\u2029]*")
_HTML_CLOSE = re.compile(r"-->[^\n\r\u2028\u2029]*")  # where a line begins
_JSX_NAME = re.compile(r"[$_\w][$_\w-]*")
_JSX_TEXT = re.compile(r"[^{<]+")
_NAME = re.compile(r"(?:[$_\w]|\\u\{[0-9a-fA-F]+\}|\\u[0-9a-fA-F]{4})+")
_NUMBER = re.compile(r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?")
_STRING = re.compile(r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"")
_REGEX = re.compile(r"/((?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+)/([a-zA-Z]*)")
_PUNCTUATORS = sorted("{ } ( ) [ ] ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? ?. : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => . ... # @".split(), key=len, reverse=True)
_PUNCTUATOR = re.compile("|".join(map(re.escape, _PUNCTUATORS)))
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\s\S]))")
_LONE = re.compile("[\ud800-\udfff]")
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r": "", "\r\n": "", "\u2028": "", "\u2029": ""}
_POWER = {op: p for p, ops in enumerate(("??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= in instanceof", "<< >> >>>", "+ -", "* / %", "**"), 1) for op in ops.split()}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_WORDS = set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false".split())
_BEFORE_REGEX = _WORDS - {"this", "super", "null", "true", "false"}


def _unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        if code := m[1] or m[2] or m[3]:
            return chr(int(code, 16))
        return _PLAIN.get(m[4], m[4])

    text = _ESCAPE.sub(one, text)
    if any("\ud800" <= c <= "\udfff" for c in text):  # pairs become one character, lone halves question marks
        text = _LONE.sub("?", text.encode("utf-16", "surrogatepass").decode("utf-16", "surrogatepass"))
    return text


def _number(text: str) -> int | float:
    t = text.replace("_", "").rstrip("n") if text[:2].lower() != "0x" else text.replace("_", "").rstrip("n")
    if t[:2].lower() in ("0x", "0b", "0o"):
        return int(t, 0)
    if t.isdigit():
        return int(t, 8) if len(t) > 1 and t[0] == "0" and set(t) <= set("01234567") else int(t)
    x = float(t)
    return int(x) if x.is_integer() and abs(x) < 1e21 else x


class Parser:
    def __init__(self, code: str, module: bool = False):
        self.code = code
        self.end = 0  # of the token before
        self.arrows: dict[int, bool] = {}
        self.elements: dict[int, int] = {}
        self.module = module  # HTML comments are for scripts
        start = re.match(r"\ufeff?#![^\n]*", code)
        self.move(start.end() if start else 0)

    # scanner

    def move(self, at: int) -> None:
        """Reads the token that follows ``at``."""
        self.kind, self.text, self.start, self.stop, self.newline = self.scan(at)

    def scan(self, at: int) -> tuple[str, str, int, int, bool]:
        code, newline = self.code, False
        while True:
            if m := _SPACE.match(code, at):
                newline = newline or bool(re.search(r"[\n\r\u2028\u2029]", m[0]))
                at = m.end()
            if not self.module and code.startswith("<!--", at):
                m = _HTML_OPEN.match(code, at)
            elif not self.module and code.startswith("-->", at) and (newline or not code[:at].strip()):
                m = _HTML_CLOSE.match(code, at)
            else:
                break
            at = m.end()
        if at >= len(code):
            return "end", "", at, at, True
        c = code[at]
        if (c.isdigit() or c == "." and code[at + 1 : at + 2].isdigit()) and (m := _NUMBER.match(code, at)):
            return "number", m[0], at, m.end(), newline
        if c in "'\"" and (m := _STRING.match(code, at)):
            return "string", m[0], at, m.end(), newline
        if c == "`":
            return "template", c, at, at + 1, newline
        if m := _NAME.match(code, at):
            return "name", m[0], at, m.end(), newline
        if m := _PUNCTUATOR.match(code, at):
            text = m[0]
            if text == "?." and code[at + 2 : at + 3].isdigit():
                text = "?"
            return "punctuator", text, at, at + len(text), newline
        raise SyntaxError(f"unexpected character {c!r} at {at}")

    def next(self) -> str:
        text, self.end = self.text, self.stop
        self.move(self.stop)
        return text

    def peek(self) -> tuple[str, str, int, int, bool]:
        return self.scan(self.stop)

    def at(self, *texts: str) -> bool:
        return self.kind in ("punctuator", "name") and self.text in texts

    def eat(self, text: str) -> bool:
        if self.at(text):
            self.next()
            return True
        return False

    def need(self, text: str) -> None:
        if not self.eat(text):
            self.fail(f"{text!r} expected")

    def fail(self, why: str = "unexpected token"):
        raise SyntaxError(f"{why} at {self.start}: {self.text[:20]!r}")

    def semicolon(self) -> None:
        if not self.eat(";") and not self.at("}") and self.kind != "end" and not self.newline:
            self.fail("';' expected")

    def node(self, kind: str, start: int, /, **fields) -> dict:
        return {"type": kind, "start": start, "end": self.end, **fields}

    # statements

    def program(self) -> dict:
        body = []
        while self.kind != "end":
            body.append(self.statement())
        directives = self.directives(body)
        return {"type": "Program", "start": 0, "end": len(self.code), "body": body, "directives": directives}

    @staticmethod
    def directives(body: list[dict]) -> list[dict]:
        """Moves leading string statements out of a body."""
        out = []
        while body and body[0]["type"] == "ExpressionStatement" and body[0]["expression"]["type"] == "StringLiteral" and not body[0]["expression"].get("extra"):
            text = body.pop(0)["expression"]["value"]
            out.append({"type": "Directive", "value": {"type": "DirectiveLiteral", "value": text}})
        return out

    def block(self, function: bool = False) -> dict:
        start, body = self.start, []
        self.need("{")
        while not self.at("}"):
            if self.kind == "end":
                self.fail("'}' expected")
            body.append(self.statement())
        self.next()
        directives = self.directives(body) if function else []
        return self.node("BlockStatement", start, body=body, directives=directives)

    def statement(self) -> dict:
        start, text = self.start, self.text
        if self.kind == "punctuator":
            if text == "{":
                return self.block()
            if text == ";":
                self.next()
                return self.node("EmptyStatement", start)
            if text == "@":
                return self.decorated(start)
        elif self.kind == "name":
            follow = self.peek()
            if text in ("var", "const") or text == "let" and (follow[0] == "name" and follow[1] not in ("in", "instanceof") or follow[1] in ("[", "{")):
                out = self.declarations()
                self.semicolon()
                out["end"] = self.end
                return out
            if text == "function" or text == "async" and follow[1] == "function" and not follow[4]:
                return self.function(declared=True)
            if text == "class":
                return self.class_(declared=True)
            if method := getattr(self, f"on_{text}", None):
                if not (text == "import" and follow[1] in ("(", ".")):
                    return method(start)
            if follow[1] == ":" and follow[0] == "punctuator" and text not in _WORDS:
                label = self.identifier()
                self.next()
                return self.node("LabeledStatement", start, body=self.statement(), label=label)
        expression = self.expression()
        self.semicolon()
        return self.node("ExpressionStatement", start, expression=expression)

    def declarations(self, no_in: bool = False) -> dict:
        start, kind, out = self.start, self.next(), []
        while True:
            at, target = self.start, self.binding()
            init = self.assignment(no_in) if self.eat("=") else None
            out.append(self.node("VariableDeclarator", at, id=target, init=init))
            if not self.eat(","):
                return self.node("VariableDeclaration", start, declarations=out, kind=kind)

    def condition(self) -> dict:
        self.need("(")
        test = self.expression()
        self.need(")")
        return test

    def on_if(self, start: int) -> dict:
        self.next()
        test, then = self.condition(), self.statement()
        other = self.statement() if self.eat("else") else None
        return self.node("IfStatement", start, test=test, consequent=then, alternate=other)

    def on_while(self, start: int) -> dict:
        self.next()
        test = self.condition()
        return self.node("WhileStatement", start, test=test, body=self.statement())

    def on_do(self, start: int) -> dict:
        self.next()
        body = self.statement()
        self.need("while")
        test = self.condition()
        self.eat(";")
        return self.node("DoWhileStatement", start, body=body, test=test)

    def on_for(self, start: int) -> dict:
        self.next()
        wait = self.eat("await")
        self.need("(")
        init = None
        if not self.at(";"):
            if self.at("var", "const") or self.at("let") and self.peek()[1] not in ("in", "of", ";", "=", "."):
                init = self.declarations(no_in=True)
            else:
                init = self.expression(no_in=True)
            if self.at("of", "in"):
                kind = "ForOfStatement" if self.next() == "of" else "ForInStatement"
                left = init if init["type"] == "VariableDeclaration" else self.target(init)
                right = self.assignment() if kind == "ForOfStatement" else self.expression()
                self.need(")")
                extra = {"await": wait} if kind == "ForOfStatement" else {}
                return self.node(kind, start, **extra, left=left, right=right, body=self.statement())
        self.need(";")
        test = None if self.at(";") else self.expression()
        self.need(";")
        update = None if self.at(")") else self.expression()
        self.need(")")
        return self.node("ForStatement", start, init=init, test=test, update=update, body=self.statement())

    def on_return(self, start: int) -> dict:
        kind = {"return": "ReturnStatement", "throw": "ThrowStatement"}[self.next()]
        argument = None if self.at(";", "}") or self.kind == "end" or self.newline else self.expression()
        self.semicolon()
        return self.node(kind, start, argument=argument)

    on_throw = on_return

    def on_break(self, start: int) -> dict:
        kind = {"break": "BreakStatement", "continue": "ContinueStatement"}[self.next()]
        label = self.identifier() if self.kind == "name" and not self.newline else None
        self.semicolon()
        return self.node(kind, start, label=label)

    on_continue = on_break

    def on_debugger(self, start: int) -> dict:
        self.next()
        self.semicolon()
        return self.node("DebuggerStatement", start)

    def on_with(self, start: int) -> dict:
        self.next()
        scope = self.condition()
        return self.node("WithStatement", start, object=scope, body=self.statement())

    def on_switch(self, start: int) -> dict:
        self.next()
        value, cases = self.condition(), []
        self.need("{")
        while not self.eat("}"):
            at = self.start
            test = self.expression() if self.eat("case") else self.need("default")
            self.need(":")
            body = []
            while not self.at("case", "default", "}"):
                body.append(self.statement())
            cases.append(self.node("SwitchCase", at, consequent=body, test=test))
        return self.node("SwitchStatement", start, discriminant=value, cases=cases)

    def on_try(self, start: int) -> dict:
        self.next()
        block, handler = self.block(), None
        at = self.start
        if self.eat("catch"):
            param = None
            if self.eat("("):
                param = self.binding()
                self.need(")")
            handler = self.node("CatchClause", at, param=param, body=self.block())
        final = self.block() if self.eat("finally") else None
        if not handler and not final:
            self.fail("'catch' or 'finally' expected")
        return self.node("TryStatement", start, block=block, handler=handler, finalizer=final)

    def source(self) -> dict:
        if self.kind != "string":
            self.fail("string expected")
        return self.primary()

    def attributes(self) -> list[dict]:
        """What follows a source after ``with`` (or, in older code, ``assert``)."""
        if not (self.at("with") or self.at("assert") and not self.newline) or self.peek()[1] != "{":
            return []
        self.next()
        return [p | {"type": "ImportAttribute"} for p in self.primary()["properties"]]

    def on_import(self, start: int) -> dict:
        self.next()
        names: list[dict] = []
        if self.kind != "string":
            while not self.at("from"):
                at = self.start
                if self.eat("*"):
                    self.need("as")
                    names.append(self.node("ImportNamespaceSpecifier", at, local=self.identifier()))
                elif self.eat("{"):
                    while not self.eat("}"):
                        at = self.start
                        imported = self.source() if self.kind == "string" else self.word()
                        local = self.identifier() if self.eat("as") else imported
                        names.append(self.node("ImportSpecifier", at, imported=imported, local=local))
                        if not self.at("}"):
                            self.need(",")
                else:
                    names.append(self.node("ImportDefaultSpecifier", at, local=self.identifier()))
                if not self.eat(","):
                    break
            self.need("from")
        source, attributes = self.source(), self.attributes()
        self.semicolon()
        return self.node("ImportDeclaration", start, specifiers=names, source=source, attributes=attributes)

    def on_export(self, start: int) -> dict:
        self.next()
        if self.eat("default"):
            if self.at("function") or self.at("async") and self.peek()[1] == "function":
                value = self.function(declared=True)
            elif self.at("class"):
                value = self.class_(declared=True)
            elif self.at("@"):
                marks = self.decorators()
                value = self.class_(declared=True) | {"decorators": marks}
            else:
                value = self.assignment()
                self.semicolon()
            return self.node("ExportDefaultDeclaration", start, declaration=value)
        if self.eat("*"):
            name = self.word() if self.eat("as") else None
            self.need("from")
            source, _ = self.source(), self.attributes()
            self.semicolon()
            if name:
                spec = self.node("ExportNamespaceSpecifier", name["start"], exported=name)
                return self.node("ExportNamedDeclaration", start, specifiers=[spec], source=source, declaration=None)
            return self.node("ExportAllDeclaration", start, source=source)
        if self.eat("{"):
            names = []
            while not self.eat("}"):
                at, local = self.start, self.word()
                names.append(self.node("ExportSpecifier", at, local=local, exported=self.word() if self.eat("as") else local))
                if not self.at("}"):
                    self.need(",")
            source = self.source() if self.eat("from") else None
            if source:
                self.attributes()
            self.semicolon()
            return self.node("ExportNamedDeclaration", start, specifiers=names, source=source, declaration=None)
        return self.node("ExportNamedDeclaration", start, specifiers=[], source=None, declaration=self.statement())

    # functions, classes, patterns

    def word(self) -> dict:
        """Any name, reserved or not."""
        if self.kind != "name":
            self.fail("name expected")
        start, name = self.start, self.next()
        return self.node("Identifier", start, name=_unescaped(name))

    def identifier(self) -> dict:
        if self.kind != "name" or self.text in _WORDS:
            self.fail("identifier expected")
        return self.word()

    def binding(self) -> dict:
        start = self.start
        if self.eat("["):
            items = []
            while not self.eat("]"):
                if self.at(","):
                    items.append(None)
                else:
                    items.append(self.rest() if self.at("...") else self.with_default())
                if not self.at("]"):
                    self.need(",")
            return self.node("ArrayPattern", start, elements=items)
        if self.eat("{"):
            items = []
            while not self.eat("}"):
                at = self.start
                if self.at("..."):
                    items.append(self.rest())
                else:
                    key, computed = self.key()
                    short = not self.eat(":")
                    value = self.defaulted(key, at) if short else self.with_default()
                    items.append(self.node("ObjectProperty", at, method=False, key=key, computed=computed, shorthand=short, value=value))
                if not self.at("}"):
                    self.need(",")
            return self.node("ObjectPattern", start, properties=items)
        return self.identifier()

    def rest(self) -> dict:
        start = self.start
        self.next()
        return self.node("RestElement", start, argument=self.binding())

    def defaulted(self, left: dict, start: int) -> dict:
        return self.node("AssignmentPattern", start, left=left, right=self.assignment()) if self.eat("=") else left

    def with_default(self) -> dict:
        start = self.start
        return self.defaulted(self.binding(), start)

    def params(self) -> list[dict]:
        self.need("(")
        out = []
        while not self.eat(")"):
            out.append(self.rest() if self.at("...") else self.with_default())
            if not self.at(")"):
                self.need(",")
        return out

    def function(self, declared: bool = False) -> dict:
        start = self.start
        is_async = self.eat("async")
        self.need("function")
        generator = self.eat("*")
        name = self.identifier() if self.kind == "name" else None
        params = self.params()
        return self.node("FunctionDeclaration" if declared else "FunctionExpression", start, id=name, generator=generator, **{"async": is_async}, params=params, body=self.block(function=True))

    def class_(self, declared: bool = False) -> dict:
        start = self.start
        self.need("class")
        name = self.identifier() if self.kind == "name" and not self.at("extends") else None
        parent = self.suffixes(self.primary(), self.start) if self.eat("extends") else None
        at, members = self.start, []
        self.need("{")
        while not self.eat("}"):
            if not self.eat(";"):
                members.append(self.member())
        body = self.node("ClassBody", at, body=members)
        return self.node("ClassDeclaration" if declared else "ClassExpression", start, id=name, superClass=parent, body=body)

    def decorators(self) -> list[dict]:
        out = []
        while self.at("@"):
            start = self.start
            self.next()
            at = self.start
            if self.at("("):
                expression = self.primary()
            else:
                expression = self.identifier()
                while self.eat("."):
                    expression = self.node("MemberExpression", at, object=expression, computed=False, property=self.word())
                if self.at("("):
                    expression = self.node("CallExpression", at, callee=expression, arguments=self.arguments())
            out.append(self.node("Decorator", start, expression=expression))
        return out

    def decorated(self, start: int) -> dict:
        """A class, or an exported one, behind its decorators."""
        marks = self.decorators()
        if not self.at("class", "export"):
            self.fail("class expected")
        out = self.statement()
        owner = out if out["type"] == "ClassDeclaration" else out.get("declaration") or {}
        if owner.get("type") != "ClassDeclaration":
            raise SyntaxError(f"class expected after the decorators at {start}")
        owner["decorators"] = marks + owner.get("decorators", [])
        return out | {"start": start}

    def modifiers(self, *names: str) -> dict[str, bool]:
        """Leading words that modify a member, unless the word is the member's own name."""
        out = {}
        for n in names:
            if self.at(n) and self.peek()[1] not in ("(", "=", ";", "}", ",", ":") and not (n in ("async", "get", "set") and self.peek()[4]):
                out[n] = self.eat(n)
        return out

    def member(self) -> dict:
        start, marks = self.start, self.decorators()
        out = self.bare_member(start)
        return {"type": out["type"], "start": start, "end": self.end, "decorators": marks} | out if marks else out

    def bare_member(self, start: int) -> dict:
        static = bool(self.modifiers("static"))
        if static and self.at("{"):
            return self.node("StaticBlock", start, body=self.block()["body"])
        mods = self.modifiers("async", "get", "set")
        generator = self.eat("*")
        private = self.eat("#")
        key, computed = self.key()
        if private:
            key = {"type": "PrivateName", "start": key["start"] - 1, "end": key["end"], "id": key}
        if self.at("("):
            kind = "get" if "get" in mods else "set" if "set" in mods else "constructor" if not static and key.get("name") == "constructor" else "method"
            return self.node("ClassPrivateMethod" if private else "ClassMethod", start, static=static, key=key, computed=computed, kind=kind, id=None, generator=generator, **{"async": "async" in mods}, params=self.params(), body=self.block(function=True))
        value = self.assignment() if self.eat("=") else None
        self.semicolon()
        return self.node("ClassPrivateProperty" if private else "ClassProperty", start, static=static, key=key, computed=computed, value=value)

    def key(self) -> tuple[dict, bool]:
        if self.eat("["):
            out = self.assignment()
            self.need("]")
            return out, True
        return (self.primary() if self.kind in ("string", "number") else self.word()), False

    def target(self, expr: dict) -> dict:
        """An expression read as an assignment's left side."""
        kind = expr["type"]
        if kind == "ArrayExpression":
            return expr | {"type": "ArrayPattern", "elements": [e and self.target(e) for e in expr["elements"]]}
        if kind == "ObjectExpression":
            return expr | {"type": "ObjectPattern", "properties": [self.target(p) for p in expr["properties"]]}
        if kind == "ObjectProperty":
            return expr | {"value": self.target(expr["value"])}
        if kind == "SpreadElement":
            return expr | {"type": "RestElement", "argument": self.target(expr["argument"])}
        if kind == "AssignmentExpression" and expr["operator"] == "=":
            return {"type": "AssignmentPattern", "start": expr["start"], "end": expr["end"], "left": expr["left"], "right": expr["right"]}
        if kind in ("Identifier", "MemberExpression", "ArrayPattern", "ObjectPattern", "AssignmentPattern"):
            return expr
        raise SyntaxError(f"invalid assignment target at {expr['start']}")

    # expressions

    def expression(self, no_in: bool = False) -> dict:
        start, first = self.start, self.assignment(no_in)
        if not self.at(","):
            return first
        items = [first]
        while self.eat(","):
            items.append(self.assignment(no_in))
        return self.node("SequenceExpression", start, expressions=items)

    def assignment(self, no_in: bool = False) -> dict:
        start = self.start
        if self.kind == "name":
            if self.at("yield"):
                self.next()
                if self.newline or self.at(")", "]", "}", ",", ";", ":") or self.kind == "end":
                    return self.node("YieldExpression", start, delegate=False, argument=None)
                delegate = self.eat("*")
                return self.node("YieldExpression", start, delegate=delegate, argument=self.assignment(no_in))
            follow = self.peek()
            if self.at("async") and not follow[4] and (follow[0] == "name" and follow[1] not in _WORDS and self.scan(follow[3])[1] == "=>" or follow[1] == "(" and self.is_arrow(follow[2])):
                self.next()
                return self.arrow(start, True, no_in)
            if follow[1] == "=>" and self.text not in _WORDS:
                return self.arrow(start, False, no_in)
        elif self.at("(") and self.is_arrow(self.start):
            return self.arrow(start, False, no_in)
        left = self.conditional(no_in)
        if self.kind == "punctuator" and self.text in _ASSIGN:
            operator = self.next()
            left = self.target(left) if operator == "=" else left
            if left["type"] not in ("Identifier", "MemberExpression", "ArrayPattern", "ObjectPattern"):
                raise SyntaxError(f"invalid assignment target at {start}")
            return self.node("AssignmentExpression", start, operator=operator, left=left, right=self.assignment(no_in))
        return left

    def is_arrow(self, at: int) -> bool:
        """Whether the parenthesis at ``at`` closes before an arrow; scans tokens only, each parenthesis once."""
        if at in self.arrows:
            return self.arrows[at]
        open_, pos, last = [], at, None
        while True:
            kind, text, start, stop, _ = self.scan(pos)
            if kind == "end":
                break
            operand = last is None or last[0] == "punctuator" and last[1] not in (")", "]", "}") or last[0] == "name" and last[1] in _BEFORE_REGEX
            if text == "<" and operand:
                kind, stop = "jsx", self.skip_jsx(start)
            elif text in ("/", "/=") and operand:
                if m := _REGEX.match(self.code, start):
                    kind, stop = "regex", m.end()
            elif kind == "template":
                stop = self.skip_template(start)
            elif kind == "punctuator" and text in "([{":
                open_.append((text, start))
            elif kind == "punctuator" and text in ")]}":
                if not open_:
                    break
                opener, where = open_.pop()
                if opener == "(":
                    follow = self.scan(stop)
                    self.arrows[where] = follow[1] == "=>" and not follow[4]
                if not open_:
                    break
            last, pos = (kind, text), stop
        return self.arrows.setdefault(at, False)

    def skip_template(self, at: int) -> int:
        depth, i, code = 0, at + 1, self.code
        while i < len(code):
            c = code[i]
            if c == "\\":
                i += 1
            elif c == "`" and not depth:
                return i + 1
            elif c == "`":
                i = self.skip_template(i) - 1
            elif c == "{" and (depth or code[i - 1] == "$"):
                depth += 1
            elif c == "}" and depth:
                depth -= 1
            i += 1
        raise SyntaxError(f"template not closed at {at}")

    def arrow(self, start: int, is_async: bool, no_in: bool) -> dict:
        params = self.params() if self.at("(") else [self.identifier()]
        self.need("=>")
        body = self.block(function=True) if self.at("{") else self.assignment(no_in)
        return self.node("ArrowFunctionExpression", start, id=None, generator=False, **{"async": is_async}, params=params, body=body)

    def conditional(self, no_in: bool) -> dict:
        start, test = self.start, self.binary(0, no_in)
        if not self.eat("?"):
            return test
        then = self.assignment()
        self.need(":")
        return self.node("ConditionalExpression", start, test=test, consequent=then, alternate=self.assignment(no_in))

    def binary(self, least: int, no_in: bool) -> dict:
        start, left = self.start, self.unary()
        while self.kind in ("punctuator", "name") and (power := _POWER.get(self.text, 0)) > least and not (no_in and self.text == "in"):
            operator = self.next()
            right = self.binary(power - (operator == "**"), no_in)
            left = self.node("LogicalExpression" if operator in ("&&", "||", "??") else "BinaryExpression", start, left=left, operator=operator, right=right)
        return left

    def unary(self) -> dict:
        start = self.start
        if self.at("++", "--"):
            operator = self.next()
            return self.node("UpdateExpression", start, operator=operator, prefix=True, argument=self.unary())
        if self.at("!", "~", "+", "-", "typeof", "void", "delete"):
            operator = self.next()
            return self.node("UnaryExpression", start, operator=operator, prefix=True, argument=self.unary())
        if self.at("await") and (self.peek()[0] in ("name", "string", "number", "template") or self.peek()[1] in ("(", "[", "{")) and not self.peek()[4]:
            self.next()
            return self.node("AwaitExpression", start, argument=self.unary())
        out = self.suffixes(self.primary(), start)
        if self.at("++", "--") and not self.newline:
            operator = self.next()
            return self.node("UpdateExpression", start, operator=operator, prefix=False, argument=out)
        return out

    def arguments(self) -> list[dict]:
        self.need("(")
        out = []
        while not self.eat(")"):
            out.append(self.spread() if self.at("...") else self.assignment())
            if not self.at(")"):
                self.need(",")
        return out

    def spread(self) -> dict:
        start = self.start
        self.next()
        return self.node("SpreadElement", start, argument=self.assignment())

    def suffixes(self, out: dict, start: int, calls: bool = True) -> dict:
        optional = False  # once ?. was met the rest of the chain is optional too
        while True:
            question = False
            if calls and self.at("?."):
                self.next()
                optional = question = True
            kinds = ("OptionalMemberExpression", "OptionalCallExpression") if optional else ("MemberExpression", "CallExpression")
            extra = {"optional": question} if optional else {}
            if calls and self.at("("):
                out = self.node(kinds[1], start, callee=out, arguments=self.arguments(), **extra)
            elif self.eat("["):
                prop = self.expression()
                self.need("]")
                out = self.node(kinds[0], start, object=out, computed=True, property=prop, **extra)
            elif question or self.eat("."):
                if self.eat("#"):
                    name = self.word()
                    prop = {"type": "PrivateName", "start": name["start"] - 1, "end": name["end"], "id": name}
                else:
                    prop = self.word()
                out = self.node(kinds[0], start, object=out, computed=False, property=prop, **extra)
            elif self.kind == "template":
                out = self.node("TaggedTemplateExpression", start, tag=out, quasi=self.template())
            else:
                return out

    def template(self) -> dict:
        start, i, code = self.start, self.start + 1, self.code
        quasis, holes = [], []
        while True:
            at = i
            while i < len(code) and code[i] != "`" and code[i : i + 2] != "${":
                i += 2 if code[i] == "\\" else 1
            if i >= len(code):
                raise SyntaxError(f"template not closed at {start}")
            raw, tail = code[at:i].replace("\r\n", "\n").replace("\r", "\n"), code[i] == "`"
            quasis.append({"type": "TemplateElement", "start": at, "end": i, "value": {"raw": raw, "cooked": _unescaped(raw)}, "tail": tail})
            if tail:
                break
            self.move(i + 2)
            holes.append(self.expression())
            if not self.at("}"):
                self.fail("'}' expected")
            i = self.stop
        self.end = i + 1
        self.move(i + 1)
        return self.node("TemplateLiteral", start, expressions=holes, quasis=quasis)

    def primary(self) -> dict:
        start, kind, text = self.start, self.kind, self.text
        if kind == "number":
            self.next()
            return self.node("BigIntLiteral", start, value=text[:-1]) if text.endswith("n") and text[:2].lower() != "0x" or text[-1] == "n" else self.node("NumericLiteral", start, value=_number(text))
        if kind == "string":
            self.next()
            return self.node("StringLiteral", start, value=_unescaped(text[1:-1]))
        if kind == "template":
            return self.template()
        if text in ("/", "/=") and kind == "punctuator":
            if not (m := _REGEX.match(self.code, start)):
                self.fail("unterminated regular expression")
            self.end = m.end()
            self.move(m.end())
            return self.node("RegExpLiteral", start, pattern=m[1], flags=m[2])
        if text == "(" and kind == "punctuator":
            self.next()
            out = self.expression()
            self.need(")")
            return out | {"extra": {"parenthesized": True}}
        if text == "[" and kind == "punctuator":
            self.next()
            items = []
            while not self.eat("]"):
                if self.at(","):
                    items.append(None)
                else:
                    items.append(self.spread() if self.at("...") else self.assignment())
                if not self.at("]"):
                    self.need(",")
            return self.node("ArrayExpression", start, elements=items)
        if text == "{" and kind == "punctuator":
            self.next()
            items = []
            while not self.eat("}"):
                items.append(self.spread() if self.at("...") else self.property())
                if not self.at("}"):
                    self.need(",")
            return self.node("ObjectExpression", start, properties=items)
        if kind == "punctuator" and text == "<":  # no operator can stand here
            return self.jsx(start)
        if kind == "punctuator" and text == "@":
            marks = self.decorators()
            return self.class_() | {"decorators": marks}
        if kind == "punctuator" and text == "#":  # #name in object
            self.next()
            return self.node("PrivateName", start, id=self.word())
        if kind != "name":
            self.fail()
        if text == "function" or text == "async" and self.peek()[1] == "function" and not self.peek()[4]:
            return self.function()
        if text == "class":
            return self.class_()
        if text == "new":
            return self.new()
        if text in ("this", "super", "null", "true", "false", "import"):
            self.next()
            if text == "import" and self.eat("."):
                return self.node("MetaProperty", start, meta={"type": "Identifier", "name": "import"}, property=self.word())
            if text in ("true", "false"):
                return self.node("BooleanLiteral", start, value=text == "true")
            return self.node({"this": "ThisExpression", "super": "Super", "null": "NullLiteral", "import": "Import"}[text], start)
        return self.identifier()

    # JSX; here the scanner's tokens don't hold for names, texts and attribute strings

    def jsx(self, start: int) -> dict:
        out = self.jsx_element(start)
        self.move(self.end)
        return out

    def skip_jsx(self, start: int) -> int:
        """The end of the element at ``start``, or of the mark alone where none begins there; the parser stays where it is."""
        if start not in self.elements:
            was = self.kind, self.text, self.start, self.stop, self.newline, self.end
            try:
                self.elements[start] = self.jsx_element(start)["end"]
            except SyntaxError:
                self.elements[start] = start + 1
            self.kind, self.text, self.start, self.stop, self.newline, self.end = was
        return self.elements[start]

    def jsx_element(self, start: int) -> dict:
        """The element or fragment whose ``<`` is at ``start``; the token behind it is not read yet."""
        at = self.jsx_space(start + 1)
        name = None if self.code[at : at + 1] == ">" else self.jsx_name(at)
        marks: list[dict] = []
        at = self.jsx_space(self.end) if name else at
        while name and self.code[at : at + 1] not in ("/", ">"):
            marks.append(self.jsx_attribute(at))
            at = self.jsx_space(self.end)
        if closed := self.code[at : at + 1] == "/":
            at = self.jsx_space(at + 1)
        at = self.jsx_need(">", at)
        part = "Element" if name else "Fragment"
        fields = {"name": name, "attributes": marks, "selfClosing": closed} if name else {}
        opening = {"type": f"JSXOpening{part}", "start": start, "end": at, **fields}
        children, closing = ([], None) if closed else self.jsx_children(at, name)
        kind = {"openingElement": opening, "closingElement": closing} if name else {"openingFragment": opening, "closingFragment": closing}
        return self.node(f"JSX{part}", start, **kind, children=children)

    def jsx_children(self, at: int, name: dict | None) -> tuple[list[dict], dict]:
        """What stands between the tags, and the closing tag."""
        code, out = self.code, []
        while at < len(code):
            if m := _JSX_TEXT.match(code, at):
                self.end = m.end()
                out.append(self.node("JSXText", at, value=html.unescape(m[0])))
            elif code[at] == "{":
                out.append(self.jsx_hole(at, "JSXSpreadChild"))
            elif code[(inner := self.jsx_space(at + 1)) : inner + 1] == "/":
                inner = self.jsx_space(inner + 1)
                own = None if code[inner : inner + 1] == ">" else self.jsx_name(inner)
                self.jsx_need(">", self.jsx_space(self.end) if own else inner)
                if _jsx_spelt(own) != _jsx_spelt(name):
                    raise SyntaxError(f"closing tag of {_jsx_spelt(name)!r} expected at {at}")
                return out, self.node("JSXClosingElement" if own else "JSXClosingFragment", at, **({"name": own} if own else {}))
            else:
                out.append(self.jsx_element(at))
            at = self.end
        raise SyntaxError(f"tag {_jsx_spelt(name)!r} not closed")

    def jsx_space(self, at: int) -> int:
        m = _SPACE.match(self.code, at)
        return m.end() if m else at

    def jsx_need(self, text: str, at: int) -> int:
        if not self.code.startswith(text, at):
            raise SyntaxError(f"{text!r} expected at {at}")
        self.end = at + len(text)
        return self.end

    def jsx_word(self, at: int) -> dict:
        if not (m := _JSX_NAME.match(self.code, at)):
            raise SyntaxError(f"name expected at {at}")
        self.end = m.end()
        return self.node("JSXIdentifier", at, name=m[0])

    def jsx_name(self, at: int, members: bool = True) -> dict:
        """a, a:b or, for tags, a.b.c."""
        out, follow = self.jsx_word(at), self.code[self.end : self.end + 1]
        if follow == ":":
            return self.node("JSXNamespacedName", at, namespace=out, name=self.jsx_word(self.end + 1))
        while members and self.code[self.end : self.end + 1] == ".":
            prop = self.jsx_word(self.end + 1)
            out = self.node("JSXMemberExpression", at, object=out, property=prop)
        return out

    def jsx_hole(self, start: int, spread: str) -> dict:
        """Braces in JSX: an expression, three dots and one, or nothing."""
        self.end = start + 1
        self.move(start + 1)
        if self.at("}"):
            inner = {"type": "JSXEmptyExpression", "start": start + 1, "end": self.start}
            kind, fields = "JSXExpressionContainer", {"expression": inner}
        elif self.eat("..."):
            kind, fields = spread, {"argument" if spread == "JSXSpreadAttribute" else "expression": self.assignment()}
        else:
            kind, fields = "JSXExpressionContainer", {"expression": self.expression()}
        if not self.at("}"):
            self.fail("'}' expected")
        self.end = self.stop
        return self.node(kind, start, **fields)

    def jsx_attribute(self, start: int) -> dict:
        if self.code[start : start + 1] == "{":
            return self.jsx_hole(start, "JSXSpreadAttribute")
        name, value = self.jsx_name(start, members=False), None
        if self.code[(at := self.jsx_space(self.end)) : at + 1] == "=":
            at = self.jsx_space(at + 1)
            c = self.code[at : at + 1]
            if c in ("'", '"') and (close := self.code.find(c, at + 1)) > 0:
                self.end = close + 1
                value = self.node("StringLiteral", at, value=html.unescape(self.code[at + 1 : close]))
            elif c == "{":
                value = self.jsx_hole(at, "JSXSpreadChild")
            elif c == "<":
                value = self.jsx_element(at)
            else:
                raise SyntaxError(f"attribute value expected at {at}")
        return self.node("JSXAttribute", start, name=name, value=value)

    def new(self) -> dict:
        start = self.start
        self.next()
        if self.eat("."):
            return self.node("MetaProperty", start, meta={"type": "Identifier", "name": "new"}, property=self.word())
        at = self.start
        callee = self.suffixes(self.new() if self.at("new") else self.primary(), at, calls=False)
        return self.node("NewExpression", start, callee=callee, arguments=self.arguments() if self.at("(") else [])

    def property(self) -> dict:
        start, mods = self.start, self.modifiers("async", "get", "set")
        generator = self.eat("*")
        key, computed = self.key()
        if self.at("("):
            kind = next((k for k in ("get", "set") if k in mods), "method")
            return self.node("ObjectMethod", start, method=kind == "method", key=key, computed=computed, kind=kind, id=None, generator=generator, **{"async": "async" in mods}, params=self.params(), body=self.block(function=True))
        if self.eat(":"):
            return self.node("ObjectProperty", start, method=False, key=key, computed=computed, shorthand=False, value=self.assignment())
        if key["type"] != "Identifier" or key["name"] in _WORDS:
            self.fail()
        return self.node("ObjectProperty", start, method=False, key=key, computed=False, shorthand=True, value=self.defaulted(key, start))


def _jsx_spelt(name: dict | None) -> str:
    """A tag's name as written, nothing for a fragment."""
    if name is None:
        return ""
    if name["type"] == "JSXIdentifier":
        return name["name"]
    a, b, mark = (name["namespace"], name["name"], ":") if name["type"] == "JSXNamespacedName" else (name["object"], name["property"], ".")
    return _jsx_spelt(a) + mark + _jsx_spelt(b)


def parse(code: str) -> dict:
    """{program: ...} of a script or module; what may be an HTML comment is none in a file that imports or exports."""
    try:
        if "<!--" in code or "-->" in code:
            try:
                program = Parser(code, module=True).program()
                if any(s["type"].startswith(("Import", "Export")) for s in program["body"]):
                    return {"type": "File", "program": program}
            except SyntaxError:
                pass
        return {"type": "File", "program": Parser(code).program()}
    except RecursionError:
        raise SyntaxError("nested too deeply") from None


def _clean(text: str) -> str:
    """Lone surrogates as question marks, so that the text can be stored."""
    return text.encode("utf-8", "replace").decode("utf-8")


def within(seconds: float, work: Callable[[str], dict], code: str) -> dict:
    """``work(code)``, or a TimeoutError after so many seconds; without a limit off the main thread, where no signal arrives."""
    import signal
    import threading

    if threading.current_thread() is not threading.main_thread():
        return work(code)

    def late(*_):
        raise TimeoutError(f"parsing took more than {seconds:g} s")

    was = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return work(code)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, was)


def parse_files(files: DataFrame, parser: Callable[[str], dict] = parse, name: str = "builtin", seconds: float = MOST_SECONDS) -> DataFrame:
    """Trees of source files (SOURCE_FILES): one envelope a file, success or error; too large files are not read, slow ones given up."""
    import pandas as pd

    def run(batches):
        import sys

        sys.setrecursionlimit(10_000)
        for pdf in batches:
            trees, errors = [], []
            for size, code in zip(pdf["size"], pdf.code):
                tree = error = None
                if size is not None and size > MOST_BYTES:
                    error = TOO_LARGE
                else:
                    try:
                        tree = _clean(json.dumps(within(seconds, parser, code or "")))
                    except (SyntaxError, ValueError, TimeoutError) as x:
                        error = _clean(str(x)) or type(x).__name__
                trees.append(tree)
                errors.append(error)
            yield pd.DataFrame({"package_id": pdf.package_id, "data_type": pdf.data_type, "rel_path": pdf.rel_path, "success": [t is not None for t in trees], "parser": name, "ast": trees, "error": errors})

    return files.select("package_id", "data_type", "rel_path", "size", "code").mapInPandas(run, schemas.ASTS)


def valid_asts(asts: DataFrame) -> DataFrame:
    """Envelopes whose result can be kept: those of a run before that need not be made again."""
    return asts.where("success is not null and parser is not null")
