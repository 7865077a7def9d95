"""A TypeScript and JSX parser in plain Python: text to a tree of nodes.

A scanner driven by the parser resolves regular expressions, templates and JSX;
arrows and type arguments are parsed speculatively, each position once.  Types are
parsed as far as the analysis looks into them.  Anything unreadable raises
SyntaxError, and the file then contributes no rows.
"""

from __future__ import annotations

import re

_WS = re.compile(r"(?:[ \t\r\n\f\v\u00a0\ufeff\u2028\u2029]|//[^\n]*|/\*(?s:.*?)\*/)*")
_IDENT = re.compile(r"#?(?:[A-Za-z_$\u0080-\U0010ffff]|\\u[0-9a-fA-F]{4})(?:[\w$\u0080-\U0010ffff]|\\u[0-9a-fA-F]{4})*")
_NUM = re.compile(r"0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_STR = re.compile(r"'(?:[^'\\\n]|\\(?s:.))*'|\"(?:[^\"\\\n]|\\(?s:.))*\"")
_PUNCT = re.compile(r"\.\.\.|=>|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|==|!=|\*\*|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<=|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-zA-Z]*")
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "as": 8, "satisfies": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_MODS = frozenset("public private protected static readonly abstract override declare async accessor export const in out".split())
_KEYWORD_TYPES = frozenset("any unknown never void null undefined string number boolean symbol bigint object this".split())
_RESERVED = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())


class Node:
    """kind, span and fields; children are the fields that are nodes or lists of nodes, in order."""

    __slots__ = ("kind", "start", "end", "f")

    def __init__(self, kind: str, start: int, end: int, **f):
        self.kind, self.start, self.end, self.f = kind, start, end, f

    def __getattr__(self, name):
        try:
            return self.f[name]
        except KeyError:
            return None

    def children(self):
        for v in self.f.values():
            if isinstance(v, Node):
                yield v
            elif isinstance(v, list):
                for x in v:
                    if isinstance(x, Node):
                        yield x


class Token:
    __slots__ = ("type", "value", "start", "end", "nl")

    def __init__(self, type_, value, start, end, nl):
        self.type, self.value, self.start, self.end, self.nl = type_, value, start, end, nl


class Parser:
    def __init__(self, text: str, jsx: bool = False):
        self.s, self.jsx, self.n = text, jsx, len(text)
        self.last = 0
        self.comments: list[tuple[int, int]] = []
        self.cache: dict[int, Token] = {}
        self.failed: set[tuple[str, int]] = set()
        self.no_in = False
        self.no_cond_arrow = 0
        start = text.find("\n") if text.startswith("#!") else 0
        self.t = self.scan(max(start, 0))

    # scanning

    def scan(self, pos: int) -> Token:
        if pos in self.cache:
            return self.cache[pos]
        m = _WS.match(self.s, pos)
        at = m.end()
        gap = self.s[pos:at]
        nl = "\n" in gap
        if at >= self.n:
            t = Token("eof", "", self.n, self.n, True)
        else:
            c = self.s[at]
            if c == "/" and self.s.startswith("/*", at):
                raise SyntaxError("open comment")
            if m := _IDENT.match(self.s, at):
                t = Token("id", m[0], at, m.end(), nl)
            elif (c.isdigit() or c == ".") and (m := _NUM.match(self.s, at)):
                t = Token("num", m[0], at, m.end(), nl)
            elif c in "'\"":
                m = _STR.match(self.s, at)
                if not m:
                    raise SyntaxError(f"open string at {at}")
                t = Token("str", m[0], at, m.end(), nl)
            elif c == "`":
                t = Token("`", "`", at, at + 1, nl)
            elif m := _PUNCT.match(self.s, at):
                t = Token("p", m[0], at, m.end(), nl)
            else:
                raise SyntaxError(f"unknown sign at {at}")
        self.cache[pos] = t
        return t

    def next(self) -> Token:
        t = self.t
        self.last = t.end
        self.t = self.scan(t.end)
        return t

    def peek(self) -> Token:
        return self.scan(self.t.end)

    def jump(self, pos: int) -> None:
        self.t = self.scan(pos)

    def mark(self):
        return self.t, self.last

    def reset(self, m) -> None:
        self.t, self.last = m

    def at(self, *values: str) -> bool:
        return self.t.type in ("p", "id") and self.t.value in values

    def eat(self, value: str) -> bool:
        if self.t.type in ("p", "id") and self.t.value == value:
            self.next()
            return True
        return False

    def need(self, value: str) -> Token:
        if not self.at(value):
            raise SyntaxError(f"{value} expected at {self.t.start}, found {self.t.value!r}")
        return self.next()

    def semi(self) -> None:
        if self.eat(";") or self.at("}") or self.t.type == "eof" or self.t.nl:
            return
        raise SyntaxError(f"; expected at {self.t.start}")

    def attempt(self, what: str, f):
        """f() or None; a position where it failed isn't tried again."""
        key = (what, self.t.start)
        if key in self.failed:
            return None
        m, no_in = self.mark(), self.no_in
        try:
            return f()
        except SyntaxError:
            self.failed.add(key)
            self.reset(m)
            self.no_in = no_in
            return None

    def ident(self) -> Node:
        t = self.next()
        if t.type != "id":
            raise SyntaxError(f"name expected at {t.start}")
        return Node("Identifier", t.start, t.end, name=t.value)

    # statements

    def program(self) -> Node:
        body = []
        while self.t.type != "eof":
            body.append(self.statement())
        return Node("Program", 0, self.n, body=body)

    def block(self) -> Node:
        start = self.need("{").start
        body = []
        while not self.at("}"):
            body.append(self.statement())
        return Node("Block", start, self.next().end, body=body)

    def statement(self) -> Node:
        t = self.t
        if t.type == "p":
            if t.value == "{":
                return self.block()
            if t.value == ";":
                self.next()
                return Node("Empty", t.start, t.end)
            if t.value == "@":
                decorators = self.decorators()
                s = self.statement()
                s.f["decorators"] = decorators
                return s
        if t.type == "id":
            f = getattr(self, "s_" + t.value, None)
            if f is not None and (s := f()) is not None:
                return s
            nx = self.peek()
            if nx.type == "p" and nx.value == ":" and t.value not in _RESERVED:
                label = self.ident()
                self.next()
                body = self.statement()
                return Node("Labeled", t.start, self.last, label=label, body=body)
        e = self.expression()
        self.semi()
        return Node("ExpressionStatement", t.start, self.last, expression=e)

    def decorators(self) -> list[Node]:
        out = []
        while self.at("@"):
            self.next()
            out.append(self.suffixes(self.primary(), self.t.start))
        return out

    def var(self, kind: str) -> Node:
        start = self.next().start
        if kind == "await using":
            self.next()
        out = []
        while True:
            at = self.t.start
            target = self.binding()
            self.eat("!")
            kind_ = self.type_annotation()
            init = self.assignment() if self.eat("=") else None
            out.append(Node("Declarator", at, self.last, id=target, type=kind_, init=init))
            if not self.eat(","):
                break
        return Node("VariableDeclaration", start, self.last, var=kind, declarations=out)

    def _declaration(self, kind):
        d = self.var(kind)
        self.semi()
        d.end = self.last
        return d

    def s_var(self):
        return self._declaration("var")

    def s_const(self):
        if self.peek().value == "enum":
            self.next()
            return self.s_enum()
        return self._declaration("const")

    def s_let(self):
        nx = self.peek()
        return self._declaration("let") if nx.type == "id" or nx.value in ("{", "[") else None

    def s_using(self):
        nx = self.peek()
        return self._declaration("using") if nx.type == "id" and not nx.nl and nx.value not in ("in", "of", "instanceof", "as") else None

    def s_function(self):
        return self.function(True)

    def s_async(self):
        nx = self.peek()
        return self.function(True) if nx.value == "function" and not nx.nl else None

    def s_class(self):
        return self.klass(True)

    def s_abstract(self):
        if self.peek().value == "class":
            self.next()
            return self.klass(True)

    def s_if(self):
        start = self.next().start
        self.need("(")
        test = self.expression()
        self.need(")")
        then = self.statement()
        other = self.statement() if self.eat("else") else None
        return Node("If", start, self.last, test=test, consequent=then, alternate=other)

    def s_for(self):
        start = self.next().start
        wait = self.eat("await")
        self.need("(")
        init = None
        self.no_in = True
        if not self.at(";"):
            if self.at("var", "const") or (self.at("let") and (self.peek().type == "id" or self.peek().value in ("[", "{"))):
                init = self.var(self.t.value)
            else:
                init = self.expression()
        self.no_in = False
        if self.at("of", "in"):
            kind = "ForOf" if self.next().value == "of" else "ForIn"
            right = self.expression()
            self.need(")")
            body = self.statement()
            return Node(kind, start, self.last, left=init, right=right, body=body, wait=wait)
        self.need(";")
        test = None if self.at(";") else self.expression()
        self.need(";")
        update = None if self.at(")") else self.expression()
        self.need(")")
        body = self.statement()
        return Node("For", start, self.last, init=init, test=test, update=update, body=body)

    def s_while(self):
        start = self.next().start
        self.need("(")
        test = self.expression()
        self.need(")")
        body = self.statement()
        return Node("While", start, self.last, test=test, body=body)

    def s_do(self):
        start = self.next().start
        body = self.statement()
        self.need("while")
        self.need("(")
        test = self.expression()
        self.need(")")
        self.eat(";")
        return Node("DoWhile", start, self.last, body=body, test=test)

    def s_switch(self):
        start = self.next().start
        self.need("(")
        value = self.expression()
        self.need(")")
        self.need("{")
        cases = []
        while not self.at("}"):
            at = self.t.start
            test = None
            if not self.eat("default"):
                self.need("case")
                test = self.expression()
            self.need(":")
            body = []
            while not self.at("case", "default", "}"):
                body.append(self.statement())
            cases.append(Node("Case", at, self.last, test=test, body=body))
        self.next()
        return Node("Switch", start, self.last, discriminant=value, cases=cases)

    def s_try(self):
        start = self.next().start
        body = self.block()
        handler = final = None
        if self.at("catch"):
            at = self.next().start
            param = None
            if self.eat("("):
                param = self.binding()
                self.type_annotation()
                self.need(")")
            b = self.block()
            handler = Node("Catch", at, self.last, param=param, body=b)
        if self.eat("finally"):
            final = self.block()
        return Node("Try", start, self.last, block=body, handler=handler, finalizer=final)

    def s_throw(self):
        start = self.next().start
        e = self.expression()
        self.semi()
        return Node("Throw", start, self.last, argument=e)

    def s_return(self):
        start = self.next().start
        e = None if self.at(";", "}") or self.t.nl or self.t.type == "eof" else self.expression()
        self.semi()
        return Node("Return", start, self.last, argument=e)

    def _jump(self, kind):
        start = self.next().start
        if self.t.type == "id" and not self.t.nl:
            self.next()
        self.semi()
        return Node(kind, start, self.last)

    def s_break(self):
        return self._jump("Break")

    def s_continue(self):
        return self._jump("Continue")

    def s_debugger(self):
        start = self.next().start
        self.semi()
        return Node("Debugger", start, self.last)

    def s_import(self):
        if self.peek().value in ("(", "."):
            return None
        start = self.next().start
        specs = []
        if self.t.type == "str":
            source = self.next()
        else:
            if self.at("type") and self.peek().value not in ("from", ",", "="):
                self.next()
            if self.t.type == "id" and not self.at("from") or self.at("from") and self.peek().value == "from":
                name = self.ident()
                if self.eat("="):
                    e = self.expression()
                    self.semi()
                    return Node("ImportEquals", start, self.last, id=name, value=e)
                specs.append(("default", "default", name.name))
                self.eat(",")
            if self.eat("*"):
                self.need("as")
                specs.append(("namespace", "*", self.ident().name))
            elif self.eat("{"):
                while not self.eat("}"):
                    if self.at("type") and self.peek().value not in (",", "}", "as"):
                        self.next()
                    name = self.next()
                    imported = self.string(name.value) if name.type == "str" else name.value
                    local = self.ident().name if self.eat("as") else imported
                    specs.append(("named", imported, local))
                    if not self.at("}"):
                        self.need(",")
            self.need("from")
            source = self.next()
        if source.type != "str":
            raise SyntaxError(f"source expected at {source.start}")
        if self.at("with", "assert") and not self.t.nl:
            self.next()
            self.object()
        self.semi()
        return Node("Import", start, self.last, source=self.string(source.value), specifiers=specs)

    def s_export(self):
        start = self.next().start
        if self.eat("default"):
            if self.at("class", "abstract", "@"):
                self.eat("abstract")
                d = self.statement() if self.at("@") else self.klass(True)
            elif self.at("function") or self.at("async") and self.peek().value == "function":
                d = self.function(True)
            elif self.at("interface") and self.peek().type == "id":
                d = self.s_interface()
            else:
                d = self.assignment()
                self.semi()
            return Node("ExportDefault", start, self.last, declaration=d)
        if self.eat("*"):
            if self.eat("as"):
                self.next()
            self.need("from")
            self.next()
            self.semi()
            return Node("ExportAll", start, self.last)
        if self.eat("="):
            e = self.expression()
            self.semi()
            return Node("ExportEquals", start, self.last, value=e)
        if self.at("as") and self.peek().value == "namespace":
            self.next(), self.next(), self.next()
            self.semi()
            return Node("ExportAll", start, self.last)
        if self.at("{") or self.at("type") and self.peek().value in ("{", "*"):
            self.eat("type")
            if self.eat("*"):
                if self.eat("as"):
                    self.next()
            else:
                self.next()
                while not self.eat("}"):
                    self.next()
            if self.eat("from"):
                self.next()
            self.semi()
            return Node("ExportNamed", start, self.last)
        return Node("ExportNamed", start, self.last, declaration=self.statement())

    def s_interface(self):
        if self.peek().type != "id":
            return None
        start = self.next().start
        name = self.ident()
        params = self.type_params()
        bases = []
        if self.eat("extends"):
            bases = self.heritage()
        body = self.type_object()
        return Node("Interface", start, self.last, id=name, params=params, extends=bases, body=body)

    def s_type(self):
        nx = self.peek()
        if nx.type != "id" or nx.nl:
            return None
        start = self.next().start
        name = self.ident()
        params = self.type_params()
        self.need("=")
        value = self.type()
        self.semi()
        return Node("TypeAlias", start, self.last, id=name, params=params, value=value)

    def s_enum(self):
        if self.peek().type != "id":
            return None
        start = self.next().start
        name = self.ident()
        self.need("{")
        members = []
        while not self.eat("}"):
            self.property_key()
            if self.eat("="):
                members.append(self.assignment())
            if not self.at("}"):
                self.need(",")
        return Node("Enum", start, self.last, id=name, members=members)

    def s_declare(self):
        nx = self.peek()
        if nx.type != "id" or nx.nl:
            return None
        start = self.next().start
        if self.at("global"):
            self.next()
            return Node("Namespace", start, self.last, body=self.block())
        return Node("Declare", start, self.last, declaration=self.statement())

    def s_namespace(self):
        nx = self.peek()
        if nx.type not in ("id", "str") or nx.nl:
            return None
        start = self.next().start
        self.next()
        while self.eat("."):
            self.next()
        body = self.block() if self.at("{") else None
        if body is None:
            self.semi()
        return Node("Namespace", start, self.last, body=body)

    s_module = s_namespace

    # functions and classes

    def function(self, statement: bool = False) -> Node:
        start = self.t.start
        is_async = self.eat("async")
        self.need("function")
        generator = self.eat("*")
        name = self.ident() if self.t.type == "id" and not self.at("(") else None
        return self.function_rest(start, "Function", is_async=is_async, generator=generator, id=name, statement=statement)

    def function_rest(self, start: int, kind: str, **f) -> Node:
        types = self.type_params()
        params_start = self.t.start
        params = self.params()
        returns = self.return_type()
        body = self.block() if self.at("{") else None
        if body is None:
            self.semi()
        return Node(kind, start, self.last, **f, params_start=params_start, types=types, params=params, returns=returns, body=body)

    def params(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.eat(")"):
            start = self.t.start
            decorators = self.decorators()
            while self.t.type == "id" and self.t.value in ("public", "private", "protected", "readonly", "override") and self.peek().type in ("id",) or self.t.value in ("public", "private", "protected", "readonly", "override") and self.peek().value in ("{", "["):
                self.next()
            rest = self.eat("...")
            target = self.binding()
            self.eat("?")
            kind = self.type_annotation()
            default = self.assignment() if self.eat("=") else None
            name = target.name if target.kind == "Identifier" else None
            out.append(Node("Param", start, self.last, decorators=decorators, target=target, type=kind, default=default, rest=rest, this=name == "this"))
            if not self.at(")"):
                self.need(",")
        return [p for p in out if not p.this]

    def binding(self) -> Node:
        if self.at("{", "["):
            start = self.t.start
            close = "}" if self.next().value == "{" else "]"
            parts = []
            while not self.eat(close):
                if self.at(","):
                    self.next()
                    continue
                if self.eat("..."):
                    parts.append(self.binding())
                elif close == "}":
                    key = self.property_key()
                    if key.kind == "Computed":
                        parts.append(key)
                    if self.eat(":"):
                        parts.append(self.binding())
                else:
                    parts.append(self.binding())
                if self.eat("="):
                    parts.append(self.assignment())
                if not self.at(close):
                    self.need(",")
            return Node("Pattern", start, self.last, parts=parts)
        return self.ident()

    def property_key(self) -> Node:
        t = self.t
        if t.type == "id":
            self.next()
            return Node("Key", t.start, t.end, name=t.value)
        if t.type == "str":
            self.next()
            return Node("Key", t.start, t.end, name=self.string(t.value))
        if t.type == "num":
            self.next()
            return Node("Key", t.start, t.end, name=t.value)
        self.need("[")
        e = self.assignment()
        self.need("]")
        return Node("Computed", t.start, self.last, value=e)

    def klass(self, statement: bool = False) -> Node:
        start = self.need("class").start
        name = self.ident() if self.t.type == "id" and not self.at("extends", "implements") else None
        types = self.type_params()
        base, base_types, implements = None, [], []
        if self.eat("extends"):
            base = self.suffixes(self.primary(), self.t.start, no_object=True)
            if self.at("<"):
                base_types = self.type_args()
        if self.eat("implements"):
            implements = self.heritage()
        self.need("{")
        members = []
        while not self.eat("}"):
            if self.eat(";"):
                continue
            members.append(self.member())
        return Node("Class", start, self.last, id=name, types=types, base=base, base_types=base_types, implements=implements, members=members, statement=statement)

    def heritage(self) -> list[Node]:
        out = [self.type_primary()]
        while self.eat(","):
            out.append(self.type_primary())
        return out

    def member(self) -> Node:
        start = self.t.start
        decorators = self.decorators()
        mods = set()
        while self.t.type == "id" and self.t.value in _MODS:
            nx = self.peek()
            if nx.value in ("(", "=", ";", ":", "?", "!", "}", "<", ","):
                break
            if self.at("static") and nx.value == "{":
                self.next()
                return Node("StaticBlock", start, self.last, body=self.block())
            mods.add(self.next().value)
        generator = self.eat("*")
        accessor = None
        if self.at("get", "set") and self.peek().value not in ("(", "=", ";", ":", "?", "!", "}", "<", ","):
            accessor = self.next().value
        if self.at("[") and (sig := self.attempt("index", self.index_signature)) is not None:
            self.eat(";")
            return sig
        key = self.property_key()
        name = key.name
        self.eat("?") or self.eat("!")
        if self.at("(", "<"):
            f = self.function_rest(self.t.start, "Function", is_async="async" in mods, generator=generator, method=True)
            return Node("Method", start, self.last, decorators=decorators, key=key, name=name, static="static" in mods, accessor=accessor, value=f)
        kind = self.type_annotation()
        value = self.assignment() if self.eat("=") else None
        self.semi()
        return Node("Property", start, self.last, decorators=decorators, key=key, name=name, static="static" in mods, type=kind, value=value)

    def index_signature(self) -> Node:
        start = self.need("[").start
        self.ident()
        self.need(":")
        k = self.type()
        self.need("]")
        v = self.type_annotation()
        return Node("IndexSignature", start, self.last, key=k, type=v)

    # expressions

    def expression(self) -> Node:
        start = self.t.start
        e = self.assignment()
        if self.at(","):
            parts = [e]
            while self.eat(","):
                parts.append(self.assignment())
            return Node("Sequence", start, self.last, parts=parts)
        return e

    def assignment(self) -> Node:
        t = self.t
        start = t.start
        if t.type == "id":
            if t.value == "yield":
                self.next()
                delegate = False
                arg = None
                if not self.t.nl and not self.at(")", "]", "}", ",", ";", ":") and self.t.type != "eof":
                    delegate = self.eat("*")
                    arg = self.assignment()
                return Node("Yield", start, self.last, delegate=delegate, argument=arg)
            nx = self.peek()
            if t.value == "async" and not nx.nl:
                if nx.type == "id" and nx.value != "function" and self.scan(nx.end).value == "=>":
                    self.next()
                    return self.arrow_from_name(start, True)
                if nx.value in ("(", "<") and (a := self.attempt("async arrow", lambda: self.arrow(start, True))) is not None:
                    return a
            if nx.value == "=>" and nx.type == "p" and t.value not in _RESERVED:
                return self.arrow_from_name(start, False)
        elif t.type == "p" and (t.value == "(" and self.arrow_ahead() or t.value == "<"):
            if (a := self.attempt("arrow", lambda: self.arrow(start, False))) is not None:
                return a
        left = self.conditional()
        op = self.operator()
        if op in _ASSIGN:
            self.take(op)
            right = self.assignment()
            return Node("Assignment", start, self.last, operator=op, left=left, right=right)
        return left

    def arrow_ahead(self) -> bool:
        """Whether the matching parenthesis is followed by what an arrow function has there."""
        depth, pos = 0, self.t.start
        try:
            while True:
                t = self.scan(pos)
                if t.type == "eof":
                    return False
                if t.type == "`":
                    return True  # too deep to tell: try
                if t.type == "p":
                    if t.value in "([{":
                        depth += 1
                    elif t.value in ")]}":
                        depth -= 1
                        if not depth:
                            return self.scan(t.end).value in ("=>", ":")
                pos = t.end
        except SyntaxError:
            return True

    def arrow_from_name(self, start: int, is_async: bool) -> Node:
        at = self.t.start
        p = self.ident()
        param = Node("Param", at, self.last, target=p)
        self.need("=>")
        return self.arrow_body(start, is_async, [param], at)

    def arrow(self, start: int, is_async: bool) -> Node:
        if is_async:
            self.next()
        types = self.type_params()
        params_start = self.t.start
        params = self.params()
        returns = self.return_type()
        if self.t.nl:
            raise SyntaxError("arrow on a new line")
        self.need("=>")
        return self.arrow_body(start, is_async, params, params_start, types=types, returns=returns)

    def arrow_body(self, start, is_async, params, params_start, **f) -> Node:
        no_in, self.no_in = self.no_in, False
        concise = not self.at("{")
        if concise:
            self.no_in = no_in
        body = self.assignment() if concise else self.block()
        self.no_in = no_in
        return Node("Arrow", start, self.last, is_async=is_async, concise=concise, params_start=params_start, params=params, **f, body=body)

    def operator(self) -> str:
        """The operator at hand; those that begin with > are put together here."""
        t = self.t
        if t.type == "p" and t.value == ">":
            for op in (">>>=", ">>=", ">>>", ">=", ">>"):
                if self.s.startswith(op, t.start):
                    return op
        return t.value if t.type in ("p", "id") else ""

    def take(self, op: str) -> None:
        self.last = self.t.start + len(op)
        self.jump(self.last)

    def conditional(self) -> Node:
        start = self.t.start
        test = self.binary(0)
        if self.at("?"):
            self.next()
            no_in, self.no_in = self.no_in, False
            m = self.mark()
            a = self.assignment()
            if not self.at(":") and a.kind == "Arrow":  # its colon was ours: read again, not as an arrow
                self.reset(m)
                self.failed.add(("arrow", self.t.start))
                a = self.assignment()
            self.no_in = no_in
            self.need(":")
            b = self.assignment()
            return Node("Conditional", start, self.last, test=test, consequent=a, alternate=b)
        return test

    def binary(self, least: int) -> Node:
        start = self.t.start
        left = self.unary()
        while True:
            op = self.operator()
            p = _BINARY.get(op)
            if p is None or p <= least or op == "in" and self.no_in:
                return left
            if op in ("as", "satisfies"):
                if self.t.nl:
                    return left
                self.next()
                kind = Node("TypeConst", self.t.start, self.next().end) if self.at("const") else self.type()
                left = Node("As" if op == "as" else "Satisfies", start, self.last, expression=left, type=kind)
                continue
            self.take(op)
            right = self.binary(p - 1 if op == "**" else p)
            left = Node("Logical" if op in ("&&", "||", "??") else "Binary", start, self.last, operator=op, left=left, right=right)

    def unary(self) -> Node:
        t = self.t
        if t.type == "p":
            if t.value in ("!", "~", "+", "-"):
                self.next()
                a = self.unary()
                return Node("Unary", t.start, self.last, operator=t.value, argument=a)
            if t.value in ("++", "--"):
                self.next()
                a = self.unary()
                return Node("Update", t.start, self.last, argument=a)
            if t.value == "<" and not self.jsx:
                self.next()
                kind = self.type()
                self.need(">")
                a = self.unary()
                return Node("TypeAssertion", t.start, self.last, type=kind, expression=a)
        elif t.type == "id":
            if t.value in ("typeof", "void", "delete"):
                self.next()
                a = self.unary()
                return Node("Unary", t.start, self.last, operator=t.value, argument=a)
            if t.value == "await" and not (self.peek().type == "p" and self.peek().value in (")", ",", ";", "=", ".", "=>", ":", "?", "}", "]")):
                self.next()
                a = self.unary()
                return Node("Await", t.start, self.last, argument=a)
        e = self.suffixes(self.primary(), t.start)
        if self.at("++", "--") and not self.t.nl:
            self.next()
            return Node("Update", t.start, self.last, argument=e)
        return e

    def arguments(self) -> list[Node]:
        self.need("(")
        no_in, self.no_in = self.no_in, False
        out = []
        while not self.eat(")"):
            at = self.t.start
            if self.eat("..."):
                a = self.assignment()
                out.append(Node("Spread", at, self.last, argument=a))
            else:
                out.append(self.assignment())
            if not self.at(")"):
                self.need(",")
        self.no_in = no_in
        return out

    def suffixes(self, e: Node, start: int, no_call: bool = False, no_object: bool = False) -> Node:
        start = e.start
        chain = False
        while True:
            t = self.t
            if t.type == "`":
                e = Node("TaggedTemplate", start, 0, tag=e, quasi=self.template())
                e.end = self.last
            elif t.type != "p":
                break
            elif t.value == ".":
                self.next()
                p = self.ident()
                e = Node("Member", start, self.last, object=e, property=p.name, property_start=p.start)
            elif t.value == "?.":
                if no_call:
                    break
                self.next()
                chain = True
                if self.at("("):
                    e = Node("Call", start, 0, callee=e, arguments=self.arguments(), optional=True)
                elif self.at("["):
                    self.next()
                    i = self.expression()
                    self.need("]")
                    e = Node("Index", start, 0, object=e, index=i, optional=True)
                elif self.at("<"):
                    types = self.type_args()
                    e = Node("Call", start, 0, callee=e, types=types, arguments=self.arguments(), optional=True)
                else:
                    p = self.ident()
                    e = Node("Member", start, 0, object=e, property=p.name, property_start=p.start, optional=True)
                e.end = self.last
            elif t.value == "[":
                self.next()
                no_in, self.no_in = self.no_in, False
                i = self.expression()
                self.no_in = no_in
                self.need("]")
                e = Node("Index", start, self.last, object=e, index=i)
            elif t.value == "(" and not no_call:
                e = Node("Call", start, 0, callee=e, arguments=self.arguments())
                e.end = self.last
            elif t.value == "!" and not t.nl and not self.s.startswith("!=", t.start):
                self.next()
                e = Node("NonNull", start, self.last, expression=e)
            elif t.value in ("<", "<<"):
                types = self.attempt("type args", self.call_type_args) if t.value == "<" else None
                if types is None:
                    break
                if self.t.type == "`":
                    e = Node("TaggedTemplate", start, 0, tag=e, types=types, quasi=self.template())
                    e.end = self.last
                elif self.at("(") and not no_call:
                    e = Node("Call", start, 0, callee=e, types=types, arguments=self.arguments())
                    e.end = self.last
                else:
                    e = Node("Instantiation", start, self.last, expression=e, types=types)
                    if no_call:
                        break
            else:
                break
        return Node("Chain", start, e.end, expression=e) if chain else e

    def call_type_args(self) -> list[Node]:
        types = self.type_args()
        if self.t.type == "`" or self.at("(", ")", "]", ":", ";", ",", ".", "?.", "==", "===", "!=", "!==", "&&", "||", "??", "}", "{", "extends", "implements") or self.t.type == "eof" or self.t.nl:
            return types
        raise SyntaxError("no type arguments")

    def primary(self) -> Node:
        t = self.t
        if t.type == "num":
            self.next()
            return Node("Number", t.start, t.end, raw=t.value)
        if t.type == "str":
            self.next()
            return Node("String", t.start, t.end, value=self.string(t.value))
        if t.type == "`":
            return self.template()
        if t.type == "id":
            v = t.value
            if v == "function" or v == "async" and self.peek().value == "function" and not self.peek().nl:
                return self.function()
            if v == "class":
                return self.klass()
            if v == "new":
                return self.new()
            if v == "import":
                self.next()
                if self.eat("."):
                    self.next()
                    return Node("Meta", t.start, self.last)
                args = self.arguments()
                return Node("ImportCall", t.start, self.last, arguments=args)
            self.next()
            if v in ("true", "false"):
                return Node("Boolean", t.start, t.end, value=v)
            if v == "null":
                return Node("Null", t.start, t.end)
            if v == "this":
                return Node("This", t.start, t.end)
            if v == "super":
                return Node("Super", t.start, t.end)
            if v in _RESERVED:
                raise SyntaxError(f"{v} at {t.start}")
            return Node("Identifier", t.start, t.end, name=v)
        if t.value == "(":
            self.next()
            no_in, self.no_in = self.no_in, False
            e = self.expression()
            self.no_in = no_in
            self.need(")")
            return Node("Paren", t.start, self.last, expression=e)
        if t.value == "[":
            self.next()
            out = []
            while not self.eat("]"):
                at = self.t.start
                if self.eat(","):
                    out.append(Node("Hole", at, at))
                    continue
                if self.eat("..."):
                    a = self.assignment()
                    out.append(Node("Spread", at, self.last, argument=a))
                else:
                    out.append(self.assignment())
                if not self.at("]"):
                    self.need(",")
            return Node("Array", t.start, self.last, elements=out)
        if t.value == "{":
            return self.object()
        if t.value in ("/", "/="):
            m = _REGEX.match(self.s, t.start)
            if not m:
                raise SyntaxError(f"regular expression at {t.start}")
            self.last = m.end()
            self.jump(m.end())
            return Node("Regex", t.start, m.end())
        if t.value == "<" and self.jsx:
            return self.element()
        if t.value == "@":
            d = self.decorators()
            c = self.klass()
            c.f["decorators"] = d
            return c
        raise SyntaxError(f"{t.value!r} at {t.start}")

    def new(self) -> Node:
        start = self.next().start
        if self.eat("."):
            self.next()
            return Node("Meta", start, self.last)
        callee = self.suffixes(self.new() if self.at("new") else self.primary(), self.t.start, no_call=True)
        types = []
        if callee.kind == "Instantiation":
            types, callee = callee.types, callee.expression
        args = self.arguments() if self.at("(") else []
        return Node("New", start, self.last, callee=callee, types=types, arguments=args)

    def object(self) -> Node:
        start = self.need("{").start
        no_in, self.no_in = self.no_in, False
        props = []
        while not self.eat("}"):
            at = self.t.start
            if self.eat("..."):
                a = self.assignment()
                props.append(Node("Spread", at, self.last, argument=a))
            else:
                ends = (",", "}", ":", "(", "<", "=")
                is_async = self.at("async") and self.peek().value not in ends and bool(self.next())
                generator = self.eat("*")
                accessor = self.at("get", "set") and self.peek().value not in ends and bool(self.next())
                shorthand = self.t.type == "id"
                key = self.property_key()
                if self.at("(", "<"):
                    v = self.function_object(is_async, generator)
                elif self.eat(":"):
                    v = self.assignment()
                elif shorthand:
                    v = Node("Identifier", key.start, key.end, name=key.name)
                    if self.eat("="):
                        d = self.assignment()
                        v = Node("Assignment", at, self.last, operator="=", left=v, right=d)
                else:
                    raise SyntaxError(f"property at {at}")
                props.append(Node("ObjectProperty", at, self.last, key=key, name=key.name if key.kind == "Key" else None, value=v, accessor=accessor))
            if not self.at("}"):
                self.need(",")
        self.no_in = no_in
        return Node("Object", start, self.last, properties=props)

    def function_object(self, is_async, generator) -> Node:
        return self.function_rest(self.t.start, "Function", is_async=is_async, generator=generator, method=True)

    def template(self) -> Node:
        start = self.t.start
        quasis, parts = [], []
        pos = start + 1
        text = pos
        while True:
            if pos >= self.n:
                raise SyntaxError("open template")
            c = self.s[pos]
            if c == "\\":
                pos += 2
            elif c == "`":
                quasis.append(self.s[text:pos])
                break
            elif c == "$" and self.s.startswith("${", pos):
                quasis.append(self.s[text:pos])
                self.jump(pos + 2)
                parts.append(self.expression())
                if not self.at("}"):
                    raise SyntaxError("} expected")
                pos = text = self.t.end
            else:
                pos += 1
        self.last = pos + 1
        self.jump(pos + 1)
        return Node("Template", start, self.last, quasis=tuple(quasis), parts=parts)

    def string(self, raw: str) -> str:
        v = raw[1:-1]
        if "\\" not in v:
            return v
        table = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}

        def one(m):
            x = m[1]
            if x[0] in "ux" and len(x) > 1:
                return chr(int(x.strip("ux{}"), 16))
            return table.get(x, x)

        return re.sub(r"\\(u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|(?s:.))", one, v)

    # JSX

    _JNAME = re.compile(r"[A-Za-z_$][\w$.:-]*")

    def element(self) -> Node:
        start = self.t.start
        pos = self.skip(start + 1)
        children: list[Node] = []
        if self.s.startswith(">", pos):
            pos, name = pos + 1, ""
        else:
            m = self._JNAME.match(self.s, pos)
            if not m:
                raise SyntaxError(f"element at {start}")
            name, pos = m[0], self.skip(m.end())
            if self.s.startswith("<", pos):
                self.jump(pos)
                self.type_args()
                pos = self.skip(self.last)
            while True:
                if self.s.startswith("/>", pos):
                    self.last = pos + 2
                    self.jump(self.last)
                    return Node("Jsx", start, self.last, children=children)
                if self.s.startswith(">", pos):
                    pos += 1
                    break
                if self.s.startswith("{", pos):
                    e, pos = self.container(pos)
                    children += e
                else:
                    m = self._JNAME.match(self.s, pos)
                    if not m:
                        raise SyntaxError(f"attribute at {pos}")
                    pos = self.skip(m.end())
                    if self.s.startswith("=", pos):
                        pos = self.skip(pos + 1)
                        if self.s.startswith("{", pos):
                            e, pos = self.container(pos)
                            children += e
                        elif self.s.startswith("<", pos):
                            self.jump(pos)
                            children.append(self.element())
                            pos = self.last
                        else:
                            q = self.s[pos : pos + 1]
                            end = self.s.find(q, pos + 1) if q in ("'", '"') else -1
                            if end < 0:
                                raise SyntaxError(f"attribute at {pos}")
                            pos = end + 1
                pos = self.skip(pos)
        while True:
            stop = pos
            while stop < self.n and self.s[stop] not in "<{":
                stop += 1
            if stop >= self.n:
                raise SyntaxError("open element")
            pos = stop
            if self.s[pos] == "{":
                e, pos = self.container(pos)
                children += e
                continue
            after = self.skip(pos + 1)
            if self.s.startswith("/", after):
                m = self._JNAME.match(self.s, self.skip(after + 1))
                if (m[0] if m else "") != name:
                    raise SyntaxError(f"closing tag at {pos}")
                end = self.s.find(">", after)
                self.last = end + 1
                self.jump(self.last)
                return Node("Jsx", start, self.last, children=children)
            self.t = Token("p", "<", pos, pos + 1, False)
            children.append(self.element())
            pos = self.last

    def skip(self, pos: int) -> int:
        return _WS.match(self.s, pos).end()

    def container(self, pos: int) -> tuple[list[Node], int]:
        self.jump(pos + 1)
        out = []
        if not self.at("}"):
            self.eat("...")
            out.append(self.expression())
        if not self.at("}"):
            raise SyntaxError("} expected")
        return out, self.t.end

    # types

    def type_annotation(self) -> Node | None:
        return self.type() if self.eat(":") else None

    def return_type(self) -> Node | None:
        if not self.eat(":"):
            return None
        if self.at("asserts") and self.peek().type == "id" and not self.peek().nl:
            self.next()
        if self.t.type == "id" and self.peek().value == "is" and not self.peek().nl:
            self.next()
            self.next()
        elif self.t.type == "id" and self.s[self.last : self.t.start].strip() == "" and self.at("asserts"):
            pass
        return self.type()

    def type_params(self) -> list[Node]:
        if not self.at("<"):
            return []
        self.next()
        out = []
        while not self.at(">"):
            while self.at("const", "in", "out") and self.peek().type == "id":
                self.next()
            self.ident()
            if self.eat("extends"):
                out.append(self.type())
            if self.eat("="):
                out.append(self.type())
            if not self.at(">"):
                self.need(",")
        self.next()
        return out

    def type_args(self) -> list[Node]:
        self.need("<")
        out = []
        while not self.at(">"):
            out.append(self.type())
            if not self.at(">"):
                self.need(",")
        self.last = self.t.start + 1
        self.jump(self.last)
        return out

    def type(self) -> Node:
        start = self.t.start
        if self.at("new", "abstract") and self.peek().value in ("(", "<", "new"):
            self.eat("abstract")
            self.next()
            return self.function_type(start)
        if self.at("<") or self.at("(") and self.function_type_ahead():
            if (f := self.attempt("function type", lambda: self.function_type(start))) is not None:
                return f
        if self.at("asserts") and self.peek().type == "id" and not self.peek().nl:
            self.next()
        if self.t.type == "id" and self.peek().value == "is" and self.peek().type == "id" and not self.peek().nl:
            self.next()
            self.next()
        left = self.type_union()
        if self.at("extends") and not self.t.nl and not self.no_cond_arrow:
            self.next()
            self.no_cond_arrow += 1
            bound = self.type()
            self.no_cond_arrow -= 1
            self.need("?")
            a = self.type()
            self.need(":")
            b = self.type()
            return Node("TypeConditional", start, self.last, parts=[left, bound, a, b])
        return left

    def function_type_ahead(self) -> bool:
        depth, pos = 0, self.t.start
        while True:
            t = self.scan(pos)
            if t.type == "eof":
                return False
            if t.type == "p":
                if t.value in "([{":
                    depth += 1
                elif t.value in ")]}":
                    depth -= 1
                    if not depth:
                        return self.scan(t.end).value == "=>"
            pos = t.end

    def function_type(self, start: int) -> Node:
        types = self.type_params()
        params = self.params()
        self.need("=>")
        saved, self.no_cond_arrow = self.no_cond_arrow, 0
        if self.at("asserts") and self.peek().type == "id":
            self.next()
        if self.t.type == "id" and self.peek().value == "is":
            self.next()
            self.next()
        out = self.type()
        self.no_cond_arrow = saved
        return Node("TypeFunction", start, self.last, types=types, params=params, returns=out)

    def type_union(self) -> Node:
        start = self.t.start
        self.eat("|") or self.eat("&")
        parts = [self.type_operator()]
        while self.at("|", "&"):
            self.next()
            parts.append(self.type_operator())
        return parts[0] if len(parts) == 1 else Node("TypeUnion", start, self.last, parts=parts)

    def type_operator(self) -> Node:
        start = self.t.start
        if self.at("keyof", "unique", "readonly", "infer") and (self.peek().type in ("id", "str", "`") or self.peek().value in ("(", "[", "{")) and not self.peek().nl:
            infer = self.next().value == "infer"
            part = self.type_operator()
            if infer and self.at("extends"):
                m = self.mark()
                self.next()
                self.no_cond_arrow += 1
                bound = self.type_union()
                self.no_cond_arrow -= 1
                if self.at("?") and not self.no_cond_arrow:
                    self.reset(m)
                else:
                    part = Node("TypeUnion", start, self.last, parts=[part, bound])
            return Node("TypeOperator", start, self.last, part=part)
        if self.at("new", "<") or self.at("(") and self.function_type_ahead():
            self.eat("new")
            return self.function_type(start)
        return self.type_primary()

    def type_primary(self) -> Node:
        t = self.t
        start = t.start
        if t.type == "id":
            if t.value == "typeof":
                self.next()
                if self.at("import"):
                    e = self.type_primary()
                else:
                    self.next()
                    while self.eat("."):
                        self.next()
                    e = None
                args = self.type_args() if self.at("<") and not self.t.nl else []
                e = Node("TypeQuery", start, self.last, of=e, args=args)
            elif t.value == "import":
                self.next()
                self.need("(")
                self.type()
                if self.eat(","):
                    self.object()
                self.need(")")
                while self.eat("."):
                    self.ident()
                args = self.type_args() if self.at("<") else []
                e = Node("TypeImport", start, self.last, args=args)
            elif t.value in _KEYWORD_TYPES and self.peek().value != ".":
                self.next()
                e = Node("TypeAny" if t.value == "any" else "TypeKeyword", start, self.last, name=t.value)
            else:
                self.next()
                name = t.value
                while self.at("."):
                    self.next()
                    name = self.ident().name
                args = self.type_args() if self.at("<") and not self.t.nl else []
                e = Node("TypeReference", start, self.last, name=name, simple=name == t.value, args=args)
        elif t.type in ("str", "num"):
            self.next()
            e = Node("TypeLiteral", start, self.last)
        elif t.type == "`":
            pos = start + 1
            parts = []
            while self.s[pos : pos + 1] != "`":
                if pos >= self.n:
                    raise SyntaxError("open template")
                if self.s[pos] == "\\":
                    pos += 2
                elif self.s.startswith("${", pos):
                    self.jump(pos + 2)
                    parts.append(self.type())
                    if not self.at("}"):
                        raise SyntaxError("} expected")
                    pos = self.t.end
                else:
                    pos += 1
            self.last = pos + 1
            self.jump(pos + 1)
            e = Node("TypeTemplate", start, self.last, parts=parts)
        elif t.value == "-":
            self.next()
            self.next()
            e = Node("TypeLiteral", start, self.last)
        elif t.value == "(":
            self.next()
            saved, self.no_cond_arrow = self.no_cond_arrow, 0
            e = self.type()
            self.no_cond_arrow = saved
            self.need(")")
            e = Node("TypeParen", start, self.last, part=e)
        elif t.value == "[":
            self.next()
            parts = []
            while not self.eat("]"):
                self.eat("...")
                if self.t.type == "id" and (self.peek().value == ":" or self.peek().value == "?" and self.scan(self.peek().end).value == ":"):
                    self.next()
                    self.eat("?")
                    self.next()
                parts.append(self.type())
                self.eat("?")
                if not self.at("]"):
                    self.need(",")
            e = Node("TypeTuple", start, self.last, parts=parts)
        elif t.value == "{":
            e = self.type_object()
        else:
            raise SyntaxError(f"type expected at {start}")
        while self.at("[") and not self.t.nl:
            self.next()
            if self.eat("]"):
                e = Node("TypeArray", start, self.last, part=e)
            else:
                i = self.type()
                self.need("]")
                e = Node("TypeIndex", start, self.last, part=e, index=i)
        return e

    def type_object(self) -> Node:
        start = self.need("{").start
        members = []
        while not self.eat("}"):
            if self.eat(";") or self.eat(","):
                continue
            at = self.t.start
            if self.at("+", "-"):
                self.next()
            while self.at("readonly", "static") and self.peek().value not in (":", "?", "(", ",", ";", "}", "<"):
                self.next()
            if self.at("get", "set") and self.peek().value not in (":", "?", "(", ",", ";", "}", "<"):
                self.next()
            if self.at("new") and self.peek().value in ("(", "<"):
                self.next()
            if self.at("(", "<"):
                types, params = self.type_params(), self.params()
                members.append(Node("CallSignature", at, self.last, types=types, params=params, returns=self.return_type()))
                continue
            if self.at("["):
                self.next()
                if self.t.type == "id" and self.peek().value == "in":
                    self.next()
                    self.next()
                    parts = [self.type()]
                    if self.eat("as"):
                        parts.append(self.type())
                    self.need("]")
                    self.eat("+") or self.eat("-")
                    self.eat("?")
                    if (v := self.type_annotation()) is not None:
                        parts.append(v)
                    members.append(Node("Mapped", at, self.last, parts=parts))
                    continue
                if self.t.type == "id" and self.peek().value == ":":
                    self.next()
                    self.next()
                    k = self.type()
                    self.need("]")
                    members.append(Node("IndexSignature", at, self.last, key=k, type=self.type_annotation()))
                    continue
                e = self.assignment()
                self.need("]")
                key = Node("Computed", at, self.last, value=e)
            else:
                key = self.property_key()
            self.eat("?")
            if self.at("(", "<"):
                types, params = self.type_params(), self.params()
                members.append(Node("MethodSignature", at, self.last, key=key, types=types, params=params, returns=self.return_type()))
            else:
                members.append(Node("PropertySignature", at, self.last, key=key, type=self.type_annotation()))
            if not (self.at(";", ",", "}") or self.t.nl):
                raise SyntaxError(f"member at {self.t.start}")
        return Node("TypeObject", start, self.last, members=members)


def comments(text: str, tree: Node) -> list[tuple[int, int]]:
    """Spans of the comments: found between tokens, so never inside strings or templates."""
    out = []
    for m in re.finditer(r"//[^\n]*|/\*(?s:.*?)\*/|'(?:[^'\\\n]|\\(?s:.))*'|\"(?:[^\"\\\n]|\\(?s:.))*\"|`(?:[^`\\]|\\(?s:.))*`", text):
        if m[0][0] == "/":
            out.append(m.span())
    return out


def parse(text: str, path: str = "a.ts") -> Node:
    """The program of a source; the extension tells whether it may hold JSX."""
    try:
        return Parser(text, path.endswith((".tsx", ".jsx"))).program()
    except (RecursionError, IndexError, ValueError) as e:
        raise SyntaxError(str(e)) from e
