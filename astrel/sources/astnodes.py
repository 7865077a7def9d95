"""Syntax trees as a table: one row for each node that a rule may look at.

mapInArrow turns (file, text) into rows; everything that needs a walk of the tree
(frames, owned yields, calls below an argument, shapes of functions) becomes a
column here, so that rules are plain expressions over one row.  Positions are
packed as line * 2**20 + column, both from 1, columns in bytes.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrel.sources.tsparse import Node, comments, parse

SHIFT = 20
_ARG = (
    "kind string, module string, prop string, name string, str string, num string, pos bigint, n_args int, is_async boolean, generator boolean, n_params int, concise boolean, "
    "res_kind string, res_module string, res_prop string, res_arg0 string, keys array<string>, unbounded array<bigint>, below array<string>, on_tag boolean, sleeps boolean, callee string"
)
SCHEMA = (
    "file string, node_id int, parent_id int, kind string, pos bigint, span_end bigint, fn_id int, in_gen boolean, in_code boolean, module string, prop string, object_name string, member_prop string, "
    "callee_name string, callee_kind string, inner_module string, inner_prop string, inner_generator boolean, recv_member string, recv_module string, recv_prop string, recv_names array<string>, "
    f"args array<struct<{_ARG.replace(' ', ':').replace(',:', ', ')}>>, try_below array<string>, try_params int, catch_res string, operator string, left_kind string, right_kind string, left_str string, right_str string, "
    "left_tag boolean, right_tag boolean, flag boolean, own_yield boolean, own_await boolean, n_params int, n_stmts int, is_async boolean, generator boolean, name string, params_pos bigint, only_gen boolean, "
    "max_nest int, complexity int, sig binary, hist array<int>, sig_len int, callees array<string>, chain array<struct<module:string, prop:string, type_arg:string, type_pos:bigint, str:string, str_pos:bigint>>, "
    "members array<struct<kind:string, name:string, static:boolean, pos:bigint>>, implements array<string>, imported array<string>, str string, fork_name string, join_name string, idx int"
)
_STATEMENT_TAGS = {k: i + 1 for i, k in enumerate("Block If For ForOf ForIn While DoWhile Switch Try Throw Return VariableDeclaration ExpressionStatement Break Continue".split())}
_EXPRESSION_TAGS = {k: i + 64 for i, k in enumerate("Call Binary Logical Conditional Member Index Await Yield New Arrow Object Array Assignment Unary Template".split())}
_EXPRESSIONS = frozenset([*_EXPRESSION_TAGS, *"Identifier Number String Boolean Null This Super Regex Paren Chain Update As Satisfies NonNull TypeAssertion Instantiation TaggedTemplate Sequence ImportCall Meta Jsx".split()])
_LOOPS = frozenset("For ForOf ForIn While DoWhile".split())
_STATEMENTS = frozenset([*_STATEMENT_TAGS, *"Empty Labeled Debugger Import ExportDefault ExportAll ExportNamed ExportEquals Interface TypeAlias Enum Namespace Declare".split()])
_FUNCTIONS = ("Function", "Arrow")
_DEEP = frozenset("sync promise tryPromise runSync runSyncExit flatMap andThen log logDebug logInfo logWarning logError logTrace logFatal".split())
MIN_SIGNATURE = 16


def is_effect_source(source: str) -> bool:
    return source == "effect" or source.startswith(("effect/", "@effect/"))


def bare(e: Node | None) -> Node | None:
    """An expression without its parentheses."""
    while e is not None and e.kind == "Paren":
        e = e.expression
    return e


def walk(e: Node, stop=()):
    """Nodes of a subtree in source order, e first; not below nodes of the kinds in stop."""
    stack = [e]
    while stack:
        n = stack.pop()
        yield n
        if n is e or n.kind not in stop:
            stack.extend(reversed(list(n.children())))


def owns(e: Node | None, kind: str) -> bool:
    """Whether a node of the kind lies below e outside nested functions."""
    return e is not None and any(n.kind == kind for n in walk(e, _FUNCTIONS) if not (n.kind in _FUNCTIONS and n is e))


class File:
    """Rows of one source file."""

    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.tree = parse(text, path)
        self.lines = [0]
        at = text.find("\n")
        while at >= 0:
            self.lines.append(at + 1)
            at = text.find("\n", at + 1)
        self.ascii = text.isascii()
        self.modules: dict[str, str] = {}
        self.effect = False
        for s in self.tree.body:
            if s.kind == "Import":
                self.effect |= is_effect_source(s.source)
                if is_effect_source(s.source):
                    for form, name, local in s.specifiers:
                        if form == "named":
                            self.modules[local] = name
                        elif form == "namespace" and s.source.startswith("effect/"):
                            self.modules[local] = s.source.rsplit("/", 1)[-1]
        self.rows: list[dict] = []
        self.marked: dict[int, str] = {}

    def pos(self, at: int) -> int:
        line = bisect.bisect_right(self.lines, at) - 1
        col = at - self.lines[line] if self.ascii else len(self.text[self.lines[line] : at].encode())
        return (line + 1) << SHIFT | min(col + 1, (1 << SHIFT) - 1)

    def ref(self, e: Node | None) -> tuple[str | None, str | None]:
        """(module, property) of a member of an imported binding."""
        if e is not None and e.kind == "Member" and e.object.kind == "Identifier" and (m := self.modules.get(e.object.name)):
            return m, e.property
        return None, None

    def call(self, e: Node | None) -> tuple[str | None, str | None]:
        return self.ref(e.callee) if e is not None and e.kind == "Call" else (None, None)

    def direct_gen(self, e: Node | None) -> Node | None:
        """The generator of Effect.gen(...)."""
        if self.call(e) == ("Effect", "gen"):
            return next((a for a in e.arguments if a.kind == "Function" and a.generator), None)
        return None

    def result(self, f: Node | None) -> Node | None:
        """What a handler gives: a concise body, or the argument of a lone return."""
        if f is None or f.kind not in _FUNCTIONS or f.body is None:
            return None
        if f.concise:
            return bare(f.body)
        body = f.body.body
        return bare(body[0].argument) if len(body) == 1 and body[0].kind == "Return" else None

    def below(self, e: Node) -> list[str]:
        """What is called and constructed in a subtree."""
        out = []
        for n in walk(e):
            if n.kind == "Call":
                c = n.callee
                m, p = self.ref(c)
                if m:
                    out.append(f"M:{m}.{p}")
                if c.kind == "Member":
                    out.append(f"P:{c.property}")
                    if c.object.kind == "Identifier":
                        out.append(f"O:{c.object.name}.{c.property}")
                elif c.kind == "Identifier":
                    out.append(f"F:{c.name}")
            elif n.kind == "New" and n.callee.kind == "Identifier":
                out.append(f"N:{n.callee.name}")
        return out

    @staticmethod
    def category(e: Node | None) -> str | None:
        """The kind of an expression as far as rules tell kinds apart."""
        if e is None:
            return None
        if e.kind == "Identifier" and e.name == "undefined" or e.kind == "Unary" and e.operator == "void":
            return "Undefined"
        return e.kind

    def on_tag(self, e: Node) -> bool:
        def tagged(x):
            x = x if x is not None else Node("None", 0, 0)
            if x.kind == "Member":
                return x.property == "_tag" or tagged(x.object)
            if x.kind in ("Binary", "Logical"):
                return tagged(x.left) or tagged(x.right)
            return x.kind == "Conditional" and tagged(x.test)

        if e.kind != "Arrow":
            return False
        if e.concise:
            b = bare(e.body)
            return b.kind == "Conditional" and tagged(b.test)
        return any(s.kind == "If" and tagged(s.test) or s.kind == "Switch" and tagged(s.discriminant) for s in e.body.body)

    def sleeps(self, e: Node | None) -> bool:
        e = bare(e)
        if e is None or e.kind != "Call":
            return False
        if self.call(e) == ("Effect", "sleep"):
            return True
        c = e.callee
        return c.kind == "Member" and c.property == "pipe" and self.call(bare(c.object)) == ("Effect", "sleep")

    def arg(self, raw: Node, deep: bool) -> dict:
        if raw.kind == "Spread":
            return {"kind": "Spread", "pos": self.pos(raw.start)}
        e = bare(raw)
        m, p = self.call(e) if e.kind == "Call" else self.ref(e)
        a = {"kind": self.category(raw), "module": m, "prop": p, "pos": self.pos(raw.start), "sleeps": self.sleeps(raw) or e.kind == "Array" and any(self.sleeps(x) for x in e.elements)}
        if e.kind == "Identifier":
            a["name"] = e.name
        elif e.kind == "String":
            a["str"] = e.value
        elif e.kind == "Number":
            a["num"], a["pos"] = e.raw, self.pos(e.start)
        elif e.kind == "Call":
            a["n_args"] = len(e.arguments)
            a["callee"] = e.callee.name if e.callee.kind == "Identifier" else None
            if e.callee.kind == "Member" and e.callee.object.kind == "Identifier":
                a["name"] = f"{e.callee.object.name}.{e.callee.property}"
        elif e.kind == "Array":
            a["n_args"] = len([x for x in e.elements if x.kind != "Hole"])
        elif e.kind == "Object":
            a["keys"] = [x.name for x in e.properties if x.kind == "ObjectProperty" and x.key.kind == "Key" and self.text[x.key.start] not in "'\""]
            a["unbounded"] = [self.pos(x.start) for x in e.properties if x.kind == "ObjectProperty" and x.name == "concurrency" and x.value.kind == "String" and x.value.value == "unbounded"]
        if raw.kind in _FUNCTIONS:
            a |= {"is_async": bool(raw.is_async), "generator": bool(raw.generator), "n_params": len(raw.params), "concise": bool(raw.concise), "on_tag": self.on_tag(raw)}
            r = self.result(raw)
            if r is not None:
                a["res_kind"] = self.category(r)
                a["res_module"], a["res_prop"] = self.call(r) if r.kind == "Call" else self.ref(r)
                if r.kind == "Call" and r.arguments:
                    x = r.arguments[0]
                    a["res_arg0"] = "Nullish" if self.category(x) == "Undefined" or bare(x).kind == "Null" else x.kind
                if r.kind == "Template" and not r.parts:
                    a["res_kind"] = "PlainTemplate"
        if deep and raw.kind != "Identifier":
            a["below"] = self.below(raw)
            if raw.kind == "Template":
                a["below"] = ["T:" + x for x in a["below"]]
        return a

    def metrics(self, f: Node) -> tuple[int, int]:
        """(cognitive complexity, deepest nesting) of a body; nested functions are measured on their own."""
        total = deepest = 0
        stack = [(s, 0) for s in reversed(f.body.body)] if f.body.kind == "Block" else [(f.body, 0)]
        while stack:
            n, depth = stack.pop()
            if n.kind in _FUNCTIONS:
                continue
            if n.kind == "If":
                total += 1 + depth
                deepest = max(deepest, depth + 1)
                stack.append((n.test, depth))
                stack.append((n.consequent, depth + 1))
                if n.alternate is not None:
                    if n.alternate.kind == "If":
                        stack.append((n.alternate, depth))
                    else:
                        total += 1
                        stack.append((n.alternate, depth + 1))
                continue
            if n.kind in _LOOPS or n.kind in ("Switch", "Catch", "Conditional"):
                total += 1 + depth
                depth += 1
                deepest = max(deepest, depth)
            elif n.kind == "Logical" and n.operator != "??":
                total += 1
            stack.extend((c, depth) for c in n.children())
        return total, deepest

    def shape(self, f: Node) -> dict:
        """Signature, histogram and callees of a body, if it is long enough to tell."""
        sig, callees = bytearray(), set()
        body = f.body.body if f.body.kind == "Block" else [Node("ExpressionStatement", f.body.start, f.body.end, expression=f.body)]
        for s in body:
            for n in walk(s):
                if n.kind in _STATEMENTS or n.kind in ("Function", "Class") and n.statement:
                    sig.append(_STATEMENT_TAGS.get(n.kind, 16))
                elif n.kind in _EXPRESSIONS or n.kind in ("Function", "Class") and not n.method:
                    sig.append(_EXPRESSION_TAGS.get(n.kind, 79))
                if n.kind == "Call":
                    c = n.callee
                    if c.kind == "Identifier":
                        callees.add(c.name)
                    elif c.kind == "Member":
                        callees.add(c.property)
        if len(sig) < MIN_SIGNATURE:
            return {}
        hist = [0] * 32
        for t in sig:
            hist[t - 1 if t < 64 else t - 48] += 1
        return {"sig": bytes(sig), "hist": hist, "sig_len": len(sig), "callees": sorted(callees)}

    def forks(self, s: Node) -> str | None:
        if s.kind == "VariableDeclaration" and s.declarations[0].id.kind == "Identifier":
            y = bare(s.declarations[0].init)
            if y is not None and y.kind == "Yield" and y.delegate:
                m, p = self.call(bare(y.argument))
                if m == "Effect" and p in ("fork", "forkChild", "forkDaemon", "forkDetach", "forkScoped"):
                    return s.declarations[0].id.name
        return None

    def joins(self, s: Node) -> Node | None:
        e = {"VariableDeclaration": lambda: s.declarations[0].init, "Return": lambda: s.argument, "ExpressionStatement": lambda: s.expression}.get(s.kind, lambda: None)()
        y = bare(e)
        if y is not None and y.kind == "Yield":
            c = bare(y.argument)
            if self.call(c) == ("Fiber", "join") and c.arguments and c.arguments[0].kind == "Identifier":
                return c
        return None

    def row(self, n: Node, kind: str, parent: int, fn: int, gen: bool, code: bool, **cols) -> int:
        id_ = len(self.rows)
        self.rows.append({"file": self.path, "node_id": id_, "parent_id": parent, "kind": kind, "pos": self.pos(n.start), "span_end": n.end, "fn_id": fn, "in_gen": gen, "in_code": code} | cols)
        return id_

    def build(self) -> list[dict]:
        """All rows; none for a file without an import of the effect packages."""
        if not self.effect:
            return []
        stack = [(self.tree, -1, -1, False, False, None, None)]
        while stack:
            n, parent, fn, gen, code, role, up = stack.pop()
            f = getattr(self, "r_" + n.kind, None)
            id_ = parent
            if f is not None:
                cols = f(n, role, up)
                if cols is not None:
                    id_ = self.row(n, n.kind, parent, fn, gen, code, **cols)
            if n.kind == "Call":
                self.mark(n)
                g = self.direct_gen(n)
                if g is not None:
                    for i, s in enumerate(g.body.body):
                        j = self.joins(s)
                        if self.forks(s) or j is not None:
                            self.row(j or s, "GenStatement", id_, fn, gen, code, idx=i, fork_name=self.forks(s), join_name=j.arguments[0].name if j is not None else None)
            if n.kind in _FUNCTIONS:
                frame = self.marked.get(n.start)
                fn, gen, code = id_, frame == "gen", code or frame is not None
            kids = [(c, id_, fn, gen, code, r, n) for r, v in n.f.items() for c in (v if isinstance(v, list) else [v]) if isinstance(c, Node)]
            stack.extend(reversed(kids))
        for a, b in comments(self.text, self.tree):
            self.row(Node("Comment", a, b), "Comment", -1, -1, False, False, str=self.text[a:b])
        return self.rows

    def mark(self, c: Node) -> None:
        """Frames of the functions that a call gets, before they are reached."""
        m, p = self.call(c)
        im, ip = self.call(c.callee) if c.callee.kind == "Call" else (None, None)
        if m == "Effect" and p in ("gen", "fn", "fnUntraced") or im == "Effect" and ip in ("gen", "fn", "fnUntraced") and m is None:
            for a in c.arguments:
                if a.kind == "Function" and a.generator:
                    self.marked[a.start] = "gen"
        if m == "Effect":
            for a in c.arguments:
                if a.kind in _FUNCTIONS:
                    self.marked.setdefault(a.start, "callback")

    # columns by kind; None: no row

    def r_Call(self, n, role, up):
        c = n.callee
        m, p = self.ref(c)
        cols = {"module": m, "prop": p, "callee_kind": c.kind}
        if c.kind == "Identifier":
            cols["callee_name"] = c.name
        inner = bare(c)
        if inner.kind == "Call":
            cols["inner_module"], cols["inner_prop"] = self.call(inner)
            cols["inner_generator"] = any(a.kind == "Function" and a.generator for a in inner.arguments)
        if c.kind == "Member":
            cols["member_prop"] = c.property
            cols["object_name"] = c.object.name if c.object.kind == "Identifier" else None
            r = bare(c.object)
            if r.kind == "Call":
                cols["recv_member"] = r.callee.property if r.callee.kind == "Member" else None
                cols["recv_module"], cols["recv_prop"] = self.call(r)
                cols["recv_names"] = [a.name if a.kind == "Identifier" else None for a in r.arguments]
        deep = p in _DEEP and m in ("Effect", "Stream")
        cols["args"] = [self.arg(a, deep) for a in n.arguments]
        g = self.direct_gen(n)
        if g is not None:
            b = g.body.body
            y = bare(b[0].argument) if len(b) == 1 and b[0].kind == "Return" else None
            cols |= {"n_params": len(g.params), "params_pos": self.pos(g.params_start), "only_gen": y is not None and y.kind == "Yield" and bool(y.delegate)}
        if m == "Effect" and n.arguments and n.arguments[0].kind == "Object":
            for x in n.arguments[0].properties:
                if x.kind == "ObjectProperty" and x.name == "try":
                    cols["try_below"], cols["try_params"] = self.below(x.value), len(x.value.params or []) if x.value.kind in _FUNCTIONS else None
                elif x.kind == "ObjectProperty" and x.name == "catch":
                    cols["catch_res"] = self.category(self.result(x.value))
        return cols

    def r_New(self, n, role, up):
        return {"callee_name": n.callee.name if n.callee.kind == "Identifier" else None, "args": [self.arg(a, False) for a in n.arguments]}

    def r_Member(self, n, role, up):
        m, p = self.ref(n)
        return {"module": m, "prop": p, "member_prop": n.property, "object_name": n.object.name if n.object.kind == "Identifier" else None}

    def r_Yield(self, n, role, up):
        a = bare(n.argument)
        m, p = self.call(a)
        return {"flag": bool(n.delegate), "module": m, "prop": p, "generator": self.direct_gen(a) is not None, "args": [self.arg(x, False) for x in a.arguments] if a is not None and a.kind == "Call" else None}

    def r_Try(self, n, role, up):
        return {"flag": n.handler is not None, "own_yield": n.finalizer is not None and (owns(n.block, "Yield") or owns(n.finalizer, "Yield")), "left_kind": "Finally" if n.finalizer is not None else None}

    def r_Catch(self, n, role, up):
        return {"n_stmts": len(n.body.body)}

    def r_Throw(self, n, role, up):
        return {}

    def _loop(self, n, role, up):
        return {"own_yield": owns(n.body, "Yield"), "own_await": owns(n.body, "Await")}

    r_For = r_ForOf = r_ForIn = r_While = r_DoWhile = _loop

    def r_Return(self, n, role, up):
        m, p = self.call(bare(n.argument))
        return {"module": m, "prop": p}

    def r_Binary(self, n, role, up):
        side = lambda e: (e.kind, e.value if e.kind == "String" else None, e.kind == "Member" and e.property == "_tag")
        (lk, ls, lt), (rk, rs, rt) = side(bare(n.left)), side(bare(n.right))
        return {"operator": n.operator, "left_kind": lk, "right_kind": rk, "left_str": ls, "right_str": rs, "left_tag": lt, "right_tag": rt}

    def r_Switch(self, n, role, up):
        d = bare(n.discriminant)
        return {"left_tag": d.kind == "Member" and d.property == "_tag"}

    def r_If(self, n, role, up):
        return {"flag": n.alternate is not None, "left_kind": "ElseIf" if role == "alternate" and up.kind == "If" else None}

    def r_Conditional(self, n, role, up):
        return {}

    def r_VariableDeclaration(self, n, role, up):
        return {"name": n.var}

    def r_Assignment(self, n, role, up):
        return {"left_kind": n.left.kind, "operator": n.operator} if not (up is not None and up.kind == "ObjectProperty" and n.start == up.start and up.key.start == n.start) else None

    def r_ImportCall(self, n, role, up):
        return {}

    def r_TypeAny(self, n, role, up):
        return {}

    def r_NonNull(self, n, role, up):
        return {}

    def r_As(self, n, role, up):
        return {"flag": bare(n.expression).kind == "As"}

    def r_ExportDefault(self, n, role, up):
        return {}

    def r_Import(self, n, role, up):
        return {"str": n.source, "imported": [name for form, name, _ in n.specifiers if form == "named"]}

    def r_TaggedTemplate(self, n, role, up):
        return {"name": n.tag.name if n.tag.kind == "Identifier" else None, "str": n.quasi.quasis[0]}

    def r_Interface(self, n, role, up):
        members = [{"kind": m.kind, "name": m.key.name if m.key is not None else None, "static": False, "pos": self.pos(m.start)} for m in n.body.members]
        return {"name": n.id.name, "members": members}

    def r_Class(self, n, role, up):
        chain, e = [], n.base
        while e is not None and e.kind == "Call":
            m, p = self.call(e)
            first = (e.types or [None])[0]
            ref = first if first is not None and first.kind == "TypeReference" and first.simple else None
            a = bare(e.arguments[0]) if e.arguments else None
            chain.append({"module": m, "prop": p, "type_arg": ref.name if ref is not None else None, "type_pos": self.pos(ref.start) if ref is not None else None, "str": a.value if a is not None and a.kind == "String" else None, "str_pos": self.pos(e.arguments[0].start) if e.arguments else self.pos(e.start)})
            e = e.callee
        members = []
        for m in n.members:
            kind = "constructor" if m.kind == "Method" and m.name == "constructor" and not m.static else m.kind
            members.append({"kind": kind, "name": m.name, "static": bool(m.static), "pos": self.pos(m.start)})
        return {"name": n.id.name if n.id is not None else None, "chain": chain, "members": members, "implements": [t.name for t in n.implements if t.kind == "TypeReference" and t.simple], "object_name": n.base.name if n.base is not None and n.base.kind == "Identifier" else None}

    def _function(self, n, role, up):
        cols = {"is_async": bool(n.is_async), "generator": bool(n.generator), "n_params": len([p for p in n.params if not p.rest]), "params_pos": self.pos(n.params_start)}
        name = n.id.name if n.kind == "Function" and n.id is not None else None
        if name is None and up is not None:
            if up.kind == "Declarator" and up.id.kind == "Identifier" and up.init is n:
                name = up.id.name
            elif up.kind in ("Method", "ObjectProperty", "Property") and up.value is n:
                name = up.name
        cols["name"] = name
        if n.body is not None:
            b = n.body.body if n.body.kind == "Block" else None
            only = bare(n.body) if b is None else bare(b[0].argument) if len(b) == 1 and b[0].kind == "Return" else None
            cols["only_gen"] = self.direct_gen(only) is not None
            cols["complexity"], cols["max_nest"] = self.metrics(n)
            cols |= self.shape(n)
        return cols

    r_Function = r_Arrow = _function


def rows(path: str, text: str) -> list[dict]:
    """Rows of one file; a file that can't be parsed has none."""
    try:
        return File(path, text).build()
    except (SyntaxError, RecursionError):
        return []


def ast_nodes(files: DataFrame) -> DataFrame:
    """Rows of files(file, text).  Files without the word effect are left out before they reach Python."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def over(batches):
        for batch in batches:
            out = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += rows(path, text)
                if len(out) > 20_000:
                    yield from pa.Table.from_pylist(out, schema=schema).to_batches()
                    out = []
            if out:
                yield from pa.Table.from_pylist(out, schema=schema).to_batches()

    return files.select("file", "text").filter(F.contains("text", F.lit("effect"))).mapInArrow(over, SCHEMA)
