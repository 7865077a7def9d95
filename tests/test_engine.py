"""Rules, scans and sources of the analysis."""

import json
import subprocess

import pytest


from astrel import cli
from astrel.plans import engine, rules
from astrel.plans.catalog import BY_ID, PRELUDE, RENAMES, RULES
from astrel.sources import astnodes, repo
from astrel.sources.tsparse import parse
from astrel.streaming import live

ALL = engine.Options(v4=True, adopt=True, agent=True)


def found(spark, files, options=ALL):
    df = engine.lint(spark.createDataFrame(list(files.items()), "file string, text string"), options)
    return sorted((r["file"], r["rule"], r["line"]) for r in df.collect())


def test_catalog():
    assert len(RULES) == len(BY_ID) == 118 and len(RENAMES) == len({r[:2] for r in RENAMES}) == 60
    assert {s: sum(r.severity == s for r in RULES) for s in ("error", "warn", "info")} == {"error": 21, "warn": 52, "info": 45}
    assert all(r.help for r in RULES)


@pytest.mark.parametrize(
    "source",
    [
        "const f = <T,>(x: T) => x", "a < b && c > d", "f<number>(1)", "type A<T> = T extends (infer U)[] ? U : never", "x = a ? (b) : (c)", "x = a ? (b) : c => d", "a = /[/]x/.test(b) / 2", "`a${b + `c${d}`}e`",
        "class A<T> extends B.C<D>('x')<E>()({a: 1}) implements X, Y<Z> { private x?: number = 1; static async *m(): void {} constructor(private readonly a: string) { super() } [k: string]: any; static { a() } }",
        "const {a, b: {c = 1}, ...r} = x", "function f(this: A, a = 1, ...r: any[]): x is string {}", "a >>>= b >> c", "new Foo<Bar>(x)", "type M = { readonly [K in keyof T]?: T[K] }", "a\n++b", "let x: typeof import('a')", "x!.y!; a?.b?.[c]?.(d)",
        "import a, {type b as c} from 'x'", "export default function* () { yield* a; yield }", "@dec() class A {@x() y() {}}", "for await (const a of b) {}", "label: for (;;) { break label }",
    ],
)
def test_parser_reads(source):
    assert parse(source).kind == "Program"


@pytest.mark.parametrize("source", ["const = 1", "f(", "'abc", "`abc", "class {", "if (a", "/* open", "\u0000"])
def test_parser_refuses(source):
    with pytest.raises(SyntaxError):
        parse(source)
    assert astnodes.rows("a.ts", 'import { Effect } from "effect"\n' + source) == []


def test_rules_fire_and_stay_silent(spark):
    files = {f"{r.id}/{k}.ts": rules._example(getattr(r, k)) for r in RULES for k in ("bad", "good") if getattr(r, k)}
    got = found(spark, files)
    for r in RULES:
        if r.bad:
            n = [sum(f == f"{r.id}/{k}.ts" and i == r.id for f, i, _ in got) for k in ("bad", "good")]
            assert n == [rules.COUNTS.get(r.id, 1), 0], r.id


def test_boundaries(spark):
    loop = "const p = Effect.gen(function* () { const f = () => { throw x }; [1].map(() => Effect.runSync(a)); yield* b })"
    files = {
        "none.ts": "export const effect = Effect.gen(function* () { yield 1 })",
        "alias.ts": 'import { Effect as E } from "effect"\nconst p = E.gen(function* () { yield 1 })',
        "module.ts": 'import * as E from "effect/Effect"\nconst p = E.gen(function* () { yield 1 })',
        "nested.ts": PRELUDE + loop,
        "chain.ts": PRELUDE + "if (a) { b() } else if (c) { d() } else if (e) { f() } else { g() }",
        "tag.ts": PRELUDE + 'const a = b._tag === "Some"',
        "optional.ts": PRELUDE + "const a = x?.then(f)",
        "comment.ts": PRELUDE + 'const a = "// @ts-ignore"',
        "long.ts": "\n" * 651,
        "fits.ts": "\n" * 650,
        "bytes.ts": PRELUDE + 'const é = "é"; const a: any = 1',
    }
    got = found(spark, files)
    by = lambda f: [i for x, i, _ in got if x == f]
    assert by("none.ts") == [] and by("alias.ts") == by("module.ts") == ["require-yield-star"]
    assert "no-run-inside-effect" in by("nested.ts") and "no-throw-in-effect" not in by("nested.ts")
    assert by("chain.ts").count("agent-no-if-else-chain") == 1
    assert "no-tag-string-comparison" in by("tag.ts") and "agent-no-string-equality-guard" not in by("tag.ts")
    assert "no-ts-ignore" not in by("comment.ts")
    assert ("long.ts", "agent-max-file-length", 651) in got and not by("fits.ts")
    row = engine.lint(spark.createDataFrame([("b.ts", files["bytes.ts"])], "file string, text string")).filter("rule = 'no-explicit-any'").first()
    assert row["column"] == len('const é = "é"; const a: '.encode()) + 1 and row["snippet"] == 'const é = "é"; const a: any = 1'


def test_tiers_and_strict(spark):
    f = {"a.ts": PRELUDE + "let a: any = Effect.fork"}
    assert {i for _, i, _ in found(spark, f, engine.Options())} == {"no-explicit-any"}
    files = spark.createDataFrame(list(f.items()), "file string, text string")
    strict = {r["rule"]: r["severity"] for r in engine.lint(files, engine.Options(agent_strict=True, v4=True)).collect()}
    assert strict == {"no-explicit-any": "error", "agent-no-let": "error", "v4-fork-renames": "error"}


def test_names_do_not_change_a_shape():
    a, b = (astnodes.rows("a.ts", PRELUDE + f"const f = {body}") for body in (rules._BODY, rules._SAME))
    assert [r["sig"] for r in a if r.get("sig")] == [r["sig"] for r in b if r.get("sig")] != []


def test_partner_limit(spark):
    nodes = engine.parsed(spark.createDataFrame(list(rules.REPOS["agent-near-duplicate-function"]), "file string, text string"))
    assert engine.partners(nodes).count() == 2 and engine.partners(nodes, limit=1).count() == 0


def test_queries_against_sql(spark, sf):
    import duckdb

    import __spark_entry__ as entry
    from astrel.plans import tables

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    queries, sql = tables.queries() | {k: v for k, v in rules.queries().items() if not k.startswith("q_rule_")}, entry.oracle_sql()
    for name, f in queries.items():
        got = f(spark, sf)
        want = con.execute(sql[name])
        columns = sorted(got.columns)
        names = [c[0] for c in want.description]
        assert sorted(names) == columns, name
        a = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
        b = sorted((tuple(r[names.index(c)] for c in columns) for r in want.fetchall()), key=str)
        assert a == b, name
    assert entry.entry(spark).columns == ["rule", "severity", "file", "doc_id", "line"]


def customers(spark, folder, rows):
    spark.createDataFrame(rows, "c_custkey bigint, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_range_count_of_odd_rows(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    # The last two are within ratio, though rounding puts their logarithms two buckets of width log(1.34) apart.
    balances = [None, -1.0, 0.0, 5e-324, 1e-310, 1.0, 1.0, 1.34, 1.3400000000000003, 1.7955999999999999, 100.0, 133.99, 134.0, 134.01, 1e308, 1.5e308, float("inf"), float("nan"), 0.002870146287496672, 0.0038459960252455404]
    rows = [(i, i % 2, "A", v) for i, v in enumerate(balances * 4)] + [(1000, 1, None, 1.0), (1001, None, "A", 1.0), (None, 1, "A", 1.0)]
    rows += [(2000 + i % 3, i % 2, "AB"[i % 5 % 2], v) for i, v in enumerate(balances * 3)] + [(3000, 2, "A", 5.0), (3000, 2, "A", 6.0), (3001, 3, "A", 5.0)]
    folder = customers(spark, tmp_path, rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{folder}/customer.parquet/*.parquet'")
    want = dict(con.execute(entry.oracle_sql()["q_len_bucket_join"]).fetchall())
    assert want[18] and 3000 not in want
    assert {r.c_custkey: r.n for r in entry.queries()["q_len_bucket_join"](spark, folder).collect()} == want


def test_range_count_makes_no_pairs(spark, tmp_path):
    """A group of 100,000 is 10^10 pairs; its counts come from two rows for each of its own."""
    import __spark_entry__ as entry

    balance = [100.0, 120.0, 150.0]
    folder = customers(spark, tmp_path, [(i, 1, "A", balance[i % 3]) for i in range(100_000)])
    got = entry.queries()["q_len_bucket_join"](spark, folder)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    a, b, c = 33_334, 33_333, 33_333
    assert {(r.c_custkey % 3, r.n) for r in got.collect()} == {(0, a + b - 1), (1, a + b + c - 1), (2, b + c - 1)}


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "src/__tests__").mkdir(parents=True)
    (tmp_path / "node_modules/x").mkdir(parents=True)
    (tmp_path / "packages/ui/src").mkdir(parents=True)
    for name, text in rules.SHOP.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "node_modules/x/a.ts").write_text("")
    (tmp_path / "src/a.d.ts").write_text("")
    (tmp_path / "src/ignored.ts").write_text("")
    (tmp_path / "src/latin.ts").write_bytes(b"\xff\xfe")
    (tmp_path / ".gitignore").write_text("ignored.ts\n")
    (tmp_path / "package.json").write_text(json.dumps({"name": "shop", "dependencies": {"effect": "workspace:*"}, "devDependencies": {"effect": "^4.0.1"}}))
    (tmp_path / "packages/ui/package.json").write_text(json.dumps({"name": "@acme/ui", "exports": {"./select": "./s.tsx", "./button": "./b.tsx", "./*": "./x"}}))
    (tmp_path / "tsconfig.json").write_text('{ // comment\n "strict" : true }')
    (tmp_path / "src/ui.ts").write_text('import { Effect } from "effect"\nimport { S } from "@radix-ui/react-select"\n')
    (tmp_path / "astrel.toml").write_text('[rules]\n"no-explicit-any" = "off"\n"x" = "bogus"\n[design-system]\npackage = "@acme/ui"\nforbid-import-prefixes = ["@radix-ui/"]\n')
    return tmp_path


def test_scan_of_a_directory(spark, tree):
    assert repo.walk(str(tree)) == ["src/__tests__/shop.test.ts", "src/broken.ts", "src/latin.ts", "src/plain.ts", "src/quiet.ts", "src/shop.ts", "src/ui.ts"]
    assert repo.effect_major(str(tree)) == 4
    out = cli.scan_dir(spark, str(tree))
    got = {(r["rule"], r["file"], r["line"]) for r in out["diagnostics"].collect()}
    assert got == {(r, f, n) for r, _, f, n, _ in rules.SHOP_FOUND if r != "no-explicit-any"} | {("ds-no-banned-import", "src/ui.ts", 2)}
    assert "use select" in out["diagnostics"].filter("rule = 'ds-no-banned-import'").first()["message"]
    assert out["score"].first()["files_scanned"] == 7 and out["any_error"].first()[0]
    (tree / "tsconfig.json").unlink()
    (tree / "tsconfig.base.json").write_text("{}")
    assert cli.scan_dir(spark, str(tree))["diagnostics"].filter("rule = 'prefer-strict-tsconfig'").count() == 1


def test_scan_of_changes(spark, tree):
    git = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-b", "main")
    git("add", ".")
    git("commit", "-m", "one")
    lines = rules.SHOP["src/shop.ts"].split("\n")
    (tree / "src/shop.ts").write_text("\n".join([*lines[:3], "  const more = yield Fx.succeed(1)", *lines[3:]]))
    (tree / "src/new.ts").write_text('import { Effect } from "effect"\nconst a: any = 1\n')
    rule_lines = lambda scope: {(r["rule"], r["line"]) for r in cli.scan_dir(spark, str(tree), scope, "HEAD")["diagnostics"].filter("file <> 'src/new.ts'").collect()}
    assert rule_lines("lines") == {("require-yield-star", 4)}
    assert ("require-yield-star", 5) in rule_lines("changed") and ("prefer-it-effect", 2) not in rule_lines("changed")


def test_hunks(spark):
    text = ["diff --git a/x b/x", "+++ b/x.ts", "@@ -1,2 +3,4 @@ f(+9,9)", "@@ -5 +7 @@", "@@ -9,2 +8,0 @@", "+++ b/y.ts", "@@ -0,0 +1 @@"]
    out = repo.changes_of(spark.createDataFrame(list(enumerate(text)), "nth bigint, line string"))
    assert sorted(map(tuple, out.collect())) == [("x.ts", 3, 6), ("x.ts", 7, 7), ("y.ts", 1, 1)]


def test_manifest_table(spark):
    p = spark.createDataFrame([(0, '{"dependencies": {"effect": "workspace:*"}}'), (1, "junk"), (2, '{"peerDependencies": {"effect": "~3.2"}}')], "rank int, text string")
    assert repo.major_of(p).first()[0] == 3


def test_reports_of_other_tools(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"diagnostics": [{"filePath": "/r/a.tsx", "rule": "hooks", "severity": "warning", "message": "m", "title": "t", "line": 2, "column": 3}]}))
    out = engine.external(spark, repo.report(spark, str(tmp_path / "r.json"), react=True), "rd", "react", "/r/").first()
    assert (out["rule"], out["severity"], out["file"], out["message"]) == ("rd/hooks", "warn", "a.tsx", "t")


def test_design_system_detection(spark):
    p = spark.createDataFrame([(0, "@a/ui", 3, []), (1, "@a/kits", 9, []), (2, "@a/wrap", 9, ["@radix-ui/react-x"]), (3, "@a/core", 50, [])], "nth int, name string, n_exports int, deps array<string>")
    assert repo.detect_design_system(p).first()[0] == "@a/wrap"
    assert [r["prefix"] for r in repo.detect_forbidden_prefixes(p).collect()] == ["@radix-ui/"]


def test_ignore_rules(tmp_path):
    """Patterns hold below their own folder, * stops at a slash and ** doesn't, later lines win."""
    for f in ("a/x.ts", "a/deep/x.ts", "a/gen/y.ts", "gen/y.ts", "b/c/d/z.ts", "b/z.ts", "b/keep.ts", "q1.ts"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_text("")
    (tmp_path / ".gitignore").write_text("b/*.ts\n!b/keep.ts\nb/**/z.ts\nq?.ts\n")
    (tmp_path / "a/.gitignore").write_text("/gen/\n/x.ts\n")
    assert repo.walk(str(tmp_path)) == ["a/deep/x.ts", "b/keep.ts", "gen/y.ts"]


def test_partner_messages(spark):
    body = "{ const a = yield* Effect.succeed(%s); const b = a + 1; return b * a - 2 }"
    text = 'import { Effect } from "effect"\n%s\nexport const %s = () => Effect.gen(function* () ' + body + ")\n"
    files = spark.createDataFrame([("a.ts", text % ("", "loadUser", "1")), ("b.ts", text % ("// pushed down", "fetchPerson", "1"))], "file string, text string")
    found = {r["file"]: r["message"] for r in engine.scan(files, engine.Options(agent=True)).filter("rule = 'agent-duplicate-cross-file'").collect()}
    assert found["a.ts"].endswith("in b.ts:3") and found["b.ts"].endswith("in a.ts:3") and " has the body of " in found["a.ts"]


def test_report_counts_what_it_hides(spark):
    rows = [(f"r{i % 5}", "warn", "style", "help", f"f{i}.ts", i, 1, "x") for i in range(40)]
    groups, hidden = engine.report(spark.createDataFrame(rows, "rule string, severity string, category string, help string, file string, line int, column int, snippet string"), 3, 2)
    got = groups.collect()
    assert hidden == 2 and [(g["rule"], g["n"], g["more"], len(g["places"])) for g in got] == [(f"r{i}", 8, 6, 2) for i in range(3)]


def test_live_equals_batch(spark, tmp_path):
    rows = [("a.ts", 1, rules.SHOP["src/shop.ts"]), ("a.ts", 2, rules.SHOP["src/quiet.ts"]), ("b.ts", 1, rules.SHOP["src/quiet.ts"]), ("b.ts", 2, rules.SHOP["src/shop.ts"])]
    schema = "uri string, version long, text string"
    for i in range(2):
        spark.createDataFrame(rows[i::2], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = live.live(stream, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    now = live.current(spark, str(tmp_path / "out"))
    want = engine.lint(spark.createDataFrame([(u, t) for u, v, t in rows if v == 2], "file string, text string"))
    key = lambda df: sorted((r["file"], r["rule"], r["line"], r["column"]) for r in df.collect())
    assert key(now) == key(want) != []
    sent = live.published(now).orderBy("line").first()
    assert sent["line"] == 2 and sent["start"] == 21 and "\n\n" in sent["message"]


def test_score(spark):
    rows = [("a", "error", "production"), ("a", "warn", "production"), ("b", "info", "production"), ("c", "error", "test"), ("prefer-it-effect", "warn", "test")]
    out = engine.score(spark.createDataFrame(rows, "rule string, severity string, file_context string")).first()
    assert (out["score"], out["error_rules"], out["warning_rules"]) == (97, 1, 2)
    seven = spark.createDataFrame([(str(i), "error" if i < 3 else "warn", "production") for i in range(7)], "rule string, severity string, file_context string")
    assert engine.score(seven).first()["score"] == 93  # 92.5, away from zero


def test_cli(tmp_path, capsys, spark):
    assert cli.main(["explain", "no-explicit-any"]) == 0 and cli.main(["explain", "nothing"]) == 2
    assert cli.main(["init", str(tmp_path)]) == 0 and cli.main(["init", str(tmp_path)]) == 1
    (tmp_path / "a.ts").write_text('import { Effect } from "effect"\nconst p = Effect.gen(function* () { yield 1 })\n')
    capsys.readouterr()
    assert cli.main(["scan", str(tmp_path), "--json", "--agent-strict"]) == 1
    report = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert report["score"] == 99 and report["diagnostics"][0]["rule"] == "require-yield-star"
    assert (report["files_scanned"], report["effect_files"]) == (1, 1) and report["duration_ms"] > 0
    assert cli.main(["scan", str(tmp_path)]) == 0
    assert "a.ts:2:" in capsys.readouterr().out
    for name, manifest in (("ui", {"name": "@a/ui", "exports": {"./a": "", "./b": "", "./c": ""}, "dependencies": {"@mui/x": "1"}}), ("app", {"name": "app"})):
        (tmp_path / "packages" / name).mkdir(parents=True)
        (tmp_path / "packages" / name / "package.json").write_text(json.dumps(manifest))
    assert cli.main(["init", str(tmp_path), "--force"]) == 0
    assert repo.config(str(tmp_path))["package"] == "@a/ui" and list(repo.config(str(tmp_path))["prefixes"]) == ["@mui/"]


def test_one_scan_for_all_rules(spark):
    """The fused projection reads the nodes once, whatever the number of rules."""
    nodes = astnodes.ast_nodes(spark.createDataFrame([("a.ts", PRELUDE)], "file string, text string"))
    plan = engine.fused(nodes, [r for r in RULES if r.when])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
