"""Queries that run the analysis on sources kept here: one for each rule, and whole scans; their SQL is what they must find."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrel.operators import relational as R
from astrel.plans import engine
from astrel.plans.catalog import BY_ID, CATEGORY_LABELS, PRELUDE, RULES

#: Findings in a rule's bad example, where it isn't one.
COUNTS = {"agent-duplicate-function": 2}
_BODY = "(a, b) => { const c = a.x + b.y; if (c > 2) { return first(c, a) } return second(c, b.z) }"
_SAME = "(u, v) => { const w = u.x + v.y; if (w > 9) { return third(w, u) } return fourth(w, v.z) }"
_NEAR = "(a, b) => { const c = a.x + b.y; if (c > 3) { return first(c, b) } third(c); return second(c, b.z) }"
_CALLS = "(p, q) => { while (p.ok) { if (q) { first(p) } else { second(q); p = q } } try { q.go = [p, p] } catch (e) { throw e } return [p.a + 1, q.b * 2, { p, q }] }"
REPOS: dict[str, tuple[tuple[str, str], ...]] = {
    "agent-duplicate-cross-file": (("src/a.ts", f"{PRELUDE}export const foo = {_BODY}"), ("src/b.ts", f"{PRELUDE}export const bar = {_SAME}"), ("src/c.ts", f"{PRELUDE}export const x = 1")),
    "agent-near-duplicate-function": (("src/a.ts", f"{PRELUDE}export const foo = {_BODY}"), ("src/b.ts", f"{PRELUDE}export const bar = {_NEAR}")),
    "agent-similar-function-name": (("src/a.ts", f"{PRELUDE}export const shared = {_BODY}"), ("src/b.ts", f"{PRELUDE}export const shared = {_CALLS.replace('first', 'other')}"), ("src/c.ts", f"{PRELUDE}export const init = 1")),
    "agent-similar-shape": (("src/a.ts", f"{PRELUDE}export const foo = {_BODY}"), ("src/b.ts", f"{PRELUDE}export const bar = {_CALLS}")),
}
SHOP = {
    "src/shop.ts": """import { Effect as Fx, Schedule } from "effect"
import * as S from "effect/Schema"
export const price = (id: string) => Fx.gen(function* () {
  const row = yield Fx.succeed(id)
  if (!row) { throw new Error("none") }
  console.log(row)
  return row
})
const retry = Schedule.exponential("1 second")
export class Item extends S.Class<Thing>("Item")({}) {
  constructor() { super({}) }
}
""",
    "src/__tests__/shop.test.ts": """import { Effect } from "effect"
it("prices", () => Effect.runPromise(price("a")))
const value: any = JSON.parse("1")
""",
    "src/plain.ts": "export const effect = () => { throw new Error('no import, no findings') }\n",
    "src/broken.ts": 'import { Effect } from "effect"\nexport const = (\n',
    "src/quiet.ts": 'import { Effect } from "effect"\nexport const one = Effect.succeed(1)\n',
}
SHOP_FOUND = (
    ("prefer-effect-fn", "warn", "src/shop.ts", 3, 22), ("require-yield-star", "error", "src/shop.ts", 4, 15), ("no-throw-in-effect", "error", "src/shop.ts", 5, 15), ("prefer-effect-logging", "warn", "src/shop.ts", 6, 3),
    ("add-jitter-to-backoff", "info", "src/shop.ts", 9, 15), ("cap-exponential-backoff", "info", "src/shop.ts", 9, 15), ("schema-class-self-mismatch", "error", "src/shop.ts", 10, 35), ("no-constructor-override-in-schema-class", "error", "src/shop.ts", 11, 3),
    ("prefer-it-effect", "warn", "src/__tests__/shop.test.ts", 2, 1), ("no-explicit-any", "warn", "src/__tests__/shop.test.ts", 3, 14),
)


def _files(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], "file string, text string")


def _example(text: str) -> str:
    return text if 'from "effect' in text else PRELUDE + text


def q_rule(rule: str, spark: SparkSession, d: str) -> DataFrame:
    """Findings of one rule in its bad and good example."""
    options = engine.Options(v4=True, adopt=True, agent=True, only=[rule])
    names = spark.createDataFrame([("bad",), ("good",)], "example string")
    if rule == "prefer-strict-tsconfig":
        found = engine.loose_tsconfig(_files(spark, [("tsconfig.base.json", '{"strict": true}'), ("tsconfig.json", '{"compilerOptions": {}}')])).withColumn("file", F.lit("bad"))
    elif rule == "ds-no-banned-import":
        files = _files(spark, [("app/a.ts", f'{PRELUDE}import {{ S }} from "@radix-ui/react-select"'), ("packages/ui/b.ts", f'{PRELUDE}import {{ S }} from "@radix-ui/react-select"')])
        catalog = spark.createDataFrame([("select", "Select")], "leaf string, component string")
        found = engine.banned_imports(engine.parsed(files), ["@radix-ui/"], catalog, "@acme/ui").withColumn("file", F.when(F.col("file") == "app/a.ts", "bad").otherwise("good"))
    elif rule in REPOS:
        found = engine.partners(engine.parsed(_files(spark, REPOS[rule]))).filter(F.col("rule") == rule).withColumn("file", F.lit("bad"))
    else:
        r = BY_ID[rule]
        found = engine.raw_findings(_files(spark, [("bad", _example(r.bad)), ("good", _example(r.good))]), options)
    n = found.groupBy(F.col("file").alias("example")).agg(F.count("*").alias("n"))
    return names.join(n, "example", "left").select("example", F.coalesce("n", F.lit(0)).alias("n"))


def q_rules_catalog(spark: SparkSession, d: str) -> DataFrame:
    return engine.rules_table(spark).select("id", "severity", "category", "label", "gate")


def q_scan(spark: SparkSession, d: str) -> DataFrame:
    """A repository end to end: parse, rules, positions."""
    return engine.scan(_files(spark, SHOP.items())).select("rule", "severity", "file", "line", "column")


def q_scan_settings(spark: SparkSession, d: str) -> DataFrame:
    """The same with settings: a rule off, one pinned."""
    options = engine.Options(settings={"no-explicit-any": "off", "require-yield-star": "Warn", "nonsense": "x"})
    return engine.scan(_files(spark, SHOP.items()), options).select("rule", "severity", "file", "line", "column")


def q_scan_lines(spark: SparkSession, d: str) -> DataFrame:
    """The same over changed lines only."""
    changes = spark.createDataFrame([("src/shop.ts", 4, 5), ("src/__tests__/shop.test.ts", None, None), ("README.md", 1, 2)], "file string, start int, end int")
    return engine.scan(_files(spark, SHOP.items()), engine.Options(scope="lines"), changes).select("rule", "severity", "file", "line", "column")


def q_scan_score(spark: SparkSession, d: str) -> DataFrame:
    return engine.score(engine.scan(_files(spark, SHOP.items())))


def q_scan_report(spark: SparkSession, d: str) -> DataFrame:
    return R.report_groups(engine.scan(_files(spark, SHOP.items())))[0]


def q_external(spark: SparkSession, d: str) -> DataFrame:
    """Findings of another tool as diagnostics."""
    rows = spark.createDataFrame([("/r/src/a.ts", 3, 1, "Error", "floating", "m"), ("/r/src/a.test.ts", 4, 2, "hint", "x", "n")], "file string, line int, column int, severity string, name string, message string")
    return engine.external(spark, rows, "ls", "type-aware", "/r/").select("rule", "severity", "category", "file", "file_context", "line")


def _values(rows, *names: str) -> str:
    lit = lambda x: str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({', '.join(names)})"


_PLACE = ("rule", "severity", "file", "line", '"column"')


def queries() -> dict:
    out = {f"q_rule_{r.id.replace('-', '_').lower()}": functools.partial(q_rule, r.id) for r in RULES}
    return out | {f.__name__: f for f in (q_rules_catalog, q_scan, q_scan_settings, q_scan_lines, q_scan_score, q_scan_report, q_external)}


def oracle_sql() -> dict[str, str]:
    out = {}
    for r in RULES:
        n = COUNTS.get(r.id, 2 if r.id in REPOS else 1)
        out[f"q_rule_{r.id.replace('-', '_').lower()}"] = f"SELECT * FROM (VALUES ('bad', {n}::BIGINT), ('good', 0::BIGINT)) v(example, n)"
    out["q_rules_catalog"] = _values([(r.id, r.severity, r.category, CATEGORY_LABELS[r.category], r.gate) for r in RULES], "id", "severity", "category", "label", "gate")
    out["q_scan"] = _values(SHOP_FOUND, *_PLACE)
    out["q_scan_settings"] = _values([(r, "warn" if r == "require-yield-star" else s, *x) for r, s, *x in SHOP_FOUND if r != "no-explicit-any"], *_PLACE)
    out["q_scan_lines"] = _values([x for x in SHOP_FOUND if "test" in x[2] or x[3] in (4, 5)], *_PLACE)
    # 4 error rules; 2 warnings in production and one about tests: 100 - 6 - 2.25
    out["q_scan_score"] = "SELECT 92::INT AS score, 'Great' AS label, 4::BIGINT AS error_rules, 3::BIGINT AS warning_rules"
    out["q_scan_report"] = "SELECT * FROM (VALUES ('no-constructor-override-in-schema-class', 0, 1::BIGINT), ('no-throw-in-effect', 0, 1::BIGINT), ('require-yield-star', 0, 1::BIGINT)) v(rule, rank, n)"
    out["q_external"] = _values([("ls/floating", "error", "type-aware", "src/a.ts", "production", 3), ("ls/x", "info", "type-aware", "src/a.test.ts", "test", 4)], "rule", "severity", "category", "file", "file_context", "line")
    return out
