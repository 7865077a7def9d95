"""The analysis: files to findings, score and report.

    files -> scope -> ast_nodes -> rules (one fused projection, renames by broadcast
    join, windows and aggregates for the rest) -> repo-level partners -> union with
    external findings -> settings -> score and report

Rules whose tier is off are left out of the plan when it is built.  Nodes are
written once where several branches read them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from astrel.functions import scalars as X
from astrel.operators import relational as R
from astrel.plans.catalog import BY_ID, CATEGORY_LABELS, RENAMES, RULES
from astrel.sources.astnodes import SHIFT, ast_nodes

DIAGNOSTICS = "rule string, severity string, category string, message string, help string, file string, file_context string, line int, column int, snippet string"
TEST_RULES = ("prefer-it-effect", "prefer-test-clock", "no-run-in-tests")
MAX_LINES = 650
GENERIC_NAMES = ("run", "handle", "main", "init", "setup", "teardown", "callback", "cb", "noop")


@dataclass(frozen=True)
class Options:
    """Tiers and parameters of a scan."""

    v4: bool = False
    adopt: bool = False
    agent: bool = False
    agent_strict: bool = False
    scope: str = "full"  # full, changed or lines
    fuzzy_limit: int = R.FUZZY_LIMIT
    only: Sequence[str] | None = None  # rule ids to evaluate, or all
    settings: dict[str, str] = field(default_factory=dict)

    def wants(self, rule) -> bool:
        tier = {"on": True, "v4": self.v4, "adopt": self.adopt, "agent": self.agent or self.agent_strict, "config": False}[rule.gate]
        return tier and (self.only is None or rule.id in self.only)


def _struct(rule, pos: str) -> str:
    return f"named_struct('rule', '{rule.id}', 'pos', {pos}, 'message', {rule.message})"


def fused(nodes: DataFrame, rules) -> DataFrame:
    """(file, rule, pos, message): all rules that look at one row, in one projection over one scan."""
    parts, kinds = [], set()
    for r in rules:
        kinds |= set(r.kinds)
        on = f"kind in ({', '.join(repr(k) for k in r.kinds)})"
        if r.many:
            parts.append(f"if({on} and ({r.when}), transform({r.many}, q -> {_struct(r, 'q')}), array())")
        else:
            parts.append(f"if({on} and ({r.when}), array({_struct(r, r.pos)}), array())")
    if not parts:
        return nodes.sparkSession.createDataFrame([], "file string, rule string, pos bigint, message string")
    empty = "cast(array() as array<struct<rule:string, pos:bigint, message:string>>)"
    cast = [p.replace("array())", f"{empty})") if p.endswith("array())") else p for p in parts]
    return nodes.filter(F.col("kind").isin(*sorted(kinds))).selectExpr("file", f"inline(flatten(array({', '.join(cast)})))")


def _found(df: DataFrame, rule: str, pos="pos", message: str | None = None) -> DataFrame:
    return df.select("file", F.lit(rule).alias("rule"), F.col(pos).alias("pos"), F.expr(message or BY_ID[rule].message).alias("message"))


def joined(nodes: DataFrame, options: Options) -> list[DataFrame]:
    """Findings of the rules that need more than one row."""
    out = []
    wants = lambda i: options.wants(BY_ID[i])
    if renames := [r for r in RENAMES if wants(r[2])]:
        dim = nodes.sparkSession.createDataFrame(renames, "module string, prop string, rule string, hint string")
        hit = nodes.filter("kind = 'Member' and module is not null").select("file", "pos", "module", "prop").join(F.broadcast(dim), ["module", "prop"])
        out.append(hit.select("file", "rule", "pos", F.concat("module", F.lit("."), "prop", F.lit(" -> "), "hint").alias("message")))
    if wants("no-fork-then-immediate-join"):
        w = Window.partitionBy("file", "parent_id").orderBy("idx")
        s = nodes.filter("kind = 'GenStatement'").select("file", "parent_id", "idx", "pos", "join_name", F.lag("fork_name").over(w).alias("before"), F.lag("idx").over(w).alias("at"))
        out.append(_found(s.filter("before = join_name and at = idx - 1"), "no-fork-then-immediate-join"))
    backoff = {"add-jitter-to-backoff": ("jittered",), "cap-exponential-backoff": ("either", "union", "upTo", "intersect", "both")}
    for rule, guards in backoff.items():
        if wants(rule):
            schedule = nodes.filter("kind = 'Member' and module = 'Schedule'").select("file", "pos", "prop")
            guarded = schedule.filter(F.col("prop").isin(*guards)).select("file").distinct()
            out.append(_found(schedule.filter("prop = 'exponential'").join(guarded, "file", "left_anti"), rule))
    if wants("agent-duplicate-function"):
        bodies = nodes.filter("sig is not null").select("file", "pos", "sig")
        out.append(_found(R.duplicates_within(bodies, "file", "sig"), "agent-duplicate-function"))
    if wants("oop-strategy-to-function"):
        single = nodes.filter("kind = 'Interface' and size(members) = 1 and members[0].kind = 'MethodSignature'").select("file", "name", "pos")
        uses = nodes.filter("kind = 'Class'").select("file", F.explode("implements").alias("name")).groupBy("file", "name").agg(F.count("*").alias("n")).filter("n >= 2")
        out.append(_found(single.join(uses, ["file", "name"]), "oop-strategy-to-function"))
    return out


def long_files(files: DataFrame, limit: int = MAX_LINES) -> DataFrame:
    """One finding for each file of more lines, on the first line too many; needs no import."""
    n = X.line_count(F.col("text"))
    return files.filter(n > limit).select("file", F.lit("agent-max-file-length").alias("rule"), F.lit((limit + 1 << SHIFT) | 1).cast("bigint").alias("pos"), F.concat(n, F.lit(" lines")).alias("message"))


def partners(nodes: DataFrame, limit: int = R.FUZZY_LIMIT) -> DataFrame:
    """Repo-level findings: for each function its strongest likeness to one in another file.

    exact body > similar body > same name > same calls.  The first partner by file and position.
    """
    f = nodes.filter("sig is not null").select("file", "pos", "sig", "sig_len", "hist", "n_params", "callees", "name")
    f = f.withColumn("at", F.concat_ws(":", "file", F.lpad("pos", 16, "0")))
    named = F.when((F.octet_length("name") >= 3) & ~F.col("name").isin(*GENERIC_NAMES), F.col("name"))
    calls = F.when(F.size("callees") >= 2, F.concat_ws("\u0001", F.col("n_params").cast("string"), F.array_join("callees", "\u0002")))
    f = f.withColumns({"named": named, "calls": calls})
    found = []
    for rank, key, rule in ((0, "sig", "agent-duplicate-cross-file"), (2, "named", "agent-similar-function-name"), (3, "calls", "agent-similar-shape")):
        p = R.first_partner(f.select("file", "pos", "at", key), [key], "file", "at").filter("partner_order is not null")
        found.append(p.select("file", "pos", F.lit(rank).alias("rank"), F.lit(rule).alias("rule"), F.col("partner_order").alias("partner")))
    near = R.near_duplicates(f, "at", "file", "sig_len", "hist", limit=limit).join(f.select("at", "file", "pos", "sig"), "at")
    other = f.select(F.col("at").alias("partner"), F.col("sig").alias("other"))
    near = near.join(other, "partner").filter("sig <> other")
    found.append(near.select("file", "pos", F.lit(1).alias("rank"), F.lit("agent-near-duplicate-function").alias("rule"), "partner"))
    best = R.strongest(found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]), ["file", "pos"], "rank")
    me = f.select("file", "pos", "name", F.col("hist").alias("mine"))
    it = f.select(F.col("at").alias("partner"), F.col("name").alias("its"), F.col("file").alias("there"), F.shiftright("pos", SHIFT).alias("at_line"), F.col("hist").alias("theirs"))
    quoted = lambda c, none: F.coalesce(F.concat(F.lit("`"), c, F.lit("`")), F.lit(none))
    percent = F.round(X.cosine(F.col("mine"), F.col("theirs")) * 100).cast("int").cast("string")
    relation = F.when(F.col("rule") == "agent-duplicate-cross-file", " has the body of ").when(F.col("rule") == "agent-similar-function-name", " shares its name with ")
    relation = relation.when(F.col("rule") == "agent-similar-shape", " makes the calls of ").otherwise(F.concat(F.lit(" is "), percent, F.lit(" % like ")))
    message = F.concat(quoted(F.col("name"), "this function"), relation, quoted(F.col("its"), "one"), F.lit(" in "), "there", F.lit(":"), F.col("at_line").cast("string"))
    return best.join(me, ["file", "pos"]).join(it, "partner").select("file", "rule", "pos", message.alias("message"))


def banned_imports(nodes: DataFrame, prefixes: Sequence[str], catalog: DataFrame, package: str) -> DataFrame:
    """Imports of a forbidden prefix outside the design system's own package, with its component if it has one."""
    dirs = [package, package.rsplit("/", 1)[-1]]
    i = nodes.filter("kind = 'Import'").select("file", "pos", F.col("str").alias("source"))
    i = i.filter(~F.arrays_overlap(F.split("file", "/"), F.array(*map(F.lit, dirs))) & ~F.contains("file", F.lit(f"/{package}/")))
    i = R.first_prefix(i, "source", prefixes).withColumn("leaf", X.component_leaf(F.col("source")))
    i = i.join(R.small(catalog.select("leaf", "component")), "leaf", "left")
    message = F.concat("source", F.lit(" is banned"), F.coalesce(F.concat(F.lit(": use "), "component"), F.lit("")))
    return i.select("file", F.lit("ds-no-banned-import").alias("rule"), "pos", message.alias("message"))


def loose_tsconfig(configs: DataFrame) -> DataFrame:
    """A finding if the first of tsconfig.json and tsconfig.base.json in configs(file, text) isn't strict."""
    rank = F.when(F.col("file") == "tsconfig.json", 0).when(F.col("file") == "tsconfig.base.json", 1)
    first = configs.withColumn("rank", rank).filter("rank is not null").agg(F.min_by(F.struct("file", "text"), "rank").alias("f")).select("f.*").filter("file is not null")
    loose = first.filter(~F.contains(F.regexp_replace("text", r"\s", ""), F.lit('"strict":true')))
    return loose.select("file", F.lit("prefer-strict-tsconfig").alias("rule"), F.lit((1 << SHIFT) | 1).cast("bigint").alias("pos"), F.lit("strict is off").alias("message"))


def finalize(found: DataFrame, files: DataFrame, options: Options) -> DataFrame:
    """(file, rule, pos, message) as diagnostics: with the rule's columns, line, column and source line."""
    strict = options.agent_strict
    dim = found.sparkSession.createDataFrame([(r.id, "error" if strict and r.escalates else r.severity, r.category, r.help) for r in RULES], "rule string, severity string, category string, help string")
    x = found.join(F.broadcast(dim), "rule").withColumns({"line": F.shiftright("pos", SHIFT).cast("int"), "column": F.col("pos").bitwiseAND((1 << SHIFT) - 1).cast("int")})
    # a file's text is split once, for all lines that its findings show
    shown = x.groupBy("file").agg(F.collect_set("line").alias("lines")).join(files.select("file", "text"), "file")
    shown = shown.withColumn("split", F.split("text", "\n")).select("file", F.inline(F.transform("lines", lambda n: F.struct(n.alias("line"), F.try_element_at("split", n).alias("source")))))
    x = x.join(shown, ["file", "line"], "left").withColumn("snippet", F.coalesce(F.rtrim(F.regexp_replace("source", r"\s+$", "")), F.lit("")))
    return x.select("rule", "severity", "category", "message", "help", "file", X.file_context(F.col("file")).alias("file_context"), "line", "column", "snippet")


def external(spark: SparkSession, rows: DataFrame, prefix: str, category: str, root: str = "") -> DataFrame:
    """Findings of another tool, rows(file, line, column, severity, name, message), as diagnostics named prefix/name."""
    file = F.when(F.startswith("file", F.lit(root)), F.substring("file", F.lit(len(root) + 1), F.length("file"))).otherwise(F.col("file")) if root else F.col("file")
    return rows.select(
        F.concat(F.lit(prefix + "/"), "name").alias("rule"), X.external_severity(F.col("severity")).alias("severity"), F.lit(category).alias("category"), "message", F.lit("").alias("help"),
        file.alias("file"), X.file_context(file).alias("file_context"), F.col("line").cast("int").alias("line"), F.col("column").cast("int").alias("column"), F.lit("").alias("snippet"),
    )


def parsed(files: DataFrame) -> DataFrame:
    """Syntax nodes of files, kept for the branches that read them: parsing is the dear part, and lost blocks are parsed again."""
    return ast_nodes(files).persist(StorageLevel.MEMORY_AND_DISK)


def raw_findings(files: DataFrame, options: Options, nodes: DataFrame | None = None) -> DataFrame:
    """(file, rule, pos, message) of all per-file rules that the options ask for."""
    nodes = parsed(files) if nodes is None else nodes
    rules = [r for r in RULES if r.when and options.wants(r)]
    out = fused(nodes, rules)
    for df in joined(nodes, options):
        out = out.unionByName(df)
    if options.wants(BY_ID["agent-max-file-length"]):
        out = out.unionByName(long_files(files))
    return out


def lint(files: DataFrame, options: Options = Options()) -> DataFrame:
    """Diagnostics of files(file, text), each file on its own."""
    return finalize(raw_findings(files, options), files, options)


def scan(files: DataFrame, options: Options = Options(), changes: DataFrame | None = None, configs: DataFrame | None = None, others: Sequence[DataFrame] = (), design_system=None, nodes: DataFrame | None = None) -> DataFrame:
    """Diagnostics of a repository.

    changes(file, start, end) narrows a changed or lines scan before parsing, so
    partners are then looked for among changed files only.  configs are tsconfig
    texts, read in full scans; others are external diagnostics; design_system is
    (prefixes, catalog, package).  Settings are applied last.
    """
    narrowed = options.scope != "full" and changes is not None
    if narrowed:
        files = R.in_files(files, changes)
    nodes = parsed(files) if nodes is None else nodes
    found = raw_findings(files, options, nodes)
    if options.agent or options.agent_strict:
        found = found.unionByName(partners(nodes, options.fuzzy_limit))
    out = finalize(found, files, options)
    for df in others:
        out = out.unionByName(R.in_files(df, changes) if narrowed else df)
    if narrowed and options.scope == "lines":
        out = R.in_lines(out, changes)
    if design_system is not None:
        out = out.unionByName(finalize(banned_imports(nodes, *design_system), files, options))
    if not narrowed and configs is not None:
        out = out.unionByName(finalize(loose_tsconfig(configs), configs, options))
    if options.settings:
        settings = out.sparkSession.createDataFrame(list(options.settings.items()), "rule string, setting string")
        out = R.override(out, settings)
    return out


def score(diagnostics: DataFrame) -> DataFrame:
    """Score of the production findings, and of the rules that are about tests."""
    return R.score(diagnostics, (F.col("file_context") == "production") | F.col("rule").isin(*TEST_RULES))


def counts(files: DataFrame, findings: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """One row: files_scanned, effect_files (they import effect), changed_files, findings and those by category."""
    imports = F.regexp_count("text", F.lit(r"""(?m)(?:from|import)\s*\(?\s*["'](?:effect|effect/[^"']*|@effect/[^"']*)["']""")) > 0
    n = files.agg(F.count("*").alias("files_scanned"), F.count_if(imports).alias("effect_files"))
    changed = F.lit(None).cast("long") if changes is None else F.lit(R.in_files(files, changes).count())
    by = findings.groupBy("category").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("by_category"))
    return n.withColumn("changed_files", changed).join(F.broadcast(by))  # one row each


def report(findings: DataFrame, top: int | None = 3, locations: int = 5) -> tuple[DataFrame, int]:
    """(rules shown, number of rules hidden): by severity, count and id, each with its first places and how many more there are."""
    groups = findings.groupBy("rule").agg(F.min(X.severity_rank(F.col("severity"))).alias("rank"), F.count("*").alias("n"))
    hidden = max(groups.count() - top, 0) if top is not None else 0
    shown, places = R.report_groups(findings, top if top is not None else len(BY_ID) + 100_000, locations)
    places = places.groupBy("rule").agg(F.sort_array(F.collect_list(F.struct("nth", "file", "line", "column", "snippet"))).alias("places"), F.min("severity").alias("severity"), F.min("category").alias("category"), F.min("help").alias("help"))
    return shown.join(places, "rule").withColumn("more", F.col("n") - F.size("places")).orderBy("rank", F.desc("n"), "rule"), hidden


def rules_table(spark: SparkSession) -> DataFrame:
    """The catalog, by severity and id."""
    rows = [(r.id, r.severity, r.category, CATEGORY_LABELS[r.category], r.gate, r.help, r.bad, r.good) for r in RULES]
    df = spark.createDataFrame(rows, "id string, severity string, category string, label string, gate string, help string, bad string, good string")
    return df.orderBy(X.severity_rank(F.col("severity")), "id")


def explain(spark: SparkSession, rule: str) -> DataFrame:
    """One rule's row; empty where there is none of that id."""
    return rules_table(spark).filter(F.col("id") == rule)
