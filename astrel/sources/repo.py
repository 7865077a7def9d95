"""Repositories as tables: the walk, texts, manifests, settings, changes and reports of other tools."""

from __future__ import annotations

import json
import os
import re
import subprocess
import tomllib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrel.functions import scalars as X

WORKSPACES = ("packages", "apps", "libs", "services")
#: Libraries of bare components, by the beginnings of their names.
PRIMITIVES = (
    "@base-ui-components/", "@base-ui/", "@chakra-ui/", "@emotion/", "@headlessui/", "@mui/", "@radix-ui/",
    "class-variance-authority", "styled-components", "tailwind-variants",
)


def _ignore_rule(line: str, base: str) -> tuple[re.Pattern, bool, bool]:
    """(paths it matches, for folders only, whether it keeps them) of a line of the .gitignore in folder base ("" or "a/b/")."""
    keep = line.startswith("!")
    p = line.lstrip("!") if keep else line.removeprefix("\\")
    folders = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and (end := p.find("]", i + 2)) > 0:
            out, i = out + "[" + ("^" + p[i + 2 : end] if p[i + 1] == "!" else p[i + 1 : end]) + "]", end + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    return re.compile(re.escape(base) + ("" if anchored else "(?:.*/)?") + out), folders, keep


def _ignored(rules: list[tuple[re.Pattern, bool, bool]], rel: str, is_dir: bool) -> bool:
    """Whether the last rule that fits a path leaves it out."""
    for pattern, folders, keep in reversed(rules):
        if (is_dir or not folders) and pattern.fullmatch(rel):
            return not keep
    return False


def walk(root: str) -> list[str]:
    """Relative paths of the sources below root: .gitignore honoured, hidden and ignored directories left out."""
    out = []

    def go(folder: Path, rel: str, rules):
        try:
            own = [x.strip() for x in (folder / ".gitignore").read_text().splitlines()]
            rules = rules + [_ignore_rule(x, rel) for x in own if x.strip("!/") and not x.startswith("#")]
        except (OSError, UnicodeDecodeError):
            pass
        for e in sorted(os.scandir(folder), key=lambda e: e.name):
            path = f"{rel}{e.name}"
            if e.name.startswith(".") or _ignored(rules, path, e.is_dir(follow_symlinks=False)):
                continue
            if e.is_dir(follow_symlinks=False):
                if e.name not in X.IGNORED_DIRS:
                    go(Path(e.path), path + "/", rules)
            elif re.search(r"\.(ts|tsx|mts|cts)$", e.name) and not re.search(r"\.d\.(ts|mts|cts)$", e.name):
                out.append(path)

    go(Path(root), "", [])
    return out


def sources(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """files(file, text); unreadable or non-UTF-8 files have a null text.

    The walk runs on the driver; contents are read by the executors, which must see root.
    """
    paths = walk(root) if paths is None else paths
    n = max(1, min(len(paths) // 64, 10_000))
    names = spark.createDataFrame([(p,) for p in paths], "file string").repartition(n)

    def read(batches):
        for b in batches:
            texts = []
            for p in b.column(0).to_pylist():
                try:
                    texts.append(Path(root, p).read_bytes().decode())
                except (OSError, UnicodeDecodeError):
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["file", "text"])

    return names.mapInArrow(read, "file string, text string")


def tables_of_texts(df: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """files(file, text) of any table that holds paths and contents."""
    return df.select(F.col(file).alias("file"), F.col(text).alias("text")).filter(X.is_scannable(F.col("file")) & ~X.in_ignored_dir(F.col("file")))


def manifests(root: str) -> list[tuple[str, dict]]:
    """(path, package.json) of the root and its workspaces, in order."""
    out = []
    places = [Path(root)]
    for w in WORKSPACES:
        places += sorted(p for p in Path(root, w).glob("*") if p.is_dir())
    for p in places:
        try:
            out.append((str(p.relative_to(root)), json.loads((p / "package.json").read_text())))
        except (OSError, ValueError):
            continue
    return out


def effect_major(root: str) -> int | None:
    """Major version of effect: the first manifest and dependency table that states one."""
    for _, m in manifests(root):
        for table in ("dependencies", "devDependencies", "peerDependencies"):
            deps = m.get(table)
            found = re.search(r"\d+", str(deps.get("effect", ""))) if isinstance(deps, dict) else None
            if found:
                return int(found[0])
    return None


def major_of(packages: DataFrame) -> DataFrame:
    """The same over a table packages(rank, text) of manifest texts: one row, major."""
    kind = "struct<dependencies: map<string, string>, devDependencies: map<string, string>, peerDependencies: map<string, string>>"
    p = packages.select("rank", F.from_json("text", kind).alias("p"))
    major = lambda t: X.major_version(F.try_element_at(F.col(f"p.{t}"), F.lit("effect")))
    p = p.withColumn("major", F.coalesce(major("dependencies"), major("devDependencies"), major("peerDependencies")))
    return p.filter("major is not null").agg(F.min_by("major", "rank").alias("major"))


def tsconfigs(spark: SparkSession, root: str) -> DataFrame:
    rows = []
    for name in ("tsconfig.json", "tsconfig.base.json"):
        try:
            rows.append((name, Path(root, name).read_text()))
        except OSError:
            continue
    return spark.createDataFrame(rows, "file string, text string")


def config(root: str, name: str = "astrel.toml") -> dict:
    """Tiers, settings and design system of a repository; defaults where the file is missing or malformed."""
    try:
        raw = tomllib.loads(Path(root, name).read_text())
    except (OSError, ValueError):
        raw = {}
    known = {"off", "false", "none", "info", "warn", "warning", "error"}
    rules = {k: str(v).strip().lower() for k, v in (raw.get("rules") or {}).items() if str(v).strip().lower() in known}
    ds = raw.get("design-system") or {}
    return {"tiers": {k: v for k, v in (raw.get("tiers") or {}).items() if isinstance(v, bool)}, "rules": rules, "package": ds.get("package"), "prefixes": list(ds.get("forbid-import-prefixes") or [])}


def changes_of(lines: DataFrame) -> DataFrame:
    """changes(file, start, end) of the lines(nth, line) of a zero-context diff; deletions change nothing.

    A file's header governs the hunks up to the next one: a running last value over the order of lines.
    """
    from pyspark.sql import Window

    w = Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)  # a diff is one ordered text
    x = lines.withColumn("file", F.last(F.nullif(F.regexp_extract("line", r"^\+\+\+ b/(.*)$", 1), F.lit("")), ignorenulls=True).over(w))
    x = x.filter(F.startswith("line", F.lit("@@"))).withColumn("r", X.hunk_range(F.regexp_extract("line", r"^@@ [^@]* @@", 0)))
    return x.filter("r is not null").select("file", "r.start", "r.end")


def _git(root: str, *args: str) -> str | None:
    got = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
    return got.stdout if got.returncode == 0 else None


def git_base(root: str, ref: str | None = None) -> str | None:
    """What to compare with: the merge base with a ref, else with the first main branch there is."""
    for name in [ref] if ref else ["origin/main", "origin/master", "main", "master"]:
        if (got := _git(root, "merge-base", "HEAD", name)) is not None:
            return got.strip()
    return None


def git_changes(spark: SparkSession, root: str, base: str, lines: bool) -> DataFrame:
    """Changed files, with their changed lines if asked for; untracked files are changed as a whole."""
    rows = [(f, None, None) for f in (_git(root, "ls-files", "--others", "--exclude-standard") or "").splitlines()]
    whole = spark.createDataFrame(rows, "file string, start int, end int")
    if not lines:
        names = (_git(root, "diff", "--name-only", "--diff-filter=ACMR", base) or "").splitlines()
        return whole.unionByName(spark.createDataFrame([(f, None, None) for f in names], "file string, start int, end int"))
    text = _git(root, "diff", "-U0", "--diff-filter=ACMR", base) or ""
    return whole.unionByName(changes_of(spark.createDataFrame(list(enumerate(text.splitlines())), "nth bigint, line string")))


def report(spark: SparkSession, path: str, react: bool = False) -> DataFrame:
    """Findings in a JSON report of another tool, as (file, line, column, severity, name, message)."""
    item = "filePath string, rule string, severity string, message string, title string, line int, column int" if react else "file string, line int, column int, severity string, name string, message string"
    d = spark.read.schema(f"diagnostics array<struct<{', '.join(x.replace(' ', ': ', 1) for x in item.split(', '))}>>").option("multiLine", True).json(path).select(F.inline("diagnostics"))
    return d.select(F.col("filePath").alias("file"), "line", "column", "severity", F.col("rule").alias("name"), F.coalesce("title", "message").alias("message")) if react else d


def exports(spark: SparkSession, text: str) -> DataFrame:
    """Components that a package.json exports: (leaf, component)."""
    d = spark.createDataFrame([(text,)], "text string").select(F.explode(F.json_object_keys(F.get_json_object("text", "$.exports"))).alias("key"))
    return d.filter("key rlike '^\\\\./[^*]+$'").select(F.regexp_extract("key", r"([^/]+)$", 1).alias("leaf"), F.regexp_extract("key", r"([^/]+)$", 1).alias("component"))


def packages(root: str, depth: int = 2) -> list[tuple[int, str, int, list[str]]]:
    """(number, name, exported components, dependencies) of the manifests at most so many folders below root, by path."""
    out = []
    folders = [Path(root)]
    for level in range(depth + 1):
        below = []
        for f in folders:
            try:
                m = json.loads((f / "package.json").read_text())
            except (OSError, ValueError):
                m = None
            if isinstance(m, dict) and isinstance(m.get("name"), str):
                exports = m.get("exports")
                n = sum(1 for k in exports if re.fullmatch(r"\./[^*]+", k)) if isinstance(exports, dict) else 0
                tables = [m.get(t) for t in ("dependencies", "devDependencies", "peerDependencies")]
                out.append((str(f), m["name"], n, sorted({d for t in tables if isinstance(t, dict) for d in t})))
            if level < depth:
                below += [p for p in f.iterdir() if p.is_dir() and not p.name.startswith(".") and p.name not in X.IGNORED_DIRS]
        folders = sorted(below)
    return [(i, *x[1:]) for i, x in enumerate(sorted(out))]


PACKAGES = "nth int, name string, n_exports int, deps array<string>"


def detect_design_system(packages: DataFrame) -> DataFrame:
    """The likeliest design system of packages(nth, name, n_exports, deps): most exports, the last among equals."""
    low = F.lower("name")
    ui = F.endswith(low, F.lit("/ui")) | F.endswith(low, F.lit("-ui")) | F.contains(low, F.lit("design-system")) | F.contains(low, F.lit("/components"))
    wraps = F.exists("deps", _any_prefix)
    good = packages.filter((F.col("n_exports") >= 3) & (ui | wraps))
    return good.agg(F.max_by("name", F.struct("n_exports", "nth")).alias("name")).filter("name is not null")


def detect_forbidden_prefixes(packages: DataFrame) -> DataFrame:
    """The PRIMITIVES that a package depends on: (prefix), ascending."""
    deps = packages.select(F.explode("deps").alias("dep")).distinct()
    known = packages.sparkSession.createDataFrame([(p,) for p in PRIMITIVES], "prefix string")
    return deps.join(F.broadcast(known), F.startswith("dep", F.col("prefix"))).select("prefix").distinct().orderBy("prefix")


def _any_prefix(c):
    out = F.startswith(c, F.lit(PRIMITIVES[0]))
    for p in PRIMITIVES[1:]:
        out = out | F.startswith(c, F.lit(p))
    return out
