"""python -m astrel.cli scan|rules|explain|init ...: the engine over a directory."""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrel.functions import scalars as X
from astrel.operators import relational as R
from astrel.plans import engine
from astrel.plans.catalog import CATEGORY_LABELS
from astrel.sources import repo


def scan_dir(spark: SparkSession, root: str, scope: str = "full", base: str | None = None, migrate: bool = False, reports=(), **tiers) -> dict:
    """diagnostics, score and report of a directory: settings, versions and changes are read from it; reports are diagnostics of other tools."""
    c = repo.config(root)
    t = {k: bool(tiers.get(k) or c["tiers"].get(k)) for k in ("agent", "agent_strict", "adopt")}
    options = engine.Options(v4=migrate or repo.effect_major(root) == 4, scope=scope, settings=c["rules"], **t)
    changes = None
    if scope != "full":
        at = repo.git_base(root, base)
        if at is None:
            raise ValueError("no base to compare with")
        changes = repo.git_changes(spark, root, at, scope == "lines")
    walked = repo.sources(spark, root)
    files = walked.filter("text is not null")
    ds = None
    if c["package"] and c["prefixes"]:
        text = next((Path(root, p, "package.json").read_text() for p, m in repo.manifests(root) if m.get("name") == c["package"]), "{}")
        ds = (c["prefixes"], repo.exports(spark, text), c["package"])
    nodes = engine.parsed(files if changes is None else R.in_files(files, changes))
    found = engine.scan(files, options, changes, repo.tsconfigs(spark, root), [x for x in reports if x is not None], ds, nodes=nodes).persist()
    counts = engine.counts(walked, found, changes)
    summary = engine.score(found).join(F.broadcast(counts)).withColumn("bar", X.score_bar(F.col("score")))  # one row each
    label = ", ".join([scope, *(["v4"] if options.v4 else []), *(k for k, on in t.items() if on)])
    return {"diagnostics": R.sorted_findings(found, "column"), "score": summary, "found": found, "nodes": nodes, "any_error": R.any_error(found), "label": label}


def init(spark: SparkSession, root: str) -> str:
    """Settings for a repository: its design system and the libraries that only this may import, as its manifests show them."""
    found = spark.createDataFrame(repo.packages(root), repo.PACKAGES)
    system = repo.detect_design_system(found).collect()
    prefixes = [r["prefix"] for r in repo.detect_forbidden_prefixes(found).collect()]
    out = "[tiers]\nagent = false\nadopt = false\n\n[rules]\n"
    if system and prefixes:
        out += f"\n[design-system]\npackage = {json.dumps(system[0]['name'])}\nforbid-import-prefixes = {json.dumps(prefixes)}\n"
    return out


def plural(n: int, word: str) -> str:
    return f"{n:,} {word}" + ("" if n == 1 else "s")


def show(out: dict, verbose: bool, locations: int, seconds: float) -> None:
    """The report for a terminal."""
    top = out["score"].first()
    print(f"{top['bar']} {top['score']} {top['label']}")
    print("  ".join(f"{CATEGORY_LABELS.get(c, c)}: {n}" for c, n in sorted((top["by_category"] or {}).items())))
    groups, hidden = engine.report(out["found"], None if verbose else 3, locations)
    for g in groups.collect():
        print(f"\n{g['severity']} {g['rule']} ({CATEGORY_LABELS.get(g['category'], g['category'])}): {plural(g['n'], 'finding')}\n  {g['help']}")
        for p in g["places"]:
            print(f"  {p['file']}:{p['line']}:{p['column']}  {p['snippet'].strip()}")
        if g["more"]:
            print(f"  and {g['more']} more")
    if hidden:
        print(f"\n{plural(hidden, 'further rule')}; --verbose shows all")
    print(f"\n{plural(top['files_scanned'], 'file')} ({top['effect_files']} with effect) [{out['label']}], {plural(top['findings'], 'finding')}, {seconds:.1f} s")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="astrel")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("root", nargs="?", default=".")
    for flag in ("--json", "--agent", "--agent-strict", "--adopt", "--migrate", "--verbose"):
        s.add_argument(flag, action="store_true")
    s.add_argument("--scope", choices=("full", "changed", "lines"), default="full")
    s.add_argument("--base")
    s.add_argument("--locations", type=int, default=5)
    s.add_argument("--deep", help="JSON report of the type-aware tool")
    s.add_argument("--react", help="JSON report of the React tool")
    e = sub.add_parser("explain")
    e.add_argument("rule")
    r = sub.add_parser("rules")
    r.add_argument("--json", action="store_true")
    i = sub.add_parser("init")
    i.add_argument("root", nargs="?", default=".")
    i.add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    if a.command == "init":
        path = Path(a.root, "astrel.toml")
        if path.exists() and not a.force:
            print(f"{path} exists", file=sys.stderr)
            return 1
        path.write_text(init(SparkSession.builder.appName("astrel").getOrCreate(), a.root))
        return 0
    spark = SparkSession.builder.appName("astrel").getOrCreate()
    if a.command in ("explain", "rules"):
        df = engine.explain(spark, a.rule) if a.command == "explain" else engine.rules_table(spark)
        got = [x[0] for x in df.select(F.to_json(F.struct("*"))).collect()]
        print("\n".join(got))
        return 0 if got else 2
    began, at = time.time(), str(Path(a.root).resolve()) + "/"
    others = [engine.external(spark, repo.report(spark, path, react), prefix, prefix, at) if path else None for path, react, prefix in ((a.deep, False, "deep"), (a.react, True, "react"))]
    out = scan_dir(spark, a.root, a.scope, a.base, a.migrate, others, agent=a.agent, agent_strict=a.agent_strict, adopt=a.adopt)
    if a.json:  # row by row: the driver never holds all findings
        sys.stdout.write(out["score"].select(F.to_json(F.struct("*"))).first()[0][:-1] + f', "duration_ms": {round(1000 * (time.time() - began))}, "diagnostics": [')
        for i, r in enumerate(out["diagnostics"].select(F.to_json(F.struct("*"))).toLocalIterator()):
            sys.stdout.write(("," if i else "") + r[0])
        sys.stdout.write("]}\n")
    else:
        show(out, a.verbose, a.locations, time.time() - began)
    failed = a.agent_strict and out["any_error"].first()[0]
    out["found"].unpersist()
    out["nodes"].unpersist()
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
