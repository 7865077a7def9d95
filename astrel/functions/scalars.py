"""Scalar functions of the engine as Column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Severities from worst to mildest.
SEVERITIES = ("error", "warn", "info")
TEST_SEGMENTS = ("test", "tests", "__tests__", "e2e")
IGNORED_DIRS = ("node_modules", ".git", "dist", "build", "coverage", ".next", ".turbo")
SECRETS = r"secret|password|passwd|token|apikey|privatekey|credential"


def line_count(text: Column) -> Column:
    """Lines of a text: a closing line break adds none, the empty text has none."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (breaks + F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("int")


def file_context(path: Column, segments=TEST_SEGMENTS) -> Column:
    """test where a path segment or a part of the name says so, else production."""
    low = F.lower(path)
    named = F.arrays_overlap(F.split(low, r"[/\\]"), F.array(*map(F.lit, segments)))
    marked = low.rlike(r"\.test\.|\.spec\.|-test\.")
    return F.when(named | marked, "test").otherwise("production")


def is_scannable(path: Column) -> Column:
    """TypeScript sources other than declaration files."""
    return path.rlike(r"\.(ts|tsx|mts|cts)$") & ~path.rlike(r"\.d\.(ts|mts|cts)$")


def in_ignored_dir(path: Column, dirs=IGNORED_DIRS) -> Column:
    """Whether a directory of the path is one that scans leave out."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: s.isin(*dirs))


def severity_rank(severity: Column) -> Column:
    """0 for error, 1 for warn, 2 for info and anything else."""
    return F.when(severity == "error", 0).when(severity == "warn", 1).otherwise(2)


def external_severity(value: Column) -> Column:
    """Severity of a finding of another tool: error and warnings are known, the rest is info."""
    v = F.lower(F.trim(value))
    return F.when(v == "error", "error").when(v.isin("warn", "warning"), "warn").otherwise("info")


def setting(value: Column) -> Column:
    """A rule's setting: off, info, warn or error; null where the text is none of them."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("off", "false", "none"), "off").when(v == "info", "info").when(v.isin("warn", "warning"), "warn").when(v == "error", "error")


def major_version(spec: Column) -> Column:
    """First run of digits of a version specification, null without one."""
    return F.nullif(F.regexp_extract(spec, r"(\d+)", 1), F.lit("")).try_cast("int")


def names_secret(name: Column) -> Column:
    """Whether a configuration key, reduced to letters and digits, names a secret."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "").rlike(SECRETS)


def opens_transaction(sql: Column) -> Column:
    """Whether a statement begins, commits or rolls back a transaction."""
    return F.upper(F.trim(sql)).rlike("^(BEGIN|COMMIT|ROLLBACK)")


def hunk_range(header: Column) -> Column:
    """struct(start, end) of a zero-context hunk header; null where it only deletes."""
    start = F.regexp_extract(header, r"\+(\d+)(?:,(\d+))?", 1)
    count = F.regexp_extract(header, r"\+(\d+)(?:,(\d+))?", 2)
    n = F.when(count == "", 1).otherwise(count.try_cast("int"))
    s = start.try_cast("int")
    return F.when(s.isNotNull() & (n > 0), F.struct(s.alias("start"), (s + n - 1).alias("end")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, 0 where either is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def component_leaf(source: Column) -> Column:
    """Last segment of an import source without leading react- prefixes."""
    return F.regexp_replace(F.element_at(F.split(source, "/"), -1), "^(react-)+", "")


def score_label(score: Column) -> Column:
    return F.when(score >= 75, "Great").when(score >= 50, "Needs work").otherwise("Critical")


def normal_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def score_bar(score: Column) -> Column:
    """Thirty cells, filled in proportion to the score."""
    full = F.floor(score * 30 / 100).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), 30 - full))


@F.arrow_udf(StringType())
def fnv1a(values: pa.Array) -> pa.Array:
    """64-bit FNV-1a of UTF-8 text as 16 hex digits; wraps around, which JVM arithmetic in ANSI mode may not."""
    out = []
    for v in values.to_pylist():
        if v is None:
            out.append(None)
            continue
        h = 0xCBF29CE484222325
        for b in v.encode():
            h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        out.append(f"{h:016x}")
    return pa.array(out, pa.string())
