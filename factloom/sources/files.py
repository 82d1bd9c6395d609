"""Scans of source trees and of the files that describe a project.

File contents are read by Spark's own readers, so any store that Spark reaches will do; a project's few configuration
files are read through them as well and parsed on the driver.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.functions.scalar import SOURCE_EXTENSIONS

# fixed values
IGNORED_DIRECTORIES = (".cache", ".devenv", ".git", ".next", ".nuxt", ".turbo", "build", "coverage", "dist", "node_modules")
ENTRY_FIELDS = ("main", "module", "types", "typings", "browser")
DEPENDENCY_FIELDS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
EXTENSIONS = {"effect": ("effect",), "react": ("react",), "shadcn": ("shadcn", "shadcn-ui")}
BUILD_TOOLS = {"rspack": ("@rspack/core", "@rspack/cli", "@rspack/dev-server"), "rsbuild": ("@rsbuild/core",)}


def wanted(path: Column, ignored: tuple[str, ...] = IGNORED_DIRECTORIES, hidden: tuple[str, ...] = ()) -> Column:
    """Source files outside ignored and hidden directories (unless named) that no tool has written."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    extension = F.lit(False)
    for e in SOURCE_EXTENSIONS:
        extension = extension | F.lower(path).endswith(e)
    seen = F.forall(parts, lambda p: ~p.isin(*ignored) & (~p.startswith(".") | p.isin("", ".", "..", *hidden)))
    written = path.rlike("(^|/)tests/fixtures/parser-compact/(expected|real)-output/") & F.contains(path, F.lit("/typescript/"))
    return extension & seen & ~written


def scan(spark: SparkSession, root: str, scopes: list[str] | None = None, ignored: tuple[str, ...] = IGNORED_DIRECTORIES, hidden: tuple[str, ...] = ()) -> DataFrame:
    """source_files below ``root`` (path relative to it, content, mtime_ms), those of ``scopes`` if any are given. The path predicate runs before contents are read into strings."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^[a-z]+://?(?=/)", "", root).rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*(?=/)", ""), "^" + re.escape(base) + "/", "")
    out = raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"), (F.unix_millis("modificationTime")).alias("mtime_ms")).where(wanted(F.col("path"), ignored, hidden))
    if scopes:
        inside = F.lit(False)
        for s in scopes:
            inside = inside | (F.col("path") == s) | F.col("path").startswith(s.rstrip("/") + "/") | F.lit(s in ("", "."))
        out = out.where(inside)
    return out


def select_files(files: DataFrame, names: list[str], fallback_roots: list[str]) -> DataFrame:
    """The listed files if any are listed, else those below the roots."""
    if names:
        listed = files.sparkSession.createDataFrame([(n,) for n in names], "path string")
        return files.join(listed.distinct(), "path", "left_semi")
    inside = F.lit(False)
    for r in fallback_roots:
        inside = inside | F.col("path").startswith(r.rstrip("/") + "/")
    return files.where(inside)


def without_json_comments(text: str) -> str:
    """JSON with comments and trailing commas as plain JSON."""
    out = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(\s*[}\]])', lambda m: m[1] or m[2], out, flags=re.S)


@dataclass
class Config:
    """A compiler configuration: options, files, references, aliases; a file that can't be read leaves a diagnostic."""

    options: dict = field(default_factory=dict)
    include: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    references: list[str] = field(default_factory=list)
    aliases: dict[str, list[str]] = field(default_factory=dict)
    diagnostics: list[str] = field(default_factory=list)


def parse_config(text: str | None) -> Config:
    if text is None:
        return Config()
    try:
        data = json.loads(without_json_comments(text))
        options = data.get("compilerOptions") or {}
        return Config(options, list(data.get("include") or []), list(data.get("files") or []), [r["path"] for r in data.get("references") or [] if isinstance(r, dict) and "path" in r], {k: list(v) for k, v in (options.get("paths") or {}).items()})
    except (ValueError, AttributeError, TypeError) as fault:
        return Config(diagnostics=[f"the configuration can't be read: {fault}"])


def _targets(subpath: str, value: object, conditions: list[str]) -> list[dict]:
    """Conditional targets, flattened: each with the conditions on its way."""
    if isinstance(value, str):
        return [{"subpath": subpath, "target": value, "conditions": conditions}]
    if isinstance(value, list):
        return [t for v in value for t in _targets(subpath, v, conditions)]
    if isinstance(value, dict):
        return [t for k, v in value.items() for t in _targets(subpath, v, [*conditions, k])]
    return []


@dataclass
class Manifest:
    name: str | None = None
    entries: list[dict] = field(default_factory=list)
    scripts: list[dict] = field(default_factory=list)
    dependencies: list[dict] = field(default_factory=list)
    workspaces: list[str] = field(default_factory=list)
    extensions: list[dict] = field(default_factory=list)
    build_tools: list[dict] = field(default_factory=list)
    diagnostics: list[str] = field(default_factory=list)


def parse_manifest(text: str | None) -> Manifest:
    """Entries, exports, imports, bins, scripts, dependencies, workspaces, extensions and build tools of a package manifest; a malformed one is a diagnostic."""
    if text is None:
        return Manifest()
    try:
        data = json.loads(text)
        if not isinstance(data, dict):
            raise ValueError("not an object")
    except ValueError as fault:
        return Manifest(diagnostics=[f"the manifest can't be read: {fault}"])
    entries = [{"subpath": ".", "target": data[f], "conditions": [], "source": f} for f in ENTRY_FIELDS if isinstance(data.get(f), str)]
    for key in ("exports", "imports"):
        value = data.get(key)
        sub = value if isinstance(value, dict) and all(k.startswith((".", "#")) for k in value) else {".": value} if value is not None else {}
        entries += [t | {"source": key} for k, v in sub.items() for t in _targets(k, v, [])]
    bins = data.get("bin")
    bins = {data.get("name") or ".": bins} if isinstance(bins, str) else bins if isinstance(bins, dict) else {}
    entries += [{"subpath": k, "target": v, "conditions": [], "source": "bin"} for k, v in bins.items() if isinstance(v, str)]
    table = lambda k: data.get(k) if isinstance(data.get(k), dict) else {}
    scripts = [{"name": k, "command": v} for k, v in table("scripts").items() if isinstance(v, str)]
    deps = [{"name": n, "version_range": v, "source": f} for f in DEPENDENCY_FIELDS for n, v in table(f).items() if isinstance(v, str)]
    spaces = data.get("workspaces")
    spaces = spaces.get("packages") if isinstance(spaces, dict) else spaces
    known = {d["name"] for d in deps}
    extensions = [{"name": k, "activation": "dependency", "installed": True} for k, names in EXTENSIONS.items() if known & set(names)]
    tools = [{"name": k, "has_script": any(re.search(rf"\b{k}\b", s["command"]) for s in scripts)} for k, names in BUILD_TOOLS.items() if known & set(names)]
    return Manifest(data.get("name"), entries, scripts, deps, [w for w in spaces or [] if isinstance(w, str)] if isinstance(spaces, list) else [], extensions, tools)


def yaml_packages(text: str) -> list[str]:
    """The items of the ``packages:`` list of a workspace file."""
    out, inside = [], False
    for line in text.splitlines():
        if re.match(r"^packages\s*:", line):
            inside = True
        elif inside and (m := re.match(r"""^\s*-\s*["']?([^"'#]+?)["']?\s*(?:#.*)?$""", line)):
            out.append(m[1].strip())
        elif inside and re.match(r"^\S", line) and line.strip():
            break
    return out


def glob_pattern(pattern: str) -> str | None:
    """A workspace pattern as a regular expression over directories: a star within a segment, two for all below; none for negated and absolute ones."""
    p = pattern.strip().removeprefix("./").rstrip("/")
    if p.startswith(("!", "/")) or not p:
        return None
    parts = [".+" if s == "**" else "".join("[^/]*" if c == "*" else re.escape(c) for c in s) for s in p.split("/")]
    return "^" + "/".join(parts) + "$"


def expand_workspaces(directories: DataFrame, patterns: list[str]) -> DataFrame:
    """(path, pattern): directories (column path) that a pattern names, each with its first pattern."""
    first = F.lit(None).cast("string")
    for p in reversed(patterns):
        if rx := glob_pattern(p):
            first = F.when(F.col("path").rlike(rx), F.lit(p)).otherwise(first)
    return directories.select("path").distinct().withColumn("pattern", first).where("pattern IS NOT NULL")


def project_scopes(workspaces: list[str], source_dirs: tuple[str, ...] = ("src",), test_dirs: tuple[str, ...] = ("tests", "test")) -> tuple[list[str], list[str]]:
    """Source and test directories of the root and of each workspace, distinct and sorted."""
    roots = ["", *workspaces]
    under = lambda dirs: sorted({f"{r}/{d}".lstrip("/") for r in roots for d in dirs})
    return under(source_dirs), under(test_dirs)


def discovery_config(text: str, base: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """The string lists of the [discovery] table, appended to ``base`` without repeating."""
    out = {k: list(v) for k, v in (base or {}).items()}
    for key, value in tomllib.loads(text).get("discovery", {}).items():
        if isinstance(value, list) and all(isinstance(v, str) for v in value):
            out[key] = list(dict.fromkeys([*out.get(key, []), *value]))
    return out


def locked_version(text: str | None, name: str) -> str | None:
    """A package's installed version in a lock file."""
    try:
        data = json.loads(text or "{}")
    except ValueError:
        return None
    return (data.get("packages", {}).get(f"node_modules/{name}") or data.get("dependencies", {}).get(name) or {}).get("version")


def schema_leaves(path: str, text: str) -> list[tuple[str, str, str, str | None]]:
    """(path, pointer, key, value) of every key of a JSON document; value only of scalars."""
    escape = lambda k: k.replace("~", "~0").replace("/", "~1")
    out: list[tuple[str, str, str, str | None]] = []

    def walk(value: object, pointer: str) -> None:
        pairs = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        for k, v in pairs:
            at = f"{pointer}/{escape(str(k))}"
            out.append((path, at, str(k), v if isinstance(v, str) else None if isinstance(v, dict | list) else json.dumps(v)))
            walk(v, at)

    try:
        walk(json.loads(text), "")
    except ValueError:
        return []
    return out


def all_schema_leaves(documents: DataFrame) -> DataFrame:
    """``schema_leaves`` of every JSON document (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for r in schema_leaves(p, c or "")]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in columns], ["path", "pointer", "key", "value"])

    return documents.select("path", "content").mapInArrow(run, "path string, pointer string, key string, value string")


def plain_json(text: Column) -> Column:
    """``without_json_comments`` as a column."""
    bare = F.regexp_replace(text, r'(?s)("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', "$1")
    return F.regexp_replace(bare, r'(?s)("(?:\\.|[^"\\])*")|,(\s*[}\]])', "$1$2")


def workspace_packages(documents: DataFrame, patterns: list[str]) -> DataFrame:
    """(path, name, pattern) of the directories with a manifest that a workspace pattern names."""
    m = documents.where(F.col("path").endswith("/package.json")).select(S.dirname(F.col("path")).alias("path"), F.get_json_object("content", "$.name").alias("name"))
    return m.join(expand_workspaces(m, patterns), "path").select("path", "name", "pattern")


def reference_packages(documents: DataFrame, references: list[str]) -> DataFrame:
    """(path, name, config_path, composite, declaration) of a configuration's references: a directory, or the configuration in it. The options are null where the configuration has none or can't be read."""
    spark = documents.sparkSession
    named = [(r.removeprefix("./").rstrip("/"),) for r in references]
    asked = spark.createDataFrame(named, "path string").withColumn("path", F.regexp_replace("path", r"/[^/]*\.json$", "")).distinct()
    own = lambda file, *columns: documents.where(F.col("path").endswith(f"/{file}")).select(S.dirname(F.col("path")).alias("path"), *columns)
    options = F.get_json_object(plain_json(F.col("content")), "$.compilerOptions")
    on = lambda name: F.when(options.isNotNull(), F.coalesce(F.get_json_object(options, f"$.{name}") == "true", F.lit(False))).alias(name)
    configs = own("tsconfig.json", F.col("path").alias("config_path"), on("composite"), on("declaration"))
    return asked.join(own("package.json", F.get_json_object("content", "$.name").alias("name")), "path", "left").join(configs, "path", "left").select("path", "name", "config_path", "composite", "declaration")
