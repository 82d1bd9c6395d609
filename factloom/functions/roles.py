"""Ordered classifications: module role and layer, import resolution, workspace surface, test paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import scalar as S

# fixed values
CONFIG_STEMS = ("eslint.config", "jest.config", "next.config", "playwright.config", "postcss.config", "rollup.config", "tailwind.config", "tsup.config", "vite.config", "vitest.config", "webpack.config")
MODULE_EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")


def _named(stems: tuple[str, ...], prefix: str = "^") -> str:
    """Names of these stems with any module extension."""
    join = lambda x: "|".join(re.escape(s) for s in x)
    return f"{prefix}({join(stems)})({join(MODULE_EXTENSIONS)})$"


_CONFIG, _TEST, _MAIN, _INDEX = _named(CONFIG_STEMS), _named((".test", ".spec"), ""), _named(("main",)), _named(("index",))


def inside_any(path: Column, roots: list[str]) -> Column:
    """Whether the path is one of the roots or lies below one."""
    out = F.lit(False)
    for r in roots:
        out = out | (path == r) | path.startswith(r.rstrip("/") + "/")
    return out


def module_role(path: Column, is_declaration: Column, source_roots: list[str], test_roots: list[str], entry_paths: list[str] | None = None) -> Column:
    """declaration, test, config, entrypoint, facade, source or unknown: the first that fits."""
    name, parent = S.basename(path), S.basename(S.dirname(path))
    facade = name.rlike(_INDEX)
    return (
        F.when(is_declaration, "declaration").when(inside_any(path, test_roots) | name.rlike(_TEST), "test").when(name.rlike(_CONFIG), "config")
        .when(name.rlike(_MAIN) | (parent == "bin") | path.isin(*(entry_paths or [""])), "entrypoint").when(facade, "facade").when(inside_any(path, source_roots), "source").otherwise("unknown")
    )


def module_layer(path: Column, role: Column) -> Column:
    """test and config by role; else by the path below src."""
    area = lambda a: (path == f"src/{a}.ts") | path.startswith(f"src/{a}/")
    return (
        F.when(role.isin("test", "config"), role).when(area("parser"), "parser").when(area("reasoning"), "reasoning").when(area("rules"), "policy").when(path == "src/render.ts", "render")
        .when(area("model") | path.startswith("src/") & (S.basename(path) == "model.ts"), "model").when(path.startswith("src/"), "harness").otherwise("unknown")
    )


def syntax_role(is_test: Column, has_react: Column, has_effect: Column, is_config: Column) -> Column:
    """The smaller model's role."""
    return F.when(is_test, "test").when(has_react, "react").when(has_effect, "effect").when(is_config, "config").otherwise("structural")


def matches_alias(specifier: Column, patterns: list[str]) -> Column:
    """Exact, or prefix and suffix around a pattern's first star."""
    out = F.lit(False)
    for p in patterns:
        head, star, tail = p.partition("*")
        out = out | ((specifier.startswith(head) & specifier.endswith(tail)) if star else (specifier == p))
    return out


def import_resolution(specifier: Column, target: Column, aliases: list[str], root: str = "") -> Column:
    """unresolved, external, relative, package-import or path-alias, from the specifier and the resolved path, if any."""
    alias = matches_alias(specifier, aliases)
    inside = target.startswith(root) if root else ~target.startswith("/")
    return (
        F.when(target.isNull(), F.when(specifier.startswith(".") | specifier.startswith("#") | alias, "unresolved").otherwise("external"))
        .when(target.rlike("(^|/)node_modules/"), "external").when(specifier.startswith("."), "relative").when(specifier.startswith("#"), "package-import")
        .when(inside, F.when(alias, "path-alias").otherwise("package-import")).otherwise("external")
    )


def workspace_surface(path: Column) -> Column:
    below = lambda d: (path == d) | path.startswith(f"{d}/")
    return F.when(S.is_test_path(path) | F.contains(path, F.lit("/fixtures/")), "test").when(below("docs"), "docs").when(below("playground"), "demo").otherwise("source")


def workspace_score(path: Column, pattern: Column, imported: Column) -> Column:
    """Lower is better: the surface's score, 10 for a pattern of tests or all below, 5 less if the project imports it."""
    surface = workspace_surface(path)
    base = F.when(surface == "source", 0).when(surface == "docs", 10).when(surface == "demo", 20).otherwise(40)
    return base + F.when((F.contains(pattern, F.lit("__tests__")) | F.contains(pattern, F.lit("**"))), 10).otherwise(0) - F.when(imported, 5).otherwise(0)
