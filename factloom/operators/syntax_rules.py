"""Rules of the smaller model: they read module texts, items and function rows, one finding each. Ids that the larger model also uses mean something else here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import scalar as S

# fixed values
BUCKETS = ("utils", "common", "helpers", "shared", "misc", "lib", "core", "types")

RULES = {
    "TS-SYN-R001": ("Error", "The module is valid"), "TS-AGENT-PROJECT-003": ("Error", "The index only re-exports"), "AGENT-TS-R001": ("Warning", "A comment opens the module"), "AGENT-TS-R003": ("Warning", "No generic bucket"),
    "AGENT-TS-R006": ("Warning", "One boolean parameter"), "AGENT-TS-R008": ("Warning", "Shallow nesting"), "AGENT-TS-R009": ("Warning", "Few statements"), "AGENT-TS-R012": ("Warning", "Few exports"),
    "TS-REACT-R001": ("Error", "No browser API in components"), "TS-REACT-R002": ("Warning", "Hooks apart from JSX"), "TS-REACT-R003": ("Warning", "Hooks return objects"), "TS-REACT-R004": ("Warning", "One boolean prop"), "TS-REACT-R005": ("Warning", "Small contexts"), "TS-REACT-R006": ("Warning", "Short effects"),
    "TS-EFFECT-R001": ("Warning", "Tags and layers apart"), "TS-EFFECT-R002": ("Error", "No environment reads"), "TS-EFFECT-R003": ("Error", "No test imports"), "TS-EFFECT-R004": ("Warning", "Typed errors"), "TS-EFFECT-R006": ("Warning", "Services apart from runtimes"), "TS-EFFECT-R007": ("Warning", "No promise exports"),
    "R004": ("Warning", "Nesting"), "R005": ("Warning", "Branches"), "R007": ("Warning", "Parameters"), "R010": ("Warning", "Tuple return"), "R011": ("Warning", "any"),
}


def _pick(df: DataFrame, rule: str, where: Column, line: Column | None = None) -> DataFrame:
    severity, title = RULES[rule]
    return df.where(where).select(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), "path", (line if line is not None else F.lit(1)).cast("int").alias("line"), F.lit(title).alias("summary"))


def module_findings(modules: DataFrame) -> DataFrame:
    """Of (path, content, is_valid, export_kinds): findings that the text and the exports decide."""
    text, name = F.col("content"), S.basename(F.col("path"))
    component = F.col("path").endswith(".tsx")
    own = F.exists("export_kinds", lambda k: ~k.isin("star-reexport", "named-reexport", "namespace-reexport"))
    first_index = modules.where(S.stem(name) == "index").orderBy("path").limit(1)
    effect = text.rlike(r"""from\s+["']effect(/[^"']*)?["']""")
    checks = [
        ("TS-SYN-R001", ~F.col("is_valid")),
        ("AGENT-TS-R001", ~F.substring(text, 1, 500).rlike(r"/\*\*|^\s*//")),
        ("AGENT-TS-R003", S.basename(S.dirname(F.col("path"))).isin(*BUCKETS)),
        ("AGENT-TS-R012", F.size(F.filter("export_kinds", lambda k: k != "star-reexport")) > 12),
        ("TS-REACT-R001", component & text.rlike(r"\b(window|document|localStorage|sessionStorage)\.")),
        ("TS-REACT-R002", component & text.rlike(r"\bfunction\s+use[A-Z]|\bconst\s+use[A-Z]\w*\s*=") & text.rlike(r"<[A-Za-z][\w.]*[\s/>]")),
        ("TS-REACT-R003", text.rlike(r"(?s)\bfunction\s+use[A-Z]\w*[^{]*\{.*?\breturn\s*\[")),
        ("TS-EFFECT-R001", effect & text.rlike(r"Context\.(Tag|GenericTag)") & text.rlike(r"Layer\.\w+\(")),
        ("TS-EFFECT-R002", effect & text.rlike(r"\bprocess\.env\b")),
        ("TS-EFFECT-R003", effect & text.rlike(r"""from\s+["'](vitest|jest|@effect/vitest|node:test)["']""")),
        ("TS-EFFECT-R004", effect & text.rlike(r"Effect<[^<>]*,\s*(any|unknown)\b")),
        ("TS-EFFECT-R006", effect & text.rlike(r"Context\.(Tag|GenericTag)") & text.rlike(r"Effect\.run\w+\(")),
        ("TS-EFFECT-R007", effect & text.rlike(r"\bexport\s+(async\s+function|(const|function)\s+\w+[^=\n{]*Promise<)")),
    ]
    each = [_pick(modules, rule, where) for rule, where in checks]
    return reduce(DataFrame.unionAll, [*each, _pick(first_index, "TS-AGENT-PROJECT-003", own)])


def function_findings(functions: DataFrame) -> DataFrame:
    """Of (path, line, exported, n_params, n_boolean_params, max_nesting, statements, branches, uses_any, returns): findings that a function's shape decides; ids R0xx hold only for exported ones."""
    exported = F.col("exported")
    checks = [
        ("AGENT-TS-R006", F.col("n_boolean_params") > 1), ("AGENT-TS-R008", F.col("max_nesting") > 4), ("AGENT-TS-R009", F.col("statements") > 30),
        ("R007", exported & (F.col("n_params") > 3)), ("R004", exported & (F.col("max_nesting") > 4)), ("R005", exported & (F.col("branches") > 8)), ("R011", exported & F.col("uses_any")), ("R010", exported & F.col("returns").rlike(r"^\s*(readonly\s*)?\[")),
    ]
    return reduce(DataFrame.unionAll, [_pick(functions, rule, where, F.col("line")) for rule, where in checks])


def react_findings(components: DataFrame) -> DataFrame:
    """Of (path, line, n_boolean_props, n_context_props, effect_statements)."""
    checks = [("TS-REACT-R004", F.col("n_boolean_props") > 1), ("TS-REACT-R005", F.col("n_context_props") > 6), ("TS-REACT-R006", F.col("effect_statements") > 15)]
    return reduce(DataFrame.unionAll, [_pick(components, rule, where, F.col("line")) for rule, where in checks])


def ordered(findings: DataFrame) -> DataFrame:
    """Errors first, then by rule."""
    return findings.orderBy(F.when(F.col("severity") == "Error", 0).otherwise(1), "rule_id", "path", "line")
