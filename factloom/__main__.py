"""The command line: ``python -m factloom COMMAND ...``.

    check ROOT [--changed]                      findings; exit code 1 if one of them blocks
    search VIEW [QUERY] --root ROOT [--query-set A,B] [--owner PATH] [--pipe tests]
    plans FILE --root ROOT                      pattern plans, one JSON object a line, with a field "id"
    flow TERMS --root ROOT                      source.call=... sink.constructs=... scope.fn=...
    views                                       the search views

Rows come as lines of name=value, or, with --json DIR, as JSON in folders by name. Exit codes: 0 done, 1 blocking findings, 2 usage or plans that can't be run.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import patterns, rules
from factloom.operators.search import VIEWS, search
from factloom.plans import project
from factloom.sources import files, sinks

SHOWN = 200  # lines that are printed of a list


class Usage(ValueError):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise Usage(message)


def _parser() -> argparse.ArgumentParser:
    p = _Parser(prog="factloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True, parser_class=_Parser)
    check = commands.add_parser("check")
    check.add_argument("root")
    check.add_argument("--changed", action="store_true")
    find = commands.add_parser("search")
    find.add_argument("view")
    find.add_argument("query", nargs="?", default="")
    find.add_argument("--query-set")
    find.add_argument("--owner")
    find.add_argument("--pipe", action="append", choices=["tests"])
    plans = commands.add_parser("plans")
    plans.add_argument("file")
    flow = commands.add_parser("flow")
    flow.add_argument("terms", nargs="+")
    commands.add_parser("views")
    for c in (find, plans, flow):
        c.add_argument("--root", required=True)
    for c in (check, find, plans, flow):
        c.add_argument("--json")
    return p


def _catalog(spark: SparkSession, root: str) -> rules.Catalog:
    """The project below ``root``: sources by suffix; manifest, configuration and JSON documents beside them."""
    sources = files.scan(spark, root)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{json,yaml}").load(root)
    base = root.rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*(?=/)", ""), r"^\Q" + base + r"\E/", "")
    documents = raw.select(path.alias("path"), F.decode("content", "UTF-8").alias("content")).where(~F.col("path").rlike("(^|/)node_modules/"))
    own = {r.path: r.content for r in documents.where(F.col("path").isin("package.json", "tsconfig.json")).collect()}  # two files
    return project.build(sources, own.get("package.json"), own.get("tsconfig.json"), documents=documents)


def _show(packet: dict[str, DataFrame], folder: str | None) -> None:
    if folder:
        sinks.write_packet(packet, folder)
        return
    for name, df in packet.items():
        rows = sinks.compact_lines(df, name).limit(SHOWN + 1).collect()
        for r in rows[:SHOWN]:
            print(r.line)
        if len(rows) > SHOWN:
            print(f"{name}: more than {SHOWN} rows; --json DIR writes them all")


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    try:
        a = _parser().parse_args(arguments)
    except Usage as e:
        print(f"factloom: {e}", file=sys.stderr)
        return 2
    if a.command == "views":
        print("\n".join(sorted(VIEWS)))
        return 0
    if a.command == "search" and a.view not in VIEWS:
        print(f"factloom: unknown view {a.view!r}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("factloom").getOrCreate()
    try:
        if a.command == "check":
            c = _catalog(spark, a.root)
            found = project.check_changed(c) if a.changed else c["findings"]
            _show({"finding": found}, a.json)
            return rules.exit_code(found)
        if a.command == "flow":
            patterns.parse_flow(" ".join(a.terms))
        c = _catalog(spark, a.root)
        if a.command == "search":
            options = {k: v for k, v in (("query_set", a.query_set.split(",") if a.query_set else None), ("owner", a.owner), ("pipes", tuple(a.pipe or ()))) if v}
            _show(search(c, a.view, a.query, **options), a.json)
            return 0
        if a.command == "flow":
            _show({"flow": patterns.flow_query(" ".join(a.terms), c["items"].where("kind IN ('function', 'method')").select("path", "name", "line"), c["calls"])}, a.json)
            return 0
        text = spark.read.text(a.file).where("trim(value) <> ''").select(F.coalesce(F.get_json_object("value", "$.id"), F.concat(F.lit("line "), F.monotonically_increasing_id() + 1)).alias("plan"), F.col("value").alias("text"))
        relations = {name: patterns.syntax_rows(name, c["items"], c["imports"], c["calls"]) for name in patterns.CATALOGS}
        hits, errors = patterns.run_plans(text, relations)
        _show({"hit": hits, "error": errors}, a.json)
        return 0 if errors.isEmpty() else 2
    except (patterns.BadPlan, TypeError) as e:
        print(f"factloom: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
