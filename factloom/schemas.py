"""Explicit schemas of the relations that operators read. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_TYPES = {"STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "BOOLEAN": T.BooleanType(), "ARRAY<STRING>": T.ArrayType(T.StringType()), "MAP<STRING,STRING>": T.MapType(T.StringType(), T.StringType())}


def _struct(text: str) -> T.StructType:
    """Name and type of each column; needs no session."""
    return T.StructType([T.StructField(*(lambda name, kind: (name, _TYPES[kind]))(*part.split(" "))) for part in text.split(", ")])


_AT = "line INT, col INT"

SCHEMAS: dict[str, T.StructType] = {
    name: _struct(ddl)
    for name, ddl in {
        "source_files": "path STRING, content STRING, mtime_ms BIGINT",
        "modules": "path STRING, role STRING, layer STRING, is_valid BOOLEAN, is_declaration BOOLEAN, has_intent_doc BOOLEAN, n_lines INT, export_names ARRAY<STRING>, type_only_export_names ARRAY<STRING>, content_hash STRING",
        "imports": f"path STRING, seq INT, module_specifier STRING, kind STRING, is_type_only BOOLEAN, {_AT}",
        "edges": f"seq BIGINT, from_path STRING, to_path STRING, module_specifier STRING, kind STRING, is_type_only BOOLEAN, resolution STRING, {_AT}",
        "exports": f"path STRING, seq INT, name STRING, kind STRING, is_type_only BOOLEAN, {_AT}",
        "diagnostics": f"path STRING, phase STRING, code INT, message STRING, category STRING, {_AT}",
        "fixtures": "path STRING, seq INT, fixture_path STRING, line INT, line_end INT",
        "items": f"path STRING, name STRING, kind STRING, is_exported BOOLEAN, is_private BOOLEAN, line INT, line_end INT, container STRING",
        "calls": f"path STRING, owner STRING, callee STRING, is_new BOOLEAN, {_AT}",
        "params": f"path STRING, seq INT, function_name STRING, function_line INT, param_name STRING, type_text STRING, primitive_type STRING, flag_type STRING, {_AT}",
        "tuple_surfaces": f"path STRING, seq INT, function_name STRING, surface_name STRING, type_text STRING, element_types ARRAY<STRING>, {_AT}",
        "data_fields": f"path STRING, seq INT, type_kind STRING, type_name STRING, type_line INT, field_name STRING, type_text STRING, primitive_type STRING, {_AT}",
        "type_aliases": f"path STRING, seq INT, alias_name STRING, type_text STRING, primitive_type STRING, {_AT}",
        "variant_fields": f"path STRING, seq INT, union_name STRING, variant_name STRING, discriminant_name STRING, field_name STRING, primitive_type STRING, {_AT}",
        "control_flows": f"path STRING, seq INT, function_name STRING, line_span INT, statements INT, branches INT, loops INT, max_nesting INT, max_literal_chain INT, manual_transform_loops INT, max_block_statements INT, {_AT}",
        "responsibilities": f"path STRING, kind STRING, name STRING, line_span INT, {_AT}",
        "async_surfaces": f"path STRING, seq INT, name STRING, is_async BOOLEAN, returns_promise BOOLEAN, returns_effect BOOLEAN, error_text STRING, error_kind STRING, requirements STRING, {_AT}",
        "service_methods": f"path STRING, seq INT, container_kind STRING, container_name STRING, method_name STRING, requirements STRING, error_kind STRING, {_AT}",
        "signals": f"path STRING, seq INT, family STRING, owner_name STRING, callee STRING, kinds ARRAY<STRING>, {_AT}",
        "function_shapes": "path STRING, seq INT, name STRING, exported BOOLEAN, is_async BOOLEAN, line INT, line_span INT, n_params INT, n_boolean_params INT, statements INT, max_nesting INT, branches INT, loops INT, awaits INT, tries INT, uses_any BOOLEAN, returns STRING",
        "react_shapes": "path STRING, seq INT, name STRING, line INT, n_boolean_props INT, n_context_props INT, effect_statements INT",
        "return_shapes": "path STRING, seq INT, function_name STRING, fields ARRAY<STRING>, spreads ARRAY<STRING>, line INT",
        "package_entries": "subpath STRING, target STRING, conditions ARRAY<STRING>, source STRING, resolution STRING, to_path STRING",
        "package_scripts": "name STRING, command STRING",
        "package_dependencies": "name STRING, version_range STRING, source STRING",
        "workspace_packages": "path STRING, name STRING, pattern STRING",
        "reference_packages": "path STRING, name STRING, config_path STRING, composite BOOLEAN, declaration BOOLEAN",
        "schema_leaves": "path STRING, pointer STRING, key STRING, value STRING",
        "extensions": "name STRING, activation STRING, installed BOOLEAN",
        "build_tools": "name STRING, has_script BOOLEAN",
        "project": "mode STRING, config_path STRING, module_resolution STRING, source_roots ARRAY<STRING>, test_roots ARRAY<STRING>",
        "findings": f"seq BIGINT, rule_id STRING, pack STRING, severity STRING, title STRING, path STRING, {_AT}, summary STRING, labels MAP<STRING,STRING>",
        "hits": "seq BIGINT, term STRING, kind STRING, owner_path STRING, symbol STRING, path STRING, line_range STRING, score INT, reason STRING, snippet STRING, mtime_ms BIGINT",
        "profile_hints": "seq BIGINT, owner_path STRING, responsibilities ARRAY<STRING>, task_kinds ARRAY<STRING>, rationale STRING",
        "receipts": "seq BIGINT, kind STRING, owner_path STRING, fingerprint STRING, status STRING, summary STRING",
        "waivers": "seq BIGINT, kind STRING, owner_path STRING, fingerprint STRING, owner STRING, reason STRING, expires_at STRING",
        "tasks": "kind STRING, state STRING, owner_path STRING, fingerprint STRING, note STRING",
        "snapshot": "path STRING, content_hash STRING, is_valid BOOLEAN, facts STRING",
    }.items()
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def relation(spark: SparkSession, name: str, rows: list[dict]) -> DataFrame:
    """Rows given by column name; columns that are left out are null."""
    schema = SCHEMAS[name]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def conform(df: DataFrame, name: str) -> DataFrame:
    """The relation's columns in order, those that ``df`` lacks as nulls; raises if a column has another type."""
    from pyspark.sql import functions as F

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])
