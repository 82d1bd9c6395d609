"""Column functions: paths, names, versions, scores. All stay in Catalyst; none is a UDF."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
SOURCE_EXTENSIONS = (".ts", ".tsx", ".mts", ".cts")
STRUCTURAL = "._/\"'()[]:"
ASSET_EXTENSIONS = (".css", ".scss", ".less", ".svg", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".json", ".yaml", ".yml", ".html", ".md", ".txt")
SECRET_FLAGS = ("--api-key", "--apikey", "--password", "--secret", "--token")
BUILT_IN_TYPES = ("Array", "AsyncIterable", "BigInt", "Boolean", "Date", "Error", "Map", "NonNullable", "Omit", "Partial", "Pick", "Promise", "Readonly", "ReadonlyArray", "Record", "Required", "Set", "String", "Symbol", "Uint8Array")
SEMANTIC_NAMES = ("path", "url", "uri", "key", "token")
SEMANTIC_SUFFIXES = ("path", "url", "uri", "key", "token", "ms", "secs", "seconds", "bytes")
SEMANTIC_ALIASES = ("Id", "ID", "Path", "Url", "URL", "Uri", "URI", "Key", "Token", "Ms", "Secs", "Seconds", "Bytes")
STATE_NAMES = ("kind", "type", "status", "state", "mode", "phase", "tag", "category")
SURFACE_SCORES = {"source": 0, "docs": 10, "demo": 20, "test": 40}


# paths
def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def relative(path: Column, root: str) -> Column:
    """The path below ``root``; one that isn't below it stays."""
    root = root.rstrip("/")
    return F.when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1 << 30)).when(path == root, F.lit("")).otherwise(path)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(name: Column) -> Column:
    """The name without its last extension; a leading dot doesn't begin one."""
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", "")


def depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda x: x != ""))


def common_ancestor(paths: Column) -> Column:
    """Longest common directory of an array of paths."""
    parts = F.transform(paths, lambda p: F.split(dirname(p), "/"))
    same = lambda a, b: F.slice(a, 1, F.aggregate(F.zip_with(a, b, lambda x, y: x == y), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda acc, e: F.struct((acc["n"] + F.when(acc["on"] & F.coalesce(e, F.lit(False)), 1).otherwise(0)).alias("n"), (acc["on"] & F.coalesce(e, F.lit(False))).alias("on")), lambda acc: acc["n"]))
    return F.array_join(F.aggregate(parts, F.element_at(parts, 1), same), "/")


def namespace(path: Column) -> Column:
    """Owner namespace: no extension; an index file stands for its directory, the root's for a dot."""
    bare = stem(path)
    directory = dirname(path)
    return F.when(basename(bare) == "index", F.when(directory == "", F.lit(".")).otherwise(directory)).otherwise(bare)


def package_root(specifier: Column) -> Column:
    """A package's name in an import: two segments if scoped, else one; null for relative, absolute and # ones."""
    return F.when(specifier.rlike("^[./#]"), F.lit(None).cast("string")).otherwise(F.nullif(F.regexp_extract(specifier, r"^(@[^/]+/[^/]+|[^@/][^/]*)", 1), F.lit("")))


def is_test_path(path: Column) -> Column:
    """As search sees it: a directory must lie below another one, so that tests/x.ts at the root is none."""
    return F.lower(path).rlike(r"/tests?/|/__tests__/|\.test\.|\.spec\.")


def is_test_path_for_prefilter(path: Column) -> Column:
    """As the prefilter sees it: also directories at the root."""
    return path.rlike(r"^tests?$|(^|/)tests?/|\.(test|spec)\.tsx?$")


# search text
def contains_ci(value: Column, query: str) -> Column:
    """Case-insensitive containment; an empty query matches nothing."""
    needle = query.strip().lower()
    return F.contains(F.lower(value), F.lit(needle)) if needle else F.lit(False)


def any_contains_ci(values: list[Column], query: str) -> Column:
    needle = query.strip().lower()
    return F.exists(F.array(*values), lambda v: F.coalesce(F.contains(F.lower(v), F.lit(needle)), F.lit(False))) if needle else F.lit(False)


def fuzzy_match(candidate: Column, query: Column) -> Column:
    """struct(score, column) or null: an exact part scores 12 plus the query's length; else the query's signs, white space
    aside, taken greedily from left to right, score by how close they stand, unless they spread too far.

    One fold over the query's signs; lengths count code points. A null candidate or query and an empty query give null.
    """
    q, text = F.lower(F.trim(query)), F.lower(candidate)
    signs = F.filter(F.split(F.regexp_replace(q, r"\s+", ""), ""), lambda c: c != "")
    n, length = F.size(signs), F.length(q)

    def step(acc: Column, c: Column) -> Column:
        at = F.when(acc["at"] < 0, F.lit(0)).otherwise(F.call_function("locate", c, text, acc["at"] + 1))
        return F.struct(F.when(at == 0, F.lit(-1)).otherwise(at).alias("at"), F.when(acc["first"] == 0, at).otherwise(acc["first"]).alias("first"))

    walk = F.aggregate(signs, F.struct(F.lit(0).alias("at"), F.lit(0).alias("first")), step)
    span = walk["at"] - walk["first"] + 1
    loose = F.struct((F.lit(4) + F.greatest(F.lit(0), n * 2 - (span - n))).alias("score"), walk["first"].alias("column"))
    exact = F.struct((length + 12).alias("score"), F.call_function("locate", q, text).alias("column"))
    return F.when((q == "") | q.isNull() | candidate.isNull(), F.lit(None)).when(F.contains(text, q), exact).when((walk["at"] > 0) & (span <= F.greatest(length * 3, length + 12)), loose)


def fuzzy_match_of(low: Column, query: str) -> Column:
    """``fuzzy_match`` of a candidate in small letters and a query that is known: its signs in order are one pattern, which few
    candidates pass, and the greedy walk is a chain of ``locate`` calls, without a fold."""
    q = query.strip(" ").lower()
    signs = re.sub(r"[ \t\n\x0b\f\r]+", "", q)
    n, length = len(signs), len(q)
    kind = "struct<score:int,column:int>"
    if not q:
        return F.lit(None).cast(kind)
    exact = F.struct(F.lit(length + 12).alias("score"), F.locate(q, low).alias("column"))
    found = F.when(F.contains(low, F.lit(q)), exact)
    if n:
        first = at = F.locate(signs[0], low)
        for c in signs[1:]:
            at = F.call_function("locate", F.lit(c), low, at + 1)
        span = at - first + 1
        inside = low.rlike("^" + "".join(f"[^{re.escape(c)}]*+{re.escape(c)}" for c in signs))  # gives nothing back, so that a line is walked once
        loose = F.struct((F.lit(4) + F.greatest(F.lit(0), F.lit(n * 2) - (span - n))).alias("score"), first.alias("column"))
        found = found.when(inside & (span <= max(length * 3, length + 12)), loose)
    return found.cast(kind)


def specificity(term: Column) -> Column:
    """Distinct signs, length, and 8 for each structural sign."""
    signs = F.filter(F.split(term, ""), lambda c: c != "")
    lower = F.filter(F.split(F.lower(term), ""), lambda c: c != "")
    structural = F.size(F.filter(signs, lambda c: c.isin(*STRUCTURAL)))
    return F.size(F.array_distinct(lower)) + F.length(term) + structural * 8


def surface_rank(owner_path: Column) -> Column:
    return F.when((owner_path == "") | is_test_path(owner_path), 0).when(owner_path.endswith(".d.ts"), 1).otherwise(2)


def occurrences(text: Column, term: Column, most: int | None = None) -> Column:
    """Occurrences that don't overlap, ``most`` at most; 0 for an empty term."""
    n = F.when(F.length(term) > 0, F.floor((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term))).otherwise(F.lit(0)).cast("int")
    return F.least(n, F.lit(most)) if most is not None else n


def camel_tokens(name: Column) -> Column:
    """Lower-case words of a name, split at case changes and at other signs; those of two signs or fewer go."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2")), r"[^a-z0-9]+"), lambda t: F.length(t) > 2)


def line_class(line: Column, term: str) -> Column:
    """0: the line declares the term, 1: calls it, 2: holds an export, 3: other."""
    t = re.escape(term)
    declares = rf"(?i)^\s*(export\s+)?(async\s+)?(function|class|interface|type|enum|const|let|var)\s+{t}\b"
    return F.when(line.rlike(declares), 0).when(line.rlike(rf"(?i)\b{t}\s*\("), 1).when(line.rlike(r"(?i)\bexport\b"), 2).otherwise(3)


def filename_score(name: Column, term: str, primary: str) -> Column:
    """80 for the whole term, 25 for each of its words, 70 for each word of the primary term."""
    words = lambda s: [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", s).lower()) if len(w) > 2]
    has = lambda w, n: F.when(F.contains(F.lower(name), F.lit(w.lower())), n).otherwise(0)
    return sum((has(w, 25) for w in words(term)), has(term, 80)) + sum((has(w, 70) for w in words(primary)), F.lit(0))


def text_score(name: Column, text: Column, term: str) -> Column:
    """40 for the term in the name, 10 for each of 8 occurrences at most, 30 and 20 for the two declaration forms."""
    t = re.escape(term.lower())
    low = F.lower(text)
    return (
        F.when(F.contains(F.lower(name), F.lit(term.lower())), 40).otherwise(0)
        + occurrences(low, F.lit(term.lower()), 8) * 10
        + F.when(low.rlike(rf"\b(function|class|interface|type|enum)\s+{t}\b"), 30).otherwise(0)
        + F.when(low.rlike(rf"\b(const|let|var)\s+{t}\b"), 20).otherwise(0)
    )


# names and types
def _ends(name: Column, suffixes: tuple[str, ...]) -> Column:
    """name_suffix or nameSuffix."""
    return name.rlike("_(" + "|".join(suffixes) + ")$|(" + "|".join(x.capitalize() for x in suffixes) + ")$")


def is_semantic_name(name: Column) -> Column:
    """Fields that name ids, places, keys or units."""
    return name.rlike("^id$|_id$|Id$") | name.isin(*SEMANTIC_NAMES) | _ends(name, SEMANTIC_SUFFIXES)


def is_semantic_alias(name: Column) -> Column:
    return name.rlike("(" + "|".join(SEMANTIC_ALIASES) + ")$")


def is_flag_name(name: Column) -> Column:
    return name.isin("enabled", "disabled") | name.rlike("^(is|has|can|allow|include|should)_|^(is|has|can|allow|include|should|enable|disable)[A-Z]")


def is_flag_alias(name: Column) -> Column:
    return name.rlike("(Flag|Enabled|Disabled|Allowed|Included)$")


def is_state_name(name: Column) -> Column:
    return name.isin(*STATE_NAMES) | _ends(name, STATE_NAMES)


def primitive_type(type_text: Column) -> Column:
    """The primitive label of a type: its own name, or, of a union of primitives only, their sorted distinct names joined by |; else null."""
    parts = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(type_text, r"\|"), lambda p: F.trim(p)), lambda p: p != "")))
    return F.when((F.size(parts) > 0) & F.forall(parts, lambda p: p.isin("string", "number", "boolean", "bigint", "symbol")), F.array_join(parts, " | "))


def flag_type(type_text: Column) -> Column:
    """boolean for a boolean and for unions of true, false and boolean; null and undefined beside them don't count."""
    parts = F.filter(F.transform(F.split(type_text, r"\|"), lambda p: F.trim(p)), lambda p: ~p.isin("", "undefined", "null"))
    return F.when((F.size(parts) > 0) & F.forall(parts, lambda p: p.isin("boolean", "true", "false")), F.lit("boolean"))


def collection_kind(type_text: Column) -> Column:
    """array, tuple, map, set or record; the first that fits, seen through Readonly."""
    bare = F.trim(F.regexp_replace(type_text, r"^\s*(?:Readonly<(.*)>|readonly\s+(.*))\s*$", "$1$2"))
    return (
        F.when(bare.rlike(r"^\[.*\]$"), "tuple").when(bare.rlike(r"\[\]$|^(Readonly)?Array<"), "array").when(bare.rlike(r"^(Readonly|Weak)?Map<"), "map").when(bare.rlike(r"^(Readonly|Weak)?Set<"), "set").when(bare.rlike(r"^(Partial<)?Record<"), "record")
    )


def error_channel(error_text: Column) -> Column:
    """none, weak or domain; of a union weak if a member is weak, none only if all are."""
    parts = F.transform(F.split(error_text, r"\|"), lambda p: F.trim(p))
    weak = F.exists(parts, lambda p: p.isin("any", "unknown", "Error", "string", "object", "{}"))
    return F.when(F.forall(parts, lambda p: p == "never"), "none").when(weak, "weak").otherwise("domain")


def has_custom_type(type_text: Column) -> Column:
    """Whether a capitalised name outside the built-in ones is mentioned."""
    return F.exists(F.regexp_extract_all(type_text, F.lit(r"\b([A-Z][A-Za-z0-9_]*)\b"), F.lit(1)), lambda n: ~n.isin(*BUILT_IN_TYPES))


def mentions_import_type(type_text: Column, specifier: str) -> Column:
    return type_text.rlike(rf"""\bimport\(\s*["']{re.escape(specifier)}["']\s*\)""")


# versions and dependency queries
def parse_dependency_query(query: str) -> dict[str, str | None] | None:
    """dep[/sub][@version][::api]; null without a name."""
    m = re.fullmatch(r"(@[^/@:]+/[^/@:]+|[^@/:]+)(?:/([^@:]+))?(?:@([^:]+))?(?:::(.+))?", query.strip())
    return None if m is None else dict(zip(("name", "subpath", "version", "api"), m.groups(), strict=True))


def version_status(requested: Column, locked: Column, version_range: Column) -> Column:
    return (
        F.when(requested.isNull() & locked.isNotNull(), "locked").when(requested.isNotNull() & locked.isNotNull() & (requested == locked), "matched").when(requested.isNotNull() & locked.isNotNull(), "external-version")
        .when(requested.isNotNull(), "requested-unresolved").when(version_range.isNotNull(), "range-only").otherwise("unknown")
    )


def version_scope(status: Column) -> Column:
    return F.when(status.isin("locked", "matched", "range-only"), "current").when(status == "external-version", "external").otherwise("unknown")


# hashes, ids, text windows
def fingerprint16(text: Column) -> Column:
    return F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 16)


def djb2(text: Column) -> Column:
    """32-bit hash: 33 times the hash so far, xor the next sign; base 5381."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(5381).cast("bigint"), lambda h, c: (h * 33).bitwiseXOR(F.ascii(c).cast("bigint")).bitwiseAND(F.lit((1 << 32) - 1)))


def sanitised_id(text: Column) -> Column:
    kept = F.regexp_replace(F.lower(text), r"[^a-z0-9._:-]+", ".")
    trimmed = F.regexp_replace(F.regexp_replace(kept, r"\.{2,}", "."), r"^\.+|\.+$", "")
    return F.when(trimmed == "", F.lit("root")).otherwise(trimmed)


def redact_argv(argv: Column) -> Column:
    """Values of secret flags, joined by = or the next word, become a mark."""
    flags = "|".join(re.escape(f) for f in SECRET_FLAGS)

    def one(x: Column, i: Column) -> Column:
        after_flag = (i > 0) & F.coalesce(F.try_element_at(argv, i), F.lit("")).isin(*SECRET_FLAGS)
        return F.when(after_flag, F.lit("[REDACTED]")).otherwise(F.regexp_replace(x, rf"^({flags})=.*$", "$1=[REDACTED]"))

    return F.transform(argv, one)


def pointer_escape(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def source_lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n", -1)


def line_window(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, trailing white space cut; swapped if reversed, the end clamped, a start past the end an error."""
    lines = source_lines(text)
    a, b = F.least(start, end), F.greatest(start, end)
    return F.when(a > F.size(lines), F.raise_error(F.lit("the range starts past the end of the text"))).otherwise(F.rtrim(F.array_join(F.slice(lines, a, b - a + 1), "\n")))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 3).cast("int")


def doc_word_count(text: Column) -> Column:
    """Words of more than two signs in the first block comment, tags aside."""
    block = F.regexp_replace(F.regexp_extract(text, r"(?s)/\*\*?(.*?)\*/", 1), r"@\w+|\{[^}]*\}|[*`]", " ")
    return F.size(F.filter(F.split(block, r"\s+"), lambda w: F.length(w) > 2))


def capped_names(names: Column, k: int) -> Column:
    """The first k names and, if there are more, how many."""
    more = F.when(F.size(names) > k, F.concat(F.lit(",+"), (F.size(names) - k).cast("string"))).otherwise(F.lit(""))
    return F.concat(F.array_join(F.slice(names, 1, k), ","), more)


def capped_line(text: Column, k: int = 160) -> Column:
    return F.substring(F.trim(text), 1, k)


# type surfaces: fixed values and their order
PRIMITIVES = "string|number|boolean|bigint|symbol|null|undefined|void|unknown|never"


def type_surface_kind(api_kind: Column, surface: Column) -> Column:
    """What sort of declaration a public type stands in."""
    alike = api_kind.isin("tuple", "union", "interface", "class", "enum")
    return F.when(alike, api_kind).when(api_kind == "type", "alias").when(surface.startswith("field:"), "object").when(api_kind.isNull(), "unknown").otherwise("function")


def type_surface_role(api_kind: Column, surface: Column) -> Column:
    """What a public type is to those who call."""
    return (
        F.when(surface.startswith("param:"), "api-input").when(surface.isin("return", "success"), "api-output").when(surface == "error", "api-error").when(surface.startswith("field:"), "api-field")
        .when((surface == "alias") | (api_kind == "type"), "public-type-alias").when(surface.startswith("variant:"), "api-field").otherwise("external-dependency")
    )


def type_carrier(type_text: Column, api_kind: Column) -> Column:
    """What carries a type, by its text."""
    return (
        F.when(type_text.isNull(), "unknown").when((api_kind == "tuple") | type_text.rlike(r"^\s*\["), "tuple").when(api_kind == "type", "alias").when(type_text.rlike(rf"\b(?:{PRIMITIVES})\b"), "primitive")
        .when(F.contains(type_text, F.lit("|")), "union").when(type_text.rlike(r"^Array<|^\w+\[\]$"), "array").when(type_text.rlike(r"\{.*\}"), "object").otherwise("external")
    )


# maps, constants in JSON, stamps
def merged(base: Column, over: Column) -> Column:
    """A map with the entries of another on top of it."""
    keys = F.map_keys(over)
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.array_contains(keys, k)), over)


def compact(values: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(values, lambda _, v: v.isNotNull())


def const_at(text: Column, parts: list[str]) -> Column:
    """The string at a place in a JSON object, reached through objects only; null for anything else there and for text that isn't JSON."""
    quote = lambda k: json.dumps(k, ensure_ascii=False)
    whole = F.try_parse_json(text)
    at = "$" + "".join(f"[{quote(k)}]" for k in parts)
    return F.when(F.schema_of_variant(F.try_variant_get(whole, at, "variant")) == "STRING", F.try_variant_get(whole, at, "string"))


_DAY_MS = 86_400_000
_CYCLE_DAYS = 146_097  # 400 years, after which the calendar repeats


def utc_stamp(ms: Column, for_file: bool = False) -> Column:
    """Milliseconds since 1970 as a stamp of whole seconds in UTC, whatever the session's time zone; in a file's name colons are dashes.

    Any long has one: a timestamp ends with the year 294247, so the day is taken inside its cycle of 400 years.
    """
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    floor = lambda a, b: div(a, b) - F.when(a % b < 0, 1).otherwise(0)
    cycle, second = floor(ms, _CYCLE_DAYS * _DAY_MS), div(F.pmod(ms, F.lit(_DAY_MS)), 1000)
    date = F.date_add(F.lit("1970-01-01").cast("date"), div(F.pmod(ms, F.lit(_CYCLE_DAYS * _DAY_MS)), _DAY_MS).cast("int")).cast("string")
    year = F.substring(date, 1, 4).cast("long") + 400 * cycle
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    year = F.when(year.between(0, 999), F.lpad(year.cast("string"), 4, "0")).otherwise(year.cast("string"))
    stamp = F.concat(year, F.substring(date, 5, 6), F.lit("T"), two(div(second, 3600)), F.lit(":"), two(div(second, 60) % 60), F.lit(":"), two(second % 60), F.lit("Z"))
    return F.replace(stamp, F.lit(":"), F.lit("-")) if for_file else stamp
