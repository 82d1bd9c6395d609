"""Source texts as a relation of tokens, and fact families as plans over it.

A text is cut into pieces by one pattern inside the JVM and exploded; a token's line, depth and statement are running sums over its
file, brackets meet their partners by depth, and a family is a filter, a window or a join over tokens. All windows are by path: texts
are dealt by path before they are cut, and no token crosses the network. Windows by statement are running windows of a file that begin
anew, so that one order of a file's tokens serves nearly all; a file of any number of tokens spills and is never one Python object.

Null texts have no tokens. Known limits, beside the extractor of ``typescript``: templates nested twice are cut at the inner one, text
between tags that holds a brace is read as code, and positions are lines without columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.checkpoints import stored

_ARGUMENT = r"""(?:[^<>()=;{}"'`&]|"[^"\n]*+"|'[^'\n]*+')*+"""
_TRIVIA = r"(?:\s++|/\*.*?\*/|(?<!:)//[^\n]*+)"  # white space and comments
_PATTERN = r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"
# every sign of a text lies in one piece: a token with the white space and comments before it and the type arguments behind it; repeated groups are possessive, so that the matcher never recurses on long texts
_PIECES = rf"(?s){_TRIVIA}*+(?:" + "|".join([
    r'"(?:[^"\\\n]|\\.)*+"' + r"|'(?:[^'\\\n]|\\.)*+'", r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^`{}]|`[^`]*+`|\{[^{}]*+\})*+\})*+`",
    r"(?<=[(,=:\[!&|?{};]\s{0,3})" + _PATTERN,  # a pattern where a value is due
    r"(?<=[\w\"'}/]>)[^<>{}]++(?=</)",  # text between tags
    r"[#@]?[\p{L}_$][\p{L}\p{N}_$]*+(?:\s*+\??\.\s*+#?[\p{L}_$][\p{L}\p{N}_$]*+)*+", r"[0-9][\p{L}0-9_.]*+", r"=>|\.\.\.|&&|\|\||\?\?|\?\.|.",
]) + rf")(?:(?<=[\w$])<{_ARGUMENT}(?:<{_ARGUMENT}>{_ARGUMENT})*+>)?+|{_TRIVIA}++"
_SPACES = " \t\n\x0b\f\r"  # what \s means to the matcher
_SIGNS = ("(", ")", "{", "}", "[", "]", ";", ",", ".", ":", "=", "<", ">", "=>", "?", "!", "|", "&", "...", "&&", "||", "??", "?.")
PARTS = 4  # tasks for each shuffle partition of the session, at least: a text has far less bytes than its tokens
TEXT_BYTES = 1 << 21  # of texts in a task: their tokens, sorted, are some hundred times that
_NAME = r"^[#@]?[\p{L}_$]"
_CONTINUES = ("from", "as", "else", "catch", "finally", "extends", "implements", "of", "in", "instanceof", "satisfies", "is")
_MODIFIERS = ("export", "default", "declare", "async", "abstract")
_MEMBER_MODIFIERS = ("public", "private", "protected", "static", "async", "readonly", "get", "set", "override", "abstract", "accessor", "*")
_NO_CALLEE = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "of", "in", "constructor", "super", "async", "import", "new", "else", "do", "void", "yield", "throw", "case", "delete")
# fixed values: the keyword of a declaration and its kind
DECLARATIONS = {"function": "function", "class": "class", "interface": "interface", "type": "type", "enum": "enum", "namespace": "namespace", "module": "namespace", "const": "variable", "let": "variable", "var": "variable"}
# fixed values
RUN_METHODS = ("runCallback", "runFork", "runPromise", "runPromiseExit", "runSync")
PROMISE_COMBINATORS = ("Promise.all", "Promise.allSettled", "Promise.any", "Promise.race")
EFFECT_COLLECTIONS = ("Effect.all", "Effect.allSuccesses", "Effect.allWith", "Effect.forEach", "Effect.mergeAll", "Effect.replicateEffect", "Effect.validateAll")
EXTERNAL_IO = ("fetch", "Effect.async", "Effect.promise", "Effect.tryPromise")
IMPURE_CALLS = ("Date.now", "Math.random")
OBSERVES = r"^Effect\.(annotateCurrentSpan|annotateLogs|annotateLogsScoped|log|logDebug|logError|logFatal|logInfo|logTrace|logWarning|withSpan)$|^Metric\."
RESILIENT = r"^Effect\.(retry|retryOrElse|timeout|timeoutFail|timeoutFailCause|timeoutOption|timeoutTo)$"
DECODES = r"^Schema\.((decode|validate)\w*|parseJson|is|asserts)$"
_RUNS = r"^(Effect|Runtime|[\w$.]*[rR]untime)\.(" + "|".join(RUN_METHODS) + ")$"


def _window():
    return Window.partitionBy("path").orderBy("at")


def _before():
    return _window().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def dealt(rows: DataFrame, text_bytes: Column) -> DataFrame:
    """Rows by path over the tasks that cut their texts; these are summed up first, so that what a task sorts is bounded by the texts' bytes (a file's at least), whatever the table's size and the session's partitions."""
    size = rows.agg(F.sum(text_bytes.cast("long"))).first()[0] or 0
    return rows.repartition(max(PARTS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TEXT_BYTES)), "path")


def tokens(files: DataFrame, lie_by_path: bool = False) -> DataFrame:
    """(path, at, kind, text, line, depth) and what is near: the tokens of each file in order, white space, comments and type arguments left out.

    ``prev``, ``second`` and ``third`` are the texts before, ``next``, ``next_two`` and ``next_three`` those behind. ``depth`` counts open brackets of any form; a bracket has the depth of what surrounds it, so that both ends agree. ``lie_by_path`` says that
    the texts were made of rows that ``dealt`` has dealt, and need no exchange of their own.
    """
    texts = files.select("path", "content")  # no condition on texts made of rows, which would be made once more for it: of null come no pieces
    texts = (texts if lie_by_path else dealt(texts.where("content IS NOT NULL"), F.octet_length("content"))).sortWithinPartitions("path")
    t = texts.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(_PIECES), F.lit(0))).alias("at", "piece")).withColumn("rest", F.ltrim("piece", F.lit(_SPACES)))
    commented = F.col("rest").startswith("//") | F.col("rest").startswith("/*")
    t = t.withColumn("rest", F.when(commented, F.regexp_replace("rest", rf"(?s)^{_TRIVIA}*+", "")).otherwise(F.col("rest")))  # from the token on
    first, rest = F.substring("rest", 1, 1), F.col("rest")
    bare = ~rest.contains("<") | (first == "<") | first.isin('"', "'", "`", "/") & ~rest.endswith(">")  # no type arguments follow
    text = F.when(bare, rest).otherwise(F.substring_index("rest", "<", 1))
    ends = lambda c: F.when(F.contains(c, F.lit("\n")), F.length(c) - F.length(F.replace(F.col(c), F.lit("\n"), F.lit("")))).otherwise(0)
    t = t.select("path", "at", text.alias("text"), ends("piece").alias("_n"), ends("rest").alias("_own"))
    first = F.substring("text", 1, 1)
    kind = (
        F.when(first.between("a", "z") | first.between("A", "Z"), "name").when(F.col("text").isin(*_SIGNS), "op").when(first.isin('"', "'"), "string").when(first == "`", "template")
        .when((first == "/") & (F.length("text") > 1), "pattern").when(F.col("text").rlike(_NAME), "name").when(first.between("0", "9"), "number").when(F.length("text") == 1, "op").otherwise("markup")
    )
    opens, closes = F.col("text").isin("(", "[", "{"), F.col("text").isin(")", "]", "}")
    t = t.select("path", "at", F.when(F.col("text") != "", kind).alias("kind"), "text", "_n", "_own", F.when(opens, 1).when(closes, -1).otherwise(0).alias("_d"))
    spaced = (F.col("kind") == "name") & F.contains("text", F.lit(".")) & F.col("text").rlike(r"[\s?]")
    t = t.withColumn("text", F.when(spaced, F.regexp_replace("text", r"\s*+\??\.\s*+", ".")).when(F.col("kind").isNotNull(), F.col("text")))  # null at a text's end, if that is no token
    w, ended = _window(), F.sum("_n").over(_before())
    line = lambda n: (ended - F.col("_own") + 1 if n == 0 else F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -n)) - F.lag("_own", n).over(w) + 1).cast("int")
    near = {"prev": F.lag("text").over(w), "prev_line": line(1), "prev_kind": F.lag("kind").over(w), "next": F.lead("text").over(w), "next_kind": F.lead("kind").over(w)}
    near |= {"second": F.lag("text", 2).over(w), "second_line": line(2), "third": F.lag("text", 3).over(w), "next_two": F.lead("text", 2).over(w), "kind_two": F.lead("kind", 2).over(w), "next_three": F.lead("text", 3).over(w)}
    t = t.select("path", "at", "kind", "text", line(0).alias("line"), (F.sum("_d").over(_before()) - F.greatest("_d", F.lit(0))).cast("int").alias("depth"), *[c.alias(n) for n, c in near.items()])
    return t.where("text IS NOT NULL")


def _with_starts(found: DataFrame) -> DataFrame:
    """Tokens with ``starts``, which marks the first one of a statement.

    One starts at depth 0 after a semicolon, after a closing brace, or on a new line where the one before can end: at a name that continues nothing.
    """
    fresh = F.col("kind").isin("name", "string", "template") & ~F.col("text").isin(*_CONTINUES)
    can_end = F.col("prev_kind").isin("name", "string", "number", "template", "pattern") & ~F.col("prev").isin(*_CONTINUES, *_MODIFIERS, *DECLARATIONS) | F.col("prev").isin(")", "]", "}")
    starts = (F.col("depth") == 0) & ~F.col("text").isin(")", "]", "}") & (F.col("prev").isNull() | (F.col("prev") == ";") | fresh & ((F.col("prev") == "}") | (F.col("line") > F.col("prev_line")) & can_end))
    return found.withColumn("starts", F.coalesce(starts, F.lit(False)))


def _head() -> Column:
    """Whether a token is the first one of a statement, or of its file."""
    return F.col("starts") | F.col("prev").isNull()


def _last(marked: Column, value: str | Column = "at") -> Column:
    """The value of the last marked token up to each token; it is the token's own statement's where that token lies at or after ``statement``."""
    return F.last(F.when(marked, F.col(value) if isinstance(value, str) else value), True).over(_before())


def _is_here(place: str) -> Column:
    return F.coalesce(F.col(place) >= F.col("statement"), F.lit(False))


def statements(found: DataFrame) -> DataFrame:
    """Tokens with their statement: ``statement`` is the place of its first token, ``starts`` marks that token."""
    return _with_starts(found).withColumn("statement", _last(_head()))


def _is_clause() -> Column:
    """At the first token of a statement: whether it is an import or a list of exports; null elsewhere."""
    return F.when(F.col("starts"), F.col("text").isin("import", "export") & ~((F.col("text") == "import") & (F.col("next") == "(")) & ~((F.col("text") == "export") & F.col("next").isin("default", "declare", "async", "abstract", "interface", "=", "as", *(d for d in DECLARATIONS if d != "type"))))


def _clauses(found: DataFrame, others: dict[str, Column]) -> DataFrame:
    """Import statements and lists of exports, ``c``: their tokens of depth 0 and 1 in order; empty at other statements. Of a statement's tokens ``others`` are gathered beside
    them, so that a family reads its tokens once. ``found`` has statements."""
    inside = F.coalesce("_in", F.lit(False)) & (F.col("depth") < 2)
    t = found.withColumn("_in", _last(_is_clause().isNotNull(), _is_clause())).withColumns({"c": F.when(inside, F.struct("at", "text", "kind", "depth", "line")), **others})
    t = t.where(F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in ("c", *others)]))
    c = t.groupBy("path", "statement").agg(F.array_sort(F.collect_list("c")).alias("c"), *[F.collect_list(n).alias(n) for n in others])
    first = F.try_element_at("c", F.lit(1))
    words = c.withColumns({"w": F.transform("c", lambda x: x["text"]), "seq_at": first["at"], "line": first["line"]})
    inner = F.array_join(F.transform(F.filter("c", lambda x: (x["depth"] == 1) & (x["kind"] != "op") | (x["depth"] == 1) & (x["text"] == ",")), lambda x: x["text"]), " ")
    elements = F.filter(F.transform(F.split(inner, ","), lambda e: F.trim(e)), lambda e: e != "")
    at_from = F.expr("array_position(transform(c, x -> x.text = 'from' AND x.depth = 0), true)").cast("int")
    return words.withColumns({"elements": elements, "from_at": at_from})


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(F.substr(c, F.lit(2), F.length(c) - 2), r"\\(.)", "$1")


_TYPE_ELEMENT = r"^type (?!as( |$))"


def imports(found: DataFrame) -> DataFrame:
    """(path, seq, module_specifier, kind, is_type_only, line): imports for their effect, by clause or by require, repeated exports, dynamic imports and import types, numbered in a file's order.

    Type only is a clause that says so as a whole or of each of its names.
    """
    t = statements(found)
    in_type = F.coalesce(F.col("prev").isin(":", "<", "|", "&", "typeof") | (F.col("prev") == "=") & (F.col("third") == "type"), F.lit(False))
    row = lambda at, spec, kind, type_only, line: F.struct(at.alias("at"), spec.alias("spec"), kind.alias("kind"), type_only.alias("is_type_only"), line.alias("line"))
    is_dynamic = (F.col("kind") == "name") & (F.col("text") == "import") & (F.col("next") == "(") & (F.col("kind_two") == "string") & (F.col("next_three") == ")")
    c = _clauses(t, {"dynamic": F.when(is_dynamic, row(F.col("at"), F.col("next_two"), F.when(in_type, "import").otherwise("dynamic-import"), in_type, F.col("line")))})
    by_from = F.when(F.col("from_at") > 0, F.try_element_at("c", F.col("from_at") + 1))
    word = lambda n: F.coalesce(F.try_element_at("w", F.lit(n)), F.lit(""))
    bare = F.when(word(1) == "import", F.try_element_at("c", F.lit(2)))
    required = F.when((word(1) == "import") & F.array_contains("w", "require"), F.expr("try_element_at(filter(c, x -> x.depth = 1 AND x.kind = 'string'), 1)"))
    is_string = lambda x: F.when(x["kind"] == "string", x["text"])
    spec = F.coalesce(is_string(by_from), is_string(bare), is_string(required))
    whole = (word(2) == "type") & ~word(3).isin("from", ",") & ((F.col("from_at") > 0) | F.array_contains("w", "require"))
    each = (word(2) == "{") & (F.size("elements") > 0) & F.forall("elements", lambda e: e.rlike(_TYPE_ELEMENT))
    static = F.when(spec.isNotNull(), row(F.col("seq_at"), spec, word(1), whole | each, F.col("line")))
    rows = c.select("path", F.explode(F.concat("dynamic", F.array_compact(F.array(static)))).alias("x")).select("path", "x.*")
    return rows.select("path", (F.row_number().over(_window()) - 1).alias("seq"), _unquoted(F.col("spec")).alias("module_specifier"), "kind", "is_type_only", "line")


_IN_PATTERN = ((",", "{", "[", ":", "..."), (",", "}", "]", "="))  # what is before and after a name that a pattern binds


def _bracket() -> Column:
    return F.col("text").isin("(", ")", "[", "]", "{", "}")


def _declared(found: DataFrame, also: Column | None = None, members: bool = False, counts: dict[str, Column] | None = None) -> DataFrame:
    """Tokens with the declaration that their statement makes: keyword's kind and place, exported, default, and the first name up to a token as ``owner_name``.

    Of tokens inside brackets those stay that bear on it: brackets, names that a pattern may bind, a file's last token, and what ``also`` asks for. Windows that
    don't build on each other are one operator. With ``members`` a token has the class's or interface's method that it lies in. ``counts`` are counted up to each token.
    """
    in_pattern = (F.col("kind") == "name") & F.col("prev").isin(*_IN_PATTERN[0]) & F.col("next").isin(*_IN_PATTERN[1])
    kept = (F.col("depth") <= 0) | _bracket() | in_pattern | F.col("next").isNull()
    t = _with_starts(found.where(kept if also is None else kept | also))
    lone = ~F.col("text").isin("type", "namespace", "module", "interface") | F.col("next_kind").isin("name", "string")
    key = (F.col("kind") == "name") & (F.col("depth") == 0) & F.col("text").isin(*DECLARATIONS) & (F.col("starts") | F.col("prev").isin(*_MODIFIERS) | (F.col("text") == "enum") & (F.col("prev") == "const")) & lone & ~((F.col("text") == "const") & (F.col("next") == "enum"))
    table = F.create_map(*[F.lit(x) for pair in DECLARATIONS.items() for x in pair])
    t = t.withColumn("is_key", F.coalesce(key, F.lit(False)))
    is_key, at_top = F.col("is_key"), F.col("depth") == 0
    t = t.withColumns({
        "statement": _last(_head()), "exported": _last(_head(), F.col("text") == "export"), "first_line": _last(_head(), "line"), "key_at": _last(is_key), "_declares": _last(is_key, table[F.col("text")]),
        "_opens": _last(is_key, F.coalesce(F.col("next").isin("{", "["), F.lit(False))), "_equals": _last(at_top & (F.col("text") == "=")), "_arrow": _last(at_top & F.col("text").isin("=>", "function")),
        **{n: F.count_if(c).over(_before()) for n, c in (counts or {}).items()},
    })
    t = t.withColumns({"declares": F.when(_is_here("key_at"), F.col("_declares")), "assigned": _is_here("_equals"), "is_function": _is_here("_arrow")}).drop("_declares", "_equals", "_arrow")
    binds = F.col("declares") == "variable"
    plain = binds & (F.col("depth") == 0) & (F.col("prev").isin("const", "let", "var") | (F.col("prev") == ",") & F.col("next").isin("=", ":", ",", ";")) & (F.col("kind") == "name") & ~F.col("is_key")
    in_pattern = binds & (F.col("depth") > 0) & F.col("_opens") & ~F.col("assigned") & in_pattern
    named = ~binds & ~F.col("is_key") & (F.col("depth") == 0) & (F.col("kind") == "name") & (F.col("prev").isin(*DECLARATIONS) & (F.col("at") > F.col("key_at")) | (F.col("prev") == "*") & (F.col("declares") == "function")) & (F.col("text") != "extends")
    unnamed = F.col("is_key") & F.col("declares").isin("function", "class") & F.col("next").isin("(", "{", "extends")
    t = t.withColumns({"_named": F.coalesce(plain | in_pattern | named, F.lit(False)), "_unnamed": F.coalesce(unnamed, F.lit(False))})
    either = F.col("_named") | F.col("_unnamed")
    # of marked tokens up to here, the latest statement's first one: ``at`` is an int
    order = F.when(either, F.shiftleft(F.col("statement").cast("long"), 32) - F.col("at"))
    more = {"_names": F.last(F.when(F.col("_named"), F.col("at")), True).over(_window().rowsBetween(Window.unboundedPreceding, -1)), "_any": _last(either), "_owner": F.max_by(F.when(F.col("_named"), F.col("text")).otherwise("default"), order).over(_before())}
    if members:
        due = F.col("second").isin("{", ";", "}", *_MEMBER_MODIFIERS) | (F.col("prev_line") > F.col("second_line"))
        t = t.withColumn("_is_member", F.coalesce((F.col("text") == "(") & (F.col("prev_kind") == "name") & F.col("declares").isin("class", "interface") & (F.col("depth") == 1) & due, F.lit(False)))
        more |= {"_member": _last(F.col("_is_member")), "_method": _last(F.col("_is_member"), "prev")}
    t = t.withColumns(more)
    fresh = ~_is_here("_names")
    t = t.withColumns({"name": F.when(F.col("_named") & (binds | fresh), F.col("text")).when(F.col("_unnamed"), F.lit("default")), "owner_name": F.when(_is_here("_any"), F.col("_owner"))} | ({"method": F.when(_is_here("_member"), F.col("_method"))} if members else {}))
    return t.drop("_owner", "_any", "_names", "_named", "_unnamed", "_opens", "_member", "_method")


def items(found: DataFrame) -> DataFrame:
    """(path, name, kind, is_exported, line, line_end): what a module declares at its top; patterns give a row for each name they bind."""
    t = _declared(found).withColumn("_ends", F.coalesce(F.lead("starts").over(_window()), F.lit(True))).where("name IS NOT NULL OR _ends")
    line_end = F.max("line").over(Window.partitionBy("path", "statement"))
    return t.select("path", "name", F.col("declares").alias("kind"), F.coalesce("exported", F.lit(False)).alias("is_exported"), F.col("first_line").alias("line"), line_end.alias("line_end")).where("name IS NOT NULL")


def exports(found: DataFrame) -> DataFrame:
    """(path, name, kind, is_type_only, line): exported declarations, lists, repeated exports, stars, default values."""
    row = lambda name, kind, type_only, line: F.struct(name.alias("name"), kind.alias("kind"), type_only.alias("is_type_only"), line.alias("line"))
    is_default = (F.col("kind") == "name") & (F.col("text") == "default") & (F.col("prev") == "export") & (F.col("depth") == 0) & ~F.col("next").isin("function", "class", "async", "abstract", "interface")
    declared = F.when(F.col("exported") & F.col("name").isNotNull(), row(F.col("name"), F.col("declares"), F.col("declares").isin("interface", "type"), F.col("first_line")))
    c = _clauses(_declared(found, F.col("depth") < 2), {"declared": declared, "default": F.when(is_default, row(F.lit("default"), F.lit("default"), F.lit(False), F.col("line")))})
    word = lambda n: F.coalesce(F.try_element_at("w", F.lit(n)), F.lit(""))
    typed = (word(2) == "type") & word(3).isin("{", "*")
    shape = F.when(word(1) == "export", F.when(typed, word(3)).otherwise(word(2)))
    star_name = F.when(typed, F.when(word(4) == "as", word(5))).when(word(3) == "as", word(4))
    stars = F.when(shape == "*", F.array(row(F.coalesce(star_name, F.lit("*")), F.when(star_name.isNotNull(), "namespace-reexport").otherwise("star"), typed, F.col("line"))))
    in_list = F.transform("elements", lambda e: row(F.element_at(F.split(e, " "), -1), F.when(F.col("from_at") > 0, "reexport").otherwise("export-list"), typed | e.rlike(_TYPE_ELEMENT), F.col("line")))
    lists = F.when(shape == "{", in_list)
    return c.select("path", F.explode(F.concat("declared", "default", F.coalesce(stars, lists, F.array().cast(c.schema["default"].dataType)))).alias("x")).select("path", "x.*")


def _opening() -> Column:
    return F.col("text").isin("(", "[", "{")


def _by_depth():
    """Brackets of one depth alternate between opening and closing, so that a bracket's partner is its neighbour here."""
    return Window.partitionBy("path", "depth", "_bracket").orderBy("at")


def _sites(found: DataFrame, also: Column | None = None, counts: dict[str, Column] | None = None) -> DataFrame:
    """Tokens of ``_declared``, with their owner; ``is_call`` marks the opening bracket of a call. Brackets alone where ``also`` asks for no others; else a bracket has its neighbours
    at its depth (one before a closing one is its partner; of a block behind brackets these are the two before), and an opening one what is counted inside it as ``n_``."""
    w = _by_depth()
    t = _declared(found, also, members=True, counts=counts).withColumn("_bracket", _bracket())
    t = t.withColumn("_site", (F.col("text") == "(") & (F.col("prev_kind") == "name") & ~F.col("_is_member"))
    owner = F.when((F.col("declares") == "function") & (F.col("depth") > 0), F.col("owner_name")).when((F.col("declares") == "variable") & F.col("is_function"), F.col("owner_name")).when((F.col("declares") == "class") & (F.col("depth") > 1), F.col("method"))
    t = t.withColumn("owner", owner)
    near = {"_after": F.lead("next").over(w)}
    if also is None:
        t = t.where("_bracket").select("path", "at", "depth", "_bracket", "text", "prev", "prev_line", "next", "second", "third", "_site", "owner")
    else:
        t = t.withColumn("_word", F.when(F.col("prev") == "await", F.col("second")).otherwise(F.col("prev")))
        lags = {"_word": (1, 2, 3), "second": (2, 3), "prev_line": (2,), "text": (1,), "prev": (1,)}
        near |= {f"{c.removeprefix('_')}_{n}": F.lag(c, n).over(w) for c, ns in lags.items() for n in ns} | {"closes_at": F.lead("at").over(w)}
        near |= {f"n_{n.removeprefix('_sum_')}": F.when(_opening(), F.lead(n).over(w) - F.col(n)) for n in counts or {}}
    t = t.withColumns(near)
    declared = (F.col("second") == "function") | (F.col("second") == "*") & (F.col("third") == "function") | (F.col("_after") == "{")
    good = F.col("_site") & ~F.coalesce(declared, F.lit(False)) & ~F.col("prev").isin(*_NO_CALLEE)
    return t.withColumn("is_call", F.coalesce(good, F.lit(False)))


def _called(sites: DataFrame, *more: str) -> DataFrame:
    return sites.where("is_call").select("path", "at", "owner", F.col("prev").alias("callee"), F.coalesce(F.col("second") == "new", F.lit(False)).alias("is_new"), F.col("prev_line").alias("line"), *more)


def calls(found: DataFrame) -> DataFrame:
    """(path, at, owner, callee, is_new, line): calls and constructions with the function that holds them: a function of the module, a variable that is one, or a class's method; null at the module's top.

    What declares a method is no call: in a class or an interface a name where a member is due, elsewhere a name whose brackets are followed by a body.
    """
    return _called(_sites(found))


# the word before a block, or before the brackets in front of it, by what the block is
_BLOCKS = {"in_loop": ("for", "while", "do"), "in_condition": ("if", "else", "switch"), "in_try": ("try",)}
_QUERY_HOOK = r"^use(Query|Mutation|InfiniteQuery|SuspenseQuery)$"


def _word(*texts: str) -> Column:
    return (F.col("kind") == "name") & F.col("text").isin(*texts)


def _in_context(found: DataFrame, also: Column) -> DataFrame:
    """Sites with the blocks around each token and with what lies between a bracket and its partner.

    A block's opening bracket adds one to the running count of its sort and its partner takes it away, so that nesting of any depth
    costs one pass; counts inside brackets are differences of running counts. Tokens are sorted by depth once, and back once.
    """
    so_far = {"_sum_throws": _word("throw"), "_sum_rejects": _word("Promise.reject") & (F.col("next") == "("), "_sum_bounds": _word("concurrency") & (F.col("next") == ":")}
    t = _sites(found, also, so_far)

    def flags(text: str, prev: str, head: Column, before: Column) -> dict[str, Column]:
        block = F.col(text) == "{"
        on = {name: block & head.isin(*words) for name, words in _BLOCKS.items()}
        on["in_callback"] = block & (F.col("depth") > 0) & ((F.col(prev) == "=>") | (head == "function") | (before == "function"))
        on["in_query_hook"] = (F.col(text) == "(") & F.col(prev).rlike(_QUERY_HOOK)
        return {n: F.coalesce(c, F.lit(False)).cast("int") for n, c in on.items()}

    behind = lambda prev, c, otherwise=None: F.when(F.col(prev) == ")", F.col(c)).otherwise(otherwise)
    t = t.withColumns({"head": behind("prev", "word_2", F.col("prev")), "head_line": behind("prev", "prev_line_2", F.col("prev_line"))})
    begins = flags("text", "prev", F.col("head"), behind("prev", "second_2"))
    ends = flags("text_1", "prev_1", behind("prev_1", "word_3", F.col("prev_1")), behind("prev_1", "second_3"))
    t = t.withColumns({f"_{n}": c for n, c in begins.items()} | {f"_step_{n}": F.when(F.col("_bracket"), F.when(_opening(), c).otherwise(-ends[n])).otherwise(0) for n, c in begins.items()})
    conditions = F.col("text").isin("&&", "||", "?") & (F.col("kind") == "op") & (F.col("depth") > 0)
    around = {n: F.sum(f"_step_{n}").over(_before()) - F.col(f"_{n}") for n in begins}
    t = t.withColumns(around | {"_condition_line": F.last(F.when(conditions, F.col("line")), True).over(_before()), "_before_brackets": F.lag("word_1").over(_window())})
    leaves = _word("return") & ((F.col("in_condition") > 0) | (behind("prev", "_before_brackets", F.col("prev")) == "if"))
    t = t.withColumn("_left", _last(leaves & (F.col("in_callback") == 0)))
    return t.withColumns({"after_return": _is_here("_left"), "on_condition": F.coalesce(F.col("_condition_line") == F.col("line"), F.lit(False))})


def signals(found: DataFrame) -> DataFrame:
    """(path, family, owner, callee, kinds, line): what functions do at the borders of an effect system and of rendering; kinds are sorted.

    Families of calls are conditions on one row, with what else its owner calls as a window over the owner's calls. Loops that await
    are found at their block's bracket, assignments to global objects and definitions inside components at their own tokens.
    """
    is_name = F.col("kind") == "name"
    sets_global = is_name & F.col("text").rlike(r"^(window|document|localStorage)(\.|$)") & (F.col("next") == "=")
    defines = is_name & F.col("prev").isin("function", "const", "let", "var")
    words = is_name & F.col("text").isin("throw", "return", "await", "concurrency", "Promise.reject") | (F.col("kind") == "op") & F.col("text").isin("&&", "||", "?")
    t = _in_context(found, words | sets_global | defines)
    shown = F.coalesce(F.col("exported") & F.col("owner").rlike("^([A-Z]|use[A-Z0-9])") & (F.col("in_callback") == 0), F.lit(False))
    assigned = shown & sets_global & (F.col("next_two") != "=")
    inner = shown & defines & (F.col("depth") == 1) & F.col("text").rlike("^([A-Z][a-z]|use[A-Z0-9])")
    what = F.when(F.col("is_call"), "call").when(F.col("_in_loop") == 1, "loop").when(assigned, "assigned").when(inner, "inner")
    t = t.withColumns({"shown": shown, "what": F.when(_word("await"), "await").when(F.col("owner").isNotNull(), what)}).where("what IS NOT NULL")
    # a loop awaits if the next await of the function itself, at its own level of callbacks, comes before its end
    level = Window.partitionBy("path", "in_callback").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("_awaits_at", F.last(F.when(F.col("what") == "await", F.col("at")), True).over(level))
    t = t.where("what <> 'await' AND (what <> 'loop' OR _awaits_at < closes_at)")
    # the few rows that matter; windows over an owner's calls come after
    c = t.select(
        "path", "owner", "what", "shown", "next", "n_throws", "n_rejects", "n_bounds", "in_loop", "in_condition", "in_try", "in_query_hook", "after_return", "on_condition",
        F.when(F.col("what") == "call", F.col("prev")).when(F.col("what") == "loop", F.col("head")).when(F.col("what") == "assigned", F.element_at(F.split("text", r"\."), 1)).otherwise(F.col("text")).alias("callee"),
        F.when(F.col("what") == "call", F.col("prev_line")).when(F.col("what") == "loop", F.col("head_line")).otherwise(F.col("line")).alias("line"), F.coalesce(F.col("second") == "new", F.lit(False)).alias("is_new"),
    )
    own = Window.partitionBy("path", "owner")
    callee, method, call = F.col("callee"), F.element_at(F.split("callee", r"\."), -1), F.col("what") == "call"
    has = lambda pattern: F.max(call & callee.rlike(pattern)).over(own)
    c = c.withColumns({"_scoped": has(r"^Effect\.scoped$"), "_decodes": has(DECODES), "_observed": has(OBSERVES), "_resilient": has(RESILIENT)})
    kinds = lambda *pairs: F.array_sort(F.array_compact(F.array(*[F.when(c, n) for n, c in pairs])))
    uses = callee == "use"
    interop = kinds(("async-callback", F.col("next") == "async"), ("throws", F.col("n_throws") > 0), ("rejects", F.col("n_rejects") > 0))
    lacking = kinds(("observability", ~F.col("_observed")), ("resilience", ~F.col("_resilient")))
    hook = kinds(("conditional", ~uses & ((F.col("in_condition") > 0) | F.col("on_condition"))), ("loop", ~uses & (F.col("in_loop") > 0)), ("try", F.col("in_try") > 0), ("after-return", ~uses & F.col("after_return")))
    none = F.array().cast("array<string>")
    found_in = [
        ("runtime-call", callee.rlike(_RUNS), kinds(("query-hook", F.col("in_query_hook") > 0))), ("promise-interop", (callee == "Effect.promise") & (F.size(interop) > 0), interop), ("resource-scope", (callee == "Effect.acquireRelease") & ~F.col("_scoped"), none),
        ("concurrency", callee.isin(*PROMISE_COMBINATORS), F.array(F.lit("promise-combinator"))), ("concurrency", callee.isin(*EFFECT_COLLECTIONS) & (F.col("n_bounds") == 0), F.array(F.lit("unbounded-collection"))),
        ("schema-boundary", ((callee == "JSON.parse") | (method == "json")) & ~F.col("_decodes"), F.array(F.lit("unvalidated-json"))), ("production-boundary", callee.isin(*EXTERNAL_IO) & (F.size(lacking) > 0), lacking),
        ("render-purity", F.col("shown") & (callee.isin(*IMPURE_CALLS) | F.col("is_new") & (callee == "Date")), F.array(F.lit("impure-call"))), ("hook-call", F.col("shown") & method.rlike("^use([A-Z0-9]|$)") & (F.size(hook) > 0), hook),
    ]
    in_calls = [F.when(call & on, F.struct(F.lit(f).alias("family"), k.alias("kinds"))) for f, on, k in found_in]
    one = lambda name, family, kind: F.when(F.col("what") == name, F.struct(F.lit(family).alias("family"), F.array(kind).alias("kinds")))
    others = [one("loop", "concurrency", F.lit("await-in-loop")), one("assigned", "render-purity", F.lit("global-assignment")), one("inner", "static-definition", F.when(callee.rlike("^[A-Z]"), "component").otherwise("hook"))]
    rows = c.withColumn("x", F.explode(F.array_compact(F.array(*in_calls, *others))))
    return rows.select("path", "x.family", "owner", "callee", "x.kinds", "line")


def flow_counts(found: DataFrame) -> DataFrame:
    """(path, owner, branches, loops, awaits, depth): by declared function, its branch words and logical operators, loops, awaits and the deepest bracket inside it."""
    is_word = F.col("kind") == "name"
    branch = F.col("text").isin("if", "case", "catch", "&&", "||", "??") & F.col("kind").isin("name", "op") | (F.col("text") == "?") & ~F.col("next").isin(":", ",", ")", "=")
    loop, waits = is_word & F.col("text").isin("for", "while", "do"), is_word & (F.col("text") == "await")
    t = _declared(found, branch | loop | waits).where(F.col("declares").isin("function", "variable") & F.col("is_function"))
    depth = F.col("depth") + (F.col("text").isin("(", "[", "{") & ~F.col("next").isin(")", "]", "}")).cast("int")  # of what a bracket holds, if it holds a token
    count = lambda c: F.count_if(c).alias
    each = t.groupBy("path", "statement").agg(F.max("owner_name").alias("owner"), count(branch)("branches"), count(loop)("loops"), count(waits)("awaits"), F.max(F.coalesce(depth, "depth")).alias("depth"))
    return each.groupBy("path", "owner").agg(*[F.sum(c).cast("int").alias(c) for c in ("branches", "loops", "awaits")], F.max("depth").alias("depth"))


def runtime_calls(called: DataFrame) -> DataFrame:
    """Calls that run an effect: a run method of Effect, of Runtime or of a value named after a runtime."""
    return called.where(F.col("callee").rlike(_RUNS))


def combinators(called: DataFrame) -> DataFrame:
    """Calls that wait for several promises."""
    return called.where(F.col("callee").isin(*PROMISE_COMBINATORS))


def unvalidated_json(called: DataFrame) -> DataFrame:
    """Calls that parse JSON in an owner without a call that decodes by a schema; one window by file and owner over these two sorts of calls, so that texts are cut once."""
    parses = (F.col("callee") == "JSON.parse") | F.col("callee").rlike(r"\.json$")
    t = called.withColumns({"_parses": parses, "_decodes": F.col("callee").rlike(DECODES)}).where("_parses OR _decodes")
    t = t.withColumn("_decoded", F.max("_decodes").over(Window.partitionBy("path", "owner")))
    return t.where("_parses AND NOT _decoded").drop("_parses", "_decodes", "_decoded")


def numbered_signals(found: DataFrame) -> DataFrame:
    """Signals as the rules read them: ``seq`` numbers those of a file, by line."""
    return found.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("line", "family", "callee")) - 1).alias("seq"), "family", F.col("owner").alias("owner_name"), "callee", "kinds", "line")


FAMILIES = {"imports": imports, "exports": exports, "items": items, "calls": calls, "flow_counts": flow_counts, "signals": signals}


def facts(files: DataFrame) -> dict[str, DataFrame]:
    """Every family over ``files`` (path, content), by name; the tokens are written to the shared folder once, and each family reads them there."""
    found = stored(tokens(files))
    return {"tokens": found} | {name: family(found) for name, family in FAMILIES.items()}
