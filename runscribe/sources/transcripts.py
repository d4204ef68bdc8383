"""Transcripts in several shapes to ordered lines: (transcript_id, line_no, text)."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Keys that may hold a record's text, words of memory records, and the marks that lines carry.
TEXT_KEYS = ["content", "text", "message", "output", "data"]
MEMORY_WORDS = ["memory_block", "<memory>", "auto-memory", "claude_memory"]
MANAGED_WORDS = ["managed_memory_v1", "agent_memory", "parent_agent_id"]
PULL_WORDS = ["read", "pull", "fetch", "load", "get", "retrieve"]
PUSH_WORDS = ["write", "push", "store", "save", "set", "commit", "append"]
OPERATION_KEYS = ["op", "operation", "direction", "action", "event", "type"]
MEMORY_MARK, PULL_MARK, PUSH_MARK, SESSION_MARK = "[system-memory] ", "[managed-memory-pull] ", "[managed-memory-push] ", "--- session break ---"


BODY_KEYS = ["content", "text", "snippet", "value"]
#: What ends a line of text.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


#: A file's name and time, as columns that a file source has hidden.
_META = ["_metadata.file_path AS transcript_id", "_metadata.file_name AS name", "_metadata.file_modification_time AS modified"]


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """transcript_id (file), name, modified, value: a file a row."""
    return spark.read.text(path, wholetext=True).selectExpr(*_META, "value")


#: A physical line's number stands above these bits of line_no; below are the lines that rarer line ends cut it into.
SUB_LOG2 = 22
#: Physical lines of a chunk: what is ordered in one task at most.
CHUNK_LOG2 = 16


def _cut(rows: DataFrame, number: Column, *keep: str) -> DataFrame:
    """Rows of whole lines to transcript_id, line_no, raw: cut at all line ends, without blank ones."""
    cut = rows.select("transcript_id", *keep, number.alias("_n"), F.posexplode(F.split("value", LINE_ENDS)).alias("_sub", "raw"))
    return cut.select("transcript_id", *keep, (F.shiftleft(F.col("_n").cast("long"), SUB_LOG2) + F.col("_sub")).alias("line_no"), strip("raw").alias("raw")).where("raw <> ''")


def records_of(files: DataFrame) -> DataFrame:
    """(transcript_id, value: a whole text) -> transcript_id, line_no, raw: the lines that aren't blank; line_no orders them."""
    lines = files.select("transcript_id", F.posexplode(F.split("value", r"\r\n|[\n\r]")).alias("at", "value"))
    return _cut(lines, F.col("at"))


def raw_records(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """transcript_id (file), name, modified, line_no, raw: the lines of text files that aren't blank; line_no orders a file's.

    Files are read in splits, so one of any size is many tasks.  A first scan counts the lines of each block; a line's number is
    its place in its block behind the lines of the file's blocks before.  Both scans split alike, as splits follow from sizes and settings.
    """
    files = (spark.read if pattern is None else spark.read.option("pathGlobFilter", pattern)).text(path)
    rows = files.selectExpr(*_META, "_metadata.file_block_start AS start", "monotonically_increasing_id() AS at", "value")
    blocks = rows.groupBy("transcript_id", "start").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("transcript_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("transcript_id", "start", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return _cut(rows.join(offsets, ["transcript_id", "start"]), F.col("at") + F.col("shift"), "name", "modified")


def strip(name: str | Column) -> Column:
    return F.regexp_replace(name, r"(?U)^\s+|\s+$", "")


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _string(v: Column, path: str) -> Column:
    """The value if it is a JSON string, else null."""
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def _duration(v: Column, path: str) -> Column:
    ms = F.when(_kind(v, path) == "BIGINT", F.try_variant_get(v, path, "bigint"))
    return F.when(ms >= 0, ms)


def jsonl_lines(records: DataFrame) -> DataFrame:
    """A record's text is the first of TEXT_KEYS that is a string; else, and if it isn't JSON, the raw line.  A whole duration makes a line of its own behind it."""
    v = F.when(F.col("raw").startswith("{"), F.try_parse_json("raw"))
    text = F.coalesce(*[_string(v, f"$.{k}") for k in TEXT_KEYS], F.col("raw"))
    ms = _duration(v, "$.duration_ms")
    mark = F.when(ms.isNotNull(), F.concat(F.lit("[tool_duration_ms: "), ms.cast("string"), F.lit("]")))
    return _numbered(records.select("transcript_id", "line_no", F.posexplode(F.array_compact(F.array(text, mark))).alias("part", "text")))


def _carried(rows: DataFrame, summary: Column, fold: Column) -> DataFrame:
    """``rows`` (transcript_id, line_no, ...) with chunk and ``carried``: what ``fold`` makes of the chunks before.

    ``summary`` sums a chunk up as ``told``; ``fold`` goes over ``told`` of a transcript's earlier chunks in order.  Only chunks are
    ordered by transcript; rows are never in one task by transcript.
    """
    rows = rows.withColumn("chunk", F.shiftright(F.col("line_no").cast("long"), SUB_LOG2 + CHUNK_LOG2))
    chunks = rows.groupBy("transcript_id", "chunk").agg(summary.alias("told"))
    earlier = Window.partitionBy("transcript_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = chunks.select(F.col("transcript_id").alias("_t"), F.col("chunk").alias("_c"), fold.over(earlier).alias("carried"))
    return rows.join(before, F.col("transcript_id").eqNullSafe(F.col("_t")) & (F.col("chunk") == F.col("_c"))).drop("_t", "_c")


def _numbered(parts: DataFrame) -> DataFrame:
    """transcript_id, line_no, text of (transcript_id, line_no, part, text): numbered from 0 without gaps, chunk by chunk."""
    n = F.row_number().over(Window.partitionBy("transcript_id", "chunk").orderBy("line_no", "part")) - 1
    rows = _carried(parts, F.count("*"), F.sum("told"))
    return rows.select("transcript_id", (n + F.coalesce("carried", F.lit(0))).cast("int").alias("line_no"), "text")


def _any_word(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def _object(raw: Column) -> Column:
    """The JSON object of a record, null where it is none."""
    v = F.when(raw.startswith("{"), F.try_parse_json(raw))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def _managed_mark(v: Column, low: Column) -> Column:
    """The mark of a managed-memory record: by the first operation field that says push or pull, else by its body."""
    said = []
    for k in OPERATION_KEYS:
        value = F.lower(_string(v, f"$.{k}"))
        said.append(F.when(_any_word(value, PUSH_WORDS), PUSH_MARK).when(_any_word(value, PULL_WORDS), PULL_MARK))
    return F.coalesce(*said, F.when(_any_word(low, PUSH_WORDS), PUSH_MARK).otherwise(PULL_MARK))


def _record_texts(v: Column, raw: Column) -> Column:
    """The first of TEXT_KEYS that is a text that isn't empty or a list ends the search; a list gives its blocks' texts, which may be none."""
    found = []
    for k in TEXT_KEYS:
        kind = _kind(v, f"$.{k}")
        text = F.when(kind == "STRING", F.try_variant_get(v, f"$.{k}", "string"))
        blocks = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, f"$.{k}", "array<variant>"))
        each = F.transform(blocks, lambda b: F.when(F.schema_of_variant(b).startswith("OBJECT"), F.coalesce(_string(b, "$.text"), _string(b, "$.content"))))
        found += [F.when(text != "", F.array(text)), F.filter(each, lambda x: x.isNotNull())]
    return F.coalesce(*found, F.array(raw))


def native_lines(records: DataFrame) -> DataFrame:
    """Like :func:`jsonl_lines`, with lists of content blocks flattened and memory records marked.

    Memory state: a record that speaks of memory enters; a user record always leaves, other speakers leave
    when they don't speak of it; lines inside are marked.  Managed memory is marked by its operation instead.
    """
    raw = F.col("raw")
    v = _object(raw)
    low = F.lower("raw")
    role = _string(v, "$.role")
    managed = v.isNotNull() & _any_word(low, MANAGED_WORDS)
    speaks = v.isNotNull() & _any_word(low, MEMORY_WORDS)
    event = F.when(role == "user", 0).when(speaks, 1).when(role.isin("assistant", "tool"), 0)
    # a record keeps the state or sets it, so what a chunk does to it is its last setting
    records = _carried(records.withColumn("_event", event), F.max_by("_event", F.when(F.col("_event").isNotNull(), F.col("line_no"))), F.last("told", ignorenulls=True))
    here = F.last("_event", ignorenulls=True).over(Window.partitionBy("transcript_id", "chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    inside = F.coalesce(here, "carried")
    ms = F.coalesce(_duration(v, "$.duration_ms"), _duration(v, "$.hookSpecificOutput.duration_ms"))
    timing = F.when(ms.isNotNull(), F.array(F.concat(F.lit("[tool_duration_ms: "), ms.cast("string"), F.lit("]")))).otherwise(F.array().cast("array<string>"))
    mark = F.when(managed, _managed_mark(v, low)).when((inside == 1) & v.isNotNull(), F.lit(MEMORY_MARK)).otherwise(F.lit(""))
    rows = records.select("transcript_id", "line_no", F.when(v.isNull(), F.array(raw)).otherwise(_record_texts(v, raw)).alias("texts"), mark.alias("mark"), timing.alias("timing"))
    parts = F.concat(F.transform("texts", lambda t: F.concat(F.col("mark"), t)), F.col("timing"))
    return _numbered(rows.select("transcript_id", "line_no", F.posexplode(parts).alias("part", "text")))


def retagged(lines: DataFrame) -> DataFrame:
    """Marks managed-memory records among lines that are JSON text still; marked lines and all others stay as they are."""
    text = F.col("text")
    line = strip("text")
    v = F.when(~text.startswith(PULL_MARK) & ~text.startswith(PUSH_MARK) & line.endswith("}"), _object(line))
    body = F.coalesce(*[F.when(_string(v, f"$.{k}") != "", _string(v, f"$.{k}")) for k in BODY_KEYS], line)
    low = F.lower(line)
    return lines.withColumn("text", F.when(v.isNotNull() & _any_word(low, MANAGED_WORDS), F.concat(_managed_mark(v, low), body)).otherwise(text))


def _truthy(v: Column, path: str) -> Column:
    """The text at ``path`` if it is one that isn't empty."""
    return F.when(_string(v, path) != "", _string(v, path))


def spaced(compact: Column) -> Column:
    """Compact JSON text as Python's ``json.dumps`` writes it: a blank behind : and , outside of strings, and ASCII only."""
    blanks = F.regexp_replace(compact, r'\G((?:[^":,]|"(?:[^"\\]|\\.)*+")*+)([:,])', "$1$2 ")

    def escaped(c: Column) -> Column:
        n = F.ascii(c)
        unit = lambda x: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(x)), 4, "0"))
        return F.when(n < 128, c).when(n < 0x10000, unit(n)).otherwise(F.concat(unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), unit(F.lit(0xDC00) + n % 0x400)))

    tokens = F.regexp_extract_all(blanks, F.lit(r"\\u[0-9A-F]{4}|\\.|[^\\]+"), F.lit(0))  # hex digits of escapes are small there
    small = F.when(blanks.contains("\\u"), F.array_join(F.transform(tokens, lambda t: F.when(t.startswith("\\u"), F.lower(t)).otherwise(t)), "")).otherwise(blanks)
    return F.when(small.rlike("[^\\x00-\\x7f]"), F.array_join(F.transform(F.split(small, ""), escaped), "")).otherwise(small)


def _message_texts(m: Column, source: Column, path: Column) -> Column:
    """Texts of a chat message: its content, parts flattened (``text``, else ``content``), then a line for each tool call.

    ``m`` stands at ``path`` of the JSON text ``source``; arguments that are no text are read from there, where keys keep their order.
    """
    none = F.array().cast("array<string>")
    blocks = F.when(_kind(m, "$.content").startswith("ARRAY"), F.try_variant_get(m, "$.content", "array<variant>"))
    each = F.transform(blocks, lambda b: F.when(F.schema_of_variant(b) == "STRING", F.nullif(b.cast("string"), F.lit(""))).otherwise(F.coalesce(_truthy(b, "$.text"), _truthy(b, "$.content"))))
    calls = F.when(_kind(m, "$.tool_calls").startswith("ARRAY"), F.try_variant_get(m, "$.tool_calls", "array<variant>"))

    def call(c: Column, i: Column) -> Column:
        at = F.concat(path, F.lit(".tool_calls["), i.cast("string"), F.lit("].function.arguments"))
        other = spaced(F.call_function("get_json_object", source, at))
        other = F.when(F.coalesce(other, F.lit("")).isin("", "[]", "{}", "0", "0.0", "false", "null"), "{}").otherwise(other)
        given = F.when(_kind(c, "$.function.arguments") == "STRING", _string(c, "$.function.arguments")).otherwise(other)
        return F.concat(F.lit("tool_use: "), _truthy(c, "$.function.name"), F.lit("("), given, F.lit(")"))

    own = F.when(_truthy(m, "$.content").isNotNull(), F.array(_truthy(m, "$.content"))).otherwise(F.coalesce(each, none))
    return F.filter(F.concat(own, F.coalesce(F.transform(calls, call), none)), lambda t: t.isNotNull())


def chat_lines(files: DataFrame) -> DataFrame:
    """(transcript_id, value): a JSON array of messages, an object with ``messages``, or one message a line."""
    v = F.try_parse_json("value")
    listed = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(_kind(v, "$.messages").startswith("ARRAY"), F.try_variant_get(v, "$.messages", "array<variant>"))
    root = F.when(F.schema_of_variant(v).startswith("ARRAY"), "$").otherwise("$.messages")
    texts = F.transform(listed, lambda m, i: _message_texts(m, F.col("value"), F.concat(root, F.lit("["), i.cast("string"), F.lit("]"))))
    by_line = F.transform(F.split("value", LINE_ENDS), lambda x: _message_texts(_object(strip(x)), strip(x), F.lit("$")))
    rows = files.select("transcript_id", F.posexplode(F.coalesce(texts, by_line)).alias("line_no", "texts"))
    return _numbered(rows.select("transcript_id", "line_no", F.posexplode("texts").alias("part", "text")))


def markdown_lines(files: DataFrame) -> DataFrame:
    """(transcript_id, value): lines that aren't blank, without blanks at either end."""
    return _numbered(records_of(files).select("transcript_id", "line_no", F.lit(0).alias("part"), F.col("raw").alias("text")))


def codex_lines(files: DataFrame) -> DataFrame:
    """(transcript_id, name, value): files called .json or .jsonl are chats, all others text."""
    is_chat = F.lower("name").rlike(r"\.jsonl?$")
    return chat_lines(files.where(is_chat)).unionByName(markdown_lines(files.where(~is_chat)))


def native_file_lines(files: DataFrame) -> DataFrame:
    return retagged(native_lines(records_of(files)))


ADAPTERS = {
    "claude-code": native_file_lines,
    "codex": codex_lines,
    "cowork": native_file_lines,
    "openai-compatible": chat_lines,
    "cursor": chat_lines,
    "continue": chat_lines,
}
DEFAULT_ADAPTER = "claude-code"


def adapted_lines(files: DataFrame, adapter: str | None = None) -> DataFrame:
    """(transcript_id, name, value) -> lines by a named adapter; without a name, and with a warning for an unknown one, the built-in reading."""
    if adapter is not None and adapter not in ADAPTERS:
        warnings.warn(f"unknown adapter {adapter!r}; using the built-in reading (there are {', '.join(sorted(ADAPTERS))})", stacklevel=2)
    return ADAPTERS.get(adapter, lambda f: jsonl_lines(records_of(f)))(files)


def folder_lines(spark: SparkSession, path: str) -> DataFrame:
    """All ``*.jsonl`` files of each folder as one transcript, by time of change and name, with a mark between them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(path).selectExpr(*_META)  # names only, also of empty files
    sessions = files.withColumn("group_id", F.regexp_replace("transcript_id", r"/[^/]*$", ""))
    return retagged(session_lines(native_lines(raw_records(spark, path, "*.jsonl").select("transcript_id", "line_no", "raw")), sessions))


def record_turns(records: DataFrame) -> DataFrame:
    """(transcript_id, line_no, raw) -> transcript_id, turn_no, role, text: user and assistant records of a JSON-lines transcript."""
    v = _object(F.col("raw"))
    role = F.lower(_string(v, "$.role"))
    kind = F.when(role.isin("user", "human"), "user").when(role.isin("assistant", "model", "ai"), "assistant")
    blocks = F.when(_kind(v, "$.content").startswith("ARRAY"), F.try_variant_get(v, "$.content", "array<variant>"))
    each = F.transform(blocks, lambda b: F.when(F.schema_of_variant(b) == "STRING", b.cast("string")).otherwise(F.coalesce(_truthy(b, "$.text"), _string(b, "$.content"))))
    text = F.coalesce(_string(v, "$.content"), F.array_join(F.filter(each, lambda x: x.isNotNull()), " "))
    rows = records.select("transcript_id", F.col("line_no").alias("turn_no"), kind.alias("role"), text.alias("text"))
    return rows.where(F.col("role").isNotNull() & (strip("text") != ""))


def session_lines(lines: DataFrame, sessions: DataFrame) -> DataFrame:
    """Lines of several session files as one transcript: (transcript_id, group_id, modified, name) orders the files, with a mark between them."""
    order = F.dense_rank().over(Window.partitionBy("group_id").orderBy("modified", "name"))
    ranked = sessions.withColumn("session_no", order)
    body = lines.join(ranked, "transcript_id").select("group_id", "session_no", F.lit(1).alias("step"), "line_no", "text")
    marks = ranked.where("session_no > 1").select("group_id", "session_no", F.lit(0).alias("step"), F.lit(0).alias("line_no"), F.lit(SESSION_MARK).alias("text"))
    n = F.row_number().over(Window.partitionBy("group_id").orderBy("session_no", "step", "line_no")) - 1
    return body.unionByName(marks).withColumn("n", n).select(F.col("group_id").alias("transcript_id"), F.col("n").alias("line_no"), "text")


def skill_of(records: DataFrame) -> DataFrame:
    """transcript_id, skill by the first of four marks that occurs; the last hit of the first three, the first of a slash command."""
    marks = [r".*skills/([a-zA-Z0-9_-]+)/SKILL\.md.*", r".*Skill tool invoked: ([a-zA-Z0-9_-]+).*", r'.*"skill":\s*"([a-zA-Z0-9_-]+)".*', r"^/([a-zA-Z0-9_-]+).*"]
    found = [F.nullif(F.regexp_extract("raw", p, 1), F.lit("")) for p in marks]
    best = [F.max_by(f, F.when(f.isNotNull(), F.col("line_no"))) for f in found[:3]] + [F.min_by(found[3], F.when(found[3].isNotNull(), F.col("line_no")))]
    return records.groupBy("transcript_id").agg(F.coalesce(*best).alias("skill"))


def resolve_rubrics(skills: DataFrame, rubrics: DataFrame) -> DataFrame:
    """skill, rubric: the longest rubric name that is the skill or the skill without trailing ``-parts``, else ``default``."""
    parts = F.split("skill", "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))
    tries = skills.select("skill", F.explode(prefixes).alias("name")).join(rubrics.select("name").withColumn("known", F.lit(1)), "name", "left")
    return tries.groupBy("skill").agg(F.coalesce(F.max_by(F.when(F.col("known") == 1, F.col("name")), F.when(F.col("known") == 1, F.length("name"))), F.lit("default")).alias("rubric"))


def model_of(records: DataFrame, prefix: str = "claude-") -> DataFrame:
    """transcript_id, model: the first id with ``prefix`` under a key that is ``model`` or ends in ``.model``, in lower case, without a trailing date."""
    found = F.nullif(F.regexp_extract("raw", rf'(?i)"(?:[\w.]+\.)?model"\s*:\s*"({prefix}[a-z0-9.\-]+)"', 1), F.lit(""))
    first = F.min_by(found, F.when(found.isNotNull(), F.col("line_no")))
    return records.groupBy("transcript_id").agg(F.regexp_replace(F.lower(first), r"-\d{8}$", "").alias("model"))


def rubric_criteria(rubrics: DataFrame) -> DataFrame:
    """(name, text) -> name, dim, criteria: each ``### Word`` heading with all lines up to the next one; of equal words the last counts."""
    whole = F.regexp_replace("text", LINE_ENDS, "\n")
    cut = F.filter(F.split(whole, r"(?mU)^(?=###[^\S\n]+\w)"), lambda b: b.rlike(r"(?U)\A###[^\S\n]+\w"))
    blocks = F.transform(cut, lambda b: F.struct(F.lower(F.regexp_extract(b, r"(?U)\A###[^\S\n]+(\w+)", 1)).alias("dim"), F.regexp_replace(b, r"\n\z", "").alias("criteria")))
    one = rubrics.select("name", blocks.alias("blocks"))
    last = F.filter("blocks", lambda b, i: ~F.exists(F.slice("blocks", i + 2, F.size("blocks")), lambda x: x["dim"] == b["dim"]))
    return one.select("name", F.explode(last).alias("b")).select("name", "b.*")


def checked_weights(sidecars: DataFrame, dimensions: list[str]) -> DataFrame:
    """(name, weights: map) of sidecars with exactly a weight a dimension that sum to 1; the others give none."""
    has_all = F.forall(F.array(*[F.lit(d) for d in dimensions]), lambda d: F.map_contains_key("weights", d))
    total = F.aggregate(F.array(*[F.col("weights")[d] for d in dimensions]), F.lit(0.0), lambda a, x: a + x)
    return sidecars.where(has_all & (F.abs(total - 1) <= 1e-6))


def rubric_weights(runs: DataFrame, sidecars: DataFrame, dimensions: list[str]) -> DataFrame:
    """(…, rubric) with ``weights`` of the rubric's sidecar, null where it has none that is valid."""
    good = checked_weights(sidecars, dimensions).select(F.col("name").alias("_rubric"), F.transform_values("weights", lambda k, w: w.cast("double")).alias("weights"))
    return runs.join(good, F.col("rubric") == F.col("_rubric"), "left").drop("_rubric")


CASE = (
    "struct<name: string, skill: string, transcript: string, adapter: string, expected_grade_min: string, expected_grade_max: string, expected_composite_min: double,"
    " expected_composite_max: double, expected_dimension_min: map<string, double>, expected_dimension_max: map<string, double>>"
)


def manifest_cases(files: DataFrame) -> DataFrame:
    """(manifest, value: JSON with ``cases``) -> manifest, case_index and the fields of each case; bounds that aren't there are null."""
    rows = files.select("manifest", F.posexplode(F.from_json("value", f"struct<cases: array<{CASE}>>")["cases"]).alias("case_index", "c"))
    renamed = {"grade_min": "expected_grade_min", "grade_max": "expected_grade_max", "low": "expected_composite_min", "high": "expected_composite_max", "lows": "expected_dimension_min", "highs": "expected_dimension_max"}
    return rows.select("manifest", "case_index", *[F.col(f"c.{c}") for c in ("name", "skill", "transcript", "adapter")], *[F.col(f"c.{c}").alias(n) for n, c in renamed.items()])


def standards_of(files: DataFrame, defaults: dict[str, float], composite: float = 7.5) -> DataFrame:
    """(source, value: markdown) -> source, dim, benchmark: rows ``| dimension | number |``, the last of a dimension, and the first
    ``composite`` with a number behind blanks and colons only; else the defaults."""
    row = r"(?U)\|\s*(\w+)\s*\|\s*(\d+(?:\.\d+)?)\s*\|"
    each = (F.regexp_extract_all("value", F.lit(row), F.lit(k)) for k in (1, 2))
    pairs = F.zip_with(*each, lambda dim, number: F.struct(F.lower(dim).alias("dim"), number.alias("number")))
    rows = files.select("source", pairs.alias("pairs"), F.nullif(F.regexp_extract("value", r"(?iU)composite[:\s]*(\d+(?:\.\d+)?)", 1), F.lit("")).cast("double").alias("composite"))
    own = lambda d: F.try_element_at(F.filter("pairs", lambda p: p["dim"] == d), F.lit(-1))["number"].cast("double")
    found = [F.struct(F.lit(d).alias("dim"), F.coalesce(own(d), F.lit(float(default))).alias("benchmark")) for d, default in defaults.items()]
    found.append(F.struct(F.lit("composite").alias("dim"), F.coalesce("composite", F.lit(float(composite))).alias("benchmark")))
    return rows.select("source", F.explode(F.array(*found)).alias("b")).select("source", "b.*")
