"""Agent transcripts (JSON lines of four sources) as typed entries, by VARIANT column expressions.

Discovery is a recursive listing by file name; lines keep their numbers; a line that is not JSON is a diagnostic,
not a failure. Every reader returns ENTRY_COLUMNS, whatever the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import images
from skein.functions.scalars import truncated_utf8

OUTCOME_BYTES = 4096
ENTRY_COLUMNS = ["path", "source_session_id", "is_subagent", "entry_id", "parent_id", "line_no", "entry_type", "timestamp", "role", "raw_json", "entry_sha256", "text", "tool_name", "command", "files_json", "tool_calls", "tool_results", "model", "provider",
                 "tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "cost", "participates_in_context", "first_kept", "cwd", "assets"]
_CALL = "struct<id: string, tool_name: string, command: string, files_json: string, ordinal: int>"
_ASSET = "struct<asset_sha256: string, asset_kind: string, content_index: int, prompt_order: int, raw_ref: string, mime_type: string, block_type: string, bytes: bigint, width: int, height: int>"
_RESULT = "struct<for_id: string, is_error: boolean, outcome_text: string, exit_code: bigint, ordinal: int>"


def lines(spark: SparkSession, root: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, source_session_id, is_subagent, line_no, raw) of the non-blank lines of all files below root."""
    found = numbered(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n").text(root))
    return named(found.where(~F.col("path").rlike(r"/\.[^/]+/")))


def lines_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """As `lines`, of files that are named; paths without a scheme are local."""
    return named(numbered(spark.read.option("lineSep", "\n").text(paths)))


def numbered(files: DataFrame) -> DataFrame:
    """(path, line_no, value) of text files read line by line, blank lines counted.

    A file of any size is read by splits. Lines are numbered within their split and follow on the lines of the
    file's earlier splits; a line that runs over a border belongs to the split in which it begins.
    """
    spark, split = files.sparkSession, ["path", "begin"]
    at = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin")]
    # smaller files are never split
    whole = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.openCostInBytes"))
    counts = files.where(F.col("_metadata.file_size") > whole).select(*at).groupBy(*split).agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(*split, F.coalesce(earlier, F.lit(0)).alias("before"))
    rows = files.select(*at, "value", F.monotonically_increasing_id().alias("place"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*split).orderBy("place")))
    return rows.join(before, split, "left").select("path", (F.coalesce("before", F.lit(0)) + F.col("n")).cast("int").alias("line_no"), "value")


def named(rows: DataFrame, file: Column | str = "path") -> DataFrame:
    """The non-blank ones of numbered lines, with what their file's name says of the session."""
    name = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.jsonl$", "")
    rows = rows.select("path", name.alias("source_session_id"), name.startswith("agent-").alias("is_subagent"), "line_no", F.regexp_replace("value", r"\r+$", "").alias("raw"))
    return rows.where(F.trim(F.regexp_replace("raw", r"[\t\f\x0b]", " ")) != "")


def parsed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("v", F.try_parse_json("raw"))


def objects(rows: DataFrame) -> DataFrame:
    """As parsed, the lines that are JSON objects: what was parsed is one if it begins as one."""
    return parsed(rows).where(F.col("v").isNotNull() & _braced())


def _braced() -> Column:
    return F.col("raw").startswith("{") | F.col("raw").rlike(r"^[ \t\r\n]+\{")


def diagnostics(rows: DataFrame) -> DataFrame:
    """(path, line_no) of lines that are not JSON objects."""
    return parsed(rows).where(F.col("v").isNull() | ~_braced()).select("path", "line_no")


def _once(value: Column, make) -> Column:
    """make(value), with value computed once: the one element of an array is its own variable."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _text(v: Column, path: str) -> Column:
    """A string or number at path; empty for anything else."""
    at = F.try_variant_get(v, f"$.{path}", "variant")
    kind = _kind(at)
    return F.when(kind.isin("STRING", "BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.coalesce(_get(v, path), F.lit(""))).otherwise("")


def _first(*options: Column) -> Column:
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def _flag(v: Column, *paths: str) -> Column:
    return F.coalesce(*[_truth(v, p) for p in paths])


def _truth(v: Column, path: str) -> Column:
    text = F.lower(F.trim(_get(v, path)))
    return F.when(text.isin("true", "1", "yes"), True).when(text.isNotNull(), False)


def _number(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "double"), F.lit(0.0)).cast("bigint")


def _blocks(at: Column) -> Column:
    """Content as an array of blocks; a plain string is one block."""
    return F.coalesce(at.try_cast("array<variant>"), F.when(at.isNull() | F.is_variant_null(at), F.array().cast("array<variant>")).otherwise(F.array(at)))


_RESULT_KINDS, _CALL_KINDS, _IMAGE_KINDS = ("tool_result", "toolResult"), ("tool_use", "toolCall"), ("image", "image_url")
_ITEM = "struct<v: variant, done: boolean, place: int>"
_FEW_STEPS = 4  # what a list of results with lists of texts takes


def _is(v: Column, *kinds: str) -> Column:
    """Whether a block is of one of the kinds."""
    return F.coalesce(_get(v, "type").isin(*kinds), F.lit(False))


def content_items(at: Column) -> Column:
    """The blocks of content of any depth in order: array<struct<v, done, place>>, place being that in its own array.

    Arrays give way to their elements; a result gives its content, then itself. One step opens all items that are
    still closed, and steps go on until none is, at most one for each bracket and each content of the text; a step
    without anything to open costs nothing.
    """
    item = lambda v, done, place: F.struct(v.alias("v"), F.lit(done).alias("done"), place.cast("int").alias("place"))

    def opened(x: Column) -> Column:
        inner = F.try_variant_get(x["v"], "$.content", "variant")
        whole = F.array(item(x["v"], True, x["place"]))
        # null for all but arrays
        each = F.transform(x["v"].try_cast("array<variant>"), lambda v, i: item(v, False, i))
        result = F.when(_is(x["v"], *_RESULT_KINDS) & inner.isNotNull(), F.concat(F.array(item(inner, False, x["place"])), whole))
        return F.when(x["done"], F.array(x)).otherwise(F.coalesce(each, result, whole)).cast(f"array<{_ITEM}>")

    def step(state: Column, _: Column) -> Column:
        following = F.flatten(F.transform(state["items"], opened))
        # the items are a variable, so that they are computed once
        moved = _once(following, lambda items: F.struct(items.alias("items"), F.exists(items, lambda x: ~x["done"]).alias("open")))
        return F.when(state["open"], moved).otherwise(state)

    text = F.coalesce(F.to_json(at), F.lit(""))
    most = 2 + F.octet_length(text) - F.octet_length(F.replace(text, F.lit("["))) + F.regexp_count(text, F.lit('"content"'))
    first = F.array(item(at, False, F.lit(0))).cast(f"array<{_ITEM}>")
    few = F.aggregate(F.array(*map(F.lit, range(_FEW_STEPS))), F.struct(first.alias("items"), F.lit(True).alias("open")), step)
    # the text is written out only for what is still open then
    done = _once(few, lambda state: F.when(state["open"], F.aggregate(F.sequence(F.lit(1), most), state, step)).otherwise(state))
    return F.when(at.isNull() | F.is_variant_null(at), F.array().cast(f"array<{_ITEM}>")).otherwise(done["items"])


def items_text(items: Column) -> Column:
    """Texts of blocks, a line each: strings and the text of all blocks but calls, results and images."""
    silent = lambda v: _text(v, "type").isin(*_CALL_KINDS, *_RESULT_KINDS, *_IMAGE_KINDS)
    said = F.transform(items, lambda x: F.when(_kind(x["v"]) == "STRING", x["v"].try_cast("string")).when(_kind(x["v"]).startswith("OBJECT") & ~silent(x["v"]), _text(x["v"], "text")).otherwise(""))
    return F.trim(F.array_join(F.filter(said, lambda s: s != ""), "\n"))


def content_text(at: Column) -> Column:
    return items_text(content_items(at))


def _of_type(items: Column, *kinds: str) -> Column:
    return F.transform(F.filter(items, lambda x: _is(x["v"], *kinds)), lambda x: x["v"])


def items_calls(items: Column) -> Column:
    def call(b: Column, i: Column) -> Column:
        return _once(F.coalesce(F.try_variant_get(b, "$.input", "variant"), F.try_variant_get(b, "$.arguments", "variant")), lambda given: told(b, i, given))

    def told(b: Column, i: Column, given: Column) -> Column:
        return F.struct(_text(b, "id").alias("id"), _first(_text(b, "name"), _text(b, "toolName")).alias("tool_name"), _first(_text(given, "command"), _text(given, "cmd"), _text(b, "command")).alias("command"), F.coalesce(F.to_json(given), F.lit("")).alias("files_json"), i.alias("ordinal")).cast(_CALL)
    return F.transform(_of_type(items, *_CALL_KINDS), call)


def content_calls(at: Column) -> Column:
    return items_calls(content_items(at))


def _result_text(at: Column) -> Column:
    """What a result shows: its text, or the texts one level below."""
    below = F.transform(_blocks(at), lambda b: F.when(_kind(b) == "STRING", b.try_cast("string")).otherwise(_text(b, "text")))
    return F.when(_kind(at).startswith("OBJECT"), "").otherwise(F.trim(F.array_join(F.filter(below, lambda s: s != ""), "\n")))


def items_results(items: Column) -> Column:
    def result(b: Column, i: Column) -> Column:
        text = _once(F.try_variant_get(b, "$.content", "variant"), _result_text)
        code = F.coalesce(_get(b, "exit_code", "bigint"), _get(b, "exitCode", "bigint"))
        error = F.coalesce(_truth(b, "is_error"), F.lit(False)) | F.coalesce(_truth(b, "isError"), F.lit(False)) | F.coalesce(code != 0, F.lit(False))
        return F.struct(_first(_text(b, "tool_use_id"), _text(b, "toolCallId")).alias("for_id"), error.alias("is_error"), _once(text, lambda t: truncated_utf8(t, OUTCOME_BYTES)).alias("outcome_text"), code.alias("exit_code"), i.alias("ordinal")).cast(_RESULT)
    return F.transform(_of_type(items, *_RESULT_KINDS), result)


def content_results(at: Column) -> Column:
    return items_results(content_items(at))


def items_assets(items: Column) -> Column:
    """Images among blocks: by their kind, or any other block with a source that has a type or data.

    Data is base64, in the source or the block; an asset is named by the hash of its bytes, without data by that of
    its address or block. The bytes stay in the transcript.
    """
    silent = (*_CALL_KINDS, *_RESULT_KINDS, "text")

    def is_asset(x: Column) -> Column:
        kind, v = _text(x["v"], "type"), x["v"]
        return kind.isin(*_IMAGE_KINDS) | (_kind(v).startswith("OBJECT") & ~kind.isin(*silent) & ((_text(v, "source.media_type") != "") | (_text(v, "source.data") != "")))

    def asset(x: Column, i: Column) -> Column:
        v = x["v"]
        given = lambda path: F.try_to_binary(F.nullif(_text(v, path), F.lit("")), F.lit("base64"))
        mime = _first(_text(v, "source.media_type"), _text(v, "source.mime_type"), _text(v, "mimeType"), _text(v, "mime_type"), _text(v, "media_type"), F.lit("application/octet-stream"))

        def told(data: Column) -> Column:
            held = F.coalesce(F.octet_length(data), F.lit(0)) > 0
            ref = _first(_text(v, "url"), F.when(held, "").otherwise(F.to_json(v)))
            return F.element_at(F.transform(F.array(images.dimensions(data)), lambda size: F.struct(
                F.when(held, F.sha2(data, 256)).otherwise(F.sha2(ref, 256)).alias("asset_sha256"), F.lit("image").alias("asset_kind"), x["place"].alias("content_index"), i.alias("prompt_order"), ref.alias("raw_ref"), mime.alias("mime_type"), _text(v, "type").alias("block_type"),
                F.when(held, F.octet_length(data)).otherwise(0).cast("bigint").alias("bytes"), F.when(held, size["width"]).otherwise(0).alias("width"), F.when(held, size["height"]).otherwise(0).alias("height")).cast(_ASSET)), 1)

        # the data is a variable, as its size is, so that each is computed once
        return F.element_at(F.transform(F.array(F.coalesce(given("source.data"), given("data"))), told), 1)

    return F.transform(F.filter(items, is_asset), asset)


def _id_or_line(found: Column) -> Column:
    return F.when(found != "", found).otherwise(F.format_string("line-%06d-%s", F.col("line_no"), F.substring(F.sha2("raw", 256), 1, 12)))


def _finish(rows: DataFrame, **columns: Column) -> DataFrame:
    none = {"parent_id": F.lit(""), "provider": F.lit(""), "cost": F.lit(0.0), "participates_in_context": F.lit(True), "first_kept": F.lit(""), "cwd": F.lit(""), "cache_read_tokens": F.lit(0).cast("bigint"), "cache_write_tokens": F.lit(0).cast("bigint"), "reasoning_tokens": F.lit(0).cast("bigint"), "assets": F.array().cast(f"array<{_ASSET}>")}
    columns = none | {"raw_json": F.col("raw"), "entry_sha256": F.sha2("raw", 256)} | columns
    return rows.select(*[columns.get(c, F.col(c)).alias(c) for c in ENTRY_COLUMNS])


def generic_entries(rows: DataFrame) -> DataFrame:
    """Entries of the common shape (pi, claude-code, older codex)."""
    v, m, kind, found = (F.col(c) for c in ("v", "m", "kind", "found"))
    # lines that are no objects say nothing and go behind the window: a filter before it would parse each line once more
    rows = parsed(rows).withColumn("object", v.isNotNull() & _braced()).withColumn("m", F.try_variant_get("v", "$.message", "variant"))
    at = F.coalesce(F.try_variant_get(v, "$.message.content", "variant"), F.try_variant_get(v, "$.content", "variant"))
    # a column of its own, since texts, calls and results are taken from it
    rows = rows.withColumn("items", content_items(at)).withColumn("kind", _text(v, "type")).withColumn("found", _first(_text(v, "id"), _text(v, "uuid"), _text(m, "id"), _text(m, "uuid")))
    text = items_text(F.col("items"))
    role = _first(_text(m, "role"), _text(v, "role"))
    calls, results = items_calls(F.col("items")), F.col("tool_results")
    shown = _first(_text(v, "role"), _text(m, "role"), kind)
    alone = F.struct(_first(_text(m, "toolCallId"), _text(m, "tool_use_id"), _text(v, "toolCallId"), _text(v, "tool_use_id")).alias("for_id"),
                     (F.coalesce(_flag(m, "isError", "is_error"), F.lit(False)) | F.coalesce(_flag(v, "isError", "is_error"), F.lit(False)) | F.coalesce(F.coalesce(_get(m, "exit_code", "bigint"), _get(m, "exitCode", "bigint")) != 0, F.lit(False))).alias("is_error"),
                     truncated_utf8(text, OUTCOME_BYTES).alias("outcome_text"), F.coalesce(_get(m, "exit_code", "bigint"), _get(m, "exitCode", "bigint")).alias("exit_code"), F.lit(0).alias("ordinal")).cast(_RESULT)
    results = F.when((role == "toolResult") & (F.size(results) == 0), F.array(alone)).otherwise(results)
    tool = lambda f: F.coalesce(F.get(F.filter(F.transform(F.col("tool_calls"), lambda c: c[f]), lambda x: x != ""), F.lit(0)), F.lit(""))
    takes_part = F.coalesce(_flag(v, "participatesInContext", "participates_in_context"), _flag(m, "participatesInContext", "participates_in_context"), kind != "custom")
    left_out = F.coalesce(_flag(v, "excludeFromContext", "exclude_from_context"), _flag(m, "excludeFromContext", "exclude_from_context"), F.lit(False))
    summary = F.when((text == "") & (shown.isin("branchSummary", "compactionSummary") | kind.isin("summary", "compaction", "branch_summary")), _first(_text(v, "summary"), _text(v, "text"))).otherwise(text)
    usage = lambda n: _number(m, f"usage.{n}")
    # what a window follows is a column by then: a filter on the number of assets would make each of them once more
    rows = rows.withColumn("entry_id", _id_or_line(found)).withColumn("tool_calls", calls).withColumn("tool_results", items_results(F.col("items"))).withColumn("tool_results", results).withColumn("assets", items_assets(F.col("items")))
    # the header's id names the session; the first entry with a folder names it too
    file = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("header", F.last(F.when((kind == "session") & (found != ""), found), ignorenulls=True).over(file)).withColumn("cwd", F.coalesce(F.first(F.nullif(_text(v, "cwd"), F.lit("")), ignorenulls=True).over(file), F.lit(""))).where("object")
    return _finish(
        rows, source_session_id=F.coalesce("header", "source_session_id"), parent_id=_first(_text(v, "parentId"), _text(v, "parent_id"), _text(v, "parentUuid")), entry_type=kind, timestamp=_text(v, "timestamp"),
        role=F.when((shown == "user") & (F.size(_of_type(F.col("items"), "tool_result")) > 0), "toolResult").otherwise(shown), text=summary, tool_name=_first(tool("tool_name"), _text(v, "toolName"), _text(m, "toolName")), command=tool("command"), files_json=tool("files_json"),
        model=_first(_text(m, "model"), F.when(kind == "model_change", _text(v, "modelId")).otherwise(""), _text(v, "model")), provider=F.when(kind == "model_change", _text(v, "provider")).otherwise(""),
        tokens=usage("input_tokens") + usage("output_tokens") + usage("cache_creation_input_tokens") + usage("cache_read_input_tokens"), cache_read_tokens=usage("cache_read_input_tokens"), cache_write_tokens=usage("cache_creation_input_tokens"), reasoning_tokens=usage("reasoning_output_tokens") + usage("reasoning_tokens"),
        participates_in_context=takes_part & ~left_out, first_kept=F.when(kind == "compaction", _text(v, "firstKeptEntryId")).otherwise(""), cwd=F.col("cwd"), assets=F.col("assets"))


def pi_entries(rows: DataFrame) -> DataFrame:
    """As generic_entries, without the header line."""
    return generic_entries(rows).where("entry_type <> 'session'")


def is_modern_codex(rows: DataFrame) -> DataFrame:
    """rows with `modern`: one of a file's first 50 lines has an envelope with a payload object."""
    rank = Window.partitionBy("path").orderBy("line_no")
    v = parsed(rows.withColumn("place", F.row_number().over(rank)))
    enveloped = (F.col("place") <= 50) & _text(F.col("v"), "type").isin("session_meta", "turn_context", "response_item", "event_msg", "compacted") & _kind(F.try_variant_get("v", "$.payload", "variant")).startswith("OBJECT")
    return v.withColumn("modern", F.max(enveloped).over(Window.partitionBy("path"))).drop("v", "place")


def codex_entries(rows: DataFrame) -> DataFrame:
    """Entries of enveloped codex lines; model and provider carry forward from the latest header or turn."""
    rows = objects(rows).withColumn("p", F.try_variant_get("v", "$.payload", "variant"))
    v, p, at = F.col("v"), F.col("p"), F.try_variant_get("p", "$.content", "variant")
    outer, kind = _text(v, "type"), _text(p, "type")
    sets = outer.isin("session_meta", "turn_context")
    so_far = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    carry = lambda value: F.coalesce(F.last(F.when(sets, F.nullif(value, F.lit(""))), ignorenulls=True).over(so_far), F.lit(""))
    rows = rows.withColumn("cur_model", carry(_text(p, "model"))).withColumn("cur_provider", carry(_first(_text(p, "model_provider"), _text(p, "provider"))))
    whole = Window.partitionBy("path")
    rows = rows.withColumn("meta_id", F.max(F.when(outer == "session_meta", F.nullif(_text(p, "id"), F.lit("")))).over(whole)).withColumn("meta_cwd", F.max(F.when(outer == "session_meta", _text(p, "cwd"))).over(whole))
    item = (outer == "response_item") | (outer.isin("event_msg", "compacted") & (kind != ""))
    call, output = kind.isin("function_call", "local_shell_call", "custom_tool_call"), kind.isin("function_call_output", "custom_tool_call_output", "local_shell_call_output")
    given = F.try_variant_get(p, "$.arguments", "variant")
    given = F.when(_kind(given) == "STRING", F.try_parse_json(given.cast("string"))).otherwise(given)
    wanted = F.coalesce(F.try_variant_get(given, "$.command", "variant"), F.try_variant_get(given, "$.cmd", "variant"))
    command = F.when(_kind(wanted).startswith("ARRAY"), F.array_join(F.transform(F.filter(wanted.cast("array<variant>"), lambda x: _kind(x) == "STRING"), lambda x: x.cast("string")), " ")).when(_kind(wanted) == "STRING", wanted.cast("string")).otherwise("")
    out = F.try_variant_get(p, "$.output", "variant")
    told = F.when(_kind(out) == "STRING", out.cast("string")).when(_kind(out).startswith("ARRAY"), content_text(out)).otherwise(_first(_text(out, "content"), _text(out, "output")))
    code = F.nullif(F.regexp_extract(told, r"(?i)\b(?:process|command) exited with code\s+(-?\d+)\b", 1), F.lit("")).cast("bigint")
    call_id = _first(_text(p, "call_id"), _text(p, "id"))
    name = F.when(call, _first(_text(p, "name"), kind)).when(kind == "web_search_call", "web_search").otherwise("")
    files = F.when(call, F.when(_kind(F.try_variant_get(p, "$.arguments", "variant")) == "STRING", _text(p, "arguments")).otherwise(F.coalesce(F.to_json(given), F.lit("")))).otherwise("")
    line = F.when(call, command).when(kind == "web_search_call", _text(p, "action.query")).otherwise("")
    one = F.array(F.struct(call_id.alias("id"), name.alias("tool_name"), line.alias("command"), files.alias("files_json"), F.lit(0).alias("ordinal")).cast(_CALL))
    result = F.array(F.struct(call_id.alias("for_id"), (F.coalesce(_truth(p, "is_error"), F.lit(False)) | F.coalesce(code != 0, F.lit(False))).alias("is_error"), truncated_utf8(told, OUTCOME_BYTES).alias("outcome_text"), code.alias("exit_code"), F.lit(0).alias("ordinal")).cast(_RESULT))
    said = F.when(kind.isin("user_message", "agent_message"), _text(p, "message")).when(kind == "message", content_text(at)).when(output, told).when(kind == "reasoning", content_text(F.coalesce(F.try_variant_get(p, "$.summary", "variant"), at))).otherwise("")
    role = F.when(kind == "user_message", "user").when(kind == "agent_message", "assistant").when(kind == "message", _text(p, "role")).when(call | (kind == "web_search_call"), "toolCall").when(output, "toolResult").when(kind == "reasoning", "reasoning").otherwise("")
    speaks = (kind == "agent_message") | ((kind == "message") & (_text(p, "role") == "assistant"))
    use = F.coalesce(F.try_variant_get(p, "$.info.last_token_usage", "variant"), F.try_variant_get(p, "$.info", "variant"))
    total = F.when(_number(use, "total_tokens") > 0, _number(use, "total_tokens")).otherwise(_number(use, "input_tokens") + _number(use, "output_tokens"))
    usage = lambda n: F.when(item & (kind == "token_count"), n).otherwise(0).cast("bigint")
    only = lambda c, other=F.lit(""): F.when(item, c).otherwise(other)
    calls, results = F.array().cast(f"array<{_CALL}>"), F.array().cast(f"array<{_RESULT}>")
    return _finish(
        rows, source_session_id=F.coalesce("meta_id", "source_session_id"), entry_id=_id_or_line(_first(_text(v, "id"), _text(p, "id"))), entry_type=only(_first(kind, F.lit("response_item")), outer), timestamp=_text(v, "timestamp"), role=only(role), text=only(said), tool_name=only(name), command=only(line), files_json=only(files),
        tool_calls=F.when(item & (call | (kind == "web_search_call")), one).when(item & (kind == "message"), content_calls(at)).otherwise(calls), tool_results=F.when(item & output, result).when(item & (kind == "message"), content_results(at)).otherwise(results),
        model=only(F.when(speaks, F.col("cur_model")).otherwise("")), provider=only(F.col("cur_provider")), tokens=usage(total), cache_read_tokens=usage(_number(use, "cached_input_tokens")), cache_write_tokens=usage(_number(use, "cache_creation_input_tokens")), reasoning_tokens=usage(_number(use, "reasoning_output_tokens")), cwd=F.coalesce("meta_cwd", F.lit("")))


def opencode_entries(rows: DataFrame) -> DataFrame:
    """Entries of exported database rows: a session line, then a message with its parts on each line."""
    rows = objects(rows)
    inner = lambda x: F.coalesce(F.try_variant_get(x, "$.data", "variant"), x)
    rows = rows.withColumn("d", inner(F.try_variant_get("v", "$.row", "variant")))
    v, d = F.col("v"), F.col("d")
    whole = Window.partitionBy("path")
    session = _text(v, "type") == "session"
    rows = rows.withColumn("sid", F.max(F.when(session, F.nullif(_text(v, "id"), F.lit("")))).over(whole)).withColumn("dir", F.max(F.when(session, _first(_text(d, "directory"), _text(d, "cwd"), _text(d, "worktree")))).over(whole)).where(~session & (_text(v, "type") == "message"))
    parts = F.transform(_blocks(F.try_variant_get(v, "$.parts", "variant")), inner)
    tools = F.filter(parts, lambda b: _text(b, "type") == "tool")
    call_id = lambda b: _first(_text(b, "callID"), _text(b, "call_id"), _text(b, "id"))
    calls = F.filter(F.transform(tools, lambda b, i: F.struct(call_id(b).alias("id"), _first(_text(b, "tool"), _text(b, "name")).alias("tool_name"), _text(b, "state.input.command").alias("command"), F.coalesce(F.to_json(F.try_variant_get(b, "$.state.input", "variant")), F.lit("")).alias("files_json"), i.alias("ordinal")).cast(_CALL)), lambda c: (c["tool_name"] != "") | (c["command"] != "") | (c["files_json"] != ""))
    code = lambda b: F.coalesce(_get(b, "state.exit_code", "bigint"), _get(b, "state.exitCode", "bigint"), _get(b, "state.code", "bigint"))
    failed = lambda b: F.coalesce(_flag(b, "state.isError", "state.is_error"), F.lit(False)) | F.lower(_text(b, "state.status")).isin("error", "failed") | F.coalesce(code(b) != 0, F.lit(False))
    results = F.filter(F.transform(tools, lambda b, i: F.struct(call_id(b).alias("for_id"), failed(b).alias("is_error"), truncated_utf8(_first(_text(b, "state.output"), _text(b, "state.error")), OUTCOME_BYTES).alias("outcome_text"), code(b).alias("exit_code"), i.alias("ordinal")).cast(_RESULT)), lambda r: r["is_error"] | (r["outcome_text"] != ""))
    texts = F.transform(F.filter(parts, lambda b: _text(b, "type") == "text"), lambda b: _text(b, "text"))
    rows = rows.withColumn("tool_calls", calls).withColumn("tool_results", results)
    tool = lambda f: F.coalesce(F.get(F.filter(F.transform(F.col("tool_calls"), lambda c: c[f]), lambda x: x != ""), F.lit(0)), F.lit(""))
    made = F.date_format(F.timestamp_millis(_get(d, "time.created", "bigint")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    count = lambda n: _number(d, f"tokens.{n}")
    return _finish(
        rows, source_session_id=F.coalesce("sid", "source_session_id"), entry_id=_first(_text(v, "id"), _text(v, "row.id")), entry_type=F.lit("message"), timestamp=F.coalesce(made, F.lit("")), role=_first(_text(d, "role"), _text(v, "row.role")), text=F.trim(F.array_join(F.filter(texts, lambda s: s != ""), "\n")),
        tool_name=tool("tool_name"), command=tool("command"), files_json=tool("files_json"), model=_first(_text(d, "modelID"), _text(d, "model")), provider=_text(d, "providerID"), cost=F.coalesce(_get(d, "cost", "double"), F.lit(0.0)),
        tokens=count("input") + count("output") + count("reasoning") + count("cache.read") + count("cache.write"), cache_read_tokens=count("cache.read"), cache_write_tokens=count("cache.write"), reasoning_tokens=count("reasoning"), cwd=F.coalesce("dir", F.lit("")))


READERS = {"pi": pi_entries, "claude-code": generic_entries, "opencode": opencode_entries}


def read(spark: SparkSession, source: str, root: str) -> DataFrame:
    """Entries of all transcripts of a source below root."""
    if source != "codex" and source not in READERS:
        raise ValueError(f"unknown source {source!r}")
    return read_lines(source, lines(spark, root))


def read_lines(source: str, rows: DataFrame) -> DataFrame:
    """Entries of a source's lines; codex files are told apart by their first lines."""
    if source == "codex":
        probed = is_modern_codex(rows)
        return codex_entries(probed.where("modern")).unionByName(generic_entries(probed.where("not modern")))
    if source not in READERS:
        raise ValueError(f"unknown source {source!r}")
    return READERS[source](rows)


def calls_and_results(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The exploded calls and results that operators.pairing joins."""
    key = F.concat_ws("/", "path", "source_session_id").alias("session_key")
    calls = entries.select(key, "entry_id", "line_no", "timestamp", F.explode("tool_calls").alias("c")).select("session_key", "entry_id", "line_no", F.col("c.ordinal"), F.col("c.id").alias("call_id"), F.col("c.tool_name"), F.col("c.command"), F.col("c.files_json"), "timestamp", F.lit("").alias("project_key"))
    results = entries.select(key, "line_no", F.explode("tool_results").alias("r")).select("session_key", "line_no", F.col("r.ordinal"), F.col("r.for_id"), F.col("r.is_error"), F.col("r.outcome_text"), F.col("r.exit_code"))
    return calls, results


def calls_with_results(entries: DataFrame) -> DataFrame:
    """The calls and results of calls_and_results as one table, for operators.pairing.paired: entries are read once."""
    none = lambda kind: F.lit(None).cast(kind)
    calls = F.transform("tool_calls", lambda c: F.struct(c.alias("c"), none(_RESULT).alias("r")))
    results = F.transform("tool_results", lambda r: F.struct(none(_CALL).alias("c"), r.alias("r")))
    key, c, r = F.concat_ws("/", "path", "source_session_id").alias("session_key"), F.col("x.c"), F.col("x.r")
    steps = entries.select(key, "entry_id", "line_no", "timestamp", F.explode(F.concat(calls, results)).alias("x"))
    return steps.select("session_key", "entry_id", "line_no", "timestamp", F.lit("").alias("project_key"), c.isNotNull().alias("is_call"), F.coalesce(c["ordinal"], r["ordinal"]).alias("ordinal"), F.coalesce(c["id"], r["for_id"]).alias("call_id"),
                        c["tool_name"].alias("tool_name"), c["command"].alias("command"), c["files_json"].alias("files_json"), r["is_error"].alias("is_error"), r["outcome_text"].alias("outcome_text"), r["exit_code"].alias("exit_code"))
