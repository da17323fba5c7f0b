"""Tool calls and their results: keyed ones by id, the others by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.redaction import command_family, error_signature


def tool_invocations(calls: DataFrame, results: DataFrame, index_output: bool = False) -> DataFrame:
    """One row for each call that names a tool, command or files; calls without a result are pending.

    calls: (session_key, entry_id, line_no, ordinal, call_id, tool_name, command, files_json, timestamp, project_key);
    results: (session_key, line_no, ordinal, for_id, is_error, outcome_text, exit_code). The first result of an id
    counts; calls and results without ids are paired in order of line and ordinal. With index_output an error's
    signature is kept, without it only its exit code; a success keeps nothing.
    """
    given = results.select("session_key", "line_no", "ordinal", F.col("for_id").alias("call_id"), "is_error", "outcome_text", "exit_code", F.lit(False).alias("is_call"))
    return paired(calls.withColumn("is_call", F.lit(True)).unionByName(given, allowMissingColumns=True), index_output)


def paired(steps: DataFrame, index_output: bool = False) -> DataFrame:
    """As tool_invocations, of calls and results in one table, which is read once.

    steps: the columns of both, with is_call, and a result's id as call_id. Families and signatures are taken before
    rows are brought together, so that no command and no output is shuffled.
    """
    is_call, text = F.col("is_call"), F.coalesce("outcome_text", F.lit(""))
    steps = steps.where("not is_call or not (coalesce(tool_name, '') = '' and coalesce(command, '') = '' and coalesce(files_json, '') = '')")
    code = F.when(F.col("exit_code").isNotNull(), F.concat(F.lit("exit_code:"), F.col("exit_code"))).otherwise("tool_error")
    failed = F.coalesce(F.col("is_error"), F.lit(False))
    signature = F.when(~failed, "").when(F.lit(index_output) & (F.trim(text) != ""), error_signature(text)).otherwise(code)
    result = F.when(~is_call, F.struct("exit_code", failed.alias("failed"), signature.alias("signature")))
    steps = steps.select("session_key", F.coalesce("call_id", F.lit("")).alias("id"), "is_call", "line_no", "ordinal", "entry_id", "call_id", "tool_name",
                         F.when(is_call, command_family(F.col("tool_name"), F.col("command"))).alias("family"), result.alias("result"), "timestamp", "project_key")
    # results go before calls, so that the first row of a pair is its result if it has one
    one, each = F.col("id") != "", Window.partitionBy("session_key", "id").orderBy("is_call", "line_no", "ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nth = F.when(is_call, F.count(F.when(is_call, 1)).over(each)).otherwise(F.row_number().over(each))
    pair = Window.partitionBy("session_key", "id", "place").orderBy("is_call").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = steps.withColumn("place", F.when(~one, nth)).withColumn("result", F.when(one, F.first("result").over(each)).otherwise(F.first("result").over(pair))).where(is_call)
    # a session without a key is none
    result, family = F.when(F.col("session_key").isNotNull(), F.col("result")), F.col("family")
    signature = F.coalesce(result["signature"], F.lit(""))
    return out.select("session_key", "entry_id", "line_no", F.when(one, F.col("call_id")).otherwise(F.format_string("#%03d", "ordinal")).alias("tool_key"), F.col("call_id").alias("tool_use_id"), "ordinal", "tool_name",
                      family.alias("command_family"), family.alias("command"), result["exit_code"].alias("exit_code"), F.coalesce(result["failed"], F.lit(False)).cast("int").alias("is_error"), signature.alias("error_signature"), signature.alias("outcome_text"),
                      result.isNotNull().alias("outcome_observed"), "timestamp", "project_key")
