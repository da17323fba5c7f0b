"""Lifecycle of archives and workspaces: what each operation may do in each state, and the state of the whole system.

The tables are small constants; they meet data in equal-key joins with a broadcast side of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# States, operations, and for each state the operations it allows (with the state they lead to) and
# what a user is told to do where it allows none.
ARCHIVE_STATES = ("invalid_address", "invalid_configuration", "unreachable", "uninitialised", "empty", "populated", "damaged", "upgrade_required")
ARCHIVE_OPERATIONS = ("status", "init", "set_default", "upload", "download", "verify")
ARCHIVE_MOVES = {
    "uninitialised": {"init": "empty"},
    "empty": {"set_default": "empty", "download": "empty", "verify": "empty", "upload": "populated"},
    "populated": {"set_default": "populated", "download": "populated", "verify": "populated", "upload": "populated"},
    "damaged": {"verify": "damaged"},
}
ARCHIVE_ADVICE = {"uninitialised": "archive init", "damaged": "archive verify --deep", "upgrade_required": "version --json"}
WORKSPACE_STATES = ("absent", "current", "behind", "damaged", "archive_mismatch", "invalid_destination", "upgrade_required")
WORKSPACE_OPERATIONS = ("status", "set_default", "download", "verify", "repair", "conflicts")
WORKSPACE_MOVES = {
    "absent": {"set_default": "absent", "download": "current"},
    "current": {"set_default": "current", "verify": "current", "conflicts": "current", "download": "current"},
    "behind": {"set_default": "behind", "verify": "behind", "conflicts": "behind", "download": "current"},
    "damaged": {"set_default": "damaged", "verify": "damaged", "conflicts": "damaged", "repair": "current"},
}
WORKSPACE_ADVICE = {"absent": "archive download", "damaged": "workspace repair --backup", "upgrade_required": "version --json"}
KINDS = {"archive": (ARCHIVE_STATES, ARCHIVE_OPERATIONS, ARCHIVE_MOVES, ARCHIVE_ADVICE, "archive status"), "workspace": (WORKSPACE_STATES, WORKSPACE_OPERATIONS, WORKSPACE_MOVES, WORKSPACE_ADVICE, "workspace status")}


def transitions(spark: SparkSession) -> DataFrame:
    """(kind, state, operation, allowed, next_state, next_action) for every state and operation; looking is always allowed."""
    rows = []
    for kind, (states, operations, moves, advice, look) in KINDS.items():
        for state in states:
            allowed = {"status": state} | moves.get(state, {})
            rows += [(kind, state, op, op in allowed, allowed.get(op, state), "" if op in allowed else advice.get(state, look)) for op in operations]
    return spark.createDataFrame(rows, "kind string, state string, operation string, allowed boolean, next_state string, next_action string")


def attempted(spark: SparkSession, requests: DataFrame) -> DataFrame:
    """requests (kind, state, operation) with allowed, next_state and next_action; an unknown state or operation is not allowed."""
    out = requests.join(F.broadcast(transitions(spark)), ["kind", "state", "operation"], "left")
    look = F.concat("kind", F.lit(" status"))
    return out.withColumn("allowed", F.coalesce("allowed", F.lit(False))).withColumn("next_state", F.coalesce("next_state", "state")).withColumn("next_action", F.coalesce("next_action", look))


def system_state(facts: DataFrame) -> DataFrame:
    """facts with columns agent, archive and workspace (states) -> and state, next_action: the first rule that holds."""
    agent, archive, workspace = F.col("agent"), F.col("archive"), F.col("workspace")
    upload, download = agent == "upload_needed", workspace.isin("behind", "absent")
    rules: list[tuple[Column, str, str]] = [
        ((archive == "upgrade_required") | (workspace == "upgrade_required"), "upgrade_required", "version --json"),
        (archive.isin("invalid_address", "invalid_configuration", "unreachable"), "archive_unavailable", "archive status"),
        (workspace.isin("archive_mismatch", "invalid_destination"), "workspace_attention_required", "workspace status"),
        (archive == "uninitialised", "archive_uninitialised", "archive init"),
        (archive == "damaged", "damaged", "archive verify --deep"),
        (workspace == "damaged", "damaged", "workspace repair --backup"),
        (agent == "unknown", "agent_history_unknown", "archive upload --dry-run"),
        (upload & download, "upload_and_download_needed", "archive upload"),
        (upload, "upload_needed", "archive upload"),
        (download, "download_needed", "archive download"),
    ]
    state, action = F.lit("current"), F.lit("")
    for test, name, then in reversed(rules):
        state, action = F.when(test, name).otherwise(state), F.when(test, then).otherwise(action)
    return facts.withColumn("state", state).withColumn("next_action", action)
