"""Agent sessions as steps, tool calls, packet manifests and distillation state.

Steps and tool calls are rows. A session of any length stays spread out; totals are combined
before the shuffle and numbering uses range slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import collapse_space, left_units, trim_space
from ..session import computed_once
from ..sources.packets import daily_ids
from .skew import with_positions

# Lengths of previews and titles.
TOOL_UNITS, TEXT_UNITS, TITLE_UNITS = 600, 1200, 60

_ENTRY = (
    "type string, message struct<role:string,content:variant,model:string,toolName:string,"
    "toolCallId:string,isError:boolean>"
)


def _blocks(content: Column, kind: str) -> Column:
    """Content blocks of one kind; empty unless the content is a list."""
    listed = F.when(F.schema_of_variant(content).startswith("ARRAY"), content.cast("array<variant>"))
    wanted = F.filter(listed, lambda b: F.try_variant_get(b, "$.type", "string") == kind)
    return F.coalesce(wanted, F.array().cast("array<variant>"))


def _content_text(content: Column) -> Column:
    """A string as it is, or the text blocks of a list joined and trimmed."""
    parts = F.transform(
        _blocks(content, "text"), lambda b: F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit(""))
    )
    plain = F.when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))
    return F.coalesce(plain, trim_space(F.array_join(parts, "\n")))


def message_steps(entries: DataFrame) -> DataFrame:
    """steps(session_id, turn, role, text, preview, model, tool_calls, tool_call_id, tool_name, is_error).

    text is the whole text, preview its beginning.

    entries(session_id, turn, entry): entry is the JSON of one session entry. Entries that are
    no message, and assistant messages without text and tool calls, give no step.
    """
    rows = computed_once(entries, {"_m": F.from_json("entry", _ENTRY)})
    message = F.col("_m.message")
    content = F.col("content")
    rows = rows.where(
        (F.col("_m.type") == "message") & message["role"].isin("user", "assistant", "toolResult")
    ).withColumns({"role": message["role"], "content": message["content"]})
    rows = computed_once(rows, {"_calls": _blocks(content, "toolCall"), "_text": _content_text(content)})
    calls = F.transform(
        "_calls",
        lambda b: F.struct(
            F.coalesce(F.try_variant_get(b, "$.id", "string"), F.lit("")).alias("id"),
            F.coalesce(F.try_variant_get(b, "$.name", "string"), F.lit("unknown")).alias("name"),
            F.coalesce(F.to_json(F.try_variant_get(b, "$.arguments", "variant")), F.lit("{}")).alias("arguments"),
        ),
    )
    no_calls = F.array().cast("array<struct<id:string,name:string,arguments:string>>")
    is_tool, is_assistant = F.col("role") == "toolResult", F.col("role") == "assistant"
    silent = is_assistant & (F.col("_text") == "") & (F.size("_calls") == 0)
    return rows.where(~silent).select(
        "session_id", "turn", F.when(is_tool, "tool").otherwise(F.col("role")).alias("role"),
        F.col("_text").alias("text"),
        F.when(is_tool, left_units(F.col("_text"), TOOL_UNITS)).otherwise(left_units(F.col("_text"), TEXT_UNITS)).alias("preview"),
        F.when(is_assistant, message["model"]).alias("model"),
        F.when(is_assistant, calls).otherwise(no_calls).alias("tool_calls"),
        F.when(is_tool, message["toolCallId"]).alias("tool_call_id"),
        F.when(is_tool, message["toolName"]).alias("tool_name"),
        F.when(is_tool, F.coalesce(message["isError"], F.lit(False))).alias("is_error"),
    )


def tool_calls(steps: DataFrame) -> DataFrame:
    """calls(session_id, turn, pos, name) of assistant steps."""
    return steps.where("role = 'assistant'").select(
        "session_id", "turn", F.posexplode("tool_calls").alias("pos", "call")
    ).select("session_id", "turn", F.col("pos").cast("bigint").alias("pos"), "call.name")


def tool_usage(calls: DataFrame) -> DataFrame:
    """usage(session_id, name, calls, first_turn, first_pos): order by calls desc, then first use."""
    return calls.groupBy("session_id", "name").agg(
        F.count(F.lit(1)).cast("bigint").alias("calls"), F.min(F.struct("turn", "pos")).alias("f")
    ).select("session_id", "name", "calls", F.col("f.turn").alias("first_turn"), F.col("f.pos").alias("first_pos"))


def tool_sequence(calls: DataFrame) -> DataFrame:
    """Tool calls numbered through the session: (session_id, position, line)."""
    numbered = with_positions(calls, ["session_id"], ["turn", "pos"], narrow=True)
    return numbered.select(
        "session_id", "position",
        F.concat(F.col("position").cast("string"), F.lit(". `"), "name", F.lit("`")).alias("line"),
    )


def session_summary(steps: DataFrame) -> DataFrame:
    """Per session: prompt (first user text), model (first known), step and tool call counts."""
    texted = (F.col("role") == "user") & (F.col("text") != "")
    return steps.groupBy("session_id").agg(
        F.coalesce(trim_space(F.min_by(F.when(texted, F.col("text")), F.when(texted, F.col("turn")))), F.lit("")).alias("prompt"),
        F.min_by("model", F.when(F.coalesce("model", F.lit("")) != "", F.col("turn"))).alias("model"),
        F.count(F.lit(1)).cast("bigint").alias("step_count"),
        F.sum(F.size("tool_calls")).cast("bigint").alias("tool_call_count"),
    )


def trajectories(steps: DataFrame, day: str, existing: DataFrame | None = None) -> DataFrame:
    """Packet manifests, one per session: id, title, prompt, model, outcome, counts."""
    rows = session_summary(steps).withColumns({"day": F.lit(day), "capture_order": F.col("session_id")})
    numbered = daily_ids(rows, "TRJ", existing, narrow=True)
    line = left_units(collapse_space(F.col("prompt")), TITLE_UNITS)
    return numbered.select(
        "session_id", "id", F.col("day").alias("captured"), "prompt",
        F.when(F.col("prompt") != "", line).otherwise(F.concat(F.lit("Task "), "id")).alias("title"),
        F.lit("trajectory").alias("format"), F.coalesce("model", F.lit("unknown")).alias("model"),
        F.lit("success").alias("outcome"), "step_count", "tool_call_count",
    )


def summary_lines(packets: DataFrame, usage: DataFrame, sequence: DataFrame) -> DataFrame:
    """The readable summary as rows (id, section, position, line); order by the first three.

    Sections: 0 head, 1 tools used, 2 task, 3 tool calls.
    """
    head = packets.select(
        "id", F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("position"),
        F.concat(
            F.lit("# Trajectory "), "id", F.lit(": "), "title", F.lit("\n\n- **Captured:** "), "captured",
            F.lit("\n- **Model:** "), "model", F.lit("\n- **Steps:** "), F.col("step_count").cast("string"),
        ).alias("line"),
    )
    task = packets.select(
        "id", F.lit(2).alias("section"), F.lit(0).cast("bigint").alias("position"),
        F.concat(F.lit("\n## Task\n\n"), F.when(F.col("prompt") != "", F.col("prompt")).otherwise("_No prompt recorded._")).alias("line"),
    )
    ids = packets.select("session_id", "id")
    tools = with_positions(
        usage.join(ids, "session_id").withColumn("_n", -F.col("calls")), ["id"], ["_n", "first_turn", "first_pos"], narrow=True
    ).select(
        "id", F.lit(1).alias("section"), "position",
        F.concat(F.col("name"), F.lit("×"), F.col("calls").cast("string")).alias("line"),
    )
    none = packets.where("tool_call_count = 0").select(
        "id", F.lit(3).alias("section"), F.lit(0).cast("bigint").alias("position"), F.lit("_No tool calls recorded._").alias("line")
    )
    calls = sequence.join(ids, "session_id").select("id", F.lit(3).alias("section"), "position", "line")
    return head.unionByName(tools).unionByName(task).unionByName(none).unionByName(calls)


def undistilled(packets: DataFrame, links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Trajectories that no skill page cites: packets(id) against links(src, dst).

    Raw link targets count, as trajectories usually have no page. With `known`, only links to
    ids in it count, which is the literal rule of resolved backlinks.
    """
    cited = links.where(F.col("src").startswith("skills/") & F.col("dst").startswith("trajectories/"))
    if known is not None:
        cited = cited.join(known.select(F.col("id").alias("dst")), "dst", "left_semi")
    ids = cited.select(F.element_at(F.split("dst", "/"), -1).alias("id")).distinct()
    return packets.join(ids, "id", "left_anti")
