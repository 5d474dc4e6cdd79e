"""Column expressions over message lists: ARRAY<STRUCT<role, content, tool_calls, tool_call_id, name>>.

Null lists behave as empty ones unless stated otherwise; null messages are skipped by predicates.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .binding import let
from .text import json_string_length

CALLS = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
MESSAGE = f"struct<role:string,content:string,tool_calls:{CALLS},tool_call_id:string,name:string>"
MESSAGES = f"array<{MESSAGE}>"
TRAINABLE = ("user", "assistant", "tool")
CHARS_PER_TOKEN = 3.2


def listed(messages: Column) -> Column:
    return F.coalesce(messages, F.array().cast(MESSAGES))


def _calls(m: Column) -> Column:
    return F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0


def _text(m: Column) -> Column:
    return F.coalesce(m["content"], F.lit(""))


def json_calls_length(calls: Column) -> Column:
    """Characters of a list of calls as JSON with `, ` and `: ` between its parts; 0 for a null or empty list."""
    frame = len('{"id": , "type": , "function": {"name": , "arguments": }}')
    one = lambda c: (
        F.lit(frame) + json_string_length(c["id"]) + json_string_length(c["type"]) + json_string_length(c["function"]["name"]) + json_string_length(c["function"]["arguments"])
    )
    total = F.aggregate(calls, F.lit(0).cast("long"), lambda n, c: n + one(c) + 2)
    return F.when(F.coalesce(F.size(calls), F.lit(0)) > 0, total).otherwise(F.lit(0).cast("long"))


def message_chars(m: Column) -> Column:
    """Characters of the content and of the calls as JSON."""
    return F.coalesce(F.length(m["content"]), F.lit(0)).cast("long") + json_calls_length(m["tool_calls"])


def chars(messages: Column) -> Column:
    return F.aggregate(listed(messages), F.lit(0).cast("long"), lambda n, m: n + message_chars(m))


def estimated_tokens(n_chars: Column, per_token: float = CHARS_PER_TOKEN) -> Column:
    return F.floor(n_chars / F.lit(per_token)).cast("long")


def looks_text_action(messages: Column) -> Column:
    """Some assistant text has `THOUGHT:` or some user text `<returncode>`."""
    hit = lambda m: ((m["role"] == "assistant") & _text(m).contains("THOUGHT:")) | ((m["role"] == "user") & _text(m).contains("<returncode>"))
    return F.coalesce(F.exists(listed(messages), lambda m: F.coalesce(hit(m), F.lit(False))), F.lit(False))


def looks_native(messages: Column) -> Column:
    """Some assistant has tool calls, none without has both THOUGHT: and ACTION:, and no `<returncode>` comes from a
    user before the first call."""
    state = F.struct(F.lit(False).alias("saw"), F.lit(False).alias("bad"))

    def step(s: Column, m: Column) -> Column:
        assistant, user = F.coalesce(m["role"] == "assistant", F.lit(False)), F.coalesce(m["role"] == "user", F.lit(False))
        saw = s["saw"] | (assistant & _calls(m))
        text = assistant & ~_calls(m) & _text(m).contains("THOUGHT:") & _text(m).contains("ACTION:")
        early = user & _text(m).contains("<returncode>") & ~saw
        return F.struct(saw.alias("saw"), (s["bad"] | text | early).alias("bad"))

    return F.aggregate(listed(messages), state, step, lambda s: s["saw"] & ~s["bad"])


def native_reject_reason(messages: Column, tool: str = "bash") -> Column:
    """Why the turns are no strict native-tool turns: the reason of the first assistant at fault, else null."""

    def reason(m: Column) -> Column:
        first = m["tool_calls"][0]
        return (
            F.when(~_calls(m), "assistant_missing_tool_calls")
            .when(F.size(m["tool_calls"]) != 1, "assistant_multiple_tool_calls")
            .when(~first["function"]["name"].eqNullSafe(tool), "unexpected_tool_name")
            .when(first["function"]["arguments"].isNull(), "invalid_tool_arguments")
        )

    reasons = F.filter(F.transform(F.filter(listed(messages), lambda m: m["role"] == "assistant"), reason), lambda r: r.isNotNull())
    return F.when(~looks_native(messages), "not_native_tool_format").otherwise(F.get(reasons, F.lit(0)))


def attach_call_ids(messages: Column, passes: int = 1) -> Column:
    """Gives id-less tool messages the ids of the calls before them; null content becomes ''.

    An assistant with calls replaces the pending ids; the k-th id-less tool message after it gets id number k. With p
    passes ids are used again from the first, p times in all.
    """
    start = F.struct(F.array().cast("array<string>").alias("pending"), F.lit(0).alias("k"), F.array().cast("array<string>").alias("given"))

    def step(s: Column, m: Column) -> Column:
        fresh = F.coalesce(m["role"] == "assistant", F.lit(False)) & _calls(m)
        ids = F.filter(F.transform(m["tool_calls"], lambda c: c["id"]), lambda i: i.isNotNull() & (i != ""))
        pending = F.when(fresh, ids).otherwise(s["pending"])
        k, n = F.when(fresh, F.lit(0)).otherwise(s["k"]), F.size(pending)
        needs = F.coalesce(m["role"] == "tool", F.lit(False)) & (F.coalesce(m["tool_call_id"], F.lit("")) == "") & (n > 0) & (k < n * passes)
        got = F.when(needs, F.get(pending, F.when(n > 0, k % n).otherwise(F.lit(0))))
        return F.struct(pending.alias("pending"), (k + needs.cast("int")).alias("k"), F.concat(s["given"], F.array(got)).alias("given"))

    pair = lambda ms: F.zip_with(
        ms, F.aggregate(ms, start, step, lambda s: s["given"]),
        lambda m, g: F.struct(m["role"].alias("role"), _text(m).alias("content"), m["tool_calls"].alias("tool_calls"), F.coalesce(g, m["tool_call_id"]).alias("tool_call_id"), m["name"].alias("name")),
    )
    return let(listed(messages), pair)


def normalize(messages: Column, passes: int = 1) -> Column:
    """Canonical messages: role defaults to `user`, content to '', a call's type to `function`; empty call lists become
    null; name and call id stay on tool messages only; then ids are attached."""
    call = lambda c: F.struct(c["id"].alias("id"), F.coalesce(c["type"], F.lit("function")).alias("type"), c["function"].alias("function"))

    def one(m: Column) -> Column:
        tool = F.coalesce(m["role"] == "tool", F.lit(False))
        return F.struct(
            F.coalesce(m["role"], F.lit("user")).alias("role"), _text(m).alias("content"),
            F.when(_calls(m), F.transform(F.filter(m["tool_calls"], lambda c: c.isNotNull()), call)).alias("tool_calls"),
            F.when(tool, F.nullif(m["tool_call_id"], F.lit(""))).alias("tool_call_id"), F.when(tool, F.nullif(m["name"], F.lit(""))).alias("name"),
        )

    return attach_call_ids(F.transform(F.filter(listed(messages), lambda m: m.isNotNull()), one), passes)


def trainable(messages: Column) -> Column:
    return F.filter(listed(messages), lambda m: m["role"].isin(*TRAINABLE))


def response_view(messages: Column) -> Column:
    """The first two messages as they are, then the trainable rest without the user messages at its end; of up to two
    messages the trainable ones."""
    def view(ms: Column) -> Column:
        n = F.size(ms)
        tail = trainable(F.slice(ms, F.lit(3), F.greatest(n - 2, F.lit(0))))
        return F.when(n <= 2, trainable(ms)).otherwise(F.concat(F.slice(ms, F.lit(1), F.lit(2)), let(tail, cut)))

    def cut(tail: Column) -> Column:
        # The number of messages after the last that is not a user's.
        trailing = F.aggregate(tail, F.lit(0), lambda k, m: F.when(m["role"] == "user", k + 1).otherwise(F.lit(0)))
        return F.slice(tail, F.lit(1), F.size(tail) - trailing)

    return let(listed(messages), view)


def response_problem(messages: Column) -> Column:
    """Why a rollout cannot be trained on, else null."""
    def problem(view: Column) -> Column:
        head, rest = F.slice(view, 1, 2), F.slice(view, F.lit(3), F.greatest(F.size(view) - 2, F.lit(0)))
        return (
            F.when(F.size(view) < 3, "too_few_messages")
            .when(F.exists(head, lambda m: ~F.coalesce(m["role"].isin("system", "user"), F.lit(False))), "bad_prompt_roles")
            .when(~F.coalesce(F.exists(rest, lambda m: m["role"] == "assistant"), F.lit(False)), "no_assistant")
        )

    return let(response_view(messages), problem)


def linearize(messages: Column) -> Column:
    """`[role]` and content of every message, blank lines between; null content is ''."""
    return F.array_join(F.transform(listed(messages), lambda m: F.concat(F.lit("["), F.coalesce(m["role"], F.lit("user")), F.lit("]\n"), _text(m))), "\n\n")
