"""Fitting trajectories into a context budget, with additive costs per message.

`costs` is ARRAY<BIGINT>, one for each message; `HEAD` messages at the start are always kept. Exact tokenizers give
costs by `token_costs`. Null costs count as 0, a null list as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import messages as M
from ..functions.binding import let, let_all
from ..functions.tokenizers import Tokenizer, rank_file
from ..session import map_arrow

HEAD = 2
POLICIES = ("none", "smart_tail", "chunk")


def char_costs(messages: Column) -> Column:
    return F.transform(M.listed(messages), M.message_chars)


#: What stands before the role, after it, and after the message, where no chat template is given.
FRAME = ("[", "]\n", "\n")


def token_costs(rows: DataFrame, key: str, path: str, name: str = "costs", frame: tuple[str, str, str] = FRAME) -> DataFrame:
    """(key, costs): exact tokens of each message with its role and call arguments in a chat template's frame."""
    before, between, after = frame
    text = F.transform(
        M.listed(F.col("messages")),
        lambda m: F.concat(F.lit(before), F.coalesce(m["role"], F.lit("user")), F.lit(between), F.coalesce(m["content"], F.lit("")),
                           F.array_join(F.coalesce(F.transform(m["tool_calls"], lambda c: c["function"]["arguments"]), F.array().cast("array<string>")), ""), F.lit(after)),
    )
    kind = dict(rows.dtypes)[key]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_file(path).encode_ordinary
        for batch in batches:
            costs = [[len(encode(t)) for t in texts] for texts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.list_(pa.int64()))], names=[key, name])

    return map_arrow(rows.select(key, text.alias("texts")), count, f"`{key}` {kind}, `{name}` array<bigint>")


def message_tokens(rows: DataFrame, key: str, path: str | None = None, name: str = "tokens", frame: tuple[str, str, str] = FRAME) -> DataFrame:
    """(key, tokens) of each row's messages: exact with the vocabulary at `path`, estimated from the characters without."""
    if path is None:
        return rows.select(key, M.estimated_tokens(M.chars(F.col("messages"))).alias(name))
    return token_costs(rows, key, path, "_costs", frame).select(key, total(F.col("_costs")).alias(name))


def short_prompts(rows: DataFrame, key: str, most: int = 4096, path: str | None = None, frame: tuple[str, str, str] = FRAME) -> DataFrame:
    """Rows whose `messages` have at most `most` tokens. Rows with an estimate are filtered as they are read; exact counts
    are joined by `key`, which is unique and not null."""
    if path is None:
        return rows.where(M.estimated_tokens(M.chars(F.col("messages"))) <= most)
    return rows.join(message_tokens(rows, key, path, "_tokens", frame).where(F.col("_tokens") <= most).select(key), key, "left_semi").select(*rows.columns)


def total(costs: Column) -> Column:
    return F.aggregate(F.coalesce(costs, F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda n, c: n + F.coalesce(c, F.lit(0)))


def fitting_prefix(costs: Column, budget: Column | int, least: int = 1) -> Column:
    """How many messages from the start fit, but never fewer than `least` (or than there are)."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), F.lit(0).alias("fit"))

    def step(s: Column, c: Column) -> Column:
        added, n = s["sum"] + F.coalesce(c, F.lit(0)), s["n"] + 1
        return F.struct(added.alias("sum"), n.alias("n"), F.when(added <= budget, n).otherwise(s["fit"]).alias("fit"))

    fit = F.aggregate(costs, start, step, lambda s: s["fit"])
    return F.greatest(fit, F.least(F.lit(least), F.size(costs)))


def smart_tail(costs: Column, budget: int, head: int = HEAD) -> Column:
    """STRUCT<truncated, kept_tail, dropped_messages, original, final, fallback>: the head and the longest suffix that
    fits; if none does, the head alone, with `fallback` set and `final` the head's cost."""
    def facts(c: Column) -> Column:
        n = F.size(c)
        cut = F.least(F.lit(head), n)
        tail = F.reverse(F.slice(c, cut + 1, F.greatest(n - cut, F.lit(0))))
        return let_all(decide, rest=n - cut, tail=tail, first=total(F.slice(c, F.lit(1), cut)), all=total(c))

    def decide(f: Column) -> Column:
        return let_all(lambda k: result(f, k["kept"], k["fits"]), kept=fitting_prefix(f["tail"], F.lit(budget) - f["first"], 0), fits=f["all"] <= budget)

    def result(f: Column, kept: Column, fits: Column) -> Column:
        return F.struct(
            (~fits).alias("truncated"), F.when(fits, f["rest"]).otherwise(kept).alias("kept_tail"), F.when(fits, F.lit(0)).otherwise(f["rest"] - kept).alias("dropped_messages"),
            f["all"].alias("original"), F.when(fits, f["all"]).otherwise(f["first"] + total(F.slice(f["tail"], F.lit(1), kept))).alias("final"), F.when(~fits & (kept == 0), "token_keep_end").alias("fallback"),
        )

    return let(F.coalesce(costs, F.array().cast("array<bigint>")), facts)


def smart_tail_messages(messages: Column, costs: Column, budget: int, head: int = HEAD) -> Column:
    def cut(v: Column) -> Column:
        n = F.size(v["m"])
        return F.concat(F.slice(v["m"], F.lit(1), F.least(F.lit(head), n)), F.slice(v["m"], n - v["kept"] + 1, v["kept"]))

    return let_all(cut, m=M.listed(messages), kept=smart_tail(costs, budget, head)["kept_tail"])


def chunks(costs: Column, budget: int, head: int = HEAD) -> Column:
    """ARRAY<STRUCT<chunk_start, chunk_end, kept, cost>> over the tail: consecutive messages as long as they fit beside
    the head. One too large for itself has a chunk of its own, of which nothing but the head is kept. A row that fits is
    one chunk; one over budget without a tail has none.
    """
    kind = "array<struct<chunk_start:int,chunk_end:int,kept:int,cost:bigint>>"

    def facts(c: Column) -> Column:
        n = F.size(c)
        cut = F.least(F.lit(head), n)
        tail = F.transform(F.slice(c, cut + 1, F.greatest(n - cut, F.lit(0))), lambda x: F.coalesce(x, F.lit(0)).cast("long"))
        return let_all(split, rest=n - cut, tail=tail, first=total(F.slice(c, F.lit(1), cut)), all=total(c))

    def split(f: Column) -> Column:
        room = F.lit(budget) - f["first"]

        def chunk(start: Column, end: Column, cost: Column) -> Column:
            fits = cost <= room
            return F.struct(start.alias("chunk_start"), end.alias("chunk_end"), F.when(fits, end - start).otherwise(F.lit(0)).alias("kept"), (f["first"] + F.when(fits, cost).otherwise(F.lit(0))).alias("cost"))

        def step(s: Column, c: Column) -> Column:
            new = (s["at"] > s["start"]) & (s["cost"] + c > room)
            return F.struct(
                F.when(new, F.concat(s["done"], F.array(chunk(s["start"], s["at"], s["cost"])))).otherwise(s["done"]).alias("done"),
                F.when(new, s["at"]).otherwise(s["start"]).alias("start"), (s["at"] + 1).alias("at"), F.when(new, c).otherwise(s["cost"] + c).alias("cost"),
            )

        state = F.struct(F.array().cast(kind).alias("done"), F.lit(0).alias("start"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("cost"))
        parts = F.aggregate(f["tail"], state, step, lambda s: F.when(s["at"] > s["start"], F.concat(s["done"], F.array(chunk(s["start"], s["at"], s["cost"])))).otherwise(s["done"]))
        whole = F.array(F.struct(F.lit(0).alias("chunk_start"), f["rest"].alias("chunk_end"), f["rest"].alias("kept"), f["all"].alias("cost")))
        return F.when(f["all"] <= budget, whole.cast(kind)).otherwise(parts)

    return let(F.coalesce(costs, F.array().cast("array<bigint>")), facts)


def expand(rows: DataFrame, policy: str, budget: int, costs: Column | None = None, head: int = HEAD) -> DataFrame:
    """Rows with `messages` cut to the budget and a `context_limit` struct; `chunk` gives a row for each chunk, named
    `instance_id::chunkI` if there are several. Unknown policies raise."""
    if policy not in POLICIES:
        raise ValueError(f"unsupported policy: {policy}")
    if policy == "none":
        return rows
    rows = rows.withColumn("_costs", char_costs(F.col("messages")) if costs is None else costs)
    if policy == "smart_tail":
        limit = smart_tail(F.col("_costs"), budget, head)
        return rows.withColumn("context_limit", limit).withColumn("messages", smart_tail_messages(F.col("messages"), F.col("_costs"), budget, head)).drop("_costs")
    cut = F.least(F.lit(head), F.size(M.listed(F.col("messages"))))
    parts = rows.withColumn("_parts", chunks(F.col("_costs"), budget, head)).withColumn("_n", F.size("_parts"))
    out = parts.select("*", F.posexplode("_parts").alias("_i", "_c"))
    m = M.listed(F.col("messages"))
    return out.withColumns(
        {
            "context_limit": F.struct(F.col("_i").alias("chunk_index"), F.col("_n").alias("num_chunks"), (total(F.col("_costs")) > budget).alias("truncated"), total(F.col("_costs")).alias("original"), F.col("_c.cost").alias("final"), F.col("_c.chunk_start").alias("chunk_start"), F.col("_c.chunk_end").alias("chunk_end"), (F.col("_c.chunk_end") - F.col("_c.chunk_start") - F.col("_c.kept")).alias("dropped_messages")),
            "messages": F.concat(F.slice(m, F.lit(1), cut), F.slice(m, cut + F.col("_c.chunk_start") + 1, F.col("_c.kept"))),
            "instance_id": F.when(F.col("_n") > 1, F.concat("instance_id", F.lit("::chunk"), F.col("_i").cast("string"))).otherwise(F.col("instance_id")),
        }
    ).drop("_costs", "_parts", "_n", "_i", "_c")


def expansion_stats(rows: DataFrame, policy: str, budget: int, costs: Column | None = None, head: int = HEAD) -> DataFrame:
    """One row: input_rows, output_rows, truncated_rows, chunked_rows, total_chunks."""
    priced = rows.select((char_costs(F.col("messages")) if costs is None else costs).alias("c"))
    n = F.size(chunks(F.col("c"), budget, head)) if policy == "chunk" else F.lit(1)
    over = total(F.col("c")) > budget
    counted = priced.select(n.alias("n"), over.alias("over"))
    return counted.agg(
        F.count("*").alias("input_rows"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("output_rows"),
        (F.count_if("over") if policy == "smart_tail" else F.count_if(F.lit(False))).alias("truncated_rows"),
        (F.count_if(F.col("n") > 1) if policy == "chunk" else F.count_if(F.lit(False))).alias("chunked_rows"),
        (F.coalesce(F.sum("n"), F.lit(0)).cast("long") if policy == "chunk" else F.count("*")).alias("total_chunks"),
    )


def keep_tokens(ids: Column, most: int, end: bool = True) -> Column:
    """The last (or first) `most` ids."""
    return F.when(F.size(ids) <= most, ids).otherwise(F.slice(ids, -most if end else 1, most) if most else F.slice(ids, 1, 0))


def tokenize(rows: DataFrame, key: str, path: str, most: int, eos: int | None = None) -> DataFrame:
    """(key, input_ids, full_length): the linearised trajectory as ids, with `eos` at its end, its last `most` ids."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_file(path).encode_ordinary
        for batch in batches:
            out, sizes = [], []
            for text in batch.column(1).to_pylist():
                ids = encode(text)
                if eos is not None and (not ids or ids[-1] != eos):
                    ids.append(eos)
                sizes.append(len(ids))
                out.append(ids[-most:] if most else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32())), pa.array(sizes, pa.int64())], names=[key, "input_ids", "full_length"])

    return map_arrow(rows.select(key, M.linearize(F.col("messages")).alias("text")), run, f"`{key}` {kind}, input_ids array<int>, full_length bigint")


def _differences(encode: Tokenizer, texts: list[str], head: int, known: list[int]) -> list[list[int]]:
    """By which ids each message lengthens the tokens of all before it."""
    so_far, out = "".join(texts[:head]), []
    for text in texts[head:]:
        so_far += text
        now = encode(so_far)
        if now[: len(known)] != known:
            raise ValueError("the tokenizer changes earlier ids")
        out.append(now[len(known) :])
        known = now
    return out


def loss_mask(rows: DataFrame, key: str, path: str, head: int = HEAD) -> DataFrame:
    """(key, prompt_ids, response_ids, loss_mask): each message's ids are those by which it lengthens the tokens of all
    before it; the mask is 1 for assistants. A tokenizer for which a longer text changes earlier ids raises."""
    kind = dict(rows.dtypes)[key]
    view = M.response_view(F.col("messages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_file(path).encode_ordinary
        for batch in batches:
            prompts, responses, masks = [], [], []
            for texts, roles in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                prompt, parts = encode("".join(texts[:head])), [encode(t) for t in texts[head:]]
                if [*prompt, *(i for part in parts for i in part)] != encode("".join(texts)):  # messages are not tokenized independently
                    parts = _differences(encode, texts, head, prompt)
                ids = [i for part in parts for i in part]
                mask = [int(role == "assistant") for part, role in zip(parts, roles[head:]) for _ in part]
                prompts.append(prompt)
                responses.append(ids)
                masks.append(mask)
            kinds = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prompts, kinds), pa.array(responses, kinds), pa.array(masks, kinds)], names=[key, "prompt_ids", "response_ids", "loss_mask"])

    # One line feed between messages keeps the tokens of a prefix what they are in the longer text.
    texts = F.transform(view, lambda m: F.concat(F.lit("\n["), F.coalesce(m["role"], F.lit("user")), F.lit("]\n"), F.coalesce(m["content"], F.lit(""))))
    plan = rows.select(key, texts.alias("texts"), F.transform(view, lambda m: m["role"]).alias("roles"))
    return map_arrow(plan, run, f"`{key}` {kind}, prompt_ids array<int>, response_ids array<int>, loss_mask array<int>")


def limit_response(ids: Column, prompt_len: Column, max_tokens: int, max_input: int, max_train: int = 0) -> Column:
    """STRUCT<ids, stop_reason>: at most max_tokens + max_input - prompt, then at most max_train - prompt (0: no such
    limit) ids."""
    first = F.greatest(F.lit(max_tokens + max_input) - prompt_len, F.lit(0))
    room = F.least(first, F.greatest(F.lit(max_train) - prompt_len, F.lit(0))) if max_train else first
    return F.struct(F.slice(ids, F.lit(1), room).alias("ids"), F.when(F.size(ids) > room, "length").otherwise("complete").alias("stop_reason"))
