import random

import pytest
from conftest import MESSAGES, msg
from pyspark.sql import functions as F

from trailmill.functions.tokenizers import VOCABULARY
from trailmill.operators import context

COSTS = "row_id int, costs array<bigint>"


def model_prefix(costs, budget, least):
    n = len(costs)
    while n > least and sum(costs[:n]) > budget:
        n -= 1
    return n


def model_tail(costs, budget, head=2):
    if sum(costs) <= budget:
        return len(costs) - min(head, len(costs)), 0, None
    first, tail = costs[:head], costs[head:]
    for n in range(len(tail), 0, -1):
        if sum(first) + sum(tail[-n:]) <= budget:
            return n, len(tail) - n, None
    return 0, len(tail), "token_keep_end"


def model_chunks(costs, budget, head=2):
    if sum(costs) <= budget:
        return [(0, len(costs) - min(head, len(costs)))]
    first, tail, out, start = sum(costs[:head]), costs[head:], [], 0
    while start < len(tail):
        end = start
        while end < len(tail) and first + sum(tail[start : end + 1]) <= budget:
            end += 1
        end = max(end, start + 1)
        out.append((start, end))
        start = end
    return out


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(3)
    rows = [[], [5], [50], [50, 60], [1, 1, 200, 1], [60, 60, 1, 1]] + [[rng.randrange(40) for _ in range(rng.randrange(12))] for _ in range(400)]
    return rows, spark.createDataFrame(list(enumerate(rows)), COSTS)


def test_against_models(cases):
    rows, df = cases
    got = df.select("row_id", context.fitting_prefix(F.col("costs"), 100).alias("p"), context.smart_tail(F.col("costs"), 100).alias("t"), context.chunks(F.col("costs"), 100).alias("c")).orderBy("row_id").collect()
    for costs, r in zip(rows, got):
        assert r.p == model_prefix(costs, 100, min(1, len(costs))), costs
        assert (r.t.kept_tail, r.t.dropped_messages, r.t.fallback) == model_tail(costs, 100), costs
        assert [(c.chunk_start, c.chunk_end) for c in r.c] == model_chunks(costs, 100), costs
        for c in r.c:
            assert c.cost <= 100 or c.kept == 0 or sum(costs) <= 100


def test_expand(spark):
    long = [msg("system", "s"), msg("user", "u"), *(msg("assistant", "x" * 30) for _ in range(4))]
    df = spark.createDataFrame([("a", long), ("b", long[:3]), ("c", None)], f"instance_id string, messages {MESSAGES}")
    out = context.expand(df, "chunk", 70).orderBy("instance_id").collect()
    assert [(r.instance_id, len(r.messages)) for r in out] == [("a::chunk0", 4), ("a::chunk1", 4), ("b", 3), ("c", 0)]
    tail = context.expand(df, "smart_tail", 70).orderBy("instance_id").collect()
    assert [len(r.messages) for r in tail] == [4, 3, 0] and tail[0].context_limit.dropped_messages == 2
    assert context.expand(df, "none", 1) is df
    with pytest.raises(ValueError):
        context.expand(df, "other", 1)
    stats = context.expansion_stats(df, "chunk", 70).first()
    assert (stats.input_rows, stats.output_rows, stats.chunked_rows, stats.total_chunks) == (3, 4, 1, 4)
    assert context.expansion_stats(df.limit(0), "smart_tail", 70).first().output_rows == 0


def test_tokens(spark):
    path = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    chat = [msg("system", "be brief"), msg("user", "hi\n\n"), msg("assistant", "one two"), msg("tool", None), msg("assistant", "done"), msg("user", "bye")]
    df = spark.createDataFrame([(1, chat)], f"row_id bigint, messages {MESSAGES}")
    r = context.loss_mask(df, "row_id", path).first()
    assert len(r.response_ids) == len(r.loss_mask) and 0 < sum(r.loss_mask) < len(r.loss_mask)
    words = lambda text: [len(w) for w in text.split(" ")]
    assert context._differences(words, ["a b", " c", " dd e"], 1, words("a b")) == [[1], [2, 1]]
    with pytest.raises(ValueError):
        context._differences(words, ["a b", "c"], 1, words("a b"))
    t = context.tokenize(df, "row_id", path, 5, 50256).first()
    assert len(t.input_ids) == 5 and t.input_ids[-1] == 50256 and t.full_length > 5
    assert context.token_costs(df, "row_id", path).first().costs[0] > 3
    ids = F.array(*map(F.lit, range(10)))
    one = spark.range(1).select(context.limit_response(ids, F.lit(4), 5, 2).alias("a"), context.limit_response(ids, F.lit(4), 50, 2, 6).alias("b"), context.limit_response(ids, F.lit(90), 5, 2).alias("c"), context.keep_tokens(ids, 3).alias("k"), context.keep_tokens(ids, 3, False).alias("f")).first()
    assert (one.a.ids, one.a.stop_reason, one.b.ids, one.c.ids, one.k, one.f) == ([0, 1, 2], "length", [0, 1], [], [7, 8, 9], [0, 1, 2])


def test_short_prompts(spark):
    rows = [(1, [msg("user", "word " * 40)]), (2, [msg("user", "hi")]), (3, None), (4, [])]
    df = spark.createDataFrame(rows, f"row_id bigint, messages {MESSAGES}")
    assert sorted(r.row_id for r in context.short_prompts(df, "row_id", 20).collect()) == [2, 3, 4]
    assert sorted(r.row_id for r in context.short_prompts(df, "row_id", 20, VOCABULARY).collect()) == [2, 3, 4]
    plain = {r.row_id: r.tokens for r in context.message_tokens(df, "row_id", VOCABULARY).collect()}
    framed = {r.row_id: r.tokens for r in context.message_tokens(df, "row_id", VOCABULARY, frame=("<start>", "\n", "<end>\n")).collect()}
    assert plain[3] == plain[4] == 0 and framed[2] > plain[2] and context.message_tokens(df.limit(0), "row_id").count() == 0
