import random

import pytest
import tiktoken  # noqa: F401
from conftest import MESSAGES, msg

from trailmill.llm import token_budget as T, tokens

TEXTS = ["", " ", "a", "The cat sat.\nOn the mat.", "The cat sat.\nOn the hat.", "x\n\n\n  y", "\n", "a\r\nb", "日本語。テスト", "it's 10,000 o'clock!  ", "a.\tb", "word " * 400, "end. \n start", "é 　x", "\n\n", "a \n b", "tab\t\t.\t\n x"]


def test_counts_are_exact(spark):
    rng = random.Random(1)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", ".", "!", "'s", "9", "é", "字", "。", "\r\n", "_", "-", "　"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    encode = tokens.encoder(tokens.VOCABULARY).encode_ordinary
    df = spark.createDataFrame([(i, [msg("user", t, [("1", t), ("2", None)])]) for i, t in enumerate(texts)], f"row_id bigint, messages {MESSAGES}")
    got = {r.row_id: (r.n_tokens, r.usable) for r in T.row_tokens(df).collect()}
    assert got == {i: (2 * len(encode(t)), bool(t.strip())) for i, t in enumerate(texts)}


def test_defined_cases(spark):
    rows = [(1, None), (2, []), (3, [None]), (4, [msg("user", None)]), (5, [msg("user", " \n"), msg("tool", "", [("1", "\t")])]), (6, [msg("user", "x")]), (7, [msg("user", "x")])]
    df = spark.createDataFrame(rows, f"row_id bigint, messages {MESSAGES}")
    assert sorted(r.row_id for r in T.row_tokens(df).where("usable").collect()) == [6, 7] and T.row_tokens(df).count() == 7
    assert T.row_tokens(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def side(spark):
    instances = spark.createDataFrame([("o__a-1", "de", "x"), ("O__A-1", "de", "x"), ("o__a-2", "de", "x"), ("o__a-2", "fr", "x"), ("o__a-3", None, "x"), (None, "en", "x")], "instance_id string, issue_lang string, lang string")
    repos = spark.createDataFrame([("o__a", "web", "o__old"), ("o__b", None, None)], "repo string, domain string, former_name string")
    return instances, repos


def test_every_row_counts_once(spark, side):
    ids = ["o__a-1", "set::o/a#1", "o__old-1", "o__a-2", "o__a-3", "o__b-9", "zzz", None, ""]
    df = spark.createDataFrame([(i, x, " Src-A ", [msg("user", "hello world")], "c", "d") for i, x in enumerate(ids)], f"row_id bigint, instance_id string, source string, messages {MESSAGES}, lang string, domain string")
    got = {r.row_id: (r.source, r.lang, r.domain) for r in T.row_budget(df, *side).collect()}
    assert got == {0: ("src_a", "de", "web"), 1: ("src_a", "de", "web"), 2: ("src_a", "de", "web"), 3: ("src_a", "unclear", "web"), 4: ("src_a", "unknown", "web"), **{i: ("src_a", "unknown", "unknown") for i in range(5, 9)}}
    b = T.budget(T.row_budget(df, *side)).collect()
    assert sum(r.rows for r in b) == 9 and sum(r.tokens for r in b) == 9 * len(tokens.encoder(tokens.VOCABULARY).encode_ordinary("hello world"))
