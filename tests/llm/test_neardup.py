import random

import numpy as np
import pytest
from conftest import MESSAGES, msg
from pyspark.sql import functions as F

from trailmill.llm import neardup as N


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def shingles(text):
    w = N.WORD.findall(text.lower())
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    out = []
    for g in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(40, 400))]
        out.append(base)
        for _ in range(rng.randrange(3)):
            copy = list(base)
            for _ in range(max(1, len(base) // rng.choice([30, 60, 200]))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(copy)
    out += [out[0], out[0], out[3][: len(out[3]) - 2]]
    return [" ".join(t) for t in out] + ["", "one two", "一二三四五六七八九十", "一二三四五六七八九十。", "A_b c, d!", "a_B C d"]


def frame(spark, texts):
    return spark.createDataFrame([(i, [msg("user", t)], "x", 3) for i, t in enumerate(texts)], f"row_id bigint, messages {MESSAGES}, text string, size int")


def want(texts, threshold):
    s = [shingles(t) for t in texts]
    return {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if s[i] and s[j] and jaccard(s[i], s[j]) >= threshold}, {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if s[i] and s[j] and 0.55 <= jaccard(s[i], s[j]) < 0.63}


def test_pairs_against_brute_force(spark, texts):
    df = frame(spark, texts)
    members, pairs = N.similar(df)
    got = {(r.row_id_a, r.row_id_b) for r in N.row_pairs(members, pairs).collect()}
    exact, unsure = want(texts, 0.6)
    assert got ^ exact <= unsure and len(exact) > 40 and got <= exact


def test_blocks_give_the_same_candidates(spark, texts):
    df = frame(spark, [texts[0] + f" v{i}" for i in range(40)] + texts[:30])
    sketched = N.sketch_table(df, "row_id", 20, 2).select("id", "bands")
    # All values streamed; long ones split after the stream; frequent ones split before it; a sample that finds some.
    ways = {"stream": (10_000, 10**6, 10**6), "over": (4, 10**6, 10**6), "blocks": (4, 10**6, 2), "one block": (10_000, 10**6, 2), "sampled": (6, 30, 3)}
    found = {k: {(r.a, r.b) for r in N.candidates(sketched, 70, *w).collect()} for k, w in ways.items()}
    assert all(x == found["stream"] for x in found.values()) and len(found["stream"]) >= 780


def test_search(spark, texts):
    df = frame(spark, texts).withColumn("row_id", F.col("row_id") * 50)  # every other one is a query
    members, pairs = N.similar(df)
    all_pairs = {(r.row_id_a, r.row_id_b) for r in N.row_pairs(members, pairs).collect()}
    both = all_pairs | {(b, a) for a, b in all_pairs}
    got = [(r.query_id, r.row_id) for r in N.search(members, pairs).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in both if a % 100 == 0}


def test_rows_without_some_ids(spark):
    rows, ids = spark.range(2_000).withColumn("x", F.lit("y")), spark.range(0, 3_000, 3)
    assert sorted(r.id for r in N._without(rows, ids).collect()) == [i for i in range(2_000) if i % 3]
    assert N._without(rows, ids.limit(0)).count() == 2_000 and {r.id for r in ids.collect() if r.id < 2_000} <= {r.id for r in N._marked(rows, ids).where("_may").collect()}


def test_groups(spark, texts):
    df = frame(spark, texts)
    out = {r.row_id: r for r in N.groups(*N.similar(df)).collect()}
    exact, _ = want(texts, 0.6)
    for a, b in exact:
        if jaccard(shingles(texts[a]), shingles(texts[b])) >= 0.63:
            assert out[a].group_id == out[b].group_id
    n = len(texts) - 6
    assert out[0].class_id == out[n - 3].class_id == out[n - 2].class_id and len(out) == len([t for t in texts if shingles(t)])


def test_empty_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [msg("user", None)]), (4, [msg("user", "a b")]), (None, [msg("user", "a b c d")])], f"row_id bigint, messages {MESSAGES}")
    for d in (df, df.limit(0)):
        assert N.row_pairs(*N.similar(d)).count() == 0 and N.groups(*N.similar(d)).count() == 0


def test_sketch_properties():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
    a, b, tiny = base[:1500], base[500:2000], base[:1]
    k = N.sketches([a, b, np.union1d(a, b), tiny], 512)
    assert (N.merge(k[0], k[1]) == k[2]).all()
    alone = N.sketches([b], 512)
    assert (alone[0] == k[1]).all()
    j = N.similarity(k[:1], k[1:2], np.array([1500.0]), np.array([1500.0]))[0]
    assert abs(j - 0.5) < 0.08 and abs((k[0] == k[1]).mean() - 0.5) < 0.08
    assert N.similarity(k[:1], k[3:4], np.array([1500.0]), np.array([1.0]))[0] < 0.01


def test_words():
    assert N.WORD.findall("Foo_bar 日本 カナab-9é") == ["Foo_bar", "日", "本", "カ", "ナ", "ab", "9é"]
