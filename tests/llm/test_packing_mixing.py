import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.llm import mixing as M, packing as P, queries as Q, tokens


def test_fill_is_optimal():
    rng = random.Random(9)
    for _ in range(300):
        lengths = [(k, rng.randrange(1, 4)) for k in rng.sample(range(1, 30), rng.randrange(1, 5))]
        room = rng.randrange(1, 60)
        best = max(s for c in itertools.product(*(range(n + 1) for _, n in lengths)) if (s := sum(k * x for (k, _), x in zip(lengths, c))) <= room)
        used = P.fill(lengths, room)
        assert sum(k * n for k, n in used.items()) == best and all(n <= dict(lengths)[k] for k, n in used.items())


def test_plan_places_everything():
    rng = random.Random(1)
    for _ in range(50):
        histogram = {rng.randrange(0, 101): rng.randrange(1, 50) for _ in range(20)}
        plan, left = P.plan(histogram, 100), dict(histogram)
        for pattern, times in plan:
            assert sum(k * n for k, n in pattern.items()) <= 100
            for k, n in pattern.items():
                left[k] -= n * times
        left.pop(0, None)
        assert not any(left.values())
    assert P.plan({}, 100) == []


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "x") for i, (t, s) in enumerate(rows)], "doc_id bigint, text string, source string, n_tokens int, length int, shard string")


def test_pack(spark):
    rng = random.Random(3)
    rows = [("word " * rng.randrange(0, 60), "a") for _ in range(200)] + [(None, "a"), ("", None), ("word " * 500, "b"), ("word " * 500, "b")]
    df = documents(spark, rows)
    encode = tokens.encoder(tokens.VOCABULARY).encode_ordinary
    out = P.pack(P.sizes(df), 64).collect()
    by, fill = {}, {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.token_from, r.token_to))
        if r.container_id is not None:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.token_to - r.token_from
    for i, (t, _) in enumerate(rows):
        n, spans = len(encode(t or "")), sorted(by[i])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and len(spans) == max(1, -(-n // 64))
    bins: list[int] = []  # first fit decreasing, for comparison
    for size in sorted((b - a for p in by.values() for a, b in p), reverse=True):
        at = next((i for i, x in enumerate(bins) if x + size <= 64), None)
        if at is None:
            bins.append(size)
        else:
            bins[at] += size
    assert max(fill.values()) <= 64 and len(fill) <= len([x for x in bins if x])
    assert all((r.container_id is None) == (r.token_to == r.token_from) for r in out)
    sized = P.sizes(df)
    assert {r.doc_id for r in P.cut_items(P.pack(sized, 64)).collect()} == {r.doc_id for r in sized.where("n_tokens > 64").collect()}
    proof = P.proof(P.pack(sized, 64), sized, 64).first()
    assert (proof.documents, proof.broken, proof.cut_in_vain, proof.overfull) == (sized.count(), 0, 0, 0)
    wrong = P.pack(sized, 64).where("part_no = 0").withColumn("container_id", F.lit(1).cast("long"))
    assert P.proof(wrong, sized, 64).where("broken > 0 AND overfull = 1").count() == 1
    assert P.pack(P.sizes(df.limit(0)), 64).count() == 0 and P.report(P.pack(P.sizes(df.limit(0)), 64), 64).first().containers == 0


def test_permutation():
    for n in (1, 2, 3, 5, 17, 64, 1000):
        assert sorted(M.permute(np.arange(n), n, 3).tolist()) == list(range(n))
    assert M.permute(np.arange(1000), 1000, 3).tolist() != M.permute(np.arange(1000), 1000, 4).tolist()


def test_shard_counts_add_up():
    totals = np.array([1000, 3, 0, 777])
    parts = [M.shard_counts(totals, 7, s, 256, 1) for s in range(7)]
    assert (sum(c for c, _ in parts) == totals).all() and all(c.sum() in (256, 1780 % 256) for c, _ in parts)
    assert all((b == sum((c for c, _ in parts[:i]), np.zeros(4, int))).all() for i, (_, b) in enumerate(parts))
    big = np.array([3_000_000_000, 1_000_000_000])
    counts, before = M.shard_counts(big, 4, 3, 1_000_000_000, 1)
    assert counts.sum() == 1_000_000_000 and (counts + before == big).all()


def test_counts_of_very_many_slots_are_drawn():
    totals, n = np.array([3_000_000_000, 999_999_000, 1_000]), 4_000_000_000
    drawn = np.array([M.shard_counts(totals, 4, 0, n // 4, seed)[0] for seed in range(1500)])
    mean, var = totals / 4, totals * (n - totals) / n * (3 / 16)
    assert (drawn.sum(1) == n // 4).all() and (abs(drawn.mean(0) - mean) < 5 * np.sqrt(var / 1500)).all()
    assert (abs(drawn.var(0) / var - 1) < 0.2).all()


def test_draws_are_hypergeometric():
    rng = np.random.default_rng(3)
    for good, bad, drawn in ((1, 1, 1), (2, 3, 1), (6, 9, 7), (40, 25, 50), (3, 5000, 2500), (1, 999, 10), (700, 800, 600)):
        pmf = {k: math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn) for k in range(max(0, drawn - bad), min(good, drawn) + 1)}
        got = np.bincount([M.hypergeometric(good, bad, drawn, rng) for _ in range(20_000)], minlength=good + 1)
        assert all(abs(got[k] - 20_000 * p) < 5 * math.sqrt(20_000 * p * (1 - p)) + 1 for k, p in pmf.items()) and sum(got[k] for k in pmf) == 20_000
    assert M.hypergeometric(0, 10, 4, rng) == 0 and M.hypergeometric(10, 0, 4, rng) == 4 and M.hypergeometric(10, 10, 20, rng) == 10


def test_mix(spark):
    rng = random.Random(5)
    rows = [("word " * rng.randrange(1, 80), s) for s, n in (("a", 300), ("b", 60), ("c", 5)) for _ in range(n)] + [("word " * 90, None), (None, "a"), ("", "b"), ("word", "z")]
    df = documents(spark, rows)
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 4), ("c", 0.15, 2), ("none", 0.05, 9)], "source string, target_share double, max_repeats int")
    mixed, report = M.mix(df, targets, block=16, shard=32)
    rep = {r.source: r for r in report.collect()}
    encode = tokens.encoder(tokens.VOCABULARY).encode_ordinary
    held = {s: sum(len(encode(t)) for t, x in rows if x == s and t) for s in ("a", "b", "c")}
    total = sum(held.values())
    assert {s: rep[s].tokens for s in held} == held and rep["none"].tokens == 0
    assert {r.source for r in M.short_sources(report, 16).collect()} == {r.source for r in targets.collect() if held.get(r.source, 0) * r.max_repeats < r.target_share * total}
    assert abs(rep["a"].used_tokens - 0.5 * total) <= 40 and abs(rep["b"].used_tokens - 0.3 * total) <= 40 and abs(sum(r.share for r in rep.values()) - 1) < 1e-9
    assert all(r.uses_above == r.repeated_uses == 0 for r in M.proof(mixed, report).collect())
    assert {r.source for r in M.proof(mixed.unionByName(mixed.where("source = 'a'").withColumn("slot", F.col("slot") + 1000)), report).where("repeated_uses > 0").collect()} == {"a"}
    uses = {}
    for r in mixed.collect():
        for t in range(r.token_from, r.token_to):
            uses[r.doc_id, t] = uses.get((r.doc_id, t), 0) + 1
    assert max(n for (d, _), n in uses.items() if rows[d][1] == "c") == 2 and max(uses.values()) <= 4
    again = M.mix(df.repartition(5), targets, block=16, shard=32)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixed.collect()))
    exact = {r.source: r for r in M.mix(df, targets.where("source <> 'none'"), block=16, shard=32, exact=True)[1].collect()}
    assert abs(exact["a"].share / exact["c"].share - 0.5 / 0.15) < 0.6 and exact["c"].most_uses == 2
    empty = M.mix(df.limit(0), targets)
    assert empty[0].count() == 0 and all(r.share == 0 for r in empty[1].collect())


def test_rows_of_the_exact_mix_reach_the_targets(spark, sf):
    rows = Q.QUERIES["p7_exact_mix"](spark, sf).groupBy("source").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("n"), F.max("use_no").alias("last")).collect()
    report = {r.source: r for r in Q.QUERIES["p7_exact"](spark, sf).collect()}
    assert {r.source: (r.n, r.last + 1) for r in rows} == {s: (r.used_tokens, r.most_uses) for s, r in report.items() if r.used_tokens}
    total, slack = sum(r.n for r in rows), 2 * M.BLOCK
    assert total and all(abs(r.used_tokens - r.target_share * total) <= slack for r in report.values())


def test_exact_mix_does_without_a_source_that_has_nothing(spark):
    df = documents(spark, [("word " * 60, s) for s, n in (("a", 60), ("b", 20)) for _ in range(n)])
    targets = spark.createDataFrame([("a", 0.45, 3), ("b", 0.45, 1), ("none", 0.1, 9)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in M.mix(df, targets, block=16, shard=32, exact=True)[1].collect()}
    assert report["none"].used_tokens == 0
    assert "none" in {r.source for r in M.short_sources(M.mix(df, targets, block=16, shard=32)[1], 16).collect()}
    assert report["b"].used_tokens == report["b"].tokens and abs(report["a"].share - 0.5) < 0.02
