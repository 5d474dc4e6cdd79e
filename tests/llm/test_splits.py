import random

import pytest

from trailmill.llm import components as C, splits as S

REPOS = "repo string, owner string, fork_of string, former_name string, extra string, root string, family string"


def roots(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return {x: min(g) for g in groups.values() for x in g}


@pytest.fixture(params=["one task", "many tasks"])
def tasks(spark, request):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, str(request.param == "one task").lower())
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("nodes", [3, 500_000])
def test_components(spark, tasks, nodes):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, x) for x in range(5001, 5050)] + [(7, 7)]
    df = spark.createDataFrame([*links, *links[:20], (None, 1), (2, None)], "a bigint, b bigint").repartition(6)
    got = {r.node: r.root for r in C.components(df, "a", "b", nodes).collect()}
    assert got == roots([(a, b) for a, b in links if a != b])


def test_components_of_a_node_with_two_parents(spark, tasks):
    links = [(5, 1), (4, 3), (3, 2), (5, 4)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(links, 4), "a bigint, b bigint")
    got = sorted(tuple(r) for r in C.components(df, "a", "b", nodes=1).collect())
    assert got == [(n, 1) for n in (1, 2, 3, 4, 5)]


def test_components_of_texts_and_of_nothing(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "p string, q string")
    assert {r.node: r.root for r in C.components(df, "p", "q").collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert C.components(df.limit(0), "p", "q").count() == 0


@pytest.fixture(scope="module")
def repos(spark):
    rows = [("o__a", "o", None, "o__olda", "", "", ""), ("O__b", "O", None, None, "", "", ""), ("p__c", "p", "o__a", None, "", "", ""), ("q__d", "q", "P__C", "o__a", "", "", ""), ("z__z", "z", None, "y__y", "", "", "")]
    return spark.createDataFrame(rows, REPOS)


def rows_of(spark, *ids):
    return spark.createDataFrame([(i, x, "s", "g", 1) for i, x in enumerate(ids)], "row_id bigint, instance_id string, family string, group string, size int")


def test_families(repos):
    assert {r.repo: r.family for r in S.families(repos).collect()} == {"o__a": "O__b", "O__b": "O__b", "p__c": "O__b", "q__d": "O__b", "z__z": "z__z"}
    assert S.families(repos.limit(0)).count() == 0


def test_grouped(spark, repos):
    rows = rows_of(spark, "o__a-1", "set::O/A#2", "y_1776_y-3", "u__u-1", "U__u-2::chunk0", "run_1", " RUN_1 ", "", None, "o__olda-1")
    got = {r.row_id: (r.family, r.group) for r in S.grouped(rows, repos).collect()}
    assert got[0][0] == got[1][0] == got[9][0] == "O__b" and got[2][0] == "z__z"
    assert got[3] == got[4] == (None, "repo:u__u") and got[5] == got[6] == (None, "id:run_1") and got[7][1] != got[8][1]
    assert S.grouped(rows.limit(0), repos).count() == 0 and S.grouped(rows, repos.limit(0)).where("family IS NOT NULL").count() == 0


def greedy(sizes, shares):
    total, have = sum(sizes), [0] * len(shares)
    for s in sorted(sizes, reverse=True):
        i = max(range(len(shares)), key=lambda i: (shares[i] * total - have[i], -i))
        have[i] += s
    return have


def test_plan_is_greedy():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.choice([1, 1, 1, 2, 3, 10, 57, 400]) for _ in range(rng.randrange(1, 60))]
        histogram = {s: sizes.count(s) for s in sizes}
        plan = S.plan(list(histogram.items()), {"a": 0.8, "b": 0.1, "c": 0.1})
        have = [sum(size * (high - low) for size, split, low, high in plan if split == k) for k in "abc"]
        want = greedy(sizes, [0.8, 0.1, 0.1])
        assert sum(have) == sum(sizes) and max(abs(x - y) for x, y in zip(have, want)) <= max(sizes)
        target = [0.8 * sum(sizes), 0.1 * sum(sizes), 0.1 * sum(sizes)]
        worst = lambda h: max(abs(x - t) for x, t in zip(h, target))
        assert worst(have) <= worst(want) + 1e-6 or worst(have) <= max(sizes)


def test_split_keeps_groups(spark, repos):
    ids = [f"o__a-{i}" for i in range(40)] + [f"r{i}__n-1" for i in range(300)] + [None] * 100
    out = S.split_records(rows_of(spark, *ids), repos).collect()
    assert len(out) == len(ids)
    splits = {}
    for r in out:
        splits.setdefault(r.group, set()).add(r.split)
    assert all(len(x) == 1 for x in splits.values())
    n = {k: sum(r.split == k for r in out) for k in S.SHARES}
    assert n == {"train": 352, "validation": 44, "test": 44}
    assert S.split_records(rows_of(spark, "x").limit(0), repos).count() == 0
