"""Set-similarity join, progressive models, Poisson draws, sketches and core numbers against plain versions."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.operators.progressive import progressive_bayes
from tessera.operators.ranges import split_points
from tessera.operators.sampling import poisson_means
from tessera.operators.set_join import class_distances, set_pairs
from tessera.operators.sketches import distinct_sketches, merged_distinct, merged_quantiles, quantile_sketches


@pytest.mark.parametrize("partitions", [8, 400])
def test_cut_points_do_not_grow_with_partitions(spark, monkeypatch, partitions):
    df = spark.range(0, 60000, 1, partitions).select((F.col("id") * 7919 % 60000).alias("v"))
    collected = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: collected.append(collect(self)) or collected[-1])
    points = split_points(df, ["v"], 32)
    # 512 expected, and the law of such a count
    assert abs(len(collected[0]) - 512) < 6 * math.sqrt(512) and len(points) == 31
    sizes = [b[0] - a[0] for a, b in zip([(0,), *points], [*points, (60000,)])]
    assert max(sizes) < 3 * 60000 / 32


def _sets(seed, count):
    r = random.Random(seed)
    # item 0 is in a third of the sets, and some sets are equal
    made = {i: {0} if i % 9 == 0 else {r.randrange(0, 1 + r.choice([3, 12])) for _ in range(r.randrange(1, 9))} | ({0} if i % 3 == 0 else set()) for i in range(count)}
    return {i + seed * 1000: s for i, s in made.items()}


def _frame(spark, sets):
    rows = [(i, x) for i, s in sets.items() for x in s] + [(i, x) for i, s in list(sets.items())[:5] for x in s]
    return spark.createDataFrame([*rows, (-1, None)], "id long, item long")


@pytest.mark.parametrize("percent", [20, 50, 80, 100])
def test_set_pairs(spark, percent):
    a, b = _sets(1, 90), _sets(2, 110)
    want = {(i, j): len(s & u) / len(s | u) for i, s in a.items() for j, u in b.items() if 100 * len(s & u) >= percent * len(s | u)}
    got = set_pairs(_frame(spark, a), _frame(spark, b), percent).collect()
    assert len(got) == len(want) and all(abs(want[r["id"], r["id2"]] - r["jaccard"]) < 1e-12 for r in got)


def test_class_distances(spark):
    a, b = _sets(1, 60), _sets(2, 120)
    classes = spark.createDataFrame([(j, j % 4) for j in b], "id long, class long")
    want = defaultdict(list)
    for i, s in a.items():
        for j, u in b.items():
            if 100 * len(s & u) >= 30 * len(s | u):
                want[i, j % 4].append(len(s & u) / len(s | u))
    got = class_distances(_frame(spark, a), _frame(spark, b), classes, 30).collect()
    assert len(got) == len(want)
    for r in got:
        values = sorted(want[r["id"], r["class"]])
        n, middle = len(values), (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2
        mean = sum(values) / n
        assert r["rows"] == n and abs(r["mean"] - mean) < 1e-9 and abs(r["q50"] - middle) < 1e-9
        assert (r["q0"], r["q100"]) == (values[0], values[-1])
        assert abs(r["std"] - math.sqrt(sum((v - mean) ** 2 for v in values) / n)) < 1e-6


def test_set_pairs_empty(spark):
    none = spark.createDataFrame([], "id long, item long")
    assert set_pairs(none, _frame(spark, _sets(1, 9)), 50).count() == 0


def test_progressive_scores_use_earlier_blocks_only(spark):
    r = random.Random(4)
    rows = [(i, i // 25, int(r.random() < 0.3), r.choice(["a", "b", None]), r.choice("xyz")) for i in range(150)]
    schema = "id long, block long, label long, f string, g string"

    def scores(data):
        return {s["id"]: s["p"] for s in progressive_bayes(spark.createDataFrame(data, schema), "id", "block", "label", ["f", "g"]).collect()}

    got = scores(rows)
    for i, block, _, f, g in rows:
        past = [x for x in rows if x[1] < block]
        pos, neg = [x for x in past if x[2]], [x for x in past if not x[2]]
        e = math.log((len(pos) + 1) / (len(neg) + 1))
        for c, v in ((3, f), (4, g)):
            e += math.log((sum(x[c] == v for x in pos) + 1) / (len(pos) + 2)) - math.log((sum(x[c] == v for x in neg) + 1) / (len(neg) + 2))
        assert abs(got[i] - 1 / (1 + math.exp(-e))) < 1e-9
    changed = scores([(i, b, 1 - y if b == 3 else y, f, g) for i, b, y, f, g in rows])
    assert all(abs(changed[i] - got[i]) < 1e-12 for i, b, *_ in rows if b <= 3)
    assert any(abs(changed[i] - got[i]) > 1e-6 for i, b, *_ in rows if b > 3)


def test_poisson_means(spark):
    df = spark.range(4000).select("id", (F.col("id") % 10).cast("double").alias("x"))
    got = poisson_means(df, F.col("id").cast("string"), "x", 40).collect()
    assert len(got) == 40 and all(abs(r["rows"] - 4000) < 5 * math.sqrt(4000) for r in got)
    means = [r["mean"] for r in got]
    spread = math.sqrt(sum((m - 4.5) ** 2 for m in means) / 40)
    # the standard error of a mean of 4000 rows with standard deviation sqrt(8.25)
    assert 0.6 < spread / math.sqrt(8.25 / 4000) < 1.5


def test_sketches_of_slices_merge_to_the_whole(spark):
    df = spark.range(30000).select((F.col("id") % 7).alias("slice"), (F.col("id") * 7919 % 9000).alias("v"))
    distinct = merged_distinct(distinct_sketches(df, ["slice"], ["v"]), [], ["v"]).first()["v"]
    assert abs(distinct - 9000) < 0.06 * 9000
    found = merged_quantiles(quantile_sketches(df, ["slice"], ["v"]), [], {"low": ("v", 0.1), "middle": ("v", 0.5)}).first()
    assert abs(found["low"] - 900) < 180 and abs(found["middle"] - 4500) < 180


def test_core_numbers(spark, monkeypatch):
    r = random.Random(8)
    edges = {tuple(sorted(r.sample(range(60), 2))) for _ in range(260)} | {(i, i + 1) for i in range(60, 90)}
    around = defaultdict(set)
    for a, b in edges:
        around[a].add(b)
        around[b].add(a)
    core = {}
    for k in range(1, 21):
        left = set(around)
        while gone := {n for n in left if len(around[n] & left) < k}:
            left -= gone
        core |= {n: k for n in left}
    read = []
    lowered = graph.lowered

    def counted(edges, moved, top):
        read.append(edges.join(moved, "dst").count())
        return lowered(edges, moved, top)

    monkeypatch.setattr(graph, "lowered", counted)
    got = graph.core_numbers(spark.createDataFrame(list(edges), "a long, b long"), "a", "b")
    assert {n["node"]: n["core"] for n in got.collect()} == {n: c if c >= 2 else 0 for n, c in core.items()}
    # later rounds read the edges of moved nodes, a falling part of all
    assert read[-1] == 0 and all(n < 2 * len(edges) for n in read) and read[-2] < read[0]
