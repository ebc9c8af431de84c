"""Operators against brute force on small tables, hot keys included."""

import itertools
import random
import statistics
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as C
from tessera.functions import text as X
from tessera.functions.rules import REPEATED_LETTER_RULE
from tessera.operators import metrics as Q
from tessera.operators import sampling as S
from tessera.operators import vocabulary
from tessera.operators.aggregates import mode_per_key, second_highest
from tessera.operators.encoders import count_vectors
from tessera.operators.expected_f1 import best_baskets, best_size
from tessera.operators.graph import core_numbers
from tessera.operators.joins import common_neighbours
from tessera.operators.neighbours import nearest
from tessera.operators.ranges import dense_codes, group_quantiles, number_chunks, range_bucket, split_window
from tessera.operators.vocabulary import letter_score, spelling_neighbours
from tessera.sources.writers import svmlight_lines


def hot_rows(n=600, seed=3):
    """(key, at, id, value): one key holds most rows and times repeat."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.7 else f"k{rng.randrange(20)}", rng.randrange(40), i, float(rng.randrange(100))) for i in range(n)]


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("calendar", [False, True])
def test_split_window_equals_a_plain_window(spark, calendar):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "key string, at int, id long, value double")
    bucket = F.floor(F.col("at") / 5) if calendar else None
    got = split_window(df, ["key"], ["at", "id"], bucket=bucket, row_number="rn", lags={"before": "value"}, sums={"run": "value"})
    got = {r["id"]: (r["rn"], r["before"], r["run"]) for r in got.collect()}
    for group in by_key(rows).values():
        total, last = 0.0, None
        for i, r in enumerate(group, start=1):
            total += r[3]
            assert got[r[2]] == (i, last, total)
            last = r[3]


def test_split_window_keeps_null_keys_and_null_values(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, None), (None, 3, 4.0), ("a", 1, None)], "key string, at int, v double")
    got = split_window(df, ["key"], ["at"], row_number="rn", lags={"before": "v"}, sums={"run": "v"})
    assert sorted(got.select("key", "at", "rn", "before", "run").collect(), key=str) == sorted(
        [(None, 1, 1, None, 2.0), (None, 2, 2, 2.0, 2.0), (None, 3, 3, None, 6.0), ("a", 1, 1, None, None)], key=str)


def test_ranges_cut_a_hot_key(spark):
    df = spark.range(5000).select(F.lit("hot").alias("key"), F.col("id").alias("at"))
    sizes = df.groupBy(range_bucket(df, ["at"], 16).alias("b")).count().collect()
    assert len(sizes) == 16 and max(r["count"] for r in sizes) < 5000 / 4


def test_group_quantiles_match_interpolation(spark):
    rows = hot_rows(seed=5)
    df = spark.createDataFrame(rows, "key string, at int, id long, value double")
    got = {r["key"]: (r["m"], r["q"]) for r in group_quantiles(df, ["key"], "value", {"m": 0.5, "q": 0.9}).collect()}
    for key, group in by_key(rows).items():
        values = [r[3] for r in group]
        assert got[key][0] == pytest.approx(statistics.median(values))
        assert got[key][1] == pytest.approx(np.quantile(values, 0.9))


def test_dense_codes_and_chunks(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "v string")
    assert sorted(map(tuple, dense_codes(df, "v", "c").collect())) == [("a", 1), ("b", 2), ("c", 3)]
    long = spark.range(25).select(F.lit("x").alias("k"), "id")
    chunks = number_chunks(long, ["k"], "id", size=10).orderBy("chunk").collect()
    assert [len(r["items"]) for r in chunks] == [10, 10, 5]
    assert [x for r in chunks for x in r["items"]] == list(range(25))


def test_mode_takes_the_lowest_on_ties_and_second_highest(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("a", 2), ("a", 1), ("b", 5)], "k string, v int")
    assert sorted(map(tuple, mode_per_key(df, ["k"], "v", "m").collect())) == [("a", 1), ("b", 5)]
    assert sorted(map(tuple, second_highest(df, ["k"], "v", "s").collect())) == [("a", 1), ("b", 0)]


def test_core_numbers_match_peeling(spark):
    rng = random.Random(11)
    edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(160)} | {(0, i) for i in range(1, 40)}
    around = {n: set() for n in range(40)}
    for a, b in edges:
        around[a].add(b)
        around[b].add(a)
    want = {}
    for k in range(1, 21):
        alive = set(around)
        while True:
            out = {n for n in alive if len(around[n] & alive) < k}
            if not out:
                break
            alive -= out
        for n in alive:
            want[n] = k
    got = {r["node"]: r["core"] for r in core_numbers(spark.createDataFrame(sorted(edges), "a long, b long"), "a", "b").collect()}
    assert got == {n: (k if k >= 2 else 0) for n, k in want.items()}


def test_common_neighbours_with_a_hub(spark):
    rng = random.Random(2)
    edges = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(90)} | {(0, i) for i in range(1, 30)}
    around = {n: {b if a == n else a for a, b in edges if n in (a, b)} for n in range(30)}
    got = common_neighbours(spark.createDataFrame(sorted(edges), "a long, b long"), "a", "b").collect()
    assert {(r["a"], r["b"]): r["common"] for r in got} == {(a, b): len(around[a] & around[b]) for a, b in edges}


def expected_f1(p, k, none):
    """Expected F1 of choosing the first k items, over all outcomes."""
    total = 0.0
    for bits in itertools.product([0, 1], repeat=len(p)):
        chance = float(np.prod([q if b else 1 - q for q, b in zip(p, bits)]))
        truth, hit = sum(bits), sum(bits[:k])
        if none:
            score = (2 / (1 + k + 1)) if truth == 0 else 2 * hit / (k + 1 + truth)
        else:
            score = 0.0 if k + truth == 0 else 2 * hit / (k + truth)
        total += chance * score
    return total


@pytest.mark.parametrize("seed", range(5))
def test_best_size_maximises_expected_f1(seed):
    p = np.sort(np.random.RandomState(seed).uniform(0.02, 0.9, 7))[::-1]
    options = {(k, none): expected_f1(p, k, none) for k in range(8) for none in (True, False)}
    size, none, value = best_size(p)
    assert value == pytest.approx(max(options.values()))
    assert options[(size, none)] == pytest.approx(value)


def test_best_baskets(spark):
    df = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (1, 12, 0.06), (1, 13, 0.01), (2, 10, 0.1)], "order_id long, product_id long, prediction double")
    assert dict(map(tuple, best_baskets(df).collect())) == {1: "10 11", 2: "None"}


def test_kendall_matches_pairs(spark):
    rng = random.Random(4)
    rows = [(float(rng.randrange(6)), float(rng.randrange(9))) for _ in range(120)]
    df = spark.createDataFrame(rows, "a double, b double")
    s = t1 = t2 = n0 = 0
    for (a, b), (c, d) in itertools.combinations(rows, 2):
        n0 += 1
        t1, t2 = t1 + (a == c), t2 + (b == d)
        s += np.sign((a - c) * (b - d))
    got = df.limit(1).select(Q.kendall_tau_b(df, "a", "b").alias("t")).first()[0]
    assert got == pytest.approx(s / ((n0 - t1) * (n0 - t2)) ** 0.5)


@pytest.mark.parametrize("clustered", [False, True])
def test_nearest_is_exact(spark, clustered):
    rng = np.random.RandomState(9)
    vectors = rng.normal(size=(150, 4)) + (rng.randint(0, 5, (150, 1)) * 10 if clustered else 0)
    vectors[10] = vectors[11]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vector array<float>")
    got = {}
    for r in nearest(df, df, 5, pivots=8, skip_same_id=True).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["id"]
    v = vectors.astype(np.float32).astype(float)
    for q in range(150):
        order = sorted((float(np.abs(v[q] - v[i]).sum()), i) for i in range(150) if i != q)[:5]
        assert [got[q][k] for k in range(1, 6)] == [i for _, i in order]


@pytest.mark.parametrize("word, other, score", [
    ("banana", "banana", 0.98998),   # 0.33 for each of the three lengths
    ("banana", "bananas", 0.823313),  # the same, less 1 / 6 for the shorter word
    ("bananas", "banana", 0.821843),  # 6 of 7 letters, 5 of 6 pairs, 4 of 5 triples
    ("banana", "bandit", 0.0),        # three of the other's six letters
])
def test_letter_score_worked_by_hand(spark, word, other, score):
    df = spark.createDataFrame([(word, other)], "c string, r string")
    assert abs(df.select(letter_score(F.col("c"), F.col("r"))).first()[0] - score) < 1e-5


def test_spelling_neighbours_lose_no_match(spark):
    rng = random.Random(8)
    stems = ["banana", "bandana", "bananas", "banding", "bandage"]
    words = {w: 11 + rng.randrange(50) for w in stems}
    while len(words) < 150:
        w = list(rng.choice(stems))
        for _ in range(rng.randrange(1, 3)):
            w[rng.randrange(3, len(w))] = rng.choice("abndge")
        words["".join(w) + rng.choice(["", "a", "an"])] = 11 + rng.randrange(50)
    pairs = spark.createDataFrame([(c, r) for c in words for r in words], "c string, r string")
    scores = {(x["c"], x["r"]): x["s"] for x in pairs.select("c", "r", letter_score(F.col("c"), F.col("r")).alias("s")).collect()}
    want = {}
    for c, n in words.items():
        best = None
        for r, m in words.items():
            if r[:3] == c[:3] and abs(len(r) - len(c)) <= 3 and (m > n or (m == n and r < c)):
                score = round(scores[c, r], 6)
                if score > 0.60 and (best is None or (score, m, r) > best):
                    best = (score, m, r)
        if best:
            want[c] = best[2]
    got = spelling_neighbours(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {r["word"]: r["near"] for r in got.collect()} == want


def test_square_code_takes_31_for_multiples(spark):
    df = spark.createDataFrame([(n, (n ** 0.5) / 40) for n in (1, 30, 31, 62, 64, 19, 1600)], "n int, reg double")
    a, m = C.square_code(F.col("reg"))
    got = {r["n"]: (r["a"], r["m"]) for r in df.select("n", a.alias("a"), m.alias("m")).collect()}
    assert got == {1: (1, 0), 30: (30, 0), 31: (31, 0), 62: (31, 1), 64: (2, 2), 19: (-1, 0), 1600: (-1 if 1600 % 31 == 19 else 1600 % 31, -1 if 1600 // 31 == 51 else 1600 // 31)}


def test_repeated_letters_and_numbers(spark):
    df = spark.createDataFrame([("soooo coooool aab 12,345 7 x9 88",)], "t string")
    row = df.select(X.replace_all("t", [REPEATED_LETTER_RULE]).alias("r"), F.array_join(X.marked_words("t"), " ").alias("m")).first()
    assert row["r"] == "so col aab 12,345 7 x9 88"
    assert row["m"] == "soooo coooool aab numcus , numcus 7 x9 numcus"


def test_folds_cover_each_row_once_and_balance_classes(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    cells = S.stratified_folds(df, "id", "y", 5).groupBy("fold", "y").count().collect()
    assert {(r["y"], r["count"]) for r in cells} == {(0, 180), (1, 20)}


def test_equal_bags_have_equal_size(spark):
    df = spark.createDataFrame([(b, i) for b in range(6) for i in range(1 + 3 * b)], "bag long, instance long")
    out = S.equal_bags(df, "bag", "instance", 5)
    assert {r["count"] for r in out.groupBy("bag").count().collect()} == {5}


def test_gini_forms_agree(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.randrange(2), round(rng.random(), 2)) for i in range(200)], "id long, y int, p double")
    one = Q.gini(df, "y", "p", "id").first()["gini_normalised"]
    two = Q.gini_pairwise(df, "y", "p", "id").first()["gini"]
    assert one == pytest.approx(two)


def test_null_and_nan_orders_do_not_depend_on_the_cut_points(spark):
    import math

    from tessera.operators import ranges as R
    values = [None] * 3 + [float("nan")] * 2 + [random.Random(3).random() for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    order = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] is not None and math.isnan(values[i]), values[i] if values[i] is not None and not math.isnan(values[i]) else 0, i))
    want = {i: r + 1 for r, i in enumerate(order)}
    for parts in (2, 4, 32):
        got = R.split_window(df, [], ["v", "id"], row_number="r", parts=parts).collect()
        assert {x["id"]: x["r"] for x in got} == want
        tied = {str(x["v"]): (x["ties"], x["r"]) for x in _average_ranks(df, parts)}
        assert tied["None"] == (3, 2.0) and tied["nan"] == (2, len(values) - 0.5)


def _average_ranks(df, parts):
    from tessera.operators import ranges as R
    kept, R.default_parts = R.default_parts, lambda _: parts
    try:
        return R.average_rank(df, "v", "r").collect()
    finally:
        R.default_parts = kept


def test_rank_mean_keeps_rows_without_a_prediction(spark):
    from tessera.operators.blends import rank_mean
    df = spark.createDataFrame([(1, 0.1, None), (2, 0.2, 0.5), (3, 0.3, 0.4)], "id long, a double, b double")
    got = {r["id"]: r["m"] for r in rank_mean(df, "id", ["a", "b"], "m").collect()}
    assert got == pytest.approx({1: 1 / 3, 2: (2 + 3) / 6, 3: (3 + 2) / 6})


def test_long_texts_with_a_common_start_are_split(spark):
    from tessera.operators.ranges import range_bucket
    df = spark.createDataFrame([("https://example.com/" + "a" * 80 + f"/{i:04d}",) for i in range(600)], "u string")
    counts = df.groupBy(range_bucket(df, ["u"], 16).alias("b")).count().collect()
    assert len(counts) > 8 and max(r["count"] for r in counts) < 200


def test_words_of_any_script(spark):
    from tessera.functions import rules
    from tessera.functions import text as X
    df = spark.createDataFrame([("Für größe café r u",)], "t string")
    row = df.select(X.regex_words("t").alias("a"), X.letter_words("t").alias("b"), X.replace_all("t", rules.COMMENT_RULES).alias("c")).first()
    assert row["a"] == ["für", "größe", "café"] and row["b"] == ["für", "größe", "café", "r", "u"]
    assert row["c"] == "Für größe café are you"


def test_one_hot_beyond_a_thousand_levels(spark):
    from tessera.operators import encoders as E
    df = spark.range(2000).select("id", F.concat(F.lit("v"), F.col("id")).alias("c"))
    assert len(E.one_hot(df, ["c"])) == 2000
    cells = E.sparse_one_hot(df, "id", ["c"]).collect()
    assert len({r["slot"] for r in cells}) == len(cells) == 2000


def test_best_size_matches_all_outcomes():
    from itertools import product

    from tessera.operators.expected_f1 import best_size
    rng = np.random.RandomState(4)
    for n in (1, 2, 4, 6):
        p = np.sort(rng.rand(n))[::-1]

        def expected(k, none):
            total = 0.0
            for bought in product([0, 1], repeat=n):
                chance = np.prod([q if b else 1 - q for q, b in zip(p, bought)])
                truth = {i for i in range(n) if bought[i]} or {"None"}
                chosen = set(range(k)) | ({"None"} if none else set())
                both = len(truth & chosen)
                total += chance * (2 * both / (len(truth) + len(chosen)) if both else 0.0)
            return total

        size, none, score = best_size(p)
        best = max(expected(k, x) for k in range(n + 1) for x in (False, True))
        assert score == pytest.approx(best) and expected(size, none) == pytest.approx(best)


def test_nearest_sends_rows_only_where_they_are_searched(spark):
    from tessera.operators import neighbours as N
    rng = np.random.RandomState(5)
    centres = rng.rand(60, 4) * 50
    rows = [(i, [float(x) for x in centres[i % 60] + rng.rand(4)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    got = N.nearest(df, df, 3, skip_same_id=True).collect()
    m = np.array([r[1] for r in rows], dtype=np.float32).astype(float)
    for q in range(0, 1500, 97):
        gaps = np.abs(m - m[q]).sum(axis=1)
        want = sorted((round(float(g), 4), i) for i, g in enumerate(gaps) if i != q)[:3]
        assert sorted((round(r["distance"], 4), r["id"]) for r in got if r["qid"] == q) == want


def test_gram_places_of_long_texts(spark):
    from tessera.plans.pairs import gram_table
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(30000)}" for _ in range(20000)) for _ in range(2)]
    df = spark.createDataFrame([(1, *texts), (2, "a bb cc", "dd"), (3, "", "x")], "id long, a string, b string")
    got = {r["id"]: r for r in gram_table(df, "id").collect()}
    other = set(texts[1].split())
    assert got[1]["a1_in_b"] == sum(w in other for w in texts[0].split())
    assert got[2]["a1_in_b"] == 0 and got[2]["pos_a1_max"] == 0 and got[3]["count_a1"] == 0


def test_fold_means_leave_the_own_fold_out(spark):
    from tessera.operators.fills import fold_mean_fill
    df = spark.createDataFrame([(0, 1.0), (0, None), (1, 3.0), (1, None), (2, 5.0)], "f int, x double")
    got = sorted((r["f"], r["x"]) for r in fold_mean_fill(df, ["x"], "f").collect())
    assert got == [(0, 1.0), (0, 4.0), (1, 3.0), (1, 3.0), (2, 5.0)]


def test_joined_chunks_and_replaced_words(spark):
    from tessera.operators.topk import joined_chunks
    from tessera.operators.vocabulary import replace_words
    df = spark.createDataFrame([("k", i, 24 - i) for i in range(25)] + [("j", 1, 1)], "k string, v long, o long")
    got = {(r["k"], r["chunk"]): r["t"] for r in joined_chunks(df, ["k"], "v", "t", ["o"], size=10).collect()}
    assert got[("k", 0)].split() == [str(24 - i) for i in range(10)] and got[("k", 2)].split() == ["4", "3", "2", "1", "0"]
    assert got[("j", 0)] == "1" and len(got) == 4
    texts = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, ["c"])], "id long, w array<string>")
    table = spark.createDataFrame([("a", "x")], "word string, replacement string")
    assert {r["id"]: r["tokens"] for r in replace_words(texts, "id", F.col("w"), table).collect()} == {1: ["x", "b", "x"], 2: [], 3: ["c"]}


def test_noise_is_the_same_again_and_standard_normal(spark):
    from tessera.operators.sampling import with_noise
    df = spark.range(4000).select("id", F.lit(1.0).alias("x"))
    one = [r["x"] for r in with_noise(df, F.col("id").cast("string"), "x", 1.0, 3).orderBy("id").collect()]
    assert one == [r["x"] for r in with_noise(df.repartition(5), F.col("id").cast("string"), "x", 1.0, 3).orderBy("id").collect()]
    assert abs(statistics.mean(one) - 1) < 0.1 and abs(statistics.stdev(one) - 1) < 0.05


def test_nearest_holds_few_distances_at_once(spark, monkeypatch):
    from tessera.operators import neighbours as N
    monkeypatch.setattr(N, "CELLS", 500)
    frame = pd.DataFrame({"id": range(90), "vector": [np.array([float(i), 0.0], dtype=np.float32) for i in range(90)]})
    assert [len(p) for p in N._slices(frame, 20)] == [25, 25, 25, 15]
    rows = [(i, [float(i % 40), float(i // 40)]) for i in range(300)] + [(i, [3.0, 3.0]) for i in range(300, 340)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    got = {}
    for r in N.nearest(df, df, 4, pivots=6, skip_same_id=True).collect():
        got.setdefault(r["qid"], []).append((r["distance"], r["id"]))
    for q, v in rows[::7]:
        want = sorted((abs(v[0] - w[0]) + abs(v[1] - w[1]), i) for i, w in rows if i != q)[:4]
        assert sorted(got[q]) == want


def test_smallest_takes_the_first_on_ties():
    from tessera.operators.neighbours import _smallest
    gaps = np.array([[2.0, 1.0, 1.0, 1.0, 0.0], [5.0, 4.0, 3.0, 2.0, 1.0]])
    assert [list(map(int, x)) for x in _smallest(gaps, 2)] == [[0, 0, 1, 1], [1, 4, 3, 4]]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_window_sorts_small_keys_whole(spark, monkeypatch):
    from pyspark.sql import Window
    from tessera.operators import ranges as R
    rows = [(None if k == 3 else k, i, i % 7) for k, n in ((0, 40), (1, 3), (2, 1), (3, 25)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    order = Window.partitionBy("k").orderBy("i")
    want = sorted(map(tuple, df.select(
        "*", F.row_number().over(order).alias("r"), F.lag("v").over(order).alias("before"),
        F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
    ).collect()), key=repr)
    ask = dict(row_number="r", lags={"before": "v"}, sums={"s": "v"})
    small = R.split_window(df, ["k"], ["i"], **ask)
    assert "Join" not in plan_of(small)
    # keys above LARGE, the null one among them, are cut into ranges
    monkeypatch.setattr(R, "LARGE", 10)
    large = R.split_window(df, ["k"], ["i"], parts=4, **ask)
    assert "Join" in plan_of(large)
    for got in (small, large):
        assert got.columns == [*df.columns, "r", "before", "s"]
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_reorders_are_marked_without_a_join(spark):
    from tessera.operators.sequences import mark_reorders
    rows = [(1, 5, 2), (1, 5, 1), (1, 6, 2), (2, 5, 3), (2, 5, 3), (None, 5, 1), (1, None, 4)]
    got = mark_reorders(spark.createDataFrame(rows, "user_id long, product_id long, order_number long"))
    assert "Join" not in plan_of(got)
    assert sorted(map(tuple, got.collect())) == [(1, 5, 1, 0), (1, 5, 2, 1), (1, 6, 2, 0), (2, 5, 3, 0), (2, 5, 3, 0)]


def test_terms_of_dealt_texts_are_not_shuffled_with_their_key(spark):
    from math import log, sqrt
    from tessera.operators import encoders as E
    docs = spark.createDataFrame([(1, "a b a"), (2, "a c"), (2, "c d"), (None, "a b"), (3, "")], "doc_id long, text string").repartition("doc_id")
    terms = docs.select("doc_id", F.explode(F.split("text", " ")).alias("term")).where("term <> ''")
    for min_df in (1, 2):
        df = E.tfidf(terms, "doc_id", "term", min_df=min_df, max_features=2)
        assert "SortMergeJoin" not in plan_of(df) and "hashpartitioning(doc_id#" not in plan_of(df).split("Window", 1)[0]
        got = {(r["doc_id"], r["term"]): r["value"] for r in df.collect()}
        # a occurs 4 times in 3 texts, b and c twice: b in 2 texts, c in one
        a, b = log(3 / 4) + 1, log(3 / 3) + 1
        one, two = (1 + log(2)) * a, b
        norm = sqrt(one * one + two * two)
        assert got == pytest.approx({(1, "a"): one / norm, (1, "b"): two / norm, (2, "a"): 1.0})
    grams = terms.select("doc_id", F.lit(1).alias("n"), F.col("term").alias("g"))
    cells = E.count_vectors(grams, "doc_id", "n", "g", min_df=2)
    assert "hashpartitioning(doc_id#" in plan_of(cells) and ", n#" not in "".join(
        x for x in plan_of(cells).splitlines() if "hashpartitioning(doc_id#" in x)
    assert sorted(map(tuple, cells.where("doc_id is not null").collect())) == [(1, 0, 2.0), (1, 1, 1.0), (2, 0, 1.0)]


def test_char_gram_rows_are_all_grams(spark):
    from tessera.operators.encoders import char_gram_rows
    texts = {1: "abcabcab", 2: "é€𝄞x", 3: "a", 4: "", 5: "ab", 6: None}
    df = spark.createDataFrame(list(texts.items()), "k long, t string")
    want = Counter((k, t[i:i + n]) for k, t in texts.items() if t for n in range(2, 7) for i in range(len(t) - n + 1))
    assert Counter(map(tuple, char_gram_rows(df, "k", "t", 2, 6).collect())) == want


def test_sentence_vectors_ask_for_each_word_once_per_group(spark, monkeypatch):
    from tessera.operators import similarity as M
    from tessera.plans.pairs import vector_table
    monkeypatch.setattr(M, "GROUP_WORDS", 40)
    rng = random.Random(5)
    vectors = {f"w{i}": [rng.uniform(-1, 1) for _ in range(3)] for i in range(9)} | {"zero": [0.0] * 3}
    text = lambda: " ".join(rng.choice([*vectors, "other"]) for _ in range(rng.randrange(30)))
    rows = [(i // 2, text(), text()) for i in range(80)] + [(50, None, ""), (51, "zero", "other"), (None, "w1", "w2")]
    table = [(w, v) for w, v in vectors.items()] + [("w3", [1.0, 2.0, 3.0]), ("w4", None)]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    v = spark.createDataFrame(table, "word string, vector array<float>")
    got = M.sentence_vectors(df, "k", v, {"va": X.letter_words("a"), "vb": X.letter_words("b")})
    asked = {w: np.zeros(3) for w, _ in table}
    for w, x in table:
        asked[w] = asked[w] + np.array(x or [0.0] * 3)
    want = {}
    for k, a, b in rows:
        for side, t in ((0, a), (1, b)):
            for w in (t or "").split():
                if w in asked:
                    both = want.setdefault(k, [None, None])
                    both[side] = (0 if both[side] is None else both[side]) + asked[w]
    found = {r.k: (r.va, r.vb) for r in got.collect()}
    assert set(found) == {k for k, _, _ in rows}
    for k, sides in found.items():
        for mine, theirs in zip(sides, want.get(k, [None, None])):
            if theirs is None:
                assert mine is None
            else:
                length = np.linalg.norm(theirs)
                assert np.allclose(mine, theirs / (length or 1.0), atol=1e-6)
    # vectors meet words by group, not a row for every word of a text
    assert "CoGroup" in got._jdf.queryExecution().analyzed().toString()
    assert vector_table(df.where("k is not null").dropDuplicates(["k"]), "k", v).count() == 42


def test_comment_texts_and_counts_need_no_lambdas(spark):
    import re
    from tessera.functions import rules
    texts = ["I'm n't don't a'll'll they're b'd've x's won't", "'ll 's\b12 3-4 \n it's#", "a@b.c,d@e.f @x y@z.q w@v", "", "no marks 12:30 ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")

    def cleaned(t):
        t = re.sub("[\n\t\b\r]", " ", t.lower())
        for p, r in rules.CHAR_GRAM_RULES:
            t = re.sub(p, r.replace("$1", "\\1"), t)
        words = [re.sub(X.PUNCTUATION, "", w) for w in re.split(r"\s+", t) if w]
        return re.sub(r"\s+", " ", re.sub(r"\d+", " ", " ".join(words))).replace(" ", "# #")

    both = df.select("k", "t", X.char_gram_text("t").alias("c"))
    got = both.select("k", "c", *[c.alias(n) for n, c in X.comment_counts(F.col("t"), F.col("c")).items()])
    assert "lambda" not in got._jdf.queryExecution().analyzed().toString()
    for row in got.collect():
        t = texts[row.k]
        assert row.c == (None if t is None else cleaned(t))
        assert row.has_mail == (None if t is None else len(re.findall(X.ADDRESS, t)))
        assert row.clean_chars == (None if t is None else len(set(cleaned(t))))


def test_group_counts_shuffle_rows_once_for_each_fine_column(spark, monkeypatch):
    from tessera.operators import aggregates as A
    rng = random.Random(11)
    some = lambda *v: rng.choice([*v, None])
    rows = [(some(1, 2), some(*range(30)), some("x", "y", "z"), some(*range(40)), i) for i in range(400)]
    rows += [(1, 7, "x", 500 + i, -i) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b int, c string, d int, v int")
    columns = "abcd"
    groups = {"n_" + "_".join(g): list(g) for n in (1, 2, 3) for g in itertools.combinations(columns, n)}
    at = {name: [columns.index(c) for c in cols] for name, cols in groups.items()}
    seen = {name: Counter(tuple(r[i] for i in places) for r in rows) for name, places in at.items()}
    want = sorted(([*r, *[seen[n][tuple(r[i] for i in places)] for n, places in at.items()]] for r in rows), key=repr)
    for few, large, shuffles in ((0, 1000, 4), (0, 250, 99), (1 << 16, 1000, 99), (0, 1, 99)):
        monkeypatch.setattr(A, "_FEW_GROUPS", few)
        monkeypatch.setattr(A, "LARGE", large)
        got = A.with_group_counts(df, groups)
        assert got.columns == [*df.columns, *groups]
        assert plan_of(got).count("Exchange hashpartitioning") <= shuffles
        assert sorted(map(list, got.collect()), key=repr) == want
    assert sorted(map(list, A.with_group_counts(df.limit(0), groups).collect())) == []


def test_set_chains_sort_each_set_with_a_prefix_of_the_longest():
    from tessera.operators.aggregates import _chains
    sets = {"p": "p", "ap": "pa", "wp": "pw", "wap": "pwa", "cp": "pc"}
    chains = _chains({n: list(s) for n, s in sets.items()})
    assert sorted(n for chain in chains for n, _ in chain) == sorted(sets) and len(chains) == 3
    for chain in chains:
        for name, cols in chain:
            assert sorted(cols) == sorted(sets[name]) and chain[-1][1][: len(cols)] == list(cols)


def test_count_features_keep_counted_rows_without_a_key_out(spark):
    from tessera.plans.demand import TRIPLES, count_features
    names = ["week", "agency", "channel", "route", "client", "product"]
    rng = random.Random(5)
    rows = [tuple([rng.randrange(3) if rng.random() < 0.95 else None for _ in names] + [float(i)]) for i in range(200)]
    got = count_features(spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names) + ", demand double"))
    assert got.columns[:7] == ["product", "client", "route", "channel", "agency", "week", "demand"]
    groups = [g for n in (1, 2) for g in itertools.combinations(names, n)] + TRIPLES
    whole = {r["demand"]: r for r in got.collect()}
    assert sorted(whole) == [r[6] for r in rows if None not in r]
    codes = {n: {v: i for i, v in enumerate(sorted({r[k] for r in rows} - {None}), 1)} for k, n in enumerate(names)}
    for g in groups:
        places = [names.index(c) for c in g]
        seen = Counter(tuple(r[i] for i in places) for r in rows)
        assert all(whole[r[6]]["_".join(g) + "_cnt"] == seen[tuple(r[i] for i in places)] for r in rows if r[6] in whole)
    for k, n in enumerate(names):
        assert all(whole[r[6]][f"{n}_id"] == codes[n][r[k]] for r in rows if r[6] in whole)


def test_similar_sets_shuffle_into_a_task_per_bounded_number_of_rows(spark, monkeypatch):
    from tessera import session
    from tessera.operators import set_join
    rng = random.Random(9)
    sets = {i: {rng.randrange(12) for _ in range(rng.randrange(1, 6))} for i in range(60)}
    rows = [(i, v) for i, s in sets.items() for v in s]
    df = spark.createDataFrame([*rows, *rows[:20], (99, None), (None, 3)], "id long, item long")
    seen = []
    cut = set_join.cut_lineage
    monkeypatch.setattr(set_join, "cut_lineage", lambda d: (seen.append(spark.conf.get(session.FIRST_PARTITIONS, None)), cut(d))[1])
    monkeypatch.setattr(session, "TASK_ROWS", 16)
    before = spark.conf.get(session.FIRST_PARTITIONS, None)
    got = set_join.set_pairs(df, df.where("id < 30"), 40)
    # sides by the rows of both, the pairs by the meetings of prefixes, which are many more
    assert int(seen[0]) >= len(rows) // 16 and int(seen[-1]) > int(seen[0])
    assert spark.conf.get(session.FIRST_PARTITIONS, None) == before
    want = sorted((i, j, len(s & t) / len(s | t)) for i, s in sets.items() for j, t in sets.items()
                  if j < 30 and len(s & t) * 100 >= 40 * len(s | t))
    assert sorted(tuple(r)[:3] for r in got.where("id is not null and id2 is not null").collect()) == want


def test_gini_sorts_the_rows_once_for_each_figure(spark):
    rng = random.Random(21)
    for rows in ([(i, rng.choice([0.0, 1.0, 1.0, None]), rng.randrange(5) / 4) for i in range(300)],
                 [(i, rng.choice([0.0, 0.5, 2.0]), rng.randrange(4) / 4) for i in range(200)]):
        df = spark.createDataFrame(rows, "id long, y double, p double")

        def gain(order):
            seen, total = 0.0, 0.0
            for r in order:
                seen += r[1] or 0
                total += seen
            n = len(rows)
            return (total / seen - (n + 1) / 2) / n

        by_target = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[0]))
        by_score = sorted(rows, key=lambda r: (-r[2], r[0]))
        got = Q.gini(df, "y", "p", "id")
        one = got.first()
        assert one["gini"] == pytest.approx(gain(by_score)) and one["gini_perfect"] == pytest.approx(gain(by_target))
    rows = [(i, rng.choice([0, 1, 1, None]), rng.randrange(5) / 4) for i in range(300)]
    known = sorted((r for r in rows), key=lambda r: (-r[2], r[0]))
    zeros, wrong, ones = 0, 0, sum(r[1] or 0 for r in rows)
    for r in known:
        zeros += r[1] == 0
        wrong += zeros * (r[1] or 0)
    pairwise = Q.gini_pairwise(spark.createDataFrame(rows, "id long, y int, p double"), "y", "p", "id")
    # rows are sorted by ranges and summed up there, not joined with what came before
    assert "Join" not in plan_of(pairwise)
    assert pairwise.first()["gini"] == pytest.approx(1 - 2 * wrong / (ones * (len(rows) - ones)))


def test_character_grams_are_counted_where_their_texts_lie(spark):
    from tessera.functions.text import char_ngrams
    from tessera.operators import similarity as M
    from tessera.plans.pairs import char_table
    texts = [(1, "abcab", "abd"), (2, "xyz", "xyz"), (3, "", "ab"), (4, None, "q"), (5, "zz top", "top zz")]
    df = spark.createDataFrame(texts, "id long, a string, b string")
    got = {r["id"]: r for r in char_table(df, "id").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    for n in (1, 2):
        a, b = ({t[i:i + n] for i in range(len(t) - n + 1)} for t in ("abcab", "abd"))
        assert got[1][f"g{n}_jaccard"] == pytest.approx(len(a & b) / len(a | b))
        assert got[2][f"g{n}_tfidf_cosine"] == pytest.approx(0) and got[2][f"g{n}_jaccard"] == 1
    # the grams' weights are a small table of known size: the grams are not shuffled to meet it
    grams = M.pair_grams(df.repartition(4, "id"), "id", char_ngrams("a", 2), char_ngrams("b", 2))
    plan = plan_of(M.gram_distances(grams, "id", F.lit(10)))
    assert "SortMergeJoin" not in plan and "hashpartitioning(gram" not in plan and "hashpartitioning(id#" in plan


def test_spelling_pairs_meet_in_rare_grams_of_both_words(spark):
    # words of one block that share "xyz" only, of many lengths: none can match
    rng = random.Random(2)
    words = ["abc" + "".join(rng.choice("defghijk") for _ in range(rng.randrange(1, 9))) + "xyz" for _ in range(60)]
    frame = spark.createDataFrame([(w, 20 + i) for i, w in enumerate(dict.fromkeys(words))], "word string, n long")
    grams = frame.select("word", "n", F.substring("word", 1, 3).alias("block"), F.explode(F.array_distinct(X.char_ngrams("word", 3))).alias("gram"))
    seen = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    ranked = grams.join(seen, "gram").groupBy("word", "n", "block").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("g"))
    met = vocabulary._share_rare(ranked)
    # lengths are part of the join: words more than three letters apart never meet
    assert met.where(F.abs(F.length("word") - F.length("near")) > 3).count() == 0
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "long" in [line for line in plan.splitlines() if "Join Inner" in line][0]
    assert met.select("word", "near").distinct().count() < len(set(words)) * 3


def test_svmlight_cells_are_dealt_once_by_their_text(spark):
    rows = spark.createDataFrame([(i % 7, i % 2, i % 5, float(i)) for i in range(70)], "doc long, y long, i long, v double")
    lines = svmlight_lines(rows.select("doc", (F.col("doc") % 2).alias("y"), "i", (F.col("i") * 0.5).alias("v")), "doc", "y", "i", "v")
    assert lines._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(r["line"] for r in lines.collect())[0] == "0 0:0.000000 1:0.500000 2:1.000000 3:1.500000 4:2.000000"


def test_coded_cells_are_joined_by_term_first(spark):
    grams = spark.createDataFrame([(d, 1 + w % 2, f"w{w}") for d in range(4) for w in range(6) for _ in range(d)], "doc long, n int, g string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = count_vectors(grams, "doc", "n", "g", min_df=3)
        plan = cells._jdf.queryExecution().executedPlan().toString()
        # a sort tells rows apart by its first key
        assert "SortMergeJoin [g#" in plan
        assert sorted(map(tuple, cells.collect())) == [(d, s, float(d)) for d in (1, 2, 3) for s in range(6)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
