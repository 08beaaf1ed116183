import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.functions import similarity
from pairlab.operators import (
    assemble,
    conformal,
    correlation,
    evaluation,
    features,
    fuzzy,
    knockout,
    pairs,
    quantiles,
    ranking,
    relevance,
    resolve,
    selection,
)
from pairlab.plans import serving, views


def test_orientation_covers_every_case(spark, rows):
    cases = [(1, 16, "x", "y", True), (16, 1, "x", "y", True), (5, 5, "x", "y", None), (None, 4, "x", "y", False),
             (4, None, "x", "y", True), (None, None, "a", "b", True), (None, None, "b", "a", True)]
    df = spark.createDataFrame(
        [(i, sa, sh, na, nh, w, None if w is None else not w) for i, (sa, sh, na, nh, w) in enumerate(cases)],
        "i int, away_seed int, home_seed int, away_name string, home_name string, away_winner boolean, home_winner boolean",
    )
    got = rows(pairs.orient_pairs(df, ("name", "seed"), ("i",)), "i")
    assert [g[1] for g in got] == ["x", "y", "x", "y", "x", "a", "a"]
    assert [g[5] for g in got] == [1, 0, 0, 1, 1, 1, 0]


def test_features_are_antisymmetric(spark, rows):
    values = [(1.0, 4.0, 2.0, 3.0), (0.0, 5.0, 5.0, None)]
    names = ["p_season", "p_away"]
    df = spark.createDataFrame(values, "a_p_season double, b_p_season double, a_p_away double, b_p_away double")
    flipped = df.toDF("b_p_season", "a_p_season", "b_p_away", "a_p_away")
    one = rows(df.select(*features.stat_diffs(df, names), features.variant_gaps(df, names)[2]))
    two = rows(flipped.select(*features.stat_diffs(flipped, names), features.variant_gaps(flipped, names)[2]))
    for x, y in zip(one, two):
        assert [None if v is None else -v + 0.0 for v in x] == [None if v is None else v + 0.0 for v in y]


def test_composites_skip_absent_terms(spark, rows):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, 1.0)], "a_m double, b_m double, a_n double, b_n double")
    specs = [
        features.Composite("x", {"m": 1.0}, {"n": 0.5, "gone": 9.0}),
        features.Composite("y", {"gone": 1.0}),
    ]
    assert rows(df.select(*features.composites(df, specs))) == [(1.0,)]


def test_wide_assembly(spark, rows):
    a = spark.createDataFrame([("k1", 1.0)], "k string, s double")
    b = spark.createDataFrame([("k1", 9.0, 2.0), ("k2", 8.0, 3.0)], "k string, s double, t double")
    assert rows(assemble.wide_assemble([a, b], ["k"]), "k") == [("k1", 1.0, 2.0), ("k2", None, 3.0)]
    assert rows(assemble.wide_assemble([a, b], ["k"], spine="first"), "k") == [("k1", 1.0, 2.0)]


def test_wide_assembly_of_differing_and_repeated_keys(spark, rows):
    a = spark.createDataFrame([("k1", 2, 1.0, None), ("k1", 1, 5.0, "x"), ("k2", 1, None, "y"), (None, 1, 7.0, "n")], "k string, turn int, s double, `a b` string")
    b = spark.createDataFrame([("k1", 9.0, 2), ("k3", 8.0, 3), ("k3", None, 1), (None, 1.0, 4)], "k string, s double, t int")
    c = spark.createDataFrame([("k3", True)] * 50 + [("k4", None)], "k string, _values boolean")
    wide = assemble.wide_assemble([a, b, c], ["k"], order=["turn"])
    assert wide.columns == ["k", "turn", "s", "a b", "t", "_values"]
    got = {r[0]: tuple(r)[1:] for r in wide.collect()}
    assert got == {
        None: (1, 7.0, "n", 4, None),
        "k1": (1, 5.0, "x", 2, None),
        "k2": (1, None, "y", None, None),
        "k3": (None, None, None, 1, True),  # the frame's values are compared once s belongs to the first
        "k4": (None, None, None, None, None),
    }
    unordered = {r[0]: tuple(r)[1:] for r in assemble.wide_assemble([a, b, c], ["k"]).collect()}
    assert unordered["k1"] == (1, 5.0, "x", 2, None)  # fewest nulls first
    first = assemble.wide_assemble([a, b, c], ["k"], spine="first", order=["turn"])
    assert {r[0]: tuple(r)[1:] for r in first.collect()} == {k: v for k, v in got.items() if k in (None, "k1", "k2")}
    assert assemble.wide_assemble([a.limit(0), b.limit(0)], ["k"]).count() == 0


def test_pair_join_with_salts_is_the_same(spark, rows):
    df = spark.createDataFrame([(i, i % 2, 7, 2000) for i in range(20)], "g int, a_id int, b_id int, period int")
    stats = spark.createDataFrame([(0, 2000, 1.0), (1, 2000, 2.0), (7, 2000, 3.0)], "id int, period int, s double")
    sides = {"a": "a_id", "b": "b_id"}
    plain = assemble.pair_dim_join(df, stats, "id", "period", sides).select("g", "a_s", "b_s")
    salted = assemble.pair_dim_join(df, stats, "id", "period", sides, salts=4).select("g", "a_s", "b_s")
    assert rows(plain, "g") == rows(salted, "g")


@pytest.mark.parametrize("salts", [1, 3])
def test_pairs_meet_both_sides_in_one_shuffle(spark, rows, salts):
    games = [(i, i % 7 if i % 9 else None, f"n{i % 5}", 2000 + i % 3 if i % 11 else None) for i in range(200)]
    df = spark.createDataFrame(games, "g int, a_id int, name string, period int").withColumn("b_id", F.col("g") * 3 % 8)
    stats = spark.createDataFrame([(e, p, e + p / 10000, "x") for e in range(6) for p in (2000, 2001)], "id int, period int, s double, t string")
    sides = {"a": "a_id", "b": "b_id"}
    plain = assemble.pair_dim_join(df, stats, "id", "period", sides, drop=["t"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = assemble.pair_dim_join(df, stats, "id", "period", sides, drop=["t"], salts=salts, blocks=3)
        assert met.columns == plain.columns
        assert rows(met, "g") == rows(plain, "g") and met.filter("a_s is null").count() > 20
        planned = met._jdf.queryExecution().executedPlan().toString()
        assert planned.count("Exchange hashpartitioning") == 3, planned  # pairs, and the table for each side
        wider = stats.withColumn("id", F.col("id").cast("bigint"))  # equal ids of two types have other hashes
        assert rows(assemble.pair_dim_join(df, wider, "id", "period", sides, drop=["t"], blocks=3), "g") == rows(plain, "g")
        named = assemble.pair_dim_join(df, stats.withColumn("id", F.concat(F.lit("n"), "id")), "id", "period", {"a": "name"}, blocks=3)
        assert named.filter("a_s is not null").count() == df.filter("period < 2002").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges_between_joins(spark, build):
    """Exchanges between the last join and the one below it on its left, where nothing is broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = build().select("*")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [i for i, line in enumerate(plan) if "SortMergeJoin" in line]
    return [line for line in plan[joins[0] : joins[1]] if "Exchange" in line]


def test_contests_cross_no_shuffle_with_statistics(spark):
    """The statistics of one side do not travel with the contests to the other side's."""
    assert not exchanges_between_joins(spark, lambda: views.joined_pairs(spark, "/root/testdata/sf0.001"))


def test_arriving_contests_cross_no_shuffle_with_statistics(spark):
    stats = views.entity_stats(spark, "/root/testdata/sf0.001").drop("entity_name", "n_facts")
    batch = views.pairs(spark, "/root/testdata/sf0.001").select(*serving.ARRIVING).limit(50)
    assert not exchanges_between_joins(spark, lambda: serving.pair_server(batch, stats))


def test_ids_are_consecutive_over_partitions(spark, rows):
    names = [f"n{random.Random(i).random():.12f}" for i in range(500)]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(7)
    got = rows(ranking.assign_ids(df, ["name"], partitions=5), "id")
    assert [(n, i) for n, i in got] == [(n, i + 1) for i, n in enumerate(sorted(names))]


@pytest.mark.parametrize("max_left", [1_000_000, 20])
def test_exact_quantiles_match_numpy(spark, max_left):
    rng = np.random.default_rng(3)
    groups = {
        "normal": rng.normal(size=501),
        "tied": np.r_[np.zeros(400), rng.normal(size=100)],
        "outlier": np.r_[rng.normal(size=300), 1e12, -1e9],
        "largest": np.r_[rng.normal(size=300), 1.7e308, -1.7e308],
        "one": np.array([4.0]),
        "two": np.array([1.0, 2.0]),
    }
    data = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("one", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r["g"], r["prob"]): r["threshold"] for r in quantiles.exact_quantiles(df, ["g"], "v", probs, 16, max_left).collect()}
    for (g, p) in itertools.product(groups, probs):
        assert got[g, p] == pytest.approx(np.quantile(groups[g], p), rel=1e-12, abs=1e-12)
    assert len(got) == len(groups) * len(probs)


def test_order_statistics_of_awkward_values(spark):
    """Values that the scale of the index can't tell apart, infinities and NaN, over several splits."""
    near = [1e15 + i for i in range(300)]
    groups = {
        "near": near,
        "huge": [1e308 * (1 + i / 400) for i in range(300)],
        "endless": [float("-inf"), *map(float, range(200)), *[float("inf")] * 3],
        "tiny": [i * 5e-324 for i in range(200)],
        "nan": [*map(float, range(50)), float("nan"), float("nan")],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(4)
    every = [(g, i) for g, vs in groups.items() for i in range(len(vs))]
    wanted = spark.createDataFrame([x for x in every if x[1] % 7 == 0 or x[1] > 195], "g string, _rank bigint")
    found = {(r["g"], r["_rank"]): r["_v"] for r in quantiles.order_statistics(df, ["g"], "v", wanted, bins=4, max_left=10).collect()}
    key = lambda v: (np.isnan(v), v)
    ranked = {g: sorted(vs, key=key) for g, vs in groups.items()}
    assert set(found) == {tuple(r) for r in wanted.collect()}
    assert all(np.array_equal(v, ranked[g][i], equal_nan=True) for (g, i), v in found.items())


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_cut_points_bound_every_range(spark, most):
    rng = np.random.default_rng(9)
    groups = {
        "normal": rng.normal(size=400),
        "near": 1e15 + np.arange(200.0),
        "tied": np.r_[np.zeros(100), rng.normal(size=50)],
        "one": np.array([3.0]),
    }
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    cuts = {r["g"]: r["_cuts"] for r in quantiles.cut_points(df, ["g"], "v", most, bins=4).collect()}
    assert set(cuts) == set(groups)
    for g, vs in groups.items():
        assert cuts[g] == sorted(set(cuts[g])) and all(c < vs.max() for c in cuts[g])
        place = np.searchsorted(cuts[g], vs, side="left")  # how many cuts lie below
        for part in range(len(cuts[g]) + 1):
            inside = vs[place == part]
            assert len(inside) and (len(inside) <= 2 * most or len(inside) - np.unique(inside, return_counts=True)[1].max() <= 2 * most)


def test_relevance_reads_its_rows_four_times(spark):
    rng = np.random.default_rng(6)
    data = [(f"f{p}", p, float(v), int(v > 0.2)) for p in range(5) for v in rng.normal(size=80)]
    long = spark.createDataFrame(data, "feature string, pos int, x double, y int")
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    found = selection.relevance(long.mapInPandas(watch, long.schema), mi="binned").collect()
    assert len(found) == 5 and seen.value == 4 * len(data)  # index, values at the cuts, cells, positions


def brute_mi(x, y, k=5):
    def psi(n):
        return sum(1 / j for j in range(1, int(n))) - 0.5772156649015329

    keep = [i for i in range(len(x)) if (y == y[i]).sum() > 1]
    x, y = x[keep], y[keep]
    used, sizes, near = [], [], []
    for i in range(len(x)):
        d = np.abs(x - x[i])
        same = np.sort(np.delete(d, i)[np.delete(y, i) == y[i]])
        need = min(k, len(same))
        r = same[need - 1]
        used.append(need)
        sizes.append(len(same) + 1)
        near.append((d < r).sum() if r > 0 else (d == 0).sum())
    mean = lambda v: np.mean([psi(n) for n in v])
    return max(0.0, psi(len(x)) + mean(used) - mean(sizes) - mean(near))


@pytest.mark.parametrize("buckets", [1, 4, 30])
def test_knn_information_matches_brute_force(spark, buckets):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 120)
    y[:1] = 2  # a class of one member
    y[1:4] = 3  # a class with fewer members than neighbours
    columns = {
        "informative": np.float32(rng.normal(size=120) + y).astype(float),
        "ties": np.round(rng.normal(size=120) * 2),
        "hot": np.where(rng.random(120) < 0.4, 0.0, np.float32(rng.normal(size=120))).astype(float),
        "constant": np.ones(120),
    }
    data = [(f, float(v), int(c)) for f, vs in columns.items() for v, c in zip(vs, y)]
    df = spark.createDataFrame(data, "feature string, x double, y int")
    got = {r["feature"]: r["mi"] for r in relevance.mi_knn(df, buckets=buckets).collect()}
    for name, values in columns.items():
        assert got[name] == pytest.approx(brute_mi(values, y), abs=1e-9), name


def test_jitter_breaks_ties_and_repeats(spark):
    rng = np.random.default_rng(12)
    y = rng.integers(0, 2, 400)
    x = np.where(rng.random(400) < 0.5, 0.0, rng.normal(size=400) + 2 * y)
    df = spark.createDataFrame([(i, "f", float(v), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id int, feature string, x double, y int")
    one, two = (relevance.mi_knn(df.repartition(n), jitter_by="id").first()["mi"] for n in (2, 5))
    assert one == pytest.approx(two)
    noisy = [brute_mi(x + 1e-10 * rng.normal(size=400), y) for _ in range(5)]
    assert one == pytest.approx(np.mean(noisy), abs=0.05)
    assert relevance.mi_knn(df).first()["mi"] < one


def test_mcc_of_constant_and_binary_features(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 60)
    columns = {"constant": np.ones(60), "binary": y.astype(float), "noise": rng.normal(size=60)}
    data = [(f, float(v), int(c)) for f, vs in columns.items() for v, c in zip(vs, y)]
    df = spark.createDataFrame(data, "feature string, x double, y int")
    got = {r["feature"]: r["mcc"] for r in relevance.mcc_scores(df).collect()}
    best = 0.0
    for q in (0.25, 0.5, 0.75):
        hit = columns["noise"] > np.quantile(columns["noise"], q)
        best = max(best, abs(np.corrcoef(hit, y)[0, 1]))
    assert got["constant"] == 0.0
    assert got["binary"] == pytest.approx(1.0)
    assert got["noise"] == pytest.approx(best)


def test_pearson_matrix_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5)) + 1e4
    x[:, 3] = 7.0
    x[:, 4] = x[:, 0] * 2 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(5))).repartition(4)
    got = {(r["i"], r["j"]): r["r"] for r in correlation.pearson_matrix(df, [f"c{i}" for i in range(5)]).collect()}
    with np.errstate(all="ignore"):
        want = np.corrcoef(x, rowvar=False)
    for i in range(5):
        for j in range(i, 5):
            if 3 in (i, j):
                assert got[i, j] is None
            else:
                assert got[i, j] == pytest.approx(want[i, j], abs=1e-9)


def test_pearson_matrix_sends_one_row_a_task(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)) + np.array([0.0, 1e8, -1e8, 5.0])
    x[:, 3] = 0.1
    df = spark.createDataFrame([(list(map(float, v)),) for v in x], "v array<double>").repartition(9)
    matrix = correlation.pearson_matrix(df, vector="v")
    got = {(r["i"], r["j"]): r["r"] for r in matrix.collect()}
    want = np.corrcoef(x[:, :3] - x[0, :3], rowvar=False)
    for i in range(3):
        assert got[i, 3] is None
        for j in range(i, 3):
            assert got[i, j] == pytest.approx(want[i, j], abs=1e-6)
    plan = matrix._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "Join" not in plan
    assert correlation.pearson_matrix(df.limit(0), vector="v").collect() == []


def brute_dedup(n, corr, ranks, limit):
    dropped = set()
    for i in range(n):
        if i in dropped:
            continue
        for j in range(i + 1, n):
            if j in dropped or abs(corr[i][j]) <= limit:
                continue
            if ranks[i] <= ranks[j]:
                dropped.add(j)
            else:
                dropped.add(i)
                break
    return sorted(dropped)


def test_dedup_matches_brute_force_in_many_runs(spark):
    rng = random.Random(1)
    edges, want = [], {}
    for run in range(12):
        n = 8
        ranks = [rng.randint(0, 4) / 2 for _ in range(n)]
        corr = [[0.0] * n for _ in range(n)]
        for i in range(n):
            for j in range(i + 1, n):
                corr[i][j] = rng.random()
                if corr[i][j] > 0.7:
                    edges.append((run, i, j, ranks[i], ranks[j]))
        want[run] = brute_dedup(n, corr, ranks, 0.7)
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "run int, i int, j int, rank_i double, rank_j double")
    got = {}
    for r in selection.dedup_correlated(df).collect():
        got.setdefault(r["run"], []).append(r["dropped"])
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_select_features_keeps_the_informative_one(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 150)
    good = y + rng.normal(size=150) * 0.2
    data = np.c_[rng.normal(size=150), good, good + rng.normal(size=150) * 1e-3, rng.normal(size=150)]
    df = spark.createDataFrame(
        [(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(y, data))],
        "id int, y int, n1 double, good double, twin double, n2 double",
    )
    got = selection.select_features(df, ["n1", "good", "twin", "n2"], ids=["id"], at_least=1).orderBy("place").collect()
    assert got[0]["feature"] in ("good", "twin")
    assert not {"good", "twin"} <= {r["feature"] for r in got}
    assert len(got) == 1


INDEX = [(1, "North Carolina", ["UNC"]), (2, "North Carolina State", []), (3, "Saint Louis", ["St. Louis", "Shared"]),
         (4, "Miami (OH)", ["shared"])]


def test_cascade(spark):
    index = spark.createDataFrame(INDEX, "entity_id long, canonical_name string, alt_names array<string>")
    overrides = spark.createDataFrame([("NC State", "North Carolina State"), ("Nowhere", "Not There")], "variant string, canonical string")
    names = ["NC State", "Nowhere", " st  LOUIS. ", "SHARED", "North Carolna", "State Carolina North", "qqqq", " ", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r["name"]: (r["entity_id"], r["method"]) for r in resolve.resolve_cascade(df, index, overrides).collect()}
    assert got == {
        "NC State": (2, "override"), "Nowhere": (None, "unresolved"), " st  LOUIS. ": (3, "exact"), "SHARED": (4, "exact"),
        "North Carolna": (1, "fuzzy"), "State Carolina North": (1, "fuzzy"), "qqqq": (None, "unresolved"), " ": (None, "blank"),
    }
    edit = resolve.resolve_cascade(df, index, overrides, scorer="edit").collect()
    assert {r["name"]: r["entity_id"] for r in edit} == {**{n: i for n, (i, _) in got.items()}, "State Carolina North": 2}
    canonicals = df.sparkSession.createDataFrame([(n,) for _, n, _ in INDEX], "name string")
    again = {r["entity_id"] for r in resolve.resolve_cascade(canonicals, index, overrides).collect()}
    assert again == {1, 2, 3, 4}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("cutoff", [60, 80, 90])
def test_fuzzy_join_finds_every_pair(spark, cutoff):
    rng = random.Random(cutoff)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(40)]
    choices = sorted({" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(60)})
    names = sorted({" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(80)})

    def score(a, b):
        def sim(s, t):
            return 100 * (max(len(s), len(t)) - levenshtein(s, t)) / max(len(s), len(t))

        return max(sim(a, b), sim(" ".join(sorted(a.split(" "))), " ".join(sorted(b.split(" ")))))

    left = spark.createDataFrame([(n,) for n in names], "name_key string")
    right = spark.createDataFrame([(c, i) for i, c in enumerate(choices)], "choice_key string, entity_id int")
    got = {(r[0], r[1]) for r in fuzzy.edit_candidates(left, right.select("choice_key"), cutoff).collect()}
    want = {(n, c) for n in names for c in choices if score(n, c) >= cutoff}
    assert want <= got
    for way in (fuzzy._by_bigrams, fuzzy._by_segments):
        a, b, keys = way(left, right.select("choice_key"), cutoff)
        assert want <= {(r[0], r[1]) for r in a.join(b, keys).select("name_key", "choice_key").collect()}
    best = {r["name_key"]: (r["score"], r["entity_id"]) for r in fuzzy.best_matches(left, right, cutoff, "edit").collect()}
    for n in names:
        ranked = sorted((-score(n, c), i) for i, c in enumerate(choices) if score(n, c) >= cutoff)
        assert best.get(n) == ((-ranked[0][0], ranked[0][1]) if ranked else None)


def test_fuzzy_candidates_grow_with_the_names(spark):
    """Random names over few letters, all of whose bigrams are common: 1 in 5 of all pairs met before."""
    rng = random.Random(5)
    choices = sorted({"".join(rng.choice("bcdfghklmnprstvw") for _ in range(14)) for _ in range(600)})
    names = [c[:5] + c[6:] for c in choices]
    left = spark.createDataFrame([(n,) for n in names], "name_key string")
    right = spark.createDataFrame([(c,) for c in choices], "choice_key string")
    got = {(r[0], r[1]) for r in fuzzy.edit_candidates(left, right, 80).collect()}
    assert set(zip(names, choices)) <= got and len(got) < 2 * len(names)


@pytest.mark.parametrize("cutoff,seed", [(80, 1), (80, 2), (85, 3), (90, 4)])
def test_weighted_join_equals_comparing_all(spark, cutoff, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(30)] + ["st"] * 20

    def phrase():
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
        if rng.random() < 0.4:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice("abcd ") + text[at + rng.randint(0, 1):]
        return " ".join(text.split())

    choices = sorted({phrase() for _ in range(90)} - {""})
    names = sorted({phrase() for _ in range(120)} - {""})
    left = spark.createDataFrame([(n,) for n in names], "name_key string")
    right = spark.createDataFrame([(c, i) for i, c in enumerate(choices)], "choice_key string, entity_id int")
    pairs = {tuple(r) for r in fuzzy.weighted_candidates(left, right.select("choice_key"), cutoff).collect()}
    for n, c in itertools.product(names, choices):
        score = similarity.weighted_ratio(n, c)
        if score >= cutoff and (n, c) not in pairs:
            assert score == similarity.SHARED_WORD_SCORE and set(n.split()) & set(c.split()), (n, c, score)
    got = {r["name_key"]: (r["score"], r["entity_id"]) for r in fuzzy.best_matches(left, right, cutoff).collect()}
    for n in names:
        ranked = sorted((-similarity.weighted_ratio(n, c), i) for i, c in enumerate(choices))
        assert got.get(n) == ((-ranked[0][0], ranked[0][1]) if -ranked[0][0] >= cutoff else None), n


def test_weighted_ratio_known_values():
    assert similarity.ratio("this is a test", "this is a test!") == pytest.approx(96.55172, abs=1e-4)
    assert similarity.partial_ratio("this is a test", "this is a test!") == 100.0
    assert similarity.weighted_ratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == pytest.approx(95.0)
    assert similarity.weighted_ratio("north carolina", "university of north carolina") == pytest.approx(90.0)
    assert similarity.weighted_ratio("ohio", "ohio valley") == pytest.approx(90.0)
    assert similarity.weighted_ratio("", "a") == 0.0


def test_index_building(spark, rows):
    canon = spark.createDataFrame([(1, "Alpha College"), (2, "Beta")], "entity_id long, canonical_name string")
    overrides = spark.createDataFrame([("AC", "Alpha College"), ("Gone", "Missing")], "variant string, canonical string")
    names = spark.createDataFrame([("alpha college",), ("AC",), ("Alpha Colege",), ("Gone",), ("Zzz",)], "name string")
    built = resolve.build_index(canon, overrides, names)
    assert rows(built.select("entity_id", "alt_names"), "entity_id") == [(1, ["AC", "Alpha Colege"]), (2, [])]
    fallback = resolve.build_index_fallback(names, overrides)
    got = rows(fallback, "entity_id")
    assert [g[1] for g in got] == ["Alpha College", "Alpha Colege", "Missing", "Zzz", "alpha college"]
    assert got[0][2:] == ("alpha-college", ["AC"])


def test_conformal(spark, rows):
    rng = np.random.default_rng(4)
    data = [(g, float(p), int(rng.random() < p)) for g in (0, 1) for p in rng.random(80)] + [(2, 0.9, 1)]
    df = spark.createDataFrame(data, "round_group int, p double, winner int")
    cuts = conformal.calibrate(df, "p")
    finite = {(r["round_group"], r["level"]): r["threshold"] for r in conformal.calibrate(df, "p", correction="finite_sample").collect()}
    for r in cuts.collect():
        scores = np.array([1 - p if y else p for g, p, y in data if g == r["round_group"]])
        assert r["threshold"] == pytest.approx(np.quantile(scores, r["level"]))
        assert r["median_score"] == pytest.approx(np.median(scores))
        rank = int(np.ceil((len(scores) + 1) * r["level"] - 1e-9))
        want = np.sort(scores)[rank - 1] if rank <= len(scores) else 1.0
        assert finite[r["round_group"], r["level"]] == pytest.approx(want)
    sets = conformal.predict_all_levels(df, cuts, "p")
    shares = [r["coverage"] for r in conformal.coverage(sets).orderBy("level").collect()]
    assert shares == sorted(shares)
    unseen = spark.createDataFrame([(9, 0.5, 1), (9, 0.99, 1)], "round_group int, p double, winner int")
    one = conformal.predict_sets(unseen, cuts, "p", 0.80)
    mean = np.mean([r["threshold"] for r in cuts.filter("level = 0.8").collect()])
    for r in one.collect():
        want = [label for label, score in ((1, 1 - r["p"]), (0, r["p"])) if score <= mean]
        assert list(r["prediction_set"]) == (want or [1 if r["p"] > 0.5 else 0])
    nothing = conformal.predict_sets(unseen, cuts.filter("level > 2"), "p", 0.80)
    assert [list(r["prediction_set"]) for r in nothing.orderBy("p").collect()] == [[1, 0], [1]]


def test_leave_group_out_ignores_own_labels(spark, rows):
    base = [(g, k, (g + k) % 2) for g in range(3) for k in range(2) for _ in range(4)]
    changed = [(g, k, 1 if g == 0 else y) for g, k, y in base]
    schema = "g int, k int, winner int"
    one = evaluation.leave_group_out_rate(spark.createDataFrame(base, schema), "g", "k").filter("g = 0")
    two = evaluation.leave_group_out_rate(spark.createDataFrame(changed, schema), "g", "k").filter("g = 0")
    assert rows(one, "k") == rows(two, "k")


def test_forced_results(spark):
    data = [(1, 1, 0, "a", 1, "b", 16, 0.1), (1, 1, 1, "a", 8, "b", 9, 0.4), (1, 1, 2, "a", 5, "b", 12, 0.8),
            (1, 1, 3, "TBD_x", 4, "b", 13, 0.1), (1, 1, 4, "a", 6, "b", 11, 0.4), (1, 1, 5, "a", 3, "b", 14, 0.5)]
    df = spark.createDataFrame(data, "tournament int, round int, slot int, a_name string, a_seed int, b_name string, b_seed int, prob double")
    got = knockout.forced_results(df, ["tournament"], "round", budget={1: 2})
    assert sorted(r["slot"] for r in got.collect()) == [1, 4]
    few = knockout.forced_results(df, ["tournament"], "round", budget={1: 9})
    assert sorted(r["slot"] for r in few.collect()) == [1, 4, 5]


@pytest.mark.parametrize("n", [2, 4, 16])
def test_knockout_plays_to_one_winner(spark, n):
    entries = [(t, i // 2, i + 1) for t in ("x", "y") for i in range(n)]
    frame = spark.createDataFrame(entries, "tournament string, slot int, seed int")
    pair = frame.groupBy("tournament", "slot").agg(F.min("seed").alias("a_seed"), F.max("seed").alias("b_seed"))
    pair = pair.withColumn("a_name", F.concat(F.lit("n"), "a_seed")).withColumn("b_name", F.concat(F.lit("n"), "b_seed"))
    rounds = n.bit_length() - 1
    played = knockout.play_all(pair, rounds, lambda p, k: p.withColumn("prob", F.lit(0.9)), ())
    assert played.count() == 2 * (n - 1)
    assert {r["winner_name"] for r in played.filter(f"round = {rounds}").collect()} == {"n1"}
    forced = knockout.play_all(pair, rounds, lambda p, k: p.withColumn("prob", F.lit(0.6)), (), budget={1: 1})
    assert forced.filter("is_forced").groupBy("tournament").count().agg(F.max("count")).first()[0] == 1


def test_unresolved_samples_and_counts(spark, rows):
    data = [(2000, None, f"n{i:02d}") for i in range(15)] + [(2001, 5, "ok"), (2001, None, "bad")]
    df = spark.createDataFrame(data, "period int, id int, name string")
    got = rows(assemble.sample_unresolved(df, "id", "name", "period"), "period", "name")
    assert len(got) == 11 and got[9][1] == "n09"
    assert rows(pairs.period_counts(df), F.col("period").asc_nulls_last()) == [(2000, 15), (2001, 2), (None, 17)]


def test_regime_support_counts_other_periods(spark, rows):
    df = spark.createDataFrame([(p, d, 4) for p in (1, 2) for d in (1, 9, 2)], "period int, seed_diff int, round_number int")
    got = features.fold_support(df, "period", {"close": (features.regime_close(), 3), "late": (features.regime_late(), 3)})
    assert rows(got, "period", "regime") == [(1, "close", 2, False), (1, "late", 3, True), (2, "close", 2, False), (2, "late", 3, True)]
