"""Training against finite differences and a dense copy of the same steps; draws and walks against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.operators import complement, samplers, training, walks

MODELS = {"norm": (training.norm_loss, training.norm_score), "pair": (training.pair_loss, training.pair_score)}
DOMS = ["a", "b", "c"]


@pytest.mark.parametrize("name", MODELS)
def test_gradients_equal_finite_differences(name):
    rng, f = np.random.default_rng(1), MODELS[name][0]
    x, whole, second = rng.normal(0, 0.6, (7, 4, 5)), rng.normal(0, 0.8, (4, 5)), rng.normal(0, 0.1, (4, 5))
    positive, extra = np.array([True, False] * 3 + [True]), rng.normal(-3, 1, 7)
    _, *got = f(x, whole, second, positive, extra)
    cost = lambda *args: f(*args, positive, extra)[0].sum()
    for which, g in enumerate(got):
        args = [x, whole, second]
        for at in np.ndindex(args[which].shape):
            if which == 2 and name == "pair" and at != (0, 0):
                continue
            up, down = (a.copy() for _ in range(2) for a in [args[which]])
            up[at] += 1e-6
            down[at] -= 1e-6
            want = (cost(*args[:which], up, *args[which + 1 :]) - cost(*args[:which], down, *args[which + 1 :])) / 2e-6
            assert abs(g[at] - want) < 1e-4 * max(1, abs(want))


def dense(codes, sizes, vectors, whole, second, positive, extra, f, t):
    """The same steps with whole tables in memory."""
    tables = [v.copy() for v in vectors] + [whole.copy(), second.copy()]
    m, v, losses = [np.zeros_like(x) for x in tables], [np.zeros_like(x) for x in tables], []
    for step in range(1, t.rounds + 1):
        x = np.stack([tables[i][codes[:, i]] for i in range(len(sizes))], axis=1)
        loss, by_x, *rest = f(x, tables[-2], tables[-1], positive, extra)
        losses.append(loss.sum() / positive.sum())
        grads = []
        for i in range(len(sizes)):
            g = np.zeros_like(tables[i])
            np.add.at(g, codes[:, i], by_x[:, i])
            grads.append(g)
        for j, g in enumerate([*grads, *rest]):
            g = np.clip(g / positive.sum(), -t.clip, t.clip)
            m[j], v[j] = t.decays[0] * m[j] + (1 - t.decays[0]) * g, t.decays[1] * v[j] + (1 - t.decays[1]) * g * g
            tables[j] -= t.rate * (m[j] / (1 - t.decays[0] ** step)) / (np.sqrt(v[j] / (1 - t.decays[1] ** step)) + t.floor)
    return tables, losses


def planted(n, seed):
    """Records whose b and c follow from a, with a copy of each that has another b or c."""
    r = random.Random(seed)
    rows, bad = [], []
    for _ in range(n):
        a = r.randrange(12)
        row = [a, a // 2, a // 3]
        rows.append(row)
        other = list(row)
        other[1] = r.choice([k for k in range(6) if k != row[1]])
        bad.append(other)
    return rows, bad


def auc(good, bad):
    rank = np.r_[good, bad].argsort().argsort()
    return (rank[: len(good)].sum() - len(good) * (len(good) - 1) / 2) / len(good) / len(bad)


@pytest.mark.parametrize("name", MODELS)
def test_spark_steps_equal_dense_steps_and_learn(spark, name):
    f, score = MODELS[name]
    good, bad = planted(300, 2)
    sizes = [12, 6, 4]
    codes = spark.createDataFrame([(d, str(i), i) for d, n in zip(DOMS, sizes) for i in range(n)], "domain string, value string, entity_id int")
    frame = lambda rows: spark.createDataFrame([(str(i), *map(str, r), -2.0) for i, r in enumerate(rows)], "rec_id string, a string, b string, c string, extra double").repartition(3)
    rows = training.samples(frame(good), codes, DOMS, True, "extra").unionByName(training.samples(frame(bad), codes, DOMS, False, "extra")).cache()
    t = training.Training(k=4, rounds=3, rate=0.05)
    first = {(r.domain, r.entity_id): np.array(r.vec) for r in training.initial(codes, DOMS, t).collect()}
    vectors = [np.array([first[d, i] for i in range(n)]) for d, n in zip(DOMS, sizes)]
    whole, second = (np.array([first[d, i] for d in DOMS]) for i in (training.WHOLE, training.SECOND))
    positive, extra = np.r_[np.ones(len(good), bool), np.zeros(len(bad), bool)], np.full(len(good) + len(bad), -2.0)
    want, losses = dense(np.array(good + bad), sizes, vectors, whole, second, positive, extra, f, t)
    weights, got = training.train(rows, codes, DOMS, f, t)
    assert np.allclose([x for _, x in got], losses, rtol=1e-9) and losses[-1] < losses[0]
    for r in weights.collect():
        at = want[DOMS.index(r.domain)][r.entity_id] if r.entity_id >= 0 else want[-2 if r.entity_id == training.WHOLE else -1][DOMS.index(r.domain)]
        assert np.allclose(r.vec, at, atol=1e-7)
    # the same loss, carried on, tells records not used from copies of them
    final, losses = dense(np.array(good + bad), sizes, vectors, whole, second, positive, extra, f, training.Training(k=4, rounds=300, rate=0.05))
    assert losses[-1] < losses[0]
    fresh, spoilt = (np.array(x) for x in planted(200, 9))
    of = lambda c: score(np.stack([final[i][c[:, i]] for i in range(3)], axis=1), final[-2], final[-1])
    assert auc(of(fresh), of(spoilt)) > 0.9
    scored = training.scored(training.encoded(frame(good[:20]), codes, DOMS), weights, DOMS, 4, score).collect()
    x = np.stack([want[i][np.array(good[:20])[:, i]] for i in range(3)], axis=1)
    assert np.allclose([r.score for r in sorted(scored, key=lambda r: int(r.rec_id))], score(x, want[-2], want[-1]), atol=1e-6)


def test_record_vectors_sum_to_the_score(spark):
    good, bad = planted(40, 3)
    codes = spark.createDataFrame([(d, str(i), i) for d, n in zip(DOMS, [12, 6, 4]) for i in range(n)], "domain string, value string, entity_id int")
    df = spark.createDataFrame([(str(i), *map(str, r)) for i, r in enumerate(good)], "rec_id string, a string, b string, c string")
    weights = training.initial(codes, DOMS, training.Training(k=4))
    rows = training.encoded(df, codes, DOMS)
    sums = {}
    for r in training.record_vectors(rows, weights, DOMS, 4).collect():
        sums[r.rec_id] = sums.get(r.rec_id, np.zeros(4)) + np.array(r.vec)
    for r in training.scored(rows, weights, DOMS, 4, training.norm_score).collect():
        assert abs(r.score - np.tanh((sums[r.rec_id] ** 2).sum())) < 1e-12
    assert training.scored(rows.limit(0), weights, DOMS, 4, training.norm_score).collect() == []


def test_free_ids_are_all_drawn_and_none_is_seen(spark):
    r = random.Random(6)
    seen = {k: set(r.sample(range(40), n)) for k, n in zip("abcdef", (0, 1, 20, 39, 40, 33))}
    draws = [(k, u) for k in seen for u in range(40)] + [("g", 41)]
    s = spark.createDataFrame([(k, i) for k in seen for i in seen[k]] * 2, "key string, id long")
    d = spark.createDataFrame(draws, "key string, u long")
    got = complement.free_ids(d, s, ["key"], F.lit(40), F.col("u"), "free").collect()
    found = {(x.key, x.u): x.free for x in got}
    assert len(found) == len(got) == len([k for k, _ in draws if k != "e"])
    for k, u in draws:
        free = [i for i in range(40) if i not in seen.get(k, set())]
        if free:
            assert found[k, u] == free[u % len(free)]


def test_negatives_equal_no_record_and_none_is_lost(spark):
    rows = [(str(i), str(i % 3), str(i % 4), "x") for i in range(24)]
    df = spark.createDataFrame(rows, "rec_id string, a string, b string, c string")
    codes = df.selectExpr("stack(3, 'a', a, 'b', b, 'c', c) as (domain, value)").distinct().selectExpr("domain", "value", "row_number() over (partition by domain order by value) - 1 entity_id")
    known = {r[1:] for r in rows}
    # every pair of a and b occurs, and c has one value: no free value anywhere
    assert samplers.one_column_negatives(df, codes, 2, 1, DOMS).count() == 0
    some = df.filter("rec_id <> '5' and rec_id <> '17'")
    left = {r[1:] for r in rows if r[0] not in ("5", "17")}
    free = known - left
    got = samplers.one_column_negatives(some, codes, 2, 1, DOMS).collect()
    assert {(r.a, r.b, r.c) for r in got} == free and len(got) == 2 * sum((r[1], r[2]) != next(iter(free))[:2] and (r[1] == next(iter(free))[0] or r[2] == next(iter(free))[1]) for r in some.collect())


def test_long_walks_come_back_only_where_they_must(spark):
    r = random.Random(8)
    pairs = {("h", f"{i:02}"): r.sample(range(90), 30 if i else 90) for i in range(70)}
    edges = [("h", "s", h, f"{s:02}", r.randrange(1, 50)) for (_, h), near in pairs.items() for s in near]
    df = spark.createDataFrame(edges, "dom_a string, dom_b string, e_a string, e_b string, cnt long")
    starts = spark.createDataFrame([(0, "00"), (0, "07"), (0, "none")], "path int, start string")
    got = walks.walks(df, starts, [["h", "s"]], 24, 3, 5).collect()
    near = {}
    for _, _, h, s, _ in edges:
        near.setdefault(("h", h), set()).add(s)
        near.setdefault(("s", s), set()).add(h)
    assert len(got) == 6
    for g in got:
        assert len(g.walk) == 24 and g.walk[0] == g.start
        for k in range(23):
            here, other = ("h", "s") if k % 2 == 0 else ("s", "h")
            options = near[here, g.walk[k]]
            been = {g.walk[i] for i in range(k + 1) if (i % 2 == 0) == (other == "h")}
            assert g.walk[k + 1] in options
            assert g.walk[k + 1] not in been or options <= been


def test_hubs_over_many_slots(spark, monkeypatch):
    monkeypatch.setattr(walks, "SPAN", 4)
    edges = spark.createDataFrame([("h", "s", "hub", f"{i:03}", 1 if i else 5000) for i in range(200)], "dom_a string, dom_b string, e_a string, e_b string, cnt long")
    stretches = walks.weighed(edges)
    hops = walks.hop_tables(stretches, [["h", "s"]])
    assert max(len(r.near) for r in hops.collect()) <= 4
    node = stretches.filter("src = 'hub'").select("total", "slots").first()
    rows = spark.range(0, node.total, max(1, node.total // 500)).selectExpr("id u", "0 path", "0 turn", "'hub' src", f"{node.total}L total", f"{node.slots}L slots")
    want = {(r.lo, r.hi): r.dst for r in stretches.filter("src = 'hub'").collect()}
    for x in walks.stepped(rows, hops, "u").collect():
        assert x.to.dst == next(d for (lo, hi), d in want.items() if lo <= x.u < hi)


def test_free_ids_of_keys_with_many_seen_ids(spark, monkeypatch):
    monkeypatch.setattr(complement, "SPAN", 4)
    monkeypatch.setattr(complement, "WIDE", 16)
    seen = {"a": [*range(3, 37), 50, 51, 90], "b": [0], "c": [*range(0, 100, 2)], "d": [*range(100)]}
    s = spark.createDataFrame([(k, i) for k, v in seen.items() for i in v] * 2, "key string, id long")
    assert complement.gap_slices(s, ["key"]).agg(F.max(F.size("_gaps"))).first()[0] == 4
    d = spark.createDataFrame([(k, u) for k in "abcde" for u in range(130)], "key string, u long")
    got = {(r.key, r.u): r.free for r in complement.free_ids(d, s, ["key"], F.lit(100), F.col("u"), "free").collect()}
    free = {k: [i for i in range(100) if i not in seen.get(k, [])] for k in "abcde"}
    assert got == {(k, u): free[k][u % len(free[k])] for k in "abce" for u in range(130)}


def test_one_column_negatives_beside_a_null(spark):
    # the second record has nothing where the first has 0, beside the same other value
    df = spark.createDataFrame([("r1", "x0", "y0"), ("r2", None, "y0"), ("r3", "x1", "y1")], "rec_id string, a string, b string")
    codes = spark.createDataFrame([("a", "x0", 0), ("a", "x1", 1), ("b", "y0", 0), ("b", "y1", 1)], "domain string, value string, entity_id int")
    got = {(r.rec_id, r.column, r.a, r.b) for r in samplers.one_column_negatives(df, codes, 5, 1, ["a", "b"]).collect()}
    assert {x for x in got if x[1] == "a"} == {("r1", "a", "x1", "y0"), ("r2", "a", "x1", "y0"), ("r3", "a", "x0", "y1")}


def test_bagged_copies_are_drawn_as_ids(spark):
    rows = spark.createDataFrame([(f"r{i}", i % 3, i % 5) for i in range(30)], "rec_id string, c0 int, c1 int")
    drawn = samplers.bagged_ids(rows, {"a": 3, "b": 5, }, 4, 1, ["a", "b"])
    assert "value" not in drawn.columns and set(drawn.columns) == {"rec_id", "neg", "c0", "c1"}
