"""What was left of the findings of the third round: tries that can only fail, and rows that are not multiplied before a shuffle."""

import hashlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.operators import anomalies as A
from cargolens.operators import embedding as E
from cargolens.operators import graph as G
from cargolens.operators import relational as R
from cargolens.operators import training as T
from cargolens.sources.records import DOMAINS


def test_draws_of_whole_pairs_are_left_out_before_joins(spark):
    # carrier, destination and hscode occur in all combinations; consignee, origin and shipper go together
    rows = [tuple({"consignee": f"c{k}", "origin": f"o{k}", "shipper": f"s{k}", "carrier": f"a{i}", "destination": f"d{j}", "hscode": f"h{(i + j) % 2}"}.get(d, "x") for d in DOMAINS) for k in range(3) for i in range(2) for j in range(2)]
    df = spark.createDataFrame(rows, DOMAINS)
    sizes = {d: len({r[i] for r in rows}) for i, d in enumerate(DOMAINS)}
    threes = A.open_threes(R.co_occurrence(df).select(*A.PAIR), sizes)
    assert threes == [("consignee", "origin", "shipper")]
    draws = spark.range(2000).select(F.col("id").cast("string").alias("rec_id"), F.lit(1).alias("criterion"), F.lit(0).alias("attempt"))
    h = lambda x, d: hashlib.md5(f"7#{x}#1#0#{d}".encode()).hexdigest()
    first = {str(x): sorted(DOMAINS, key=lambda d: h(x, d))[:3] for x in range(2000)}
    for some in (threes, [*threes, ("carrier", "consignee", "hscode")], list(combinations(DOMAINS, 3))):
        got = {r.rec_id: list(r["_three"]) for r in A.draws_of(draws, some, 7).collect()}
        assert got == {x: t for x, t in first.items() if tuple(sorted(t)) in some}


def test_nothing_unseen_ends_at_once(spark):
    rows = spark.createDataFrame([(str(i), *("x" for _ in DOMAINS)) for i in range(20)], ["rec_id", *DOMAINS])
    codes = R.dictionary(rows)
    with pytest.raises(RuntimeError):
        A.type_one(rows, codes, dict.fromkeys(DOMAINS, 1), R.co_occurrence(rows).select(*A.PAIR), rows, 50, 7)


def test_chunks_give_the_gradients_of_pairs(spark):
    rng = np.random.default_rng(3)
    ids = [int(x) for x in rng.integers(0, 3 * E.BLOCK, 30)]
    rows = sorted({(bool(rng.integers(2)), float(rng.integers(1, 9)), ids[rng.integers(30)], ids[rng.integers(30)]) for _ in range(300)})
    pairs = spark.createDataFrame(rows, "positive boolean, extra double, c0 long, c1 long")
    t = T.Training(k=4)
    weights = T.initial(E.sides(pairs), E.SIDES, t)
    chunks = E.packed(pairs, 20)
    assert chunks.count() > 9  # pairs of blocks with more than a chunk are divided
    for loss in (E.dot_loss, E.cosine_loss, E.count_loss(8.0)):
        want, got = ({(r.d, r.entity_id): r[2:] for r in f(x, weights, E.SIDES, 4, loss).collect()} for f, x in ((T.gradients, pairs), (E.chunk_gradients, chunks)))
        assert want.keys() == got.keys()
        assert all(np.allclose(want[x], got[x], atol=1e-9) for x in want)
    plan = E.chunk_gradients(chunks, weights, E.SIDES, 4, E.dot_loss)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(c0" not in plan and "Exchange hashpartitioning(c1" not in plan


def test_pairs_are_counted_as_ids(spark):
    df = spark.createDataFrame([("x", "y", None), ("x", "y", "z"), (None, "y", "z")], "carrier string, hscode string, origin string")
    domains = ["carrier", "hscode", "origin"]
    codes = R.serial_ids(R.dictionary(df.withColumn("rec_id", F.lit("r")), domains))
    word = {r.serial_id: (r.domain, r["value"]) for r in codes.collect()}
    got = sorted(((*word[r.a], *word[r.b], r.n) for r in R.co_occurring_ids(df, codes, domains).collect()), key=str)
    want = sorted(((r.dom_a, r.e_a, r.dom_b, r.e_b, r.cnt) for r in R.co_occurrence(df, domains).collect()), key=str)
    assert got == want and any(None in r for r in got)


def test_neighbours_are_not_shuffled_once_they_are_listed(spark):
    rng = np.random.default_rng(5)
    rows = [(f"r{rng.integers(60)}", f"o{rng.integers(4)}") for _ in range(80)]  # some ids stand in several rows
    df = spark.createDataFrame(rows, "rec_id string, origin string")
    sims = {(a, b): float(rng.integers(1, 4)) for a in range(4) for b in range(4)}
    similar = spark.createDataFrame([(f"o{a}", f"o{b}", s) for (a, b), s in sims.items()], "src string, dst string, s double")
    want, k = [], 5
    for x in sorted({r[0] for r in rows}):
        found = []
        for o in (o for y, o in rows if y == x):
            best = sorted((-sims[int(o[1]), int(p[1])], y) for y, p in rows)[: k + 1]
            found += [(s, y) for s, y in best if y != x]
        want += [(x, y, -s, i + 1) for i, (s, y) in enumerate(sorted(found)[:k])]
    out = G.record_neighbours(df, similar, "origin", k)
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" in plan  # a record's list is laid out after all joins
    above = plan[: plan.index("posexplode")]
    assert "Window" not in above and "Join" not in above


def test_triples_come_from_words_of_bits(spark):
    rng = np.random.default_rng(9)
    some = lambda c, n: None if rng.integers(12) == 0 else f"{c}{rng.integers(n)}"
    rows = [(some("a", 6), some("m", 150), some("b", 6)) for _ in range(900)]  # three words
    df = spark.createDataFrame(rows, "shipper string, hscode string, consignee string")
    ab, mb, ac = ({(r[i], r[j]) for r in rows if r[i] and r[j]} for i, j in ((0, 1), (1, 2), (0, 2)))
    want = {(a, m, b) for a, m in ab for n, b in mb if n == m and (a, b) in ac} - set(rows)
    out = R.conflicting_triples(df, "shipper", "hscode", "consignee")
    got = list(map(tuple, out.collect()))
    assert out.columns == ["shipper", "hscode", "consignee"] and len(got) == len(set(got)) and set(got) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate")].replace("BroadcastExchange", "")  # nothing is shuffled once triples are laid out


def test_counts_of_pairs_are_columns_of_a_row(spark, monkeypatch):
    rng = np.random.default_rng(11)
    some = lambda n: None if rng.integers(10) == 0 else f"v{rng.integers(n)}"
    rows = [(f"r{i % 190}", some(40), some(3), some(30)) for i in range(200)]
    df = spark.createDataFrame(rows, "rec_id string, carrier string, hscode string, origin string")
    want = sorted((r[0], x, y, sum((q[i], q[j]) == (r[i], r[j]) for q in rows)) for r in rows for (i, x), (j, y) in combinations(enumerate(["carrier", "hscode", "origin"], 1), 2))
    for small in (0, 150, 1 << 18):
        monkeypatch.setattr(R, "SMALL", small)
        out = R.own_pair_counts(df, ["carrier", "hscode", "origin"])
        assert sorted(map(tuple, out.collect())) == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("Generate")].replace("BroadcastExchange", "")
