"""What the findings of the third round asked for: the graph that a query needs, and no more."""

import hashlib
import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from cargolens.operators import anomalies as A
from cargolens.operators import graph as G
from cargolens.operators import learning as L
from cargolens.operators import nearest as N
from cargolens.operators import relational as R
from cargolens.plans import catalog, walked  # noqa: F401  the catalog registers the queries
from cargolens.plans.durable import shared_folder
from cargolens.sources.records import DOMAINS


def graphs(spark):
    at = f"{shared_folder(spark)}/stores"
    return {f for f in (os.listdir(at) if os.path.isdir(at) else []) if f.startswith("graph")}


def test_only_linked_pairs_are_counted_for_walks(spark, sf_dir):
    before = graphs(spark)
    walked.coded(spark, sf_dir)
    assert graphs(spark) == before  # the dictionary needs no edges
    df, _, edges = walked.linked(spark, sf_dir)
    assert {tuple(r) for r in edges.select("dom_a", "dom_b").distinct().collect()} == set(walked.LINKED)
    every = R.co_occurrence(df).filter(F.concat_ws(",", "dom_a", "dom_b").isin([",".join(x) for x in walked.LINKED]))
    assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, every.collect()))


def test_pairs_are_numbers_while_they_are_shuffled(spark):
    df = spark.createDataFrame([("x", "y", None), ("x", "y", "z"), (None, "y", "z")], "a string, b string, c string")
    out = R.co_occurrence(df, ["a", "b", "c"])
    assert out.schema.simpleString() == "struct<dom_a:string,dom_b:string,e_a:string,e_b:string,cnt:bigint>"
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([("a", "b", "x", "y", 2), ("a", "b", None, "y", 1), ("a", "c", "x", None, 1), ("a", "c", "x", "z", 1), ("a", "c", None, "z", 1), ("b", "c", "y", None, 1), ("b", "c", "y", "z", 2)], key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    exchange = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert exchange and all("_pair" in x and "dom_a" not in x for x in exchange)


def told(df, counter):
    """df, whose rows are counted whenever they are made."""

    def run(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


def test_rounds_do_not_read_their_input_again(spark, tmp_path):
    rows = [(str(i), f"o{i % 5}", f"h{i % 7}", "c" + str(i % 3), "d" + str(i % 4), (i % 3) - 1) for i in range(2000)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "rec_id string, origin string, hscode string, carrier string, destination string, y int").write.parquet(path)
    df = spark.read.parquet(path)
    edges = R.co_occurrence(df, ["hscode", "origin"])
    trees = ["carrier", "destination", "hscode", "origin"]
    hop = G.hop(edges, "origin", "hscode")
    made = spark.sparkContext.accumulator(0)
    G.sim_rank(told(hop, made), None).collect()
    assert 35 <= made.value <= 2 * 35  # 5 by 7 edges, made for a checkpoint (Spark may do so twice), not in each round
    linked = {}
    L_forest, counted = L.forest, []
    L.forest = lambda x, *a, **k: counted.append(x.inputFiles()) or L_forest(x, *a, **k)
    try:
        linked["links"] = L.relabelled_by_links(df, edges, ["origin", "hscode"], trees, rounds=1)
        linked["near"] = L.relabelled_by_neighbours(df, G.path_similarity(edges, ["origin", "hscode"]), "origin", trees, rounds=2)
    finally:
        L.forest = L_forest
    assert counted == [[], []]  # forests are fitted to checkpoints, not to the files
    assert all(x.count() == len(rows) for x in linked.values())


def test_only_large_domains_shuffle_rows(spark, monkeypatch):
    rows = [(str(i), f"a{i % 7}" if i % 11 else None, f"b{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "rec_id string, a string, b string")
    codes = R.serial_ids(R.dictionary(df.dropna(), ["a", "b"])).localCheckpoint()
    known = {(r["domain"], r["value"]): (r["entity_id"], r["serial_id"]) for r in codes.collect()}
    for small, exchanges in ((1 << 18, 0), (7, 2), (0, 4)):  # of the rows and of the codes of each large domain
        monkeypatch.setattr(R, "SMALL", small)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            out = R.serials(df, codes, ["a", "b"])
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == exchanges
            got = {tuple(r) for r in out.collect()}
            coded = {tuple(r) for r in R.encode(df, codes, ["a", "b"]).collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert got == {(i, d, known[d, v][1]) for i, a, b in rows for d, v in (("a", a), ("b", b)) if (d, v) in known}
        assert coded == {(i, known["a", a][0], known["b", b][0]) for i, a, b in rows if ("a", a) in known and ("b", b) in known}


def test_rows_are_not_multiplied_to_find_unseen_domains(spark):
    doms = {"p": 3, "q": 2, "x": 4, "y": 4}
    codes = spark.createDataFrame([(d, f"{d}{i}", i) for d, n in doms.items() for i in range(n)], "domain string, value string, entity_id int")
    seen = [("x", f"x{i}", "p", j) for i in range(2) for j in range(3)]  # x0 and x1 leave nothing of p
    seen += [("y", f"y{i}", "q", j) for i in range(3) for j in range(2)] + [("x", "x0", "q", 0), ("y", "y3", "p", 2), ("x", "x0", "q", 0)]
    near = spark.createDataFrame(seen, "r string, o string, d string, id long")
    held = [(c, f"n{i}{j}", 0, {"x": f"x{i}", "y": f"y{j}"}) for i in range(4) for j in range(4) for c in (1, 2)]
    rows = spark.createDataFrame(held, "criterion int, rec_id string, attempt int, own map<string,string>")
    options = {1: (["p", "q"], ["x", "y"]), 2: (["p", "q"], ["y"])}
    saved, A.DOMAINS = A.DOMAINS, list(doms)
    try:
        out = A.two_unseen(rows, options, near, codes, doms, 7)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        got = {(r["criterion"], r["rec_id"]): r for r in out.collect()}
    finally:
        A.DOMAINS = saved
    assert not any("Generate explode" in x and "own" in x for x in plan.splitlines())  # 15 rows a record before
    met = lambda r, o, d: {k for a, b, c, k in seen if (a, b, c) == (r, o, d)}
    for c, rec, _, own in held:
        able = [(hashlib.md5(f"7#{rec}#{c}#0#{d}#{r}".encode()).hexdigest(), d, r) for d in options[c][0] for r in options[c][1] if len(met(r, own[r], d)) < doms[d]]
        first = [x for i, x in enumerate(sorted(able)) if x[1] not in {y[1] for y in sorted(able)[:i]}][:2]
        if len(first) < 2:
            assert (c, rec) not in got
            continue
        for k, (_, d, r) in enumerate(first, 1):
            assert got[c, rec][f"d{k}"] == d
            assert int(got[c, rec][f"v{k}"][1:]) not in met(r, own[r], d)


def test_blocks_of_queries_hold_few_products(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(4096, 8))
    t = pa.table({"id": pa.array(r.permutation(4096).astype(np.int64)), "v": pa.array(list(x))})
    tracemalloc.start()
    found = N.top(5, 9, 8)(t, t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6  # 4096 by 4096 products alone are 134 MB
    ids, s = t.column("id").to_numpy(), np.round(x @ x.T, 9)
    for i in (0, 127, 128, 4095):
        want = sorted((-s[i, j], ids[j]) for j in range(4096) if j != i)[:5]
        rows = found.filter(pc.equal(found.column("query"), int(ids[i])))
        assert rows.column("near").to_pylist() == [int(w[1]) for w in want]


def test_only_copies_that_may_equal_another_record_are_shuffled(spark):
    r = random.Random(4)
    rows = [(str(i), *(f"{d}{r.randrange(2)}" if r.random() < 0.95 else None for d in DOMAINS)) for i in range(400)]
    df = spark.createDataFrame(rows, "rec_id string, " + ", ".join(f"{d} string" for d in DOMAINS))
    codes = R.dictionary(df.dropna(), ["hscode"])
    value = {c["entity_id"]: c["value"] for c in codes.collect()}
    known, at = {x[1:] for x in rows if None not in x}, 1 + DOMAINS.index("hscode")
    want = []
    for x in rows:
        for k in range(3):
            new = [*x]
            new[at] = value[int(hashlib.md5(f"7#{x[0]}#{k}".encode()).hexdigest()[:8], 16) % len(value)]
            want += [] if tuple(new[1:]) in known else [(x[0], k, *new[1:])]
    out = R.negatives(df, codes, "hscode", 3, 7)
    assert sorted(map(tuple, out.select("rec_id", "neg", *DOMAINS).collect()), key=str) == sorted(want, key=str)
    alone = df.filter("rec_id < '2'").withColumn("shipper", F.col("rec_id"))  # no two have the same other columns
    plan = R.negatives(alone, codes, "hscode", 3, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1 and "_shared" in plan
