"""Round four: each test fails on the code before the finding of its number."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from cargolens.operators import anomalies as A
from cargolens.operators import relational as R
from cargolens.operators import samplers as P
from cargolens.plans import durable
from cargolens.sources.records import DOMAINS


def records(n, seed):
    """n made records with a hashed value of few in each domain; some are null."""
    pick = lambda i, d: int(hashlib.md5(f"{seed}#{i}#{d}".encode()).hexdigest()[:8], 16)
    sizes = {"consignee": 40, "shipper": 5}
    return [(f"r{i}", *(None if pick(i, d + "?") % 50 == 0 else f"{d[0]}{pick(i, d) % sizes.get(d, 6)}" for d in DOMAINS)) for i in range(n)]


def conflicts_by_hand(rows, company, support, n, seed):
    others, held, seen, pairs = [d for d in DOMAINS if d != company], defaultdict(int), set(), set()
    for r in rows:
        x = dict(zip(DOMAINS, r[1:], strict=True))
        for b in others:
            held[x[company], b, x[b]] += x[company] is not None and x[b] is not None
            for c in others:
                if c != b:
                    pairs.add((b, x[b], c, x[c]))
                    seen.add((x[company], b, x[b], c, x[c]))
            pairs.add((company, x[company], b, x[b]))
    md5 = lambda *p: hashlib.md5("#".join([str(seed), *p]).encode()).hexdigest()
    out = []
    for (s, b, e2), m in held.items():
        if m >= support:
            c = [d for d in others if d != b][int(md5(s, b, e2)[:8], 16) % (len(others) - 1)]
            free = [e3 for (k, v, d, e3) in pairs if (k, v, d) == (company, s, c) and e3 is not None and (b, e2, c, e3) in pairs and (s, b, e2, c, e3) not in seen]
            if free:
                out.append((md5(s, b, e2), s, b, e2, c, min(free, key=lambda e: (md5(s, b, e2, e), e))))
    return [(*x[1:], i) for i, x in enumerate(sorted(out)[:n])]


def test_f3_conflicts_are_those_found_by_hand_whatever_is_asked_for(spark):
    rows = records(300, 3)
    df = spark.createDataFrame(rows, "rec_id string, " + ", ".join(f"{d} string" for d in DOMAINS))
    for n in (5, 1000):
        want = conflicts_by_hand(rows, "shipper", 8, n, 7)
        assert len(want) > 4
        got = A.conflicts(df, "shipper", 8, n, 7).orderBy("number").collect()
        assert [(r.shipper, r.b, r.e2, r.c, r.e3, r.number) for r in got] == want


def test_f3_bases_with_few_asked_go_on_to_the_others(spark):
    # the company's entities of carrier in hash order: only the last was ever seen with the port
    df = spark.createDataFrame([(f"r{i}", *("x" for _ in DOMAINS)) for i in range(8)], "rec_id string, " + ", ".join(f"{d} string" for d in DOMAINS)).withColumn("shipper", F.lit("s"))
    some = sorted((hashlib.md5(f"7#s#origin#x#c{i}".encode()).hexdigest(), f"c{i}") for i in range(9))
    last = some[-1][1]
    own = [(f"q{i}", f"c{i}") for i in range(9)]
    more = spark.createDataFrame(own, "rec_id string, carrier string").select("rec_id", *(F.col(d) if d == "carrier" else F.lit("s" if d == "shipper" else f"other {d}").alias(d) for d in DOMAINS))
    met = spark.createDataFrame([("p", last)], "rec_id string, carrier string").select("rec_id", *(F.col(d) if d == "carrier" else F.lit("x" if d == "origin" else f"third {d}").alias(d) for d in DOMAINS))
    bases = spark.createDataFrame([("s", "origin", "x", "carrier", "0", 0)], "shipper string, b string, e2 string, c string, _o string, _i long")
    got = A.first_conflicts(df.unionByName(more).unionByName(met), "shipper", bases, 7).collect()
    assert [(r.shipper, r.b, r.e2, r.c, r.e3) for r in got] == [("s", "origin", "x", "carrier", last)]


def test_f3_shuffle_files_of_ended_plans_are_let_go(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(durable, "freed", lambda s: asked.append(s))
    assert durable.written(spark.range(3)).count() == 3 and durable.cut(spark.range(3)).count() == 3
    assert asked == [spark, spark]


def test_f6_first_copies_are_those_of_all_copies_and_lost_ones_are_made_up_for(spark, monkeypatch):
    domains = ["carrier", "hscode", "origin"]
    rows = [(f"r{i}", "ab"[i % 2], "xy"[i // 2 % 2], "pq"[i // 4 % 2]) for i in range(7)]  # all combinations but one, so most copies have no free value
    df = spark.createDataFrame(rows, "rec_id string, carrier string, hscode string, origin string")
    codes = R.dictionary(df, domains).cache()
    every = P.bagged_negatives(df, codes, 10, 7, domains).collect()
    want = {}
    for r in sorted(every, key=lambda r: r.neg):
        want.setdefault(r.rec_id, []).append(f"{r.hscode}:{r.origin}")
    made, draws = [], P.bagged_draws
    monkeypatch.setattr(P, "bagged_draws", lambda rows, sizes, negs, *x: made.append(negs) or draws(rows, sizes, negs, *x))
    got = {r.rec_id: r.firsts for r in P.first_bagged(df, codes, 3, 10, 7, ["hscode", "origin"], domains).collect()}
    assert got == {k: ",".join(v[:3]) for k, v in want.items()}
    assert made == [range(3), range(10)] and len(every) < 70
    more = df.unionByName(spark.createDataFrame([("s", "c", "z", "o")], df.schema))
    made.clear()
    P.first_bagged(more.limit(0), codes, 3, 10, 7, ["hscode", "origin"], domains).collect()
    assert made == [range(3)]  # nothing is lost, so nothing more is made


def test_f6_copies_that_cannot_be_full_and_are_not_shown_meet_no_seen_ids(spark, monkeypatch):
    domains = ["a", "b", "c"]
    rows = spark.createDataFrame([(f"r{i}", i, i % 4, i % 3) for i in range(12)], "rec_id string, c0 int, c1 int, c2 int")
    sizes = {"a": 12, "b": 4, "c": 3}
    assert P.may_be_full(rows, sizes, domains) == []
    assert P.may_be_full(spark.createDataFrame([(f"r{i}", 0, i % 4, i % 3) for i in range(12)], rows.schema), {**sizes, "a": 1}, domains) == [0, 1, 2]
    met, free = [], P.free_ids
    monkeypatch.setattr(P, "free_ids", lambda draws, *x: met.append({r["_i"] for r in draws.select("_i").collect()}) or free(draws, *x))
    some = {(r.rec_id, r.neg, r.c1) for r in P.bagged_ids(rows, sizes, 6, 7, domains, ["b"]).collect()}
    assert met == [{1}]
    assert some == {(r.rec_id, r.neg, r.c1) for r in P.bagged_ids(rows, sizes, 6, 7, domains).collect()} and len(some) == 72
