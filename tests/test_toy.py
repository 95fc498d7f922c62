"""A case computed by hand, the readers, and loops on small tables."""

import pytest
from pyspark.sql import functions as F

from cargolens.operators import graph as G
from cargolens.operators import learning as L
from cargolens.operators import measures as M
from cargolens.operators import relational as R
from cargolens.sources import records as src

ROWS = [("1", "a", "x", "p", 1), ("2", "a", "x", "q", 1), ("3", "a", "y", "p", -1), ("4", "b", "y", "q", -1), ("5", "b", "y", "q", 0), ("6", "c", "x", "p", 0)]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(ROWS, "rec_id string, S string, H string, P string, y int")


def edges(toy):
    return R.co_occurrence(toy, ["S", "H"])


def test_counts(toy):
    assert {(r.e_a, r.e_b): r.cnt for r in edges(toy).collect()} == {("x", "a"): 2, ("x", "c"): 1, ("y", "a"): 1, ("y", "b"): 2}
    assert {r.rec_id for r in R.low_frequency_removed(toy, 2, ["S", "H", "P"]).collect()} == {"1", "2", "3", "4", "5"}
    assert sorted(r.rec_id for r in R.first_of(toy, ["S", "H", "P"]).collect()) == ["1", "2", "3", "4", "6"]


def test_information_and_similarity(toy):
    assert M.mutual_information(toy, "S", "H").first().mi == pytest.approx(0.374890, abs=1e-6)
    s = {(r.src, r.dst): r.s for r in G.path_similarity(edges(toy), ["S", "H"]).collect()}
    assert s[("a", "b")] == pytest.approx(4 / 9) and s[("a", "c")] == pytest.approx(2 / 3) and s[("a", "a")] == 1 and ("b", "c") not in s
    t = {(r.src, r.dst): r.w for r in G.smoothed_transitions(edges(toy), "S", "H").collect()}
    assert t[("a", "x")] == pytest.approx(0.627115, abs=1e-6) and t[("a", "y")] == pytest.approx(0.372885, abs=1e-6)


def test_label_feature(toy):
    z = {r.rec_id: r.z for r in G.label_feature(toy, edges(toy), ["S", "H"], "y").collect()}
    assert z["1"] == pytest.approx(1 / 3, abs=1e-6) and z["4"] == pytest.approx(-1 / 3, abs=1e-6) and z["6"] == pytest.approx(2 / 3, abs=1e-6)


def test_readers(spark, tmp_path):
    (tmp_path / "in_01_2015.csv").write_text("id,a,b\n1,x,y\n2,,z\n")
    (tmp_path / "in_04_2015.csv").write_text("id,a,b\n3,u,v\n")
    got = src.read_csv(spark, [str(tmp_path / "*.csv")], "id long, a string, b string", ["id", "b"], "0[1-3]_2015")
    assert sorted(map(tuple, got.collect())) == [(1, "y"), (2, "z")]
    (tmp_path / "codes.txt").write_text("33\n 87\n33\n\n")
    assert sorted(r.code for r in src.read_codes(spark, str(tmp_path / "codes.txt")).collect()) == ["33", "87"]
    (tmp_path / "paths.txt").write_text("A, B ,C\n\nB,C\n")
    assert sorted(r.path for r in src.read_paths(spark, str(tmp_path / "paths.txt")).collect()) == [["A", "B", "C"], ["B", "C"]]
    assert sorted(map(tuple, G.relations(src.read_paths(spark, str(tmp_path / "paths.txt"))).collect())) == [("A", "B"), ("B", "C")]


def test_known_labels_stay(toy):
    out = {r.rec_id: r for r in L.relabelled_by_links(toy, edges(toy), ["S", "H"], ["H", "P"], rounds=2).collect()}
    assert len(out) == 6 and all(out[i].y == y for i, *_, y in ROWS if y)
    near = {r.rec_id: r for r in L.relabelled_by_neighbours(toy, G.path_similarity(edges(toy), ["S", "H"]), "S", ["H", "P"], k=2, rounds=2).collect()}
    assert len(near) == 6 and all(near[i].y == y for i, *_, y in ROWS if y)


def test_median_and_mixture(spark, toy):
    parts = [spark.createDataFrame([("a", "b", v)], "src string, dst string, s double") for v in (0.2, 0.6)]
    parts.append(spark.createDataFrame([("a", "c", 0.5)], "src string, dst string, s double"))
    assert {(r.dst, r.s) for r in G.median_similarity(parts).collect()} == {("b", 0.2), ("c", 0.0)}
    assert R.mixture(toy, "y", {1: 1, 0: 5}, 7).groupBy("y").agg(F.count("*").alias("n")).orderBy("y").collect() == [(0, 2), (1, 1)]


def test_sim_rank_converges(spark):
    chain = [("a", "p"), ("b", "p"), ("b", "q"), ("c", "q"), ("c", "r"), ("d", "r")]
    s = {(r.src, r.dst): r.s for r in G.sim_rank(spark.createDataFrame([(a, b, 1.0) for a, b in chain], "src string, dst string, w double"), None).collect()}
    near = {n: sorted({y for x, y in [*chain, *((b, a) for a, b in chain)] if x == n}) for e in chain for n in e}
    want = {(x, y): float(x == y) for x in near for y in near}
    for _ in range(200):
        want = {(x, y): 1.0 if x == y else 0.8 * sum(want[p, q] for p in near[x] for q in near[y]) / len(near[x]) / len(near[y]) for x, y in want}
    assert ("a", "d") in s and all(s[x, y] == pytest.approx(want[x, y], abs=1e-3) for x in "abcd" for y in "abcd")


def test_queries_run_to_the_reference_limits(spark, sf_dir, monkeypatch):
    import inspect

    from cargolens.plans import catalog

    asked = {}
    for name in ("relabelled_by_neighbours", "relabelled_by_links", "self_trained"):
        def spy(*args, _name=name, _like=inspect.signature(getattr(L, name)), **kw):
            call = _like.bind(*args, **kw)
            call.apply_defaults()
            asked[_name] = call.arguments["rounds"]
            return args[0].withColumn("known", F.col("y"))

        monkeypatch.setattr(L, name, spy)
    for name in ("i11_neighbour_relabelling", "i12_link_relabelling", "i16_self_training"):
        catalog.queries()[name](spark, sf_dir)
    assert asked == {"relabelled_by_neighbours": 25, "relabelled_by_links": 10, "self_trained": 10}


def test_links_go_on_until_no_label_is_unknown_or_moves(toy, monkeypatch):
    bounds = []
    clamped = L.clamped
    monkeypatch.setattr(L, "clamped", lambda value, bound: bounds.append(bound) or clamped(value, bound))
    L.relabelled_by_links(toy, edges(toy), ["S", "H"], ["H", "P"], rounds=2)
    assert len(bounds) > 6 and bounds[-2:] == [0.05, 0.05]
