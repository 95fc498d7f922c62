"""Meta-path operators over the typed entity graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargolens.operators.relational import SMALL, both_ways
from cargolens.plans.durable import cut


def hop(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(src, dst, w): edges from domain a to domain b."""
    return both_ways(edges).filter((F.col("src_dom") == a) & (F.col("dst_dom") == b)).select("src", "dst", F.col("cnt").cast("double").alias("w"))


def row_normalised(m: DataFrame) -> DataFrame:
    return m.join(m.groupBy("src").agg(F.sum("w").alias("t")), "src").select("src", "dst", (F.col("w") / F.col("t")).alias("w"))


def product(left: DataFrame, right: DataFrame) -> DataFrame:
    r = right.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("w").alias("v"))
    return left.join(r, "dst").groupBy("src", "end").agg(F.sum(F.col("w") * F.col("v")).alias("w")).withColumnRenamed("end", "dst")


def along(edges: DataFrame, path: list[str], normalise: bool = False) -> DataFrame:
    """The product of the hops of a path; a hop's rows are made to sum to 1 if normalise."""
    out = None
    for a, b in zip(path[:-1], path[1:]):
        m = row_normalised(hop(edges, a, b)) if normalise else hop(edges, a, b)
        out = m if out is None else product(out, m)
    return out


def commuting(edges: DataFrame, path: list[str], normalise: bool = False) -> DataFrame:
    """The matrix of the path followed there and back."""
    return along(edges, path + path[::-1][1:], normalise)


def path_similarity(edges: DataFrame, path: list[str]) -> DataFrame:
    """(src, dst, s): twice the paths between two entities over those from each back to itself."""
    m = commuting(edges, path)
    own = m.filter("src = dst").select(F.col("src").alias("k"), F.col("w").alias("own"))
    out = m.join(own.selectExpr("k src", "own own_src"), "src").join(own.selectExpr("k dst", "own own_dst"), "dst")
    return out.select("src", "dst", (2 * F.col("w") / (F.col("own_src") + F.col("own_dst"))).alias("s"))


def nearest(similarity: DataFrame, k: int) -> DataFrame:
    """The k most similar others of each entity; ties by name."""
    w = Window.partitionBy("src").orderBy(F.desc("s"), "dst")
    return similarity.filter("src <> dst").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def median_similarity(parts: list[DataFrame]) -> DataFrame:
    """(src, dst, s): the median of an odd number of similarities; a pair that one lacks counts 0 there."""
    tall = reduce(DataFrame.unionByName, parts)
    s = tall.groupBy("src", "dst").agg(F.sort_array(F.collect_list("s")).alias("v"))  # one value a part
    padded = F.concat(F.array_repeat(F.lit(0.0), F.lit(len(parts)) - F.size("v")), "v")
    return s.select("src", "dst", F.element_at(padded, len(parts) // 2 + 1).alias("s"))


def adjusted_vectors(vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """(domain, value, k, x): half an entity's vector, half the sum of its neighbours' by squared share of its edges to their domain."""
    tall = vectors.select("domain", "value", F.posexplode("vec").alias("k", "x")).withColumn("k", F.col("k") + 1)
    both = both_ways(edges)
    total = both.groupBy("src_dom", "src", "dst_dom").agg(F.sum("cnt").alias("t"))
    share = both.join(total, ["src_dom", "src", "dst_dom"]).withColumn("q", F.pow(F.col("cnt") / F.col("t"), F.lit(2)))
    near = share.join(tall.selectExpr("domain dst_dom", "value dst", "k", "x"), ["dst_dom", "dst"])
    near = near.groupBy(F.col("src_dom").alias("domain"), F.col("src").alias("value"), "k").agg(F.sum(F.col("q") * F.col("x")).alias("a"))
    return tall.join(near, ["domain", "value", "k"], "left").select("domain", "value", "k", (0.5 * (F.col("x") + F.coalesce("a", F.lit(0.0)))).alias("x"))


def relations(paths: DataFrame) -> DataFrame:
    """(dom_a, dom_b): the distinct pairs of domains that stand side by side in a path."""
    pairs = paths.select(F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b"))).alias("p"))
    return pairs.select(F.least("p.a", "p.b").alias("dom_a"), F.greatest("p.a", "p.b").alias("dom_b")).distinct()


def sim_rank(m: DataFrame, rounds: int | None, decay: float = 0.8, tolerance: float = 1e-4) -> DataFrame:
    """(src, dst, s) of the left side of a bipartite graph; each round goes right to left and back from what is known.

    Without rounds it goes on until no similarity moves by more than the
    tolerance times one plus itself; it shrinks each round, so that comes.
    """
    left = m.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    left = cut(left) if rounds is None else left  # or every round makes the edges anew
    right = left.selectExpr("b a", "a b")

    def step(known: DataFrame | None, e: DataFrame) -> DataFrame:
        # similarity of e's a from that of its b; pairs not known are 0, each b is 1 to itself
        n = e.groupBy("a").agg(F.count("*").alias("n"))
        x, y = e.join(n, "a").selectExpr("a src", "b p", "n nx"), e.join(n, "a").selectExpr("a dst", "b q", "n ny")
        if known is None:
            both = x.join(y.withColumnRenamed("q", "p"), "p").withColumn("s", F.lit(1.0))
        else:
            both = x.join(known.selectExpr("src p", "dst q", "s"), "p").join(y, "q")
        sums = both.groupBy("src", "dst").agg(F.sum("s").alias("t"), F.first(F.col("nx") * F.col("ny")).alias("n"))
        return sums.select("src", "dst", F.when(F.col("src") == F.col("dst"), 1.0).otherwise(decay * F.col("t") / F.col("n")).alias("s"))

    known, done = None, 0
    while done != rounds:
        last, known, done = known, step(step(known, right), left), done + 1
        if rounds is None:
            known = cut(known)
            if last is not None:
                before = last.withColumnRenamed("s", "was")
                moved = known.join(before, ["src", "dst"], "left").filter(F.abs(F.col("s") - F.coalesce("was", F.lit(0.0))) > tolerance * (1 + F.coalesce("was", F.lit(0.0))))
                if moved.isEmpty():
                    break
    return known


def smoothed_transitions(edges: DataFrame, a: str, b: str, power: float = 0.75) -> DataFrame:
    """Transition chances by counts over the greatest count, raised to a power and made to sum to 1."""
    m = hop(edges, a, b)
    top = m.groupBy("src").agg(F.max("w").alias("top"))
    m = m.join(top, "src").select("src", "dst", F.pow(F.col("w") / F.col("top"), F.lit(power)).alias("w"))
    return row_normalised(m)


def label_feature(df: DataFrame, edges: DataFrame, path: list[str], y: str) -> DataFrame:
    """(rec_id, z): labels summed at entities of the path's start, spread along the path and read by each record."""
    return with_label_feature(df, commuting(edges, path, normalise=True), path[0], y).select("rec_id", "z")


def with_label_feature(df: DataFrame, matrix: DataFrame, start: str, y: str) -> DataFrame:
    """df with z, `label_feature` along a path whose matrix is there already: a join by the start's entity."""
    sums = df.groupBy(F.col(start).alias("dst")).agg(F.sum(y).cast("double").alias("y"))
    z = matrix.join(sums, "dst").groupBy(F.col("src").alias(start)).agg(F.sum(F.col("w") * F.col("y")).alias("z"))
    return df.join(z, start, "left").withColumn("z", F.round(F.coalesce("z", F.lit(0.0)), 6))


def walks(edges: DataFrame, starts: DataFrame, path: list[str], length: int, per_start: int, seed: int) -> DataFrame:
    """(start, walk_no, walk): walks along the path there and back again; each step is chosen by a hash from the transitions."""
    around = path + path[::-1][1:-1]
    out = starts.select("start", F.explode(F.sequence(F.lit(0), F.lit(per_start - 1))).alias("walk_no"), F.array("start").alias("walk"), F.col("start").alias("at"))
    for k in range(length - 1):
        a, b = around[k % len(around)], around[(k + 1) % len(around)]
        choices = smoothed_transitions(edges, a, b).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "w"))).alias("c"))
        u = F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(f"{seed}#{k}"), "start", F.col("walk_no").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
        pick = F.aggregate("c", F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("string").alias("dst")), lambda s, x: F.struct((s["sum"] + x["w"]).alias("sum"), F.when(s["dst"].isNull() & (s["sum"] + x["w"] > F.col("u")), x["dst"]).otherwise(s["dst"]).alias("dst")))
        out = out.withColumn("u", u).join(choices, out["at"] == choices["src"], "left").withColumn("next", F.coalesce(pick["dst"], F.element_at("c", -1)["dst"]))
        out = out.select("start", "walk_no", F.when(F.col("next").isNull(), F.col("walk")).otherwise(F.array_append("walk", F.col("next"))).alias("walk"), F.col("next").alias("at"))
    return out.select("start", "walk_no", "walk")


def skip_grams(walks_: DataFrame, context: int) -> DataFrame:
    """(start, walk_no, pos, target, context): each place with full context on both sides."""
    k = context // 2
    at = walks_.select("start", "walk_no", "walk", F.posexplode("walk").alias("pos", "target")).filter((F.col("pos") >= k) & (F.col("pos") < F.size("walk") - k))
    return at.select("start", "walk_no", "pos", "target", F.concat(F.slice("walk", F.col("pos") - k + 1, F.lit(k)), F.slice("walk", F.col("pos") + 2, F.lit(k))).alias("context"))


def record_neighbours(df: DataFrame, similar: DataFrame, domain: str, k: int, id_: str = "rec_id") -> DataFrame:
    """(id, other, s, rank): the k records most similar to each, itself left out; ties by id.

    Records of one entity have the same neighbours but for themselves, so the
    first k + 1 records are found once for each entity, as one row; a window
    keeps k + 1 rows a partition before it is sorted as a whole. A record takes
    its ranks from its entity's list: records are shuffled by id while they are
    narrow, to find ids that several have, and only what these make is ranked anew.
    """
    own = df.select(F.col(id_).alias("other"), F.col(domain).alias("dst"))
    by_id = Window.partitionBy("dst").orderBy("other")
    few = own.withColumn("_n", F.row_number().over(by_id)).filter(F.col("_n") <= k + 1).drop("_n")
    by = Window.partitionBy("src").orderBy(F.desc("s"), "other")
    lists = similar.join(few, "dst").withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= k + 1).select("src", "other", "s", "_n")
    lists = cut(lists.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "other", "s"))), lambda x: F.struct(x["other"], x["s"])).alias("_list")))  # k + 1 at most
    told = df.select(id_, F.col(domain).alias("src")).withColumn("_same", F.count("*").over(Window.partitionBy(id_)))
    told = told.join(F.broadcast(lists) if lists.count() <= SMALL // (k + 1) else lists, "src")
    others = F.filter("_list", lambda x: x["other"] != F.col(id_))
    once = told.filter("_same = 1").select(id_, F.posexplode(F.slice(others, 1, k)).alias("_i", "x")).select(id_, "x.*", (F.col("_i") + 1).alias("rank"))
    of = Window.partitionBy(id_).orderBy(F.desc("s"), "other")
    more = told.filter("_same > 1").select(id_, F.explode(others).alias("x")).select(id_, "x.*")
    return once.unionByName(more.withColumn("rank", F.row_number().over(of)).filter(F.col("rank") <= k))
