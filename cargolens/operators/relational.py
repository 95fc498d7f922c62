"""Cleaning, encoding, joins, set operations, ranking and sampling of records."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.plans.durable import cut, written
from cargolens.sources.records import DOMAINS


def canonical(df: DataFrame, id_: str = "rec_id") -> DataFrame:
    """The id, then the domains in order of name."""
    return df.select(id_, *sorted(c for c in df.columns if c in DOMAINS))


def long_form(df: DataFrame, domains: list[str] = DOMAINS, id_: str = "rec_id") -> DataFrame:
    """(id, domain, value): a row for each domain of each record."""
    return df.select(id_, F.explode(F.array(*(F.struct(F.lit(d).alias("domain"), F.col(d).alias("value")) for d in domains))).alias("x")).select(id_, "x.*")


def low_frequency_removed(df: DataFrame, least: int, domains: list[str]) -> DataFrame:
    """Rows all of whose values occur `least` times in df as it was; survivors may fall below."""
    return reduce(lambda left, d: left.join(df.groupBy(d).count().filter(F.col("count") >= least).select(d), d, "left_semi"), domains, df)


def dictionary(df: DataFrame, domains: list[str] = DOMAINS) -> DataFrame:
    """(domain, value, entity_id): ids by order of value from 0 in each domain; ranked by ranges, so no domain is sorted in one task."""
    order = ranked(long_form(df, domains).select("domain", "value").distinct(), [F.col("domain"), F.col("value")])
    first = order.groupBy("domain").agg(F.min("rn").alias("_first"))  # a row a domain
    return order.join(F.broadcast(first), "domain").select("domain", "value", (F.col("rn") - F.col("_first")).cast("int").alias("entity_id"))


def serial_ids(codes: DataFrame) -> DataFrame:
    """The dictionary with one contiguous id space over the domains in order of name."""
    sizes = codes.groupBy("domain").agg(F.count("*").alias("n"))
    first = sizes.select("domain", F.coalesce(F.sum("n").over(Window.orderBy("domain").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))  # a row a domain
    return codes.join(F.broadcast(first), "domain").withColumn("serial_id", F.col("first") + F.col("entity_id")).drop("first")


BITS = 63  # values in a word of bits
SMALL = 1 << 18  # ids of a domain whose codes are sent to all tasks; larger domains are shuffled


def joined_codes(df: DataFrame, codes: DataFrame, columns: dict[str, dict[str, str]], how: str = "inner") -> DataFrame:
    """df joined by the value of each domain to its codes, whose columns come under the names that `columns` gives for it.

    Domains of up to SMALL ids are broadcast and come first, and a value goes
    once its codes are there; so only large domains shuffle rows, narrow ones.
    """
    n = {r["domain"]: r["n"] for r in codes.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # a row a domain
    for d, names in sorted(columns.items(), key=lambda x: n.get(x[0], 0)):
        own = codes.filter(F.col("domain") == d).select(F.col("value").alias(d), *(F.col(c).alias(name) for c, name in names.items()))
        df = df.join(F.broadcast(own) if n.get(d, 0) <= SMALL else own, d, how).drop(d)
    return df


def encode(df: DataFrame, codes: DataFrame, domains: list[str] = DOMAINS, id_: str = "rec_id") -> DataFrame:
    """Domains as codes; rows with an unknown value go, as do repeated rows."""
    out = joined_codes(df.select(id_, *domains), codes, {d: {"entity_id": f"_{d}"} for d in domains})
    return out.select(id_, *(F.col(f"_{d}").cast("int").alias(d) for d in domains)).distinct()


def serials(df: DataFrame, codes: DataFrame, domains: list[str] = DOMAINS, id_: str = "rec_id") -> DataFrame:
    """(id, domain, serial_id) of `serial_ids`: a row for each domain of each record, made when all ids are there."""
    out = joined_codes(df.select(id_, *domains), codes, {d: {"serial_id": f"_{d}"} for d in domains}, "left")
    each = F.array(*(F.struct(F.lit(d).alias("domain"), F.col(f"_{d}").alias("serial_id")) for d in domains))
    return out.select(id_, F.explode(each).alias("x")).select(id_, "x.*").filter("serial_id IS NOT NULL")


def first_of(df: DataFrame, features: list[str], id_: str = "rec_id") -> DataFrame:
    """Of rows that agree on the features the one of the smallest id."""
    return df.groupBy(*features).agg(F.min(id_).alias(id_)).select(id_, *features)


def updated(df: DataFrame, lookup: DataFrame, key: str, column: str) -> DataFrame:
    """column from the lookup where it has the key, else as it was."""
    return df.join(lookup.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def hash_order(seed: int, id_: str = "rec_id") -> Column:
    return F.md5(F.concat_ws("#", F.lit(str(seed)), id_))


def hash_sample(df: DataFrame, n: int, seed: int, id_: str = "rec_id") -> DataFrame:
    """n rows, the same for the same seed on any partitioning."""
    return df.orderBy(hash_order(seed, id_), id_).limit(n)


def hash_fraction(df: DataFrame, per_cent: int, seed: int, id_: str = "rec_id") -> DataFrame:
    """About this per cent of the rows, without any shuffle."""
    return df.filter(hash_below(per_cent, seed, id_))


def hash_below(per_cent: int, seed: int, id_: str = "rec_id") -> Column:
    return F.conv(F.substring(hash_order(seed, id_), 1, 6), 16, 10).cast("long") % 100 < per_cent


def first_of_each(df: DataFrame, by: str, sizes: dict, order: list[Column]) -> DataFrame:
    """The first `sizes` rows of each value of `by` in that order; ranked by ranges, so no class meets in one task."""
    rows = ranked(df, [F.col(by), *order], "_rn")
    starts = rows.groupBy(by).agg((F.min("_rn") - 1).alias("_start"))  # a row a class
    most = F.lit(0)
    for value, n in sizes.items():
        most = F.when(F.col(by) == value, n).otherwise(most)
    return rows.join(F.broadcast(starts), by).filter(F.col("_rn") - F.col("_start") <= most).select(*df.columns)


def mixture(df: DataFrame, flag: str, sizes: dict[int, int], seed: int, id_: str = "rec_id") -> DataFrame:
    """As many rows of each class as `sizes` says, or all it has; the choice is by hash."""
    return first_of_each(df.withColumn("_o", hash_order(seed, id_)), flag, sizes, [F.col("_o"), F.col(id_)]).drop("_o")


def co_occurrence(df: DataFrame, domains: list[str] = DOMAINS, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Counts of value pairs for every pair of domains, or for those of `pairs`, in one pass and one shuffle.

    While they are counted and shuffled a pair of domains is a number: its names come afterwards.
    """
    pairs = list(combinations(sorted(domains), 2)) if pairs is None else pairs
    each = [F.struct(F.lit(i).alias("_pair"), F.col(a).alias("e_a"), F.col(b).alias("e_b")) for i, (a, b) in enumerate(pairs)]
    n = df.select(F.explode(F.array(*each)).alias("p")).select("p.*").groupBy("_pair", "e_a", "e_b").agg(F.count("*").alias("cnt"))
    name = lambda side: F.element_at(F.array(*(F.lit(p[side]) for p in pairs)), F.col("_pair") + 1)
    return n.select(name(0).alias("dom_a"), name(1).alias("dom_b"), "e_a", "e_b", "cnt")


def co_occurring_ids(df: DataFrame, codes: DataFrame, domains: list[str] = DOMAINS) -> DataFrame:
    """(a, b, n): counts of pairs of serial ids in all pairs of domains; rows are ids before they are multiplied. A null has an id where codes have one for it."""
    null = {r["domain"]: r["serial_id"] for r in codes.filter("value IS NULL").collect()}  # a row a domain at most
    rows = joined_codes(df.select(*domains), codes, {d: {"serial_id": f"_{d}"} for d in domains}, "left").select(*(F.coalesce(f"_{d}", F.lit(null.get(d))).cast("long").alias(d) for d in domains))
    each = F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in combinations(sorted(domains), 2)))
    return rows.select(F.explode(each).alias("x")).select("x.*").filter("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges in either direction: src_dom, dst_dom, src, dst, cnt."""
    a = edges.selectExpr("dom_a src_dom", "dom_b dst_dom", "e_a src", "e_b dst", "cnt")
    return a.unionByName(edges.selectExpr("dom_b src_dom", "dom_a dst_dom", "e_b src", "e_a dst", "cnt"))


def never_together(codes: DataFrame, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(e_a, e_b) of two domains that no record holds: the complement, as large as the product of the domains less the edges.

    Ids of the one domain are counted out for each entity of the other; those
    of the seen pairs are taken away before they become values.
    """
    own = codes.filter(F.col("domain") == b).select(F.col("entity_id").cast("long").alias("_id"), F.col("value").alias("e_b"))
    n = own.count()
    left = codes.filter(F.col("domain") == a).select(F.col("value").alias("e_a"), F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)).cast("long"))).alias("_id"))
    seen = both_ways(edges).filter((F.col("src_dom") == a) & (F.col("dst_dom") == b)).selectExpr("src e_a", "dst e_b").join(own, "e_b").select("e_a", "_id")
    return left.join(seen, ["e_a", "_id"], "left_anti").join(own, "_id").select("e_a", "e_b")


def spurious_removed(test: DataFrame, edges: DataFrame, domains: list[str]) -> DataFrame:
    """Test rows all of whose pairs occur among the edges."""
    pairs = test.select("rec_id", F.explode(F.array(*(F.struct(F.lit(a).alias("dom_a"), F.lit(b).alias("dom_b"), F.col(a).alias("e_a"), F.col(b).alias("e_b")) for a, b in combinations(sorted(domains), 2)))).alias("p")).select("rec_id", "p.*")
    odd = pairs.join(edges.select("dom_a", "dom_b", "e_a", "e_b"), ["dom_a", "dom_b", "e_a", "e_b"], "left_anti").select("rec_id").distinct()
    return test.join(odd, "rec_id", "left_anti")


def pair_counts(df: DataFrame, edges: DataFrame, domains: list[str]) -> DataFrame:
    """(rec_id, dom_a, dom_b, cnt): how often each pair of a record's entities occurs among the edges, 0 if never."""
    pairs = df.select("rec_id", F.explode(F.array(*(F.struct(F.lit(a).alias("dom_a"), F.lit(b).alias("dom_b"), F.col(a).alias("e_a"), F.col(b).alias("e_b")) for a, b in combinations(sorted(domains), 2)))).alias("p")).select("rec_id", "p.*")
    return pairs.join(edges, ["dom_a", "dom_b", "e_a", "e_b"], "left").select("rec_id", "dom_a", "dom_b", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def conflicting_triples(df: DataFrame, a: str, middle: str, b: str) -> DataFrame:
    """(a, middle, b): values whose three pairs all occur in df, but never the three together.

    Values of the middle domain are bits, BITS of them a word: a pair of a and b
    meets the words of its a and of its b, and what both have without the pair
    having it is left. So only pairs are shuffled, and triples come last.
    """
    df = written(df.select(a, middle, b))
    own = df.filter(F.col(middle).isNotNull()).select(middle).distinct()
    ids = cut(ranked(own, [F.col(middle)]).select(F.col(middle), (F.col("rn") - 1).alias("_id")))
    few = ids.count() <= SMALL
    bit = F.expr(f"shiftleft(1L, int(pmod(_id, {BITS})))")
    coded = df.join(F.broadcast(ids) if few else ids, middle, "left").select(a, b, F.floor(F.col("_id") / BITS).alias("_word"), bit.alias("_bit"))
    words = written(coded.groupBy(a, b, "_word").agg(F.bit_or("_bit").alias("_has")))
    some = words.filter("_word IS NOT NULL")
    of = lambda c, name: some.filter(F.col(c).isNotNull()).groupBy(c, "_word").agg(F.bit_or("_has").alias(name))
    pairs = words.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.map_from_entries(F.collect_list(F.when(F.col("_word").isNotNull(), F.struct("_word", "_has")))).alias("_own"))  # words of a pair
    both = pairs.join(of(a, "_a"), a).join(of(b, "_b"), [b, "_word"])
    free = both.select(a, b, "_word", F.col("_a").bitwiseAND(F.col("_b")).bitwiseAND(F.bitwise_not(F.coalesce(F.col("_own")[F.col("_word")], F.lit(0).cast("long")))).alias("_free")).filter("_free <> 0")
    out = free.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1)))).filter(F.expr("(shiftright(_free, _i) & 1) = 1")).select(a, b, (F.col("_word") * BITS + F.col("_i")).alias("_id"))
    return out.join(F.broadcast(ids) if few else ids, "_id").select(a, middle, b)


def own_pair_counts(df: DataFrame, domains: list[str], id_: str = "rec_id") -> DataFrame:
    """(id, dom_a, dom_b, cnt): how many rows of df share each pair of values with the row; nulls are alike.

    A row stays one until all its counts are there. Counts of pairs of small
    domains, up to SMALL in all combinations, are broadcast; other pairs are
    counted where the rows meet by the larger domain of the pair, so that there
    are as many shuffles of rows as large domains.
    """
    domains = sorted(domains)
    df = written(df.select(id_, *domains))
    sizes = df.agg(*(F.approx_count_distinct(d).alias(d) for d in domains)).first().asDict()  # a row; the plan alone depends on it
    pairs = list(combinations(domains, 2))
    small = [p for p in pairs if sizes[p[0]] * sizes[p[1]] <= SMALL]
    n = cut(co_occurrence(df, domains, small)) if small else None
    for d in sorted(domains, key=lambda d: -sizes[d]):
        mine = [p for p in pairs if p not in small and d in p]
        pairs = [p for p in pairs if p not in mine]
        if mine:
            df = df.repartition(d)
        for x, y in mine:
            df = df.withColumn(f"_{x}_{y}", F.count("*").over(Window.partitionBy(d, y if d == x else x)))
    for x, y in small:
        own = n.filter((F.col("dom_a") == x) & (F.col("dom_b") == y)).select(F.col("e_a").alias("_a"), F.col("e_b").alias("_b"), F.col("cnt").alias(f"_{x}_{y}"))
        df = df.join(F.broadcast(own), df[x].eqNullSafe(F.col("_a")) & df[y].eqNullSafe(F.col("_b"))).drop("_a", "_b")
    each = F.array(*(F.struct(F.lit(x).alias("dom_a"), F.lit(y).alias("dom_b"), F.col(f"_{x}_{y}").alias("cnt")) for x, y in combinations(domains, 2)))
    return df.select(id_, F.explode(each).alias("x")).select(id_, "x.*")


def negatives(df: DataFrame, codes: DataFrame, domain: str, k: int, seed: int) -> DataFrame:
    """k copies of each record with one domain replaced by a hashed choice; copies equal to a record are dropped.

    A copy equals its own record, or another that has the same other columns.
    A hash of these finds the few records that share them with another value;
    only their copies are held against all records, the rest needs no shuffle.
    """
    own = codes.filter(F.col("domain") == domain).select(F.col("value").alias("_value"), F.col("entity_id").alias("_pick"))
    size = own.agg(F.count("*")).first()[0]  # a number
    others = [d for d in DOMAINS if d != domain]
    keyed = df.withColumn("_key", F.xxhash64(*others))
    shared = cut(keyed.groupBy("_key").agg(F.min(domain).alias("_a"), F.max(domain).alias("_b"), F.max(F.col(domain).isNull()).alias("_null")).filter("_a < _b OR (_null AND _a IS NOT NULL)").select("_key", F.lit(True).alias("_shared")))
    keyed = keyed.join(F.broadcast(shared) if shared.count() <= SMALL else shared, "_key", "left")
    drawn = keyed.withColumn("neg", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("_pick", F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(str(seed)), "rec_id", F.col("neg").cast("string"))), 1, 8), 16, 10).cast("long") % max(size, 1))
    out = drawn.withColumnRenamed(domain, "_own").join(F.broadcast(own) if size <= SMALL else own, "_pick").withColumnRenamed("_value", domain)
    whole = reduce(lambda a, b: a & b, (F.col(d).isNotNull() for d in others))
    itself = F.coalesce(F.col(domain) == F.col("_own"), F.lit(False)) & whole  # a null equals nothing
    columns = ["rec_id", "neg", *sorted([*others, domain])]
    few = out.filter(F.col("_shared").isNotNull()).select(columns).join(df.join(shared.select("_key"), F.xxhash64(*others) == F.col("_key"), "left_semi").select(*DOMAINS).distinct(), DOMAINS, "left_anti")
    return out.filter(F.col("_shared").isNull() & ~itself).select(columns).unionByName(few.select(columns))


def ranked(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """Global ranks from 1 without one task for all rows: ranges are sorted alone, and counts of the ranges before are added."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    placed = cut(placed.withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("long"), 33)))  # range bounds are drawn once
    before = placed.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return placed.join(F.broadcast(before), "_p").withColumn(name, F.col("_i") + F.col("_before") + 1).drop("_p", "_i", "_before")
