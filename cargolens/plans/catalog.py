"""Every query by name, and the DuckDB SQL that must give the same rows.

"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cargolens.functions import scalars as S
from cargolens.operators import graph as G
from cargolens.operators import measures as M
from cargolens.operators import nearest as N
from cargolens.operators import relational as R
from cargolens.plans.durable import cut
from cargolens.sources.records import DOMAINS, RECORDS_SQL, Config, records, table

CFG = Config()
QUERIES: dict = {}
SQL: dict[str, str] = {}
ALL = ", ".join(DOMAINS)
SPLIT = f"DATE '{CFG.split_date}'"
TRAIN = f"train AS (SELECT * FROM rec WHERE shipped < {SPLIT}), test AS (SELECT * FROM rec WHERE shipped >= {SPLIT})"
LONG = "long AS (" + " UNION ALL ".join(f"SELECT rec_id, '{d}' AS \"domain\", {d} AS \"value\" FROM train" for d in DOMAINS) + ")"
DICT = 'dict AS (SELECT "domain", "value", row_number() OVER (PARTITION BY "domain" ORDER BY "value") - 1 entity_id FROM (SELECT DISTINCT "domain", "value" FROM long))'
SMALL = ["carrier", "destination", "hscode", "origin", "port_of_lading", "port_of_unlading"]


def edges_sql(source: str, domains: list[str], name: str = "edges") -> str:
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT '{a}' dom_a, '{b}' dom_b, {a} e_a, {b} e_b, count(*) cnt FROM {source} GROUP BY {a}, {b}" for a, b in combinations(sorted(domains), 2)) + ")"


def hop_sql(name: str, source: str, a: str, b: str) -> str:
    return f"{name} AS (SELECT {a} src, {b} dst, count(*)::DOUBLE w FROM {source} GROUP BY {a}, {b})"


def query(name: str, *ctes: str, sql: str | None = None):
    """Registers the query, with SQL over the record view and other named parts."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = (f"WITH {', '.join((RECORDS_SQL, TRAIN, *ctes))} " if ctes != ("plain",) else "") + sql
        return f

    return put


def train(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).filter(F.col("shipped") < F.to_date(F.lit(CFG.split_date)))


def test(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).filter(F.col("shipped") >= F.to_date(F.lit(CFG.split_date)))


# sources and sinks


@query("a01_split_by_month", sql="SELECT strftime(shipped, '%Y-%m') AS \"month\", (shipped < " + SPLIT + ") is_train, count(*) n FROM rec GROUP BY 1, 2")
def _(spark, d):
    return records(spark, d).groupBy(F.date_format("shipped", "yyyy-MM").alias("month"), (F.col("shipped") < F.to_date(F.lit(CFG.split_date))).alias("is_train")).agg(F.count("*").alias("n"))


@query("a11_record_sentences", sql=f"SELECT rec_id, concat_ws(' ', {ALL}) sentence FROM train")
def _(spark, d):
    return train(spark, d).select("rec_id", F.array_join(F.array(*DOMAINS), " ").alias("sentence"))


# projections, filters, scalars


@query("b01_canonical_order", sql=f"SELECT rec_id, {ALL} FROM train")
def _(spark, d):
    return R.canonical(train(spark, d))


@query("b02_null_rows_dropped", "plain", sql="SELECT c_custkey, o_orderkey, c_name FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' WHERE o_orderkey IS NOT NULL AND c_name IS NOT NULL")
def _(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "c_name").dropna("any")


@query("b03_dots_removed", sql="SELECT DISTINCT hscode, replace(hscode || '.0', '.', '') code FROM rec")
def _(spark, d):
    return records(spark, d).select("hscode", F.concat("hscode", F.lit(".0")).alias("c")).distinct().select("hscode", S.without_dots("c").alias("code"))


@query("b04_prefix_allow_list", sql="SELECT rec_id, port_of_lading FROM train WHERE substr(port_of_lading, 1, 2) IN ('PROM', 'EC', 'STAN') OR substr(port_of_lading, 1, 4) IN ('PROM', 'EC', 'STAN')")
def _(spark, d):
    return train(spark, d).filter(S.has_prefix("port_of_lading", ["PROMO", "EC", "STAN"])).select("rec_id", "port_of_lading")


@query("b05_deny_list", sql="SELECT rec_id, carrier FROM train WHERE carrier NOT IN ('0F')")
def _(spark, d):
    df = train(spark, d)
    for c, values in CFG.deny.items():
        df = df.filter(~F.col(c).isin(values))
    return df.select("rec_id", "carrier")


@query("b06_low_frequency_removed", sql="SELECT rec_id, consignee, shipper FROM train WHERE consignee IN (SELECT consignee FROM train GROUP BY 1 HAVING count(*) >= 10) AND shipper IN (SELECT shipper FROM train GROUP BY 1 HAVING count(*) >= 10)")
def _(spark, d):
    return R.low_frequency_removed(train(spark, d), CFG.least_count, ["consignee", "shipper"]).select("rec_id", "consignee", "shipper")


@query("b07_dictionary", LONG, DICT, sql='SELECT "domain", "value", entity_id FROM dict')
def _(spark, d):
    return R.dictionary(train(spark, d))


ENCODED = "SELECT DISTINCT rec_id, " + ", ".join(f"{x}_.entity_id::INT {x}" for x in DOMAINS) + " FROM {} t " + " ".join(f"JOIN dict {x}_ ON {x}_.\"domain\" = '{x}' AND {x}_.\"value\" = t.{x}" for x in DOMAINS)


@query("b08_test_encoded", LONG, DICT, sql=ENCODED.format("test"))
def _(spark, d):
    return R.encode(test(spark, d), R.dictionary(train(spark, d)))


@query("b09_row_hash", sql=f"SELECT rec_id, md5(concat_ws('_', {ALL})) row_hash FROM train")
def _(spark, d):
    return train(spark, d).select("rec_id", S.row_hash(DOMAINS).alias("row_hash"))


@query("b10_suffixed_ids", "plain", sql="SELECT o_orderkey, (o_orderkey::VARCHAR || '00101')::DECIMAL(38, 0)::VARCHAR new_id FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.suffixed_id("o_orderkey", "00101").cast("string").alias("new_id"))


@query("b11_pattern_counts", sql="SELECT p.origin, p.hscode, count(t.rec_id) n FROM (SELECT DISTINCT origin, hscode FROM test) p LEFT JOIN train t ON t.origin = p.origin AND t.hscode = p.hscode GROUP BY 1, 2")
def _(spark, d):
    found = train(spark, d).groupBy("origin", "hscode").agg(F.count("*").alias("n"))
    return test(spark, d).select("origin", "hscode").distinct().join(found, ["origin", "hscode"], "left").fillna(0, ["n"])


@query("b12_label_maps", "plain", sql="SELECT doc_id, CASE quality WHEN 1 THEN 1 WHEN 0 THEN -1 ELSE 0 END y, coalesce(toxic, 0) t FROM labels")
def _(spark, d):
    return table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, 1).when(F.col("quality") == 0, -1).otherwise(0).alias("y"), F.coalesce("toxic", F.lit(0)).alias("t"))


SERIAL = 'serial AS (SELECT d."domain", d."value", d.entity_id, d.entity_id + coalesce(s.f, 0) serial_id FROM dict d JOIN (SELECT "domain", sum(n) OVER (ORDER BY "domain" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) f FROM (SELECT "domain", count(*) n FROM dict GROUP BY 1)) s USING ("domain"))'


@query("b14_serial_ids", LONG, DICT, SERIAL, sql='SELECT "domain", "value", entity_id, serial_id::BIGINT serial_id FROM serial')
def _(spark, d):
    return R.serial_ids(R.dictionary(train(spark, d)))


@query("b15_records_as_serials", LONG, DICT, SERIAL, sql='SELECT rec_id, l."domain", s.serial_id::BIGINT serial_id FROM long l JOIN serial s USING ("domain", "value")')
def _(spark, d):
    df = train(spark, d)
    return R.serials(df, cut(R.serial_ids(R.dictionary(df))))


@query("b16_one_hot_long", LONG, sql='SELECT rec_id, "domain" || \'=\' || "value" feature, 1 x FROM long')
def _(spark, d):
    return R.long_form(train(spark, d)).select("rec_id", F.concat_ws("=", "domain", "value").alias("feature"), F.lit(1).alias("x"))


@query("b17_hashed_cross", LONG, DICT, sql="SELECT rec_id, ((x + x % 7) % 23)::INT bucket FROM (SELECT rec_id, h.entity_id * 25 + o.entity_id x FROM train JOIN dict h ON h.\"domain\" = 'hscode' AND h.\"value\" = hscode JOIN dict o ON o.\"domain\" = 'origin' AND o.\"value\" = origin)".replace("% 7", f"% {S.cross_sizes(25, 25)[1]}").replace("% 23", f"% {S.cross_sizes(25, 25)[0]}"))
def _(spark, d):
    df = train(spark, d)
    codes = R.encode(df, R.dictionary(df, ["hscode", "origin"]), ["hscode", "origin"])
    return df.select("rec_id").join(codes, "rec_id").select("rec_id", S.hashed_cross(F.col("hscode"), F.col("origin"), 25, 25).alias("bucket"))


@query("b18_string_cross", sql="SELECT rec_id, concat_ws('-', hscode, origin) cross_value FROM train")
def _(spark, d):
    return train(spark, d).select("rec_id", F.concat_ws("-", "hscode", "origin").alias("cross_value"))


@query("b19_threshold_sign", "plain", sql="SELECT event_id, (CASE WHEN abs(\"value\" - 50) > 20 THEN sign(\"value\" - 50) ELSE 0 END)::INT strict, (CASE WHEN abs(\"value\" - 50) >= 20 THEN sign(\"value\" - 50) ELSE 0 END)::INT inclusive FROM events")
def _(spark, d):
    x = F.col("value") - 50
    return table(spark, d, "events").select("event_id", S.threshold_sign(x, 20, False).alias("strict"), S.threshold_sign(x, 20, True).alias("inclusive"))


@query("b23_confidence", "plain", sql="SELECT event_id, round(abs(2 * p - 1), 6) margin, round(p * (1 - p), 6) spread, (p >= 0.5)::INT guess FROM (SELECT event_id, (event_id % 101) / 100.0::DOUBLE p FROM events)")
def _(spark, d):
    p = (F.col("event_id") % 101) / F.lit(100.0)
    return table(spark, d, "events").select("event_id", F.round(F.abs(2 * p - 1), 6).alias("margin"), F.round(p * (1 - p), 6).alias("spread"), (p >= 0.5).cast("int").alias("guess"))


# joins


ROUTES = "routes AS (SELECT origin, port_of_lading FROM train GROUP BY 1, 2 HAVING count(*) >= 30)"


def routes(df: DataFrame) -> DataFrame:
    return df.groupBy("origin", "port_of_lading").count().filter("count >= 30").select("origin", "port_of_lading")


@query("c01_route_join", ROUTES, sql="SELECT rec_id FROM test JOIN routes USING (origin, port_of_lading)")
def _(spark, d):
    return test(spark, d).join(routes(train(spark, d)), ["origin", "port_of_lading"]).select("rec_id")


@query("c02_semi_join", sql="SELECT rec_id FROM test WHERE consignee IN (SELECT consignee FROM train)")
def _(spark, d):
    return test(spark, d).join(train(spark, d).select("consignee").distinct(), "consignee", "left_semi").select("rec_id")


@query("c03_anti_join", ROUTES, sql="SELECT rec_id FROM test WHERE NOT EXISTS (SELECT 1 FROM routes r WHERE r.origin = test.origin AND r.port_of_lading = test.port_of_lading)")
def _(spark, d):
    return test(spark, d).join(routes(train(spark, d)), ["origin", "port_of_lading"], "left_anti").select("rec_id")


@query("c04_hash_anti_join", sql="SELECT rec_id FROM test WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.origin = test.origin AND t.shipper = test.shipper AND t.hscode = test.hscode AND t.destination = test.destination)")
def _(spark, d):
    h = S.row_hash(["destination", "hscode", "origin", "shipper"]).alias("h")
    return test(spark, d).select("rec_id", h).join(train(spark, d).select(h).distinct(), "h", "left_anti").select("rec_id")


@query("c06_update_from_lookup", "plain", sql="SELECT o_orderkey, coalesce(n.s, o_orderstatus) o_orderstatus FROM orders LEFT JOIN (SELECT l_orderkey, min(l_linestatus) || '*' s FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) n ON n.l_orderkey = o_orderkey")
def _(spark, d):
    new = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.concat(F.min("l_linestatus"), F.lit("*")).alias("o_orderstatus"))
    return R.updated(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), new, "o_orderkey", "o_orderstatus")


# aggregations


@query("d01_group_sizes", sql="SELECT origin, port_of_lading, count(*) n FROM train GROUP BY 1, 2")
def _(spark, d):
    return train(spark, d).groupBy("origin", "port_of_lading").agg(F.count("*").alias("n"))


@query("d02_co_occurrence", edges_sql("train", DOMAINS), sql="SELECT * FROM edges")
def _(spark, d):
    return R.co_occurrence(train(spark, d))


@query("d03_marginals", LONG, sql="SELECT a.\"domain\", a.\"value\", round(coalesce(b.n / (SELECT count(*) FROM train WHERE destination <> '3'), 0.001), 9) p FROM (SELECT DISTINCT \"domain\", \"value\" FROM long) a LEFT JOIN (SELECT \"domain\", \"value\", count(*) n FROM long WHERE rec_id IN (SELECT rec_id FROM train WHERE destination <> '3') GROUP BY 1, 2) b USING (\"domain\", \"value\")")
def _(spark, d):
    df = train(spark, d)
    part = df.filter("destination <> '3'")
    n = R.long_form(part).groupBy("domain", "value").agg(F.count("*").alias("n"))
    total = part.agg(F.count("*").alias("t"))
    return R.long_form(df).select("domain", "value").distinct().join(n, ["domain", "value"], "left").join(F.broadcast(total)).select("domain", "value", F.round(F.coalesce(F.col("n") / F.col("t"), F.lit(0.001)), 9).alias("p"))


@query("d04_domain_sizes", LONG, sql='SELECT "domain", count(DISTINCT "value") n FROM long GROUP BY 1')
def _(spark, d):
    return R.long_form(train(spark, d)).groupBy("domain").agg(F.countDistinct("value").alias("n"))


@query("d05_percentile_band", sql="SELECT origin, port_of_lading, n FROM (SELECT origin, port_of_lading, count(*) n FROM train GROUP BY 1, 2) WHERE n >= (SELECT quantile_cont(n, 0.2) FROM (SELECT count(*) n FROM train GROUP BY origin, port_of_lading)) AND n <= (SELECT quantile_cont(n, 0.8) FROM (SELECT count(*) n FROM train GROUP BY origin, port_of_lading))")
def _(spark, d):
    g = train(spark, d).groupBy("origin", "port_of_lading").agg(F.count("*").alias("n"))
    band = g.agg(F.percentile("n", 0.2).alias("lo"), F.percentile("n", 0.8).alias("hi"))
    return g.join(F.broadcast(band)).filter("n >= lo AND n <= hi").select("origin", "port_of_lading", "n")


@query("d07_median_frequency", sql="SELECT median(n)::DOUBLE median_n FROM (SELECT count(*) n FROM train GROUP BY consignee)")
def _(spark, d):
    return train(spark, d).groupBy("consignee").agg(F.count("*").alias("n")).agg(F.percentile("n", 0.5).alias("median_n"))


@query("d09_pair_feature", sql="SELECT rec_id, count(*) OVER (PARTITION BY hscode, shipper) x FROM train")
def _(spark, d):
    df = train(spark, d)
    return df.select("rec_id", "hscode", "shipper").join(df.groupBy("hscode", "shipper").agg(F.count("*").alias("x")), ["hscode", "shipper"]).select("rec_id", "x")


@query("d10_mutual_information", sql="SELECT round(sum(n / t * ln(n * t / (nx * ny))), 6) mi FROM (SELECT n::DOUBLE n, (sum(n) OVER ())::DOUBLE t, (sum(n) OVER (PARTITION BY hscode))::DOUBLE nx, (sum(n) OVER (PARTITION BY shipper))::DOUBLE ny FROM (SELECT hscode, shipper, count(*) n FROM train GROUP BY 1, 2))")
def _(spark, d):
    return M.mutual_information(train(spark, d), "hscode", "shipper")


@query("d12_first_of_features", sql="SELECT min(rec_id) rec_id, hscode, origin, shipper FROM train GROUP BY hscode, origin, shipper")
def _(spark, d):
    return R.first_of(train(spark, d), ["hscode", "origin", "shipper"])


SCORED = "scored AS (SELECT rec_id, (hash_ % 10007)::DOUBLE / 10007 score, ((hash_ // 10007) % 4 = 0)::INT y FROM (SELECT rec_id, ('0x' || substr(md5(rec_id), 1, 7))::BIGINT hash_ FROM test))"


def with_scores(df: DataFrame) -> DataFrame:
    """df with a score and a mark y, both of which follow from rec_id."""
    h = F.conv(F.substring(F.md5("rec_id"), 1, 7), 16, 10).cast("long")
    return df.withColumns({"score": (h % 10007) / F.lit(10007.0), "y": (F.floor(h / 10007) % 4 == 0).cast("int")})


def scored(spark, d):
    return with_scores(test(spark, d).select("rec_id"))


@query("d16_prefix_metrics", SCORED, sql="SELECT round(p, 3) \"precision\", round(r, 3) recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 3) f1, round((r + s) / 2, 3) balanced_accuracy FROM (SELECT tp / (tp + fp) p, tp / (tp + fn) r, tn / (tn + fp) s FROM (SELECT count(*) FILTER (score < 0.3 AND y = 1)::DOUBLE tp, count(*) FILTER (score < 0.3 AND y = 0)::DOUBLE fp, count(*) FILTER (score >= 0.3 AND y = 1)::DOUBLE fn, count(*) FILTER (score >= 0.3 AND y = 0)::DOUBLE tn FROM scored))")
def _(spark, d):
    return M.metrics(scored(spark, d).withColumn("p", (F.col("score") < 0.3).cast("int")), "p", "y")


CURVE = "b AS (SELECT min(score) lo, max(score) hi FROM scored), bins AS (SELECT ceil((score - lo) * 100 / (hi - lo))::BIGINT step, count(*) n, sum(y) hits FROM scored, b GROUP BY 1), cum AS (SELECT step, sum(n) OVER w found, sum(hits) OVER w hit, sum(hits) OVER () total FROM bins WINDOW w AS (ORDER BY step)), curve AS (SELECT step, found::BIGINT found, round(hit / found, 6) \"precision\", round(hit / total, 6) recall FROM (SELECT *, coalesce(lag(hit) OVER (ORDER BY step), -1) earlier FROM cum) WHERE earlier < total)"


@query("d17_pr_curve", SCORED, CURVE, sql="SELECT * FROM curve")
def _(spark, d):
    return M.pr_curve(scored(spark, d), "score", "y")


@query("d18_pr_area", SCORED, CURVE, sql="SELECT round(sum(x), 5) auc FROM (SELECT (recall - lag(recall) OVER (ORDER BY recall, step)) * (\"precision\" + lag(\"precision\") OVER (ORDER BY recall, step)) / 2 x FROM curve)")
def _(spark, d):
    return M.area(M.pr_curve(scored(spark, d), "score", "y"))


@query("d19_band_precision", SCORED, sql="SELECT (rn - 1) // 250 band, round(avg(y), 6) \"precision\", count(*) n FROM (SELECT y, row_number() OVER (ORDER BY score, rec_id) rn FROM scored) GROUP BY 1")
def _(spark, d):
    r = R.ranked(scored(spark, d), [F.col("score"), F.col("rec_id")])
    return r.groupBy(F.floor((F.col("rn") - 1) / 250).alias("band")).agg(F.round(F.avg("y"), 6).alias("precision"), F.count("*").alias("n"))


# ranking


@query("e02_first_per_cent", SCORED, sql="SELECT rec_id, rn FROM (SELECT rec_id, row_number() OVER (ORDER BY score, rec_id) rn, count(*) OVER () n FROM scored) WHERE rn <= n * 10 // 100")
def _(spark, d):
    s = scored(spark, d)
    return R.ranked(s, [F.col("score"), F.col("rec_id")]).join(F.broadcast(s.agg(F.count("*").alias("n")))).filter("rn <= floor(n * 10 / 100)").select("rec_id", "rn")


@query("e03_top_reveal", SCORED, sql="SELECT rec_id, CASE WHEN rn <= n * 15 // 100 THEN y ELSE -1 END y, rn <= n * 15 // 100 labelled FROM (SELECT rec_id, y, row_number() OVER (ORDER BY score, rec_id) rn, count(*) OVER () n FROM scored)")
def _(spark, d):
    s = scored(spark, d)
    top = F.col("rn") <= F.floor(F.col("n") * 15 / 100)
    return R.ranked(s, [F.col("score"), F.col("rec_id")]).join(F.broadcast(s.agg(F.count("*").alias("n")))).select("rec_id", F.when(top, F.col("y")).otherwise(-1).alias("y"), top.alias("labelled"))


@query("e06_balanced_confident", SCORED, sql="SELECT rec_id, guess FROM (SELECT rec_id, guess, row_number() OVER (PARTITION BY guess ORDER BY margin DESC, rec_id) rn FROM (SELECT rec_id, (score >= 0.5)::INT guess, abs(2 * score - 1) margin FROM scored) WHERE margin > 0.2) WHERE rn <= least(50, (SELECT min(n) FROM (SELECT count(*) n FROM scored WHERE abs(2 * score - 1) > 0.2 GROUP BY score >= 0.5)))")
def _(spark, d):
    s = scored(spark, d).select("rec_id", (F.col("score") >= 0.5).cast("int").alias("guess"), F.abs(2 * F.col("score") - 1).alias("margin")).filter("margin > 0.2")
    quota = s.groupBy("guess").agg(F.count("*").alias("n")).agg(F.least(F.lit(50), F.min("n")).alias("q"))
    top = s.withColumn("rn", F.row_number().over(Window.partitionBy("guess").orderBy(F.desc("margin"), "rec_id"))).filter("rn <= 50")
    return top.join(F.broadcast(quota)).filter("rn <= q").select("rec_id", "guess")


@query("e07_serial_rows", sql="SELECT rec_id, row_number() OVER (ORDER BY rec_id) - 1 serial FROM (SELECT DISTINCT rec_id FROM train)")
def _(spark, d):
    return R.ranked(train(spark, d).select("rec_id").distinct(), [F.col("rec_id")]).select("rec_id", (F.col("rn") - 1).alias("serial"))


# set operations


@query("f01_union_by_name", sql="SELECT rec_id, hscode, 'train' part FROM train UNION ALL SELECT rec_id, hscode, 'test' FROM test")
def _(spark, d):
    return train(spark, d).select("rec_id", "hscode", F.lit("train").alias("part")).unionByName(test(spark, d).select(F.lit("test").alias("part"), "hscode", "rec_id"))


@query("f02_entities_not_seen", sql="SELECT consignee FROM test EXCEPT SELECT consignee FROM train")
def _(spark, d):
    return test(spark, d).select("consignee").subtract(train(spark, d).select("consignee"))


@query("f03_entities_in_both", sql="SELECT consignee FROM test INTERSECT SELECT consignee FROM train")
def _(spark, d):
    return test(spark, d).select("consignee").intersect(train(spark, d).select("consignee"))


@query("f04_entities_of_either", sql="SELECT consignee AS entity FROM test UNION SELECT shipper FROM train")
def _(spark, d):
    return test(spark, d).select(F.col("consignee").alias("entity")).union(train(spark, d).select("shipper")).distinct()


# sampling and synthetic data


@query("g01_hash_sample", sql="SELECT rec_id FROM (SELECT DISTINCT rec_id FROM train) ORDER BY md5('7#' || rec_id), rec_id LIMIT 100")
def _(spark, d):
    return R.hash_sample(train(spark, d).select("rec_id").distinct(), 100, CFG.seed)


@query("g07_negative_samples", LONG, DICT, sql="SELECT s.* FROM (SELECT t.rec_id, k neg, t.carrier, t.consignee, t.destination, c.\"value\" hscode, t.origin, t.port_of_lading, t.port_of_unlading, t.shipper FROM train t CROSS JOIN generate_series(0, 2) g(k) JOIN dict c ON c.\"domain\" = 'hscode' AND c.entity_id = ('0x' || substr(md5('7#' || t.rec_id || '#' || k), 1, 8))::BIGINT % (SELECT count(*) FROM dict WHERE \"domain\" = 'hscode')) s WHERE NOT EXISTS (SELECT 1 FROM train t WHERE " + " AND ".join(f"t.{x} = s.{x}" for x in DOMAINS) + ")")
def _(spark, d):
    df = train(spark, d)
    return R.negatives(df.select("rec_id", *DOMAINS), R.dictionary(df, ["hscode"]), "hscode", 3, CFG.seed)


@query("g10_never_together", LONG, DICT, sql="SELECT a.\"value\" e_a, b.\"value\" e_b FROM dict a, dict b WHERE a.\"domain\" = 'origin' AND b.\"domain\" = 'shipper' AND NOT EXISTS (SELECT 1 FROM train t WHERE t.origin = a.\"value\" AND t.shipper = b.\"value\")")
def _(spark, d):
    df = train(spark, d)
    return R.never_together(R.dictionary(df, ["origin", "shipper"]), R.co_occurrence(df, ["origin", "shipper"]), "origin", "shipper")


SPARSE = ["consignee", "hscode", "shipper"]


@query("g18_spurious_removed", sql="SELECT rec_id, consignee, hscode, shipper FROM test s WHERE " + " AND ".join(f"EXISTS (SELECT 1 FROM train t WHERE t.{a} = s.{a} AND t.{b} = s.{b})" for a, b in combinations(SPARSE, 2)))
def _(spark, d):
    return R.spurious_removed(test(spark, d).select("rec_id", *SPARSE), R.co_occurrence(train(spark, d), SPARSE), SPARSE)


# graph


@query("h01_edges_both_ways", edges_sql("train", ["hscode", "origin"]), sql="SELECT dom_a src_dom, dom_b dst_dom, e_a src, e_b dst, cnt FROM edges UNION ALL SELECT dom_b, dom_a, e_b, e_a, cnt FROM edges")
def _(spark, d):
    return R.both_ways(R.co_occurrence(train(spark, d), ["hscode", "origin"]))


@query("h02_smoothed_transitions", hop_sql("m", "train", "shipper", "hscode"), sql="SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) w FROM (SELECT src, dst, pow(w / max(w) OVER (PARTITION BY src), 0.75) w FROM m)")
def _(spark, d):
    return G.smoothed_transitions(R.co_occurrence(train(spark, d), ["hscode", "shipper"]), "shipper", "hscode").select("src", "dst", F.round("w", 6).alias("w"))


COMMUTING = "c AS (SELECT a.src, b.src dst, sum(a.w * b.w) w FROM m a JOIN m b ON a.dst = b.dst GROUP BY 1, 2)"


@query("h05_commuting_matrix", hop_sql("m", "train", "origin", "hscode"), COMMUTING, sql="SELECT src, dst, w FROM c")
def _(spark, d):
    return G.commuting(R.co_occurrence(train(spark, d), ["hscode", "origin"]), ["origin", "hscode"])


@query("h07_path_similarity", hop_sql("m", "train", "origin", "hscode"), COMMUTING, sql="SELECT c.src, c.dst, round(2 * c.w / (a.w + b.w), 6) s FROM c JOIN c a ON a.src = c.src AND a.dst = c.src JOIN c b ON b.src = c.dst AND b.dst = c.dst")
def _(spark, d):
    return G.path_similarity(R.co_occurrence(train(spark, d), ["hscode", "origin"]), ["origin", "hscode"]).select("src", "dst", F.round("s", 6).alias("s"))


@query("h08_nearest_entities", hop_sql("m", "train", "origin", "hscode"), COMMUTING, sql="SELECT src, dst, \"rank\"::INT \"rank\" FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) \"rank\" FROM (SELECT c.src, c.dst, round(2 * c.w / (a.w + b.w), 9) s FROM c JOIN c a ON a.src = c.src AND a.dst = c.src JOIN c b ON b.src = c.dst AND b.dst = c.dst) WHERE src <> dst) WHERE \"rank\" <= 5")
def _(spark, d):
    s = G.path_similarity(R.co_occurrence(train(spark, d), ["hscode", "origin"]), ["origin", "hscode"]).withColumn("s", F.round("s", 9))
    return G.nearest(s, 5).select("src", "dst", "rank")


NORMAL = "n1 AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) w FROM m), n2 AS (SELECT dst src, src dst, w / sum(w) OVER (PARTITION BY dst) w FROM m), p AS (SELECT a.src, b.dst, sum(a.w * b.w) w FROM n1 a JOIN n2 b ON a.dst = b.src GROUP BY 1, 2)"


@query("h09_normalised_path", hop_sql("m", "train", "origin", "hscode"), NORMAL, sql="SELECT src, dst, round(w, 6) w FROM p")
def _(spark, d):
    return G.commuting(R.co_occurrence(train(spark, d), ["hscode", "origin"]), ["origin", "hscode"], normalise=True).select("src", "dst", F.round("w", 6).alias("w"))


@query("h10_label_feature", hop_sql("m", "train", "origin", "hscode"), NORMAL, sql="SELECT t.rec_id, round(coalesce(z.z, 0), 6) z FROM test t LEFT JOIN (SELECT p.src, sum(p.w * y.y) z FROM p JOIN (SELECT origin, sum(CASE WHEN carrier LIKE '%F' THEN 1 ELSE -1 END) y FROM test GROUP BY 1) y ON y.origin = p.dst GROUP BY 1) z ON z.src = t.origin")
def _(spark, d):
    df = test(spark, d).withColumn("y", F.when(F.col("carrier").like("%F"), 1).otherwise(-1))
    return G.label_feature(df, R.co_occurrence(train(spark, d), ["hscode", "origin"]), ["origin", "hscode"], "y")


def nine_places(spark, d):
    df = train(spark, d)
    return G.walks(R.co_occurrence(df, ["hscode", "origin"]), df.select(F.col("origin").alias("start")).distinct(), ["origin", "hscode"], 9, 3, CFG.seed)


@query("h11_walks")
def _(spark, d):
    return nine_places(spark, d)


@query("e08_skip_grams")
def _(spark, d):
    return G.skip_grams(nine_places(spark, d), 4)


@query("h15_nearest_vectors", "plain", sql="SELECT q vec_id, v near, \"rank\"::INT \"rank\" FROM (SELECT q, v, row_number() OVER (PARTITION BY q ORDER BY c DESC, v) \"rank\" FROM (SELECT a.vec_id q, b.vec_id v, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 9) c FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)) WHERE \"rank\" <= 5")
def _(spark, d):
    # the stated query set, every twentieth vector, against all rows, in blocks
    e = N.unit(table(spark, d, "embeddings"), "vec_id", "embedding")
    return N.exact(e, e.filter("id % 20 = 0"), 5).select(F.col("query").alias("vec_id"), "near", "rank")


@query("h15_indexed_vectors")
def _(spark, d):
    # the same through an inverted file: 32 cells, of which each query reads 25, as these vectors lie in no clusters
    e = N.unit(table(spark, d, "embeddings"), "vec_id", "embedding")
    return N.indexed(e, e.filter("id % 20 = 0"), 5, N.Cells.fit(e, 32), 25).select(F.col("query").alias("vec_id"), "near", "s", "rank")


# scores with given weights


VECTORS = "list_transform(range(1, 5), lambda k: ((({}) * 31 + k * 17) % 23 - 11) / 23.0::DOUBLE)"


def coded(spark, d, domains):
    df = train(spark, d)
    return R.encode(df, R.dictionary(df, domains), domains)


CODES = "codes AS (SELECT DISTINCT rec_id, h.entity_id h, o.entity_id o, c.entity_id c FROM train JOIN dict h ON h.\"domain\" = 'hscode' AND h.\"value\" = hscode JOIN dict o ON o.\"domain\" = 'origin' AND o.\"value\" = origin JOIN dict c ON c.\"domain\" = 'carrier' AND c.\"value\" = carrier)"
THREE = ["hscode", "origin", "carrier"]


def three_vectors(df):
    return [S.code_vector(F.col(c), 4) for c in THREE]


@query("i01_weighted_norm_score", LONG, DICT, CODES, sql=f"SELECT rec_id, round(tanh(list_sum(list_transform(range(1, 5), lambda i: pow(0.5 * a[i] + 0.25 * b[i] + 0.125 * e[i], 2)))), 6) score FROM (SELECT rec_id, {VECTORS.format('h')} a, {VECTORS.format('o')} b, {VECTORS.format('c')} e FROM codes)")
def _(spark, d):
    df = coded(spark, d, THREE)
    a, b, e = three_vectors(df)
    v = F.zip_with(F.zip_with(a, b, lambda x, y: 0.5 * x + 0.25 * y), e, lambda x, y: x + 0.125 * y)
    return df.select("rec_id", F.round(F.tanh(S.dot(v, v)), 6).alias("score"))


@query("i03_pairwise_score", LONG, DICT, CODES, sql=f"SELECT rec_id, round(exp(0.25 * list_dot_product(a, b) + 0.5 * list_dot_product(a, e) + 0.75 * list_dot_product(b, e) + 0.1), 6) score FROM (SELECT rec_id, {VECTORS.format('h')} a, {VECTORS.format('o')} b, {VECTORS.format('c')} e FROM codes)")
def _(spark, d):
    df = coded(spark, d, THREE)
    a, b, e = three_vectors(df)
    return df.select("rec_id", F.round(F.exp(0.25 * S.dot(a, b) + 0.5 * S.dot(a, e) + 0.75 * S.dot(b, e) + 0.1), 6).alias("score"))


@query("i18_factor_interaction", LONG, DICT, CODES, sql=f"SELECT rec_id, round(list_dot_product(a, b) + list_dot_product(a, e) + list_dot_product(b, e), 6) score FROM (SELECT rec_id, {VECTORS.format('h')} a, {VECTORS.format('o')} b, {VECTORS.format('c')} e FROM codes)")
def _(spark, d):
    df = coded(spark, d, THREE)
    return df.select("rec_id", F.round(S.interaction(F.array(*three_vectors(df)), 4), 6).alias("score"))


FLAGSHIP = "h07_path_similarity"

from cargolens.plans import alike, embedded, extended, learned, made, walked, wider  # noqa: E402, F401  they register their queries


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
