"""Queries of filters, paging, sets, joins, graphs, changes and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import text as x
from sparkloom.functions import vector as v
from sparkloom.operators import change, graph, joins, ordered
from sparkloom.plans.registry import query
from sparkloom.tables import USAGE_SQL, load, usage

U = "WITH " + USAGE_SQL


def q(name, sql):
    return query(name, sql)


def at(text):
    return F.lit(text).cast("timestamp_ntz")


q("f1_filter_events", f"{U} SELECT id, domain FROM usage WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' AND tier = 'playwright'")(lambda s, d: usage(s, d).where(F.col("ts").between(at("2024-01-05"), at("2024-01-06")) & (F.col("tier") == "playwright")).select("id", "domain"))
q("f2_period_starts", f"{U} SELECT id, date_trunc('hour', ts) AS hour, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS TIMESTAMP) AS week, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month FROM usage")(lambda s, d: usage(s, d).select("id", *[F.date_trunc(u, "ts").cast("timestamp_ntz").alias(u) for u in ("hour", "day", "month")], F.date_sub(F.to_date("ts"), F.dayofweek("ts") - 1).cast("timestamp_ntz").alias("week")))
q("f3_previous_day", f"{U}, m AS (SELECT date_trunc('day', max(ts)) AS t FROM usage) SELECT count(*) AS n FROM usage, m WHERE ts >= t - INTERVAL 1 DAY AND ts < t")(lambda s, d: usage(s, d).join(F.broadcast(usage(s, d).agg(F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("t")))).where((F.col("ts") >= F.col("t") - F.expr("INTERVAL 1 DAY")) & (F.col("ts") < F.col("t"))).agg(F.count("*").alias("n")))
q("f6_log_page", f"{U} SELECT id, ts FROM usage WHERE starts_with(domain, 'd1') AND cost_units BETWEEN 1 AND 5 ORDER BY ts DESC, id DESC LIMIT 100 OFFSET 20")(lambda s, d: usage(s, d).where(F.startswith("domain", F.lit("d1")) & F.col("cost_units").between(1, 5)).orderBy(F.desc("ts"), F.desc("id")).offset(20).limit(100).select("id", "ts"))
q("f7_page_then_filter", f"{U}, p AS (SELECT * FROM usage WHERE tool <> 'view' ORDER BY ts DESC, id DESC LIMIT 200) SELECT id FROM p WHERE NOT success")(lambda s, d: usage(s, d).where("tool <> 'view'").orderBy(F.desc("ts"), F.desc("id")).limit(200).where("not success").select("id"))
q("f8_search_patterns", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'a') AND p_size > 10 AND p_retailprice < 1500")(lambda s, d: load(s, d, "part").where(F.contains(F.lower("p_name"), F.lit("a")) & (F.col("p_size") > 10) & (F.col("p_retailprice") < 1500)).select("p_partkey"))
q("f11_page_with_total", "SELECT o_orderkey, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")(lambda s, d: load(s, d, "orders").where("o_orderstatus = 'O'").join(F.broadcast(load(s, d, "orders").where("o_orderstatus = 'O'").agg(F.count("*").alias("total")))).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "total"))
q("f16_captures", "SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)(/.*)?$', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)(/.*)?$', 2) AS host FROM pages")(lambda s, d: load(s, d, "pages").select("page_id", F.regexp_extract("url", "^(https?)://([^/]+)(/.*)?$", 1).alias("scheme"), F.regexp_extract("url", "^(https?)://([^/]+)(/.*)?$", 2).alias("host")))
q("f23_filter_urls", "SELECT page_id FROM pages WHERE NOT regexp_matches(url, 'pills|casino') AND NOT regexp_matches(url, '^http://m[.]')")(lambda s, d: load(s, d, "pages").where(~F.exists(F.array(F.lit("pills|casino"), F.lit("^http://m[.]")), lambda p: F.regexp_like("url", p))).select("page_id"))
q("f27_not_expired", "SELECT p_partkey FROM part WHERE p_size % 10 = 0 OR 25 < p_size")(lambda s, d: load(s, d, "part").where((F.col("p_size") % 10 == 0) | (F.lit(25) < F.col("p_size"))).select("p_partkey"))
q("f34_validated_content", "SELECT doc_id, [r for r in [CASE WHEN n_chars < 200 THEN 'too short' END, CASE WHEN n_chars > 5000 THEN 'too long' END, CASE WHEN contains(text, '%%%') THEN 'excluded term' END, CASE WHEN NOT contains(lower(text), 'the') THEN 'missing term' END] if r IS NOT NULL] AS reasons FROM documents")(lambda s, d: load(s, d, "documents").select("doc_id", F.array_compact(F.array(F.when(F.col("n_chars") < 200, "too short"), F.when(F.col("n_chars") > 5000, "too long"), F.when(F.contains("text", F.lit("%%%")), "excluded term"), F.when(~F.contains(F.lower("text"), F.lit("the")), "missing term"))).alias("reasons")))
q("t1_domains_by_performance", f"{U}, s AS (SELECT domain, round(avg(duration_ms), 6) AS mean FROM usage GROUP BY domain) SELECT domain, mean FROM s ORDER BY mean, domain LIMIT 20")(lambda s, d: usage(s, d).groupBy("domain").agg(F.round(F.avg("duration_ms"), 6).alias("mean")).orderBy("mean", "domain").limit(20))
q("t2_recent", f"{U} SELECT id FROM usage ORDER BY ts DESC, id DESC LIMIT 50")(lambda s, d: usage(s, d).orderBy(F.desc("ts"), F.desc("id")).limit(50).select("id"))
q("t3_recent_of_tier", f"{U} SELECT id FROM usage WHERE tier = 'lightweight' ORDER BY ts DESC, id DESC LIMIT 50")(lambda s, d: usage(s, d).where("tier = 'lightweight'").orderBy(F.desc("ts"), F.desc("id")).limit(50).select("id"))
q("t6_history_per_domain", f"{U} SELECT domain, id FROM usage QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC, id DESC) <= 10")(lambda s, d: ordered.latest(usage(s, d), ["domain"], [F.desc("ts"), F.desc("id")], 10).select("domain", "id"))
q("t13_search_page", "SELECT p_partkey, round(0.4 * p_size / 10 + 0.3 * ln(p_retailprice + 1), 6) AS relevance FROM part ORDER BY relevance DESC, p_partkey LIMIT 20 OFFSET 20")(lambda s, d: load(s, d, "part").select("p_partkey", F.round(0.4 * F.col("p_size") / 10 + 0.3 * F.log(F.col("p_retailprice") + 1), 6).alias("relevance")).orderBy(F.desc("relevance"), "p_partkey").offset(20).limit(20))
q("u2_dedup_hints", "SELECT l_partkey, l_orderkey, l_discount FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount DESC, l_orderkey, l_linenumber) = 1")(lambda s, d: joins.best_first(load(s, d, "lineitem"), ["l_partkey"], [F.desc("l_discount"), F.asc("l_orderkey"), F.asc("l_linenumber")]).select("l_partkey", "l_orderkey", "l_discount"))
q("u4_distinct_names", "SELECT min(p_partkey) AS p_partkey, trim(lower(p_type)) AS name FROM part GROUP BY 2")(lambda s, d: load(s, d, "part").groupBy(F.trim(F.lower("p_type")).alias("name")).agg(F.min("p_partkey").alias("p_partkey")))
@query("u5_components")
def _(s, d):
    """Groups of parts and suppliers tied by strong edges: two lines at least, six in ten of them not returned.

    Without SQL: the closure that a recursive query builds is quadratic in the size of the groups.
    """
    edges = load(s, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("ok"))
    strong = edges.where((F.col("ok") >= 2) & (F.col("ok") / F.col("n") >= 0.6))
    return graph.components(strong.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b")))


q("u9_fuzzy_match", "WITH w AS (SELECT p_partkey, lower(trim(p_name)) AS a, lower(trim(p_type)) AS b FROM part), t AS (SELECT *, list_distinct([w for w in regexp_split_to_array(a, '[ \\t\\n]+') if length(w) > 2]) AS x, list_distinct([w for w in regexp_split_to_array(b, '[ \\t\\n]+') if length(w) > 2]) AS y FROM w) SELECT p_partkey, round(CASE WHEN a = b THEN 1 WHEN contains(a, b) OR contains(b, a) THEN 0.8 WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 0 END, 6)::DOUBLE AS score FROM t")(lambda s, d: load(s, d, "part").select("p_partkey", F.round(x.fuzzy(F.col("p_name"), F.col("p_type")), 6).alias("score")))
q("u12_count_by_domain", "WITH t AS (SELECT unnest([lang, source]) AS tag FROM documents) SELECT tag, count(*) AS n FROM t GROUP BY tag")(lambda s, d: load(s, d, "documents").select(F.explode(F.array("lang", "source")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")))
q("u13_merged_entries", "WITH a AS (SELECT user_id, count(*) AS n, max(value) AS best FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, count(*) AS n, max(value) AS best FROM events WHERE event_id % 3 = 0 GROUP BY 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) + coalesce(b.n, 0) AS n, greatest(a.best, b.best) AS best FROM a FULL JOIN b ON a.user_id = b.user_id")(lambda s, d: (lambda part: part(2).join(part(3).withColumnsRenamed({"n": "n2", "best": "best2"}), "user_id", "full_outer").select("user_id", (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"), F.greatest("best", "best2").alias("best")))(lambda k: load(s, d, "events").where(F.col("event_id") % k == 0).groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("best"))))
q("j1_ranked_hits", "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 0 ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 20")(lambda s, d: load(s, d, "orders").join(load(s, d, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "c_name", "o_totalprice"))
@q("j4_theta_join", "SELECT s.s_suppkey, count(*) AS n FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey AND c.c_acctbal > s.s_acctbal GROUP BY s.s_suppkey")
def _(s, d):
    low = load(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("at"))
    high = load(s, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("at"))
    return joins.counted_above(low, high, "nation", "at").groupBy("s_suppkey").agg(F.sum("n").alias("n"))


RULES = [("blog", "^http://blog[.]"), ("mobile", "^http://m[.]"), ("org", "example[.]org/"), ("any", ".")]
q("j5_regex_join", "SELECT p.page_id, r.name FROM pages p JOIN (VALUES " + ", ".join(f"('{n}', '{r}')" for n, r in RULES) + ") r(name, pattern) ON regexp_matches(p.url, r.pattern)")(lambda s, d: joins.regex_join(load(s, d, "pages"), s.createDataFrame(RULES, "name string, pattern string"), F.col("url"), "pattern").select("page_id", "name"))
q("j6_first_rule", "SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(url, '{r}') THEN '{n}'" for n, r in RULES) + " END AS rule FROM pages")(lambda s, d: joins.first_rule(load(s, d, "pages"), RULES, F.col("url"), "rule").select("page_id", "rule"))
q("j8_uncovered", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")(lambda s, d: joins.uncovered(load(s, d, "customer"), load(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey"))
@q("j9_related", "WITH r AS (SELECT l_suppkey AS node, l_partkey AS via FROM lineitem GROUP BY ALL HAVING max(l_discount) >= 0.05) SELECT x.node AS a, y.node AS b, count(*) AS common FROM r x JOIN r y ON x.via = y.via AND x.node < y.node GROUP BY 1, 2")
def _(s, d):
    sure = load(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("via")).agg(F.max("l_discount").alias("confidence")).where("confidence >= 0.05")
    return joins.related(sure, "node", "via")
q("j13_consenting", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")(lambda s, d: joins.covered(load(s, d, "orders"), load(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_orderkey"))
q("j15_coverage", "SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS indexed, CAST(round(100.0 * (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) / (SELECT count(*) FROM documents)) AS BIGINT) AS percent")(lambda s, d: load(s, d, "documents").join(load(s, d, "labels").select("doc_id", F.lit(1).alias("hit")), "doc_id", "left").agg(F.count("*").alias("total"), F.count("hit").alias("indexed"), F.round(100.0 * F.count("hit") / F.count("*")).cast("long").alias("percent")))
q("j19_compared_tables", "WITH a AS (SELECT l_partkey AS k, max(l_quantity) AS v FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_partkey AS k, max(l_quantity) AS v FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, a.v AS old, b.v AS new, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS NULL OR b.v IS NULL OR a.v <> b.v")(lambda s, d: (lambda side: joins.compared(side("l_linenumber <= 3"), side("l_linenumber >= 3"), ["k"], "v"))(lambda c: load(s, d, "lineitem").where(c).groupBy(F.col("l_partkey").alias("k")).agg(F.max("l_quantity").alias("v"))))
q("j21_agreement", "WITH p AS (SELECT l_partkey, l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY 1) SELECT p.l_partkey, arg_min(l_returnflag, (-n, l_returnflag)) AS recommended, arg_min(n, (-n, l_returnflag)) AS agreeing, any_value(sources) AS sources, count(*) AS \"values\" FROM p JOIN t USING (l_partkey) GROUP BY 1")(lambda s, d: joins.agreement(load(s, d, "lineitem"), ["l_partkey"], "l_suppkey", "l_returnflag"))
MEANS = "WITH d AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IS NOT NULL), c AS (SELECT label, i, avg(v) AS m FROM d WHERE isfinite(v) GROUP BY ALL), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY label)"


@q("v20_similar_domains", MEANS + ", s AS (SELECT a.label, b.label AS other, round(sum(a.m * b.m) / any_value(x.n * y.n), 6) AS score FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label JOIN n x ON a.label = x.label JOIN n y ON b.label = y.label GROUP BY 1, 2) SELECT label, other, score FROM s WHERE score > -0.2 QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, other) <= 5")
def _(s, d):
    """For each domain (here a label) the five others of nearest mean vector above a threshold; every vector counts, pairs are of domains."""
    long = load(s, d, "embeddings").where("label is not null").select("label", F.posexplode("embedding").alias("i", "x"))
    finite = ~F.isnan("x") & (F.abs("x") < F.lit(float("inf")))
    means = long.where(finite).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vectors = means.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("i", "m"))).alias("v"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    a, b = vectors.toDF("label", "v", "n"), vectors.toDF("other", "w", "k")
    dot = F.aggregate(F.map_entries("v"), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at("w", e["key"]), F.lit(0.0)))
    scored = a.join(b, F.col("label") != F.col("other")).select("label", "other", F.round(dot / (F.col("n") * F.col("k")), 6).alias("score")).where("score > -0.2")
    return joins.best_first(scored, ["label"], [F.desc("score"), F.asc("other")], 5)
CHG = f"{U}, c AS (SELECT * FROM usage WHERE tool = 'purchase')"


def changes(s, d):
    return usage(s, d).where("tool = 'purchase'")


q("d7_quick_stats", "WITH p AS (SELECT doc_id, source, text, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS old FROM documents) SELECT doc_id, text <> old AS changed, len(string_split(text, chr(10))) - len(string_split(old, chr(10))) AS lines, length(text) - length(old) AS size FROM p WHERE old IS NOT NULL")(lambda s, d: change.against_previous(load(s, d, "documents"), ["source"], ["doc_id"], F.col("text")).where("before is not null").select("doc_id", "changed", (F.size(F.split("value", "\n")) - F.size(F.split("before", "\n"))).cast("long").alias("lines"), (F.length("value") - F.length("before")).cast("long").alias("size")))
q("d10_hash_changes", "WITH p AS (SELECT doc_id, md5(text) AS h, lag(md5(text)) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents) SELECT doc_id FROM p WHERE h <> b")(lambda s, d: change.against_previous(load(s, d, "documents"), ["source"], ["doc_id"], F.md5("text")).where("changed").select("doc_id"))
q("d15_daily_pattern", CHG + ", h AS (SELECT domain, hour(ts) AS hour, count(*) AS n FROM c GROUP BY 1, 2), m AS (SELECT domain, arg_min(hour, (-n, hour)) AS t FROM h GROUP BY 1), r AS (SELECT c.domain, any_value(t) AS typical_hour, round(avg(CAST(least(abs(hour(ts) - t), 24 - abs(hour(ts) - t)) <= 1 AS INT)), 6) AS share, count(DISTINCT CAST(ts AS DATE)) AS days FROM c JOIN m USING (domain) GROUP BY c.domain) SELECT domain, CAST(typical_hour AS INTEGER) AS typical_hour, share, days, share > 0.6 AND days >= 3 AS daily FROM r")(lambda s, d: change.daily_pattern(changes(s, d), ["domain"], "ts"))
q("d16_workday_pattern", CHG + ", r AS (SELECT domain, round(avg(CAST(dayofweek(ts) NOT IN (0, 6) AS INT)), 6) AS share, count_if(dayofweek(ts) IN (0, 6)) AS weekend, count(*) AS n FROM c GROUP BY domain) SELECT *, share > 0.85 AND weekend <= 1 AND n >= 5 AS workday FROM r")(lambda s, d: change.workday_pattern(changes(s, d), ["domain"], "ts"))
q("d17_weekly_pattern", CHG + ", w AS (SELECT domain, dayofweek(ts) AS day, count(*) AS n FROM c GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, day) AS r FROM w), t AS (SELECT domain, sum(n) FILTER (r <= 3) AS top, sum(n) AS total FROM k GROUP BY 1), z AS (SELECT domain, count(DISTINCT date_trunc('week', ts)) AS weeks FROM c GROUP BY 1) SELECT domain, round(top / total, 6) AS share, weeks, round(top / total, 6) > 0.7 AND weeks >= 3 AS weekly FROM t JOIN z USING (domain)")(lambda s, d: change.weekly_pattern(changes(s, d), ["domain"], "ts"))
q("d18_monthly_pattern", CHG + ", r AS (SELECT domain, count(DISTINCT day(ts)) AS days, count(DISTINCT date_trunc('month', ts)) AS months FROM c GROUP BY domain) SELECT *, days <= 5 AND months >= 2 AS monthly FROM r")(lambda s, d: change.monthly_pattern(changes(s, d), ["domain"], "ts"))
q("d19_next_change", CHG + ", g AS (SELECT domain, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY domain ORDER BY ts, id)) / 1e6 AS gap FROM c), r AS (SELECT domain, max(ts) AS last, CAST(floor(avg(gap)) AS BIGINT) AS mean_s FROM g GROUP BY domain) SELECT domain, last, mean_s, last + to_seconds(mean_s) AS next FROM r WHERE mean_s IS NOT NULL")(lambda s, d: change.next_change(changes(s, d), ["domain"], "ts", "id"))
q("d21_seasonal", CHG + " SELECT CAST(day(ts) AS INTEGER) AS day, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(*) / sum(count(*)) OVER () >= 1.5 / 31 AS high FROM c GROUP BY 1")(lambda s, d: change.seasonal(changes(s, d), "ts"))
q("d25_refresh_schedule", "SELECT p_partkey, round(CASE WHEN p_size / 50.0 > 0.3 THEN greatest(5 / 60.0, least(24.0, 0.8 * p_retailprice / 100)) ELSE 168.0 END, 6)::DOUBLE AS hours FROM part")(lambda s, d: load(s, d, "part").select("p_partkey", F.round(change.interval_preset(F.col("p_retailprice") / 100, F.col("p_size") / 50.0), 6).alias("hours")))
KV = "kv AS (SELECT 'ns' || (user_id % 7) AS namespace, CAST(user_id AS VARCHAR) AS key, props AS value, ts AS updated_at, event_id FROM events)"


def kv(s, d):
    e = load(s, d, "events")
    return e.select(F.concat(F.lit("ns"), (F.col("user_id") % 7).cast("string")).alias("namespace"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), F.col("ts").alias("updated_at"), "event_id")


def current(s, d):
    from sparkloom.sources.stores import latest_values

    return latest_values(kv(s, d), ["namespace", "key"], ["updated_at", "event_id"])


NOW = f"WITH {KV}, cur AS (SELECT namespace, key, value, updated_at FROM kv QUALIFY row_number() OVER (PARTITION BY namespace, key ORDER BY updated_at DESC, event_id DESC) = 1)"
q("s7_get", NOW + " SELECT value FROM cur WHERE namespace = 'ns3' AND key = '3'")(lambda s, d: current(s, d).where("namespace = 'ns3' and key = '3'").select("value"))
q("s8_upsert", NOW + " SELECT namespace, key, value FROM cur")(lambda s, d: current(s, d).select("namespace", "key", "value"))
q("s9_delete", NOW + " SELECT namespace, key FROM cur WHERE CAST(key AS INT) % 2 = 1")(lambda s, d: joins.uncovered(current(s, d), current(s, d).where("cast(key as int) % 2 = 0").select("key"), "key").select("namespace", "key"))
q("s10_keys", NOW + " SELECT key FROM cur WHERE namespace = 'ns2'")(lambda s, d: current(s, d).where("namespace = 'ns2'").select("key"))
q("s14_count", NOW + " SELECT namespace, count(*) AS n FROM cur GROUP BY namespace")(lambda s, d: current(s, d).groupBy("namespace").agg(F.count("*").alias("n")))
q("s16_import_new", NOW + ", old AS (SELECT * FROM cur WHERE namespace IN ('ns1', 'ns2')) SELECT count_if(o.key IS NULL) AS migrated, count_if(o.key IS NOT NULL) AS skipped FROM cur c LEFT JOIN old o ON c.namespace = o.namespace AND c.key = o.key")(lambda s, d: (lambda c: c.join(c.where("namespace in ('ns1', 'ns2')").select("namespace", "key", F.lit(True).alias("there")), ["namespace", "key"], "left").agg(F.count_if(F.col("there").isNull()).alias("migrated"), F.count_if("there").alias("skipped")))(current(s, d)))
q("s27_label_stats", "SELECT label, count(*) AS n, max(vec_id) AS newest FROM embeddings GROUP BY label")(lambda s, d: load(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.max("vec_id").alias("newest")))
q("s32_retention", f"{U}, m AS (SELECT max(ts) AS t FROM usage) SELECT id FROM usage, m WHERE ts > t - INTERVAL 10 DAY QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC, id DESC) <= 20")(lambda s, d: ordered.latest(usage(s, d).join(F.broadcast(usage(s, d).agg(F.max("ts").alias("t")))).where(F.col("ts") > F.col("t") - F.expr("INTERVAL 10 DAYS")), ["domain"], [F.desc("ts"), F.desc("id")], 20).select("id"))
