"""Queries of reports: executions, patterns, feedback, tracked pages, tenants, and lists of them.

Events stand for executions and for feedback, parts for learned patterns, customers for tenants,
orders for tracked pages and their changes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import reports as r
from sparkloom.plans.registry import query
from sparkloom.tables import USAGE_SQL, load, usage

U = "WITH " + USAGE_SQL
CATEGORIES = ("view", "click", "signup", "purchase", "error", "refund")
STATUSES = ("pending", "processing", "applied", "rejected", "escalated")
FEEDBACK_SQL = """feedback AS (SELECT event_id AS id, 'd' || user_id AS tenant, ts, event_type AS category,
  CASE WHEN value < 10 THEN 'negative' WHEN value < 30 THEN 'neutral' WHEN value IS NOT NULL THEN 'positive' END AS sentiment,
  ['pending', 'processing', 'applied', 'rejected', 'escalated'][event_id % 5 + 1] AS status, value > 80 AS flagged FROM events)"""
PATTERNS_SQL = """patterns AS (SELECT p_partkey AS id, p_name AS name, p_brand AS domain, p_type AS category, p_size AS verified, p_partkey % 7 AS failed,
  CASE WHEN p_size > 35 THEN 'high' WHEN p_size > 15 THEN 'medium' ELSE 'low' END AS level, p_retailprice AS price FROM part)"""


def feedback(s, d):
    sentiment = F.when(F.col("value") < 10, "negative").when(F.col("value") < 30, "neutral").when(F.col("value").isNotNull(), "positive")
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("event_id") % 5 + 1).cast("int"))
    tenant = F.concat(F.lit("d"), F.col("user_id").cast("string"))
    return load(s, d, "events").select(F.col("event_id").alias("id"), tenant.alias("tenant"), "ts", F.col("event_type").alias("category"), sentiment.alias("sentiment"), status.alias("status"), (F.col("value") > 80).alias("flagged"))


def patterns(s, d):
    level = F.when(F.col("p_size") > 35, "high").when(F.col("p_size") > 15, "medium").otherwise("low")
    return load(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("domain"), F.col("p_type").alias("category"), F.col("p_size").alias("verified"), (F.col("p_partkey") % 7).alias("failed"), level.alias("level"), F.col("p_retailprice").alias("price"))


# ---- executions


@query("a19_skill_stats", U + """, c AS (SELECT tool, count(*) AS total, count_if(success) AS successes, count_if(NOT success) AS failures, round(count_if(success) / count(*), 6) AS success_rate,
  round(avg(duration_ms), 6) AS mean, list_sort(list(duration_ms) FILTER (duration_ms IS NOT NULL)) AS l, min(ts) AS first, max(ts) AS last FROM usage GROUP BY tool)
SELECT tool, total, successes, failures, success_rate, mean, l[CAST(floor(len(l) * 0.95) AS BIGINT) + 1] AS p95, first, last FROM c""")
def _(s, d):
    return r.executions(usage(s, d), "tool", F.col("success"), F.col("duration_ms"), "ts")


@query("a19_top_domains", U + ", c AS (SELECT tool, domain, count(*) AS n FROM usage GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY tool ORDER BY n DESC, domain) AS INTEGER) AS place FROM c QUALIFY place <= 5")
def _(s, d):
    return r.ranked(usage(s, d), ["tool"], "domain", 5)


@query("a19_common_overrides", """WITH o AS (SELECT event_type AS tool, unnest(json_keys(props)) AS parameter FROM events)
SELECT tool, parameter, count(*) AS n, CAST(1 AS INTEGER) AS place FROM o GROUP BY ALL""")
def _(s, d):
    rows = load(s, d, "events").select(F.col("event_type").alias("tool"), F.explode(F.json_object_keys("props")).alias("parameter"))
    return r.ranked(rows, ["tool"], "parameter", 10)


HEALTH_SQL = """CASE WHEN s >= 0.95 AND l <= 1000 AND f <= 0.1 THEN 'healthy' WHEN s >= 0.85 AND l <= 3000 AND f <= 0.3 THEN 'degraded' ELSE 'unhealthy' END"""
MEASURED_SQL = U + ", m AS (SELECT domain, round(count_if(success) / count(*), 6) AS s, round(avg(duration_ms) * 40, 6) AS l, round(count_if(tier = 'playwright') / count(*), 6) AS f FROM usage GROUP BY domain)"


def measured(s, d):
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    return usage(s, d).groupBy("domain").agg(rate(F.col("success")).alias("s"), F.round(F.avg("duration_ms") * 40, 6).alias("l"), rate(F.col("tier") == "playwright").alias("f"))


@query("a21_health", MEASURED_SQL + f", h AS (SELECT domain, {HEALTH_SQL} AS health, s, f, l FROM m)" + """ SELECT domain, health, len(list_filter([
  s < 0.95, l > 1000, f > 0.1], lambda x: x)) AS issues,
  CASE WHEN s < 0.85 THEN 'Low success rate: ' WHEN s < 0.95 THEN 'Success rate below optimal: ' WHEN l > 3000 THEN 'High average latency: ' WHEN l > 1000 THEN 'Latency above optimal: '
    WHEN f > 0.3 THEN 'High fallback rate: ' WHEN f > 0.1 THEN 'Fallback rate above optimal: ' END AS first FROM h""")
def _(s, d):
    measures = [F.col(c) for c in "slf"]
    rows = measured(s, d).select("domain", r.health(*measures).alias("health"), r.health_issues(*measures).alias("i"))
    first = F.regexp_extract(F.try_element_at("i", F.lit(1)), "^[^:]*: ", 0)
    return rows.select("domain", "health", F.size("i").cast("long").alias("issues"), first.alias("first"))


WEEKS = ", b AS (SELECT max(ts) AS last FROM usage), w AS (SELECT CASE WHEN ts > last - INTERVAL 7 DAY THEN 1 WHEN ts > last - INTERVAL 14 DAY THEN 0 END AS week, success, duration_ms, cost_units FROM usage, b), g AS (SELECT week, count(*) AS n, sum(cost_units) AS cost, avg(CAST(success AS INT)) AS rate, avg(duration_ms) AS latency FROM w WHERE week IS NOT NULL GROUP BY week)"


@query("a23_trends", U + WEEKS + """ SELECT round((c.n - p.n) / nullif(p.n, 0), 6) AS request_trend, round((c.cost - p.cost) / nullif(p.cost, 0), 6) AS cost_trend,
  round((c.rate - p.rate) / nullif(p.rate, 0), 6) AS success_trend, round((c.latency - p.latency) / nullif(p.latency, 0), 6) AS latency_trend FROM g c, g p WHERE c.week = 1 AND p.week = 0""")
def _(s, d):
    rows = usage(s, d)
    last = F.broadcast(rows.agg(F.max("ts").alias("last")))
    now = F.col("ts") > F.col("last") - F.expr("INTERVAL 7 DAYS")
    rows = rows.join(last).withColumn("week", F.when(now, 1).when(F.col("ts") > F.col("last") - F.expr("INTERVAL 14 DAYS"), 0))
    measures = {"request": F.count("week"), "cost": F.sum("cost_units"), "success": F.avg(F.col("success").cast("int")), "latency": F.avg("duration_ms")}
    weeks = rows.where("week is not null").groupBy().pivot("week", [0, 1]).agg(*[m.alias(k) for k, m in measures.items()])
    change = lambda k: F.round((F.col(f"1_{k}") - F.col(f"0_{k}")) / F.nullif(F.col(f"0_{k}"), F.lit(0)), 6)
    return weeks.select(*[change(k).alias(f"{k}_trend") for k in measures])


@query("a24_time_series", U + """ SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS label, count(*) AS requests, round(avg(CAST(success AS INT)), 6) AS success_rate,
  CAST(sum(cost_units) AS BIGINT) AS cost, round(avg(duration_ms), 6) AS latency, round(count_if(tier = 'playwright') / count(*), 6) AS fallback_rate FROM usage GROUP BY 1""")
def _(s, d):
    rows = usage(s, d).groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm").alias("label"))
    return rows.agg(F.count("*").alias("requests"), F.round(F.avg(F.col("success").cast("int")), 6).alias("success_rate"), F.sum("cost_units").alias("cost"), F.round(F.avg("duration_ms"), 6).alias("latency"), F.round(F.count_if(F.col("tier") == "playwright") / F.count("*"), 6).alias("fallback_rate"))


@query("a25_dashboard", MEASURED_SQL + f", h AS (SELECT domain, {HEALTH_SQL} AS health FROM m)" + """, t AS (SELECT domain, count(*) AS requests, CAST(sum(cost_units) AS BIGINT) AS cost, max(ts) AS last FROM usage GROUP BY domain),
  b AS (SELECT domain, arg_min(tier, (-n, tier)) AS main_tier FROM (SELECT domain, tier, count(*) AS n FROM usage GROUP BY ALL) GROUP BY domain)
SELECT domain, requests, cost, last, health, main_tier, m.s AS success_rate, m.l AS latency, m.f AS fallback_rate FROM t JOIN h USING (domain) JOIN m USING (domain) JOIN b USING (domain)""")
def _(s, d):
    rows = usage(s, d)
    totals = rows.groupBy("domain").agg(F.count("*").alias("requests"), F.sum("cost_units").alias("cost"), F.max("ts").alias("last"))
    main = rows.groupBy("domain", "tier").agg(F.count("*").alias("n")).groupBy("domain").agg(F.min_by("tier", F.struct(-F.col("n"), "tier")).alias("main_tier"))
    state = measured(s, d).select("domain", r.health(F.col("s"), F.col("l"), F.col("f")).alias("health"), F.col("s").alias("success_rate"), F.col("l").alias("latency"), F.col("f").alias("fallback_rate"))
    return totals.join(state, "domain").join(main, "domain")


# ---- feedback


@query("a29_feedback_by_category", f"WITH {FEEDBACK_SQL}, v(category) AS (VALUES " + ", ".join(f"('{c}')" for c in CATEGORIES) + ") SELECT v.category, count(f.id) AS n FROM v LEFT JOIN feedback f ON f.category = v.category GROUP BY v.category")
def _(s, d):
    return r.zero_filled(feedback(s, d), "category", CATEGORIES)


@query("a29_feedback_totals", f"WITH {FEEDBACK_SQL}, b AS (SELECT max(ts) AS last FROM feedback) SELECT tenant, count(*) AS total, count_if(sentiment = 'negative') AS negative, count_if(sentiment = 'positive') AS positive, count_if(flagged) AS anomalies, count_if(status = 'escalated') AS escalations, count_if(status = 'applied') AS applied FROM feedback, b WHERE ts >= last - INTERVAL 24 HOUR GROUP BY tenant")
def _(s, d):
    rows = feedback(s, d)
    recent = rows.join(F.broadcast(rows.agg(F.max("ts").alias("last")))).where(F.col("ts") >= F.col("last") - F.expr("INTERVAL 24 HOURS"))
    n = lambda c: F.count_if(c)
    return recent.groupBy("tenant").agg(F.count("*").alias("total"), n(F.col("sentiment") == "negative").alias("negative"), n(F.col("sentiment") == "positive").alias("positive"), n("flagged").alias("anomalies"), n(F.col("status") == "escalated").alias("escalations"), n(F.col("status") == "applied").alias("applied"))


@query("f10_feedback_page", f"WITH {FEEDBACK_SQL} SELECT id, ts FROM feedback WHERE category = 'error' AND sentiment = 'negative' AND status <> 'rejected' ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 10")
def _(s, d):
    return feedback(s, d).where("category = 'error' and sentiment = 'negative' and status <> 'rejected'").orderBy(F.desc("ts"), F.desc("id")).offset(10).limit(50).select("id", "ts")


@query("t9_anomalies", f"WITH {FEEDBACK_SQL} SELECT tenant, id FROM feedback WHERE flagged QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY ts DESC, id DESC) <= 20")
def _(s, d):
    from sparkloom.operators.ordered import latest

    return latest(feedback(s, d).where("flagged"), ["tenant"], [F.desc("ts"), F.desc("id")], 20).select("tenant", "id")


# ---- pools of patterns


@query("a31_pool_stats", "SELECT count(*) AS lines, count(DISTINCT l_partkey) AS patterns, count(DISTINCT l_suppkey) AS contributors, count(DISTINCT l_orderkey) AS consumers, CAST(sum(l_quantity) AS BIGINT) AS uses FROM lineitem")
def _(s, d):
    return load(s, d, "lineitem").agg(F.count("*").alias("lines"), F.count_distinct("l_partkey").alias("patterns"), F.count_distinct("l_suppkey").alias("contributors"), F.count_distinct("l_orderkey").alias("consumers"), F.sum("l_quantity").cast("long").alias("uses"))


@query("a31_most_used", "SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS uses FROM lineitem GROUP BY 1 ORDER BY uses DESC, l_partkey LIMIT 10")
def _(s, d):
    return load(s, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("uses")).orderBy(F.desc("uses"), "l_partkey").limit(10)


@query("a32_registry_stats", f"WITH {PATTERNS_SQL} SELECT category, count(*) AS patterns, round(avg(verified / 50.0), 6) AS confidence, count_if(verified > 40) AS sure, count_if(failed > 3) AS to_verify, count(DISTINCT domain) AS domains FROM patterns GROUP BY category")
def _(s, d):
    return patterns(s, d).groupBy("category").agg(F.count("*").alias("patterns"), F.round(F.avg(F.col("verified") / 50), 6).alias("confidence"), F.count_if(F.col("verified") > 40).alias("sure"), F.count_if(F.col("failed") > 3).alias("to_verify"), F.count_distinct("domain").alias("domains"))


@query("a35_effectiveness", f"WITH {PATTERNS_SQL} SELECT level, count(*) AS patterns, count_if(verified > 0) AS used, round(coalesce(avg(verified / nullif(verified + failed, 0)), 0), 6) AS success_rate, round(sum(verified) / nullif(count_if(verified > 0), 0), 6) AS mean_verifications FROM patterns GROUP BY level")
def _(s, d):
    return r.effectiveness(patterns(s, d), F.col("level"), F.col("verified"), F.col("failed"))


@query("a38_selector_effectiveness", """WITH s AS (SELECT l_orderkey, count(*) AS chain FROM lineitem GROUP BY 1)
SELECT (SELECT count(*) FROM lineitem) AS selectors, (SELECT count_if(l_quantity > 35) FROM lineitem) AS high_priority, (SELECT round(avg(l_quantity / (l_quantity + l_discount * 100)), 6) FROM lineitem WHERE l_quantity + l_discount > 0) AS success_rate,
  (SELECT count_if(l_discount * 100 > l_quantity) FROM lineitem) AS failing, round(avg(chain), 6) AS chain_length FROM s""")
def _(s, d):
    good, bad = F.col("l_quantity"), F.col("l_discount") * 100
    chains = load(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("chain"), F.count_if(good > 35).alias("high"), F.sum(F.when(good + bad > 0, good / (good + bad))).alias("rates"), F.count_if(good + bad > 0).alias("rated"), F.count_if(bad > good).alias("failing"))
    return chains.agg(F.sum("chain").alias("selectors"), F.sum("high").alias("high_priority"), F.round(F.sum("rates") / F.sum("rated"), 6).alias("success_rate"), F.sum("failing").alias("failing"), F.round(F.avg("chain"), 6).alias("chain_length"))


@query("a39_domain_coverage", f"WITH {PATTERNS_SQL}, g AS (SELECT domain, count_if(verified > 0) AS used, avg(verified / nullif(verified + failed, 0)) AS rate, bool_or(failed = 6) AS crossed FROM patterns GROUP BY domain) SELECT count(*) AS domains, count_if(used > 0) AS with_patterns, count_if(rate > 0.8) AS high_success, round(avg(rate), 6) AS mean_rate, count_if(crossed) AS beneficiaries FROM g")
def _(s, d):
    own = F.when(F.col("verified") + F.col("failed") > 0, F.col("verified") / (F.col("verified") + F.col("failed")))
    domains = patterns(s, d).groupBy("domain").agg(F.count_if(F.col("verified") > 0).alias("used"), F.avg(own).alias("rate"), F.bool_or(F.col("failed") == 6).alias("crossed"))
    return domains.agg(F.count("*").alias("domains"), F.count_if(F.col("used") > 0).alias("with_patterns"), F.count_if(F.col("rate") > 0.8).alias("high_success"), F.round(F.avg("rate"), 6).alias("mean_rate"), F.count_if("crossed").alias("beneficiaries"))


@query("a41_health_score", f"WITH {PATTERNS_SQL}, g AS (SELECT domain, count_if(verified > 10) / count(*) AS hit, avg(verified / nullif(verified + failed, 0)) AS accuracy, count_if(level = 'high') / count(*) AS optimised, count_if(failed = 0) / count(*) AS reuse, count_if(verified > 0) / count(*) AS coverage FROM patterns GROUP BY domain) SELECT domain, CAST(floor(least(100, greatest(0, (hit * 20 + accuracy * 25 + optimised * 20 + reuse * 15 + coverage * 20))) + 0.5) AS BIGINT) AS score FROM g")
def _(s, d):
    own = F.when(F.col("verified") + F.col("failed") > 0, F.col("verified") / (F.col("verified") + F.col("failed")))
    part = lambda c: F.count_if(c) / F.count("*")
    g = patterns(s, d).groupBy("domain").agg(part(F.col("verified") > 10).alias("hit_rate"), F.avg(own).alias("accuracy"), part(F.col("level") == "high").alias("optimised"), part(F.col("failed") == 0).alias("reuse"), part(F.col("verified") > 0).alias("coverage"))
    return g.select("domain", r.health_score({k: F.col(k) for k in r.SCORE_WEIGHTS}).alias("score"))


@query("a42_skill_pool", f"WITH {PATTERNS_SQL} SELECT coalesce(domain, 'unknown') AS domain, count(*) AS skills, round(coalesce(sum(verified) / nullif(sum(verified + failed), 0), 1), 6) AS success_rate FROM patterns GROUP BY 1")
def _(s, d):
    return patterns(s, d).groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(F.count("*").alias("skills"), F.round(r.share(F.sum("verified"), F.sum(F.col("verified") + F.col("failed")), 1.0), 6).alias("success_rate"))


@query("a43_anti_patterns", f"WITH {PATTERNS_SQL}, a AS (SELECT *, CASE WHEN failed % 2 = 0 THEN 'global' ELSE domain END AS place FROM patterns WHERE failed > 2) SELECT place AS domain, count(*) AS n, arg_min(name, (-failed, -price, id)) AS most_common, arg_max(name, id) AS newest FROM a GROUP BY place")
def _(s, d):
    rows = patterns(s, d).where("failed > 2").withColumn("place", F.when(F.col("failed") % 2 == 0, "global").otherwise(F.col("domain")))
    return rows.groupBy(F.col("place").alias("domain")).agg(F.count("*").alias("n"), F.min_by("name", F.struct(-F.col("failed"), -F.col("price"), "id")).alias("most_common"), F.max_by("name", "id").alias("newest"))


@query("a44_learning_progress", f"WITH {PATTERNS_SQL} SELECT id, name, round(verified / (verified + failed), 6) AS success_rate, verified + failed AS uses FROM patterns WHERE verified + failed >= 3 ORDER BY success_rate DESC, uses DESC, id LIMIT 10")
def _(s, d):
    uses = F.col("verified") + F.col("failed")
    return patterns(s, d).where(uses >= 3).select("id", "name", F.round(F.col("verified") / uses, 6).alias("success_rate"), uses.alias("uses")).orderBy(F.desc("success_rate"), F.desc("uses"), "id").limit(10)


@query("a45_uncovered", """WITH v AS (SELECT o_custkey AS domain, count(*) AS visits, count_if(o_orderstatus = 'F') AS failures FROM orders GROUP BY 1), k AS (SELECT DISTINCT c_custkey AS domain FROM customer WHERE c_acctbal > 0)
SELECT v.domain, visits, failures, CASE WHEN failures >= 3 THEN 'high' WHEN visits >= 3 THEN 'medium' ELSE 'low' END AS priority FROM v WHERE domain NOT IN (SELECT domain FROM k) AND (failures >= 3 OR visits >= 2) ORDER BY failures >= 3 DESC, visits >= 3 DESC, visits DESC, domain LIMIT 10""")
def _(s, d):
    visited = load(s, d, "orders").groupBy(F.col("o_custkey").alias("domain")).agg(F.count("*").alias("visits"), F.count_if(F.col("o_orderstatus") == "F").alias("failures"))
    known = load(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("domain"))
    open_ = visited.join(known, "domain", "left_anti").where("failures >= 3 or visits >= 2")
    priority = F.when(F.col("failures") >= 3, "high").when(F.col("visits") >= 3, "medium").otherwise("low")
    return open_.orderBy((F.col("failures") >= 3).desc(), (F.col("visits") >= 3).desc(), F.desc("visits"), "domain").limit(10).withColumn("priority", priority)


@query("a46_engine_stats", "SELECT o_custkey AS domain, count(DISTINCT o_orderkey) AS entries, count(l_linenumber) AS patterns, count_if(l_returnflag = 'R') AS failures, count_if(l_linestatus = 'O') AS validators FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def _(s, d):
    # by order first, so the join meets one row an order
    lines = load(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("l_linenumber").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("f"), F.count_if(F.col("l_linestatus") == "O").alias("v"))
    # an order that stands there twice is one entry, and meets its lines twice
    orders = load(s, d, "orders").groupBy("o_custkey", "o_orderkey").agg(F.count("*").alias("times"))
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    total = lambda c: F.coalesce(F.sum(F.col(c) * F.col("times")), F.lit(0))
    return joined.groupBy(F.col("o_custkey").alias("domain")).agg(F.count("o_orderkey").alias("entries"), total("n").alias("patterns"), total("f").alias("failures"), total("v").alias("validators"))


@query("a47_anti_pattern_stats", f"WITH {PATTERNS_SQL} SELECT category, count(*) AS total, count_if(verified % 10 = 0 OR verified > 25) AS active, count(DISTINCT domain) AS domains FROM patterns WHERE failed > 2 GROUP BY category")
def _(s, d):
    return patterns(s, d).where("failed > 2").groupBy("category").agg(F.count("*").alias("total"), F.count_if((F.col("verified") % 10 == 0) | (F.col("verified") > 25)).alias("active"), F.count_distinct("domain").alias("domains"))


# ---- tracked pages and relationships

TRACKED_SQL = "tracked AS (SELECT o_custkey AS url, o_orderkey AS id, o_orderdate AS seen, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'low' END AS significance, o_orderpriority AS category FROM orders)"


def tracked(s, d):
    grade = F.when(F.col("o_totalprice") > 300000, "high").when(F.col("o_totalprice") > 100000, "medium").otherwise("low")
    return load(s, d, "orders").select(F.col("o_custkey").alias("url"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("seen"), grade.alias("significance"), F.col("o_orderpriority").alias("category"))


@query("a49_change_statistics", f"WITH {TRACKED_SQL} SELECT category, count(*) AS n, count_if(significance = 'high') AS high, count_if(significance = 'medium') AS medium, count_if(significance = 'low') AS low, max(seen) AS latest FROM tracked GROUP BY category")
def _(s, d):
    n = lambda v: F.count_if(F.col("significance") == v).alias(v)
    return tracked(s, d).groupBy("category").agg(F.count("*").alias("n"), n("high"), n("medium"), n("low"), F.max("seen").alias("latest"))


@query("a50_tracker_stats", f"WITH {TRACKED_SQL}, c AS (SELECT url, count(*) AS n FROM tracked GROUP BY url) SELECT (SELECT count(*) FROM customer) AS tracked, count(*) AS changed, CAST(sum(n) AS BIGINT) AS changes FROM c WHERE url IN (SELECT c_custkey FROM customer)")
def _(s, d):
    changes = tracked(s, d).groupBy("url").agg(F.count("*").alias("n"))
    joined = load(s, d, "customer").select(F.col("c_custkey").alias("url")).join(changes, "url", "left")
    return joined.agg(F.count("*").alias("tracked"), F.count("n").alias("changed"), F.sum("n").alias("changes"))


@query("a50_recent_changes", f"WITH {TRACKED_SQL} SELECT url, seen, significance FROM tracked ORDER BY seen DESC, id DESC LIMIT 10")
def _(s, d):
    return tracked(s, d).orderBy(F.desc("seen"), F.desc("id")).limit(10).select("url", "seen", "significance")


@query("a53_relationships", """WITH t AS (SELECT o.o_custkey % 25 AS x, s.s_nationkey AS y, l_returnflag <> 'R' AS ok, CASE WHEN l_linenumber % 3 <> 0 THEN l_discount * 10 END AS sim, l_orderkey * 10 + l_linenumber AS seen
  FROM lineitem JOIN orders o ON l_orderkey = o_orderkey JOIN supplier s ON l_suppkey = s_suppkey),
n AS (SELECT least(x, y) AS a, greatest(x, y) AS b, ok, sim, seen, row_number() OVER (PARTITION BY least(x, y), greatest(x, y) ORDER BY seen) AS n FROM t),
k AS (SELECT *, coalesce(sum(CASE WHEN sim IS NOT NULL AND n > 1 THEN ln((n - 1) / n) END) OVER (PARTITION BY a, b ORDER BY n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS keep FROM n)
SELECT a, b, count(*) AS transfers, count_if(ok) AS successes, round(count_if(ok) / count(*), 6) AS rate, round(sum(coalesce(sim, 0) / n * exp(keep)), 6) AS similarity, max(seen) AS last FROM k GROUP BY a, b""")
def _(s, d):
    rows = load(s, d, "lineitem").join(load(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(load(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select((F.col("o_custkey") % 25).alias("x"), F.col("s_nationkey").alias("y"), "l_returnflag", "l_linenumber", "l_discount", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("last"))
    return r.relationships(rows, "x", "y", F.col("l_returnflag") != "R", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount") * 10), "last")


@query("a55_tier_preferences", U + ", p AS (SELECT domain, arg_min(tier, (-n, tier)) AS preferred, sum(d) / sum(n) AS mean FROM (SELECT domain, tier, count(*) AS n, sum(duration_ms) AS d FROM usage GROUP BY ALL) GROUP BY domain), t(tier) AS (VALUES ('intelligence'), ('lightweight'), ('playwright')) SELECT t.tier, count(p.domain) AS domains, round(coalesce(avg(mean) FILTER (mean > 0), 0), 6) AS response FROM t LEFT JOIN p ON p.preferred = t.tier GROUP BY t.tier")
def _(s, d):
    tiers = usage(s, d).groupBy("domain", "tier").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("d"))
    preferred = tiers.groupBy("domain").agg(F.min_by("tier", F.struct(-F.col("n"), "tier")).alias("preferred"), (F.sum("d") / F.sum("n")).alias("mean"))
    names = s.createDataFrame([(t,) for t in ("intelligence", "lightweight", "playwright")], "tier string")
    joined = F.broadcast(names).join(preferred, F.col("tier") == F.col("preferred"), "left")
    return joined.groupBy("tier").agg(F.count("domain").alias("domains"), F.round(F.coalesce(F.avg(F.when(F.col("mean") > 0, F.col("mean"))), F.lit(0.0)), 6).alias("response"))


@query("a57_cache_stats", "SELECT label, count(*) AS size, round(count_if(vec_id % 3 <> 0) / count(*), 6) AS hit_rate, round(avg(vec_id % 60), 6) AS ttl, min(vec_id) AS oldest, max(vec_id) AS newest FROM embeddings GROUP BY label")
def _(s, d):
    return load(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("size"), F.round(F.count_if(F.col("vec_id") % 3 != 0) / F.count("*"), 6).alias("hit_rate"), F.round(F.avg(F.col("vec_id") % 60), 6).alias("ttl"), F.min("vec_id").alias("oldest"), F.max("vec_id").alias("newest"))


@query("a59_program_stats", "SELECT c_mktsegment AS status, count(*) AS members, count_if(c_acctbal > 0) AS active, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_issues FROM customer GROUP BY 1")
def _(s, d):
    issues = load(s, d, "orders").where("o_orderstatus = 'O'").agg(F.count("*").alias("open_issues"))
    counts = load(s, d, "customer").groupBy(F.col("c_mktsegment").alias("status")).agg(F.count("*").alias("members"), F.count_if(F.col("c_acctbal") > 0).alias("active"))
    return counts.join(F.broadcast(issues))


@query("a63_pagination_stats", f"WITH {PATTERNS_SQL} SELECT domain, count(*) AS patterns, count_if(failed = 0) AS validated, round(sum(price), 4) AS time_saved, CAST(sum(verified) AS BIGINT) AS items FROM patterns GROUP BY domain")
def _(s, d):
    return patterns(s, d).groupBy("domain").agg(F.count("*").alias("patterns"), F.count_if(F.col("failed") == 0).alias("validated"), F.round(F.sum("price"), 4).alias("time_saved"), F.sum("verified").cast("long").alias("items"))


@query("a66_tenants", "SELECT c_custkey, c_mktsegment AS plan, count(o_orderkey) AS requests, coalesce(round(sum(o_totalprice), 2), 0) AS units, max(o_orderdate) AS last FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def _(s, d):
    spent = load(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("requests"), F.round(F.sum("o_totalprice"), 2).alias("units"), F.max("o_orderdate").alias("last"))
    joined = load(s, d, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.col("c_mktsegment").alias("plan"), F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("units", F.lit(0.0)).alias("units"), "last")


@query("a66_errors", U + " SELECT tool, domain, count(*) AS n, max(ts) AS last FROM usage WHERE NOT success GROUP BY tool, domain ORDER BY n DESC, tool, domain LIMIT 20")
def _(s, d):
    return usage(s, d).where("not success").groupBy("tool", "domain").agg(F.count("*").alias("n"), F.max("ts").alias("last")).orderBy(F.desc("n"), "tool", "domain").limit(20)


@query("a66_overview", U + " SELECT count(*) AS requests, count_if(NOT success) AS errors, round(avg(duration_ms), 6) AS latency, count(DISTINCT domain) AS domains, CAST(sum(cost_units) AS BIGINT) AS units FROM usage")
def _(s, d):
    return usage(s, d).agg(F.count("*").alias("requests"), F.count_if(~F.col("success")).alias("errors"), F.round(F.avg("duration_ms"), 6).alias("latency"), F.count_distinct("domain").alias("domains"), F.sum("cost_units").alias("units"))


# ---- filters and lists


@query("f4_tool_events", U + " SELECT id FROM usage WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-09' AND tool IN ('view', 'purchase') AND tier <> 'lightweight' AND domain LIKE 'd1%' AND id % 3 = 0")
def _(s, d):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return usage(s, d).where((F.col("ts") >= at("2024-01-03")) & (F.col("ts") < at("2024-01-09")) & F.col("tool").isin("view", "purchase") & (F.col("tier") != "lightweight") & F.startswith("domain", F.lit("d1")) & (F.col("id") % 3 == 0)).select("id")


@query("f5_executions", U + " SELECT id, ts FROM usage WHERE tool = 'signup' AND domain = 'd7' AND ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-25'")
def _(s, d):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return usage(s, d).where((F.col("tool") == "signup") & (F.col("domain") == "d7") & F.col("ts").between(at("2024-01-02"), at("2024-01-25"))).select("id", "ts")


@query("f9_tracked_urls", f"WITH {TRACKED_SQL} SELECT url, max(seen) AS checked, count(*) AS changes FROM tracked WHERE list_has_any([category, significance], ['1-URGENT', 'high']) GROUP BY url ORDER BY checked DESC, url LIMIT 50 OFFSET 5")
def _(s, d):
    tagged = F.arrays_overlap(F.array("category", "significance"), F.array(F.lit("1-URGENT"), F.lit("high")))
    return tracked(s, d).where(tagged).groupBy("url").agg(F.max("seen").alias("checked"), F.count("*").alias("changes")).orderBy(F.desc("checked"), "url").offset(5).limit(50)


@query("f12_tenant_page", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS total FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 20 OFFSET 20")
def _(s, d):
    rows = load(s, d, "customer").where("c_mktsegment = 'BUILDING'")
    return rows.orderBy("c_custkey").offset(20).limit(20).select("c_custkey", "c_name").join(F.broadcast(rows.agg(F.count("*").alias("total"))))


@query("f13_patterns_of_domain", f"WITH {PATTERNS_SQL} SELECT id, name FROM patterns WHERE domain = 'Brand#7'")
def _(s, d):
    return patterns(s, d).where("domain = 'Brand#7'").select("id", "name")


@query("f14_patterns_of_category", f"WITH {PATTERNS_SQL} SELECT id, name FROM patterns WHERE category = 'ECONOMY'")
def _(s, d):
    return patterns(s, d).where("category = 'ECONOMY'").select("id", "name")


@query("f37_main_request", "SELECT o_orderkey, coalesce(max(l_linestatus) FILTER (l_linenumber = 2), arg_min(l_linestatus, (l_linenumber, l_linestatus))) = 'O' AS passed FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def _(s, d):
    main = F.coalesce(F.max(F.when(F.col("l_linenumber") == 2, F.col("l_linestatus"))), F.min_by("l_linestatus", F.struct("l_linenumber", "l_linestatus")))
    lines = load(s, d, "lineitem").groupBy("l_orderkey").agg((main == "O").alias("passed"))
    return load(s, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "passed")


@query("f39_preconditions", r"""SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://[^/]*example[.](com|org)') THEN 'Domain pattern mismatch' WHEN NOT regexp_matches(url, '/[a-z0-9]+') THEN 'URL pattern mismatch'
  WHEN NOT contains(html, '<article') THEN 'Missing required selectors' WHEN NOT regexp_matches(html, 'lang="?en') THEN 'Language mismatch: expected en' END AS reason FROM pages""")
def _(s, d):
    url, html = F.col("url"), F.col("html")
    checks = [(url.rlike("^https?://[^/]*example[.](com|org)"), "Domain pattern mismatch"), (url.rlike("/[a-z0-9]+"), "URL pattern mismatch"), (F.contains(html, F.lit("<article")), "Missing required selectors"), (html.rlike('lang="?en'), "Language mismatch: expected en")]
    return load(s, d, "pages").select("page_id", r.first_reason(checks).alias("reason"))


@query("f35_content_assertions", "SELECT doc_id, length(coalesce(text, '')) > 0 AND n_chars >= 100 AND n_chars <= 8000 AND contains(lower(text), 'the') AND NOT contains(lower(text), 'lorem') AND regexp_matches(coalesce(lang, ''), '^[a-z]{2}$') AS passed FROM documents")
def _(s, d):
    low = F.lower("text")
    passed = (F.length(F.coalesce("text", F.lit(""))) > 0) & F.col("n_chars").between(100, 8000) & F.contains(low, F.lit("the")) & ~F.contains(low, F.lit("lorem")) & F.coalesce("lang", F.lit("")).rlike("^[a-z]{2}$")
    return load(s, d, "documents").select("doc_id", passed.alias("passed"))


@query("t4_recent_executions", U + " SELECT id, tool FROM usage WHERE tool IN ('purchase', 'signup') ORDER BY ts DESC, id DESC LIMIT 100")
def _(s, d):
    return usage(s, d).where(F.col("tool").isin("purchase", "signup")).orderBy(F.desc("ts"), F.desc("id")).limit(100).select("id", "tool")


@query("t5_change_history", f"WITH {TRACKED_SQL} SELECT id, seen, significance FROM tracked WHERE url = 7 ORDER BY seen DESC, id DESC LIMIT 50")
def _(s, d):
    return tracked(s, d).where("url = 7").orderBy(F.desc("seen"), F.desc("id")).limit(50).select("id", "seen", "significance")


@query("t7_latest_of_each", f"WITH {TRACKED_SQL} SELECT category, id FROM tracked QUALIFY row_number() OVER (PARTITION BY category ORDER BY seen DESC, id DESC) <= 5")
def _(s, d):
    from sparkloom.operators.ordered import latest

    return latest(tracked(s, d), ["category"], [F.desc("seen"), F.desc("id")], 5).select("category", "id")


@query("t8_deliveries", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey = 3 ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC LIMIT 50")
def _(s, d):
    return load(s, d, "lineitem").where("l_suppkey = 3").orderBy(F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber")).limit(50).select("l_orderkey", "l_linenumber")


STATUS_SQL = "CASE WHEN verified < failed THEN 'broken' WHEN verified < 3 * failed THEN 'failing' WHEN verified < 6 * failed THEN 'degraded' ELSE 'healthy' END"


@query("t10_unhealthy", f"WITH {PATTERNS_SQL}, h AS (SELECT id, domain, {STATUS_SQL} AS status FROM patterns) SELECT id, domain, status FROM h WHERE status <> 'healthy' ORDER BY CASE status WHEN 'broken' THEN 3 WHEN 'failing' THEN 2 ELSE 1 END DESC, id LIMIT 1000")
def _(s, d):
    v, f = F.col("verified"), F.col("failed")
    status = F.when(v < f, "broken").when(v < 3 * f, "failing").when(v < 6 * f, "degraded").otherwise("healthy")
    severity = F.when(F.col("status") == "broken", 3).when(F.col("status") == "failing", 2).otherwise(1)
    return patterns(s, d).withColumn("status", status).where("status <> 'healthy'").orderBy(severity.desc(), "id").limit(1000).select("id", "domain", "status")


@query("t11_by_urgency", f"WITH {TRACKED_SQL}, u AS (SELECT url, CASE WHEN count_if(significance = 'high') > 5 THEN 3 WHEN count_if(significance = 'high') > 2 THEN 2 WHEN count(*) > 5 THEN 1 ELSE 0 END AS urgency, max(seen) FILTER (significance = 'high') AS next FROM tracked GROUP BY url) SELECT url, urgency, next FROM u ORDER BY urgency DESC, next ASC NULLS LAST, url LIMIT 100")
def _(s, d):
    high = F.count_if(F.col("significance") == "high")
    urgency = F.when(high > 5, 3).when(high > 2, 2).when(F.count("*") > 5, 1).otherwise(0)
    rows = tracked(s, d).groupBy("url").agg(urgency.alias("urgency"), F.max(F.when(F.col("significance") == "high", F.col("seen"))).alias("next"))
    return rows.orderBy(F.desc("urgency"), F.asc_nulls_last("next"), "url").limit(100)
