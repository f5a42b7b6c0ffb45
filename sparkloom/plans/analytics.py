"""Queries over usage records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import ordered, usage as u
from sparkloom.plans.registry import query
from sparkloom.tables import TIER_COST, USAGE_SQL, load, usage

U = "WITH " + USAGE_SQL
SPAN = U + ", span AS (SELECT max(ts) AS last FROM usage) "
ROUND = "round({}, 6)"


def with_last(rows):
    """The rows with the time of the last of all, one value."""
    return rows.join(F.broadcast(rows.agg(F.max("ts").alias("last"))))


def floor_sql(by: str, value: str, src: str = "usage") -> str:
    pick = lambda q: f"list_sort(list({value}))[CAST(least(floor(count({value}) * {q}), count({value}) - 1) AS BIGINT) + 1]"
    return f"SELECT {by}{', ' if by else ''}{pick(0.5)} AS p50, {pick(0.95)} AS p95, {pick(0.99)} AS p99, min({value}) AS least, max({value}) AS greatest, round(avg({value}), 9) AS mean, count({value}) AS n FROM {src} WHERE {value} IS NOT NULL {'GROUP BY ' + by if by else ''}"


@query("a1_attempt_cost", """SELECT event_id, CAST(CASE WHEN event_type IN ('view','click') THEN 1 WHEN event_type = 'signup' THEN 1 + 5 ELSE 1 + 3 + 25 END AS BIGINT) AS cost FROM events""")
def _(spark, d):
    tiers = F.when(F.col("tier") == "intelligence", F.array(F.lit("intelligence"))).when(F.col("tier") == "lightweight", F.array(F.lit("intelligence"), F.lit("lightweight"))).otherwise(F.array(*map(F.lit, TIER_COST)))
    return usage(spark, d).withColumn("tiers", tiers).select(F.col("id").alias("event_id"), u.attempt_cost("tiers", "tier", TIER_COST).alias("cost"))


TOTALS = "count(*) AS requests, count_if(success) AS successes, CAST(sum(cost_units) AS BIGINT) AS cost, round(avg(duration_ms), 6) AS avg_duration, round(count_if(success) / count(*), 6) AS success_rate, arg_max(tier, (ts, id)) AS latest_tier"


@query("a2_totals_by_domain", f"{U} SELECT domain, {TOTALS} FROM usage GROUP BY domain")
def _(spark, d):
    return u.totals(usage(spark, d), ["domain"])


@query("a2_totals_by_tier", f"{U} SELECT tier, {TOTALS} FROM usage GROUP BY tier")
def _(spark, d):
    return u.totals(usage(spark, d), ["tier"])


@query("a2_totals_all", f"{U} SELECT {TOTALS} FROM usage")
def _(spark, d):
    return u.totals(usage(spark, d))


@query("a3_period_trend", SPAN + """, c AS (SELECT tool, count_if(ts >= last - INTERVAL 15 DAY) AS current, count_if(ts < last - INTERVAL 15 DAY) AS previous,
  avg(duration_ms) FILTER (ts >= last - INTERVAL 15 DAY) AS a, avg(duration_ms) FILTER (ts < last - INTERVAL 15 DAY) AS b FROM usage, span GROUP BY tool)
SELECT tool, current, previous, round((current - previous) / nullif(previous, 0), 6) AS request_change, round((a - b) / nullif(b, 0), 6) AS latency_change FROM c""")
def _(spark, d):
    return u.trend(with_last(usage(spark, d)), "tool", F.col("last") - F.expr("INTERVAL 15 DAYS"))


for unit in ("hour", "day", "week", "month"):
    start = "CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER)" if unit == "week" else f"date_trunc('{unit}', ts)"

    @query(f"a4_usage_by_{unit}", f"{U} SELECT CAST({start} AS TIMESTAMP) AS period, count(*) AS requests, CAST(sum(cost_units) AS BIGINT) AS cost, count_if(NOT success) AS failures FROM usage GROUP BY 1")
    def _(spark, d, unit=unit):
        return u.by_period(usage(spark, d), unit)


@query("a5_cost_breakdown", f"""{U}, s AS (SELECT tier, CAST(sum(cost_units) AS BIGINT) AS cost, min(ts) AS a, max(ts) AS b FROM usage GROUP BY tier),
 t AS (SELECT sum(cost) AS total, (epoch_us(date_trunc('second', max(b))) - epoch_us(date_trunc('second', min(a)))) / 3.6e9 AS hours FROM s)
 SELECT tier, cost, round(cost / total, 6) AS share, round(cost * 720 / hours, 4) AS monthly FROM s, t""")
def _(spark, d):
    return u.share_of_cost(usage(spark, d), "tier")


@query("a6_daily_export", f"{U} SELECT domain, CAST(ts AS DATE) AS day, tier, count(*) AS requests, CAST(sum(cost_units) AS BIGINT) AS units, CAST(grouping(domain) * 4 + grouping(CAST(ts AS DATE)) * 2 + grouping(tier) AS BIGINT) AS level FROM usage GROUP BY ROLLUP (domain, CAST(ts AS DATE), tier)")
def _(spark, d):
    rows = usage(spark, d).withColumn("day", F.to_date("ts"))
    return rows.rollup("domain", "day", "tier").agg(F.count("*").alias("requests"), F.sum("cost_units").alias("units"), F.grouping_id().alias("level"))


@query("a7_usage_range", f"{U} SELECT CAST(ts AS DATE) AS day, count(*) AS requests, CAST(sum(cost_units) AS BIGINT) AS units FROM usage WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1 ORDER BY 1")
def _(spark, d):
    rows = usage(spark, d).where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")))
    return rows.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("requests"), F.sum("cost_units").alias("units")).orderBy("day")


@query("a8_can_afford", f"{U} SELECT domain, CAST(sum(cost_units) AS BIGINT) AS used, sum(cost_units) + 25 <= 120 AS can_afford FROM usage GROUP BY domain")
def _(spark, d):
    return usage(spark, d).groupBy("domain").agg(F.sum("cost_units").alias("used")).withColumn("can_afford", F.col("used") + 25 <= 120)


@query("a9_percentiles_by_tool", f"{U} {floor_sql('tool', 'duration_ms')}")
def _(spark, d):
    return u.few_groups_percentiles(usage(spark, d), ["tool"], "duration_ms")


@query("a10_domain_performance", f"{U}, p AS ({floor_sql('domain', 'duration_ms')}), m AS (SELECT domain, round(count_if(success) / count(*), 6) AS success_rate FROM usage GROUP BY domain), k AS (SELECT domain, tier, count(*) AS c FROM usage WHERE success GROUP BY domain, tier), b AS (SELECT domain, arg_max(tier, (c, tier)) AS modal_tier FROM k GROUP BY domain) SELECT p.*, m.success_rate, b.modal_tier FROM p JOIN m USING (domain) LEFT JOIN b USING (domain)")
def _(spark, d):
    rows = usage(spark, d)
    rate = rows.groupBy("domain").agg(F.round(u.ratio(F.count_if("success"), F.count("*")), 6).alias("success_rate"))
    modal = rows.where("success").groupBy("domain", "tier").agg(F.count("*").alias("c")).groupBy("domain").agg(F.max_by("tier", F.struct("c", "tier")).alias("modal_tier"))
    return u.floor_percentiles(rows, ["domain"], "duration_ms").join(rate, "domain").join(modal, "domain", "left")


@query("a10_percentiles_by_domain_tier", f"{U} {floor_sql('domain, tier', 'duration_ms')}")
def _(spark, d):
    return u.floor_percentiles(usage(spark, d), ["domain", "tier"], "duration_ms")


for side, order in (("slowest", "DESC"), ("fastest", "ASC")):

    @query(f"a11_{side}_domains", f"{U} SELECT domain, round(avg(duration_ms), 3) AS mean FROM usage GROUP BY domain ORDER BY mean {order}, domain LIMIT 5")
    def _(spark, d, order=order):
        return u.top(usage(spark, d), "domain", F.round(F.avg("duration_ms"), 3), "mean", 5, order == "DESC")


@query("a12_component_percentiles", f"""{U}, c AS (SELECT unnest([{{'component': 'cost', 'v': CAST(cost_units AS DOUBLE)}}, {{'component': 'total', 'v': duration_ms}}], recursive := true) FROM usage) {floor_sql('component', 'v', 'c')}""")
def _(spark, d):
    rows = usage(spark, d).select(F.col("cost_units").cast("double").alias("cost"), F.col("duration_ms").alias("total")).unpivot([], ["cost", "total"], "component", "v")
    return u.few_groups_percentiles(rows, ["component"], "v")


@query("a13_log_percentiles", f"{U} SELECT tool, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95, quantile_disc(duration_ms, 0.99) AS p99, count(duration_ms) AS n FROM usage GROUP BY tool")
def _(spark, d):
    return u.nearest_rank(usage(spark, d), ["tool"], "duration_ms")


@query("a13_top_paths", f"{U} SELECT domain, count(*) AS n FROM usage GROUP BY domain ORDER BY n DESC, domain LIMIT 10")
def _(spark, d):
    return u.top(usage(spark, d), "domain", F.count("*"), "n", 10)


@query("a14_counters", f"{U} SELECT tool, tier, success, count(*) AS n FROM usage GROUP BY ALL")
def _(spark, d):
    return usage(spark, d).groupBy("tool", "tier", "success").agg(F.count("*").alias("n"))


@query("a15_gauges", f"{U} SELECT tool, arg_max(duration_ms, (ts, id)) AS value FROM usage GROUP BY tool")
def _(spark, d):
    return usage(spark, d).groupBy("tool").agg(F.max_by("duration_ms", F.struct("ts", "id")).alias("value"))


@query("a16_histogram", f"{U} SELECT tool, count_if(duration_ms <= 10) AS le_10, count_if(duration_ms <= 50) AS le_50, count_if(duration_ms <= 100) AS le_100, count_if(duration_ms <= 500) AS le_500, round(sum(duration_ms), 4) AS sum, count(duration_ms) AS count FROM usage GROUP BY tool")
def _(spark, d):
    return u.histogram(usage(spark, d), "duration_ms", [10, 50, 100, 500], ["tool"])


@query("a17_tools_zero_filled", f"{U} SELECT t.tool, count(u.id) AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('scroll')) t(tool) LEFT JOIN usage u USING (tool) GROUP BY t.tool")
def _(spark, d):
    return u.zero_filled(usage(spark, d), "tool", ["click", "error", "purchase", "signup", "view", "scroll"])


@query("a18_confusion", f"{U}, s AS (SELECT domain, count(*) AS calls, count(DISTINCT tool) AS tools, count_if(NOT success) AS failures FROM usage GROUP BY domain) SELECT domain, calls, tools, failures, round(least(failures / calls * 40, 40) + least(tools / 5 * 30, 30) + CASE WHEN failures >= 2 THEN 30 ELSE 0 END, 6) AS score FROM s")
def _(spark, d):
    s = usage(spark, d).groupBy("domain").agg(F.count("*").alias("calls"), F.count_distinct("tool").alias("tools"), F.count_if(~F.col("success")).alias("failures"))
    score = F.least(F.col("failures") / F.col("calls") * 40, F.lit(40.0)) + F.least(F.col("tools") / 5 * 30, F.lit(30.0)) + F.when(F.col("failures") >= 2, 30).otherwise(0)
    return s.withColumn("score", F.round(score, 6))


@query("a20_highest_success", f"{U} SELECT domain, count(*) AS n, round(count_if(success) / count(*), 6) AS rate FROM usage GROUP BY domain HAVING count(*) >= 5 ORDER BY rate DESC, n DESC, domain LIMIT 10")
def _(spark, d):
    s = usage(spark, d).groupBy("domain").agg(F.count("*").alias("n"), F.round(u.ratio(F.count_if("success"), F.count("*")), 6).alias("rate"))
    return s.where("n >= 5").orderBy(F.desc("rate"), F.desc("n"), "domain").limit(10)


@query("a20_needs_attention", f"{U} SELECT domain, count(*) AS n, round(count_if(success) / count(*), 6) AS rate FROM usage GROUP BY domain HAVING count(*) >= 5 AND count_if(success) / count(*) < 0.7")
def _(spark, d):
    s = usage(spark, d).groupBy("domain").agg(F.count("*").alias("n"), u.ratio(F.count_if("success"), F.count("*")).alias("rate"))
    return s.where("n >= 5 and rate < 0.7").withColumn("rate", F.round("rate", 6))


@query("a22_tier_analytics", f"{U}, s AS (SELECT tier, count(*) AS n, CAST(sum(cost_units) AS BIGINT) AS cost, round(avg(duration_ms), 6) AS mean FROM usage GROUP BY tier) SELECT tier, n, cost, mean, round(cost / coalesce(nullif(sum(cost) OVER (), 0), 1), 6) AS cost_share FROM s")
def _(spark, d):
    s = usage(spark, d).groupBy("tier").agg(F.count("*").alias("n"), F.sum("cost_units").alias("cost"), F.round(F.avg("duration_ms"), 6).alias("mean"))
    total = F.coalesce(F.nullif(F.sum("cost").over(Window.partitionBy()), F.lit(0)), F.lit(1))
    return s.withColumn("cost_share", F.round(F.col("cost") / total, 6))


@query("a26_ratings", "SELECT l_partkey AS pattern, round(avg(l_quantity), 6) AS rating, count(*) AS ratings FROM lineitem GROUP BY l_partkey")
def _(spark, d):
    return load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("pattern")).agg(F.round(F.avg("l_quantity"), 6).alias("rating"), F.count("*").alias("ratings"))


@query("a27_rating_histogram", "SELECT l_partkey AS pattern, count_if(l_linenumber = 1) AS r1, count_if(l_linenumber = 2) AS r2, count_if(l_linenumber = 3) AS r3, count_if(l_linenumber = 4) AS r4, count_if(l_linenumber >= 5) AS r5 FROM lineitem GROUP BY 1")
def _(spark, d):
    r = F.col("l_linenumber")
    return load(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("pattern")).agg(*[F.count_if(r == k).alias(f"r{k}") for k in range(1, 5)], F.count_if(r >= 5).alias("r5"))


@query("a28_marketplace", "SELECT p_brand, count(*) AS patterns, count(DISTINCT p_type) AS authors, round(sum(p_retailprice * p_size) / sum(p_size), 4) AS weighted FROM part GROUP BY p_brand")
def _(spark, d):
    return load(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("patterns"), F.count_distinct("p_type").alias("authors"), F.round(F.sum(F.col("p_retailprice") * F.col("p_size")) / F.sum("p_size"), 4).alias("weighted"))


@query("a30_deliveries", f"{U}, s AS (SELECT domain, count(DISTINCT tool) AS k, count(*) AS n FROM usage GROUP BY domain) SELECT CAST(sum(k) AS BIGINT) AS distinct_events, CAST(sum(n) AS BIGINT) AS deliveries FROM s")
def _(spark, d):
    s = usage(spark, d).groupBy("domain").agg(F.count_distinct("tool").alias("k"), F.count("*").alias("n"))
    return s.agg(F.sum("k").alias("distinct_events"), F.sum("n").alias("deliveries"))


HEALTH_SQL = "CASE WHEN run >= 6 THEN 'broken' WHEN n < 5 THEN 'unknown' WHEN run >= 3 OR rate < 0.5 THEN 'failing' WHEN rate < 0.7 THEN 'degraded' ELSE 'healthy' END"
RUNS_SQL = f"""{U}, r AS (SELECT *, sum(CAST(success AS INT)) OVER (PARTITION BY domain ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS run FROM usage),
runs AS (SELECT domain, min(ts) AS start, max(ts) AS "end", count(*) AS length FROM r WHERE NOT success GROUP BY domain, run)"""


@query("a33_health_counts", RUNS_SQL + f", m AS (SELECT domain, max(length) AS run FROM runs GROUP BY domain), s AS (SELECT domain, count(*) AS n, count_if(success) / count(*) AS rate FROM usage GROUP BY domain), h AS (SELECT {HEALTH_SQL} AS health FROM (SELECT domain, n, rate, coalesce(run, 0) AS run FROM s LEFT JOIN m USING (domain))) SELECT health, count(*) AS domains FROM h GROUP BY health")
def _(spark, d):
    rows = usage(spark, d)
    run = ordered.failure_runs(rows, ["domain"], "ts", "id", "success").groupBy("domain").agg(F.max("length").alias("run"))
    s = rows.groupBy("domain").agg(F.count("*").alias("n"), u.ratio(F.count_if("success"), F.count("*")).alias("rate")).join(run, "domain", "left")
    return s.groupBy(u.health(F.col("rate"), F.col("n"), F.coalesce("run", F.lit(0))).alias("health")).agg(F.count("*").alias("domains"))


@query("a34_verified_rate", f"{U}, s AS (SELECT domain, count(*) AS v, count_if(NOT success) AS f FROM usage GROUP BY domain) SELECT domain, round(CASE WHEN v = 0 THEN 1 ELSE greatest(0, least(1, (v - f) / v)) END, 6) AS rate FROM s")
def _(spark, d):
    s = usage(spark, d).groupBy("domain").agg(F.count("*").alias("v"), F.count_if(~F.col("success")).alias("f"))
    return s.select("domain", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), u.ratio(F.col("v") - F.col("f"), F.col("v"), 1.0))), 6).alias("rate"))


@query("a36_confidence_accuracy", f"{U}, s AS (SELECT tier, CASE tier WHEN 'intelligence' THEN 0.9 WHEN 'lightweight' THEN 0.7 ELSE 0.5 END AS predicted, avg(CAST(success AS INT)) AS actual FROM usage GROUP BY tier) SELECT tier, CAST(predicted AS DOUBLE) AS predicted, round(actual, 6) AS actual, round(abs(predicted - actual), 6) AS gap, actual - predicted > 0.2 AS under, predicted - actual > 0.2 AS over FROM s")
def _(spark, d):
    predicted = F.when(F.col("tier") == "intelligence", 0.9).when(F.col("tier") == "lightweight", 0.7).otherwise(0.5)
    s = usage(spark, d).groupBy("tier").agg(F.avg(F.col("success").cast("int")).alias("a")).withColumn("predicted", predicted)
    gap = F.col("a") - F.col("predicted")
    return s.select("tier", "predicted", F.round("a", 6).alias("actual"), F.round(F.abs(gap), 6).alias("gap"), (gap > 0.2).alias("under"), (-gap > 0.2).alias("over"))


@query("a37_tier_savings", f"{U} SELECT round(sum(3000 - CASE tier WHEN 'intelligence' THEN 100 WHEN 'lightweight' THEN 300 ELSE 3000 END), 0) AS saved_ms, count(*) AS n FROM usage")
def _(spark, d):
    took = F.when(F.col("tier") == "intelligence", 100).when(F.col("tier") == "lightweight", 300).otherwise(3000)
    return usage(spark, d).agg(F.round(F.sum(3000 - took).cast("double"), 0).alias("saved_ms"), F.count("*").alias("n"))


@query("a40_learning_trend", SPAN + "SELECT tool, count(*) AS n, round(count(*) / 168.0, 6) AS per_hour FROM usage, span WHERE ts > last - INTERVAL 7 DAY GROUP BY tool")
def _(spark, d):
    recent = with_last(usage(spark, d)).where(F.col("ts") > F.col("last") - F.expr("INTERVAL 7 DAYS"))
    return recent.groupBy("tool").agg(F.count("*").alias("n"), F.round(F.count("*") / 168.0, 6).alias("per_hour"))


@query("a48_failure_patterns", SPAN + "SELECT domain, arg_max(tool, (ts, id)) AS last_tool, count(*) AS failures, count_if(ts > last - INTERVAL 1 HOUR) AS recent, count_if(ts > last - INTERVAL 1 HOUR) >= 3 AS back_off FROM usage, span WHERE NOT success GROUP BY domain")
def _(spark, d):
    late = F.count_if(F.col("ts") > F.col("last") - F.expr("INTERVAL 1 HOUR"))
    return with_last(usage(spark, d)).where(~F.col("success")).groupBy("domain").agg(F.max_by("tool", F.struct("ts", "id")).alias("last_tool"), F.count("*").alias("failures"), late.alias("recent"), (late >= 3).alias("back_off"))


@query("a51_group_sizes", "WITH g AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS groups, max(n) AS largest, round(avg(n), 6) AS mean FROM g")
def _(spark, d):
    g = load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n"))
    return g.agg(F.count("*").alias("groups"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean"))


@query("a52_domain_groups", f"{U} SELECT tool AS provider, count(DISTINCT domain) AS domains, round(avg(duration_ms), 6) AS confidence, max(ts) AS last_seen FROM usage GROUP BY tool")
def _(spark, d):
    return usage(spark, d).groupBy(F.col("tool").alias("provider")).agg(F.count_distinct("domain").alias("domains"), F.round(F.avg("duration_ms"), 6).alias("confidence"), F.max("ts").alias("last_seen"))


@query("a54_proxy_stats", f"{U} SELECT tier, count(*) AS proxies, count_if(success) AS healthy, round(avg(duration_ms) FILTER (duration_ms > 0), 6) AS latency FROM usage GROUP BY tier")
def _(spark, d):
    return usage(spark, d).groupBy("tier").agg(F.count("*").alias("proxies"), F.count_if("success").alias("healthy"), F.round(F.avg(F.when(F.col("duration_ms") > 0, F.col("duration_ms"))), 6).alias("latency"))


@query("a56_latest_by_tier", f"{U}, r AS (SELECT tier, success, ts FROM usage ORDER BY ts DESC, id DESC LIMIT 100) SELECT tier, count(*) AS n, count_if(success) AS ok, min(ts) AS first, max(ts) AS last FROM r GROUP BY tier")
def _(spark, d):
    r = usage(spark, d).orderBy(F.desc("ts"), F.desc("id")).limit(100)
    return r.groupBy("tier").agg(F.count("*").alias("n"), F.count_if("success").alias("ok"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("a58_volatility", f"{U}, s AS (SELECT domain, count(*) AS checks, count_if(tool = 'purchase') / count(*) AS rate FROM usage GROUP BY domain HAVING count(*) >= 2) SELECT domain, checks, round(rate, 6) AS change_rate FROM s ORDER BY round(rate, 6) DESC, domain LIMIT 5")
def _(spark, d):
    s = usage(spark, d).groupBy("domain").agg(F.count("*").alias("checks"), F.round(u.ratio(F.count_if(F.col("tool") == "purchase"), F.count("*")), 6).alias("change_rate"))
    return s.where("checks >= 2").orderBy(F.desc("change_rate"), "domain").limit(5)


@query("a60_similarity_buckets", "WITH s AS (SELECT l_discount * 10 AS v FROM lineitem) SELECT CASE WHEN v < 0.2 THEN '0.0-0.2' WHEN v < 0.4 THEN '0.2-0.4' WHEN v < 0.6 THEN '0.4-0.6' WHEN v < 0.8 THEN '0.6-0.8' WHEN v < 0.9 THEN '0.8-0.9' ELSE '0.9-1.0' END AS bucket, count(*) AS n FROM s GROUP BY 1")
def _(spark, d):
    v = F.col("l_discount") * 10
    bucket = F.when(v < 0.2, "0.0-0.2").when(v < 0.4, "0.2-0.4").when(v < 0.6, "0.4-0.6").when(v < 0.8, "0.6-0.8").when(v < 0.9, "0.8-0.9").otherwise("0.9-1.0")
    return load(spark, d, "lineitem").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("a61_active_tenants", SPAN + ", t AS (SELECT domain, max(ts) AS seen, count_if(tool = 'purchase') > 0 AS sharing FROM usage GROUP BY domain) SELECT count_if(seen > last - INTERVAL 7 DAY) AS active, count_if(sharing) AS sharing, count(*) AS tenants FROM t, span")
def _(spark, d):
    rows = usage(spark, d)
    t = rows.groupBy("domain").agg(F.max("ts").alias("seen"), (F.count_if(F.col("tool") == "purchase") > 0).alias("sharing"))
    t = t.join(F.broadcast(t.agg(F.max("seen").alias("last"))))
    return t.agg(F.count_if(F.col("seen") > F.col("last") - F.expr("INTERVAL 7 DAYS")).alias("active"), F.count_if("sharing").alias("sharing"), F.count("*").alias("tenants"))


@query("a64_accuracy", f"{U} SELECT tool, round(count_if(success) / count(*), 6) AS rate, round(avg(abs(duration_ms - 50)), 6) AS error FROM usage GROUP BY tool")
def _(spark, d):
    return usage(spark, d).groupBy("tool").agg(F.round(u.ratio(F.count_if("success"), F.count("*")), 6).alias("rate"), F.round(F.avg(F.abs(F.col("duration_ms") - 50)), 6).alias("error"))


@query("a65_confidence", "SELECT l_orderkey, round(exp(sum(l_quantity * ln(greatest(l_discount, 0.001))) / sum(l_quantity)), 6) AS confidence, arg_min(l_linenumber, (l_discount, l_linenumber)) AS limiting FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    w, s = F.col("l_quantity"), F.greatest(F.col("l_discount"), F.lit(0.001))
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.exp(F.sum(w * F.ln(s)) / F.sum(w)), 6).alias("confidence"), F.min_by("l_linenumber", F.struct("l_discount", "l_linenumber")).alias("limiting"))


@query("w1_interval_stats", f"{U}, g AS (SELECT domain, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY domain ORDER BY ts, id)) / 3.6e9 AS gap FROM usage) SELECT domain, round(avg(gap), 6) AS avg_h, round(min(gap), 6) AS min_h, round(max(gap), 6) AS max_h, round(stddev_pop(gap), 6) AS std_h, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY domain")
def _(spark, d):
    return ordered.interval_stats(usage(spark, d), ["domain"], "ts", "id")


@query("w2_first_of_session", f"{U} SELECT id, domain, tool FROM usage QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts, id) = 1")
def _(spark, d):
    return ordered.latest(usage(spark, d), ["domain"], [F.asc("ts"), F.asc("id")], 1).select("id", "domain", "tool")


@query("w3_message_patterns", f"{U}, g AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY tool ORDER BY ts, id)) / 1e6 AS gap FROM usage) SELECT tool, count(*) AS frequency, arg_min(id, (ts, id)) AS first_id, round(avg(gap), 4) AS mean_gap FROM g GROUP BY tool")
def _(spark, d):
    g = ordered.intervals(usage(spark, d), ["tool"], "ts", "id")
    return g.groupBy("tool").agg(F.count("*").alias("frequency"), F.min_by("id", F.struct("ts", "id")).alias("first_id"), F.round(F.avg("gap"), 4).alias("mean_gap"))


@query("w4_retention", f"{U} SELECT id, domain FROM usage QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC, id DESC) <= 5")
def _(spark, d):
    return ordered.latest(usage(spark, d), ["domain"], [F.desc("ts"), F.desc("id")], 5).select("id", "domain")


@query("w5_recent_health", f"{U} SELECT id, round(avg(CAST(success AS INT)) OVER (PARTITION BY domain ORDER BY ts, id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS rate FROM usage")
def _(spark, d):
    rows = usage(spark, d).withColumn("ok", F.col("success").cast("int"))
    return ordered.running(rows, ["domain"], "ts", "id", "ok", 100).select("id", F.col("run_mean").alias("rate"))


@query("w6_failure_runs", RUNS_SQL + "SELECT domain, start, \"end\", length FROM runs WHERE length >= 3")
def _(spark, d):
    return ordered.failure_runs(usage(spark, d), ["domain"], "ts", "id", "success").where("length >= 3")


@query("w8_running_mean", f"{U} SELECT id, round(avg(duration_ms) OVER w, 9) AS run_mean, min(duration_ms) OVER w AS run_min, max(duration_ms) OVER w AS run_max FROM usage WINDOW w AS (PARTITION BY domain ORDER BY ts, id ROWS UNBOUNDED PRECEDING)")
def _(spark, d):
    return ordered.running(usage(spark, d), ["domain"], "ts", "id", "duration_ms").select("id", "run_mean", "run_min", "run_max")


@query("w11_confidence_growth", f"{U} SELECT domain, count(*) AS n, round(1 - 0.4 * pow(0.9, count(*) - 1), 6) AS confidence FROM usage GROUP BY domain")
def _(spark, d):
    return usage(spark, d).groupBy("domain").agg(F.count("*").alias("n"), F.round(1 - 0.4 * F.pow(F.lit(0.9), F.count("*") - 1), 6).alias("confidence"))


@query("w12_hourly_pattern", f"{U}, g AS (SELECT domain, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY domain ORDER BY ts, id)) / 3.6e9 AS gap FROM usage), m AS (SELECT domain, gap, avg(gap) OVER (PARTITION BY domain) AS mean FROM g WHERE gap IS NOT NULL) SELECT domain, round(any_value(mean), 6) AS mean_h, round(count_if(abs(gap - mean) <= 0.2 * mean) / count(*), 6) AS share, any_value(mean) BETWEEN 0.5 AND 12 AS hourly FROM m GROUP BY domain")
def _(spark, d):
    g = ordered.intervals(usage(spark, d), ["domain"], "ts", "id").where("gap is not null").withColumn("gap", F.col("gap") / 3600)
    m = g.withColumn("mean", F.avg("gap").over(Window.partitionBy("domain")))
    return m.groupBy("domain").agg(F.round(F.max("mean"), 6).alias("mean_h"), F.round(F.count_if(F.abs(F.col("gap") - F.col("mean")) <= 0.2 * F.col("mean")) / F.count("*"), 6).alias("share"), F.max("mean").between(0.5, 12).alias("hourly"))


@query("w13_last_ten", f"{U}, r AS (SELECT domain, success FROM usage QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC, id DESC) <= 10) SELECT domain, round(avg(CAST(success AS INT)), 6) AS accuracy FROM r GROUP BY domain")
def _(spark, d):
    r = ordered.latest(usage(spark, d), ["domain"], [F.desc("ts"), F.desc("id")], 10)
    return r.groupBy("domain").agg(F.round(F.avg(F.col("success").cast("int")), 6).alias("accuracy"))


@query("w14_best_version", f"{U}, s AS (SELECT domain, tool, avg(CAST(success AS INT)) AS rate, min(id) AS seq FROM usage GROUP BY domain, tool) SELECT domain, arg_max(tool, (rate, -seq)) AS best FROM s GROUP BY domain")
def _(spark, d):
    s = usage(spark, d).groupBy("domain", "tool").agg(F.avg(F.col("success").cast("int")).alias("rate"), F.min("id").alias("seq"))
    return s.groupBy("domain").agg(F.max_by("tool", F.struct("rate", -F.col("seq"))).alias("best"))


@query("w15_rollback", f"{U}, s AS (SELECT domain, tool, avg(CAST(success AS INT)) AS rate, count(*) AS uses FROM usage GROUP BY domain, tool), w AS (SELECT *, max(rate) OVER (PARTITION BY domain) AS best, count(*) OVER (PARTITION BY domain) AS versions FROM s) SELECT domain, tool, round(best - rate, 6) AS loss FROM w WHERE best - rate > 0.2 AND uses >= 2 AND versions >= 2")
def _(spark, d):
    s = usage(spark, d).groupBy("domain", "tool").agg(F.avg(F.col("success").cast("int")).alias("rate"), F.count("*").alias("uses"))
    w = Window.partitionBy("domain")
    s = s.withColumn("best", F.max("rate").over(w)).withColumn("versions", F.count("*").over(w))
    return s.where("best - rate > 0.2 and uses >= 2 and versions >= 2").select("domain", "tool", F.round(F.col("best") - F.col("rate"), 6).alias("loss"))


@query("z4_trailing_hour", f"{U} SELECT id, count(*) OVER w AS n, count_if(NOT success) OVER w AS negatives FROM usage WINDOW w AS (PARTITION BY domain ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)")
def _(spark, d):
    return ordered.trailing(usage(spark, d), ["domain"], "ts", 3600, {"n": F.count("*"), "negatives": F.count_if(~F.col("success"))}).select("id", "n", "negatives")


@query("z6_cooldown", RUNS_SQL + "SELECT domain, start, length, CAST(CASE WHEN length <= 0 THEN 0 ELSE least(86400.0, 60.0 * pow(2.0, length - 1)) END AS DOUBLE) AS wait_s FROM runs")
def _(spark, d):
    runs = ordered.failure_runs(usage(spark, d), ["domain"], "ts", "id", "success")
    return runs.select("domain", "start", "length", ordered.cooldown(F.col("length"), 60, 86400).alias("wait_s"))


@query("z8_evict_least_recent", f"{U}, s AS (SELECT domain, max(ts) AS seen FROM usage GROUP BY domain), r AS (SELECT domain, row_number() OVER (ORDER BY seen, domain) AS k, count(*) OVER () AS n FROM s) SELECT domain FROM r WHERE k <= floor(n * 0.1)")
def _(spark, d):
    s = usage(spark, d).groupBy("domain").agg(F.max("ts").alias("seen"))
    # the place among all without one task for all: counts by day, then places within the day that holds the cut
    days = s.groupBy(F.to_date("seen").alias("day")).agg(F.count("*").alias("n"))
    upto = days.withColumn("before", F.sum("n").over(Window.orderBy("day")) - F.col("n")).withColumn("most", F.floor(F.sum("n").over(Window.partitionBy()) * 0.1))
    placed = s.withColumn("day", F.to_date("seen")).join(upto.where("before < most"), "day")
    place = F.col("before") + F.row_number().over(Window.partitionBy("day").orderBy("seen", "domain"))
    return placed.withColumn("place", place).where("place <= most").select("domain")
