"""Queries of providers that domains share, duplicates, JSON paths, paging and predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import markup as m
from sparkloom.functions import paths as p
from sparkloom.operators import joins
from sparkloom.plans.markup import ROBOTS, documents, text
from sparkloom.plans.registry import query
from sparkloom.tables import USAGE_SQL, load, usage

U = "WITH " + USAGE_SQL
REL_SQL = "rel AS (SELECT l_suppkey AS domain, l_partkey AS provider, max(l_discount) AS confidence FROM lineitem GROUP BY ALL)"


def relations(s, d):
    return load(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("domain"), F.col("l_partkey").alias("provider")).agg(F.max("l_discount").alias("confidence"))


@query("j10_shared_provider", f"WITH {REL_SQL}, p AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier), c AS (SELECT a, b, x.provider, least(x.confidence, y.confidence) AS confidence FROM p JOIN rel x ON x.domain = a JOIN rel y ON y.domain = b AND y.provider = x.provider) SELECT a, b, arg_min(provider, (-confidence, provider)) AS provider, max(confidence) AS confidence FROM c GROUP BY a, b")
def _(s, d):
    """For given pairs of domains, here neighbours by id, the provider that both are surest of."""
    rel = relations(s, d)
    pairs = load(s, d, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    left = pairs.join(rel.withColumnsRenamed({"domain": "a", "confidence": "x"}), "a")
    both = left.join(rel.withColumnsRenamed({"domain": "b", "confidence": "y"}), ["b", "provider"]).withColumn("confidence", F.least("x", "y"))
    return both.groupBy("a", "b").agg(F.min_by("provider", F.struct(-F.col("confidence"), "provider")).alias("provider"), F.max("confidence").alias("confidence"))


@query("j11_domains_of_provider", f"WITH {REL_SQL} SELECT domain, confidence FROM rel WHERE provider = 7 AND confidence >= 0.05")
def _(s, d):
    return relations(s, d).where("provider = 7 and confidence >= 0.05").select("domain", "confidence")


RULES = [("blog", "^http://blog[.]", True), ("mobile", "^http://m[.]", False), ("org", "example[.]org/", True), ("net", "[.]net/", True)]


@query("j7_anti_patterns", "SELECT page_id, array_to_string(list_filter([CASE WHEN regexp_matches(url, '^http://blog[.]') THEN 'blog' END, CASE WHEN regexp_matches(url, '[.]net/') THEN 'net' END, CASE WHEN regexp_matches(url, 'example[.]org/') THEN 'org' END], lambda x: x IS NOT NULL), ',') AS rules FROM pages")
def _(s, d):
    active = sorted((n, r) for n, r, on in RULES if on)
    hits = F.array_compact(F.array(*[F.when(F.col("url").rlike(r), n) for n, r in active]))
    return load(s, d, "pages").select("page_id", F.array_join(hits, ",").alias("rules"))


@query("j12_domain_analytics", U + """, s AS (SELECT domain, CAST(sum(cost_units) AS BIGINT) AS cost, count(*) AS requests, round(avg(duration_ms), 6) AS latency FROM usage GROUP BY domain),
l AS (SELECT domain, 1 AS k FROM (SELECT domain FROM s ORDER BY cost DESC, domain LIMIT 5) UNION ALL SELECT domain, 2 FROM (SELECT domain FROM s ORDER BY requests DESC, domain LIMIT 5) UNION ALL SELECT domain, 3 FROM (SELECT domain FROM s ORDER BY latency DESC, domain LIMIT 5) UNION ALL SELECT domain, 4 FROM (SELECT domain FROM s ORDER BY latency, domain LIMIT 5))
SELECT domain, ['cost', 'requests', 'slow', 'fast'][min(k)] AS found_by, any_value(cost) AS cost, any_value(requests) AS requests, any_value(latency) AS latency FROM l JOIN s USING (domain) GROUP BY domain""")
def _(s, d):
    sums = usage(s, d).groupBy("domain").agg(F.sum("cost_units").alias("cost"), F.count("*").alias("requests"), F.round(F.avg("duration_ms"), 6).alias("latency"))
    lists = (("cost", F.desc("cost")), ("requests", F.desc("requests")), ("slow", F.desc("latency")), ("fast", F.asc("latency")))
    out = None
    for k, (name, order) in enumerate(lists):
        part = sums.orderBy(order, "domain").limit(5).select("*", F.struct(F.lit(k).alias("k"), F.lit(name).alias("name")).alias("by"))
        out = part if out is None else out.unionAll(part)
    return out.groupBy("domain").agg(F.min("by")["name"].alias("found_by"), *[F.first(c).alias(c) for c in ("cost", "requests", "latency")])


@query("j14_pool_use", "SELECT p_partkey, p_size + count(l_orderkey) AS uses, count(DISTINCT l_suppkey) AS users FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY p_partkey, p_size")
def _(s, d):
    members = load(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    used = joins.covered(load(s, d, "lineitem"), members, "l_suppkey").groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("users"))
    return load(s, d, "part").join(used, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", (F.col("p_size") + F.col("n")).alias("uses"), "users")


NEAR_SQL = """WITH g AS (SELECT vec_id, label, [x::DOUBLE for x in embedding] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
c AS (SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)"""


def near(s, d, least):
    """(vec_id, other, score) of the queries, the ids divisible by 50, against all vectors of their label."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = load(s, d, "embeddings").where("label is not null and embedding is not null").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).where(finite & F.exists(v, lambda x: x != 0))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    good = good.withColumn("n", F.sqrt(dot("v", "v")))
    asks = good.where("vec_id % 50 = 0")
    rows = asks.join(good.toDF("other", "label", "w", "k"), "label").where("vec_id <> other")
    return rows.select("vec_id", "other", F.round(dot("v", "w") / (F.col("n") * F.col("k")), 6).alias("score")).where(F.col("score") >= least)


@query("j17_duplicate_check", NEAR_SQL + " SELECT vec_id, max(score) AS score, arg_min(other, (-score, other)) AS other FROM c WHERE score >= 0.95 GROUP BY vec_id")
def _(s, d):
    return near(s, d, 0.95).groupBy("vec_id").agg(F.max("score").alias("score"), F.min_by("other", F.struct(-F.col("score"), "other")).alias("other"))


@query("j18_near_duplicates", NEAR_SQL + " SELECT vec_id, other, score FROM c WHERE score >= 0.35 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) <= 50")
def _(s, d):
    return joins.best_first(near(s, d, 0.35), ["vec_id"], [F.desc("score"), F.asc("other")], 50)


@query("j20_compared_arrays", "WITH a AS (SELECT l_orderkey AS id, list(DISTINCT l_suppkey) FILTER (l_linenumber <= 3) AS x, list(DISTINCT l_suppkey) FILTER (l_linenumber >= 3) AS y FROM lineitem GROUP BY 1) SELECT id, list_sort(list_filter(coalesce(y, []), lambda v: NOT list_contains(coalesce(x, []), v))) AS added, list_sort(list_filter(coalesce(x, []), lambda v: NOT list_contains(coalesce(y, []), v))) AS removed FROM a")
def _(s, d):
    n = F.col("l_linenumber")
    sets = load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.when(n <= 3, F.col("l_suppkey"))).alias("x"), F.collect_set(F.when(n >= 3, F.col("l_suppkey"))).alias("y"))
    return sets.select("id", F.array_sort(F.array_except("y", "x")).alias("added"), F.array_sort(F.array_except("x", "y")).alias("removed"))


@query("j22_capabilities", """WITH o AS (SELECT o_custkey, count(*) AS n, count_if(o_orderstatus = 'F') AS f, max(o_totalprice) AS top FROM orders GROUP BY 1)
SELECT c_custkey, n IS NOT NULL AS learned, coalesce(f, 0) > 3 AS failing, coalesce(top, 0) > 400000 AS costly, CASE WHEN coalesce(n, 0) >= 12 THEN 'high' WHEN coalesce(n, 0) >= 6 THEN 'medium' ELSE 'low' END AS confidence,
  array_to_string(list_filter([CASE WHEN n IS NULL THEN 'browse first' END, CASE WHEN coalesce(f, 0) > 3 THEN 'check errors' END, CASE WHEN coalesce(top, 0) > 400000 THEN 'use cheaper tier' END], lambda x: x IS NOT NULL), '; ') AS advice FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def _(s, d):
    known = load(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.max("o_totalprice").alias("top"))
    rows = load(s, d, "customer").join(known, F.col("c_custkey") == F.col("o_custkey"), "left")
    n, failing, costly = F.coalesce("n", F.lit(0)), F.coalesce("f", F.lit(0)) > 3, F.coalesce("top", F.lit(0.0)) > 400000
    advice = F.array_compact(F.array(F.when(F.col("n").isNull(), "browse first"), F.when(failing, "check errors"), F.when(costly, "use cheaper tier")))
    return rows.select("c_custkey", F.col("n").isNotNull().alias("learned"), failing.alias("failing"), costly.alias("costly"), F.when(n >= 12, "high").when(n >= 6, "medium").otherwise("low").alias("confidence"), F.array_join(advice, "; ").alias("advice"))


@query("u3_robots_rules", "SELECT c_custkey AS id, r.rule, r.path FROM customer, LATERAL (VALUES ('disallow', '/api/' || c_custkey), ('allow', '/docs'), ('allow', '/v' || c_custkey || '/'), ('disallow', '/shop'), ('allow', '/api/' || c_custkey)) r(rule, path)")
def _(s, d):
    return documents(s, d, ROBOTS).select("id", F.explode(F.array_distinct(m.robots_rules(F.col("doc")))).alias("x")).select("id", "x.*")


@query("u7_group_confidence", "SELECT l_suppkey, round(least(1.0, rate * 0.3 + least(1.0, ok / 10) * 0.3 + least(1.0, parts / (n * (n - 1) / 2.0)) * 0.2 + sim * 0.2), 6)::DOUBLE AS confidence FROM (SELECT l_suppkey, count(*) AS n, count_if(l_returnflag <> 'R') AS ok, count_if(l_returnflag <> 'R') / count(*) AS rate, count(DISTINCT l_partkey) AS parts, avg(l_discount * 10) AS sim FROM lineitem GROUP BY 1 HAVING count(*) > 1)")
def _(s, d):
    g = load(s, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("ok"), F.count_distinct("l_partkey").alias("parts"), F.avg(F.col("l_discount") * 10).alias("sim")).where("n > 1")
    one = lambda x: F.least(F.lit(1.0), x)
    score = F.col("ok") / F.col("n") * 0.3 + one(F.col("ok") / 10) * 0.3 + one(F.col("parts") / (F.col("n") * (F.col("n") - 1) / 2)) * 0.2 + F.col("sim") * 0.2
    return g.select("l_suppkey", F.round(one(score), 6).alias("confidence"))


@query("u8_merged_sets", "WITH a AS (SELECT l_suppkey AS g, list(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS x, list(DISTINCT l_partkey) FILTER (l_linenumber = 1) AS y FROM lineitem GROUP BY 1) SELECT g, len(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))) AS merged FROM a")
def _(s, d):
    sets = load(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("g")).agg(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("x"), F.collect_set(F.when(F.col("l_linenumber") == 1, F.col("l_partkey"))).alias("y"))
    return sets.select("g", F.size(F.array_union("x", "y")).cast("long").alias("merged"))


@query("u11_by_domains", "SELECT p_partkey FROM part WHERE lower(p_brand) IN ('brand#3', 'brand#9')")
def _(s, d):
    return load(s, d, "part").where(F.lower("p_brand").isin(*[x.lower() for x in ("Brand#3", "BRAND#9")])).select("p_partkey")


# ---- predictions


@query("d13_observations", U + " SELECT domain, id FROM usage WHERE tool = 'purchase' QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC, id DESC) <= 50")
def _(s, d):
    return joins.best_first(usage(s, d).where("tool = 'purchase'"), ["domain"], [F.desc("ts"), F.desc("id")], 50).select("domain", "id")


@query("d20_calendar_triggers", "SELECT month(o_orderdate)::INTEGER AS month, day(o_orderdate)::INTEGER AS day, count(DISTINCT year(o_orderdate)) AS years, round(least(0.95, 0.5 + count(DISTINCT year(o_orderdate)) * 0.15), 6)::DOUBLE AS confidence, max(year(o_orderdate))::INTEGER AS last FROM orders GROUP BY 1, 2 HAVING count(DISTINCT year(o_orderdate)) >= 2")
def _(s, d):
    at = F.col("o_orderdate")
    days = load(s, d, "orders").groupBy(F.month(at).alias("month"), F.dayofmonth(at).alias("day")).agg(F.count_distinct(F.year(at)).alias("years"), F.max(F.year(at)).alias("last")).where("years >= 2")
    return days.select("month", "day", "years", F.round(F.least(F.lit(0.95), 0.5 + F.col("years") * 0.15), 6).alias("confidence"), "last")


@query("d24_prediction_hits", U + ", g AS (SELECT domain, id, epoch_us(ts) / 3.6e9 AS t, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 3.6e9 AS gap FROM usage WINDOW w AS (PARTITION BY domain ORDER BY ts, id)), m AS (SELECT domain, avg(gap) AS mean FROM g GROUP BY domain) SELECT domain, count_if(abs(gap - mean) <= mean * 0.5) AS hits, count(gap) AS predictions FROM g JOIN m USING (domain) GROUP BY domain")
def _(s, d):
    from sparkloom.operators.ordered import intervals

    gaps = intervals(usage(s, d), ["domain"], "ts", "id")
    gap = F.col("gap")
    mean = gaps.groupBy("domain").agg(F.avg("gap").alias("mean"))
    return gaps.join(mean, "domain").groupBy("domain").agg(F.count_if(F.abs(gap - F.col("mean")) <= F.col("mean") * 0.5).alias("hits"), F.count("gap").alias("predictions"))


# ---- JSON paths

DOC = '{"a": {"b": [{"n": "x{key}", "v": {size}}, {"n": "y"}, {"w": 1}]}, "t": null, "$ref": "#/a", "c": [{"$ref": "#/x"}], "s": "{name}"}'


def objects(s, d):
    return load(s, d, "part").select(F.col("p_partkey").alias("id"), text(DOC, key=F.col("p_partkey"), size=F.col("p_size"), name=F.col("p_name")).alias("doc"))


@query("m32_traverse", "SELECT p_partkey AS id, ['x' || p_partkey, 'y'] AS names, '{\"w\":1}' AS last, p_name AS either FROM part")
def _(s, d):
    doc = F.col("doc")
    return objects(s, d).select("id", p.every(doc, "a.b", "n").alias("names"), p.last(doc, "a.b").alias("last"), p.first_of(doc, ["no.such", "t", "s"]).alias("either"))


@query("m33_fields", "SELECT p_partkey AS id, 'x' || p_partkey AS name, CAST(p_size AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS none FROM part")
def _(s, d):
    return objects(s, d).select("id", *p.fields(F.col("doc"), {"name": ["q", "a.b[0].n"], "value": ["a.b[0].v"], "none": ["a.x", "t"]}))


@query("m34_get", "SELECT p_partkey AS id, 'x' || p_partkey AS found, 'dflt' AS missing, '{\"n\":\"x' || p_partkey || '\",\"v\":' || p_size || '}' AS first FROM part")
def _(s, d):
    return objects(s, d).select("id", p.get(F.col("doc"), "a.b[0].n").alias("found"), p.get(F.col("doc"), "a.zz", "dflt").alias("missing"), p.get(F.col("doc"), "a.b").alias("first"))


@query("m35_set_path", "SELECT p_partkey AS id, '{\"$ref\":\"#/a\",\"a\":' || p_size || ',\"c\":[{\"$ref\":\"#/x\"}],\"s\":\"' || p_name || '\",\"t\":null}' AS doc FROM part")
def _(s, d):
    size = F.get_json_object("doc", "$.a.b[0].v")
    return objects(s, d).select("id", p.with_value(F.col("doc"), "a", size).alias("doc"))


@query("m37_has_path", "SELECT p_partkey AS id, true AS there, false AS gone FROM part")
def _(s, d):
    return objects(s, d).select("id", p.has(F.col("doc"), "a.b[1].n").alias("there"), p.has(F.col("doc"), "a.b[1].v").alias("gone"))


@query("m39_count_refs", "SELECT p_partkey AS id, CAST(2 AS INTEGER) AS refs FROM part")
def _(s, d):
    return objects(s, d).select("id", p.count_refs(F.col("doc")).cast("int").alias("refs"))


# ---- URLs


def urls(s, d):
    k = F.col("p_partkey")
    forms = F.array(F.concat(F.lit("http://s.org/list?x=1&page="), k), F.concat(F.lit("http://s.org/api/items/page/"), k), F.concat(F.lit("http://s.org/v2/find?q=a&offset="), k * 10), F.lit("http://s.org/about"))
    after = F.array(F.concat(F.lit("http://s.org/list?x=1&page="), k + 1), F.concat(F.lit("http://s.org/api/items/page/"), k + 1), F.concat(F.lit("http://s.org/v2/find?q=a&offset="), k * 10 + 10), F.lit("http://s.org/about"))
    at = (k % 4 + 1).cast("int")
    return load(s, d, "part").select(k.alias("id"), F.element_at(forms, at).alias("url"), F.element_at(after, at).alias("after"))


@query("l10_paging_between", "SELECT p_partkey AS id, ['query_param', 'path_segment', 'query_param', 'next_button'][p_partkey % 4 + 1] AS kind, ['page', NULL, 'offset', NULL][p_partkey % 4 + 1] AS name, [p_partkey, p_partkey, p_partkey * 10, NULL][p_partkey % 4 + 1] AS start, [1, 1, 10, NULL][p_partkey % 4 + 1]::BIGINT AS step FROM part")
def _(s, d):
    return urls(s, d).select("id", p.paging_between(F.col("url"), F.col("after")).alias("x")).select("id", "x.*")


@query("l16_paging_parameter", "SELECT p_partkey AS id, ['page', 'path', 'offset', NULL][p_partkey % 4 + 1] AS parameter FROM part")
def _(s, d):
    return urls(s, d).select("id", p.paging_parameter(F.col("url")).alias("parameter"))


@query("l15_next_value", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_partkey + 1 WHEN 2 THEN p_partkey * 10 + 20 END AS next FROM part")
def _(s, d):
    url = F.col("url")
    page, offset = p.parameter(url, "page").try_cast("long"), p.parameter(url, "offset").try_cast("long")
    return urls(s, d).select("id", F.coalesce(page + 1, offset + 20).alias("next"))


@query("l2_url_variables", "SELECT p_partkey AS id, [NULL, p_partkey::VARCHAR, NULL, NULL][p_partkey % 4 + 1] AS number, CASE WHEN p_partkey % 4 = 2 THEN 'a' END AS term, 'S.ORG' AS host FROM part")
def _(s, d):
    from sparkloom.functions.url import host

    url = F.col("url")
    return urls(s, d).select("id", F.nullif(F.regexp_extract(url, "/page/([0-9]+)$", 1), F.lit("")).alias("number"), p.parameter(url, "q").alias("term"), F.upper(host(url)).alias("host"))


@query("l4_url_pattern", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '^http://s\\.org/list$' WHEN 1 THEN '^http://s\\.org/api/items/page/(?<n>[^/]+)$' WHEN 2 THEN '^http://s\\.org/v2/find$' ELSE '^http://s\\.org/about$' END AS pattern FROM part WHERE p_partkey > 9")
def _(s, d):
    return urls(s, d).where("id > 9").select("id", p.url_pattern(F.col("url"), {"n": F.col("id").cast("string")}).alias("pattern"))


@query("m30_paging_candidates", "SELECT p_partkey AS id, [3, 2, 5, 0][p_partkey % 4 + 1] + CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 0 END AS score FROM part")
def _(s, d):
    return urls(s, d).select("id", p.candidate_score(F.col("url"), p.PAGING, 3, F.col("id") % 3 == 0).alias("score"))


@query("m29_search_candidates", "SELECT p_partkey AS id, [0, 2, 6, 0][p_partkey % 4 + 1] + CASE WHEN p_partkey % 3 = 0 THEN 3 ELSE 0 END AS score FROM part")
def _(s, d):
    return urls(s, d).select("id", p.candidate_score(F.col("url"), p.SEARCHING, 4, F.col("id") % 3 == 0).alias("score"))
