"""Queries of rules over parts, orders, events, documents and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import rules as r
from sparkloom.operators import change
from sparkloom.plans.registry import query
from sparkloom.tables import USAGE_SQL, load, usage

U = "WITH " + USAGE_SQL


def parts(name, sql, columns):
    query(name, f"SELECT p_partkey, {sql} FROM part")(lambda s, d: load(s, d, "part").select("p_partkey", *[c.alias(n) for n, c in columns().items()]))


K, SIZE = F.col, lambda: F.col("p_size")
SOURCES = list(r.SOURCE_SCORES)
MESSAGES = ("Request timed out", "Connection refused by host", "Too many requests", "Login required", "Bad gateway", "Unexpected token in JSON", "missing field x", "Content too short", "boom", "Page blocked by captcha")
STATUSES = (None, 401, 404, 429, 503, 418, 200)
sql_list = lambda values: "[" + ", ".join("NULL" if v is None else repr(v) if isinstance(v, str) else str(v) for v in values) + "]"
of = lambda values, at: F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))

parts("x7_level", "CASE WHEN p_size / 50.0 > 0.8 THEN 'high' WHEN p_size / 50.0 > 0.5 THEN 'medium' ELSE 'low' END AS level", lambda: dict(level=r.level(SIZE() / 50)))
parts("m7_source_score", f"{sql_list(r.SOURCE_SCORES.values())}[p_partkey % 10 + 1]::DOUBLE AS score", lambda: dict(score=r.source_score(of(SOURCES, K("p_partkey")))))
parts("m14_volatility", "round(CASE WHEN p_size >= 2 THEN CASE WHEN p_partkey % 5 = 0 THEN 0.0 WHEN p_partkey % 48 > 24 THEN (p_partkey % 7) / p_size * 0.5 ELSE (p_partkey % 7) / p_size END END, 6)::DOUBLE AS volatility", lambda: dict(volatility=F.round(r.volatility(K("p_partkey") % 7, SIZE(), F.when(K("p_partkey") % 5 != 0, K("p_partkey") % 48)), 6)))
parts("m15_poll_minutes", """round(CASE WHEN p_type = 'ECONOMY' THEN 1440 WHEN p_type = 'SMALL' OR p_size < 2 THEN 60 ELSE greatest(5, least(1440, p_size * 60 * 0.8 * CASE WHEN p_partkey % 10 < 5 THEN 0.5 WHEN p_partkey % 10 < 7 THEN 0.7 ELSE 1.0 END * CASE WHEN p_type = 'LARGE' THEN 0.6 ELSE 1.0 END)) END, 6)::DOUBLE AS minutes""", lambda: dict(minutes=F.round(r.poll_minutes(F.when(K("p_type") == "ECONOMY", "static").when(K("p_type") == "SMALL", "unknown").when(K("p_type") == "LARGE", "irregular").otherwise("daily"), SIZE(), SIZE(), (K("p_partkey") % 10) / 10), 6)))
parts("m16_verified_confidence", "round(CASE WHEN p_size % 5 = 0 THEN 0.5 ELSE (p_partkey % (p_size % 5 + 1)) / (p_size % 5) * CASE WHEN p_partkey % 11 = 0 THEN 0.3 WHEN p_partkey % 3 = 0 THEN 0.6 ELSE 1.0 END END, 6)::DOUBLE AS confidence", lambda: dict(confidence=F.round(r.verified_confidence(K("p_partkey") % (SIZE() % 5 + 1), F.nullif(SIZE() % 5, F.lit(-1)), F.when(K("p_partkey") % 11 == 0, 1).otherwise(0), F.when(K("p_partkey") % 3 == 0, 1).otherwise(0)), 6)))
parts("m22_days", "CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size * 7 WHEN 2 THEN p_size * 30 END::BIGINT AS days", lambda: dict(days=r.days_in(F.concat(F.lit("in "), SIZE().cast("string"), of((" Tage", " semanas", " months", " years"), K("p_partkey"))))))
parts("m21_change_type", "CASE WHEN p_partkey % 50 > p_size THEN 'increased' WHEN p_partkey % 50 < p_size THEN 'decreased' ELSE 'modified' END AS change", lambda: dict(change=r.change_type(SIZE(), K("p_partkey") % 50)))
parts("m25_combined_risk", f"{sql_list(r.RISKS)}[CAST(ceil(round((p_size % 4) * 0.6 + (p_partkey % 4) * 0.4, 9)) AS INTEGER) + 1] AS risk", lambda: dict(risk=r.combined_risk(of(r.RISKS, SIZE()), of(r.RISKS, K("p_partkey")), 0.4)))
METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD")
CODES = (200, 201, 204, 404, 500)
parts(
    "m28_request_confidence",
    f"""(WITH v AS (SELECT {sql_list(METHODS)}[p_partkey % 5 + 1] AS m, {sql_list(CODES)}[p_size % 5 + 1] AS c, p_partkey % 2 = 0 AS j, p_partkey % 3 = 0 AS a, p_size % 2 = 0 AS b),
 w AS (SELECT 3 * (c < 300)::INT + 2 * j::INT + 2 * (m = 'GET')::INT + (c < 300 AND m IN ('POST', 'PUT', 'DELETE'))::INT * (2 * a::INT + ((m = 'POST' AND c = 201) OR (m = 'DELETE' AND c IN (200, 204)) OR (m = 'PUT' AND c = 200))::INT) + b::INT + a::INT AS n FROM v)
 SELECT CASE WHEN n >= 7 THEN 'high' WHEN n >= 4 THEN 'medium' ELSE 'low' END FROM w) AS confidence""",
    lambda: dict(confidence=r.request_confidence(of(CODES, SIZE()), F.when(K("p_partkey") % 2 == 0, "application/json").otherwise("text/html"), of(METHODS, K("p_partkey")), K("p_partkey") % 3 == 0, SIZE() % 2 == 0, K("p_partkey") % 3 == 0)),
)
BY_STATUS = "CASE WHEN s IN (401, 403) THEN 'auth_required' WHEN s = 429 THEN 'rate_limited' WHEN s = 404 THEN 'wrong_endpoint' WHEN s BETWEEN 500 AND 599 THEN 'server_error' WHEN s BETWEEN 400 AND 499 THEN CASE WHEN m = 'Login required' THEN 'auth_required' WHEN m = 'Too many requests' THEN 'rate_limited' ELSE 'wrong_endpoint' END"
WORDS_CLASS = "CASE m WHEN 'Request timed out' THEN 'timeout' WHEN 'Connection refused by host' THEN 'network_error' WHEN 'Too many requests' THEN 'rate_limited' WHEN 'Login required' THEN 'auth_required' WHEN 'Bad gateway' THEN 'server_error' WHEN 'Unexpected token in JSON' THEN 'parse_error' WHEN 'missing field x' THEN 'validation_failed' WHEN 'Content too short' THEN 'content_too_short' ELSE 'unknown' END"
GIVEN = f"(SELECT p_partkey, {sql_list(STATUSES)}[p_size % 7 + 1] AS s, {sql_list(MESSAGES)}[p_partkey % 10 + 1] AS m FROM part)"


@query("x43_failure_class", f"SELECT p_partkey, {BY_STATUS} ELSE {WORDS_CLASS} END AS category FROM {GIVEN}")
def _(s, d):
    return load(s, d, "part").select("p_partkey", r.failure_class(of(STATUSES, SIZE()), of(MESSAGES, K("p_partkey")))["category"].alias("category"))


@query("x45_error_type", f"SELECT p_partkey, CASE WHEN s IN (401, 403) THEN 'auth_expired' WHEN s = 404 THEN 'not_found' WHEN s = 429 THEN 'rate_limited' WHEN s >= 500 THEN 'server_error' WHEN m = 'Page blocked by captcha' THEN 'blocked' WHEN m = 'Too many requests' THEN 'rate_limited' ELSE 'unknown' END AS type FROM {GIVEN}")
def _(s, d):
    return load(s, d, "part").select("p_partkey", r.error_type(of(STATUSES, SIZE()), of(MESSAGES, K("p_partkey"))).alias("type"))


@query("x36_key_values", "SELECT p_partkey, unnest([{'type': 'currency', 'place': 0, 'value': p_size || ' EUR'}, {'type': 'currency', 'place': 1, 'value': '1,200.50$'}, {'type': 'percent', 'place': 2, 'value': '3.5 %'}, {'type': 'duration', 'place': 3, 'value': p_size || ' days'}], recursive := true) FROM part")
def _(s, d):
    text = F.concat(F.lit("pay "), SIZE().cast("string"), F.lit(" EUR or 1,200.50$ less 3.5 % in "), SIZE().cast("string"), F.lit(" days"))
    return load(s, d, "part").select("p_partkey", F.explode(r.key_values(text)).alias("x")).select("p_partkey", "x.*")


@query("x37_differing_values", "SELECT p_partkey, 'currency' AS type, p_size || ' EUR' AS old, '7 EUR' AS new FROM part WHERE p_size <> 7 UNION ALL SELECT p_partkey, 'percent', '5%', '(removed)' FROM part UNION ALL SELECT p_partkey, 'duration', '(new)', '2 weeks' FROM part")
def _(s, d):
    old = F.concat(SIZE().cast("string"), F.lit(" EUR at 5%"))
    return load(s, d, "part").select("p_partkey", F.explode(r.differing_values(old, F.lit("7 EUR within 2 weeks"))).alias("x")).select("p_partkey", "x.*")


@query("x54_hash_string", "SELECT p_partkey, list_reduce(list_transform(string_split(p_name || p_brand, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, c: (a * 31 + c) % 4294967296, 0::BIGINT) AS v FROM part".replace("SELECT p_partkey,", "WITH h AS (SELECT p_partkey,") + ") SELECT p_partkey, abs(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END) AS hash FROM h")
def _(s, d):
    return load(s, d, "part").select("p_partkey", F.abs(r.rolling_hash(F.concat("p_name", "p_brand"))).alias("hash"))


@query("x55_hash_hex", "WITH h AS (SELECT p_partkey, list_reduce(list_transform(string_split(p_name || p_brand, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, c: (a * 31 + c) % 4294967296, 0::BIGINT) AS v FROM part), g AS (SELECT p_partkey, CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END AS v FROM h) SELECT p_partkey, CASE WHEN v < 0 THEN '-' ELSE '' END || lower(to_hex(abs(v))) AS hash FROM g")
def _(s, d):
    return load(s, d, "part").select("p_partkey", r.signed_hex(r.rolling_hash(F.concat("p_name", "p_brand"))).alias("hash"))


@query("x53_fingerprint", "SELECT vec_id, array_to_string(list_transform(list_transform(embedding[1:8], lambda v: CAST(floor(v::DOUBLE * 1000 + 0.5) AS BIGINT)), lambda n: lpad(CASE WHEN n < 0 THEN '-' ELSE '' END || lower(to_hex(abs(n))), 4, '0')), '') AS fingerprint FROM embeddings")
def _(s, d):
    return load(s, d, "embeddings").select("vec_id", r.fingerprint(F.col("embedding")).alias("fingerprint"))


@query("v8_quantised", "SELECT vec_id, list_transform(embedding, lambda v: CAST(floor((greatest(-1.0, least(1.0, v::DOUBLE)) + 1) * 127.5 + 0.5) AS INTEGER)) AS codes FROM embeddings")
def _(s, d):
    return load(s, d, "embeddings").select("vec_id", r.quantised(F.col("embedding")).alias("codes"))


@query("v7_code_cosine", "WITH q AS (SELECT vec_id, list_transform(embedding, lambda v: floor((greatest(-1.0, least(1.0, v::DOUBLE)) + 1) * 127.5 + 0.5)::DOUBLE - 128) AS c FROM embeddings) SELECT vec_id, round(list_cosine_similarity(c, list_transform(range(len(c)), lambda i: 1.0 + i % 3)), 6) AS score FROM q WHERE c IS NOT NULL")
def _(s, d):
    codes = F.transform(r.quantised(F.col("embedding")), lambda c: c - F.lit(128.0))
    other = F.transform(F.sequence(F.lit(0), F.size("c") - 1), lambda i: 1.0 + i % 3)
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    rows = load(s, d, "embeddings").where("embedding is not null").select("vec_id", codes.alias("c")).withColumn("o", other)
    return rows.select("vec_id", F.round(total("c", "o") / F.sqrt(total("c", "c") * total("o", "o")), 6).alias("score"))


@query("v2_filtered_search", "WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 1) SELECT e.vec_id, round(list_inner_product([x::DOUBLE for x in e.embedding], [x::DOUBLE for x in q.v]), 6) AS score FROM embeddings e, q WHERE e.label IN (1, 2, 3) AND e.vec_id > 10 ORDER BY score DESC, vec_id LIMIT 10")
def _(s, d):
    rows = load(s, d, "embeddings")
    one = F.broadcast(rows.where("vec_id = 1").select(F.col("embedding").alias("v")))
    score = F.aggregate(F.zip_with("embedding", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return rows.where("label in (1, 2, 3) and vec_id > 10").join(one).select("vec_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query("x39_text_change", """WITH p AS (SELECT doc_id, md5(text) AS h, length(text) AS n, len(string_split(text, chr(10))) AS lines, lag(doc_id) OVER w AS old, lag(md5(text)) OVER w AS b, lag(length(text)) OVER w AS m, lag(len(string_split(text, chr(10)))) OVER w AS k FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT doc_id, CASE WHEN h = b THEN 'none' WHEN lines <> k THEN 'high' WHEN abs(n - m) / m > 0.2 THEN 'high' WHEN abs(n - m) / m > 0.05 THEN 'medium' ELSE 'low' END AS significance FROM p WHERE m > 0""")
def _(s, d):
    # hashes and lengths alone meet, not the texts
    short = load(s, d, "documents").select("doc_id", "source", F.struct(F.md5("text").alias("h"), F.length("text").alias("n"), F.size(F.split("text", "\n")).alias("lines")).alias("x"))
    rows = change.against_previous(short, ["source"], ["doc_id"], K("x")).where("before.n > 0")
    now, old = (lambda c: K(f"value.{c}")), (lambda c: K(f"before.{c}"))
    return rows.select("doc_id", r.text_change(now("h") == old("h"), now("lines") == old("lines"), old("n"), now("n")).alias("significance"))


@query("x40_change_weight", f"SELECT item_id, CASE WHEN regexp_matches(lower(text), '{'|'.join(r.HIGH_WORDS)}') THEN 'high' WHEN regexp_matches(lower(text), '{'|'.join(r.MEDIUM_WORDS)}') THEN 'medium' ELSE 'low' END AS weight FROM (SELECT item_id, text || CASE item_id % 3 WHEN 0 THEN ' A Fee of 3' WHEN 1 THEN ' an option' ELSE '' END AS text FROM benchmark)")
def _(s, d):
    text = F.concat("text", of((" A Fee of 3", " an option", ""), K("item_id")))
    return load(s, d, "benchmark").select("item_id", r.change_weight(text).alias("weight"))


@query("m20_credibility", "SELECT page_id, CASE WHEN regexp_matches(url, '[.]gov|example[.]org') THEN 'official' WHEN regexp_matches(url, '[.]edu|www[.]') THEN 'authoritative' WHEN regexp_matches(url, '(?i)wikipedia|wiki|news|blog|forum') THEN 'secondary' ELSE 'unverified' END AS credibility FROM pages")
def _(s, d):
    return load(s, d, "pages").select("page_id", r.credibility(K("url"), ["[.]gov", "example[.]org"], ["[.]edu", "www[.]"]).alias("credibility"))


@query("f32_likely_api", "SELECT page_id, page_id % 4 = 0 OR regexp_matches(lower(url) || CASE WHEN page_id % 3 = 0 THEN '/api/x' ELSE '' END, 'graphql|/gql|/query|/api/|/v[0-9]+/|[.]json$|/rest/|/ajax/|/rpc') AS api FROM pages")
def _(s, d):
    url = F.concat("url", F.when(K("page_id") % 3 == 0, "/api/x").otherwise(""))
    return load(s, d, "pages").select("page_id", r.likely_api(url, F.when(K("page_id") % 4 == 0, "Application/JSON; charset=x")).alias("api"))


@query("f22_skipped_urls", "SELECT page_id, regexp_matches(url, '[.]pdf$') OR regexp_matches(url, '^https?://m[.]') OR regexp_matches(url, 'login') AS skip FROM pages")
def _(s, d):
    skip = F.exists(F.array(*map(F.lit, ("[.]pdf$", "^https?://m[.]", "login"))), lambda p: F.regexp_like("url", p))
    return load(s, d, "pages").select("page_id", skip.alias("skip"))


@query("m8_stale_orders", "SELECT o_orderkey, CAST(floor((epoch_us(TIMESTAMP '2000-01-01') - epoch_us(o_orderdate)) / 86400000000) AS BIGINT) AS days, o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 14 DAY AS stale FROM orders")
def _(s, d):
    now = F.lit("2000-01-01").cast("timestamp_ntz")
    return load(s, d, "orders").select("o_orderkey", r.days_since(K("o_orderdate"), now).alias("days"), r.is_stale(K("o_orderdate"), now).alias("stale"))


@query("m10_decay_history", U + " SELECT domain, id FROM usage WHERE NOT success QUALIFY row_number() OVER (PARTITION BY domain ORDER BY ts DESC, id DESC) <= 10")
def _(s, d):
    from sparkloom.operators.ordered import latest

    return latest(usage(s, d).where("not success"), ["domain"], [F.desc("ts"), F.desc("id")], 10).select("domain", "id")


@query("m45_cron_due", U + " SELECT id FROM usage WHERE minute(ts) BETWEEN 10 AND 20 AND hour(ts) IN (3, 9, 10, 11) AND month(ts) = 1 AND dayofweek(ts) BETWEEN 1 AND 5")
def _(s, d):
    return usage(s, d).where(r.cron_due(K("ts"), "10-20 3,9-11 * 1 1-5")).select("id")


@query("m44_next_execution", U + ", n AS (SELECT id, date_trunc('minute', ts) + INTERVAL 1 MINUTE AS t FROM usage) SELECT id, CAST(CASE WHEN minute(t) <= 30 THEN date_trunc('hour', t) + INTERVAL 30 MINUTE ELSE date_trunc('hour', t) + INTERVAL 90 MINUTE END AS TIMESTAMP) AS next FROM n")
def _(s, d):
    first = F.date_trunc("minute", K("ts")).cast("timestamp_ntz") + F.expr("INTERVAL 1 MINUTE")
    minutes = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.col("first") + F.make_dt_interval(F.lit(0), F.lit(0), i))
    return usage(s, d).select("id", first.alias("first")).select("id", F.element_at(F.filter(minutes, lambda t: r.cron_due(t, "30 * * * *")), 1).alias("next"))


@query("z1_rate_delay", U + """, h AS (SELECT id, domain, epoch_us(ts) AS t FROM usage),
c AS (SELECT id, t, count(*) OVER w AS n, min(t) OVER w AS oldest, max(t) OVER w AS newest FROM h WINDOW w AS (PARTITION BY domain ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING))
SELECT id, round(CASE WHEN n >= 5 THEN greatest(0, oldest + 3600000000 - t) / 1000.0 WHEN n > 0 AND t - newest < 600000000 THEN (600000000 - (t - newest)) / 1000.0 ELSE 0 END, 3)::DOUBLE AS delay_ms FROM c""")
def _(s, d):
    rows = usage(s, d).select("id", "domain", F.unix_micros(K("ts").cast("timestamp")).alias("t"))
    window, gap, most = 3_600_000_000, 600_000_000, 5
    w = Window.partitionBy("domain").orderBy("t").rangeBetween(-window, -1)
    n, oldest, newest = F.count("*").over(w), F.min("t").over(w), F.max("t").over(w)
    delay = F.when(n >= most, F.greatest(F.lit(0), oldest + window - K("t")) / 1000).when((n > 0) & (K("t") - newest < gap), (gap - (K("t") - newest)) / 1000).otherwise(0.0)
    return rows.select("id", F.round(delay, 3).alias("delay_ms"))


@query("z13_retry_delay", "SELECT p_partkey, round(least((100.0 * 2 ** (p_size % 8)) * (1 + 0.3 * ((p_partkey % 10) / 10.0)), 5000.0), 6)::DOUBLE AS delay_ms FROM part")
def _(s, d):
    return load(s, d, "part").select("p_partkey", F.round(r.retry_delay(F.lit(100), F.lit(5000), SIZE() % 8 + 1, (K("p_partkey") % 10) / 10), 6).alias("delay_ms"))


@query("z14_deliverable", """SELECT p_partkey, p_partkey % 7 <> 0 AND (p_partkey % 5 <> 0 OR p_size >= 5) AND p_type IN ('ECONOMY', 'SMALL', 'LARGE') AND (p_partkey % 2 = 0 OR p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')) AND p_size % 4 >= 1 AS deliver FROM part""")
def _(s, d):
    lists = F.when(K("p_partkey") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, ("Brand#1", "Brand#2", "Brand#3"))))
    go = r.deliverable(K("p_partkey") % 7 != 0, F.when(K("p_partkey") % 5 == 0, "unhealthy").otherwise("healthy"), SIZE(), F.array(*map(F.lit, ("ECONOMY", "SMALL", "LARGE"))), K("p_type"), lists, K("p_brand"), of(("low", "medium", "high", "critical"), SIZE()), F.lit("medium"))
    return load(s, d, "part").select("p_partkey", go.alias("deliver"))


@query("d8_changed_ignoring_space", "WITH p AS (SELECT doc_id, md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS h, lag(md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))))) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents) SELECT doc_id, h <> b AS changed FROM p WHERE b IS NOT NULL")
def _(s, d):
    short = load(s, d, "documents").select("doc_id", "source", F.md5(F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))).alias("h"))
    return change.against_previous(short, ["source"], ["doc_id"], K("h")).where("before is not null").select("doc_id", "changed")
