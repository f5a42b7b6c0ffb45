"""Queries of URL, text, scoring and vector functions over the pages, documents, parts and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import scoring as m
from sparkloom.functions import text as x
from sparkloom.functions import url as l
from sparkloom.functions import vector as v
from sparkloom.plans.registry import query
from sparkloom.tables import load

HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1))"
PATH = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def pages(name, sql, columns):
    query(name, f"SELECT page_id, {sql} FROM pages")(lambda spark, d: load(spark, d, "pages").select("page_id", *[c.alias(n) for n, c in columns().items()]))


def documents(name, sql, columns):
    query(name, f"SELECT doc_id, {sql} FROM documents")(lambda spark, d: load(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in columns().items()]))


def parts(name, sql, columns):
    query(name, f"SELECT p_partkey, {sql} FROM part")(lambda spark, d: load(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in columns().items()]))


pages("l1_host_path", f"{HOST} AS host, {PATH} AS path", lambda: dict(host=l.host(F.col("url")), path=l.path(F.col("url"))))
pages("l3_generalised_url", f"regexp_replace(regexp_replace(regexp_replace({PATH}, '/[0-9]+(/|$)', '/{{id}}\\1', 'g'), '/[0-9a-f]{{8}}-[0-9a-f-]{{27}}(/|$)', '/{{uuid}}\\1', 'g'), '/[A-Za-z0-9_-]{{20,}}(/|$)', '/{{token}}\\1', 'g') AS pattern", lambda: dict(pattern=l.generalised(F.col("url"))))
ROOT2 = f"array_to_string(list_slice(string_split({HOST}, '.'), -2, -1), '.')"
pages("l5_root_domain", f"CASE WHEN {ROOT2} IN ('co.uk','com.au','co.nz','co.jp','com.br','co.in') THEN array_to_string(list_slice(string_split({HOST}, '.'), -3, -1), '.') ELSE {ROOT2} END AS root", lambda: dict(root=l.root_domain(l.host(F.col("url")))))
pages("l6_embedding_text", f"concat_ws(' ', {HOST}, array_to_string([w for w in string_split({PATH}, '/') if length(w) > 0 AND NOT regexp_matches(w, '^[0-9]+$') AND length(w) < 20], ' ')) AS words", lambda: dict(words=l.embedding_text(F.col("url"))))
documents("l7_truncated", "length(cut) AS n, md5(cut) AS h FROM (SELECT doc_id, CASE WHEN length(one) <= 200 THEN one WHEN strpos(reverse(head), ' ') > 0 AND length(head) - strpos(reverse(head), ' ') + 1 > 160 THEN substr(head, 1, length(head) - strpos(reverse(head), ' ')) ELSE head END AS cut FROM (SELECT doc_id, one, substr(one, 1, 200) AS head FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS one FROM documents))) --", lambda: dict(n=F.length(x.cut(F.col("text"), 200)), h=F.md5(x.cut(F.col("text"), 200))))
pages("l8_volatility_key", f"{HOST} || regexp_replace({PATH}, '/[0-9]+', '/{{id}}', 'g') AS key", lambda: dict(key=l.volatility_key(F.col("url"))))
pages("l9_url_base", "regexp_replace(regexp_replace(regexp_replace(url || '?page=' || page_id || '&q=a', '([?&])(?:page|p|pg|offset|start|skip|cursor|after)=[^&#]*', '\\1', 'g'), '[?&]+($|#)', '\\1', 'g'), '([?&])&+', '\\1', 'g') AS base", lambda: dict(base=l.without_page(F.concat(F.col("url"), F.lit("?page="), F.col("page_id").cast("string"), F.lit("&q=a")))))
pages("l11_api_candidates", f"['https://' || {HOST} || '/api' || {PATH}, 'https://api.' || {HOST} || {PATH}, url || '.json'] AS candidates", lambda: dict(candidates=F.array(F.concat(F.lit("https://"), l.host(F.col("url")), F.lit("/api"), l.path(F.col("url"))), F.concat(F.lit("https://api."), l.host(F.col("url")), l.path(F.col("url"))), F.concat(F.col("url"), F.lit(".json")))))
pages("l12_resolved_link", f"CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || '/a/b' WHEN 1 THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || '//cdn.example.com/x' ELSE regexp_replace(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*)', 1), '[^/]*$', '') || 'c' END AS link", lambda: dict(link=l.resolved(F.col("url"), F.when(F.col("page_id") % 3 == 0, "/a/b").when(F.col("page_id") % 3 == 1, "//cdn.example.com/x").otherwise("c"))))
pages("l13_api_url", "NOT regexp_matches(url, '(?i)\\.(?:js|css|png|jpe?g|gif|svg|woff2?|ico|map)(?:\\?|$)') AND regexp_matches(url, '(?i)/api/|/v[0-9]+/|/graphql|\\.json(?:\\?|$)|^https?://api\\.') AS api", lambda: dict(api=l.looks_like_api(F.col("url"))))
pages("l14_next_page", "CASE WHEN regexp_matches(url, '[?&]page=') THEN regexp_replace(url, '([?&]page=)[^&#]*', '\\1' || (page_id + 1)) ELSE url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'page=' || (page_id + 1) END AS next", lambda: dict(next=l.with_page(F.col("url"), F.col("page_id") + 1)))
pages("l17_endpoint", "regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*)', 1) AS endpoint", lambda: dict(endpoint=l.endpoint(F.col("url"))))
pages("f18_url_match", "regexp_matches(url, '(?i)^https?://[^/]*example\\.(com|org)/') AS hit", lambda: dict(hit=F.col("url").rlike(r"(?i)^https?://[^/]*example\.(com|org)/")))
pages("f19_domain_glob", f"regexp_matches({HOST}, '^.*\\.example\\.com$') AS hit", lambda: dict(hit=l.host(F.col("url")).rlike(l.glob("*.example.com").replace(r"\-", "-"))))
pages("f20_first_pattern", f"CASE WHEN regexp_matches({HOST}, '^blog[.]') THEN 'blog' WHEN regexp_matches({HOST}, '^www[.]') THEN 'www' WHEN regexp_matches({HOST}, 'example[.]org$') THEN 'org' END AS pattern", lambda: dict(pattern=F.when(l.host(F.col("url")).rlike("^blog[.]"), "blog").when(l.host(F.col("url")).rlike("^www[.]"), "www").when(l.host(F.col("url")).rlike("example[.]org$"), "org")))
pages("f21_all_patterns", f"[p for p in ['^blog[.]', '^www[.]', 'example[.]org$', 'example[.]com$'] if regexp_matches({HOST}, p)] AS patterns", lambda: dict(patterns=F.filter(F.array(*map(F.lit, ["^blog[.]", "^www[.]", "example[.]org$", "example[.]com$"])), lambda p: F.regexp_like(l.host(F.col("url")), p))))
pages("f24_domain_in_list", f"({HOST} = 'cheap-pills.example.com' OR ends_with({HOST}, '.cheap-pills.example.com') OR regexp_matches({HOST}, '^blog\\..*$')) AS listed", lambda: dict(listed=l.in_list(l.host(F.col("url")), ["cheap-pills.example.com", "blog.*"])))
#: URLs of every kind that the safety rule tells apart, and what it says of them.
URL_CASES = (
    ("http://example.com/", True), ("https://user:pw@example.com:8443/x", True), ("http://user@127.0.0.1/", False), ("http://u:p@10.0.0.1/x", False),
    ("http://2130706433/", False), ("http://127.1/", False), ("http://0x7f.0.0.1/", False), ("http://0177.0.0.1/", False), ("https://169.254.169.254./", False),
    ("http://8.8.8.8/", True), ("http://172.15.0.1/", True), ("http://172.31.9.9/", False), ("http://192.168.1.1", False), ("http://256.1.1.1/", False), ("http://0.0.0.0/", False),
    ("http://localhost/", False), ("http://a.localhost:80/", False), ("http://localhost.localdomain/", False), ("http://metadata.google.internal/", False), ("http://100.100.100.200/", False),
    ("http://[::1]/", False), ("http://[0:0:0:0:0:0:0:1]/", False), ("http://[fe80::1]/", False), ("http://[fd00::2]/", False), ("http://[2001:db8::1]/", True), ("http://[::ffff:10.0.0.1]/", False),
    ("ftp://example.com/", False), ("javascript:alert(1)", False), ("http:///x", False), ("http://1.2.3.4.example.com/", True),
)


@query("f26_safe_url", f"SELECT page_id, regexp_matches(url, '(?i)^https?://') AND {HOST} <> '' AND NOT regexp_matches({HOST}, '(^|[.])[0-9]+$') AND {HOST} <> 'localhost' AS safe FROM pages UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}, {ok})" for i, (_, ok) in enumerate(URL_CASES)) + ") v(page_id, safe)")
def _(s, d):
    cases = s.createDataFrame([(-1 - i, u) for i, (u, _) in enumerate(URL_CASES)], "page_id long, url string")
    return load(s, d, "pages").select("page_id", "url").unionAll(cases).select("page_id", l.is_safe(F.col("url")).alias("safe"))

pages("x50_domain_class", f"CASE WHEN regexp_matches({HOST}, '\\.gov(?:\\.|$)') THEN 'government' WHEN regexp_matches({HOST}, '\\.edu(?:\\.|$)|\\.ac\\.') THEN 'education' WHEN regexp_matches({HOST}, '^(?:docs?|api|developer)\\.') THEN 'technical' WHEN regexp_matches({HOST}, '^(?:blog|news)\\.') THEN 'news' ELSE 'general' END AS class", lambda: dict(**{"class": l.domain_class(l.host(F.col("url")))}))
pages("x52_content_type", "CASE WHEN regexp_matches(lower(url), '\\.pdf(?:\\?|$)') THEN 'pdf' WHEN regexp_matches(lower(url), '/(?:blog|news|article)') THEN 'article' WHEN regexp_matches(lower(url), '/(?:product|item|shop)') THEN 'product' WHEN regexp_matches(lower(url), '/(?:search|find)|[?&]q=') THEN 'search' ELSE 'page' END AS kind", lambda: dict(kind=l.content_type(F.col("url"))))
pages("m47_pdf_url", "regexp_matches(lower(url), '\\.pdf(?:[?#]|$)') AS pdf", lambda: dict(pdf=F.lower(F.col("url")).rlike(r"\.pdf(?:[?#]|$)")))
PLAIN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis'), '</(?:p|div|h[1-6]|li|tr)>|<br[ /]*>', chr(10), 'gi'), '<[^>]*>', '', 'g')"
for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    PLAIN = f"replace({PLAIN}, '{name}', '{char}')"
PLAIN = f"trim(regexp_replace(regexp_replace({PLAIN}, '[ \\t]+', ' ', 'g'), '\\n[ \\n]*', chr(10), 'g'))"
pages("x1_plain_text", f"md5({PLAIN}) AS h, length({PLAIN}) AS n", lambda: dict(h=F.md5(x.plain_text(F.col("html"))), n=F.length(x.plain_text(F.col("html")))))
pages("x2_is_html", "regexp_matches(html, '<[a-zA-Z][^>]*>') AS is_html", lambda: dict(is_html=F.col("html").rlike("<[a-zA-Z][^>]*>")))
pages("x8_page_language", "regexp_extract(html, '<html[^>]* lang=\"([a-zA-Z-]+)\"', 1) AS lang, CASE WHEN regexp_matches(html, '<html[^>]* lang=\"') THEN 0.95::DOUBLE ELSE 0.3::DOUBLE END AS confidence", lambda: dict(lang=F.regexp_extract(F.col("html"), '<html[^>]* lang="([a-zA-Z-]+)"', 1), confidence=F.when(F.col("html").rlike('<html[^>]* lang="'), 0.95).otherwise(0.3)))
pages("x48_bot_protection", "CASE WHEN contains(lower(html), 'cf-chl') OR contains(lower(html), 'cloudflare') THEN 'cloudflare' WHEN contains(lower(html), 'datadome') THEN 'datadome' WHEN contains(lower(html), 'perimeterx') THEN 'perimeterx' WHEN contains(lower(html), 'akamai') THEN 'akamai' WHEN contains(lower(html), 'recaptcha') THEN 'recaptcha' END AS vendor", lambda: dict(vendor=x.bot_protection(F.col("html"))))
pages("h_title", "regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS heading", lambda: dict(title=F.regexp_extract(F.col("html"), "<title>([^<]*)</title>", 1), heading=F.regexp_extract(F.col("html"), "<h1[^>]*>([^<]*)</h1>", 1)))
query("h_links", "SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages")(lambda spark, d: load(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("href")))
WORDS = "list_distinct([w for w in regexp_split_to_array(lower(text), '[^a-zà-öø-ÿ]+') if w <> ''])"
LANGS = " ".join(f"WHEN s = s_{k} THEN '{k}'" for k in sorted(x.STOP_WORDS, reverse=True))
query("x11_content_language", "WITH w AS (SELECT doc_id, " + WORDS + " AS w FROM documents), h AS (SELECT doc_id, " + ", ".join(f"len(list_intersect(w, {words})) / 10.0 AS s_{k}" for k, words in x.STOP_WORDS.items()) + " FROM w), b AS (SELECT *, greatest(" + ", ".join(f"s_{k}" for k in x.STOP_WORDS) + f") AS s FROM h) SELECT doc_id, CASE WHEN s < 0.1 THEN NULL {LANGS} END AS lang FROM b")(lambda spark, d: load(spark, d, "documents").select("doc_id", x.stop_word_language(F.col("text")).alias("lang")))
documents("x12_script", "len(regexp_extract_all(text, '[\\x{0400}-\\x{04FF}]')) AS cyrillic, len(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{024F}]')) AS latin", lambda: dict(cyrillic=F.regexp_count(F.col("text"), F.lit("[\\x{0400}-\\x{04FF}]")).cast("long"), latin=F.regexp_count(F.col("text"), F.lit("[A-Za-z\\x{00C0}-\\x{024F}]")).cast("long")))
documents("x21_money", "TRY_CAST(CASE WHEN regexp_matches(raw, ',[0-9]{1,2}$') THEN replace(replace(raw, '.', ''), ',', '.') ELSE replace(raw, ',', '') END AS DOUBLE) AS amount FROM (SELECT doc_id, regexp_extract(text, '(?:[$€£]|USD|EUR|GBP) ?([0-9][0-9.,]*[0-9]|[0-9])', 1) AS raw FROM documents) --", lambda: dict(amount=x.money(F.col("text"))))
documents("x22_duration", "TRY_CAST(regexp_extract(lower(text), '([0-9]+) ?(?:day|week|month|year)', 1) AS INT) * CASE regexp_extract(lower(text), '[0-9]+ ?(day|week|month|year)', 1) WHEN 'week' THEN 7 WHEN 'month' THEN 30 WHEN 'year' THEN 365 WHEN 'day' THEN 1 END AS days", lambda: dict(days=x.duration_days(F.col("text"))))
documents("x27_contacts", "list_sort(list_distinct([lower(e) for e in regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')])) AS emails", lambda: dict(emails=x.emails(F.col("text"))))
COLLAPSED = "trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))"
documents("x38_fingerprint", f"md5({COLLAPSED}) AS content, md5(array_to_string([CAST(length(w) AS VARCHAR) for w in string_split(text, chr(10))], ',')) AS shape, length(text) AS length, len([w for w in regexp_split_to_array(text, '[ \\t\\n\\r\\f]+') if w <> '']) AS words", lambda: dict(content=x.fingerprint(F.col("text"))["content"], shape=x.fingerprint(F.col("text"))["shape"], length=x.fingerprint(F.col("text"))["length"], words=x.fingerprint(F.col("text"))["words"]))
parts("x41_edit_distance", "levenshtein(p_name, p_type) AS distance", lambda: dict(distance=F.levenshtein("p_name", "p_type")))
documents("x44_error_class", "CASE WHEN regexp_matches(lower(text), '\\b(?:401|403)\\b|forbidden|unauthori[sz]ed') THEN 'auth' WHEN regexp_matches(lower(text), '\\b404\\b|not found') THEN 'missing' WHEN regexp_matches(lower(text), '\\b429\\b|rate limit|too many') THEN 'rate_limit' WHEN regexp_matches(lower(text), '\\b5[0-9]{2}\\b|server error') THEN 'server' WHEN regexp_matches(lower(text), 'time ?out|timed out') THEN 'timeout' WHEN regexp_matches(lower(text), 'dns|econn|network|socket') THEN 'network' ELSE 'unknown' END AS kind", lambda: dict(kind=x.error_class(F.col("text"))))
parts("m1_combined_score", "round(0.7 * (p_size / 50.0) + 0.2 * 0.5 + 0.1 * exp(-p_size / 30.0), 6) AS score", lambda: dict(score=F.round(m.combined(F.col("p_size") / 50.0, F.lit(0.5), F.col("p_size").cast("double")), 6)))
parts("m3_decay", "round(CASE WHEN p_size <= 14 THEN 0.9 ELSE greatest(0.3, 0.9 - floor((p_size - 14) / 7) * 0.1) END, 6)::DOUBLE AS confidence", lambda: dict(confidence=F.round(m.decayed(F.lit(0.9), F.col("p_size")), 6)))
parts("m4_monthly_decay", "round(CASE WHEN p_size * 3 > 90 THEN NULL WHEN p_size * 3 > 30 THEN 0.9 * pow(0.95, floor(p_size * 3 / 30)) ELSE 0.9 END, 6)::DOUBLE AS confidence", lambda: dict(confidence=F.round(m.monthly_decay(F.lit(0.9), F.col("p_size") * 3), 6)))
parts("m5_level", "CASE WHEN p_size / 50.0 >= 0.9 THEN 'very_high' WHEN p_size / 50.0 >= 0.7 THEN 'high' WHEN p_size / 50.0 >= 0.5 THEN 'medium' WHEN p_size / 50.0 >= 0.3 THEN 'low' ELSE 'very_low' END AS level", lambda: dict(level=m.level(F.col("p_size") / 50.0)))
parts("m6_boost", "round(greatest(0, least(1, p_size / 50.0 + CASE WHEN p_size % 2 = 0 THEN 0.1 ELSE -0.1 END)), 6)::DOUBLE AS score", lambda: dict(score=F.round(m.boosted(F.col("p_size") / 50.0, F.col("p_size") % 2 == 0), 6)))
parts("m11_retry_wait", "CASE WHEN p_size % 7 > 5 THEN -1.0 ELSE least(60.0, 2.0 * pow(2.0, p_size % 7 - 1)) END::DOUBLE AS wait", lambda: dict(wait=m.retry_wait(F.col("p_size") % 7, 2, 2, 60, 5)))
parts("m19_agreement", "CASE WHEN (p_size % 5) / 4.0 >= 1 THEN 'unanimous' WHEN (p_size % 5) / 4.0 >= 0.7 THEN 'strong' WHEN (p_size % 5) / 4.0 >= 0.4 THEN 'partial' ELSE 'conflicting' END AS level", lambda: dict(level=m.agreement(F.col("p_size") % 5, F.lit(4.0))))
parts("m23_percent_change", "CAST(floor((p_retailprice - p_size) / p_size * 100 + 0.5) AS BIGINT) AS change", lambda: dict(change=m.percent_change(F.col("p_size"), F.col("p_retailprice"))))
parts("m27_risk", "CASE WHEN p_size / 50.0 >= 0.7 THEN 'very_high' WHEN p_size / 50.0 >= 0.4 THEN 'high' WHEN p_size / 50.0 >= 0.15 THEN 'medium' ELSE 'low' END AS risk", lambda: dict(risk=m.risk(F.col("p_size") / 50.0)))
query("m40_quantised", "SELECT vec_id, [CAST(floor((greatest(-1.0, least(1.0, x::DOUBLE)) + 1) / 2 * 255 + 0.5) AS INTEGER) for x in embedding] AS codes FROM embeddings")(lambda spark, d: load(spark, d, "embeddings").select("vec_id", m.quantised(F.col("embedding")).alias("codes")))
query("m41_restored", "SELECT vec_id, round(list_sum([floor((greatest(-1.0, least(1.0, x::DOUBLE)) + 1) / 2 * 255 + 0.5) / 255.0 * 2 - 1 for x in embedding]), 6) AS total FROM embeddings")(lambda spark, d: load(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(m.restored(m.quantised(F.col("embedding"))), F.lit(0.0), lambda a, b: a + b), 6).alias("total")))
documents("m42_human_bytes", "CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN round(n_chars / 1024.0, 1)::DOUBLE || ' KB' ELSE round(n_chars / 1048576.0, 1)::DOUBLE || ' MB' END AS size", lambda: dict(size=m.human_bytes(F.col("n_chars"))))

ASK = "(SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)"


def nearest(spark, d, score, filter=None):
    rows = load(spark, d, "embeddings")
    q = rows.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    rows = rows if filter is None else rows.where(filter)
    return rows.join(F.broadcast(q)).select("vec_id", score.alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


query("v1_nearest_l2", f"SELECT vec_id, round(exp(-list_distance([x::DOUBLE for x in embedding], [x::DOUBLE for x in q])), 6) AS score FROM embeddings, {ASK} ORDER BY score DESC, vec_id LIMIT 10")(lambda spark, d: nearest(spark, d, F.round(F.exp(-v.distance(F.col("embedding"), F.col("q"))), 6)))
query("v3_nearest_cosine", f"SELECT vec_id, round(list_cosine_similarity([x::DOUBLE for x in embedding], [x::DOUBLE for x in q]), 6) AS score FROM embeddings, {ASK} ORDER BY score DESC, vec_id LIMIT 10")(lambda spark, d: nearest(spark, d, F.round(v.cosine(F.col("embedding"), F.col("q")), 6)))
query("v4_filtered_cosine", f"SELECT vec_id, round(list_cosine_similarity([x::DOUBLE for x in embedding], [x::DOUBLE for x in q]), 6) AS score FROM embeddings, {ASK} WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")(lambda spark, d: nearest(spark, d, F.round(v.cosine(F.col("embedding"), F.col("q")), 6), F.col("label") == 3))
query("v6_normalised", "SELECT vec_id, round(list_sum([x::DOUBLE / sqrt(list_inner_product([y::DOUBLE for y in embedding], [y::DOUBLE for y in embedding])) for x in embedding]), 6) AS total FROM embeddings")(lambda spark, d: load(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(v.normalised(F.col("embedding")), F.lit(0.0), lambda a, b: a + b), 6).alias("total")))
