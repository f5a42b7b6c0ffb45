"""Rules that grade, classify and schedule: column functions without state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far each source of a value is trusted.
SOURCE_SCORES = {
    "structured_data": 0.95,
    "api_response": 0.95,
    "graphql": 0.90,
    "framework_data": 0.90,
    "selector_match": 0.75,
    "learned_pattern": 0.70,
    "meta_tags": 0.65,
    "heuristic": 0.50,
    "fallback": 0.30,
    "unknown": 0.20,
}
#: Words of messages by which failures are told apart.
AUTH_WORDS = ("unauthorized", "authentication", "auth", "login", "credential", "forbidden", "access denied", "permission", "not allowed")
RATE_WORDS = ("rate limit", "too many requests", "throttle", "quota exceeded", "slow down", "try again later")
SERVER_WORDS = ("internal server", "service unavailable", "bad gateway", "gateway timeout", "temporarily unavailable")
TIMEOUT_WORDS = ("timeout", "timed out", "deadline exceeded", "connection timeout", "request timeout", "aborted")
NETWORK_WORDS = ("network", "connection refused", "connection reset", "dns", "econnrefused", "econnreset", "enotfound", "enetunreach")
PARSE_WORDS = ("parse", "json", "xml", "syntax", "unexpected token", "invalid", "malformed")
#: Words that make a change of text weighty.
HIGH_WORDS = ("requirement", "required", "must", "mandatory", "deadline", "fee", "cost", "price", "income", "minimum", "maximum", "visa", "permit", "application", "document", "effective", "valid", "expire")
MEDIUM_WORDS = ("may", "should", "recommend", "option", "alternative", "process", "step", "procedure")
RISKS = ("low", "medium", "high", "extreme")


def holds(text: Column, words: Sequence[str]) -> Column:
    """Whether a text contains any of the words."""
    return F.lower(text).rlike("|".join(words))


def level(score: Column) -> Column:
    return F.when(score > 0.8, "high").when(score > 0.5, "medium").otherwise("low")


def source_score(source: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, score in SOURCE_SCORES.items():
        out = F.when(source == name, F.lit(score)).otherwise(out)
    return out


def days_since(verified: Column, now: Column) -> Column:
    """Whole days since a verification, or null where there was none."""
    return F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(verified.cast("timestamp"))) / F.lit(86_400_000_000))


def is_stale(verified: Column, now: Column, days: int = 14) -> Column:
    return verified.isNull() | (verified < now - F.expr(f"INTERVAL {days} DAYS"))


def volatility(changes: Column, checks: Column, hours_since: Column) -> Column:
    """Share of checks that found a change: null under two checks, 0 without a change, halved after a day without one."""
    rate = changes / checks
    return F.when(checks >= 2, F.when(hours_since.isNull(), 0.0).when(hours_since > 24, rate * 0.5).otherwise(rate))


def poll_minutes(pattern: Column, changes: Column, mean_hours: Column, confidence: Column, least: float = 5.0, most: float = 1440.0) -> Column:
    """Minutes until a page is looked at again."""
    trust = F.when(confidence < 0.5, 0.5).when(confidence < 0.7, 0.7).otherwise(1.0)
    wanted = mean_hours * 60 * 0.8 * trust * F.when(pattern == "irregular", 0.6).otherwise(1.0)
    return F.when(pattern == "static", most).when((pattern == "unknown") | (changes < 2), min(60.0, most)).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), wanted)))


def verified_confidence(passed: Column, total: Column, critical: Column, errors: Column) -> Column:
    """Share of checks passed, cut to three tenths by a critical failure or six tenths by an error."""
    rate = passed / total * F.when(critical > 0, 0.3).when(errors > 0, 0.6).otherwise(1.0)
    return F.when(total == 0, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate)))


def credibility(url: Column, official: Sequence[str], authoritative: Sequence[str]) -> Column:
    return F.when(url.rlike("|".join(official)), "official").when(url.rlike("|".join(authoritative)), "authoritative").when(url.rlike("(?i)wikipedia|wiki|news|blog|forum"), "secondary").otherwise("unverified")


def days_in(text: Column) -> Column:
    """Days that a text names, as days, weeks of 7 or months of 30, in five languages; days are looked for first."""
    number = lambda units: F.regexp_extract(text, rf"(?i)([0-9]+)\s*(?:{units})", 1).try_cast("long")
    return F.coalesce(number("days?|dias?|tage?|jours?|giorni?"), number("weeks?|semanas?|wochen?|semaines?") * 7, number("months?|meses?|monate?|mois") * 30)


def change_type(old: Column, new: Column) -> Column:
    """increased, decreased or modified, by the numbers of two values."""
    return F.when(new > old, "increased").when(new < old, "decreased").otherwise("modified")


def combined_risk(first: Column, second: Column, weight: float) -> Column:
    """The risk between two that a weight of the second gives, rounded up."""
    place = lambda r: F.array_position(F.array(*map(F.lit, RISKS)), r) - 1
    at = F.ceil(F.round(place(first) * (1 - weight) + place(second) * weight, 9)).cast("int")
    return F.element_at(F.array(*map(F.lit, RISKS)), F.least(at, F.lit(len(RISKS) - 1)) + 1)


def request_confidence(status: Column, content_type: Column, method: Column, authorised: Column, body: Column, token: Column) -> Column:
    """How surely a request is one of an interface: high, medium or low by added points."""
    good = status.between(200, 299)
    fitting = ((method == "POST") & (status == 201)) | ((method == "DELETE") & status.isin(200, 204)) | ((method == "PUT") & (status == 200))
    point = lambda c, n: F.when(F.coalesce(c, F.lit(False)), n).otherwise(0)
    write = good & method.isin("POST", "PUT", "PATCH", "DELETE")
    score = point(good, 3) + point(F.contains(content_type, F.lit("application/json")), 2) + point(method == "GET", 2) + point(write & authorised, 2) + point(write & fitting, 1) + point(body, 1) + point(token, 1)
    return F.when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")


def likely_api(url: Column, content_type: Column) -> Column:
    """Whether a request is likely one of an interface, by its content type and URL."""
    json = F.coalesce(F.contains(F.lower(content_type), F.lit("application/json")), F.lit(False))
    return json | F.lower(url).rlike(r"graphql|/gql|/query|/api/|/v\d+/|\.json$|/rest/|/ajax/|/rpc")


def text_change(same: Column, same_structure: Column, old_length: Column, new_length: Column) -> Column:
    """none, low, medium or high, by hashes of content and structure and the share of length that changed."""
    share = F.abs(new_length - old_length) / old_length
    return F.when(same, "none").when(~same_structure, "high").when(share > 0.2, "high").when(share > 0.05, "medium").otherwise("low")


def change_weight(text: Column) -> Column:
    return F.when(holds(text, HIGH_WORDS), "high").when(holds(text, MEDIUM_WORDS), "medium").otherwise("low")


def failure_class(status: Column, message: Column) -> Column:
    """(category, confidence) of a failure, by its status and then by words of its message."""
    kind = lambda name, score: F.struct(F.lit(name).alias("category"), F.lit(score).alias("confidence"))
    low = F.lower(F.coalesce(message, F.lit("unknown error")))
    client = F.when(holds(low, AUTH_WORDS), kind("auth_required", 0.8)).when(holds(low, RATE_WORDS), kind("rate_limited", 0.8)).otherwise(kind("wrong_endpoint", 0.6))
    by_status = F.when(status.isin(401, 403), kind("auth_required", 1.0)).when(status == 429, kind("rate_limited", 1.0)).when(status == 404, kind("wrong_endpoint", 1.0)).when(status.between(500, 599), kind("server_error", 0.9)).when(status.between(400, 499), client)
    by_words = (
        F.when(holds(low, TIMEOUT_WORDS), kind("timeout", 0.9))
        .when(holds(low, NETWORK_WORDS), kind("network_error", 0.9))
        .when(holds(low, RATE_WORDS), kind("rate_limited", 0.8))
        .when(holds(low, AUTH_WORDS), kind("auth_required", 0.8))
        .when(holds(low, SERVER_WORDS), kind("server_error", 0.8))
        .when(holds(low, PARSE_WORDS), kind("parse_error", 0.8))
        .when((holds(low, ["missing"]) & holds(low, ["field"])) | holds(low, ["required field"]), kind("validation_failed", 0.9))
        .when(holds(low, ["too short"]), kind("content_too_short", 0.9))
        .otherwise(kind("unknown", 0.3))
    )
    return F.coalesce(by_status, by_words)


def error_type(status: Column, message: Column) -> Column:
    """One of eight types of error, by status and then by words."""
    low = F.lower(F.coalesce(message, F.lit("")))
    by_status = F.when(status.isin(401, 403), "auth_expired").when(status == 404, "not_found").when(status == 429, "rate_limited").when(status >= 500, "server_error")
    by_words = F.when(holds(low, ["timeout"]), "timeout").when(holds(low, ["blocked", "captcha", "cloudflare"]), "blocked").when(holds(low, ["not found", "404"]), "not_found").when(holds(low, ["rate limit", "too many"]), "rate_limited").otherwise("unknown")
    return F.coalesce(by_status, by_words)


def key_values(text: Column) -> Column:
    """Array of (type, place, value): amounts of money, percentages and durations of a text, numbered through."""
    kinds = (("currency", r"(?i)([0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]{2})?)\s*(?:EUR|USD|\$|euros?)"), ("percent", r"([0-9]+(?:\.[0-9]+)?)\s*%"), ("duration", r"(?i)([0-9]+)\s*(?:days?|weeks?|months?|years?)"))
    of = lambda kind, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))
    found = F.concat(*[of(*k) for k in kinds])
    return F.transform(found, lambda x, i: F.struct(x["type"].alias("type"), i.alias("place"), x["value"].alias("value")))


def differing_values(old: Column, new: Column) -> Column:
    """Array of (type, old, new): values of two texts whose place and type agree and that differ, are new or are gone."""
    at = lambda values, x: F.try_element_at(F.filter(values, lambda y: (y["type"] == x["type"]) & (y["place"] == x["place"])), F.lit(1))["value"]
    a, b = key_values(old), key_values(new)
    row = lambda kind, x, y: F.struct(kind.alias("type"), x.alias("old"), y.alias("new"))
    gone = F.transform(F.filter(a, lambda x: ~x["value"].eqNullSafe(at(b, x))), lambda x: row(x["type"], x["value"], F.coalesce(at(b, x), F.lit("(removed)"))))
    fresh = F.transform(F.filter(b, lambda x: at(a, x).isNull()), lambda x: row(x["type"], F.lit("(new)"), x["value"]))
    return F.concat(gone, fresh)


def rolling_hash(text: Column) -> Column:
    """The signed 32-bit hash of a text by the multiplier 31, over code points of the basic plane."""
    top = 1 << 32
    value = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda a, c: F.pmod(a * 31 + F.ascii(c), F.lit(top)))
    return F.when(value >= top // 2, value - top).otherwise(value)


def signed_hex(number: Column) -> Column:
    return F.concat(F.when(number < 0, "-").otherwise(""), F.lower(F.hex(F.abs(number))))


def fingerprint(vector: Column, parts: int = 8) -> Column:
    """The first components in thousandths, as hexadecimal of four digits at least, negative ones with a sign."""
    each = lambda v: F.lpad(signed_hex(F.floor(v.cast("double") * 1000 + 0.5)), 4, "0")
    return F.array_join(F.transform(F.slice(vector, 1, parts), each), "")


def quantised(vector: Column) -> Column:
    """Components from -1 to 1 as whole numbers from 0 to 255."""
    return F.transform(vector, lambda v: F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v.cast("double"))) + 1) * 127.5 + 0.5).cast("int"))


def cron_matches(value: Column, part: str) -> Column:
    """Whether a number fits a part of a cron pattern: a star, a list, a range or a number."""
    if part == "*":
        return F.lit(True)
    if "," in part:
        out = F.lit(False)
        for p in part.split(","):
            out = out | cron_matches(value, p)
        return out
    if "-" in part:
        first, last = map(int, part.split("-"))
        return value.between(first, last)
    return value == int(part)


def cron_due(ts: Column, pattern: str) -> Column:
    """Whether a time fits a cron pattern of five parts."""
    minute, hour, day, month, weekday = pattern.split()
    parts = ((F.minute(ts), minute), (F.hour(ts), hour), (F.dayofmonth(ts), day), (F.month(ts), month), (F.dayofweek(ts) - 1, weekday))
    out = F.lit(True)
    for value, part in parts:
        out = out & cron_matches(value, part)
    return out


def retry_delay(first_ms: Column, most_ms: Column, attempt: Column, jitter: Column) -> Column:
    """Doubling delay with up to three tenths more, cut at a maximum; jitter from 0 to 1."""
    delay = first_ms * F.pow(F.lit(2.0), attempt - 1)
    return F.least(delay + jitter * 0.3 * delay, most_ms.cast("double"))


def deliverable(enabled: Column, health: Column, opened_minutes: Column, events: Column, event: Column, domains: Column, domain: Column, severity: Column, least: Column, reset: float = 5.0) -> Column:
    """Whether an event goes to an endpoint: enabled, its breaker closed or timed out, and its filters met; empty lists of domains let all pass."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), s)
    breaker = (health != "unhealthy") | F.coalesce(opened_minutes >= reset, F.lit(False))
    named = (F.size(domains) == 0) | F.coalesce(F.array_contains(domains, domain), F.lit(False))
    return enabled & breaker & F.array_contains(events, event) & named & (rank(severity) >= rank(least))
