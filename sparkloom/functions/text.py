"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frequent words by which a language is recognised.
STOP_WORDS = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "with", "was"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "mit", "von", "den", "ein"],
    "fr": ["le", "la", "les", "et", "des", "est", "dans", "que", "une", "pour"],
    "es": ["el", "la", "los", "que", "de", "una", "por", "con", "para", "las"],
}
#: Character references that plain text resolves.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def collapsed(text: Column) -> Column:
    """White space made single, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def plain_text(html: Column) -> Column:
    """Markup removed: scripts and styles with their content, block ends as line ends, common references resolved."""
    out = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", "")
    out = F.regexp_replace(out, r"(?i)</(?:p|div|h[1-6]|li|tr)>|<br[ /]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for name, char in REFERENCES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n[ \n]*", "\n"))


def words(text: Column) -> Column:
    """Distinct lower-case words of letters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-zà-öø-ÿ]+"), lambda w: w != ""))


def stop_word_language(text: Column, least: float = 0.1) -> Column:
    """Language whose frequent words are best represented among a text's words; null below a share."""
    have = words(text)
    hits = F.array(*[F.struct((F.size(F.array_intersect(have, F.array(*map(F.lit, w)))) / float(len(w))).alias("s"), F.lit(lang).alias("lang")) for lang, w in sorted(STOP_WORDS.items())])
    best = F.array_max(hits)
    return F.when(best["s"] >= least, best["lang"])


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def fuzzy(a: Column, b: Column) -> Column:
    """1 for equal, 0.8 where one contains the other, else similarity of words longer than two letters."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    long = lambda t: F.array_distinct(F.filter(F.split(t, r"[ \t\n]+"), lambda w: F.length(w) > 2))
    return F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.8).otherwise(jaccard(long(x), long(y)))


def cut(text: Column, most: int) -> Column:
    """Collapsed text cut to a length, at the last blank if that is past four fifths of it."""
    one = collapsed(text)
    head = F.substring(one, 1, most)
    last = F.length(head) - F.locate(" ", F.reverse(head)) + 1
    whole = F.locate(" ", F.reverse(head)) > 0
    return F.when(F.length(one) <= most, one).when(whole & (last > most * 0.8), F.substring(head, F.lit(1), (last - 1).cast("int"))).otherwise(head)


def money(text: Column) -> Column:
    """First amount of money in a text, decimal comma or point."""
    raw = F.regexp_extract(text, r"(?:[$€£]|USD|EUR|GBP) ?([0-9][0-9.,]*[0-9]|[0-9])", 1)
    comma = raw.rlike(r",[0-9]{1,2}$")
    plain = F.when(comma, F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(raw, F.lit(","), F.lit("")))
    return plain.try_cast("double")


def duration_days(text: Column) -> Column:
    """Days of the first duration in a text: weeks 7, months 30, years 365."""
    number = F.regexp_extract(F.lower(text), r"([0-9]+) ?(?:day|week|month|year)", 1).try_cast("int")
    unit = F.regexp_extract(F.lower(text), r"[0-9]+ ?(day|week|month|year)", 1)
    return number * F.when(unit == "week", 7).when(unit == "month", 30).when(unit == "year", 365).when(unit == "day", 1)


def emails(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)), F.lower)))


def key_values(text: Column) -> Column:
    """Map of `key: value` lines, the last of a key counting."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^ *[A-Za-z][A-Za-z0-9 _-]{0,40}: +[^ ]"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):", 1)).alias("key"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("value")))
    return F.map_from_entries(pairs)


def fingerprint(text: Column) -> Column:
    """Hash of collapsed text, hash of its shape (lengths of lines), length and number of words."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.length(x).cast("string"))
    return F.struct(F.md5(collapsed(text)).alias("content"), F.md5(F.array_join(lines, ",")).alias("shape"), F.length(text).alias("length"), F.size(F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda w: w != "")).alias("words"))


def significance(same: Column, shape: Column, old: Column, new: Column) -> Column:
    """Weight of a change from equality of content and shape and the relative change of length."""
    delta = F.abs(new - old) / F.greatest(old, F.lit(1))
    return F.when(same, "none").when(~shape & (delta > 0.2), "high").when(~shape | (delta > 0.05), "medium").otherwise("low")


def language_code(locale: Column) -> Column:
    """Two-letter code of a locale."""
    code = F.regexp_extract(F.lower(locale), r"^([a-z]{2,3})(?:[-_]|$)", 1)
    three = F.create_map(*[F.lit(x) for pair in (("eng", "en"), ("deu", "de"), ("ger", "de"), ("fra", "fr"), ("fre", "fr"), ("spa", "es")) for x in pair])
    return F.coalesce(F.try_element_at(three, code), F.nullif(code, F.lit("")))


def error_class(message: Column) -> Column:
    """Class of an error: by HTTP status in it, then by words."""
    m = F.lower(message)
    return (
        F.when(m.rlike(r"\b(?:401|403)\b|forbidden|unauthori[sz]ed"), "auth")
        .when(m.rlike(r"\b404\b|not found"), "missing")
        .when(m.rlike(r"\b429\b|rate limit|too many"), "rate_limit")
        .when(m.rlike(r"\b5[0-9]{2}\b|server error"), "server")
        .when(m.rlike(r"time ?out|timed out"), "timeout")
        .when(m.rlike(r"dns|econn|network|socket"), "network")
        .otherwise("unknown")
    )


def bot_protection(html: Column) -> Column:
    """Name of the bot protection that a page shows, if any."""
    h = F.lower(html)
    return F.when(F.contains(h, F.lit("cf-chl")) | F.contains(h, F.lit("cloudflare")), "cloudflare").when(F.contains(h, F.lit("datadome")), "datadome").when(F.contains(h, F.lit("perimeterx")), "perimeterx").when(F.contains(h, F.lit("akamai")), "akamai").when(F.contains(h, F.lit("recaptcha")), "recaptcha")


def cache_directives(header: Column) -> Column:
    """Cache-Control as a map, directives without value as empty text."""
    return F.map_from_entries(F.transform(F.filter(F.split(F.lower(header), r" *, *"), lambda x: x != ""), lambda x: F.struct(F.trim(F.split(x, "=")[0]), F.coalesce(F.try_element_at(F.split(x, "="), F.lit(2)), F.lit("")))))


def hash31(text: Column) -> Column:
    """Absolute value of the 31-multiplier 32-bit hash over code points of the basic plane."""
    wrap = lambda x: F.when(x > 2147483647, x - 4294967296).otherwise(x)
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.abs(F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: wrap(F.pmod(a * 31 + F.ascii(c), F.lit(4294967296)))))
