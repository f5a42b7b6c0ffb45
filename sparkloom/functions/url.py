"""URL functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Public suffixes of two labels.
TWO_LABEL_SUFFIXES = ("co.uk", "com.au", "co.nz", "co.jp", "com.br", "co.in")
#: Query parameters that page through results.
PAGE_PARAMS = ("page", "p", "pg", "offset", "start", "skip", "cursor", "after")


def host(url: Column) -> Column:
    """The host in lower case: without user information, port and last dot, IPv6 addresses in brackets."""
    found = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#@]+)", 1)
    return F.lower(F.regexp_replace(found, r"\.$", ""))


def ipv4(name: Column) -> Column:
    """The number of an IPv4 address in any of the forms that URLs may give it (four parts or fewer; decimal, octal, hexadecimal), or null."""
    parts = F.split(name, r"\.")
    n = F.size(parts)
    number = lambda x: F.when(x.rlike("^0x[0-9a-f]*$"), F.conv(F.concat(F.lit("0"), F.substring(x, 3, 20)), 16, 10)).when(x.rlike("^0[0-7]+$"), F.conv(x, 8, 10)).when(x.rlike("^(?:0|[1-9][0-9]*)$"), x).try_cast("long")
    values = F.transform(parts, number)
    bound = lambda i: F.when(i < n - 1, F.lit(256)).otherwise(F.pow(F.lit(256), 5 - n))
    fits = n.between(1, 4) & F.forall(F.transform(values, lambda x, i: F.coalesce((x < bound(i)), F.lit(False))), lambda ok: ok)
    weighted = F.transform(values, lambda x, i: F.when(i < n - 1, x * F.pow(F.lit(256), 3 - i).cast("long")).otherwise(x))
    return F.when(fits, F.aggregate(weighted, F.lit(0).cast("long"), lambda a, x: a + x))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_string(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def root_domain(name: Column) -> Column:
    """Last two labels of a host, three where the last two are a public suffix."""
    labels = F.split(name, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".")
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), three).otherwise(two)


def generalised(url: Column) -> Column:
    """The path with numeric, hexadecimal and long segments replaced by placeholders."""
    out = F.regexp_replace(path(url), r"/[0-9]+(/|$)", "/{id}$1")
    out = F.regexp_replace(out, r"/[0-9a-f]{8}-[0-9a-f-]{27}(/|$)", "/{uuid}$1")
    return F.regexp_replace(out, r"/[A-Za-z0-9_-]{20,}(/|$)", "/{token}$1")


def volatility_key(url: Column) -> Column:
    return F.concat(host(url), F.regexp_replace(path(url), r"/[0-9]+", "/{id}"))


def without_page(url: Column) -> Column:
    """The URL without parameters that page through results."""
    names = "|".join(PAGE_PARAMS)
    out = F.regexp_replace(url, rf"([?&])(?:{names})=[^&#]*", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"[?&]+($|#)", "$1"), r"([?&])&+", "$1")


def with_page(url: Column, number: Column) -> Column:
    """The URL with its page parameter set, appended where it has none."""
    has = url.rlike(r"[?&]page=")
    glue = F.when(F.contains(url, F.lit("?")), "&").otherwise("?")
    return F.when(has, F.regexp_replace(url, F.lit(r"([?&]page=)[^&#]*"), F.concat(F.lit("$1"), number.cast("string")))).otherwise(F.concat(url, glue, F.lit("page="), number.cast("string")))


def endpoint(url: Column) -> Column:
    """Scheme, host and path."""
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*)", 1)


def resolved(base: Column, link: Column) -> Column:
    """An absolute form of a link on a page."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    folder = F.regexp_replace(endpoint(base), r"[^/]*$", "")
    return F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(F.startswith(link, F.lit("//")), F.concat(scheme, link)).when(F.startswith(link, F.lit("/")), F.concat(origin, link)).otherwise(F.concat(folder, link))


def embedding_text(url: Column) -> Column:
    """Host and the words of the path that are no identifiers."""
    words = F.filter(F.split(path(url), "/"), lambda s: (F.length(s) > 0) & ~s.rlike(r"^[0-9]+$") & (F.length(s) < 20))
    return F.concat_ws(" ", host(url), F.array_join(words, " "))


def looks_like_api(url: Column) -> Column:
    static = url.rlike(r"(?i)\.(?:js|css|png|jpe?g|gif|svg|woff2?|ico|map)(?:\?|$)")
    return ~static & url.rlike(r"(?i)/api/|/v[0-9]+/|/graphql|\.json(?:\?|$)|^https?://api\.")


def glob(pattern: str) -> str:
    """A regular expression for a glob: * any characters, ? one."""
    import re

    return "^" + re.escape(pattern).replace(r"\*", ".*").replace(r"\?", ".") + "$"


def in_list(name: Column, domains: Sequence[str]) -> Column:
    """Whether a host is one of the domains, under one, or matches one given as a glob."""
    out = F.lit(False)
    for d in domains:
        out = out | (name.rlike(glob(d)) if "*" in d else (name == d) | F.endswith(name, F.lit("." + d)))
    return out


#: Names of cloud metadata services; ranges of addresses that are no public hosts (first, last).
METADATA_HOSTS = ("instance-data", "metadata.google.internal", "metadata.gke.io")
LOCAL_RANGES = (("0.0.0.0", "0.0.0.0"), ("10.0.0.0", "10.255.255.255"), ("100.100.100.200", "100.100.100.200"), ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.168.0.0", "192.168.255.255"))
LOCAL_NAMES = ("localhost", "localhost.localdomain")


def is_safe(url: Column) -> Column:
    """Whether a URL is http(s) and points at no loopback, private, link-local or metadata address; malformed ones are unsafe."""
    name = host(url)
    number = ipv4(name)
    # a host whose last label is a number is an address, so it must be a good one
    numeric = name.rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)$")
    six = F.regexp_extract(name, r"^\[(.*)\]$", 1)
    mapped = F.regexp_extract(six, r"^(?:0*:)*(?:0*:)?ffff:([0-9.]+)$", 1)
    whole = six.rlike(r"^[0-9a-f:.]+$") & F.contains(six, F.lit(":"))
    closed = six.rlike(r"^(?:0*:)*:?0*1?$") | six.rlike("^(?:fe[89ab]|f[cd])") | ((mapped != "") & ~F.coalesce(is_public(ipv4(mapped)), F.lit(False)))
    named = name.isin(*LOCAL_NAMES, *METADATA_HOSTS) | F.endswith(name, F.lit(".localhost"))
    address = F.startswith(name, F.lit("["))
    good = F.when(address, whole & ~closed).when(numeric, F.coalesce(is_public(number), F.lit(False))).otherwise(~named)
    return url.rlike(r"^(?i)https?://") & (name != "") & ~name.rlike(r"[\x00-\x20<>^|%\\]") & good


def is_public(number: Column) -> Column:
    """Whether the number of an IPv4 address lies in none of the local ranges."""
    octets = lambda x: sum(int(o) << 8 * i for i, o in enumerate(reversed(x.split("."))))
    out = number.isNotNull()
    for first, last in LOCAL_RANGES:
        out = out & ~number.between(octets(first), octets(last))
    return out


def domain_class(name: Column) -> Column:
    """A coarse class of site from its host."""
    return F.when(name.rlike(r"\.gov(?:\.|$)"), "government").when(name.rlike(r"\.edu(?:\.|$)|\.ac\."), "education").when(name.rlike(r"^(?:docs?|api|developer)\."), "technical").when(name.rlike(r"^(?:blog|news)\."), "news").otherwise("general")


def content_type(url: Column) -> Column:
    """A coarse class of page from its URL."""
    p = F.lower(url)
    return F.when(p.rlike(r"\.pdf(?:\?|$)"), "pdf").when(p.rlike(r"/(?:blog|news|article)"), "article").when(p.rlike(r"/(?:product|item|shop)"), "product").when(p.rlike(r"/(?:search|find)|[?&]q="), "search").otherwise("page")
