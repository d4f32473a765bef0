"""URL expressions: parts, canonical form, host, candidate policy, address ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------------------------

TRACKING_PARAMETERS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "mc_eid", "_ga", "ref", "source")
HTTPS_HOSTS = ("arxiv.org", "export.arxiv.org", "europepmc.org", "pubmed.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov")
AUTH_PATHS = ("/login", "/signin", "/sign-in", "/account/login", "/accounts/login")
LISTING_PATHS = ("/search", "/results", "/browse", "/authors", "/author/", "/category/", "/tag/")
LISTING_KEYS = ("searchtype", "query", "q", "page", "offset", "start")
BINARY_MARKERS = ("/pdf/", "/pdf", ".pdf", ".docx", ".xlsx", ".pptx", "ptpmcrender.fcgi")
BLOCKED_IPV4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)

_SCHEME, _NETLOC = r"^([A-Za-z][A-Za-z0-9+.\-]*):", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
_PATH, _QUERY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", r"^[^?#]*\?([^#]*)"


def host(url: Column) -> Column:
    """Host in lower case, without user, port and a leading ``www.``; null where there is none."""
    raw = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    bare = F.regexp_replace(raw, r"^www\.", "")
    return F.when(bare != "", bare)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def authority(url: Column) -> Column:
    """Host with user and port, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(url, _NETLOC, 1))


def path(url: Column) -> Column:
    """Path without parameters after a semicolon in its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _PATH, 1), r";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, _QUERY, 1)


def contains_any(text: Column, markers: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers])


def _decoded(text: Column, plus: bool) -> Column:
    """Percent-decoded; left alone where an escape is bad. ``plus``: a plus sign is a space."""
    return F.coalesce(F.try_url_decode(text if plus else F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column, declared: Column | None = None) -> Column:
    """One form for the addresses of one page; null stays null.

    Scheme and host in lower case, https for hosts that serve it, no default port, no repeated
    slashes, path segments decoded except for an escaped slash (and with ``% ? #`` escaped again, so
    that the form is stable), parameters sorted and without tracking, no fragment. ``declared`` is a
    canonical link that counts instead where it starts with http.
    """
    target = F.trim(url)
    if declared is not None:
        target = F.when(declared.startswith("http"), F.trim(declared)).otherwise(target)
    net, plain = authority(target), scheme(target)
    plain = F.when((plain == "http") & net.isin(*HTTPS_HOSTS), "https").otherwise(plain)
    net = F.when(plain == "http", F.regexp_replace(net, ":80$", "")).when(plain == "https", F.regexp_replace(net, ":443$", "")).otherwise(net)
    parts = F.split(F.replace(path(target), F.lit("%2f"), F.lit("%2F")), "/")
    parts = F.filter(parts, lambda s, i: (s != "") | (i == 0) | (i == F.size(parts) - 1))

    def segment(s: Column) -> Column:
        pieces = F.transform(F.split(s, "%2F"), lambda p: F.replace(F.replace(F.replace(_decoded(p, False), F.lit("%"), F.lit("%25")), F.lit("?"), F.lit("%3F")), F.lit("#"), F.lit("%23")))
        return F.array_join(pieces, "%2F")

    way = F.array_join(F.transform(parts, segment), "/")
    way = F.when(way == "", "/").when(~way.startswith("/"), F.concat(F.lit("/"), way)).otherwise(way)
    pairs = F.transform(F.filter(F.split(query(target), "&"), lambda p: p != ""), lambda p: F.struct(_decoded(F.substring_index(p, "=", 1), True).alias("k"), F.when(F.contains(p, F.lit("=")), _decoded(F.regexp_extract(p, "=(.*)$", 1), True)).otherwise("").alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_PARAMETERS)))
    words = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.concat(F.when(plain != "", F.concat(plain, F.lit("://"))).otherwise(F.lit("")), net, way, F.when(words != "", F.concat(F.lit("?"), words)).otherwise(F.lit("")))


def rejection_reason(url: Column) -> Column:
    """Why a URL can't be a final source; null if it can. A null URL has no scheme."""
    url = F.coalesce(url, F.lit(""))
    way = F.regexp_replace(F.lower(path(url)), "/+$", "")
    way = F.when(way == "", "/").otherwise(way)
    words = F.lower(query(url))

    def under(markers: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, [(way == m) | way.startswith(m + "/") for m in markers])

    keys = F.transform(F.filter(F.split(words, "&"), lambda p: F.regexp_extract(p, "=(.+)$", 1) != ""), lambda p: F.substring_index(p, "=", 1))
    return (
        F.when(~scheme(url).isin("http", "https"), "UNSUPPORTED_SCHEME")
        .when(under(AUTH_PATHS), "AUTHENTICATION_URL")
        .when(contains_any(way, BINARY_MARKERS) | contains_any(words, BINARY_MARKERS), "BINARY_DOCUMENT_URL")
        .when(under(LISTING_PATHS), "SEARCH_LISTING_URL")
        .when(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in LISTING_KEYS])), "SEARCH_LISTING_URL")
        .when(way == "/", "DOMAIN_HOME_URL")
    )


def is_binary_document(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    return contains_any(F.lower(path(url)), BINARY_MARKERS) | contains_any(F.lower(query(url)), BINARY_MARKERS)


def matches_domain(url: Column, domain: str) -> Column:
    """The host is the domain or below it."""
    d = domain.lower().removeprefix("www.")
    return F.coalesce((host(url) == d) | host(url).endswith("." + d), F.lit(False))


def ipv4_number(address: Column) -> Column:
    """The address as a number; null unless it is four numbers up to 255."""
    parts = F.transform(F.split(address, r"\."), lambda p: p.try_cast("int"))
    good = address.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & ~F.exists(parts, lambda p: p > 255)
    return F.when(good, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p))


def is_blocked_ipv4(address: Column) -> Column:
    """The address is in a private, local, test, multicast or reserved range; null if it is no IPv4 address."""
    n = ipv4_number(address)
    tests = []
    for block in BLOCKED_IPV4:
        base, bits = block.split("/")
        low = reduce(lambda a, x: a * 256 + int(x), base.split("."), 0)
        tests.append(n.between(low, low + 2 ** (32 - int(bits)) - 1))
    return reduce(lambda a, b: a | b, tests)


def unwrapped(url: Column) -> Column:
    """The target of a redirect address (its ``uddg`` parameter), https added to an address that starts with ``//``."""
    full = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    inner = F.regexp_extract(full, r"[?&]uddg=([^&#]*)", 1)
    return F.when(inner != "", _decoded(inner, True)).otherwise(full)


def doi(text: Column) -> Column:
    """A DOI named in a text, or that a Nature or Springer address implies; null if none."""
    general = F.regexp_extract(text, r"(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)", 1)
    nature = F.regexp_extract(text, r"nature\.com/articles/([A-Za-z0-9\-]+)", 1)
    return F.when(general != "", F.regexp_replace(general, r"[.,;)]+$", "")).when(nature != "", F.concat(F.lit("10.1038/"), nature))
