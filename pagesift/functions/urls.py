"""URL columns. The split is the generic-syntax regular expression, so that no URL is an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
)

TEXT_FRAGMENT = "#:~:text="

#: fixed values: schemes a checked URL may have
SCHEMES = ("http", "https", "socks4", "socks4h", "socks5", "socks5h")
MIN_PORT, MAX_PORT = 1, 65535

#: fixed values: schemes after which an empty network location is kept as ``//``
LOCATED_SCHEMES = (
    "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp", "snews", "prospero", "rtsp",
    "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services",
)

#: fixed values: pattern of the sites and words that mark a result as one about search tricks.
#: The plus sign is not escaped and so repeats the letter before it; results depend on that.
BLACKLIST = (
    r"(?:kb\.cert\.org|exploit-db\.com"
    r"|googledork|google+dork|google-dork|google_dork|google%20dork"
    r"|googlehack|google+hack|google-hack|google_hack|google%20hack)"
)


def _clean(url: Column) -> Column:
    """Without leading control characters and blanks, and without tabs and line ends."""
    return F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(_clean(url), _SPLIT, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def host(url: Column) -> Column:
    """Lower-case host name without user information and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":[^:\]]*$", ""))


def extension(url: Column) -> Column:
    """Lower-case extension of the last path segment, or an empty string."""
    return F.lower(F.regexp_extract(path(url), r"\.([^./]*)$", 1))


def _prefixed(mark: str, part: Column) -> Column:
    return F.when(part == "", "").otherwise(F.concat(F.lit(mark), part))


def _prefixed_scheme(url: Column) -> Column:
    s = scheme(url)
    return F.when(s == "", "").otherwise(F.concat(s, F.lit(":")))


def _located(url: Column) -> Column:
    """Network location and path. Without a location, ``//`` stands where the scheme or the path asks for one."""
    p, n = path(url), netloc(url)
    located = scheme(url).isin(*LOCATED_SCHEMES) & ((p == "") | p.startswith("/"))
    return (
        F.when(n != "", F.concat(F.lit("//"), n, p))
        .when(p.startswith("//") | located, F.concat(F.lit("//"), p))
        .otherwise(p)
    )


def normalize(url: Column) -> Column:
    """Split and rebuilt: lower-case scheme, no empty query or fragment mark."""
    return F.concat(
        _prefixed_scheme(url),
        _located(url),
        _prefixed("?", query(url)),
        _prefixed("#", fragment(url)),
    )


def redirected(url: Column, final_url: Column) -> Column:
    return normalize(url) != final_url


def _recoded(part: Column) -> Column:
    """A part of a query in one way of percent-coding; one that can't be decoded stays as it is."""
    return F.coalesce(F.url_encode(F.try_url_decode(part)), part)


def _recoded_path(part: Column) -> Column:
    """A path in one way of percent-coding. Coded slashes and question marks are no separators, a plus sign is no blank."""
    kept = F.regexp_replace(F.regexp_replace(part, r"\+", "%2B"), r"(?i)%(2f|3f)", "%25$1")
    coded = F.url_encode(F.try_url_decode(kept))
    plain = F.regexp_replace(F.replace(F.replace(coded, F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")), r"(?i)%25(2f|3f)", "%$1")
    return F.coalesce(F.regexp_replace(F.replace(plain, F.lit("%2f"), F.lit("%2F")), "%3f", "%3F"), part)


def canonical(url: Column) -> Column:
    """One form for URLs that lead to the same request: percent-coding alike, parameters sorted, no fragment."""
    pairs = F.transform(
        F.filter(F.split(query(url), "&"), lambda p: p != ""),
        lambda p: F.struct(
            _recoded(F.substring_index(p, "=", 1)).alias("name"),
            _recoded(F.regexp_replace(p, r"^[^=]*=?", "")).alias("value"),
        ),
    )
    sorted_query = F.array_join(
        F.transform(F.sort_array(pairs), lambda p: F.concat(p["name"], F.lit("="), p["value"])), "&"
    )
    p = _recoded_path(path(url))
    return F.concat(
        _prefixed_scheme(url),
        _prefixed("//", F.lower(netloc(url))),
        F.when(p == "", "/").otherwise(p),
        _prefixed("?", sorted_query),
    )


def url_problem(url: Column) -> Column:
    """Why a URL is not acceptable, or ``ok``; the first reason counts."""
    s, n = scheme(url), netloc(url)
    port = F.regexp_extract(F.regexp_replace(n, r"^.*@", ""), r":([^:\]]*)$", 1)
    number = port.try_cast("int")
    return (
        F.when(F.coalesce(s, F.lit("")) == "", "scheme_missing")
        .when(~s.isin(*SCHEMES), "scheme_not_allowed")
        .when(n == "", "no_network_location")
        .when(
            (port != "") & ~F.coalesce(number.between(MIN_PORT, MAX_PORT), F.lit(False)),
            "port_out_of_range",
        )
        .otherwise("ok")
    )


def strip_text_fragment(url: Column) -> Column:
    return F.substring_index(url, TEXT_FRAGMENT, 1)


def file_base(url: Column) -> Column:
    """Last path segment, else the network location."""
    last = F.regexp_extract(F.regexp_replace(path(url), r"^/+|/+$", ""), r"([^/]*)$", 1)
    return F.when(last == "", netloc(url)).otherwise(last)
