"""URL functions as Column expressions.

Spark's own ``parse_url`` goes through ``java.net.URI`` and gives NULL for hosts with underscores or non-ASCII letters and
for any path with a space or a pipe, so the parts are cut out with RFC 3986's generic pattern instead.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import col, let, trim_space

# RFC 3986 appendix B, with the authority split further into userinfo, host and port. The marks stay with their parts
# ('?', '#', '@', '//'), which tells an empty part from a missing one.
_URL = (
    r"(?s)^(?:([^:/?#]+):)?(?:(//)([^/?#]*@)?(\[[^\]/?#]*\]|[^:@/?#\[\]]*)(?::(\d*))?(?=[/?#]|\z))?"
    r"([^?#]*)(\?[^#]*)?(#.*)?\z"
)
_PATH = r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)"
_SEPARATOR = "\x1f"  # a control character, which no valid URL holds
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
_SAFE_PATH = r"^(?:[A-Za-z0-9._~!$&'()*+,;=:@/\[\]-]|%[0-9A-Fa-f]{2})*+\z"
_USERINFO = r"^[A-Za-z0-9._:~!$&'()*+,;=%@-]*\z"
_HOST_FORBIDDEN = r"[\x00-\x20\x7f\\^`{|}%]"

# Paths that hold lists of articles rather than an article. The last three have no closing slash.
LISTING_PREFIXES = ("/tag/", "/tags/", "/topic/", "/topik/", "/search", "/indeks", "/index")

_DEFAULT_PORTS = {"http": "80", "https": "443"}


def split_url(url: Column | str) -> Column:
    """The eight pieces of a URL as an array, cut by one regular expression; a single element when it is no URL."""
    groups = _SEPARATOR.join(f"${i}" for i in range(1, 9))
    return F.split(F.regexp_replace(trim_space(url), _URL, groups), _SEPARATOR)


def parts_of(pieces: Column) -> Column:
    """STRUCT of the parts from :func:`split_url`; NULL when the URL cannot be parsed."""
    scheme, slashes, userinfo, host, port, path, query, fragment = (F.get(pieces, F.lit(i)) for i in range(8))
    bad = (
        (F.size(pieces) != 8)
        | ((scheme != "") & ~scheme.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*\z"))
        | ((slashes == "") & path.startswith("//"))
        | ((scheme == "") & (slashes == "") & path.rlike(r"^[^/]*:"))
        | F.concat(host, path, fragment).rlike(r"[\x00-\x1f\x7f]")
        | path.rlike(_BAD_ESCAPE)
        | fragment.rlike(_BAD_ESCAPE)
        | host.rlike(_HOST_FORBIDDEN)
        | ~userinfo.rlike(_USERINFO)
    )
    parts = F.struct(
        F.lower(scheme).alias("scheme"),
        F.when(userinfo != "", F.regexp_replace(userinfo, "@$", "")).alias("userinfo"),
        F.regexp_replace(host, r"^\[|\]$", "").alias("host"),
        port.alias("port"),
        path.alias("path"),
        F.when(query != "", F.substring(query, 2, 1 << 30)).alias("query"),
        F.when(fragment != "", F.substring(fragment, 2, 1 << 30)).alias("fragment"),
        (slashes != "").alias("has_authority"),
    )
    return F.when(~bad, parts)


def url_parts(url: Column | str) -> Column:
    """STRUCT of the URL's parts; NULL when it cannot be parsed.

    ``query`` is NULL when there is no ``?`` and '' when nothing follows it. ``host`` keeps its case and loses the
    brackets of an IPv6 literal.
    """
    return let(split_url(url), parts_of)


def escape_path(path: Column) -> Column:
    """Keep a well-formed path as written; otherwise decode it and percent-encode it again."""
    return let(path, _escape)


def _escape(path: Column) -> Column:
    encoded = F.url_encode(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))
    # url_encode writes form encoding. The characters that a path may hold unescaped, and '*', which may not.
    for escaped, plain in (
        ("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%2C", ","),
        ("%2F", "/"), ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@"),
    ):
        encoded = F.replace(encoded, F.lit(escaped), F.lit(plain))
    return F.when(path.rlike(_SAFE_PATH), path).otherwise(encoded)


def build_url(scheme: Column, host: Column, path: Column, query: Column, fragment: Column | None = None) -> Column:
    """Write the parts back as text; a NULL query or fragment leaves out its mark."""
    text = F.concat(scheme, F.lit("://"), host, path, F.coalesce(F.concat(F.lit("?"), query), F.lit("")))
    if fragment is None:
        return text
    return F.concat(text, F.coalesce(F.concat(F.lit("#"), F.nullif(fragment, F.lit(""))), F.lit("")))


def ascii_host(host: Column) -> Column:
    """Lower-case ASCII host without its closing dot; NULL when a label breaks the host-name rules."""
    # another character, a hyphen at either end of a label, two hyphens in third place other than after "xn", a second closing dot. Each is found by
    # one pass: a pattern with a group per label would recurse once per label, and strangers submit these names.
    bad = r"[^a-z0-9.-]|(?:^|\.)-|-(?:\.|\z)|(?:^|\.)(?!xn--)[a-z0-9-]{2}--|\.\z"
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(host, r"\.\z", "")), rf"(?s)^(?=.*?(?:{bad})).*\z", ""), F.lit(""))


@F.pandas_udf(StringType())
def idna_ascii(hosts: pd.Series) -> pd.Series:
    """Internationalised host names to their ASCII form; NULL stays NULL and a name that breaks the rules becomes NULL."""
    try:
        from idna import encode
    except ImportError:  # the standard library knows the older IDNA 2003 only
        def encode(name, **_):
            return name.encode("idna")

    known: dict[str, str | None] = {}

    def convert(host: str | None) -> str | None:
        if host is None:
            return None
        if host not in known:
            try:
                known[host] = encode(host.removesuffix("."), uts46=True, std3_rules=True).decode("ascii").lower()
            except (UnicodeError, ValueError):
                known[host] = None
        return known[host]

    return hosts.map(convert, na_action="ignore").astype(object).where(lambda s: s.notna(), None)


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7f]")


def normalize_parts(parts: Column, host: Column) -> Column:
    """Normal form from :func:`url_parts` and a checked ASCII host."""
    path = F.when(parts["path"] == "", F.lit("/")).otherwise(escape_path(parts["path"]))
    return build_url(parts["scheme"], host, path, parts["query"])


def normalize_url(url: Column | str) -> Column:
    """Normal form of a URL with an ASCII host: lower scheme and host, no default port, path at least '/', no fragment.

    NULL when it cannot be parsed or the host breaks the rules. Hosts in other scripts need
    :func:`pressroom.operators.urls.validate_urls`, which adds the one Python stage they need.
    """
    return let(url_parts(url), lambda parts: normalize_parts(parts, ascii_host(parts["host"])))


def default_port(scheme: Column) -> Column:
    return F.when(scheme == "http", F.lit(_DEFAULT_PORTS["http"])).otherwise(F.lit(_DEFAULT_PORTS["https"]))


def host_suffixes(host: Column | str) -> Column:
    """``a.b.c`` → [``a.b.c``, ``b.c``, ``c``]: turns "equal or ends with '.' + entry" into an equality."""
    labels = F.split(col(host), r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def is_listing(url: Column | str, prefixes: Sequence[str] = LISTING_PREFIXES) -> Column:
    """True for the home page and for tag, topic, search and index pages."""
    path = F.lower(F.regexp_extract(col(url), _PATH, 1))
    return path.rlike("^/?\\z" + "".join(f"|^{re.escape(p)}" for p in prefixes))


def _remove_dot_segments(path: Column) -> Column:
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    kept = F.reduce(
        segments,
        F.array().cast("array<string>"),
        lambda out, s: F.when(s == ".", out)
        .when(s == "..", F.when(F.size(out) > 0, F.slice(out, 1, F.size(out) - 1)).otherwise(out))
        .otherwise(F.array_append(out, s)),
    )
    tail = F.when(path.rlike(r"(^|/)\.\.?\z") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"), tail)
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(path.rlike(r"(^|/)\.\.?(/|\z)"), F.regexp_replace(joined, "^//", "/")).otherwise(rooted)


def resolve_url(base: Column | str, reference: Column | str) -> Column:
    """RFC 3986 section 5.2: the reference as an absolute URL; an unusable reference gives the base."""
    base, raw = col(base), col(reference)
    both = F.struct(url_parts(base).alias("b"), url_parts(raw).alias("r"))
    return let(both, lambda p: F.when(p["r"].isNull(), base).otherwise(_resolve(p["b"], p["r"], trim_space(raw))))


def _authority(parts: Column) -> Column:
    return F.concat(
        F.coalesce(F.concat(parts["userinfo"], F.lit("@")), F.lit("")),
        F.when(parts["host"].contains(":"), F.concat(F.lit("["), parts["host"], F.lit("]"))).otherwise(parts["host"]),
        F.when(parts["port"] != "", F.concat(F.lit(":"), parts["port"])).otherwise(F.lit("")),
    )


def _resolve(b: Column, r: Column, raw: Column) -> Column:
    path = r["path"]
    escaped = F.struct(escape_path(b["path"]).alias("b"), escape_path(path).alias("r"))
    merged = let(
        escaped,
        lambda p: F.when(r["has_authority"] | p["r"].startswith("/"), p["r"])
        .when(p["r"] == "", p["b"])
        .otherwise(F.concat(F.regexp_replace(p["b"], r"[^/]*\z", ""), p["r"])),
    )
    return let(_clean_path(merged), lambda clean: _written(b, r, raw, clean))


def _written(b: Column, r: Column, raw: Column, path: Column) -> Column:
    """Base and reference put together with the path that was found for them."""
    same_query = (r["path"] == "") & r["query"].isNull()
    same_fragment = same_query & (F.coalesce(r["fragment"], F.lit("")) == "")
    relative = build_url(
        b["scheme"],
        _authority(b),
        path,
        F.when(same_query, b["query"]).otherwise(r["query"]),
        F.when(same_fragment, b["fragment"]).otherwise(r["fragment"]),
    )
    scheme = F.when(r["scheme"] == "", b["scheme"]).otherwise(r["scheme"])
    absolute = build_url(scheme, _authority(r), path, r["query"], r["fragment"])
    # a scheme without an authority ("mailto:x") stays as it is
    return F.when(r["has_authority"], absolute).when(r["scheme"] != "", raw).otherwise(relative)


def _clean_path(path: Column) -> Column:
    return let(path, lambda p: F.when(p == "", p).otherwise(_remove_dot_segments(p)))
