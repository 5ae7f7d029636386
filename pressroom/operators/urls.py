"""URL corpus operators: allow-list, public hosts, validation with a reject reason, first occurrences, seen set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import address_hex, ip_is_public, ipv4_is_public, network_prefixes
from ..functions.text import trim_space
from ..functions.urls import (
    ascii_host,
    default_port,
    host_suffixes,
    idna_ascii,
    is_ascii,
    normalize_parts,
    parts_of,
    split_url,
)
from .skew import first_per_key

MAX_URL_BYTES = 2048


def clean_domains(domains: Sequence[str]) -> list[str]:
    """Lower-case entries without blanks and closing dots."""
    cleaned = (d.strip().lower().removesuffix(".") for d in domains)
    return [d for d in cleaned if d]


def domain_allowed(host: Column, domains: Sequence[str]) -> Column:
    """Host equals an entry or ends with '.' + entry; an empty list allows every host."""
    domains = clean_domains(domains)
    if not domains:
        return F.lit(True)
    return F.arrays_overlap(host_suffixes(host), F.array(*[F.lit(d) for d in domains]))


def allow_domains(df: DataFrame, host: str, domains: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose host is on the allow-list table (column ``domain``).

    The list may have any length: host suffixes are matched by equality on the distinct hosts, then the rows follow by
    host. Spark broadcasts whichever side its own size check allows.
    """
    entries = domains.select(F.regexp_replace(F.lower(F.trim("domain")), r"\.\z", "").alias("_suffix"))
    entries = entries.filter("_suffix != ''").distinct()
    hosts = df.select(host).distinct()
    suffixes = hosts.select(host, F.explode(host_suffixes(host)).alias("_suffix"))
    allowed = suffixes.join(entries, "_suffix", "left_semi").select(host).distinct()
    return df.join(allowed, host, how)


def host_verdicts(dns: DataFrame) -> DataFrame:
    """DNS snapshot (host, ip) → one row per host: is every address public?"""
    return dns.groupBy("host").agg(F.min(ip_is_public("ip")).alias("all_public"))


def in_networks(addresses: DataFrame, networks: DataFrame, ip: str = "ip", network: str = "network") -> DataFrame:
    """Distinct (ip, network): the networks of a table, CIDR text of either version, that each address lies in.

    Every network is a few prefixes of hex digits, so that lying in it is an equality of prefixes: an address is looked up once per prefix length that
    occurs, 33 at most, and no range is compared with every address. Malformed text on either side matches nothing.
    """
    ranges = networks.select(F.col(network).alias("network")).distinct()
    ranges = ranges.select("network", F.explode(network_prefixes("network")).alias("_prefix"))
    lengths = [row[0] for row in ranges.select(F.length("_prefix")).distinct().collect()]  # of 0 to 32
    if not lengths:
        return addresses.select(F.col(ip).alias("ip"), F.lit(None).cast("string").alias("network")).limit(0)
    hosts = addresses.select(F.col(ip).alias("ip")).distinct().withColumn("_digits", address_hex("ip"))
    looked_up = hosts.select("ip", F.explode(F.array(*[F.substring("_digits", 1, n) for n in lengths])).alias("_prefix"))
    return looked_up.join(ranges, "_prefix").select("ip", "network").distinct()


def host_verdicts_by_table(dns: DataFrame, networks: DataFrame) -> DataFrame:
    """:func:`host_verdicts` with the networks that are not public given as a table (column ``network``): they are data and may be any number."""
    inside = in_networks(dns, networks).select("ip").distinct().withColumn("_inside", F.lit(True))
    joined = dns.join(inside, "ip", "left")
    fine = address_hex("ip").isNotNull() & F.col("_inside").isNull()
    return joined.groupBy("host").agg(F.min(fine).alias("all_public"))


def validate_urls(
    df: DataFrame,
    url: str = "url",
    allow_http: bool = False,
    allowed_domains: Sequence[str] | DataFrame = (),
    dns: DataFrame | None = None,
    idna: bool = True,
) -> DataFrame:
    """Add ``host``, ``normalized_url`` and ``reject_reason`` (NULL when the URL is accepted).

    The reasons are tested in a fixed order and the first that holds wins. Length and control characters are tested on
    the text as given, the rest after trimming. With a DNS snapshot, hosts without an address or with any address that
    is not public are rejected too; an IPv4 literal stands for itself. ``idna=False`` leaves out the Python stage for
    host names in other scripts, for tables known to have none.
    """
    raw = F.col(url)
    # a longer text is refused as it is, so it is never cut up
    short = F.when(F.octet_length(raw) <= MAX_URL_BYTES, raw)
    # one column per step: Spark does not merge steps whose result is used more than once
    df = df.withColumn("_pieces", split_url(short)).withColumn("_parts", parts_of(F.col("_pieces"))).drop("_pieces")
    parts = F.col("_parts")
    if idna:
        df = df.withColumn("_idna", idna_ascii(F.when(~is_ascii(parts["host"]), parts["host"])))
        host = F.when(is_ascii(parts["host"]), ascii_host(parts["host"])).otherwise(F.col("_idna"))
    else:
        host = F.when(is_ascii(parts["host"]), ascii_host(parts["host"]))
    df = df.withColumn("_host", host)
    host = F.col("_host")

    if isinstance(allowed_domains, DataFrame):
        listed = allow_domains(df.select("_host").distinct(), "_host", allowed_domains).withColumn("_listed", F.lit(True))
        df = df.join(listed, "_host", "left")
        allowed = F.coalesce(F.col("_listed"), F.lit(False))
    else:
        allowed = F.coalesce(domain_allowed(host, allowed_domains), F.lit(False))

    if dns is not None:
        verdicts = host_verdicts(dns).withColumnRenamed("host", "_host")
        df = df.join(verdicts, "_host", "left")
        public = F.coalesce(ipv4_is_public(host), F.col("all_public"))
    else:
        public = F.coalesce(ipv4_is_public(host), F.lit(True))

    reason = (
        F.when(raw.isNull() | (raw == "") | (F.octet_length(raw) > MAX_URL_BYTES), F.lit("empty_or_too_long"))
        .when(raw.rlike(r"[\x00-\x1f]"), F.lit("control_character"))
        .when(parts.isNull() | (parts["host"] == ""), F.lit("unparsable"))
        .when(~parts["scheme"].isin("http", "https"), F.lit("unsupported_scheme"))
        .when((parts["scheme"] == "http") & F.lit(not allow_http), F.lit("http_not_allowed"))
        .when(parts["userinfo"].isNotNull(), F.lit("credentials"))
        .when(host.isNull(), F.lit("bad_hostname"))
        .when(~allowed, F.lit("domain_not_allowed"))
        .when(~parts["port"].isin("", default_port(parts["scheme"])), F.lit("non_default_port"))
        .when(public.isNull(), F.lit("unresolved"))
        .when(~public, F.lit("not_public"))
    )
    df = df.withColumn("reject_reason", reason)
    accepted = F.col("reject_reason").isNull()
    return (
        df.withColumn("host", F.when(accepted, host))
        .withColumn("normalized_url", F.when(accepted, normalize_parts(parts, host)))
        .drop("_parts", "_idna", "_host", "_listed", "all_public")
    )


def valid_scrape_request(df: DataFrame, url: str = "url") -> DataFrame:
    """Single-URL intake: 8 to 2048 characters before trimming; adds ``reject_reason`` and trims the URL."""
    length = F.char_length(F.col(url))
    reason = F.when(length.isNull() | (length < 8), F.lit("too_short")).when(length > 2048, F.lit("too_long"))
    return df.withColumn("reject_reason", reason).withColumn(url, trim_space(url))


def dedupe_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Keep the first row of every key in the order. ``order`` must be a total order inside a key."""
    return first_per_key(df, [key], [F.col(c) for c in order])


def unseen(df: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the seen set. Reduce ``df`` to first occurrences before: then no key is hot."""
    return df.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def write_seen(seen: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None) -> None:
    """The seen set as a table bucketed and sorted by its keys: against it, :func:`unseen_in_table` moves the new rows only."""
    writer = seen.select(*keys).distinct().write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite")
    (writer if path is None else writer.option("path", path)).saveAsTable(name)


def unseen_in_table(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    """:func:`unseen` against a table of :func:`write_seen`. Its buckets are joined where they lie; the new rows are dealt out to them by key."""
    seen = df.sparkSession.table(name).select(*keys)
    return df.join(seen.hint("merge"), list(keys), "left_anti")


def merge_seen(seen: DataFrame, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The seen set after this batch."""
    return seen.select(*keys).unionByName(df.select(*keys)).distinct()
