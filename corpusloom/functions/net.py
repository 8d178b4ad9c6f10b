"""Addresses: which IPs are private or reserved, and which URLs are safe to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import urls

# Fixed values.
PRIVATE_RANGES = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "224.0.0.0/4",
    "240.0.0.0/4",
    "255.255.255.255/32",
)
BLOCKED_HOSTS = ("localhost", "localhost.localdomain", "ip6-localhost", "metadata.google.internal")
METADATA_IPS = ("169.254.169.254", "fd00:ec2::254")
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z"
IPV6 = r"^(?=.*:.*:)[0-9A-Fa-f:]+(?:\.[0-9]+){0,3}\z|^::(?:[0-9A-Fa-f]{1,4}:)*(?:[0-9]{1,3}\.){3}[0-9]{1,3}\z"


def ipv4_number(ip: Column) -> Column:
    return F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))


def bounds(cidr: str) -> tuple[int, int]:
    """First and last address of a range."""
    address, bits = cidr.split("/")
    number = sum(int(x) << s for x, s in zip(address.split("."), (24, 16, 8, 0), strict=True))
    size = 1 << (32 - int(bits))
    low = number // size * size
    return low, low + size - 1


def private_ranges(spark: SparkSession) -> DataFrame:
    """(cidr, low, high): the 15 ranges as a table, small enough to be sent to every task at any size of the other side."""
    return spark.createDataFrame([(c, *bounds(c)) for c in PRIVATE_RANGES], "cidr string, low long, high long")


def matching_ranges(ips: DataFrame, ip: str = "ip") -> DataFrame:
    """The rows of ips with each private range that holds their IPv4 address."""
    ranges = F.broadcast(private_ranges(ips.sparkSession))
    n = ipv4_number(F.when(F.col(ip).rlike(IPV4), F.col(ip)))
    return ips.join(ranges, n.between(F.col("low"), F.col("high")))


def is_private(ip: Column) -> Column:
    """Private, reserved, or not understood."""
    low = F.lower(ip)
    mapped = F.regexp_extract(low, r"^::ffff:([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)\z", 1)
    v4 = F.when(ip.rlike(IPV4), ip).when(mapped != "", F.when(mapped.rlike(IPV4), mapped))
    n = ipv4_number(v4)
    inside = F.lit(False)
    for cidr in PRIVATE_RANGES:
        inside = inside | n.between(*bounds(cidr))
    v6 = low.isin("::1", "::") | low.rlike("^(?:fc|fd|fe8|fe9|fea|feb)")
    return F.when(ip.isNull(), True).when(ip.isin(*METADATA_IPS), True).when(v4.isNotNull(), inside).when(mapped != "", True).when(ip.rlike(IPV6), v6).otherwise(True)


# The messages.
NOT_VALID, SCHEME, HOST, ADDRESS = "Not a valid URL", 'Unsupported scheme "%s:" — only http/https are allowed', 'Hostname "%s" is not allowed', "IP address %s is a private/reserved address"
LOOKUP_FAILED, UNRESOLVED, RESOLVES = 'DNS lookup failed for "%s"', 'Could not resolve hostname "%s"', 'Hostname "%s" resolves to a private/reserved address (%s)'


def url_problem(url: Column) -> Column:
    """Why a URL may not be fetched, as far as its text tells; null where it may."""
    scheme, h = urls.protocol(url), urls.host(url)
    return (
        F.when((scheme == "") | (scheme.isin("http", "https") & (h == "")), NOT_VALID)
        .when(~scheme.isin("http", "https"), F.format_string(SCHEME, scheme))
        .when(h.isin(*BLOCKED_HOSTS) | h.endswith(".local"), F.format_string(HOST, h))
        .when(h.rlike(IPV4) & is_private(h), F.format_string(ADDRESS, h))
    )


def checked(candidates: DataFrame, dns: DataFrame) -> DataFrame:
    """candidates (url, …) with safe and reason; dns (host, ip) holds what hosts resolve to. A host in the URL that is an IP is not looked up."""
    found = dns.groupBy(F.lower("host").alias("__host")).agg(F.min(F.when(is_private(F.col("ip")), F.col("ip"))).alias("__bad"), F.count("ip").alias("__ips"))
    h = urls.host(F.col("url"))
    joined = candidates.withColumn("__host", h).join(found, "__host", "left")
    looked_up = ~h.rlike(IPV4)
    reason = (
        F.when(url_problem(F.col("url")).isNotNull(), url_problem(F.col("url")))
        .when(looked_up & F.col("__ips").isNull(), F.format_string(LOOKUP_FAILED, h))
        .when(looked_up & (F.col("__ips") == 0), F.format_string(UNRESOLVED, h))
        .when(looked_up & F.col("__bad").isNotNull(), F.format_string(RESOLVES, h, F.col("__bad")))
    )
    return joined.withColumn("reason", reason).withColumn("safe", F.col("reason").isNull()).drop("__host", "__bad", "__ips")
