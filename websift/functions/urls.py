"""URL column functions: host, registrable domain, path parts, sitemap candidates.

All JVM-side expressions.  The registrable-domain lookup (longest public
suffix) is written as bounded equi-joins on the *distinct* hosts against a
small rule table, then joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# The suffix rules the tests use (exact, wildcard, exception);
# treating example.* as suffixes makes the label before them the site.
DEFAULT_SUFFIX_RULES = ["com", "net", "org", "co.uk", "example.com", "example.net",
                        "example.org", "*.ck", "!www.ck"]

# scheme://[user@]host[:port]... ; host is group 1.
HOST_PATTERN = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#:@]+@)?([^/?#:]+)"
IPV4_PATTERN = r"^[0-9]+(\.[0-9]+){3}$"


def host(url: Column) -> Column:
    """Lower-cased host of an absolute URL; NULL for relative or host-less URLs."""
    h = F.lower(F.regexp_extract(url, HOST_PATTERN, 1))
    return F.when(h != "", h)


def suffix_rules(spark: SparkSession, rules: list[str] | None = None) -> DataFrame:
    """Rule table (key, kind): kind exact / wild (``*.key``) / exc (``!key``)."""
    rows = []
    for r in rules or DEFAULT_SUFFIX_RULES:
        r = r.strip().lower()
        if not r or r.startswith("//"):
            continue
        if r.startswith("!"):
            rows.append((r[1:], "exc"))
        elif r.startswith("*."):
            rows.append((r[2:], "wild"))
        else:
            rows.append((r, "exact"))
    return spark.createDataFrame(rows, "key string, kind string")


def registrable_domains(hosts: DataFrame, rules: DataFrame, host_col: str = "host") -> DataFrame:
    """Map each distinct host to its registrable domain (``root``).

    Returns (host, root).  Public-suffix algorithm: an exception rule wins and
    its suffix is the rule minus its first label; otherwise the matching rule
    with most labels; with no rule the last label is the suffix.  The domain is
    the suffix plus one label; IP addresses and bare suffixes give NULL.

    The rule table is tiny and of fixed size, so it is broadcast; hosts are
    de-duplicated before the suffix explode (as many rows per host as the
    longest rule has labels).
    """
    longest = rules.agg(F.max(F.size(F.split("key", r"\.")))).first()[0] or 1  # a scalar of the rule table
    h = (hosts.select(F.col(host_col).alias("host")).where(F.col("host").isNotNull())
         .distinct()
         .withColumn("labels", F.split("host", r"\."))
         .withColumn("n", F.size("labels")))
    cand = h.select("host", "labels", "n", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(longest)))).alias("k")) \
        .withColumn("suffix", F.array_join(F.slice("labels", F.col("n") - F.col("k") + 1, F.col("k")), "."))
    # left join: a host without any matching rule keeps its rows (default suffix = last label)
    m = cand.join(F.broadcast(rules), cand.suffix == rules.key, "left")
    ps = F.when(m.kind == "exact", m.k).when((m.kind == "wild") & (m.n > m.k), m.k + 1)
    per_host = m.groupBy("host").agg(
        F.max(F.when(m.kind == "exc", m.k - 1)).alias("exc_len"), F.max(ps).alias("rule_len"),
        F.first("labels").alias("labels"), F.first("n").alias("n"))
    ps_len = F.coalesce("exc_len", "rule_len", F.lit(1))
    return per_host.select("host", F.when(~F.col("host").rlike(IPV4_PATTERN) & (F.col("n") > ps_len),
                                          F.array_join(F.slice("labels", F.col("n") - ps_len, ps_len + 1), "."))
                           .alias("root"))


def with_root(df: DataFrame, url_col: str, rules: DataFrame, prefix: str = "") -> DataFrame:
    """Add ``{prefix}host`` and ``{prefix}root`` columns for a URL column."""
    hc, rc = f"{prefix}host", f"{prefix}root"
    d = df.withColumn(hc, host(F.col(url_col)))
    roots = registrable_domains(d.select(hc), rules, hc).withColumnRenamed("host", hc).withColumnRenamed("root", rc)
    # one row per distinct host: broadcast back when its measured size allows
    return d.join(roots, hc, "left")


def url_path_parts(url: Column) -> Column:
    """Path of an absolute URL split by '/', empty parts dropped."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda x: x != "")


def sitemap_candidates(base: Column) -> Column:
    """The two sitemap URLs tried for a site."""
    return F.array(F.concat(F.lit("https://"), base, F.lit("/sitemap.xml")),
                   F.concat(F.lit("http://"), base, F.lit("/sitemap.xml")))
