"""Queries over the star-schema tables: money, geo, phonetic, paths, orders, joins, export."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import export as EX
from ..operators import geo_money as GM
from . import sqlkit as S
from .context import ctx
from .registry import register

# Currency of a customer: by its key, every currency of the rate table and one that has no rate.
CURRENCIES = [GM.DEFAULT_CURRENCY, *(b for a, b, _ in GM.RATES if a == GM.DEFAULT_CURRENCY), "XXX"]
GEO_POINT, GEO_KM = (45.0, 10.0), 2500.0
RANDOM_SEED = 7
HASH_MUL, HASH_MOD = 1103515245, 2147483648


def _money_sql() -> str:
    codes = "[" + ", ".join(S.lit(c) for c in CURRENCIES) + "]"
    conv = []
    for t in ("USD", "EUR", "NOK"):
        conv.append(f"round(c.c_acctbal * coalesce((SELECT rate FROM rates r WHERE r.src = c.code AND r.dst = '{t}'), "
                    f"(SELECT r1.rate FROM rates r1 WHERE r1.src = c.code AND r1.dst = 'USD') * "
                    f"(SELECT r2.rate FROM rates r2 WHERE r2.src = 'USD' AND r2.dst = '{t}')), 4) AS in_{t.lower()}")
    return f"""
WITH rates AS (SELECT src, dst, CAST(rate AS DOUBLE) AS rate FROM {S.values_table(GM.rate_rows(), ['src', 'dst', 'rate'])}),
c AS (SELECT c_custkey, c_acctbal, {codes}[(c_custkey % {len(CURRENCIES)}) + 1] AS code FROM customer)
SELECT c.c_custkey, c.code, round(c.c_acctbal, 4) AS amount, {', '.join(conv)} FROM c
"""


@register("money_convert", ops=("J14",), sql=_money_sql())
def money_convert(spark, sf_dir):
    c = ctx(spark, sf_dir).t("customer")
    codes = F.array(*[F.lit(x) for x in CURRENCIES])
    d = c.select("c_custkey", "c_acctbal", F.element_at(codes, (F.pmod("c_custkey", F.lit(len(CURRENCIES))) + 1).cast("int")).alias("code"))
    rates = GM.rate_table(spark)
    for t in ("USD", "EUR", "NOK"):
        d = GM.with_converted(d, "c_acctbal", "code", t, rates, f"in_{t.lower()}")
    return d.select("c_custkey", "code", F.round("c_acctbal", 4).alias("amount"),
                    *[F.round(f"in_{t.lower()}", 4).alias(f"in_{t.lower()}") for t in ("USD", "EUR", "NOK")])


@register("geo_within", ops=("F14",), sql=f"""
WITH g AS (SELECT c_custkey, CAST((c_custkey * 37 % 180) - 90 AS DOUBLE) AS lat, CAST((c_custkey * 91 % 360) - 180 AS DOUBLE) AS lon FROM customer),
d AS (SELECT c_custkey, lat, lon,
        {2 * GM.EARTH_RADIUS_KM} * asin(sqrt(pow(sin(radians({GEO_POINT[0]} - lat) / 2), 2)
          + cos(radians(lat)) * cos(radians({GEO_POINT[0]})) * pow(sin(radians({GEO_POINT[1]} - lon) / 2), 2))) AS dist
      FROM g)
SELECT c_custkey, lat, lon, round(dist, 3) AS dist_km FROM d WHERE dist <= {GEO_KM}
""")
def geo_within(spark, sf_dir):
    c = ctx(spark, sf_dir).t("customer")
    g = c.select("c_custkey", (F.pmod(F.col("c_custkey") * 37, F.lit(180)) - 90).cast("double").alias("lat"),
                 (F.pmod(F.col("c_custkey") * 91, F.lit(360)) - 180).cast("double").alias("lon"))
    return GM.within(g, "lat", "lon", GEO_POINT, GEO_KM).select("c_custkey", "lat", "lon",
                                                                 F.round("dist_km", 3).alias("dist_km"))


@register("geo_points", ops=("F14",), sql=f"""
WITH g AS (SELECT c_custkey, CAST((c_custkey * 37 % 180) - 90 AS DOUBLE) AS lat, CAST((c_custkey * 91 % 360) - 180 AS DOUBLE) AS lon FROM customer),
p AS (SELECT s_suppkey AS point_id, (s_suppkey * 53 % 179) - 88.75 AS plat, (s_suppkey * 71 % 360) - 179.75 AS plon,
             CAST(10 + 90 * (s_suppkey % 9) AS DOUBLE) AS km FROM supplier),
b AS (SELECT *, degrees(km / {GM.EARTH_RADIUS_KM}) AS dlat,
             CASE WHEN abs(plat) + degrees(km / {GM.EARTH_RADIUS_KM}) >= 90 THEN 180.0
                  ELSE degrees(asin(least(1.0, sin(km / {GM.EARTH_RADIUS_KM}) / cos(radians(plat))))) END AS dlon FROM p),
d AS (SELECT b.*, g.*, abs(lon - plon) AS turn, {2 * GM.EARTH_RADIUS_KM} * asin(least(1.0, sqrt(pow(sin(radians(plat - lat) / 2), 2)
             + cos(radians(lat)) * cos(radians(plat)) * pow(sin(radians(plon - lon) / 2), 2)))) AS dist FROM b, g)
SELECT 'circle' AS mode, point_id, c_custkey, round(dist, 3) AS dist_km FROM d WHERE dist <= km
UNION ALL SELECT 'box', point_id, c_custkey, round(dist, 3) FROM d WHERE abs(lat - plat) <= dlat AND least(turn, 360 - turn) <= dlon
""")
def geo_points(spark, sf_dir):
    """F14 for a batch: customers within a radius of every supplier, and in the box around it."""
    c = ctx(spark, sf_dir)
    g = c.t("customer").select("c_custkey", (F.pmod(F.col("c_custkey") * 37, F.lit(180)) - 90).cast("double").alias("lat"),
                               (F.pmod(F.col("c_custkey") * 91, F.lit(360)) - 180).cast("double").alias("lon"))
    key = F.col("s_suppkey")
    p = c.t("supplier").select(key.alias("point_id"), (F.pmod(key * 53, F.lit(179)) - F.lit(88.75)).alias("lat"),
                               (F.pmod(key * 71, F.lit(360)) - F.lit(179.75)).alias("lon"), (10 + 90 * F.pmod(key, F.lit(9))).cast("double").alias("km"))
    found = [GM.near_points(g, p, mode=m).select(F.lit(m).alias("mode"), "point_id", "c_custkey", F.round("dist_km", 3).alias("dist_km"))
             for m in ("circle", "box")]
    return found[0].unionByName(found[1])


@register("phonetic_match", ops=("F15",))
def phonetic_match(spark, sf_dir):
    """part-name words grouped by their sound code (soundex; no SQL oracle: DuckDB lacks it)."""
    p = ctx(spark, sf_dir).t("part")
    w = p.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")).where(F.col("word") != "")
    return w.groupBy(F.soundex("word").alias("code")).agg(
        F.countDistinct("p_partkey").alias("parts"), F.array_join(F.array_sort(F.collect_set("word")), " ").alias("words"))


@register("path_facet", ops=("F16", "G12"), sql=f"""
WITH parts AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages),
anc AS (SELECT page_id, unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], '/'))) AS path FROM parts)
SELECT path, CAST(count(DISTINCT page_id) AS BIGINT) AS pages FROM anc GROUP BY path
""")
def path_facet(spark, sf_dir):
    """F16: pages under every ancestor path of their URL (descendant-path facet)."""
    p = ctx(spark, sf_dir).t("pages")
    parts = p.select("page_id", U.url_path_parts(F.col("url")).alias("p")).where(F.size("p") > 0)
    anc = parts.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")),
                                                        lambda i: F.array_join(F.slice("p", 1, i), "/"))).alias("path"))
    return anc.groupBy("path").agg(F.countDistinct("page_id").cast("long").alias("pages"))


@register("random_order", ops=("O8",), sql=f"""
SELECT doc_id, CAST((doc_id * {HASH_MUL} + {RANDOM_SEED}) % {HASH_MOD} AS BIGINT) AS order_key FROM documents
""")
def random_order(spark, sf_dir):
    """All documents in a stable pseudo-random order per named seed, with the key of the order."""
    d = ctx(spark, sf_dir).t("documents").select("doc_id")
    key = F.pmod(F.col("doc_id") * HASH_MUL + RANDOM_SEED, F.lit(HASH_MOD)).cast("long")
    return d.select("doc_id", key.alias("order_key")).orderBy("order_key", "doc_id")


@register("alpha_sort", ops=("O9", "O7"), sql="""
SELECT p_partkey, regexp_replace(lower(trim(p_name)), '[^a-z]', '', 'g') AS sort_key, substring(p_name, 1, 1024) AS sort_text
FROM part
""")
def alpha_sort(spark, sf_dir):
    p = ctx(spark, sf_dir).t("part")
    return p.select("p_partkey", F.regexp_replace(F.lower(F.trim("p_name")), "[^a-z]", "").alias("sort_key"),
                    F.substring("p_name", 1, 1024).alias("sort_text"))


@register("boosted_order", ops=("O10", "O3"), sql="""
SELECT p_partkey, round(score, 6) AS score, CAST(pos AS BIGINT) AS pos FROM (
  SELECT p_partkey, p_size / 50.0 + p_retailprice / 1000.0 AS score,
         row_number() OVER (ORDER BY p_size / 50.0 + p_retailprice / 1000.0 DESC, p_partkey) AS pos FROM part)
WHERE pos <= 10
""")
def boosted_order(spark, sf_dir):
    """Top 10 parts by a relevance score boosted by a numeric field."""
    p = ctx(spark, sf_dir).t("part")
    s = p.select("p_partkey", (F.col("p_size") / 50.0 + F.col("p_retailprice") / 1000.0).alias("score"))
    top = s.orderBy(F.col("score").desc(), "p_partkey").limit(10)
    return top.select("p_partkey", F.round("score", 6).alias("score"),
                      F.row_number().over(Window.orderBy(F.col("score").desc(), "p_partkey")).cast("long").alias("pos"))


@register("companion_join", ops=("J16",), sql="""
SELECT s.s_suppkey, s.s_name, n.n_name FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
""")
def companion_join(spark, sf_dir):
    c = ctx(spark, sf_dir)
    return c.t("supplier").join(c.t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left") \
        .select("s_suppkey", "s_name", "n_name")


@register("feed_export", ops=("A10", "S31", "A8"), sql="""
WITH lines AS (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1)
SELECT o.o_orderkey AS doc_id,
  '<item><title>' || replace(replace(replace(o.o_orderpriority, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</title>'
  || '<link>order/' || CAST(o.o_orderkey AS VARCHAR) || '</link>'
  || '<pubDate>' || strftime(greatest(o.o_orderdate, coalesce(l.last_ship, o.o_orderdate)), '%Y-%m-%dT%H:%M:%SZ') || '</pubDate></item>' AS item
FROM orders o LEFT JOIN lines l ON l.l_orderkey = o.o_orderkey
""")
def feed_export(spark, sf_dir):
    """One feed item per imported document, last change as a UTC date."""
    c = ctx(spark, sf_dir)
    last = c.t("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    o = c.t("orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    lm = F.greatest(F.col("o_orderdate"), F.coalesce("last_ship", "o_orderdate"))
    return o.select(F.col("o_orderkey").alias("doc_id"),
                    EX.feed_item(F.col("o_orderpriority"), F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")),
                                 lm).alias("item"))
