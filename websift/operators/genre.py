"""Page genre by rules (S9), known domains (J18) and model fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Meta markers checked in this order inside each meta value.
META_RULES = [("og:article", "article"), ("og:book", "product"), ("og:website", "website"),
              ("og:profile", "social")]
# Domains whose genre is known without classification.
KNOWN_DOMAINS = [("wikipedia.org", "article"), ("github.com", "product"), ("youtube.com", "website"),
                 ("facebook.com", "social"), ("twitter.com", "social")]
DEFAULT_GENRE = "default"


def _meta_genre(m: Column) -> Column:
    lm = F.lower(m)
    out = None
    for marker, genre in META_RULES:
        out = F.when(lm.contains(marker), F.lit(genre)) if out is None else out.when(lm.contains(marker), F.lit(genre))
    return out


def rule_genre(body: Column, meta: Column) -> Column:
    """First meta value with a marker decides; else keyword rules on the body."""
    from_meta = F.try_element_at(F.filter(F.transform(F.coalesce(meta, F.array().cast("array<string>")), _meta_genre),
                                      lambda x: x.isNotNull()), F.lit(1))
    b = F.lower(F.coalesce(body, F.lit("")))
    product = ((b.contains("install") | b.contains("get started")) & b.contains("version")) | \
        (b.contains("maintained") & b.contains("develop"))
    article = (b.contains("author") & b.contains("article")) | b.contains("written by") | b.contains("further reading")
    from_body = F.when(product, "product").when(article, "article").otherwise(DEFAULT_GENRE)
    return F.coalesce(from_meta, from_body)


def known_domains(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN_DOMAINS, "base_url string, known_genre string")


def classify(sites: DataFrame, known: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """Known domain first, then a model prediction, then the rules.

    ``sites`` (id, base_url, text, metadata[]); ``model`` (id, model_genre).
    The known-domain table is fixed and tiny, hence broadcast."""
    s = sites.join(F.broadcast(known), "base_url", "left")
    if model is not None:
        s = s.join(model, "id", "left")
    else:
        s = s.withColumn("model_genre", F.lit(None).cast("string"))
    genre = F.coalesce("known_genre", "model_genre", rule_genre(F.col("text"), F.col("metadata")))
    source = F.when(F.col("known_genre").isNotNull(), "known_domain") \
        .when(F.col("model_genre").isNotNull(), "model").otherwise("rules")
    return s.select("id", genre.alias("genre"), source.alias("genre_source"))
