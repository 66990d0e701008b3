"""Shared, lazily built frames of one (session, data folder).

Only logical plans are kept here; nothing is collected.  Frames that several
stages of one query reuse are built once so that Spark's exchange reuse can
share their shuffles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import analysis as AN
from ..operators import dictionary as DI
from ..operators import extract as X
from ..operators import index as IX
from ..operators import phrases as PH
from ..operators import store as ST
from ..session import materialize, materialize_bucketed
from ..sources import derived as D
from ..sources.tables import table


class Ctx:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def rules(self) -> DataFrame:
        return U.suffix_rules(self.spark)

    @cached_property
    def parsed(self) -> DataFrame:
        """Extracted pages (the HTML is parsed once, then dropped)."""
        return materialize(X.parse_pages(self.t("pages")), "page_id")

    @cached_property
    def site(self) -> DataFrame:
        return materialize(D.site(self.spark, self.sf_dir, self.rules), "page_id")

    @cached_property
    def outlinks(self) -> DataFrame:
        return D.outlinks(self.spark, self.sf_dir, self.site)

    @cached_property
    def links(self) -> DataFrame:
        return X.page_links(self.parsed, self.outlinks)

    @cached_property
    def ext_links(self) -> DataFrame:
        return materialize(X.external_links(self.links, self.site, self.rules), "page_id")

    @cached_property
    def edges(self) -> DataFrame:
        return X.link_edges(self.ext_links)

    @cached_property
    def websites(self) -> DataFrame:
        return X.websites(self.parsed, self.site)

    @cached_property
    def metadata(self) -> DataFrame:
        return materialize(X.metadata_rows(self.parsed))

    @cached_property
    def search_docs(self) -> DataFrame:
        """Website + metadata[] + external_links[] (one row per website)."""
        docs = ST.assemble(self.websites, self.metadata, "id", "website_id", "position", "metadata_text", "metadata")
        docs = ST.assemble(docs, self.edges.withColumn("pos", F.col("domain")), "id", "page_id", "pos", "domain",
                           "external_links")
        return materialize(docs, "id")

    @cached_property
    def postings(self) -> DataFrame:
        # bucketed by term: joins on term shuffle only the other side
        return materialize_bucketed(IX.postings(self.search_docs, IX.text_all_source()), "term")

    @cached_property
    def text_positions(self) -> DataFrame:
        """Positional index of the documents' texts."""
        d = self.t("documents").select(F.col("doc_id").alias("id"), "text")
        return materialize(PH.positional_index(PH.field_values(d, ["text"])))

    @cached_property
    def all_positions(self) -> DataFrame:
        """Positional index of the catch-all field: the values of the copied fields, one after the other."""
        d = self.search_docs.select("id", IX.text_all_values().alias("text_all"))
        return materialize(PH.positional_index(PH.field_values(d, ["text_all"])))

    @cached_property
    def link_positions(self) -> DataFrame:
        """Positional index of the websites' link fields."""
        return materialize(PH.positional_index(PH.field_values(self.search_docs, list(PH.LINK_FIELDS))))

    @cached_property
    def link_dictionary(self) -> DataFrame:
        """Terms of the websites' link fields, for prefixes."""
        return DI.dictionary(self.link_positions)

    @cached_property
    def text_dictionary_reversed(self) -> DataFrame:
        """Terms of the documents' texts by their last letters, for suffixes."""
        return DI.dictionary(self.text_positions, backwards=True)

    @cached_property
    def vocab(self) -> DataFrame:
        return materialize(IX.vocab(self.postings))

    @cached_property
    def spelling_index(self) -> DataFrame:
        return materialize(AN.spelling_index(self.vocab), "piece")

    @cached_property
    def grams(self) -> DataFrame:
        return materialize_bucketed(IX.vocab_grams(self.vocab), "gram")

    @cached_property
    def votes(self) -> DataFrame:
        return D.votes(self.spark, self.sf_dir)

    @cached_property
    def ranks(self) -> DataFrame:
        """(id, rank): website ranks after all votes (10 s cooldown)."""
        from ..operators import votes as V
        r = V.final_ranks(self.votes, self.websites.select("id", "rank"), V.COOLDOWN_SECONDS)
        return materialize(r.select(F.col("website_id").alias("id"), "rank"), "id")

    @cached_property
    def queries(self) -> DataFrame:
        return D.queries(self.spark)


_CACHE: dict[tuple[int, str], Ctx] = {}


def ctx(spark: SparkSession, sf_dir: str) -> Ctx:
    key = (id(spark), sf_dir)
    if key not in _CACHE:
        _CACHE[key] = Ctx(spark, sf_dir)
    return _CACHE[key]
