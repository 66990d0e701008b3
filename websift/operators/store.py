"""Relational store operators on snapshot tables.

Parquet has no MERGE or DELETE, so every change produces a new snapshot
DataFrame (written by the caller to a new folder).  Keys are matched with
equi-joins; deletes are anti-joins and their counts semi-joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_ROW_BITS = 33  # monotonically_increasing_id: partition id in the upper bits


def assign_ids(rows: DataFrame, base, order_cols: list[str], id_col: str = "id") -> DataFrame:
    """Dense ids ``base+1, base+2, ...`` in ``order_cols`` order, without a
    single-partition window.

    Rows are range-partitioned and sorted, materialised (so the ids are
    stable on recomputation), counted per partition (a table with one row per
    partition), and offset by the prefix sum of those counts.  ``base`` is a
    Column or number (e.g. the current max id).
    """
    # the place is a column taken before the write: a later scan may read the files in any order
    srt = materialize(rows.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
                      .withColumn("_mid", F.monotonically_increasing_id()))
    srt = srt.withColumn("_part", F.shiftright("_mid", _ROW_BITS)) \
        .withColumn("_row", F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    counts = srt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = srt.join(F.broadcast(counts.select("_part", "_off")), "_part")  # one row per partition
    base_col = base if not isinstance(base, (int, float)) else F.lit(int(base))
    return out.withColumn(id_col, (base_col + F.col("_off") + F.col("_row") + 1).cast("long")) \
        .drop("_mid", "_part", "_row", "_off")


def max_id(df: DataFrame, id_col: str = "id") -> int:
    """Current max id (a scalar; 0 for an empty table)."""
    v = df.agg(F.max(id_col)).first()[0]
    return int(v) if v is not None else 0


def upsert_by_url(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Known URL → new field values, same id and rank; new URL → new id, rank 0.

    ``existing`` has the website schema; ``incoming`` (url, title, text,
    base_url, type_of_website).  Of a URL that arrives several times the last
    version counts.  Returns the new snapshot with ``is_new``.
    """
    inc = incoming.withColumn("_at", F.monotonically_increasing_id())
    inc = inc.groupBy("url").agg(F.max_by(F.struct(*[c for c in incoming.columns if c != "url"]), "_at").alias("_v")) \
        .select("url", "_v.*")
    old = existing.select("id", "url", "rank")
    upd = inc.join(old, "url", "inner").withColumn("is_new", F.lit(False))
    new = inc.join(old.select("url"), "url", "left_anti")
    new = assign_ids(new, max_id(existing), ["url"]).withColumn("rank", F.lit(0.0)) \
        .withColumn("is_new", F.lit(True))
    kept = existing.join(inc.select("url"), "url", "left_anti").withColumn("is_new", F.lit(False))
    cols = ["id", "title", "text", "url", "base_url", "rank", "type_of_website", "is_new"]
    return kept.select(*cols).unionByName(upd.select(*cols)).unionByName(new.select(*cols))


def replace_children(children: DataFrame, fresh: DataFrame, parent_col: str) -> DataFrame:
    """Drop all children of the parents present in ``fresh``, then add ``fresh``."""
    touched = fresh.select(parent_col).distinct()
    return children.join(touched, parent_col, "left_anti").unionByName(fresh)


def delete_keys(rows: DataFrame, keys: DataFrame, key_col: str):
    """(remaining rows, number deleted) for a key list."""
    k = keys.select(key_col).distinct()
    remaining = rows.join(k, key_col, "left_anti")
    deleted = rows.join(k, key_col, "left_semi")
    return remaining, deleted


def delete_links_of_sites(links: DataFrame, bridge: DataFrame, site_ids: DataFrame):
    """Delete links referenced by the bridge rows of the given websites, then those bridge rows."""
    victims = bridge.join(site_ids.select(F.col("id").alias("website_id")), "website_id", "left_semi")
    link_ids = victims.select(F.col("ext_link_id").alias("id")).distinct()
    return (links.join(link_ids, "id", "left_anti"), links.join(link_ids, "id", "left_semi"),
            bridge.join(victims.select("id"), "id", "left_anti"))


def cascade_delete(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], deleted: DataFrame,
                   key: str = "id") -> dict[str, DataFrame]:
    """Delete parents and, by anti-join on their foreign keys, their children."""
    d = deleted.select(key).distinct()
    out = {"parents": delete_keys(parents, d, key)[0]}
    for name, (df, fk) in children.items():
        out[name] = df.join(d.withColumnRenamed(key, fk), fk, "left_anti")
    return out


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose parent does not exist."""
    return child.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def too_long(df: DataFrame, col: str, limit: int) -> DataFrame:
    """Values longer than the column limit."""
    return df.where(F.length(col) > limit)


def assemble(parents: DataFrame, children: DataFrame, pk: str, fk: str, pos_col: str, value_col: str,
             out_col: str) -> DataFrame:
    """Children collected into an ordered array on the parent (NULL when none)."""
    agg = children.groupBy(fk).agg(F.array_sort(F.collect_list(F.struct(pos_col, value_col))).alias("_c"))
    agg = agg.select(F.col(fk).alias(pk), F.transform("_c", lambda x: x[value_col]).alias(out_col))
    return parents.join(agg, pk, "left")


def changed_parents(parents: DataFrame, children: DataFrame, pk: str, fk: str,
                    parent_ts: str, child_ts: str, since) -> DataFrame:
    """Parents changed since ``since`` or with a changed child (key union, distinct)."""
    p = parents.where(F.col(parent_ts) > since).select(pk)
    c = children.where(F.col(child_ts) > since).select(F.col(fk).alias(pk))
    return p.unionByName(c).distinct()
