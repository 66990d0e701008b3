"""Files of a bucketed table."""

from websift.session import BUCKETS, materialize_bucketed


def test_bucketed_tables_have_a_bounded_number_of_files_a_task(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(4 * BUCKETS))
    try:
        t = materialize_bucketed(spark.range(5000).selectExpr("cast(id as string) term", "id").coalesce(2), "term")
        assert t.count() == 5000 and len(t.inputFiles()) <= 2 * BUCKETS
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
