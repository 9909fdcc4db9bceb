"""The bucketed store table: what a write touches, old versions, lost writers, new columns."""

import os

import pytest
from pyspark.sql import functions as F

from storelens.sources import store


def now(day=1):
    return F.expr(f"timestamp '2024-03-{day:02d}'")


@pytest.fixture
def table(spark, tmp_path):
    held = store.StoreTable(spark, str(tmp_path / "stores"), buckets=8, keep=2)
    held.upsert(spark.range(60).select(F.concat(F.lit("s"), "id", F.lit(".com")).alias("site"), F.col("id").alias("n")), now())
    return held


def buckets(table, version):
    return {n for n in os.listdir(table.folder(version)) if n.startswith("bucket=")} if os.path.isdir(table.folder(version)) else set()


def one(spark, site="s7.com", n=700):
    return spark.createDataFrame([(site, n)], "site string, n long")


def test_an_upsert_of_one_site_rewrites_one_bucket(spark, table):
    assert len(buckets(table, 1)) == 8
    old = table.read()
    assert table.upsert(one(spark), now(2)) == 2 and len(buckets(table, 2)) == 1
    assert {r.site: r.n for r in table.read().collect()} == {f"s{i}.com": 700 if i == 7 else i for i in range(60)}
    assert sorted(r.n for r in old.collect()) == list(range(60)) and table.read(before=2).filter("n = 700").count() == 0
    found = table.lookup("https://s7.com/x")
    assert [(r.n, r.created_at.day, r.updated_at.day) for r in found.collect()] == [(700, 1, 2)]
    files = found.inputFiles()
    assert files and len({os.path.dirname(f) for f in files}) == 1


def test_a_deletion_touches_the_buckets_of_its_keys_and_may_empty_them(spark, table):
    removed = table.delete(spark.createDataFrame([("s7.com",), ("gone.com",)], "site string"))
    assert [r.site for r in removed.collect()] == ["s7.com"] and table.read().count() == 59 and len(buckets(table, 2)) <= 2
    assert table.delete(table.read().select("site")).count() == 59 and table.read().count() == 0
    table.upsert(one(spark), now(3))
    assert [(r.site, r.n, r.created_at.day) for r in table.read().collect()] == [("s7.com", 700, 3)]


def test_old_versions_go_and_what_newer_ones_name_stays(spark, table):
    for i in range(2, 6):
        table.upsert(one(spark, n=1000 + i), now(i))
    assert table.versions() == [4, 5] and [table.read(before=v).filter("site = 's7.com'").first().n for v in (5, 6)] == [1004, 1005]
    # Seven buckets of the first version are still in use, the rewritten ones in between are gone.
    assert len(buckets(table, 1)) == 7 and not buckets(table, 2) and not buckets(table, 3)
    assert table.read().count() == 60


def test_a_lost_writer_leaves_the_table_as_it_was(spark, table):
    rows = one(spark).withColumn("bucket", F.lit(3))
    rows.write.partitionBy("bucket").parquet(table.folder(2))
    assert table.versions() == [1] and table.read().count() == 60
    assert table.upsert(one(spark), now(2), version=2) == 2 and table.upsert(one(spark), now(2), version=2) == 2
    assert table.read().count() == 60 and table.lookup("s7.com").first().n == 700


def test_new_columns_are_null_in_buckets_that_were_not_rewritten(spark, table):
    table.upsert(one(spark).withColumn("logo", F.lit("l")), now(2))
    assert {(r.site, r.logo) for r in table.read().collect() if r.logo} == {("s7.com", "l")} and table.read().count() == 60


def test_two_batch_rows_and_empty_batches(spark, table):
    table.upsert(one(spark).limit(0), now(2))
    assert table.read().count() == 60
    both = one(spark, n=1).withColumn("updated_at", F.lit("2024-02-01")).unionByName(one(spark, n=2).withColumn("updated_at", F.lit("2024-02-02")))
    table.upsert(both, now(3))
    assert table.lookup("s7.com").first().n == 2
