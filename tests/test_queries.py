import pytest
from oracle import assert_same, connect

from lumenfold.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert_same(QUERIES[name](spark, sf_dir), con, SQL[name])


@pytest.mark.parametrize("name", ["split_leakage_gate", "canonical_dedup_ledger", "round_robin_cap", "multi_key_components"])
def test_partitioning_changes_nothing(spark, sf_dir, con, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert_same(QUERIES[name](spark, sf_dir), con, SQL[name])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_whole_items_are_searched(spark, tmp_path):
    item = "the opening of this item has well over sixty-four characters, and then it goes on to its end"
    spark.createDataFrame([(1, item), (2, "short one"), (3, ""), (4, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [f"say {item} again", f"{item[:70]} but ends otherwise", "a short one here", "nothing", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["item_id"], r["doc_id"]) for r in QUERIES["contamination_substring"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0), (2, 2)}


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
