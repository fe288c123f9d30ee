"""Repeatability: order-dependent queries give
the same result under different shuffle partition counts."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.check_oracle import digest

ORDER_SENSITIVE = ["dedup_text_first", "dedup_key_last", "vote_rank_labels", "vocab_stats", "pack_blocks",
                   "split_exact", "split_stratified", "group_folds", "sample_exact", "lag_correlation",
                   "roc_points", "span_report", "top_keywords"]


@pytest.mark.parametrize("name", ORDER_SENSITIVE)
def test_same_result_under_partition_counts(spark, name):
    fn = E.queries()[name]
    seen = set()
    try:
        for parts in (1, 4, 17):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            df = fn(spark, SF_SMALL)
            seen.add(digest(df.columns, [tuple(r) for r in df.collect()])[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(seen) == 1
