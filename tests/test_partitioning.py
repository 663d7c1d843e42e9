"""Results do not depend on partitioning: registered aggregates are equal at 1 and
8 shuffle partitions, and ``spread`` only touches inputs with too few splits."""

import pytest

from churnkit.plans.parallelism import spread
from churnkit.plans.registry import all_queries

SF = "/root/testdata/sf0.001"


def test_spread_only_repartitions_small_inputs(spark):
    slots = spark.sparkContext.defaultParallelism
    one = spark.range(100).coalesce(1)
    many = spark.range(100).repartition(slots * 3)
    assert spread(one).rdd.getNumPartitions() == slots * 2
    assert spread(many) is many
    assert sorted(r.id for r in spread(one).collect()) == list(range(100))


@pytest.mark.parametrize("name", ["kpi_summary", "lifecycle_summary", "cohort_summary", "retention_curve",
                                  "chi_square_association", "outlier_summary", "rule_tuned_threshold",
                                  "rule_tier_summary"])
def test_same_result_at_1_and_8_shuffle_partitions(spark, name):
    q = all_queries()[name]
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = sorted(map(tuple, q(spark, SF).collect()), key=repr)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        b = sorted(map(tuple, q(spark, SF).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
    assert a == b
