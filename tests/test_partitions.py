"""Results must not depend on partitioning: 1 vs 16 input partitions."""

from quarry.operators import eda as ed
from quarry.operators import metrics as ev
from quarry.operators import profile as pr
from quarry.plans.fixtures import dirty, scored_binary

from data_dirs import SF01


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_profile_numeric_independent_of_partitions(spark):
    d = dirty(spark, SF01)
    assert _rows(pr.profile_numeric(d.repartition(1))) == _rows(pr.profile_numeric(d.repartition(16)))


def test_spearman_independent_of_partitions(spark):
    d = dirty(spark, SF01)
    assert _rows(ed.spearman_matrix(d.repartition(1))) == _rows(ed.spearman_matrix(d.repartition(16)))


def test_auc_independent_of_partitions(spark):
    s = scored_binary(spark, SF01)
    assert _rows(ev.roc_auc(s.repartition(1))) == _rows(ev.roc_auc(s.repartition(16)))
