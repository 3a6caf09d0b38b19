"""Driver contract: entry runs, every query builds, oracle keys are a subset of query keys."""

import __spark_entry__ as entry
from equilibra.plans.registry import load_all

# builders of these modules train models while building (driver-coordinated fits)
EAGER = ("equilibra.plans.model_queries", "equilibra.plans.experiment_queries")


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0


def test_oracle_keys_subset():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_lazy_query_builds_small(spark):
    from tests.conftest import SF_SMALL
    for name, q in load_all().items():
        if q.build.__module__ in EAGER:
            continue
        df = q.build(spark, SF_SMALL)
        assert df.columns, name


def test_one_model_query_small(spark):
    from tests.conftest import SF_SMALL
    rows = load_all()["svm_grid"].build(spark, SF_SMALL).collect()
    assert len(rows) == 4 * 5 and {r.fold for r in rows if r.chosen} == set(range(5)) and sum(r.chosen for r in rows) == 5
