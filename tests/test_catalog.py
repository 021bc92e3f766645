"""Every query that SQL can express returns what DuckDB returns."""

import pytest

from loomtext.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(name, agree):
    agree(catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", ["louvain_communities", "kmedoids_fit", "kmeans_baseline", "metric_acc", "confusion_aligned", "pca_scores", "seed_label_sample"])
def test_has_rows(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).count() > 0
