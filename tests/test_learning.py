"""The registered training queries fit models of full size, each once."""

import pytest

from sessionloom.catalog import base, learning


class Stopped(Exception):
    pass


FORESTS = ["mdl02_random_forest", "mdl02_forest_invariants", "mdl06_feature_importance", "evl01_model_comparison", "snk04_save_model", "snk04_reload_equality"]
LEVELS = ["mdl03_boosted_trees", "mdl03_boosted_invariants", "mdl06_boosted_importance"]
LEAVES = ["mdl03_leaf_wise_trees", "mdl03_leaf_wise_invariants"]


@pytest.mark.parametrize("name", [*FORESTS, *LEVELS, *LEAVES, "mdl04_sequence_classifier"])
def test_full_size(spark, monkeypatch, name):
    held = []

    def fit(train, settings=None, weight=True, **more):
        held.append((settings, more))
        raise Stopped

    for f in ("fit_classifier", "fit_boosted", "fit_sequences"):
        monkeypatch.setattr(learning.models, f, fit)
    monkeypatch.setattr(learning, "staged", lambda s, f, n, build: build(s, f))
    empty = spark.createDataFrame([], "session_id string, label int, channel string, is_test boolean, steps array<array<double>>")
    monkeypatch.setattr(learning, "split_sessions", lambda s, f: empty)
    monkeypatch.setattr(learning, "click_seq", lambda s, f: empty)
    monkeypatch.setattr(learning.sampling, "stratified_split", lambda df: df.selectExpr("*", "false AS is_test"))
    with pytest.raises(Stopped):
        base.QUERIES[name](spark, "unread")
    settings, more = held[0]
    if name in FORESTS:
        assert (settings.getNumTrees(), settings.getMaxDepth()) == (300, 15)
    elif name in LEVELS:
        assert (settings.rounds, settings.depth, settings.row_share, settings.column_share, settings.rate) == (400, 8, 0.8, 0.8, 0.05)
    elif name in LEAVES:
        assert (settings.rounds, settings.depth, settings.leaves, settings.rate) == (400, 10, 31, 0.05)
    else:
        assert (settings, more) == (6, {})  # the network's own defaults: 64 and 32 units, 20 epochs
