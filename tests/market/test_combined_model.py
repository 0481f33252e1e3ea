import json

import pytest

from barloom.plans import tools
from barloom.sources import tables


def test_a_saved_model_predicts_the_same(spark, sf_dir):
    bars = tables.bars(spark, sf_dir)
    saved, scored = tools.combined_model(bars, "1-URGENT", n_test=60, types=("ma", "roc"), increment=4, n_long=2, n_short=1)
    held = json.loads(saved)
    assert [(s["type"], s["short_lookback"], s["long_lookback"]) for s in held["specs"]] == [("ma", 2, 4), ("ma", 4, 8), ("roc", 2, 4), ("roc", 4, 8)]
    assert len(held["model"]["beta"]) == 4
    want = {r.i: r.pred for r in scored.collect()}
    got = {r.i: r.pred for r in tools.model_predictions(bars.where("symbol = '1-URGENT'"), saved).collect()}
    assert len(want) == 60 and all(got[i] == pytest.approx(v) for i, v in want.items())
    held["specs"].pop()
    with pytest.raises(ValueError):
        tools.model_predictions(bars, json.dumps(held))
