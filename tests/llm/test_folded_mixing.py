"""Rounds of a fit as one fold over arrays: the same weights as under windows, in plans that don't grow with the rounds."""

import corpus_pipeline
import pytest
from helpers import rows, table
from pyspark.sql import functions as F

from tidemark.llm import _kit, mixing


def rates(cells, targets, **more):
    return {(r.source, r.lang, r.topic): (r.tokens, r.rate) for r in mixing.raked(cells, targets, **more).collect()}


def test_fold_and_windows_agree(spark, monkeypatch):
    """With cells that have no tokens, nulls, and values without a target."""
    found = [(f"s{i % 7}", "abc"[i % 3] if i % 11 else None, f"t{i % 5}", 17 * i * i % 900 if i % 8 else 0) for i in range(105)]
    cells = spark.createDataFrame(found, "source string, lang string, topic string, tokens long")
    targets = {name: mixing.tempered(cells, name, 0.5) for name in mixing.DIMENSIONS}
    targets["topic"] = targets["topic"].where("value <> 't3'")
    for more in ({"most": None}, {"most": 1}, {"most": None, "rounds": 3, "keep": 0.5}, {"most": None, "rounds": 0}):
        monkeypatch.undo()
        fold = rates(cells, targets, **more)
        monkeypatch.setattr(mixing, "FEW", 0)
        windows = rates(cells, targets, **more)
        assert len(fold) == 105 and set(fold) == set(windows)
        for cell, (tokens, rate) in windows.items():
            assert fold[cell] == (tokens, pytest.approx(rate, rel=1e-9, abs=1e-12)), (cell, more)


def test_plans_do_not_grow_with_rounds(spark, monkeypatch):
    """Plans of thirty windows took the driver over its memory."""
    plans, real = [], _kit.written

    def told(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(_kit, "written", told)
    assert corpus_pipeline.mixed(spark, table(spark, rows()), "").agg(F.count("*")).first()[0] > 0
    assert len(plans) > 5 and max(p.count("Window [") for p in plans) <= 8
