"""The registered ensemble is fitted whole: every default round, every member."""

import os

import pytest

from fieldseq.operators import xg
from fieldseq.plans import model_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_ensemble_fits_all_rounds(spark, monkeypatch):
    fitted = []

    def noted(train, settings=xg.TreeSettings()):
        fitted.append(settings)
        return quick(train, xg.settings_for(1))

    quick = xg.fit_trees
    monkeypatch.setattr(xg, "fit_trees", noted)
    found = model_queries.xg_ensemble_fit(spark, SF)
    assert fitted == [xg.TreeSettings()] * 3 and fitted[0].rounds == 300
    assert found.filter("p_mine is not null").count() == found.count()
