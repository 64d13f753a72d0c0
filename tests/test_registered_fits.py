"""The registered model queries fit the models of the jobs, with all their rounds and trees."""

from smogline.schemas import TARGETS


def test_registered_fits_are_whole(spark, monkeypatch):
    from smogline.ml import models as M
    from smogline.plans import queries_more as Q
    fitted = {}

    def fit(feats, target, model, matrix=None, **params):
        reg = M.MODELS[model](**params)
        fitted[model, target] = {p.name: v for p, v in reg.extractParamMap().items()}

    monkeypatch.setattr(M, "fit_horizon", fit)
    monkeypatch.setattr(Q, "_model_inputs", lambda spark, sf: (None, dict.fromkeys(TARGETS)))
    monkeypatch.setattr(Q, "_FITS", {})
    Q._fit_models(spark, "no-tables", ("gbt", "forest", "ridge"))
    assert set(fitted) == {(m, t) for m in ("gbt", "forest", "ridge") for t in TARGETS}
    whole = {"gbt": M.GBT_PARAMS, "forest": M.FOREST_PARAMS, "ridge": M.RIDGE_PARAMS}
    for (model, _), params in fitted.items():
        assert {k: params[k] for k in whole[model]} == whole[model]
    assert M.GBT_PARAMS["maxIter"] == 500
