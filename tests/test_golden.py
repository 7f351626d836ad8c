"""Published results on small tables: time series of failure fractions and the effects of a factorial experiment."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from yieldspark.operators import doe, timeseries

# Failures in 26 windows of 50 units, and in a last one of 9; information criteria of three orders;
# the mean absolute error of the best order over rolling origins.
FAILURES = (10, 7, 2, 10, 10, 5, 6, 4, 4, 1, 2, 2, 3, 0, 1, 2, 2, 1, 4, 0, 1, 1, 1, 3, 5, 1)
LAST = (2, 9)
AIC = {(0, 1, 1): (-68.70785389146299, -68.18611476102821), (1, 0, 0): (-68.77237381859716, -67.7288955577276), (1, 1, 0): (-66.73667039245092, -66.21493126201614)}
MAE = 0.023845998397839612
# Coded levels, failures and mean response of the cells of 1,309 rows each; effects of both models.
CELLS = (
    (0, 0, 0, 49, 0.046565015361050614),
    (0, 0, 0, 61, 0.046565015361050614),
    (-1, -1, 1, 35, 0.03163482280215656),
    (-1, 1, -1, 47, 0.03231029177876302),
    (-1, 1, 1, 62, 0.04052269073706354),
    (1, 1, -1, 68, 0.057277410773804785),
    (1, -1, -1, 54, 0.041979080211961874),
    (1, 1, 1, 92, 0.07834977402202799),
    (-1, -1, -1, 38, 0.027065309122905123),
    (1, -1, 1, 72, 0.05447575425587782),
    (0, 0, 0, 61, 0.046565015361050614),
)
OLS = {"intercept": 0.04575547088979204, "a": 0.012568613102848025, "b": 0.00666315011484475, "c": 0.005793868741211389, "a:b": 0.003129937467153519, "a:c": 0.0025983905818233975, "b:c": 0.0015273218104195443}
GLM = {"intercept": (-3.102537998833879, 0.04175648888067062), "a": (0.23744526583232278, 0.048936858333201536), "b": (0.1624575163618358, 0.049099625306842774), "c": (0.10623702136032649, 0.049095829444046724), "a:b": (-0.041727774862704084, 0.049073385790054165), "a:c": (0.045522292812538834, 0.04869056023410569), "b:c": (0.03942166616127059, 0.048110773095657096)}
CURVATURE = 0.001113123647980524


@pytest.fixture(scope="module")
def fractions():
    return np.append(np.array(FAILURES) / 50, LAST[0] / LAST[1])


def test_orders_of_failure_fractions(fractions):
    for order, (aic, aicc) in AIC.items():
        fit = timeseries.fit_arima(fractions, order)
        assert (fit["aic"], fit["aicc"]) == (pytest.approx(aic, abs=1e-5), pytest.approx(aicc, abs=1e-5))
    assert timeseries.rolling_arima(fractions, (0, 1, 1)) == pytest.approx(MAE, abs=1e-6)


def test_grid_and_choice_of_failure_fractions(spark, fractions):
    df = spark.createDataFrame([("f", i, float(v), float(i % 3)) for i, v in enumerate(fractions)], "s string, t long, y double, x double")
    grid = {(r["p"], r["d"], r["q"]): r["aicc"] for r in timeseries.arima_grid(df, "s", "t", "y").collect()}
    assert grid == {o: pytest.approx(v, abs=1e-5) for o, (_, v) in AIC.items()}
    chosen = timeseries.staged_choice(df, "s", "t", "y", {"x": 0}, holdout=0).first()
    assert (chosen["p"], chosen["d"], chosen["q"]) == (0, 1, 1) and chosen["base_aicc"] == pytest.approx(AIC[0, 1, 1][1], abs=1e-5)
    assert chosen["winner"] == "arima" and not chosen["used"] and chosen["mase"] == pytest.approx(MAE / 0.026, abs=1e-4)


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([(i, float(a), float(b), float(c), n, 1309, m) for i, (a, b, c, n, m) in enumerate(CELLS)], "k long, a double, b double, c double, failures long, trials long, mean double")


def test_linear_effects(cells):
    got = {r["term"]: r["estimate"] for r in doe.ols_effects(cells, ["a", "b", "c"]).collect()}
    assert got == {t: pytest.approx(v, abs=1e-9) for t, v in OLS.items()}
    center = doe.curvature(cells.withColumn("is_center", F.col("a") == 0), F.col("is_center")).first()
    assert center["curvature"] == pytest.approx(CURVATURE, abs=1e-12)
    assert doe.recommend(cells, "k").first()["k"] == 8


def test_binomial_effects(cells):
    got = {r["term"]: (r["estimate"], r["std_error"]) for r in doe.glm_effects(cells, ["a", "b", "c"]).collect()}
    assert got == {t: (pytest.approx(v, abs=1e-5), pytest.approx(s, abs=1e-5)) for t, (v, s) in GLM.items()}
