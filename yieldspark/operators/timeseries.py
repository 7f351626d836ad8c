"""Windowed and daily series, baselines, rolling origins, and ARIMA by exact likelihood."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The orders tried, and the rolling-origin protocol.
GRID = ((1, 0, 0), (0, 1, 1), (1, 1, 0))
MIN_TRAIN, HORIZON, STEP = 16, 2, 2


def windowed_mean(df: DataFrame, position: str, value: str, window: int, start: int = 0) -> DataFrame:
    """w, n, mean of consecutive windows of positions from start on; nulls leave the mean, not the window."""
    at = F.col(position) - start
    return df.where(at >= 0).groupBy(F.floor(at / window).cast("long").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def daily_grid(df: DataFrame, ts: str, fail: str) -> DataFrame:
    """Every calendar day from first to last: n, total_fail, fail_freq (null on an empty day)."""
    days = df.groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(fail).cast("long")).alias("total_fail"))
    spine = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    out = spine.join(days, "day", "left").fillna({"n": 0, "total_fail": 0})
    return out.withColumn("fail_freq", F.when(F.col("n") > 0, F.col("total_fail") / F.col("n")))


def naive_scale(series: DataFrame, order: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """Mean |step|: the scale of MASE."""
    keys = keys or []
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)))
    return series.withColumn("step", step).groupBy(*keys).agg(F.avg("step").alias("scale"))


def rolling_origin(series: DataFrame, key: str, order: str, value: str, min_train: int = MIN_TRAIN, horizon: int = HORIZON, step: int = STEP) -> DataFrame:
    """key, model, n_errors, mae, mase of persistence and mean forecasts from origins t = min_train, + step, ...

    A forecast at origin t uses values before t only; MASE divides by the mean |step| of the whole series.
    """
    own = Window.partitionBy(key).orderBy(order)
    s = series.select(key, F.col(value).alias("y"), (F.row_number().over(own) - 1).alias("t"), F.lag(value).over(own).alias("last"), F.avg(value).over(own.rowsBetween(Window.unboundedPreceding, -1)).alias("mean"), F.count(F.lit(1)).over(Window.partitionBy(key)).alias("n"))
    origin = s.where((F.col("t") >= min_train) & ((F.col("t") - min_train) % step == 0) & (F.col("t") <= F.col("n") - horizon))
    ahead = origin.select(key, F.explode(F.sequence(F.col("t"), F.col("t") + horizon - 1)).alias("t"), "last", "mean")
    errors = ahead.join(s.select(key, "t", "y"), [key, "t"]).select(key, F.explode(F.array(F.struct(F.lit("persistence").alias("model"), F.abs(F.col("y") - F.col("last")).alias("e")), F.struct(F.lit("mean").alias("model"), F.abs(F.col("y") - F.col("mean")).alias("e")))).alias("m")).select(key, "m.*")
    mae = errors.groupBy(key, "model").agg(F.count("e").alias("n_errors"), F.avg("e").alias("mae"))
    scale = s.groupBy(key).agg(F.avg(F.abs(F.col("y") - F.col("last"))).alias("scale"))
    return mae.join(scale, key).select(key, "model", "n_errors", "mae", F.when(F.col("scale") > 0, F.col("mae") / F.col("scale")).alias("mase"))


def autocorrelation(series: DataFrame, key: str, order: str, value: str, lags: int) -> DataFrame:
    """key, lag, acf for lags 1..lags, in one pass over the ordered series."""
    own = Window.partitionBy(key).orderBy(order)
    mean = F.avg(value).over(Window.partitionBy(key))
    s = series.select(key, order, (F.col(value) - mean).alias("d"))
    s = s.select(key, "d", *(F.lag("d", k).over(own).alias(f"d{k}") for k in range(1, lags + 1)))
    wide = s.groupBy(key).agg(*((F.sum(F.col("d") * F.col(f"d{k}")) / F.sum(F.col("d") ** 2)).alias(str(k)) for k in range(1, lags + 1)))
    return wide.unpivot([key], [str(k) for k in range(1, lags + 1)], "lag", "acf").withColumn("lag", F.col("lag").cast("long"))


def breach_summary(forecast: DataFrame, keys: list[str]) -> DataFrame:
    """coverage (inclusive) and breaches (strict) of actual against lower and upper."""
    inside = (F.col("actual") >= F.col("lower")) & (F.col("actual") <= F.col("upper"))
    return forecast.groupBy(*keys).agg(F.avg(inside.cast("double")).alias("coverage"), F.count_if(~inside).alias("n_breach"))


# --- ARIMA: small helpers inside the tasks that Spark deals out, one series and order each ---


def _poly(ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = max(len(ar), len(ma) + 1)
    move = np.zeros((m, m))
    move[: len(ar), 0] = ar
    move[:-1, 1:] = np.eye(m - 1)
    noise = np.zeros(m)
    noise[0] = 1
    noise[1 : len(ma) + 1] = ma
    start = np.linalg.solve(np.eye(m * m) - np.kron(move, move), np.outer(noise, noise).ravel()).reshape(m, m)
    return move, noise, start


def kalman(y: np.ndarray, ar: np.ndarray, ma: np.ndarray, ahead: int = 0) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Concentrated log-likelihood, sigma2, forecasts and their variances (in sigma2) of a stationary ARMA."""
    move, noise, p = _poly(ar, ma)
    a, logs, squares, n = np.zeros(len(noise)), 0.0, 0.0, 0
    q = np.outer(noise, noise)
    for value in y:
        f = p[0, 0]
        if not np.isnan(value):
            v = value - a[0]
            logs, squares, n = logs + np.log(f), squares + v * v / f, n + 1
            gain = p[:, 0] / f
            a, p = a + gain * v, p - np.outer(gain, p[0])
        a, p = move @ a, move @ p @ move.T + q
    mean, var = [], []
    for _ in range(ahead):
        mean.append(a[0])
        var.append(p[0, 0])
        a, p = move @ a, move @ p @ move.T + q
    s2 = squares / max(n, 1)
    return -0.5 * (n * np.log(2 * np.pi * max(s2, 1e-300)) + logs + n), s2, np.array(mean), np.array(var)


def _steps(x: np.ndarray) -> np.ndarray:
    """Free numbers to stationary coefficients, by partial autocorrelations."""
    out: list[float] = []
    for r in np.tanh(x):
        out = [c - r * d for c, d in zip(out, out[::-1], strict=True)] + [r]
    return np.array(out)


def _minimise(f, x: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Nelder-Mead simplex."""
    n = len(x)
    if not n:
        return x
    simplex = [x] + [x + 0.5 * e for e in np.eye(n)]
    values = [f(s) for s in simplex]
    for _ in range(rounds):
        order = np.argsort(values)
        simplex, values = [simplex[i] for i in order], [values[i] for i in order]
        if values[-1] - values[0] < 1e-10 and max(np.abs(s - simplex[0]).max() for s in simplex) < 1e-7:
            break
        centre = np.mean(simplex[:-1], axis=0)
        tries = [(k, centre + k * (centre - simplex[-1])) for k in (1.0, 2.0, 0.5, -0.5)]
        best = f(tries[0][1])
        if best < values[0]:
            far = f(tries[1][1])
            simplex[-1], values[-1] = (tries[1][1], far) if far < best else (tries[0][1], best)
        elif best < values[-2]:
            simplex[-1], values[-1] = tries[0][1], best
        else:
            near = tries[2][1] if best < values[-1] else tries[3][1]
            value = f(near)
            if value < min(best, values[-1]):
                simplex[-1], values[-1] = near, value
            else:
                simplex = [simplex[0]] + [(s + simplex[0]) / 2 for s in simplex[1:]]
                values = [values[0]] + [f(s) for s in simplex[1:]]
    return simplex[int(np.argmin(values))]


def _standard_errors(loss, v: np.ndarray) -> np.ndarray:
    """Root diagonal of the inverse information matrix: second differences of the loss at its minimum; NaN where
    that is not positive."""
    n, step = len(v), 1e-4 * np.maximum(np.abs(v), 1e-2)
    at = lambda *moves: loss(v + sum((s * step[i] * np.eye(n)[i] for i, s in moves), np.zeros(n)))
    info = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            info[i, j] = info[j, i] = (at((i, 1), (j, 1)) - at((i, 1), (j, -1)) - at((i, -1), (j, 1)) + at((i, -1), (j, -1))) / (4 * step[i] * step[j])
    with np.errstate(invalid="ignore"):
        return np.sqrt(np.diag(np.linalg.pinv(info))) if n else np.zeros(0)


def fit_arima(y: np.ndarray, order: tuple[int, int, int], season: tuple[int, int] = (0, 0), exog: np.ndarray | None = None, ahead: int = 0, exog_ahead: np.ndarray | None = None) -> dict:
    """Exact maximum likelihood of ARIMA(p, d, q) with an optional seasonal AR (count, period) and regressors.

    A constant only where d = 0. k counts the variance; AICc uses n - d points.
    """
    p, d, q = order
    z = np.diff(y, d) if d else y
    columns = [np.ones(len(z))] if d == 0 else []
    if exog is not None:
        columns += list(np.diff(exog, d, axis=0).T if d else exog.T)
    x = np.column_stack(columns) if columns else np.zeros((len(z), 0))
    count, period = season

    def unpack(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        beta, ar, ma, sar = np.split(v, np.cumsum([x.shape[1], p, q]))
        ar = _steps(ar)
        if count:
            lags = np.zeros(count * period + 1)
            lags[0] = 1
            lags[period::period] = -_steps(sar)
            ar = -np.convolve(np.append(1, -ar), lags)[1:]
        return beta, ar, -_steps(ma)

    def loss(v: np.ndarray) -> float:
        beta, ar, ma = unpack(v)
        ll = kalman(z - x @ beta, ar, ma)[0]
        return -ll if np.isfinite(ll) else 1e12

    beta = np.linalg.lstsq(x[~np.isnan(z)], z[~np.isnan(z)], rcond=None)[0] if x.shape[1] else np.zeros(0)
    best = min((_minimise(loss, np.concatenate([beta, np.full(p + q + count, s)])) for s in (0.1, -0.4, 0.6)), key=loss)
    best = _minimise(loss, best)
    beta, ar, ma = unpack(best)
    ll, s2, mean, var = kalman(z - x @ beta, ar, ma, ahead)
    k, n = len(best) + 1, len(z)
    errors = _standard_errors(loss, best)[: x.shape[1]]
    aic = 2 * k - 2 * ll
    out = {"llf": ll, "aic": aic, "aicc": aic + 2 * k * (k + 1) / (n - k - 1) if n - k - 1 > 0 else float("nan"), "sigma2": s2, "ar": ar[:p].tolist(), "ma": ma.tolist(), "beta": beta.tolist(), "se_beta": errors.tolist()}
    if ahead:
        future = [np.ones(ahead)] if d == 0 else []
        if exog is not None:
            whole = np.concatenate([exog, exog_ahead])
            future += list((np.diff(whole, d, axis=0) if d else whole)[-ahead:].T)
        mean = mean + (np.column_stack(future) @ beta if future else 0)
        # psi weights of the integrated process give the forecast variances
        full = np.append(1, -ar)
        for _ in range(d):
            full = np.convolve(full, [1, -1])
        psi = np.zeros(ahead)
        for j in range(ahead):
            psi[j] = (1 if j == 0 else (ma[j - 1] if j <= len(ma) else 0)) - sum(full[i] * psi[j - i] for i in range(1, min(j, len(full) - 1) + 1))
        level = mean
        for back in range(d):
            last = np.diff(y, d - 1 - back)[-1] if d - 1 - back else y[-1]
            level = last + np.cumsum(level)
        out |= {"forecast": level.tolist(), "se": np.sqrt(s2 * np.cumsum(psi**2)).tolist()}
    return out


def arima_grid(series: DataFrame, key: str, order: str, value: str, grid: tuple = GRID) -> DataFrame:
    """key, p, d, q, llf, aic, aicc, sigma2: one task a series and order. A series is a window summary, not rows."""
    orders = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip("pdq", o, strict=True))) for o in grid)))
    jobs = series.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("series__")).select(key, F.transform("series__", lambda x: x[value]).alias("y__"), orders.alias("order__")).select(key, "y__", "order__.*").repartition(len(grid) * 2, key, "p", "d", "q")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fits = [fit_arima(np.array(y, float), (p, d, q)) for y, p, d, q in zip(b["y__"], b["p"], b["d"], b["q"], strict=True)]
            yield b[[key, "p", "d", "q"]].assign(**{c: [f[c] for f in fits] for c in ("llf", "aic", "aicc", "sigma2")})

    return jobs.mapInPandas(run, f"{key} {dict(series.dtypes)[key]}, p int, d int, q int, llf double, aic double, aicc double, sigma2 double")


def arima_forecast(series: DataFrame, key: str, order: str, value: str, holdout: int, model: tuple[int, int, int] = (0, 1, 1), z: float = 1.959963984540054) -> DataFrame:
    """key, step, actual, forecast, lower, upper: one shot over the last `holdout` points."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        y = part.sort_values(order)[value].to_numpy(float)
        fit = fit_arima(y[:-holdout], model, ahead=holdout)
        mean, se = np.array(fit["forecast"]), np.array(fit["se"])
        return pd.DataFrame({key: part[key].iloc[0], "step": np.arange(1, holdout + 1), "actual": y[-holdout:], "forecast": mean, "lower": mean - z * se, "upper": mean + z * se})

    return series.select(key, order, value).groupBy(key).applyInPandas(run, f"{key} {dict(series.dtypes)[key]}, step long, actual double, forecast double, lower double, upper double")


def rolling_arima(y: np.ndarray, model: tuple[int, int, int], min_train: int = MIN_TRAIN, horizon: int = HORIZON, step: int = STEP) -> float:
    """Mean absolute error of an ARIMA refitted at each origin."""
    errors = [np.abs(y[t : t + horizon] - fit_arima(y[:t], model, ahead=horizon)["forecast"]) for t in range(min_train, len(y) - horizon + 1, step)]
    return float(np.mean(list(itertools.chain.from_iterable(errors)))) if errors else float("nan")


def partial_autocorrelation(acf: DataFrame, key: str) -> DataFrame:
    """key, lag, pacf from autocorrelation()'s table, by Durbin-Levinson (a few lags a key)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        r = part.sort_values("lag")["acf"].to_numpy(float)
        phi, out = np.zeros(0), []
        for k in range(len(r)):
            scale = 1 - phi @ r[:k]
            last = (r[k] - phi @ r[:k][::-1]) / scale if scale > 0 else np.nan
            phi = np.append(phi - last * phi[::-1], last)
            out.append(last)
        return pd.DataFrame({key: part[key].iloc[0], "lag": np.arange(1, len(r) + 1), "pacf": out})

    return acf.select(key, "lag", "acf").groupBy(key).applyInPandas(run, f"{key} {dict(acf.dtypes)[key]}, lag long, pacf double")


# The seasonal candidates, as (AR lags, seasonal AR lags, period).
SEASONAL = {"ar1": (1, 0, 1), "sar7": (1, 1, 7), "sar14": (1, 1, 14)}


def seasonal_candidates(series: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, model, llf, aicc, place by AICc: a constant with AR(1), and seasonal AR of a week and two weeks."""
    kind = dict(series.dtypes)[key]
    names = F.explode(F.array(*map(F.lit, SEASONAL)))
    jobs = series.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("series__")).select(key, F.transform("series__", lambda x: x[value]).alias("y__"), names.alias("model")).repartition(len(SEASONAL) * 2, key, "model")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fits = [fit_arima(np.array(y, float), (SEASONAL[m][0], 0, 0), (SEASONAL[m][1], SEASONAL[m][2])) for y, m in zip(b["y__"], b["model"], strict=True)]
            yield b[[key, "model"]].assign(llf=[f["llf"] for f in fits], aicc=[f["aicc"] for f in fits])

    out = jobs.mapInPandas(run, f"{key} {kind}, model string, llf double, aicc double")
    return out.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("aicc", "model")).cast("long"))


def exogenous_tests(series: DataFrame, key: str, order: str, value: str, exog: list[str], model: tuple[int, int, int] = (1, 0, 0), gain: float = 2.0) -> DataFrame:
    """key, exog, coefficient, aicc, base_aicc, accepted: a regressor must beat the bare model's AICc by over `gain`."""
    kind = dict(series.dtypes)[key]
    long = series.select(key, order, value, *exog).unpivot([key, order, value], exog, "exog", "x")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        y = part[value].to_numpy(float)
        base, full = fit_arima(y, model), fit_arima(y, model, exog=part[["x"]].to_numpy(float))
        return pd.DataFrame({key: part[key].iloc[:1], "exog": part["exog"].iloc[:1], "coefficient": full["beta"][-1], "aicc": full["aicc"], "base_aicc": base["aicc"], "accepted": bool(base["aicc"] - full["aicc"] > gain)})

    return long.groupBy(key, "exog").applyInPandas(run, f"{key} {kind}, exog string, coefficient double, aicc double, base_aicc double, accepted boolean")


#: Points of one series that a task fits; more raise, as a fit is a loop over them.
MAX_POINTS = 20_000


def staged_choice(series: DataFrame, key: str, order: str, value: str, exog: dict[str, int], holdout: int, grid: tuple = GRID, gain: float = 2.0, min_train: int = MIN_TRAIN, horizon: int = HORIZON, step: int = STEP) -> DataFrame:
    """key, p, d, q, base_aicc, exog, aicc, coefficient, p_value, sign_ok, used, winner, mase, holdout_mae: the model
    of each series, chosen in stages, a row a series.

    The order of least AICc on all but the last `holdout` points; then one regressor at a time on that order
    (exog: name and expected sign, 0 for none), of which the best is used if its AICc is lower by over `gain`;
    then rolling origins, in which a used regressor must beat the bare order (mase: mean absolute error over
    that of the last value); the winner forecasts the held points. coefficient, p_value and sign_ok are the best
    regressor's, also where it is not used; errors come from the information matrix. Rows with null values are
    gaps; a series of no points, or with too few to hold out, gives nulls. A series is one task's work.
    """
    names = list(exog)
    kind = dict(series.dtypes)[key]
    fields = f"{key} {kind}, p int, d int, q int, base_aicc double, exog string, aicc double, coefficient double, p_value double, sign_ok boolean, used boolean, winner string, mase double, holdout_mae double"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        if len(part) > MAX_POINTS:
            raise ValueError(f"a series of {len(part)} points; at most {MAX_POINTS}")
        part = part.sort_values(order)
        whole, x = part[value].to_numpy(float), part[names].to_numpy(float)
        y, n = whole[: len(whole) - holdout], len(whole) - holdout
        row = dict.fromkeys((f.split()[0] for f in fields.split(", ")[1:])) | {key: part[key].iloc[0], "used": False}
        if n < 4 or np.isnan(y).all():
            return pd.DataFrame([row])
        fits = {o: fit_arima(y, o) for o in grid}
        best = min(grid, key=lambda o: (fits[o]["aicc"] if np.isfinite(fits[o]["aicc"]) else np.inf, grid.index(o)))
        row |= dict(zip("pdq", best, strict=True)) | {"base_aicc": fits[best]["aicc"], "winner": "arima"}
        models = {"arima": None}
        tried = [(fit_arima(y, best, exog=x[:n, [j]]), j) for j in range(len(names)) if not np.isnan(x[:, j]).any() and np.ptp(x[:n, j])]
        if tried:
            fit, j = min(tried, key=lambda f: (f[0]["aicc"] if np.isfinite(f[0]["aicc"]) else np.inf, f[1]))
            coefficient, error = fit["beta"][-1], fit["se_beta"][-1]
            z = abs(coefficient) / error if error > 0 else math.nan
            used = bool(fit["aicc"] < row["base_aicc"] - gain)
            row |= {"exog": names[j], "aicc": fit["aicc"], "coefficient": coefficient, "p_value": math.erfc(z / math.sqrt(2)), "sign_ok": bool(coefficient * exog[names[j]] > 0) if exog[names[j]] else None, "used": used}
            if used:
                models[f"arima+{names[j]}"] = x[:, [j]]
        errors: dict[str, list[float]] = {m: [] for m in (*models, "last")}
        for t in range(min_train, n - horizon + 1, step):
            ahead = y[t : t + horizon]
            errors["last"] += np.abs(ahead - y[t - 1]).tolist()
            for m, r in models.items():
                fit = fit_arima(y[:t], best, exog=None if r is None else r[:t], ahead=horizon, exog_ahead=None if r is None else r[t : t + horizon])
                errors[m] += np.abs(ahead - fit["forecast"]).tolist()
        if errors["arima"]:
            mean = {m: np.nanmean(e) for m, e in errors.items()}
            row["winner"] = min(models, key=lambda m: (mean[m], m != "arima"))
            row["mase"] = mean[row["winner"]] / mean["last"] if mean["last"] > 0 else None
        if holdout:
            r = models[row["winner"]]
            fit = fit_arima(y, best, exog=None if r is None else r[:n], ahead=holdout, exog_ahead=None if r is None else r[n:])
            row["holdout_mae"] = float(np.nanmean(np.abs(whole[n:] - fit["forecast"])))
        return pd.DataFrame([row])

    return series.select(key, order, value, *names).groupBy(key).applyInPandas(run, fields)


def rolling_arima_errors(series: DataFrame, key: str, order: str, value: str, model: tuple[int, int, int] = (0, 1, 1)) -> DataFrame:
    """key, mae, mase of an ARIMA refitted at each rolling origin: comparable with rolling_origin()."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        y = part.sort_values(order)[value].to_numpy(float)
        mae, scale = rolling_arima(y, model), float(np.mean(np.abs(np.diff(y)))) if len(y) > 1 else 0.0
        return pd.DataFrame({key: part[key].iloc[:1], "mae": mae, "mase": mae / scale if scale > 0 else None})

    return series.select(key, order, value).groupBy(key).applyInPandas(run, f"{key} {dict(series.dtypes)[key]}, mae double, mase double")


def channel_drift(forecast: DataFrame, key: str, least: int = 1) -> DataFrame:
    """key, n_breach, coverage, verdict: DRIFT from `least` breaches of the one-shot interval on, else STABLE."""
    out = breach_summary(forecast, [key])
    return out.withColumn("verdict", F.when(F.col("n_breach") >= least, "DRIFT").otherwise("STABLE"))
