"""Voltage errors of predictions against labels; tables (run_id, scenario_id, bus, vm, va)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.complexnum import Cx, wrap
from gridweave.functions.numbers import exact_quantiles


def pred_vs_truth(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Predictions next to labels per bus, with dvm and the wrapped angle difference dva."""
    t = truth.select("scenario_id", "bus", F.col("vm").alias("vm_true"), F.col("va").alias("va_true"))
    return pred.join(t, ["scenario_id", "bus"]).withColumns({"dvm": F.col("vm") - F.col("vm_true"), "dva": wrap(F.col("va") - F.col("va_true"))})


def voltage_rmse(matched: DataFrame, *keys: str) -> DataFrame:
    """rmse of magnitude and angle (radians) together, of magnitude, and of angle in degrees, by ``keys``."""
    both = F.col("dvm") * F.col("dvm") + F.col("dva") * F.col("dva")
    ms = lambda c: F.sqrt(F.avg(c * c))
    return matched.groupBy(*keys).agg(
        F.sqrt(F.avg(both)).alias("rmse"), ms(F.col("dvm")).alias("rmse_mag"), ms(F.degrees("dva")).alias("rmse_ang_deg"), F.count("*").alias("n")
    )


def mag_ang_mse(matched: DataFrame, *keys: str, w_mag: float = 1.0, w_ang: float = 1 / math.pi) -> DataFrame:
    """Mean over buses of the squared differences, each divided by its weight, magnitude plus angle."""
    m, a = F.col("dvm") / w_mag, F.col("dva") / w_ang
    return matched.groupBy(*keys).agg(F.avg(m * m + a * a).alias("mse"))


def baseline_reduction(start: DataFrame, model: DataFrame, truth: DataFrame, *keys: str) -> DataFrame:
    """rmse of a start guess and of a model by ``keys``, and how many times smaller the model's is."""
    s = voltage_rmse(pred_vs_truth(start, truth), *keys).select(*keys, F.col("rmse_mag").alias("start_mag"), F.col("rmse_ang_deg").alias("start_ang"))
    m = voltage_rmse(pred_vs_truth(model, truth), *keys).select(*keys, F.col("rmse_mag").alias("model_mag"), F.col("rmse_ang_deg").alias("model_ang"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return s.join(m, list(keys)).withColumns({"mag_ratio": ratio("start_mag", "model_mag"), "ang_ratio": ratio("start_ang", "model_ang")})


def drop_diverged(voltage: DataFrame) -> DataFrame:
    """Voltages of scenarios whose solution is not all zero; scenarios without buses are gone anyway."""
    ok = voltage.groupBy("scenario_id").agg(F.max(F.abs("vm")).alias("__top")).where("__top > 0").select("scenario_id")
    return voltage.join(ok, "scenario_id", "left_semi")


def is_converged(voltage: DataFrame, tol: float = 1e-8) -> DataFrame:
    """Per scenario: whether any voltage exceeds ``tol``."""
    return voltage.groupBy("scenario_id").agg((F.max(F.abs("vm")) > tol).cast("long").alias("converged"))


def _finite(x):
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def iqr_bounds(voltage: DataFrame, k: float = 1.5) -> DataFrame:
    """One row: exact quartiles of the real and imaginary parts over all finite values, and the outlier bounds; nulls without values."""
    u = Cx.polar("vm", "va")
    ok = voltage.select(u.re.alias("re"), u.im.alias("im")).where(_finite(F.col("re")) & _finite(F.col("im"))).checkpoint()
    out = {}
    for c in ("re", "im"):
        lo, hi = (F.lit(x).cast("double") for x in exact_quantiles(ok, c, [0.25, 0.75]))
        out |= {f"{c}_q1": lo, f"{c}_q3": hi, f"{c}_low": lo - k * (hi - lo), f"{c}_high": hi + k * (hi - lo)}
    return voltage.sparkSession.range(1).select(*[v.alias(n) for n, v in out.items()])


def drop_voltage_outliers(voltage: DataFrame, k: float = 1.5) -> DataFrame:
    """Voltages of the scenarios none of whose values lie outside the bounds (a one-row broadcast).

    Values that are not finite are left out of the bounds and of the test.
    """
    u = Cx.polar("vm", "va")
    marked = voltage.crossJoin(F.broadcast(iqr_bounds(voltage, k)))
    bad = _finite(u.re) & _finite(u.im) & ~(u.re.between(F.col("re_low"), F.col("re_high")) & u.im.between(F.col("im_low"), F.col("im_high")))
    out = marked.where(bad).select("scenario_id").distinct()
    return voltage.join(out, "scenario_id", "left_anti")


def voltage_extremes(voltage: DataFrame, *keys: str) -> DataFrame:
    """Smallest and largest magnitude and the bus of each (the lowest number, if several)."""
    lo, hi = F.min(F.struct("vm", "bus")), F.max(F.struct(F.col("vm"), -F.col("bus")))
    return voltage.groupBy(*keys).agg(lo.alias("lo"), hi.alias("hi")).select(*keys, F.col("lo.vm").alias("vm_min"), F.col("lo.bus").alias("bus_min"), F.col("hi.vm").alias("vm_max"), (-F.col("hi.col2")).alias("bus_max"))


def start_distance(start: DataFrame, solved: DataFrame) -> DataFrame:
    """Per start mode (run_id): largest |U0 - U| over all buses of each scenario."""
    m = pred_vs_truth(start, solved)
    gap = (Cx.polar("vm", "va") - Cx.polar("vm_true", "va_true")).abs()
    return m.groupBy("run_id", "scenario_id").agg(F.max(gap).alias("distance"))
