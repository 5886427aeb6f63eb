"""Solver traces (scenario_id, iter, misinf, step) and training histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


# Limits of the judgement below.
NEAR, BLOW_UP, RISE, OFF_BEST = 1e-3, 2.0, 1.05, 1.2
LITTLE, HALF, RECENT, FLAT = 0.10, 0.50, 5, 0.02


def classify_nonconvergence(trace: DataFrame, scenarios: DataFrame | None = None, near: float = NEAR) -> DataFrame:
    """Why each run did not converge, the first that holds of:

    near_convergence_not_passing_step: the last or least mismatch is at most ``near``;
    divergence: the last is twice the first or more, or it rose in at least half (and 3) of
    the steps and ends above the least; stagnation: less than a tenth won over all, or less
    than half with the last five flat; else slow_convergence. ``scenarios`` without a trace
    are no_progress_data.
    """
    w = Window.partitionBy("scenario_id").orderBy("iter")
    back = F.row_number().over(Window.partitionBy("scenario_id").orderBy(F.desc("iter")))
    t = trace.withColumns({"before": F.lag("misinf").over(w), "back": back})
    a = t.groupBy("scenario_id").agg(
        F.count("*").alias("n"),
        F.min_by("misinf", "iter").alias("first"),
        F.max_by("misinf", "iter").alias("last"),
        F.min("misinf").alias("best"),
        F.count_if(F.col("misinf") > RISE * F.col("before")).alias("rises"),
        F.min_by("misinf", F.when(F.col("back") <= RECENT, F.col("iter"))).alias("recent"),
    )
    first, last, best = (F.col(c) for c in ("first", "last", "best"))
    safe = F.greatest(first, F.lit(1e-15))
    won, lately = (first - last) / safe, (F.col("recent") - last) / F.greatest("recent", F.lit(1e-15))
    reason = (
        F.when((last <= near) | (best <= near), "near_convergence_not_passing_step")
        .when(last / safe >= BLOW_UP, "divergence")
        .when((F.col("rises") >= F.greatest(F.lit(3), F.floor(F.col("n") / 2))) & (last > OFF_BEST * best), "divergence")
        .when((won < LITTLE) | ((lately < FLAT) & (won < HALF)), "stagnation")
        .otherwise("slow_convergence")
    )
    out = a.select("scenario_id", "n", "last", reason.alias("reason"))
    if scenarios is not None:
        out = scenarios.select("scenario_id").distinct().join(out, "scenario_id", "left").fillna({"n": 0, "reason": "no_progress_data"})
    return out


def convergence_iteration(trace: DataFrame, tol: float, step_tol: float, scale: str | None = None) -> DataFrame:
    """First iteration with misinf < tol * max(1, scale), and the first that ends two steps below ``step_tol``; null if none."""
    w = Window.partitionBy("scenario_id").orderBy("iter")
    t = trace.withColumn("before", F.lag("step").over(w))
    limit = tol * F.greatest(F.lit(1.0), F.col(scale)) if scale else F.lit(tol)
    by_mis = F.min(F.when(F.col("misinf") < limit, F.col("iter")))
    by_step = F.min(F.when((F.col("step") < step_tol) & (F.col("before") < step_tol), F.col("iter")))
    return t.groupBy("scenario_id").agg(by_mis.alias("by_misinf"), by_step.alias("by_step"))


def history_tail(trace: DataFrame, k: int = 5) -> DataFrame:
    """The last k values of each trace, in order (only those are gathered)."""
    back = F.row_number().over(Window.partitionBy("scenario_id").orderBy(F.desc("iter")))
    few = trace.withColumn("__b", back).where(F.col("__b") <= k)
    return few.groupBy("scenario_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("iter", "misinf"))), lambda x: x["misinf"]).alias("tail"))


def best_epoch(history: DataFrame) -> DataFrame:
    """Epoch of least magnitude plus angle rmse of each run, the earliest if several."""
    score = F.col("rmse_mag") + F.col("rmse_ang_deg")
    return history.groupBy("run_id").agg(F.min(F.struct(score.alias("score"), "epoch")).alias("b")).select("run_id", "b.epoch", "b.score")


def running_best(history: DataFrame) -> DataFrame:
    """Adds best: the least score up to each epoch."""
    w = Window.partitionBy("run_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("best", F.min(F.col("rmse_mag") + F.col("rmse_ang_deg")).over(w))


def warmstart_savings(trace: DataFrame, flat: str = "flat", model: str = "model") -> DataFrame:
    """Iterations of two start modes (mode, scenario_id, iterations, converged): mean, median, max, share converged, saved."""
    def of(mode):
        on = F.col("mode") == mode
        it = F.when(on, F.col("iterations"))
        return [F.avg(it).alias(f"{mode}_mean"), F.percentile(it, F.lit(0.5)).alias(f"{mode}_median"), F.max(it).alias(f"{mode}_max"), F.avg(F.when(on, F.col("converged"))).alias(f"{mode}_converged")]

    out = trace.agg(*of(flat), *of(model))
    saved = F.col(f"{flat}_mean") - F.col(f"{model}_mean")
    return out.withColumns({"saved": saved, "saved_percent": F.try_divide(100 * saved, f"{flat}_mean")})
