"""Power-flow residuals, their distribution, and the losses built on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.complexnum import Cx, cx
from gridweave.functions.numbers import exact_quantiles


def power_residual(bus: DataFrame, ybus: DataFrame) -> DataFrame:
    """dp and dq of every bus: set-point less V conj(Y V); dp null at the slack, dq null but at PQ buses.

    ``bus``: scenario_id, bus, bus_type (1 slack, 2 PV, 3 PQ), p_set, q_set, u_re, u_im; a row for each bus.
    An entry and the bus of its column meet in a window, its current and the bus of its row in a grouping:
    no join, and no shuffle if both tables come partitioned by scenario_id.
    """
    key, held = "scenario_id", [c for c in bus.columns if c not in ("scenario_id", "bus")]
    entry = {"__i": "bigint", "__re": "double", "__im": "double"}
    own = bus.select(key, F.col("bus").alias("__at"), *held, *[F.lit(None).cast(t).alias(c) for c, t in entry.items()])
    of = ybus.select(key, F.col("j").cast(bus.schema["bus"].dataType).alias("__at"), *[F.lit(None).cast(bus.schema[c].dataType).alias(c) for c in held], *[F.col(c[2:]).alias(c) for c in entry])
    at = Window.partitionBy(key, "__at")
    rows = own.unionByName(of).withColumns({f"__u_{x}": F.max(f"u_{x}").over(at) for x in ("re", "im")})
    part = Cx.of("__re", "__im") * cx("__u")
    rows = rows.withColumns({"bus": F.coalesce("__i", "__at"), "__own": F.col("__i").isNull()} | part.columns("__c"))
    rows = rows.groupBy(key, "bus").agg(F.max("__own").alias("__own"), *[F.max(c).alias(c) for c in held], *[F.coalesce(F.sum(f"__c_{x}"), F.lit(0.0)).alias(f"__c_{x}") for x in ("re", "im")])
    s = cx("u") * cx("__c").conj()
    rows = rows.where("__own").withColumns({"dp": F.when(F.col("bus_type") != 1, F.col("p_set") - s.re), "dq": F.when(F.col("bus_type") == 3, F.col("q_set") - s.im)})
    return rows.drop("__own", "__c_re", "__c_im")


def residual_inf(residual: DataFrame, *keys: str) -> DataFrame:
    """Largest |dp| and |dq| of each scenario; 0 where it has no such bus."""
    top = lambda c: F.coalesce(F.max(F.abs(c)), F.lit(0.0)).alias(f"{c}_inf")
    return residual.groupBy(*(keys or ["scenario_id"])).agg(top("dp"), top("dq"))


def residual_distribution(residual: DataFrame, tol: float = 1e-3) -> DataFrame:
    """Mean, median, p95, p99, rmse, share <= tol and count of |dp| and |dq| over the buses that have them; zeros if none has.

    The residuals are computed once and stored; quantiles are exact.
    """
    out, held = [], residual.select(F.abs("dp").alias("dp"), F.abs("dq").alias("dq")).checkpoint()
    for c in ("dp", "dq"):
        a = F.col(c)
        q = [F.lit(x).cast("double") for x in exact_quantiles(held, c, [0.5, 0.95, 0.99])]
        row = held.agg(F.avg(a).alias("mean"), F.sqrt(F.avg(a * a)).alias("rmse"), F.try_divide(F.count_if(a <= tol).cast("double"), F.count(a)).alias("within"), F.count(a).alias("n"))
        cols = {"mean": F.col("mean"), "median": q[0], "p95": q[1], "p99": q[2], "rmse": F.col("rmse"), "within": F.col("within")}
        out.append(row.select(F.lit(c).alias("part"), *[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in cols.items()], "n"))
    return out[0].unionByName(out[1])


def convergence_rate(inf: DataFrame, tol: float = 1e-3) -> DataFrame:
    """Share of scenarios whose largest residuals are both below ``tol``."""
    ok = ((F.col("dp_inf") < tol) & (F.col("dq_inf") < tol)).cast("long")
    return inf.agg(F.count("*").alias("n"), F.sum(ok).alias("converged"), F.avg(ok).alias("rate"))


def residual_mva(inf: DataFrame, s_base_mva: float) -> DataFrame:
    """Largest residuals in MW and Mvar."""
    return inf.withColumns({"dp_mw": F.col("dp_inf") * s_base_mva, "dq_mvar": F.col("dq_inf") * s_base_mva})


def _form(r: Column, form: str, delta: float) -> Column:
    if form == "mse":
        return r * r
    a = F.abs(r)
    if form == "huber":
        return F.when(a <= delta, 0.5 * r * r).otherwise(delta * (a - 0.5 * delta))
    # log cosh r = |r| + log(1 + exp(-2|r|)) - log 2, safe for large r
    return a + F.log1p(F.exp(-2 * a)) - math.log(2)


def physics_loss(residual: DataFrame, form: str = "mse", norm: str = "none", delta: float = 1.0, eps: float = 1e-6) -> DataFrame:
    """loss_dp and loss_dq, the mean loss of each part, and loss, that of both together.

    Without a norm, buses without a residual count as zeros; the loss is the mean
    over P and Q entries, but for ``mse`` the mean over buses of dp^2 + dq^2. With
    ``setpoint`` residuals are divided by |S| of the bus, with ``graph`` by the largest |S| of the
    scenario, ``eps`` at least; entries without a residual are left out of the one mean. No entries give 0.
    """
    df, size = residual, F.sqrt(F.col("p_set") * F.col("p_set") + F.col("q_set") * F.col("q_set"))
    if norm == "graph":
        top = residual.groupBy("scenario_id").agg(F.max(size).alias("__s"))
        df = residual.join(top, "scenario_id")
    elif norm == "setpoint":
        df = residual.withColumn("__s", size)
    parts = []
    for c in ("dp", "dq"):
        r = F.coalesce(F.col(c), F.lit(0.0)) if norm == "none" else F.col(c) / F.greatest(F.col("__s"), F.lit(eps))
        x = _form(r, form, delta)
        parts += [F.sum(x).alias(f"__{c}"), F.count(x).alias(f"__n_{c}")]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total, n = zero(F.col("__dp")) + zero(F.col("__dq")), F.col("__n_dp") + F.col("__n_dq")
    if norm == "none" and form == "mse":
        n = F.col("__n_dp")
    return df.agg(*parts).select(*[zero(F.try_divide(f"__{c}", f"__n_{c}")).alias(f"loss_{c}") for c in ("dp", "dq")], zero(F.try_divide(total, n)).alias("loss"))


def discounted_residual(trace: DataFrame, gamma: float) -> DataFrame:
    """Per scenario: sum over steps k of gamma^(K-1-k) times the mean dp^2 + dq^2 of that step.

    ``trace``: scenario_id, step (from 0), bus, dp, dq.
    """
    sq = lambda c: F.coalesce(F.col(c), F.lit(0.0)) ** 2
    steps = trace.groupBy("scenario_id", "step").agg(F.avg(sq("dp") + sq("dq")).alias("m"))
    last = steps.groupBy("scenario_id").agg(F.max("step").alias("last"))
    return steps.join(last, "scenario_id").groupBy("scenario_id").agg(F.sum(F.pow(F.lit(gamma), F.col("last") - F.col("step")) * F.col("m")).alias("loss"))


def combined_loss(df: DataFrame, weight: float, physics: str = "physics", mse: str = "mse") -> DataFrame:
    return df.withColumn("loss", F.col(physics) + weight * F.col(mse))
