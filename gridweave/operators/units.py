"""Units, per-unit bases, bus-type codes and branch parameters (projections of long tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.functions.complexnum import Cx, cx


# Bus-type codes of each convention, from (1 slack, 2 PV, 3 PQ).
BUS_TYPES = {
    "hvn": {1: 1, 2: 2, 3: 0},
    "ppc": {1: 3, 2: 2, 3: 1},
    "names": {1: "REF", 2: "PV", 3: "PQ"},
}


def infer_bus_count(bus_typ="bus_typ", y_matrix="Y_matrix", pairs="pairs") -> Column:
    """Bus count: length of the types, else the root of the matrix length, else from the pair count."""
    return F.coalesce(
        F.nullif(F.size(bus_typ), F.lit(-1)),
        F.round(F.sqrt(F.nullif(F.size(y_matrix), F.lit(-1)))).cast("int"),
        F.floor((1 + F.sqrt(1 + 8.0 * F.col(pairs))) / 2).cast("int"),
    )


def with_endpoint_bases(branch: DataFrame, bus: DataFrame, base: str = "vn_kv") -> DataFrame:
    """Adds v_f and v_t, the base voltages of both ends of every branch."""
    f = bus.select("scenario_id", F.col("bus").alias("f_bus"), F.col(base).alias("v_f"))
    t = bus.select("scenario_id", F.col("bus").alias("t_bus"), F.col(base).alias("v_t"))
    return branch.join(f, ["scenario_id", "f_bus"]).join(t, ["scenario_id", "t_bus"])


def branch_admittance(branch: DataFrame, s_base: float | None = None) -> DataFrame:
    """Adds y_from, y_to, y_ft, ysh_f, ysh_t (``_re``, ``_im``) from r, x, b and optional g and to-side parameters.

    Zero impedance gives zero admittance and a tap of 0 counts as 1. With
    ``s_base`` (VA) and columns v_f, v_t (V) the values are in siemens, else per unit.
    """
    has = lambda c: F.coalesce(F.col(c), F.lit(0.0)) if c in branch.columns else F.lit(0.0)
    y_f = Cx.of("r", "x").inverse()
    y_t = Cx(F.col("r") + has("r_asym"), F.col("x") + has("x_asym")).inverse()
    sh_f, sh_t = Cx(has("g"), has("b")), Cx(has("g") + has("g_asym"), has("b") + has("b_asym"))
    y_ft = y_f
    if s_base is not None:
        vf, vt = F.col("v_f"), F.col("v_t")
        y_f, y_t, y_ft = y_f * (s_base / (vf * vf)), y_t * (s_base / (vt * vt)), y_ft * (s_base / (vf * vt))
        sh_f, sh_t = sh_f * (s_base / (vf * vf)), sh_t * (s_base / (vt * vt))
    made = {}
    for name, y in (("y_from", y_f), ("y_to", y_t), ("y_ft", y_ft), ("ysh_f", sh_f), ("ysh_t", sh_t)):
        made |= y.columns(name)
    tap = {"tau": F.when(F.col("tau") == 0, 1.0).otherwise(F.col("tau"))} if "tau" in branch.columns else {}
    return branch.withColumns(made | tap)


def to_per_unit(branch: DataFrame, s_base: float) -> DataFrame:
    """Admittances in siemens to per unit on the bases v_f, v_t (V) of the two ends."""
    vf, vt = F.col("v_f"), F.col("v_t")
    scale = {"y_from": vf * vf, "ysh_f": vf * vf, "y_to": vt * vt, "ysh_t": vt * vt, "y_ft": vf * vt}
    return branch.withColumns({k: v for name, s in scale.items() for k, v in (cx(name) * (s / s_base)).columns(name).items()})


def buses_to_per_unit(bus: DataFrame, s_base: float) -> DataFrame:
    """Bus values u (V), s (VA) and ysh (S) to per unit; base voltage vn_kv. A base of 0 kV gives no u."""
    vb = F.col("vn_kv") * 1e3
    return bus.withColumns((cx("u") * F.try_divide(F.lit(1.0), vb)).columns("u") | (cx("s") * (1 / s_base)).columns("s") | (cx("ysh") * (vb * vb / s_base)).columns("ysh"))


def to_per_unit_scalar(df: DataFrame, u_base: float, s_base: float) -> DataFrame:
    """One base for all: y by S/U^2, i by S/U, u by U, s by S, where these columns exist."""
    base = {"y": s_base / u_base**2, "i": s_base / u_base, "u": u_base, "s": s_base}
    return df.withColumns({k: v for n, b in base.items() if f"{n}_re" in df.columns for k, v in (cx(n) * (1 / b)).columns(n).items()})


def to_si(ybus: DataFrame, s_base: float) -> DataFrame:
    """Per-unit matrix entries (with v_i, v_j in V) to siemens; null where a base is 0."""
    return ybus.withColumns((Cx.of("re", "im") * F.try_divide(F.lit(float(s_base)), F.col("v_i") * F.col("v_j"))).columns("y")).withColumns({"re": F.col("y_re"), "im": F.col("y_im")}).drop("y_re", "y_im")


def rebase_sbase(df: DataFrame, old: float, new: float, names: tuple[str, ...]) -> DataFrame:
    """Per-unit powers and admittances ``names`` from one power base to another; voltages do not change."""
    return df.withColumns({n: F.col(n) * (old / new) for n in names})


def to_polar(df: DataFrame, name: str) -> DataFrame:
    return df.withColumns({f"{name}_abs": cx(name).abs(), f"{name}_ang": cx(name).angle()})


def to_rect(df: DataFrame, magnitude: str, angle: str, name: str) -> DataFrame:
    return df.withColumns(Cx.polar(magnitude, angle).columns(name))


def remap_bus_type(code: str, convention: str) -> Column:
    """A bus type (1 slack, 2 PV, 3 PQ) in another convention; unknown codes become null."""
    out = None
    for k, v in BUS_TYPES[convention].items():
        out = F.when(F.col(code) == k, v) if out is None else out.when(F.col(code) == k, v)
    return out


def voltage_class_feature(bus: DataFrame, mode: str) -> DataFrame:
    """Adds vn_feature: 0 (``none``), share of the scenario's largest kV (``norm``), or log10 (``log``)."""
    if mode == "none":
        return bus.withColumn("vn_feature", F.lit(0.0))
    if mode == "log":
        return bus.withColumn("vn_feature", F.log10(F.col("vn_kv") + 1e-9))
    top = bus.groupBy("scenario_id").agg(F.greatest(F.max("vn_kv"), F.lit(1.0)).alias("__top"))
    return bus.join(top, "scenario_id").withColumn("vn_feature", F.col("vn_kv") / F.col("__top")).drop("__top")


def is_transformer(tol: float = 1e-12) -> Column:
    """Tap other than 1, any shift, or ends of different kV (needs v_f, v_t in kV)."""
    return (F.abs(F.col("tau") - 1) > tol) | (F.abs("shift_deg") > tol) | (F.abs(F.col("v_f") - F.col("v_t")) > 1e-6)


def hv_side_ratio(branch: DataFrame) -> DataFrame:
    """Adds hv_is_f and n, the ratio of the higher to the lower base voltage (1 where that is not positive)."""
    hi, lo = F.greatest("v_f", "v_t"), F.least("v_f", "v_t")
    return branch.withColumns({"hv_is_f": F.col("v_f") >= F.col("v_t"), "n": F.when(lo > 0, F.try_divide(hi, lo)).otherwise(1.0)})


def line_view(branch: DataFrame) -> DataFrame:
    """Adds y_line and c_line: series admittance and half the charging of plain lines, null for transformers."""
    plain = ~is_transformer()
    return branch.withColumns({"y_line_re": F.when(plain, F.col("y_ft_re")), "y_line_im": F.when(plain, F.col("y_ft_im")), "c_line": F.when(plain, 0.5 * F.col("ysh_f_im"))})


def pair_index(i, j, n) -> Column:
    """Place of the pair i > j among the N(N-1)/2 pairs, column by column."""
    i, j, n = (F.col(c) if isinstance(c, str) else c for c in (i, j, n))
    return j * n - F.floor(j * (j + 1) / 2) + (i - j - 1)


def pair_of(place, n) -> tuple[Column, Column]:
    """i and j of a place, the inverse of ``pair_index``."""
    place, n = (F.col(c) if isinstance(c, str) else c for c in (place, n))
    start = lambda j: j * n - F.floor(j * (j + 1) / 2)
    j = F.floor(((2 * n - 1) - F.sqrt((2 * n - 1) * (2 * n - 1) - 8.0 * place)) / 2)
    # The root is rounded: step to the column that holds the place.
    j = j + F.when(place < start(j), -1).when(place >= start(j + 1), 1).otherwise(0)
    return (place - start(j) + j + 1).cast("long"), j.cast("long")
