"""Experiment runs: ranking, Pareto front, comparison to a baseline, benchmark rows, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions.joins import rank_within


def rank_runs(runs: DataFrame, metric: str = "rmse_ang_deg", by: str = "config") -> DataFrame:
    """Adds the rank of each run by ``metric`` among those of the same ``by``, equal values alike."""
    return rank_within(runs, [by], metric)


def _front(runs: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    points = runs.groupBy(*keys, x).agg(F.min(y).alias("__y"))
    w = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    low = points.withColumn("__low", F.min("__y").over(w)).drop("__y")
    return runs.join(low, [*keys, x]).where(F.col("__low").isNull() | (F.col(y) <= F.col("__low"))).drop("__low")


def pareto_front(runs: DataFrame, x: str = "rmse_mag", y: str = "rmse_ang_deg", by: str | None = None, salts: int = 64) -> DataFrame:
    """Runs that no other beats strictly on both objectives.

    A run that is beaten is beaten by one of the front of some salt, so fronts of salts come first, and
    only they meet in their group. There only the least y of each x matters, beside the least y of all smaller x.
    """
    keys = [by] if by else []
    salted = runs.withColumn("__s", F.pmod(F.xxhash64(x, y), F.lit(salts)))
    return _front(_front(salted, [*keys, "__s"], x, y).drop("__s"), keys, x, y)


def compare_to_baseline_run(metrics: DataFrame, baseline: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Percent change against a baseline, and a signed factor: minus base/current if smaller, else current/base, infinite for a current of zero; a base of zero or NaN gives null."""
    b = baseline.select(*keys, F.col(value).alias("base"))
    cur, base = F.col(value), F.col("base")
    ok = (base != 0) & ~F.isnan(base) & ~F.isnan(cur)
    change = F.when(ok, 100 * (cur - base) / base)
    endless = F.when(change < 0, float("-inf")).otherwise(float("inf"))
    factor = F.when(ok & (cur == 0), endless).when(ok & (cur < base), -F.abs(base / cur)).when(ok, F.abs(cur / base))
    return metrics.join(b, keys).withColumns({"pct_change": change, "factor": factor})


def bench_summary(bench: DataFrame, base_method: str) -> DataFrame:
    """Per size and method: median and mean ms, cases per second, and speedup over ``base_method``; null where no time passed."""
    s = bench.groupBy("n", "method").agg(F.percentile("ms", F.lit(0.5)).alias("median_ms"), F.avg("ms").alias("mean_ms"), F.try_divide(1e3 * F.sum("cases"), F.sum("ms")).alias("cases_per_s"))
    b = s.where(F.col("method") == base_method).select("n", F.col("median_ms").alias("__b"))
    return s.join(b, "n", "left").withColumn("speedup", F.try_divide("__b", "median_ms")).drop("__b")


def file_label(path: str, parts: int = 3):
    """First ``parts`` tokens of a file's name, joined by ``_and_``."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.array_join(F.slice(F.split(name, "_"), 1, parts), "_and_")


def model_tag(model):
    """A model's name, shortened: without its family prefix, attention abbreviated, in lower case with underscores."""
    s = F.regexp_replace(model, "^GNSMsg_?", "")
    for long in ("SelfAttention", "SelfAttn"):
        s = F.regexp_replace(s, long, "Attn")
    return F.lower(F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def dataset_tag(paths):
    """An array of file paths as a tag: family and solver from the first name's tokens, if the second is a number, their count, and six digits of a sha1 over the sorted names."""
    stems = F.array_sort(F.transform(paths, lambda p: F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"(?<=.)\.[^.]*$", "")))
    tokens, n = F.split(F.get(stems, F.lit(0)), "_"), F.size(stems).cast("string")
    digest = F.substring(F.sha1(F.array_join(stems, "|")), 1, 6)
    known = (F.size(tokens) >= 3) & F.get(tokens, F.lit(1)).rlike("^[0-9]+$")
    head = F.when(known, F.concat_ws("_", F.lower(F.get(tokens, F.lit(0))), F.lower(F.get(tokens, F.lit(2))))).otherwise("ds")
    return F.when(F.size(stems) == 0, "ds_n0").otherwise(F.concat(head, F.lit("_n"), n, F.lit("_"), digest))


def run_slug(paths, model, k, d, d_hi, **flags):
    """dataset, model and sizes of a run, then its flags: ``pinn``, ``block_diag``, ``per_unit`` (booleans) and ``split_mode``."""
    on = lambda name, tag: F.when(flags[name], tag) if name in flags else F.lit(None)
    marks = [on("pinn", "pinn"), on("block_diag", "blk"), on("per_unit", "pu"), F.when(flags["split_mode"] == "equal3", "eq3") if "split_mode" in flags else F.lit(None)]
    core = F.concat(dataset_tag(paths), F.lit("_"), model_tag(model), F.lit("_k"), k, F.lit("_d"), d, F.lit("_h"), d_hi)
    return F.concat_ws("_", core, *[m.cast("string") for m in marks])


def run_id(slug, at):
    """A time of start and four digits of the slug's sha1."""
    return F.concat(F.date_format(at, "yyMMdd-HHmmss"), F.lit("_"), F.substring(F.sha1(slug), 1, 4))


# What run logs are searched for, and what holds where nothing is found.
LOG_KEYS = {
    "model": (r"MODEL:(\S+?),", "GNSMsg_EdgeSelfAttn_VnFeat"),
    "d": (r"\bd:\s*(\d+)", "4"),
    "d_hi": (r"\bd_hi:\s*(\d+)", "16"),
    "attn_layers": (r"\battn_layers:\s*(\d+)", "1"),
    "k": (r"\bK:\s*(\d+)", "10"),
    "dtheta_max": (r"DthetaMax:\s*([\d.]+)", "0.30"),
    "dvm_frac": (r"DvmFrac:\s*([\d.]+)", "0.10"),
}


def parse_run_logs(logs: DataFrame, text: str = "value") -> DataFrame:
    """Adds a run's settings as its log first states them, with defaults; each row holds a whole log (say, read with ``wholetext``). Null and empty logs have the defaults."""
    kinds = {"model": "string", "dtheta_max": "double", "dvm_frac": "double"}
    pick = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return logs.withColumns({c: F.coalesce(pick(p), F.lit(default)).cast(kinds.get(c, "int")) for c, (p, default) in LOG_KEYS.items()})


def _as_text(v):
    """A JSON leaf as settings are logged: null as ``null``, truth values as True and False, texts as they are."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "VOID", "null").when(kind == "BOOLEAN", F.initcap(v.cast("string"))).otherwise(v.cast("string"))


def flatten_config(df: DataFrame, key: str, column: str) -> DataFrame:
    """Nested JSON objects of any depth as rows (key, path, value) with dotted paths; a round for each level.

    Lists are joined by commas, with null as ``None`` in them; null is ``null``. Empty
    objects have no rows. Text that is no JSON object, and null, have none either.
    """
    is_object = lambda c: F.coalesce(F.schema_of_variant(c).startswith("OBJECT"), F.lit(False))
    level = df.select(key, F.lit("").alias("path"), F.try_parse_json(column).alias("v")).where(is_object(F.col("v")))
    done = None
    while True:
        entries = F.explode(F.col("v").cast("map<string,variant>")).alias("k", "v")
        level = level.select(key, "path", entries).select(key, F.concat("path", F.when(F.col("path") != "", ".").otherwise(""), "k").alias("path"), "v").checkpoint()
        kind = F.schema_of_variant("v")
        listed = F.transform(F.when(kind.startswith("ARRAY"), F.col("v").cast("array<variant>")), lambda x: F.when(F.schema_of_variant(x) == "VOID", "None").otherwise(_as_text(x)))
        leaf = level.where(~is_object(F.col("v"))).select(key, "path", F.coalesce(F.array_join(listed, ","), _as_text(F.col("v"))).alias("value"))
        done = leaf if done is None else done.unionByName(leaf)
        level = level.where(is_object(F.col("v")))
        if level.isEmpty():
            return done
