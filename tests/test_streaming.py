from pyspark.sql import functions as F

from gridweave.operators.residual import power_residual, residual_inf
from gridweave.plans.grid import buses, matrix
from gridweave.streaming.residuals import watch_residuals

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    b = buses(spark, SF).where("scenario_id < 60")
    y = matrix(spark, SF).where("scenario_id < 60").cache()
    for k in range(3):
        b.where(F.col("scenario_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    watch_residuals(stream, y, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("scenario_id", F.round("dp_inf", 9), F.round("dq_inf", 9))
    want = residual_inf(power_residual(b, y)).select("scenario_id", F.round("dp_inf", 9), F.round("dq_inf", 9))
    assert got.count() == want.count() > 5 and got.exceptAll(want).count() == 0
