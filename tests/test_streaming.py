from pyspark.sql import functions as F

from tabcal.functions.rules import domain_group
from tabcal.functions.text import normalize_blanks
from tabcal.operators.recode import recode_pairs


def test_row_level_operators_run_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(5.0, None), (None, " N/A "), (1.0, "PVA")], "a double, t string").write.parquet(source)
    stream = spark.readStream.schema("a double, t string").parquet(source)
    out = recode_pairs(normalize_blanks(stream), [("p", "a", "t")]).withColumn("g", domain_group(F.col("t")))
    job = out.writeStream.format("memory").queryName("recoded").trigger(availableNow=True).start()
    job.awaitTermination(120)
    got = {(r.a, r.t, r.g) for r in spark.table("recoded").collect()}
    assert got == {(5.0, "unknown_type", "unknown_type"), (0.0, "not_applicable", "not_applicable"), (1.0, "PVA", "fiber_pva")}
