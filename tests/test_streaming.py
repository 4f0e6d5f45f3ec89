"""Row-local operators take a stream as they take a table."""

from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import filters


def test_row_local_operators_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Section 17 of the Act", "en"), (2, "", "de"), (3, None, None)], "id int, text string, lang string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = stream.select("id", T.provision_refs(F.col("text")).alias("refs"), T.intake_problem(F.col("text")).alias("problem"), filters.matches(F.col("lang"), "EN").alias("en"), T.bounded(F.col("text"), 9).alias("short"))
    q = out.writeStream.format("memory").queryName("row_local").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r.id: r for r in spark.sql("select * from row_local").collect()}
    assert got[1].refs == ["section 17"] and got[1].en and got[1].short == "Section"
    assert got[2].problem == got[3].problem == "blank" and not got[3].en
