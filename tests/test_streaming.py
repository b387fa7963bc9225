from lineaspark.operators.regions import region_features
from lineaspark.streaming.regions import running_regions

PIXELS = "movie string, t int, z int, y int, x int, label int, value double"


def test_running_regions(spark, tmp_path):
    rows = [("m", t, 0, y, x, 1 + (y + x) % 3, float(y)) for t in range(2) for y in range(4) for x in range(3)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], PIXELS).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(PIXELS).parquet(f"{tmp_path}/in/*")
    query = running_regions(stream).writeStream.outputMode("complete").format("memory").queryName("regions").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.t, r.label): (r.area, r.cy, r.int_mean) for r in spark.table("regions").collect()}
    want = {(r.t, r.label): (r.area, r.cy, r.int_mean) for r in region_features(spark.createDataFrame(rows, PIXELS), 9, 9).collect()}
    assert got == want
