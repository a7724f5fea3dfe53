"""Streams give what the batch forms give."""

from pyspark.sql import functions as F

from roadloom.jobs.routing import find_routes
from roadloom.operators import tracking
from roadloom.sources import fixtures as fx
from roadloom.streaming.gps import filter_gps_stream, read_gps_stream, reroute_stream, router


def _feed(spark, sf, folder):
    fixes = fx.gps_fixes(spark, sf).where("device_id < 20").orderBy("ts_ms", "event_id").toPandas()
    half = len(fixes) // 2
    for part in (fixes[:half], fixes[half:]):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(folder)
    return spark.createDataFrame(fixes)


def test_stream_keeps_what_the_batch_keeps(spark, sf, tmp_path):
    fixes = _feed(spark, sf, str(tmp_path / "in"))
    stream = filter_gps_stream(read_gps_stream(spark, str(tmp_path / "in"), 1))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.event_id, r.lat_e7) for r in spark.read.parquet(str(tmp_path / "out")).where("moved").collect()}
    want = tracking.gps_positions(tracking.filter_gps(fixes)).select("event_id", "gps.lat_e7")
    assert got == {(r.event_id, r.lat_e7) for r in want.collect()}


def test_moving_sessions_are_routed_anew(spark, sf, tmp_path):
    _feed(spark, sf, str(tmp_path / "in"))
    end = F.struct(F.lit(470000000).alias("lat_e7"), F.lit(60000000).alias("lon_e7"))
    sessions = spark.range(20).select(F.col("id").alias("session_id"), F.col("id").alias("device_id"), F.lit(True).alias("follow_gps"), F.lit(None).cast("struct<lat_e7:int,lon_e7:int>").alias("start"), F.when(F.col("id") != 3, end).alias("end"))
    route = lambda r: r.select("request_id", "start", F.lit("routed").alias("summary"))
    reroute_stream(read_gps_stream(spark, str(tmp_path / "in")), sessions, route, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert rows["session_id"].is_unique and 3 not in set(rows["session_id"]) and len(rows) > 10


def test_routes_of_the_stream_are_the_batchs(spark, sf, tmp_path):
    """With the real router: every session's last route is what ``find_routes`` gives for its last position."""
    fixes = _feed(spark, sf, str(tmp_path / "in"))
    nodes, edges, details = fx.nodes(spark, sf), fx.edges(spark, sf), fx.edge_details(spark, sf)
    end = F.struct(F.lit(470000000).alias("lat_e7"), F.lit(60000000).alias("lon_e7")).alias("end")
    sessions = spark.range(5).select(F.col("id").alias("session_id"), F.col("id").alias("device_id"), F.lit(True).alias("follow_gps"), F.lit(None).cast("struct<lat_e7:int,lon_e7:int>").alias("start"), end)
    route = router(nodes, edges, details)
    reroute_stream(read_gps_stream(spark, str(tmp_path / "in")), sessions, route, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(300)
    got = {(r.session_id, r.dist, len(r.way)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    last = tracking.latest_request(tracking.gps_positions(tracking.filter_gps(fixes)).withColumnRenamed("device_id", "session_id"))
    asked = last.where("session_id < 5").select(F.col("session_id").alias("request_id"), F.col("gps").alias("start"), end)
    want = {(r.request_id, r.dist, len(r.way)) for r in find_routes(asked, nodes, edges, details).collect()}
    assert got == want and len(got) == 5


def test_fixes_in_json(spark, sf, tmp_path):
    """Any stream with a ``value`` in JSON, as Kafka gives it; what can't be read is ignored."""
    rows = fx.gps_fixes(spark, sf).where("device_id < 5")
    rows.select(F.to_json(F.struct("*")).alias("value")).union(spark.createDataFrame([("no json",)], "value string")).coalesce(1).write.text(str(tmp_path / "in"))
    stream = read_gps_stream(spark, spark.readStream.text(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.event_id, r.lat) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.event_id, r.lat) for r in rows.collect()}
