"""The session log as a stream gives what its batch form gives, however its rows fall into micro-batches."""

import random

import pytest
from pyspark.sql import functions as F
from roadloom.operators import sessions, tracking
from roadloom.sources import fixtures as fx
from roadloom.streaming.gps import router
from roadloom.streaming.sessions import kept_fixes_stream, reroute_sessions, session_requests_stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"
DELAY_MS = 40_000


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    yield
    spark.conf.set(STORE, before)


@pytest.fixture(scope="module")
def log(spark, sf):
    """The log of a few devices, and far later rows that let the watermark pass all others."""
    return sessions.event_log(*fx.session_log(spark, sf)).where("device_id < 6").collect()


def _feed(spark, rows, folder, seed, cuts):
    """Rows in order of an arrival up to ``DELAY_MS`` after their time, in ``cuts`` files, and one that ends the log."""
    r = random.Random(seed)
    came = sorted(rows, key=lambda x: x["ts_ms"] + r.randrange(DELAY_MS))
    at = sorted(r.sample(range(1, len(came)), cuts - 1))
    last = [(-1, -1, None, 10**12 + k, "fix", 1.0, None, 0, 0) for k in range(2)]
    parts = [came[a:b] for a, b in zip([0, *at], [*at, len(came)], strict=True)] + [last[:1], last[1:]]
    for part in parts:
        spark.createDataFrame(part, sessions.LOG).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(sessions.LOG).option("maxFilesPerTrigger", 1).parquet(folder)


def _run(stream, tmp_path):
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out")).where("device_id >= 0").collect()


def _batch(spark, log):
    return spark.createDataFrame(log, sessions.LOG)


@pytest.mark.parametrize(("seed", "cuts"), [(1, 5), (2, 9)])
def test_stream_of_requests_is_the_batch(spark, log, rocks, tmp_path, seed, cuts):
    got = _run(session_requests_stream(_feed(spark, log, str(tmp_path / "in"), seed, cuts), f"{DELAY_MS} milliseconds"), tmp_path)
    want = sessions.session_requests(_batch(spark, log)).select(*got[0].__fields__).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 100


def test_stream_of_kept_fixes_is_the_batch(spark, log, rocks, tmp_path):
    """Disorder across micro-batches too."""
    got = _run(kept_fixes_stream(_feed(spark, log, str(tmp_path / "in"), 3, 6), f"{DELAY_MS} milliseconds"), tmp_path)
    fixes = _batch(spark, log).where("kind = 'fix'").withColumns({"lat": F.lit(0.0), "lon": F.lit(0.0)})
    batch = tracking.filter_gps(fixes)
    want = batch.collect()
    assert sorted((r.event_id, r.lat_e7, r.lon_e7) for r in got) == sorted((r.event_id, r.lat_e7, r.lon_e7) for r in want)
    moved = tracking.changes_only(batch.withColumn("gps", F.struct("lat_e7", "lon_e7")), "device_id", ["ts_ms", "event_id"], "gps")
    assert {r.event_id for r in got if r.moved} == {r.event_id for r in moved.collect()}


def _plain(rows):
    """Every rule at once, row by row."""
    device, held, out = {}, {}, []
    for r in sorted(rows, key=lambda r: (r["device_id"], r["ts_ms"], r["event_id"])):
        d = device.setdefault(r["device_id"], {"last": (None, None), "gps": None})
        point = (r["lat_e7"], r["lon_e7"]) if r["lat_e7"] is not None and r["lon_e7"] is not None else None
        if r["kind"] == "fix":
            if not tracking.keep_fix(r["ts_ms"], r["accuracy"], *d["last"]):
                continue
            d.update(last=(r["ts_ms"], r["accuracy"]), gps=point)
        elif r["kind"] == "gps_off":
            d["gps"] = None
        else:
            s = held.setdefault((r["device_id"], r["session_id"]), {"start": None, "end": None, "follow": True, "drag": False, "asked": None})
            s[r["kind"]] = point if r["kind"] in ("start", "end") else r["flag"]
        for (device_id, session_id), s in held.items():
            if device_id != r["device_id"] or (r["kind"] not in ("fix", "gps_off") and session_id != r["session_id"]) or s["drag"]:
                continue
            start = (d["gps"] or s["start"]) if s["follow"] else (s["start"] or d["gps"])
            now = (start, s["end"]) if start and s["end"] else None
            if now != s["asked"]:
                s["asked"] = now
                out.append((session_id, r["event_id"], now))
    return out


def test_batch_is_the_plain_rule(spark):
    r = random.Random(9)
    rows = []
    for i in range(1500):
        kind = r.choice(["fix"] * 6 + ["gps_off", "start", "end", "follow", "drag"])
        point = (r.randrange(3), r.randrange(2)) if kind in ("fix", "start", "end") and (kind == "fix" or r.random() < 0.8) else (None, None)
        rows.append((i, r.randrange(3), None if kind in ("fix", "gps_off") else r.randrange(2), r.randrange(400) * 1000, kind, float(r.randrange(30)) if kind == "fix" else None, r.random() < 0.5 if kind in ("follow", "drag") else None, *point))
    df = spark.createDataFrame(rows, sessions.LOG)
    point = lambda p: (p.lat_e7, p.lon_e7)
    got = [(x.session_id, x.event_id, (point(x.start), point(x.end)) if x.end else None) for x in sessions.session_requests(df).collect()]
    key = lambda x: (x[1], x[0])
    assert sorted(got, key=key) == sorted(_plain(df.collect()), key=key) and len(got) > 50


def test_log_ignores_what_it_cannot_use(spark):
    fixes = spark.createDataFrame([(1, 1, 5, 3.0, 48.0, 9.0), (2, 1, None, 3.0, 48.0, 9.0), (3, 1, 6, None, 48.0, 9.0)], "event_id long, device_id long, ts_ms long, accuracy double, lat double, lon double")
    changes = [(4, 1, 7, 5, "start", None, None, 1, 2), (5, 1, None, 5, "end", None, None, 1, 2), (6, 1, 7, 5, "drag", None, None, None, None), (7, 1, 7, 5, "other", None, True, None, None), (8, 1, None, 9, "gps_off", None, None, None, None)]
    log = sessions.event_log(fixes, spark.createDataFrame(changes, sessions.LOG))
    assert sorted(r.event_id for r in log.collect()) == [1, 4, 8]
    assert sessions.session_requests(log.where("FALSE")).count() == 0


def test_sessions_are_routed_as_they_change(spark, sf, rocks, log, tmp_path):
    """Of each batch a session's newest request is routed; the last row of a session is its last request's route."""
    rows = [r for r in log if r["device_id"] < 2]
    stream = _feed(spark, rows, str(tmp_path / "in"), 4, 2)
    route = router(fx.nodes(spark, sf), fx.edges(spark, sf), fx.edge_details(spark, sf))
    reroute_sessions(stream, route, str(tmp_path / "out"), str(tmp_path / "cp"), f"{DELAY_MS} milliseconds").awaitTermination(400)
    got = spark.read.parquet(str(tmp_path / "out"))
    last = got.groupBy("session_id").agg(F.max_by(F.struct("ts_ms", "dist"), "ts_ms").alias("r")).select("session_id", "r.*").collect()
    asked = tracking.latest_request(sessions.session_requests(_batch(spark, rows)))
    known = {r.request_id: r.dist for r in route(asked.where("end IS NOT NULL").select(F.col("session_id").alias("request_id"), "start", "end")).collect()}
    want = {(r.session_id, r.ts_ms, known.get(r.session_id)) for r in asked.collect()}
    assert {tuple(r) for r in last} == want and len(want) > 1
