import datetime as dt

from seamline import schema as S
from seamline.operators.detections import verdict_from_boxes
from seamline.sources.tables import frame_stream, read_inspections
from seamline.streaming import kpis
from seamline.streaming.registration import registration_writer

START = dt.datetime(2024, 1, 1)


def drain(stream, name, mode, folder):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode)
    query = query.option("checkpointLocation", str(folder)).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_live_kpis(spark, tmp_path):
    rows = [(START + dt.timedelta(minutes=7 * i), ["Defecto", "Aprobado", "Revisar"][i % 3]) for i in range(40)]
    table = spark.createDataFrame(rows, "created_at timestamp, status string")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(kpis.live_kpis(stream, width="1 hour", lateness="2 days"), "live", "complete", tmp_path / "a")
    key = lambda r: r.window_start
    expected = sorted(kpis.live_kpis(table, width="1 hour").collect(), key=key)
    assert sorted(spark.table("live").collect(), key=key) == expected
    assert sum(r.total for r in expected) == 40


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "created_at timestamp, status string"
    folder = str(tmp_path / "in")
    for minute in (0, 200, 1, 400):  # the third comes long after its time
        part = spark.createDataFrame([(START + dt.timedelta(minutes=minute), "Defecto")], schema)
        part.coalesce(1).write.mode("append").parquet(folder + f"/n={minute}")
        stream = spark.readStream.schema(schema).parquet(folder + "/n=*")
        query = (
            kpis.live_kpis(stream, width="1 hour", lateness="10 minutes")
            .writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    found = {r.window_start.hour: r.total for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found[0] == 1 and found[3] == 1


def test_sessions_and_repeats(spark, tmp_path):
    minutes = [0, 1, 2, 30, 31, 31]
    rows = [(7, i if i < 5 else 4, START + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)]
    table = spark.createDataFrame(rows, "station_id long, frame_seq long, ts timestamp")
    once = kpis.without_repeats(table, ["station_id", "frame_seq"])
    assert once.count() == 5
    found = sorted(r.captures for r in kpis.station_sessions(once, "10 minutes").collect())
    assert found == [2, 3]
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    drain(kpis.without_repeats(stream, ["station_id", "frame_seq"]), "once", "append", tmp_path / "b")
    assert spark.table("once").count() == 5


def test_registration_is_repeatable(spark, tmp_path):
    schema = "image_id long, captured_at timestamp"
    rows = spark.createDataFrame([(i, START + dt.timedelta(seconds=i)) for i in range(20)], schema)
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    boxes = spark.createDataFrame([(3, 0, 0, 0.8, 0.0, 0.0, 1.0, 1.0, 100, 100)], S.BOXES)

    def run(state):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        writer = registration_writer(
            stream, lambda batch: verdict_from_boxes(batch, boxes), str(tmp_path / "out"), str(tmp_path / state)
        )
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()

    run("state")
    first = sorted(read_inspections(spark, str(tmp_path / "out")).select("id", "code", "status").collect())
    run("state")  # nothing new
    run("other")  # every batch again
    again = sorted(read_inspections(spark, str(tmp_path / "out")).select("id", "code", "status").collect())
    assert first == again and len(first) == 20
    assert [r.status for r in first if r.id == 4] == ["Defecto"]


def test_frame_stream_signals(spark, tmp_path):
    from seamline.operators.images import frame_signals

    pixels = bytes(10 * 10 * 3)
    rows = [(1, i, START + dt.timedelta(seconds=i), i != 1, *((10, 10, 3, pixels) if i != 1 else (None,) * 4)) for i in range(3)]
    spark.createDataFrame(rows, S.FRAMES).write.parquet(str(tmp_path / "in"))
    stream = frame_stream(spark, str(tmp_path / "in"), 1)
    drain(frame_signals(stream, ["station_id", "frame_seq", "ts", "readable"]), "signals", "append", tmp_path / "c")
    found = {r.frame_seq: r for r in spark.table("signals").collect()}
    assert len(found) == 3 and len(found[0].signal) == 64
    assert found[1].signal is None and found[1].error
