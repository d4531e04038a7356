from lodemap.streaming import events


def test_sessions_close_after_the_watermark(spark, data, tmp_path):
    source = spark.read.parquet(f"{data}/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = events.sessions(events.event_stream(spark, str(tmp_path / "in")), gap="2 hours", late="0 seconds")
    run = stream.writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    got = {(r.session_id, r.start, r.events) for r in spark.table("closed").collect()}
    whole = {(r.session_id, r.start, r.events) for r in events.sessions(source, gap="2 hours").collect()}
    assert got and got <= whole


def test_log_takes_each_event_once(spark, data, tmp_path):
    import shutil

    from lodemap.streaming import events

    (tmp_path / "in").mkdir()
    shutil.copy(f"{data}/events.parquet", tmp_path / "in" / "one.parquet")
    want = spark.read.parquet(f"{data}/events.parquet").count()
    run = lambda checkpoint: events.log(events.event_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "log"), str(tmp_path / checkpoint), late="1000 days").awaitTermination()
    run("state")
    assert events.read_log(spark, str(tmp_path / "log")).count() == want
    shutil.copy(f"{data}/events.parquet", tmp_path / "in" / "two.parquet")
    run("state")  # the same events in another file
    assert events.read_log(spark, str(tmp_path / "log")).select("event_id").distinct().count() == events.read_log(spark, str(tmp_path / "log")).count() == want
    shutil.rmtree(tmp_path / "in")
    (tmp_path / "in").mkdir()
    shutil.copy(f"{data}/events.parquet", tmp_path / "in" / "one.parquet")
    run("lost")  # the first batch once more, after its state was lost
    assert events.read_log(spark, str(tmp_path / "log")).count() == want
