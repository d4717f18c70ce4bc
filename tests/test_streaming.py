import json
import tempfile

from pyspark.sql import functions as F

from recapflow.operators import infer, speakers, windows
from recapflow.params import Params
from recapflow.plans.bindings import Tables
from recapflow.streaming import batches, stateful

BASE = "2024-01-01 00:00:00"


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option(
        "checkpointLocation", tempfile.mkdtemp(prefix="recapflow-stream-")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def landed(spark, *frames):
    """A folder with one file per frame, read as a stream file by file in order of arrival."""
    root = tempfile.mkdtemp(prefix="recapflow-src-")
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(root)


def at(seconds):
    return F.timestamp_micros((F.unix_micros(F.lit(BASE).cast("timestamp")) + F.lit(seconds) * F.lit(1e6)).cast("bigint"))


def test_windows_match_batch(spark, sf):
    seg = Tables(spark, sf).segments.select("session_id", "id", "t_start", "t_end", "n_words", "turn")
    rows = seg.withColumn("ts", at(F.col("t_end"))).cache()
    late = rows.limit(1).withColumns({"session_id": F.lit(-1).cast("bigint"), "id": F.lit(-1).cast("bigint"), "ts": at(10**6)})
    later = late.withColumn("ts", at(2 * 10**6))
    stream = landed(spark, rows.where("turn < 2").drop("turn"), rows.where("turn >= 2").drop("turn"), late.drop("turn"), later.drop("turn"))
    drain(stateful.windows(stream), "win")
    got = {(r.session_id, r.window_no, tuple(r.segment_ids)) for r in spark.table("win").collect() if r.session_id >= 0}
    built = windows.build(windows.assign(rows))
    assert got == {(r.session_id, r.window_no, tuple(r.segment_ids)) for r in built.collect()}


def test_hours_close_once(spark):
    def act(rows):
        df = spark.createDataFrame(rows, "session_id long, s double, t double")
        return df.select("session_id", at(F.col("s")).alias("started_at"), at(F.col("t")).alias("ts"))

    stream = landed(spark, act([(1, 0.0, 10.0), (2, 1800.0, 1900.0)]), act([(1, 0.0, 3700.0)]), act([(1, 0.0, 3790.0)]), act([(1, 0.0, 11000.0)]), act([(1, 0.0, 11001.0)]))
    drain(stateful.hours(stream), "hrs")
    rows = [tuple(r) for r in spark.table("hrs").orderBy("session_id", "hour").collect()]
    assert rows == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)]


def test_windows_count_on_after_silence(spark):
    def say(rows):
        df = spark.createDataFrame(rows, "session_id long, id long, t double, ended boolean")
        return df.select("session_id", "id", F.col("t").alias("t_start"), (F.col("t") + 5).alias("t_end"), F.lit(3).cast("long").alias("n_words"), at(F.col("t")).alias("ts"), "ended")

    stream = landed(spark, say([(1, 1, 0.0, False)]), say([(2, 9, 5000.0, False)]), say([(2, 10, 5001.0, False)]), say([(1, 2, 5002.0, False)]),
                    say([(1, 3, 5010.0, True)]), say([(2, 11, 9000.0, False)]), say([(1, 4, 9001.0, False)]), say([(2, 12, 20000.0, False)]), say([(2, 13, 20001.0, False)]))
    drain(stateful.windows(stream), "resumed")
    got = sorted((r.window_no, tuple(r.segment_ids)) for r in spark.table("resumed").where("session_id = 1").collect())
    assert got == [(1, (1,)), (1, (4,)), (2, (2, 3))]  # after its end a session starts anew


def test_hours_of_an_ended_session(spark):
    def act(rows):
        df = spark.createDataFrame(rows, "session_id long, s double, t double, e double")
        return df.select("session_id", at(F.col("s")).alias("started_at"), at(F.col("t")).alias("ts"), F.when(F.col("e").isNotNull(), at(F.col("e"))).alias("ended_at"))

    stream = landed(spark, act([(1, 0.0, 10.0, None)]), act([(1, 0.0, 5000.0, 5000.0)]), act([(2, 0.0, 6000.0, None)]), act([(2, 0.0, 200000.0, None)]), act([(3, 0.0, 200001.0, None)]))
    drain(stateful.hours(stream), "ended")
    assert sorted(r.hour for r in spark.table("ended").where("session_id = 1").collect()) == [0, 1]


def test_sessions_end_after_silence(spark):
    def act(ts):
        return spark.createDataFrame([("a", float(t)) for t in ts], "source string, t double").select("source", at(F.col("t")).alias("ts"))

    stream = landed(spark, act([0, 100, 350]), act([900, 1000]), act([5000]), act([5001]))
    drain(stateful.sessions(stream), "ses")
    assert sorted(r.pieces for r in spark.table("ses").collect()) == [2, 3]


def test_feed_keeps_latest(spark):
    df = spark.createDataFrame([(1, i, "t", str(i)) for i in range(9)], "session_id long, seq long, type string, payload string")
    drain(stateful.feed(landed(spark, df.where("seq < 5"), df.where("seq >= 5")), 4), "feed", "update")
    assert max((list(r.messages) for r in spark.table("feed").collect()), key=lambda m: m[-1]) == [f'[{i}, "t", "{i}"]' for i in (5, 6, 7, 8)]


def feed_of(spark, root, checkpoint, table, n=4):
    """Starts, drains and stops the feed over what lies in ``root``; rows of all starts so far."""
    messages = spark.readStream.schema("session_id long, seq long, type string, payload string").option("maxFilesPerTrigger", 1).parquet(root)
    write = stateful.feed(messages, n).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    q = write.foreachBatch(lambda df, _: df.write.mode("append").parquet(table)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return [(r.session_id, list(r.messages)) for r in spark.read.parquet(table).collect()]


def said(spark, root, *rows):
    spark.createDataFrame([(s, i, "t", str(i)) for s, i in rows], "session_id long, seq long, type string, payload string").coalesce(1).write.mode("append").parquet(root)


def test_feed_goes_on_after_restart(spark):
    root, checkpoint, table = (tempfile.mkdtemp(prefix="recapflow-feed-") for _ in range(3))
    said(spark, root, *[(1, i) for i in (0, 1, 2, 2, 3)], (2, 7))
    feed_of(spark, root, checkpoint, table)
    said(spark, root, (1, 4), (1, 1))
    rows = feed_of(spark, root, checkpoint, table)
    assert len(rows) == 3  # the second start sends only what changed
    assert (1, [f'[{i}, "t", "{i}"]' for i in (2, 2, 3, 4)]) in rows  # a message that came twice counts twice


def test_feed_forgets_silent_sessions(spark):
    def say(*rows):
        df = spark.createDataFrame([(s, i, "t", str(i), float(t)) for s, i, t in rows], "session_id long, seq long, type string, payload string, t double")
        return df.withColumn("ts", at(F.col("t"))).drop("t")

    stream = landed(spark, say((1, 0, 0), (3, 0, 0)), say((2, 0, 4000), (3, 1, 3000)), say((2, 1, 4001)), say((1, 1, 4002), (3, 2, 4003)))
    drain(stateful.feed(stream, 4, p=Params(max_age_hours=1.0)), "silent", "update")
    rows = [(r.session_id, [json.loads(m)[0] for m in r.messages]) for r in spark.table("silent").collect()]
    assert (1, [1]) in rows and (1, [0, 1]) not in rows and (3, [0, 1, 2]) in rows


def test_missing_heartbeat(spark):
    def beat(rows):
        return spark.createDataFrame(rows, "session_id long, t double").select("session_id", at(F.col("t")).alias("ts"))

    stream = landed(spark, beat([(1, 0.0), (2, 0.0)]), beat([(2, 25.0)]), beat([(2, 50.0)]), beat([(2, 51.0)]))
    drain(stateful.orphans(stream), "orp")
    assert [r.session_id for r in spark.table("orp").collect()] == [1]


def test_voices_match_batch(spark, sf):
    e = Tables(spark, sf).read("embeddings")
    heard = e.select((F.col("vec_id") % 3).alias("channel_id"), F.col("vec_id").alias("segment_id"), F.col("vec_id").cast("double").alias("t_start"), F.lit(2.0).alias("seconds"), "embedding")
    known = e.where("vec_id < 6").select((F.col("vec_id") % 3).alias("channel_id"), F.col("vec_id").alias("speaker_id"), "embedding")
    batch = {(r.segment_id, r.speaker_id, r.flag) for r in speakers.identify(heard, known).collect()}
    enrolled = known.select("channel_id", F.lit(True).alias("is_voice"), F.col("speaker_id").alias("item_id"), F.lit(-1.0).alias("t_start"), F.lit(0.0).alias("seconds"), "embedding")
    rows = heard.select("channel_id", F.lit(False).alias("is_voice"), F.col("segment_id").alias("item_id"), "t_start", "seconds", "embedding")
    drain(stateful.voices(landed(spark, enrolled, rows.where("item_id < 200"), rows.where("item_id >= 200"))), "voi")
    assert {(r.segment_id, r.speaker_id, r.flag) for r in spark.table("voi").collect()} == batch


def test_beats_once_per_hour(spark, sf):
    class BeatModel(infer.StubModel):
        def generate_json(self, prompt, system=""):
            import json
            import re

            ids = [int(x) for x in re.findall(r"^- id (\d+)", prompt, re.M)]
            return "```json\n" + json.dumps({"beats": [{"headline": "all", "significance": 3, "event_ids": ids}]}) + "\n```"

    t = Tables(spark, sf)
    empty = spark.createDataFrame([], "session_id long, created_at timestamp, cost_usd double")
    state = {"sessions": t.ev_sessions.where("id < 4"), "windows": t.ev_windows.withColumn("cost_usd", F.lit(0.0)), "events": t.ev_events, "summaries": empty}
    root = tempfile.mkdtemp(prefix="recapflow-beats-")
    handle = batches.beats(root, state.__getitem__, lambda b: F.lit("2024-01-31 00:00:00").cast("timestamp"), BeatModel)
    batch = state["sessions"].select(F.col("id").alias("session_id"), F.lit(0).alias("hour"))
    for epoch in (0, 0, 1):  # batch 0 is run twice
        handle(batch, epoch)
    runs = spark.read.parquet(f"{root}/beat_runs")
    assert runs.count() == runs.select("session_id", "hour_index").distinct().count() > 0
    made = spark.read.parquet(f"{root}/plot_beats")
    assert made.count() == runs.where("status = 'done'").count() > 0


def test_rolling_builds_on_previous(spark):
    class Echo(infer.StubModel):
        def generate_text(self, prompt, system="", max_tokens=500):
            return prompt.split("Previous summary:\n")[1].split("\n")[0] + "+" + prompt.split("New window:\n")[1].split("\n")[0]

    w = spark.createDataFrame([(1, 7, 0.0, 60.0, "a"), (2, 7, 60.0, 120.0, "b"), (3, 8, 0.0, 60.0, "c")], "id long, session_id long, t_start double, t_end double, window_summary string")
    events = spark.createDataFrame([], "id long, window_id long, description string")
    root = tempfile.mkdtemp(prefix="recapflow-roll-")
    handle = batches.rolling(root, {"events": events}.__getitem__, lambda b: F.lit("2024-01-01 00:00:00").cast("timestamp"), Echo)
    handle(w.where("id <> 2"), 0)
    handle(w.where("id = 2"), 1)
    assert {r.text for r in spark.read.parquet(f"{root}/summaries").collect()} == {"+a", "+c", "+a+b"}
