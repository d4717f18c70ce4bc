"""Steps for ``foreachBatch``. Every batch writes its rows under its own number, so a batch that is run again
after a failure replaces what it wrote before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recapflow.functions.stages import settled
from recapflow.operators import infer, sessions, summaries, timeline
from recapflow.params import DEFAULTS, Params
from recapflow.schemas import TABLES
from recapflow.sources.tables import conform, insert_new


def write_batch(rows: DataFrame, root: str, name: str, epoch: int) -> None:
    rows.write.mode("overwrite").parquet(f"{root}/{name}/epoch={epoch}")


def read_before(spark: SparkSession, root: str, name: str, epoch: int, schema: str) -> DataFrame:
    """Rows written by earlier batches."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(f"{schema}, epoch BIGINT").parquet(f"{root}/{name}")
    return stored.where(F.col("epoch") < epoch).drop("epoch")


_BEATS = TABLES["plot_beats"] + ", beat_no INT, event_ids ARRAY<BIGINT>"


def beats(root: str, read: Callable[[str], DataFrame], now: Callable[[DataFrame], Column],
          model: Callable[[], infer.Model] = infer.StubModel, p: Params = DEFAULTS) -> Callable[[DataFrame, int], None]:
    """Handler for closed hours (session_id, hour): each (session, hour) gets its beats and its run mark once.
    ``read`` gives the current state tables by name, ``now`` the time of a batch."""
    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old_beats, old_runs = (read_before(spark, root, n, epoch, s) for n, s in (("plot_beats", _BEATS), ("beat_runs", TABLES["beat_runs"])))
        touched = settled(batch.select("session_id").distinct())
        mine = read("sessions").join(touched.withColumnRenamed("session_id", "id"), "id", "left_semi")
        made, marks = timeline.generate(
            mine, read("windows"), read("events"), read("summaries"), old_beats, old_runs, now(batch), model, limit=None, p=p
        )
        fresh = settled(insert_new(old_runs, conform(marks, TABLES["beat_runs"]), ["session_id", "hour_index", "run_label"]))
        kept = made.join(fresh, ["session_id", "hour_index", "run_label"], "left_semi")
        write_batch(conform(kept, _BEATS), root, "plot_beats", epoch)
        write_batch(fresh, root, "beat_runs", epoch)

    return handle


def rolling(root: str, read: Callable[[str], DataFrame], now: Callable[[DataFrame], Column],
            model: Callable[[], infer.Model] = infer.StubModel, p: Params = DEFAULTS) -> Callable[[DataFrame, int], None]:
    """Handler for finished windows (the windows table's columns): a new rolling summary per window, each on top
    of the one before. Windows of one session in the same batch are taken in turn; mostly there is one."""
    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        order = F.row_number().over(Window.partitionBy("session_id").orderBy("id"))
        todo = settled(batch.withColumn("turn", order))
        told = read_before(spark, root, "summaries", epoch, TABLES["summaries"])
        mine = told.join(todo.select("session_id"), "session_id", "left_semi")
        written = None
        turns = todo.agg(F.max("turn").alias("n")).first()["n"] or 0
        for turn in range(1, turns + 1):
            asked = infer.run(summaries.rolling_prompts(todo.where(F.col("turn") == turn), mine, read("events")), model, p=p)
            short = settled(asked.withColumn("raw", summaries.rolling_text(F.col("raw"))))
            # A window has at most one rolling summary, so its id serves as the summary's id.
            rows = summaries.save(short, "rolling", now(batch), p=p).join(short.select("session_id", F.col("window_id").alias("id")), "session_id")
            rows = conform(rows, TABLES["summaries"])
            mine = mine.unionByName(rows)
            written = rows if written is None else written.unionByName(rows)
        if written is not None:
            write_batch(written, root, "summaries", epoch)

    return handle


def actions(root: str, read: Callable[[str], DataFrame], now: Callable[[DataFrame], Column], p: Params = DEFAULTS) -> Callable[[DataFrame, int], None]:
    """Handler for landed live status (login, stream_id, title, category): one action per live channel. A check
    that failed lands no rows and so causes no action."""
    def handle(batch: DataFrame, epoch: int) -> None:
        names = ("channels", "sessions", "segments", "monitor_leases")
        c, s, g, m = (read(n) for n in names)
        write_batch(sessions.tick(c, batch, s, g, m, now(batch), p), root, "actions", epoch)

    return handle
