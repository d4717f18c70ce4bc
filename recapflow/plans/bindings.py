"""Adapters that give the driver tables the roles of the state tables, in Spark and in SQL.

Every adapter covers its whole source table; attributes the tables lack (status, channel, kind) are derived
from columns by fixed rules stated once per language."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recapflow.functions import times as TM
from recapflow.functions.ordered import running_sum
from recapflow.operators import budget, windows as W

NOW = "2001-07-01 12:00:00"
EV_NOW = "2024-01-31 00:00:00"


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def _case(c: Column, values: dict, other: str) -> Column:
    out = None
    for k, v in values.items():
        out = (F if out is None else out).when(c == k, v)
    return out.otherwise(other)


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # events -> sessions of users, their windows, events, votes, beats

    @cached_property
    def ev_sessions(self) -> DataFrame:
        u = F.col("user_id")
        return self.read("events").groupBy("user_id").agg(
            F.min("ts").cast("timestamp").alias("started_at"), F.max("ts").cast("timestamp").alias("ended_at")
        ).select(
            u.alias("id"), (u % 10).alias("channel_id"), "started_at", "ended_at",
            _case(u % 4, {0: "live", 1: "ended", 2: "interrupted"}, "degraded").alias("status"),
        )

    @cached_property
    def _ev(self) -> DataFrame:
        started = self.ev_sessions.select(F.col("id").alias("user_id"), "started_at")
        el = TM.seconds_between(F.col("ts"), F.col("started_at"))
        return self.read("events").drop("props").join(started, "user_id").withColumn("el", el).withColumn(
            "block", F.floor(el / 7200)
        )

    @cached_property
    def ev_windows(self) -> DataFrame:
        end = F.col("t_start") + 7200.0
        return self._ev.groupBy("user_id", "block", "started_at").agg(F.count(F.lit(1)).alias("n")).select(
            (F.col("user_id") * 1000 + F.col("block")).alias("id"), F.col("user_id").alias("session_id"),
            (F.col("block") * 7200.0).alias("t_start"), "started_at", "n",
        ).withColumn("t_end", end).select(
            "id", "session_id", "t_start", "t_end", "n",
            F.timestamp_micros(F.unix_micros("started_at") + (F.col("t_end") * 1000000).cast("bigint")).alias("created_at"),
        )

    @cached_property
    def ev_events(self) -> DataFrame:
        return self._ev.select(
            F.col("event_id").alias("id"), F.col("user_id").alias("session_id"), (F.col("user_id") * 1000 + F.col("block")).alias("window_id"),
            F.col("el").alias("t_start"), (F.col("el") + 30.0).alias("t_end"), F.col("event_type").alias("type"),
            F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("description"),
            (F.least(F.lit(4), F.floor(F.col("value") / 50)) + 1).cast("int").alias("importance"), "ts",
        )

    @cached_property
    def ev_hours(self) -> DataFrame:
        return self._ev.select(F.col("user_id").alias("session_id"), TM.hour_index(F.col("el")).alias("hour")).distinct()

    @cached_property
    def ev_runs(self) -> DataFrame:
        k = F.col("session_id") + F.col("hour")
        return self.ev_hours.where((k % 5 == 0) | (k % 7 == 0)).select(
            "session_id", F.col("hour").alias("hour_index"), F.lit("live").alias("run_label"),
            F.when(k % 5 == 0, "done").otherwise("skipped").alias("status"),
        )

    @cached_property
    def ev_beats(self) -> DataFrame:
        return self.ev_runs.where("status = 'done'").select(
            (F.col("session_id") * 1000 + F.col("hour_index")).alias("id"), "session_id", "hour_index", "run_label",
            (F.col("hour_index") * 3600 + 5.0).alias("t_start"),
            F.concat_ws(" ", F.lit("beat"), F.col("session_id").cast("string"), F.col("hour_index").cast("string")).alias("headline"),
            F.lit(3).alias("significance"),
        )

    @cached_property
    def ev_votes(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("session_id"),
            F.when(F.col("event_id") % 2 == 0, "recap").otherwise("rolling").alias("kind"),
            _case(F.col("event_type"), {"view": "yes", "click": "no", "signup": "not_sure"}, "maybe").alias("vote"),
        )

    @cached_property
    def ev_recaps(self) -> DataFrame:
        """A stored recap per session, keyed by an earlier event."""
        e = self.read("events").groupBy("user_id").agg(F.max("event_id").alias("m"))
        return e.select(
            (F.col("user_id") + 1).alias("id"), F.col("user_id").alias("session_id"), F.lit("recap").alias("kind"),
            F.lit("old recap").alias("text"),
            F.when(F.col("user_id") % 3 == 0, F.concat((F.col("m") - 2000).cast("string"), F.lit(":stamp")))
            .when(F.col("user_id") % 3 == 1, "stale-feedback").otherwise(F.concat(F.col("m").cast("string"), F.lit(":"))).alias("cache_key"),
        )

    # conversations -> segments

    @cached_property
    def segments(self) -> DataFrame:
        n = W.word_count(F.col("text"))
        gap = F.when(F.col("turn") % 3 == 2, 20).otherwise(0)
        base = self.read("conversations").withColumn("n_words", n).withColumn("ds", F.col("n_words") * 4)
        timed = running_sum(base, ["conv_id"], ["turn"], F.col("ds") + gap, "upto", F.floor(F.col("turn") / 1000))
        start = (F.col("upto") - gap - F.col("ds")) / F.lit(10.0)
        return timed.select(
            F.col("conv_id").alias("session_id"), (F.col("conv_id") % 5).alias("channel_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
            start.alias("t_start"), ((F.col("upto") - gap) / F.lit(10.0)).alias("t_end"), "n_words", "text", "turn", "role",
            _case(F.col("role"), {"user": "1", "assistant": "2"}, "").alias("speaker"),
            F.when(F.col("role") == "user", F.col("conv_id") % 7 + 1).when(F.col("role") == "assistant", F.col("conv_id") % 3 + 11).alias("speaker_id"),
            F.when(F.col("turn") % 4 != 3, F.round(F.lit(1.0) / (F.col("turn") + 1), 4)).alias("speaker_conf"),
        )

    # part -> entities and aliases

    @cached_property
    def entities(self) -> DataFrame:
        size = F.col("p_size")
        return self.read("part").select(
            F.col("p_partkey").alias("id"), F.substring_index("p_brand", "#", -1).cast("bigint").alias("channel_id"),
            F.lower("p_type").alias("type"), F.col("p_name").alias("canonical_name"), F.col("p_type").alias("description"),
            F.when(size % 10 == 0, "merged").when(size > 25, "confirmed").otherwise("provisional").alias("status"),
            F.lit(None).cast("bigint").alias("merged_into"), size.cast("bigint").alias("mention_count"),
            F.timestamp_seconds(F.lit(1700000000) + (F.col("p_partkey") * 37 % 1000) * 3600).alias("last_seen_at"),
        )

    @cached_property
    def aliases(self) -> DataFrame:
        p = self.read("part").where("p_size % 3 = 0")
        return p.select(F.col("p_partkey").alias("entity_id"), F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("alias"))

    # orders and lineitem -> sessions, storylines, priced calls

    @cached_property
    def sessions(self) -> DataFrame:
        started = F.col("o_orderdate").cast("timestamp")
        status = _case(F.col("o_orderstatus"), {"O": "live", "F": "ended"}, "interrupted")
        ended = F.timestamp_micros(F.unix_micros(started) + (F.floor(F.col("o_totalprice") / 10000) * 3600000000).cast("bigint"))
        return self.read("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("channel_id"), started.alias("started_at"),
            F.when(F.col("o_orderstatus") != "O", ended).alias("ended_at"), status.alias("status"),
            F.when(F.col("o_orderpriority") == "5-LOW", "replay").otherwise("live").alias("source"),
            F.col("o_orderpriority").alias("title"),
            F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 != 0), F.concat(F.lit("wrap-up "), F.col("o_orderkey"))).alias("final_summary"),
        )

    @cached_property
    def threads(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("channel_id"),
            F.concat(F.lit("story "), F.col("o_orderkey")).alias("title"), F.col("o_orderpriority").alias("summary"),
            _case(F.col("o_orderstatus"), {"O": "open", "F": "resolved"}, "dormant").alias("status"),
            F.left("o_orderpriority", F.lit(1)).cast("int").alias("importance"), F.col("o_orderdate").cast("timestamp").alias("last_updated_at"),
        )

    @cached_property
    def cost_windows(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("session_id"), F.col("l_shipdate").cast("timestamp").alias("created_at"),
            budget.cost(F.col("l_quantity") * 100, F.col("l_extendedprice") / 10).alias("cost_usd"),
        )

    @cached_property
    def cost_summaries(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
            (F.col("o_totalprice") / 1000000).alias("cost_usd"),
        )

    @cached_property
    def told(self) -> DataFrame:
        """Summaries of order sessions, one per line."""
        kind = _case(F.col("l_returnflag"), {"A": "rolling", "R": "full"}, "recap")
        return self.read("lineitem").select(
            (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("id"), F.col("l_orderkey").alias("session_id"), kind.alias("kind")
        )

    # customer -> channels with configuration

    @cached_property
    def channels(self) -> DataFrame:
        k = F.col("c_custkey")
        profile = _case(F.col("c_mktsegment"), {"HOUSEHOLD": "gaming", "MACHINERY": "just_chatting", "BUILDING": "mystery"}, "roleplay")
        mode = F.when(k % 2 == 0, "observer").otherwise("other")
        host = F.struct(F.col("c_name").alias("name"), (k * 3).alias("entity_id"), mode.alias("pov_mode"))
        config = F.when(k % 5 == 0, F.to_json(F.struct(profile.alias("content_profile"), (k % 2 == 0).alias("auto_monitor"), host.alias("streamer"))))
        config = config.when(k % 5 == 1, "{broken").when(k % 5 == 2, F.to_json(F.struct(profile.alias("content_profile"), (k % 4 == 0).alias("auto_monitor"))))
        return self.read("customer").select(
            k.alias("id"), F.lower(F.replace("c_name", F.lit("#"), F.lit("_"))).alias("login"), config.alias("config_json"),
        )


# The same bindings for the SQL side. Order matters: later ones may use earlier ones.
SQL: dict[str, str] = {
    "ev_sessions": """SELECT user_id AS id, user_id % 10 AS channel_id, min(ts) AS started_at, max(ts) AS ended_at,
        CASE user_id % 4 WHEN 0 THEN 'live' WHEN 1 THEN 'ended' WHEN 2 THEN 'interrupted' ELSE 'degraded' END AS status
        FROM events GROUP BY user_id""",
    "ev": """SELECT e.event_id, e.user_id, e.ts, e.event_type, e.value, s.started_at,
        (epoch_us(e.ts) - epoch_us(s.started_at)) / 1e6 AS el,
        CAST(floor(((epoch_us(e.ts) - epoch_us(s.started_at)) / 1e6) / 7200) AS BIGINT) AS block
        FROM events e JOIN ev_sessions s ON s.id = e.user_id""",
    "ev_windows": """SELECT user_id * 1000 + block AS id, user_id AS session_id, block * 7200.0::DOUBLE AS t_start,
        block * 7200.0::DOUBLE + 7200.0 AS t_end, count(*) AS n,
        make_timestamp(epoch_us(started_at) + (block + 1) * 7200000000) AS created_at
        FROM ev GROUP BY user_id, block, started_at""",
    "ev_events": """SELECT event_id AS id, user_id AS session_id, user_id * 1000 + block AS window_id, el AS t_start, el + 30.0 AS t_end,
        event_type AS type, event_type || ' ' || event_id AS description,
        CAST(1 + least(4, floor(value / 50)) AS INTEGER) AS importance, ts FROM ev""",
    "ev_timed": """SELECT session_id, id, importance, description, el AS "at", CAST(floor(el / 3600) AS BIGINT) AS hour FROM (
        SELECT e.session_id, e.id, e.importance, e.description,
        greatest((epoch_us(w.created_at) - epoch_us(s.started_at)) / 1e6
            - least(greatest(w.t_end - e.t_start, 0), greatest(w.t_end - w.t_start, 0)), 0) AS el
        FROM ev_events e JOIN ev_windows w ON w.id = e.window_id JOIN ev_sessions s ON s.id = e.session_id)""",
    "ev_hours": "SELECT DISTINCT user_id AS session_id, CAST(floor(el / 3600) AS BIGINT) AS hour FROM ev",
    "ev_runs": """SELECT session_id, hour AS hour_index, CASE WHEN (session_id + hour) % 5 = 0 THEN 'done' ELSE 'skipped' END AS status
        FROM ev_hours WHERE (session_id + hour) % 5 = 0 OR (session_id + hour) % 7 = 0""",
    "ev_beats": """SELECT session_id * 1000 + hour_index AS id, session_id, hour_index, hour_index * 3600 + 5.0::DOUBLE AS t_start,
        'beat ' || session_id || ' ' || hour_index AS headline, 3 AS significance FROM ev_runs WHERE status = 'done'""",
    "ev_votes": """SELECT event_id AS id, user_id AS session_id, CASE WHEN event_id % 2 = 0 THEN 'recap' ELSE 'rolling' END AS kind,
        CASE event_type WHEN 'view' THEN 'yes' WHEN 'click' THEN 'no' WHEN 'signup' THEN 'not_sure' ELSE 'maybe' END AS vote FROM events""",
    "ev_recaps": """SELECT user_id + 1 AS id, user_id AS session_id, CASE user_id % 3 WHEN 0 THEN (max(event_id) - 2000) || ':stamp'
        WHEN 1 THEN 'stale-feedback' ELSE max(event_id) || ':' END AS cache_key FROM events GROUP BY user_id""",
    "seg0": r"""SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_words FROM conversations""",
    "segments": """SELECT conv_id AS session_id, conv_id % 5 AS channel_id, conv_id * 1000 + turn AS id,
        CAST(upto - gap - 4 * n_words AS BIGINT) / 10.0::DOUBLE AS t_start, CAST(upto - gap AS BIGINT) / 10.0::DOUBLE AS t_end,
        CAST(n_words AS BIGINT) AS n_words, text, turn, role, pos,
        CASE role WHEN 'user' THEN '1' WHEN 'assistant' THEN '2' ELSE '' END AS speaker,
        CASE role WHEN 'user' THEN conv_id % 7 + 1 WHEN 'assistant' THEN conv_id % 3 + 11 END AS speaker_id,
        CASE WHEN turn % 4 <> 3 THEN round(1.0::DOUBLE / (turn + 1), 4) END AS speaker_conf
        FROM (SELECT *, sum(4 * n_words + gap) OVER (PARTITION BY conv_id ORDER BY turn) AS upto,
              row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos
              FROM (SELECT *, CASE WHEN turn % 3 = 2 THEN 20 ELSE 0 END AS gap FROM seg0))""",
    "entities": """SELECT p_partkey AS id, CAST(split_part(p_brand, '#', 2) AS BIGINT) AS channel_id, lower(p_type) AS type,
        p_name AS canonical_name, p_type AS description,
        CASE WHEN p_size % 10 = 0 THEN 'merged' WHEN p_size > 25 THEN 'confirmed' ELSE 'provisional' END AS status,
        CAST(p_size AS BIGINT) AS mention_count, 1700000000 + (p_partkey * 37 % 1000) * 3600 AS seen FROM part""",
    "aliases": "SELECT p_partkey AS entity_id, p_type || ' ' || p_size AS alias FROM part WHERE p_size % 3 = 0",
    "sessions": """SELECT o_orderkey AS id, o_custkey AS channel_id, CAST(o_orderdate AS TIMESTAMP) AS started_at,
        CASE WHEN o_orderstatus <> 'O' THEN make_timestamp(epoch_us(CAST(o_orderdate AS TIMESTAMP)) + CAST(floor(o_totalprice / 10000) AS BIGINT) * 3600000000) END AS ended_at,
        CASE o_orderstatus WHEN 'O' THEN 'live' WHEN 'F' THEN 'ended' ELSE 'interrupted' END AS status,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'replay' ELSE 'live' END AS source, o_orderpriority AS title,
        CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 <> 0 THEN 'wrap-up ' || o_orderkey END AS final_summary FROM orders""",
    "threads": """SELECT o_orderkey AS id, o_custkey % 100 AS channel_id, 'story ' || o_orderkey AS title, o_orderpriority AS summary,
        CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'dormant' END AS status,
        CAST(left(o_orderpriority, 1) AS INTEGER) AS importance, CAST(o_orderdate AS TIMESTAMP) AS last_updated_at FROM orders""",
    "costs": """SELECT l_orderkey AS session_id, CAST(l_shipdate AS TIMESTAMP) AS created_at,
        l_quantity * 100 / 1000 * 0.0005::DOUBLE + l_extendedprice / 10 / 1000 * 0.0015::DOUBLE AS cost_usd FROM lineitem
        UNION ALL SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP), o_totalprice / 1000000 FROM orders""",
    "told": """SELECT l_orderkey * 100000 + l_partkey AS id, l_orderkey AS session_id,
        CASE l_returnflag WHEN 'A' THEN 'rolling' WHEN 'R' THEN 'full' ELSE 'recap' END AS kind FROM lineitem""",
    "channels": """SELECT c_custkey AS id, lower(replace(c_name, '#', '_')) AS login, c_name, c_custkey % 5 AS k,
        CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'gaming' WHEN 'MACHINERY' THEN 'just_chatting' WHEN 'BUILDING' THEN 'mystery' ELSE 'roleplay' END AS given
        FROM customer""",
}

_NEEDS = {
    "ev": ("ev_sessions",), "ev_windows": ("ev",), "ev_events": ("ev",), "ev_timed": ("ev_events", "ev_windows", "ev_sessions"),
    "ev_hours": ("ev",), "ev_runs": ("ev_hours",), "ev_beats": ("ev_runs",), "segments": ("seg0",),
}


def with_(names: tuple[str, ...], body: str, recursive: str = "") -> str:
    """SQL text: the named bindings and what they need as CTEs, then own CTEs, then the body."""
    wanted: set[str] = set()

    def need(n: str) -> None:
        for m in _NEEDS.get(n, ()):
            need(m)
        wanted.add(n)

    for n in names:
        need(n)
    ctes = [f"{n} AS ({SQL[n]})" for n in SQL if n in wanted]
    if recursive:
        ctes.append(recursive)
    if not ctes:
        return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + body
