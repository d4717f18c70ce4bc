"""Operators with state per session or channel. Every state is bounded: an open window, a start time, the
last messages, the voices of one channel. Time-outs follow the watermark of the input.

All but the voices keep several small states per key and change only what a batch touches, which needs the RocksDB store:
``spark.sql.streaming.stateStore.providerClass`` must name ``ROCKSDB``."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recapflow.functions.times import HOUR
from recapflow.operators.speakers import IDENTIFIED, Voices
from recapflow.params import DEFAULTS, Params

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_WINDOW = "session_id BIGINT, window_no BIGINT, t_start DOUBLE, t_end DOUBLE, n_words BIGINT, segment_ids ARRAY<BIGINT>"


def _rows(out: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])


class _Timed(StatefulProcessor):
    """One timer per key; a new one replaces the old one, which the key's state remembers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "ms BIGINT")

    def wake(self, ms: int | None) -> None:
        """Set the key's timer, or with None take it away."""
        old = self.due.get()[0] if self.due.exists() else None
        if old == ms:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if ms is None:
            self.due.clear()
        else:
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def close(self) -> None:
        pass


class _Windows(_Timed):
    """The open window of a session: its figures, and the ids of its utterances as a list that is only appended to."""

    def __init__(self, p: Params) -> None:
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "window_no BIGINT, t_start DOUBLE, t_end DOUBLE, n_words BIGINT, held BIGINT")
        self.ids = handle.getListState("ids", "id BIGINT")

    def _held(self) -> list[int]:
        held = [int(i) for (i,) in self.ids.get()] if self.ids.exists() else []
        self.ids.clear()
        return held

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        p, session, out = self.p, int(key[0]), []
        no, t0, t1, words, held = self.open.get() if self.open.exists() else (1, 0.0, 0.0, 0, 0)
        fresh: list[int] = []

        def close() -> None:
            nonlocal no, held, fresh
            out.append((session, no, t0, t1, words, self._held() + fresh))
            no, held, fresh = no + 1, 0, []

        arrived = pd.concat([b[["id", "t_start", "t_end", "n_words", "ts", "ended"]] for b in rows]).sort_values(["t_start", "id"])
        over = bool(arrived["ended"].any())
        said = arrived[arrived["id"].notna()]
        for uid, a, b, n in zip(said["id"].astype("int64").tolist(), said["t_start"].tolist(), said["t_end"].tolist(), said["n_words"].tolist()):
            pause = held and t1 - t0 >= p.window_min_seconds and a - t1 >= p.window_min_silence
            if pause or (held and (b - t0 > p.window_max_seconds or words + n > p.window_max_words)):
                close()
            t0, t1, words, held = (t0, b, words + n, held + 1) if held else (a, b, n, 1)
            fresh.append(uid)
            if held > 1 and (t1 - t0 >= p.window_max_seconds or words >= p.window_max_words):
                close()
        if held and over:
            close()
        if over:
            self.open.clear()
            self.wake(None)
        else:
            if fresh:
                self.ids.appendList([(i,) for i in fresh])
            self.open.update((no, t0, t1, words, held))
            last = int(arrived["ts"].max().timestamp() * 1000)
            self.wake(max(last, timerValues.getCurrentWatermarkInMs()) + p.offline_minutes * 60000)
        yield _rows(out, _WINDOW)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        no, t0, t1, words, held = self.open.get()
        out = [(int(key[0]), no, t0, t1, words, self._held())] if held else []
        self.open.update((no + len(out), t0, t1, words, 0))
        self.due.clear()
        yield _rows(out, _WINDOW)


def windows(stream: DataFrame, delay: str = "1 minute", p: Params = DEFAULTS) -> DataFrame:
    """Utterances (session_id, id, t_start, t_end, n_words, ts) to closed windows. A session's open window is flushed
    when nothing arrives for ``offline_minutes`` of event time; a session that resumes goes on counting. An optional
    boolean column ``ended`` marks a session's last row (which may have a NULL id): it flushes and drops the state."""
    rows = stream if "ended" in stream.columns else stream.withColumn("ended", F.lit(False))
    return rows.withWatermark("ts", delay).groupBy("session_id").transformWithStateInPandas(_Windows(p), _WINDOW, "Append", "EventTime")


def sessions(stream: DataFrame, delay: str = "1 minute", p: Params = DEFAULTS) -> DataFrame:
    """Audio activity (source, ts) to sessions that end after ``offline_minutes`` of silence."""
    gap = F.session_window("ts", f"{p.offline_minutes} minutes")
    return stream.withWatermark("ts", delay).groupBy("source", gap).agg(F.count(F.lit(1)).alias("pieces")).select(
        "source", F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("ended_at"), "pieces"
    )


_HOUR = "session_id BIGINT, hour BIGINT"


class _Hours(_Timed):
    """Start, next hour and last activity of a session."""

    def __init__(self, p: Params) -> None:
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.seen = handle.getValueState("seen", "started DOUBLE, next_hour BIGINT, last DOUBLE")

    def _close(self, session: int, start: float, nxt: int, last: float, now: float, end: float | None, watermark: int) -> pd.DataFrame:
        p = self.p
        until = int((end - start) // HOUR) + 1 if end is not None else max(nxt, int((now - p.close_grace_seconds - start) // HOUR))
        if end is not None or now - last > p.max_age_hours * HOUR:
            self.seen.clear()
            self.wake(None)
        else:
            self.seen.update((start, until, last))
            self.wake(max(int((start + (until + 1) * HOUR + p.close_grace_seconds) * 1000), watermark + 1))
        return _rows([(session, h) for h in range(nxt, until)], _HOUR).astype("int64")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, nxt, last = self.seen.get() if self.seen.exists() else (None, 0, 0.0)
        end, mark = None, timerValues.getCurrentWatermarkInMs()
        for b in rows:
            over = b["ended_at"].max()
            start = b["started_at"].min().timestamp() if start is None else start
            last = max(last, b["ts"].max().timestamp())
            end = over.timestamp() if pd.notna(over) else end
        yield self._close(int(key[0]), start, nxt, last, max(mark / 1000, last), end, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        mark = timerValues.getCurrentWatermarkInMs()
        yield self._close(int(key[0]), *self.seen.get(), mark / 1000, None, mark)


def hours(stream: DataFrame, delay: str = "0 seconds", p: Params = DEFAULTS) -> DataFrame:
    """Activity (session_id, started_at, ts, optional ended_at) to the closed hours of every session, each once. Hours
    are counted from the session's own start and close after the grace, by later activity or by the watermark. With the
    end all hours up to it close at once and the state goes; a session silent for ``max_age_hours`` is dropped, too."""
    rows = stream if "ended_at" in stream.columns else stream.withColumn("ended_at", F.lit(None).cast("timestamp"))
    return rows.withWatermark("ts", delay).groupBy("session_id").transformWithStateInPandas(_Hours(p), _HOUR, "Append", "EventTime")


_FEED = "session_id BIGINT, messages ARRAY<STRING>"


class _Feed(_Timed):
    """The latest messages of a session, one map entry each, so that a batch writes only what comes and goes."""

    def __init__(self, n: int, silent_ms: int | None) -> None:
        self.n, self.silent_ms = n, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = handle.getMapState("kept", "seq BIGINT, message STRING", "copies BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = {tuple(k): int(v[0]) for k, v in self.kept.iterator()} if self.kept.exists() else {}
        new, over, last = dict(old), False, timerValues.getCurrentWatermarkInMs() if self.silent_ms else 0
        for b in rows:
            over = over or bool(b["ended"].any())
            if self.silent_ms:
                last = max(last, int(b["ts"].max().timestamp() * 1000))
            for s, t, x in zip(b["seq"], b["type"], b["payload"]):
                k = (int(s), json.dumps([int(s), t, x]))
                new[k] = new.get(k, 0) + 1
            free = self.n
            for k in sorted(new, reverse=True):
                new[k] = min(new[k], free)
                free -= new[k]
            new = {k: c for k, c in new.items() if c}
        if over:
            self.kept.clear()
        else:
            for k in old.keys() - new.keys():
                self.kept.removeKey(k)
            for k, c in new.items():
                if old.get(k) != c:
                    self.kept.updateValue(k, (c,))
        if self.silent_ms:
            self.wake(None if over else last + self.silent_ms)
        yield pd.DataFrame({"session_id": [int(key[0])], "messages": [[m for k in sorted(new) for m in [k[1]] * new[k]]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        self.due.clear()
        yield _rows([], _FEED)


def feed(stream: DataFrame, n: int = 100, delay: str = "0 seconds", p: Params = DEFAULTS) -> DataFrame:
    """Messages (session_id, seq, type, payload) to the latest ``n`` per session, as changed rows
    (session_id, messages); older ones drop out. An optional boolean column ``ended`` marks a session's last message,
    after which its state goes. With an optional event time ``ts`` the state of a session silent for ``max_age_hours`` goes, too."""
    rows = stream if "ended" in stream.columns else stream.withColumn("ended", F.lit(False))
    timed = "ts" in stream.columns
    step = _Feed(n, int(p.max_age_hours * HOUR * 1000) if timed else None)
    rows = rows.withWatermark("ts", delay) if timed else rows
    return rows.groupBy("session_id").transformWithStateInPandas(step, _FEED, "Update", "EventTime" if timed else "None")


_ORPHAN = "session_id BIGINT, last_seen DOUBLE"


class _Heartbeats(_Timed):
    """The last heartbeat of a session."""

    def __init__(self, p: Params) -> None:
        self.p = p

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at DOUBLE")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = max(b["ts"].max().timestamp() for b in rows)
        last = max(last, self.last.get()[0]) if self.last.exists() else last
        self.last.update((last,))
        self.wake(max(int((last + self.p.lease_ttl_seconds) * 1000), timerValues.getCurrentWatermarkInMs() + 1))
        yield _rows([], _ORPHAN)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = [(int(key[0]), self.last.get()[0])]
        self.last.clear()
        self.due.clear()
        yield _rows(out, _ORPHAN)


def orphans(stream: DataFrame, delay: str = "0 seconds", p: Params = DEFAULTS) -> DataFrame:
    """Heartbeats (session_id, ts) to sessions whose worker stopped renewing for the lease time."""
    return stream.withWatermark("ts", delay).groupBy("session_id").transformWithStateInPandas(_Heartbeats(p), _ORPHAN, "Append", "EventTime")


_VOICES = (
    "made BIGINT, dim INT, ids ARRAY<BIGINT>, bank ARRAY<FLOAT>, numbers ARRAY<BIGINT>, counts ARRAY<BIGINT>, heard ARRAY<DOUBLE>, "
    "clusters ARRAY<DOUBLE>"
)


def voices(stream: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Live identification: rows (channel_id, is_voice, item_id, t_start, seconds, embedding), where enrolled
    voices and heard segments share one stream, to the columns of ``speakers.identify``."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bank = Voices.unpack(p, state.get) if state.exists else Voices(p)
        rows = pd.concat(list(batches)).sort_values(["is_voice", "t_start", "item_id"], ascending=[False, True, True])
        out = []
        for enrolled, item, seconds, v in zip(rows["is_voice"], rows["item_id"], rows["seconds"], rows["embedding"]):
            if enrolled:
                bank.enrol(int(item), v)
            else:
                out.append((int(key[0]), int(item), *bank.hear(v, float(seconds))))
        state.update(bank.pack())
        names = [x.split()[0] for x in IDENTIFIED.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"speaker_id": "Int64", "confidence": "float64", "voice_seconds": "float64"})

    return stream.groupBy("channel_id").applyInPandasWithState(step, IDENTIFIED, _VOICES, "append", GroupStateTimeout.NoTimeout)
