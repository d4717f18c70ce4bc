"""Cutting audio into utterances from the loudness of its 32 ms frames.

``frames``: file_id, frame_no, n_samples (at most FRAME_SAMPLES), rms. Where a piece ends depends on where it began, yet a
long file is cut in parallel. A piece is in one of two states: it is fresh, or it holds the rest behind a cut at the cap.
A file is split into chunks of audio; each works out, for every state that could begin its first piece, which state begins the first piece of
the next chunk. These few steps are chained per file, and every chunk then cuts its own pieces from its now known first state. No piece
reaches further than the cap, so a chunk looks that far into the next one, and as far back as the cap looks for a quiet frame."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recapflow.functions.folds import fold_sorted
from recapflow.functions.ordered import running_sum

# Fixed values.
SAMPLE_RATE = 16000
FRAME_SAMPLES = 512
SPEECH_RMS = 0.02
SILENT_FRAMES = 15
SILENCE_SAMPLES = 8000
MIN_SECONDS = 0.3
MAX_SECONDS = 30.0
SEARCH_FRAMES = 156

#: Seconds of audio that one task looks at, besides what it sees of its neighbours.
CHUNK_SECONDS = 600.0
_MIN, _MAX = int(MIN_SECONDS * SAMPLE_RATE), int(MAX_SECONDS * SAMPLE_RATE)
FRESH, REST = 0, 1


def _quietest(rms: np.ndarray, width: int) -> np.ndarray:
    """Per frame the first quietest of the ``width`` frames before it, by a table of doubled spans; -1 where there are fewer."""
    out = np.full(len(rms), -1)
    if len(rms) <= width:
        return out
    at, span = np.arange(len(rms)), 1
    while 2 * span <= width:
        a, b = at[:len(at) - span], at[span:]
        at, span = np.where(rms[b] < rms[a], b, a), 2 * span
    first, last = at[:len(rms) - width], at[width - span:len(rms) - span]
    out[width:] = np.where(rms[last] < rms[first], last, first)
    return out


class _Cuts:
    """Pieces among the frames of a chunk and its neighbours. A state is (kind, frame): a fresh piece begins at the
    frame; a rest began at the quietest frame before it and was cut loose at it."""

    def __init__(self, rows: dict[str, list], mode: str) -> None:
        self.no, self.own = rows["frame_no"], np.asarray(rows["own"], dtype=bool)
        self.stateful = mode == "stateful"
        n = np.asarray(rows["n_samples"], dtype=np.int64)
        rms = np.asarray(rows["rms"], dtype="float64")
        self.size, self.start = len(n), int(rows["start"][0])
        self.sum = np.concatenate([[0], np.cumsum(n)])
        self.rms, self.n, speech = rms, n, rms > SPEECH_RMS
        place = np.arange(self.size)
        last = np.maximum.accumulate(np.where(speech, place, -1))
        quiet = (place - last >= SILENT_FRAMES) if not self.stateful else (self.sum[1:] - self.sum[last + 1] >= SILENCE_SAMPLES)
        self.next_quiet, self.next_speech = self._next(quiet & ~speech), self._next(speech)
        self.q = _quietest(rms, SEARCH_FRAMES - 1) if self.stateful else np.full(self.size, -1)

    def _next(self, flags: np.ndarray) -> np.ndarray:
        """Per frame, and one past the last, the first flagged frame from there on; ``size`` without one."""
        at = np.where(flags, np.arange(self.size), self.size)
        return np.append(np.minimum.accumulate(at[::-1])[::-1], self.size).astype(int)

    def _reach(self, begin: int, samples: int) -> int:
        """First frame with which a piece from ``begin`` has so many samples."""
        return min(int(np.searchsorted(self.sum, self.sum[begin] + samples)) - 1, self.size)

    def begin(self, state: tuple[int, int]) -> int:
        return state[1] if state[0] == FRESH else int(self.q[state[1]])

    def step(self, state: tuple[int, int]) -> tuple[int, int, tuple[int, int] | None]:
        """(first frame, one past the last frame, next state) of the piece that ``state`` begins; no next state at the end."""
        kind, at = state
        first, fed = self.begin(state), at + kind
        cap = self._reach(first, _MAX)
        if not self.stateful:
            quiet = self.next_quiet[min(max(self._reach(first, _MIN), first + SILENT_FRAMES - 1), self.size)]
        elif kind == FRESH:
            quiet = self.next_quiet[self._reach(first, SILENCE_SAMPLES)]
        else:  # all that a rest holds counts as silence until speech follows
            quiet = max(self._reach(first, SILENCE_SAMPLES), fed)
            if quiet >= self.next_speech[min(fed, self.size)]:
                quiet = self.next_quiet[self.next_speech[fed]]
        end = min(int(quiet), cap)
        if end >= self.size:
            return first, self.size, None
        if self.stateful and end == cap:
            return first, int(self.q[end]), (REST, end)
        return first, end + 1, (FRESH, end + 1)

    def spoken(self, state: tuple[int, int], following: tuple[int, int] | None) -> bool:
        """Whether speech was heard from the state's first frame to the cut that ended its piece."""
        kind, at = state
        end = self.size if following is None else following[1] + following[0]
        if self.next_speech[min(at + kind, self.size)] < end:
            return True
        first = self.begin(state)
        if kind == FRESH:
            return False
        held = slice(first, at + 1)
        return bool((sum(k * r * r for k, r in zip(self.n[held].tolist(), self.rms[held].tolist())) / self.n[held].sum()) ** 0.5 > SPEECH_RMS)

    def mine(self, state: tuple[int, int] | None) -> bool:
        return state is not None and state[1] < self.size and self.begin(state) >= 0 and bool(self.own[self.begin(state)])


class _Gathered:
    """Frames of one chunk and its neighbours, bounded by their length."""

    def __init__(self) -> None:
        self.rows: dict[str, list] = {}

    def feed(self, rows: dict[str, list]) -> list[tuple]:
        for c, values in rows.items():
            self.rows.setdefault(c, []).extend(values)
        return []


_STEPS = "file_id BIGINT, chunk BIGINT, kind INT, upto BIGINT, to_kind INT, to_frame BIGINT"


def _steps(mode: str):
    class Steps(_Gathered):
        """Rows (kind, upto, to_kind, to_frame): states of a kind up to a frame, beyond the row before, lead to the state in the next chunk."""

        def finish(self) -> list[tuple]:
            if not any(self.rows["own"]):
                return []
            cuts, key = _Cuts(self.rows, mode), (self.rows["file_id"][0], self.rows["chunk"][0])
            own = np.flatnonzero(cuts.own)
            lo, hi = int(own[0]), int(own[-1])
            entry = min(cuts._reach(lo, _MAX) + 1, hi)
            leave: dict[tuple[int, int], tuple[int, int] | None] = {}
            out = []
            for kind in (FRESH, REST) if mode == "stateful" else (FRESH,):
                mine: list[tuple] = []
                for at in range(lo, min(entry + SEARCH_FRAMES * kind, cuts.size - 1) + 1):
                    state = (kind, at)
                    if not cuts.mine(state):
                        continue
                    path = []
                    while cuts.mine(state) and state not in leave:
                        path.append(state)
                        state = cuts.step(state)[2]
                    to = leave[state] if state in leave else state
                    for s in path:
                        leave[s] = to
                    exit_ = (None, None) if to is None or to[1] >= cuts.size else (to[0], cuts.no[to[1]])
                    if mine and mine[-1][4:] == exit_:
                        mine.pop()
                    mine.append((*key, kind, cuts.no[at], *exit_))
                out += mine
            return out

    return Steps


class _Chain:
    """First state of every chunk of a file, from the steps in order of chunk, kind and frame."""

    def __init__(self) -> None:
        self.state, self.file, self.chunk, self.found = None, None, None, False

    def feed(self, rows: dict[str, list]) -> list[tuple]:
        out = []
        for file, chunk, kind, upto, to_kind, to_frame in zip(*(rows[c] for c in ("file_id", "chunk", "kind", "upto", "to_kind", "to_frame"))):
            if chunk != self.chunk:
                began = self.chunk is None
                self.chunk, self.found = chunk, False
                if began:
                    self.state = (FRESH, None)
            if self.found or self.state is None or kind != self.state[0] or (self.state[1] is not None and upto < self.state[1]):
                continue
            out.append((file, chunk, *self.state))
            self.found = True
            self.state = None if to_kind is None or to_kind != to_kind else (int(to_kind), int(to_frame))
        return out

    def finish(self) -> list[tuple]:
        return []


def _pieces(mode: str):
    class Pieces(_Gathered):
        def finish(self) -> list[tuple]:
            rows = self.rows
            kind, frame = rows["entry_kind"][0], rows["entry_frame"][0]
            if kind is None or kind != kind:
                return []
            cuts, out = _Cuts(rows, mode), []
            at = int(np.flatnonzero(cuts.own)[0]) if frame is None or frame != frame else int(np.searchsorted(cuts.no, frame))
            state = (int(kind), at)
            while cuts.mine(state):
                first, end, following = cuts.step(state)
                long = cuts.sum[end] - cuts.sum[first] >= _MIN
                if long and (mode != "stateful" or cuts.spoken(state, following)):
                    t0, t1 = ((cuts.start + int(cuts.sum[k])) / SAMPLE_RATE for k in (first, end))
                    out.append((rows["file_id"][0], t0, t1, end - first))
                state = following
            return out

    return Pieces


def segment(frames: DataFrame, mode: str = "simple", chunk_seconds: float = CHUNK_SECONDS) -> DataFrame:
    """(file_id, t_start, t_end, n_frames) of the utterances. ``simple`` cuts after 15 silent frames or at 30 s; the silence stays at
    the end of the utterance. ``stateful`` cuts on 500 ms of silence, or at 30 s at the quietest frame of the last 5 s, and
    drops pieces without speech. Very short pieces are dropped by both. The result is the same for every chunk length."""
    if mode not in ("simple", "stateful"):
        raise ValueError(mode)
    if chunk_seconds <= MAX_SECONDS + 10:
        raise ValueError("a chunk must be longer than a piece and what it looks back for")
    length = int(chunk_seconds * SAMPLE_RATE)
    plain = frames.select(F.col("file_id").cast("bigint"), F.col("frame_no").cast("bigint"), F.col("n_samples").cast("bigint"), F.col("rms").cast("double"))
    placed = running_sum(plain, ["file_id"], ["frame_no"], F.col("n_samples"), "__end", F.floor(F.col("frame_no") / 65536))
    placed = placed.withColumn("start", F.col("__end") - F.col("n_samples")).drop("__end").withColumn("__chunk", F.floor(F.col("start") / length))
    inside = F.col("start") - F.col("__chunk") * length
    seen = lambda shift, own: F.struct((F.col("__chunk") + shift).alias("chunk"), F.lit(own).alias("own"))
    views = F.filter(F.array(
        seen(0, True), F.when(inside < _MAX + FRAME_SAMPLES, seen(-1, False)),
        F.when(inside >= length - (SEARCH_FRAMES + 1) * FRAME_SAMPLES, seen(1, False)),
    ), lambda v: v.isNotNull())
    rows = placed.withColumn("__v", F.explode(views)).select("file_id", "__v.chunk", "__v.own", "frame_no", "n_samples", "rms", "start")
    steps = fold_sorted(rows, ["file_id", "chunk"], ["frame_no"], _steps(mode), _STEPS)
    entries = fold_sorted(steps, ["file_id"], ["chunk", "kind", "upto"], _Chain, "file_id BIGINT, chunk BIGINT, entry_kind INT, entry_frame BIGINT")
    told = rows.join(entries, ["file_id", "chunk"])
    return fold_sorted(told, ["file_id", "chunk"], ["frame_no"], _pieces(mode), "file_id BIGINT, t_start DOUBLE, t_end DOUBLE, n_frames BIGINT")
