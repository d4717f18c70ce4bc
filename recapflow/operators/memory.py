"""Writing extracted memory: entities, storylines, events, participants, attributions.

A batch holds extractions of any number of windows and channels. References are resolved against the
stored tables plus the new names of the batch; ids of new rows continue after the stored ones.

``extractions``: window_id, session_id, channel_id, at (time stamp), extraction. Order inside a channel is by
window id, then by position in the document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapflow.functions import text as X
from recapflow.functions.folds import fold_sorted
from recapflow.functions.ordered import id_block
from recapflow.functions.stages import settled
from recapflow.operators import resolve
from recapflow.operators.guards import gate, parse_ref, thread_title
from recapflow.params import DEFAULTS, Params
from recapflow.sources.tables import insert_new, next_ids, upsert

# Fixed values.
CONFIRM_AT = 2
RESOLVE_CONFIDENCE = 0.7
EVIDENCE_CHARS = 60
NEW_IMPORTANCE = 3


@dataclass
class Memory:
    entities: DataFrame
    entity_aliases: DataFrame
    threads: DataFrame
    events: DataFrame
    event_participants: DataFrame
    attributions: DataFrame


def _items(extractions: DataFrame, field: str) -> DataFrame:
    return extractions.select(
        "window_id", "session_id", "channel_id", "at", F.posexplode(F.col("extraction")[field]).alias("pos", "u")
    ).select("window_id", "session_id", "channel_id", "at", "pos", "u.*")


def gated(extractions: DataFrame, field: str, kind: str, p: Params = DEFAULTS) -> DataFrame:
    return _items(extractions, field).withColumn("outcome", gate(kind, F.col("confidence"), p))


def counters(extractions: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Applied and quarantined proposals per kind."""
    fields = {"entity": "entity_updates", "thread": "thread_updates", "event": "events", "attribution": "utterance_attributions"}

    def outcomes(kind: str, field: str) -> Column:
        items = F.coalesce(F.col("extraction")[field], F.array())
        return F.transform(items, lambda u: F.struct(F.lit(kind).alias("kind"), gate(kind, u["confidence"], p).alias("outcome")))

    each = extractions.select(F.explode(F.concat(*[outcomes(k, f) for k, f in fields.items()])).alias("o")).select("o.*")
    return each.groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("n"))


def _max_id(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]


class _Digest:
    """Text of one id, growing by deltas. What goes beyond the limit is cut out behind the first characters."""
    LIMIT, FIRST = 2000, 400

    def __init__(self) -> None:
        self.key, self.text = None, ""

    def feed(self, rows: dict[str, list]) -> list[tuple]:
        self.key = rows["id"][0]
        for pos, delta in zip(rows["pos"], rows["delta"]):
            if pos < 0:
                self.text = delta or ""
                continue
            self.text = " ".join((self.text, delta)).strip()
            over = len(self.text) - self.LIMIT
            if over > 0:
                rest = self.text[self.FIRST + over + len(X.ELLIPSIS):]
                self.text = "".join((self.text[:self.FIRST].rstrip(), X.ELLIPSIS, rest.lstrip()))
        return []

    def finish(self) -> list[tuple]:
        return [(self.key, self.text)]


def fold_text(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """(id, text): ``base`` (id, text) with the ``deltas`` (id, window_id, pos, delta) appended in order, each
    step bounded. One row at a time flows through a state of at most 2000 characters."""
    told = deltas.where("delta IS NOT NULL AND delta <> ''").select("id", "window_id", "pos", "delta")
    seeds = base.join(told.select("id"), "id", "left_semi").select(
        "id", F.lit(-1).cast("bigint").alias("window_id"), F.lit(-1).alias("pos"), F.col("text").alias("delta")
    )
    return fold_sorted(seeds.unionByName(told), ["id"], ["window_id", "pos"], _Digest, "id BIGINT, text STRING")


def _entities(ext: DataFrame, entities: DataFrame, aliases: DataFrame, p: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, aliases, (window_id, ref, entity_id))."""
    updates = gated(ext, "entity_updates", "entity", p).where("outcome = 'applied'")
    found = settled(resolve.resolve_in_order(updates, entities, aliases))
    numbered = settled(next_ids(found.where("tier = 5"), ["window_id", "pos"], id_block("window_id"), _max_id(entities), "new_id"))
    new_ids = numbered.select(F.col("window_id").alias("made_window"), F.col("pos").alias("made_pos"), "new_id")
    known = found.join(new_ids, ["made_window", "made_pos"], "left").withColumn("id", F.coalesce("entity_id", "new_id"))
    created = numbered.select(
        F.col("new_id").alias("id"), "channel_id", "type", F.col("name").alias("canonical_name"), F.lit(None).cast("string").alias("description"),
        F.lit("provisional").alias("status"), F.lit(None).cast("bigint").alias("merged_into"), F.lit(False).alias("needs_review"),
        F.lit(None).cast("bigint").alias("voiced_by_speaker_id"), F.lit(0).cast("bigint").alias("mention_count"),
        F.col("session_id").alias("first_seen_session"), F.lit(None).cast("timestamp").alias("last_seen_at"),
    )
    base = entities.unionByName(created.select(*entities.columns))
    touched = known.groupBy("id").agg(
        F.count(F.lit(1)).alias("__n"), F.max("at").alias("__at"), F.max("needs_review").alias("__review")
    )
    texts = fold_text(base.select("id", F.col("description").alias("text")), known.select("id", "window_id", "pos", F.col("description_delta").alias("delta")))
    count = F.col("mention_count") + F.coalesce("__n", F.lit(0))
    promoted = F.col("__n").isNotNull() & (F.col("status") == "provisional") & (count >= CONFIRM_AT)
    updated = base.join(touched, "id", "left").join(texts.withColumnRenamed("text", "__text"), "id", "left").withColumns({
        "status": F.when(promoted, "confirmed").otherwise(F.col("status")), "mention_count": count,
        "last_seen_at": F.greatest("last_seen_at", "__at"), "description": F.coalesce("__text", "description"),
        "needs_review": F.col("needs_review") | F.coalesce("__review", F.lit(False)),
    }).select(*entities.columns)
    seen = known.select(F.col("id").alias("entity_id"), F.explode("aliases_seen").alias("alias")).unionByName(
        numbered.select(F.col("new_id").alias("entity_id"), F.col("name").alias("alias"))
    ).where("alias IS NOT NULL").withColumn("source", F.lit("extraction")).distinct()
    all_aliases = aliases.unionByName(insert_new(aliases, seen, ["entity_id", "alias"]).select(*aliases.columns))
    refs = known.select("window_id", "ref", F.col("id").alias("entity_id"), "pos")
    by_id = refs.where(F.col("ref").startswith("NEW:")).withColumn("ref", F.concat(F.lit("E"), F.col("entity_id")))
    ref_map = refs.unionByName(by_id).groupBy("window_id", "ref").agg(F.max_by("entity_id", "pos").alias("entity_id"))
    return updated, all_aliases, ref_map


def _threads(ext: DataFrame, threads: DataFrame, p: Params) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(threads with new rows, updates (id, window_id, pos, at, status, delta, confidence), (window_id, ref, thread_id))."""
    updates = settled(gated(ext, "thread_updates", "thread", p).where("outcome = 'applied'").withColumn("p", parse_ref(F.col("ref"))))
    stored = threads.select("channel_id", F.col("id").alias("thread_id"))
    old = updates.where("p.kind = 'thread'").withColumn("thread_id", F.col("p.id")).join(stored, ["channel_id", "thread_id"])
    new = settled(next_ids(updates.where(F.col("ref").startswith("NEW:")), ["window_id", "pos"], id_block("window_id"), _max_id(threads), "thread_id"))
    created = new.select(
        F.col("thread_id").alias("id"), "channel_id", thread_title(F.col("ref")).alias("title"), F.lit("").alias("summary"),
        F.lit("open").alias("status"), F.lit(NEW_IMPORTANCE).alias("importance"), F.col("at").alias("last_updated_at"),
    )
    cols = ["thread_id", "window_id", "pos", "ref", "at", "status", "delta", "confidence"]
    every = old.select(*cols).unionByName(new.select(*cols))
    ref_map = every.groupBy("window_id", "ref").agg(F.max_by("thread_id", "pos").alias("thread_id"))
    return threads.unionByName(created.select(*threads.columns)), every, ref_map


def accepted_status(status: Column, confidence: Column) -> Column:
    """Status an update sets; an unsure 'resolved' sets none."""
    return F.when(~((status == "resolved") & (confidence < RESOLVE_CONFIDENCE)), status)


def thread_importance(old: Column, biggest_event: Column) -> Column:
    """A storyline is as important as the biggest event it has carried."""
    return F.greatest(F.coalesce(old, F.lit(0)), F.coalesce(biggest_event, F.lit(0)))


def fold_threads(threads: DataFrame, updates: DataFrame, carried: DataFrame) -> DataFrame:
    """Storylines after updates and after the events they carry (thread_id, importance, at)."""
    at = F.struct("window_id", "pos")
    told = accepted_status(F.col("status"), F.col("confidence"))
    moved = updates.groupBy(F.col("thread_id").alias("id")).agg(
        F.max_by(told, F.when(told.isNotNull(), at)).alias("__status"), F.max("at").alias("__at")
    )
    weight = carried.groupBy(F.col("thread_id").alias("id")).agg(F.max("importance").alias("__imp"), F.max("at").alias("__eat"))
    texts = fold_text(threads.select("id", F.col("summary").alias("text")), updates.select(F.col("thread_id").alias("id"), "window_id", "pos", "delta"))
    return (
        threads.join(moved, "id", "left").join(weight, "id", "left").join(texts.withColumnRenamed("text", "__text"), "id", "left")
        .withColumns({
            "status": F.coalesce("__status", "status"), "summary": F.coalesce("__text", "summary"),
            "last_updated_at": F.greatest("last_updated_at", "__at", "__eat"),
            "importance": thread_importance(F.col("importance"), F.col("__imp")).cast("int"),
        }).select(*threads.columns)
    )


def link(rows: DataFrame, ref: str, in_batch: DataFrame, stored: DataFrame, prefix: str, out: str) -> DataFrame:
    """Reference look-up: the batch's own references first, then a stored id of the same channel, else NULL."""
    number = F.regexp_extract(F.coalesce(ref, F.lit("")), rf"^{prefix}(\d+)$", 1)
    known = stored.select("channel_id", F.col("id").alias("__sid"))
    mapped = in_batch.select("window_id", F.col("ref").alias(ref), F.col(out).alias("__bid"))
    return (
        rows.join(mapped, ["window_id", ref], "left")
        .withColumn("__sid", F.nullif(number, F.lit("")).try_cast("bigint"))
        .join(known.withColumn("__ok", F.lit(True)), ["channel_id", "__sid"], "left")
        .withColumn(out, F.coalesce("__bid", F.when(F.col("__ok"), F.col("__sid"))))
        .drop("__bid", "__sid", "__ok")
    )


def attributions(ext: DataFrame, ref_map: DataFrame, entities: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """One attribution per segment, the last one wins. Weak ones are kept as 'unclear' without an entity."""
    rows = gated(ext, "utterance_attributions", "attribution", p)
    linked = link(rows, "entity_ref", ref_map, entities, "E", "entity_id")
    sure = F.col("outcome") == "applied"
    value = F.struct(
        F.when(sure, F.col("kind")).otherwise("unclear").alias("kind"), F.when(sure, F.col("entity_id")).alias("entity_id"),
        "confidence", X.cap(F.coalesce("evidence", F.lit("")), EVIDENCE_CHARS).alias("evidence"), F.lit("llm").alias("method"),
    )
    return linked.groupBy("segment_id").agg(F.max_by(value, F.struct("window_id", "pos")).alias("v")).select("segment_id", "v.*")


def apply(ext: DataFrame, memory: Memory, p: Params = DEFAULTS) -> Memory:
    """New table versions after writing a batch of extractions. Steps that several tables depend on are
    settled, so that each is computed once and new ids stay the same if an executor is lost."""
    ext = settled(ext)
    entities, aliases, entity_refs = _entities(ext, memory.entities, memory.entity_aliases, p)
    grown, updates, thread_refs = _threads(ext, memory.threads, p)
    proposed = gated(ext, "events", "event", p).where("outcome = 'applied'")
    placed = link(proposed, "thread_ref", thread_refs, grown, "T", "thread_id")
    numbered = settled(next_ids(placed, ["window_id", "pos"], id_block("window_id"), _max_id(memory.events)))
    new_events = numbered.select(
        "id", "session_id", "window_id", "t_start", "t_end", "type", F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("importance", F.lit(NEW_IMPORTANCE)).cast("int").alias("importance"), "thread_id", X.norm_role(F.coalesce("streamer_role", F.lit(""))).alias("streamer_role"),
    )
    carried = numbered.where("thread_id IS NOT NULL").select("thread_id", "importance", "at")
    named = link(
        numbered.select("window_id", "channel_id", F.col("id").alias("event_id"), F.explode("participants").alias("ref")),
        "ref", entity_refs, entities, "E", "entity_id",
    )
    participants = named.where("entity_id IS NOT NULL").select("event_id", "entity_id").distinct()
    told = attributions(ext, entity_refs, entities, p)
    return Memory(
        entities, aliases, fold_threads(grown, updates, carried),
        memory.events.unionByName(new_events.select(*memory.events.columns)),
        memory.event_participants.unionByName(participants.select(*memory.event_participants.columns)),
        upsert(memory.attributions, told.select(*memory.attributions.columns), ["segment_id"], [F.lit(1)]),
    )
