"""Entities: names, duplicate candidates, reference resolution, merging."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recapflow.functions import text as X
from recapflow.functions.ordered import top_n
from recapflow.functions.stages import settled, written
from recapflow.functions.similar import similar_keys, similar_within, token_key
from recapflow.operators.guards import parse_ref
from recapflow.sources.channels import is_streamer

# Fixed values.
PAIR_LIMIT = 25
PAIR_SCORE = 85.0
RESOLVE_SCORE = 90.0
MERGE_AT = 0.75
REVIEW_AT = 0.5


def names(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(channel_id, entity_id, name, is_canonical) for canonical names and aliases."""
    own = entities.select("channel_id", F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"), F.lit(True).alias("is_canonical"))
    keys = entities.select("channel_id", F.col("id").alias("entity_id"))
    other = aliases.join(keys, "entity_id").select("channel_id", "entity_id", F.col("alias").alias("name"), F.lit(False).alias("is_canonical"))
    return own.unionByName(other)


def name_sets(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct lower-cased names per entity."""
    return names(entities, aliases).groupBy("channel_id", "entity_id").agg(
        F.array_sort(F.collect_set(F.lower("name"))).alias("names")
    )


def aka(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Display list of aliases: sorted, distinct, comma separated; a dash when there are none."""
    shown = aliases.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("alias")), ", ").alias("aka"))
    return entities.select(F.col("id").alias("entity_id")).join(shown, "entity_id", "left").na.fill("—", ["aka"])


def candidate_pairs(entities: DataFrame, aliases: DataFrame, limit: int = PAIR_LIMIT) -> DataFrame:
    """Possible duplicates per channel: two unmerged entities that share a name or alias, or whose
    canonical names score at least 85. The first ``limit`` pairs in id order are kept; a list shorter than
    the limit is ordered by combined mentions.

    All members of a group of equal names match each other, so the first ``limit`` pairs can only contain
    the ``limit`` + 1 lowest ids of a group. Larger groups are cut to those before any pair is formed."""
    live = entities.where("status <> 'merged'")
    pair = ["channel_id", "a_id", "b_id"]

    def heads(groups: DataFrame, name: str) -> DataFrame:
        return top_n(groups.distinct(), ["channel_id", name], [F.asc("id")], limit + 1, "__r").drop("__r")

    def inside(groups: DataFrame, name: str) -> DataFrame:
        h = heads(groups, name)
        other = h.withColumnRenamed("id", "b_id")
        return h.withColumnRenamed("id", "a_id").join(other, ["channel_id", name]).where("a_id < b_id").select(*pair)

    by_name = names(live, aliases).select("channel_id", F.col("entity_id").alias("id"), F.lower("name").alias("name"))
    keyed = live.select("channel_id", "id", token_key(F.lower("canonical_name")).alias("key")).where("key <> ''")
    head = heads(keyed, "key")
    close = similar_within(keyed.select("channel_id", "key").distinct(), ["channel_id"], PAIR_SCORE)
    crossed = (
        close.join(head.withColumnsRenamed({"key": "key_a", "id": "x"}), ["channel_id", "key_a"])
        .join(head.withColumnsRenamed({"key": "key_b", "id": "y"}), ["channel_id", "key_b"])
        .select("channel_id", F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"))
    )
    found = inside(by_name, "name").unionByName(inside(keyed, "key")).unionByName(crossed).distinct()
    first = top_n(found, ["channel_id"], [F.asc("a_id"), F.asc("b_id")], limit, "position")
    counts = live.select("channel_id", "id", F.col("mention_count").alias("m"))
    sized = first.groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"))
    mentions = (
        first.join(counts.withColumnsRenamed({"id": "a_id", "m": "ma"}), ["channel_id", "a_id"])
        .join(counts.withColumnsRenamed({"id": "b_id", "m": "mb"}), ["channel_id", "b_id"])
        .join(sized, "channel_id").withColumn("mentions", F.col("ma") + F.col("mb"))
    )
    order = [F.when(F.col("n") < limit, -F.col("mentions")).otherwise(0), F.col("position")]
    return top_n(mentions, ["channel_id"], order, limit).select(*pair, "mentions", "rank")


def _first_entity(matches: DataFrame, keys: Sequence[str], tier: int) -> DataFrame:
    return matches.groupBy(*keys).agg(F.min("entity_id").alias("entity_id")).withColumn("tier", F.lit(tier))


def resolve(refs: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Resolve (channel_id, ref) to stored entities: see ``_answers``. Adds ``name``, ``entity_id`` (NULL for new),
    ``tier`` and ``needs_review``."""
    keys = ["channel_id", "ref"]
    answered = _answers(refs, entities, aliases).select(*keys, "name", "entity_id", "tier", (F.col("tier") == 4).alias("needs_review"))
    return refs.join(answered, keys)


def _answers(refs: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Resolve (channel_id, ref) to entities: by id, exact alias, exact canonical name, best token-set
    score of at least 90 (names of three letters or more), else a new provisional entity.

    One row per distinct reference: name, lname, entity_id (NULL for new), tier and the score of tier 4. Every tier
    works on the references left over by the earlier ones."""
    keys = ["channel_id", "ref"]
    # The distinct references feed every tier, so they are worked out once.
    parsed = settled(refs.select(*keys).distinct().withColumn("p", parse_ref(F.col("ref"))).select(
        *keys, "p.kind", F.col("p.id").alias("ref_id"), "p.name", F.lower("p.name").alias("lname")
    ))
    live = entities.where("status <> 'merged'").select("channel_id", F.col("id").alias("ref_id"), F.col("id").alias("entity_id"))
    by_id = parsed.where("kind = 'entity'").join(live, ["channel_id", "ref_id"]).select(*keys, "entity_id", F.lit(1).alias("tier"))
    open_1 = parsed.join(by_id, keys, "left_anti")

    every = names(entities, aliases).withColumn("lname", F.lower("name")).drop("name")
    exact = open_1.join(every, ["channel_id", "lname"]).withColumn("tier", F.when(F.col("is_canonical"), 3).otherwise(2))
    best = exact.groupBy(*keys).agg(F.min(F.struct("tier", "entity_id")).alias("m")).select(*keys, "m.entity_id", "m.tier")
    open_2 = settled(open_1.join(best, keys, "left_anti").withColumn("key", token_key(F.col("lname"))))

    long = open_2.where(F.length("name") >= 3)
    keyed = every.withColumn("key", token_key(F.col("lname")))
    close = similar_keys(
        long.select("channel_id", "key"), keyed.select("channel_id", "key"), ["channel_id"], RESOLVE_SCORE
    )
    # Lowest id per key first: a popular name then contributes one row per reference key.
    owner = keyed.groupBy("channel_id", "key").agg(F.min("entity_id").alias("entity_id")).withColumnRenamed("key", "key_b")
    top = close.join(owner, ["channel_id", "key_b"]).groupBy("channel_id", "key_a").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "entity_id")).alias("m")
    )
    fuzzy = long.join(top.withColumnRenamed("key_a", "key"), ["channel_id", "key"]).select(
        *keys, F.col("m.entity_id").alias("entity_id"), F.lit(4).alias("tier"), (-F.col("m.s")).alias("score")
    )
    known = by_id.unionByName(best).unionByName(fuzzy, allowMissingColumns=True)
    return parsed.join(known, keys, "left").select(*keys, "name", "lname", "entity_id", F.coalesce("tier", F.lit(5)).alias("tier"), "score")


_NAME, _PLACE = ["channel_id", "lname"], ["channel_id", "window_id", "pos"]


def _other(df: DataFrame, **columns: str) -> DataFrame:
    """Facts about names as facts about the ``other`` name of a pair."""
    return df.withColumnsRenamed({"lname": "other", **columns})


def _makers(first: DataFrame, near: DataFrame, spoken: DataFrame) -> DataFrame:
    """(channel_id, lname, first) of the names for which the batch makes an entity, at the first place they are written.

    ``first``: the names that stored tables do not answer. A name makes an entity unless it or a name it is like is known
    before: as an alias (``spoken``), or because that other name made one. By deterministic reservations: a name that is like no
    undecided earlier name is decided, the names like it drop out, and so on; in random order few rounds are needed."""
    known = first.join(spoken, _NAME, "left").where(~F.coalesce(F.col("spoken") < F.col("first"), F.lit(False))).drop("spoken")
    like = near.join(known, _NAME).join(_other(spoken), ["channel_id", "other"], "left")
    told = like.where(F.col("spoken") < F.col("first")).select(*_NAME)
    free = known.join(told, _NAME, "left_anti")
    both = near.join(free, _NAME).join(_other(free, first="earlier"), ["channel_id", "other"])
    edges = written(both.where(F.col("earlier") < F.col("first")).select("channel_id", "lname", "other"))
    if edges.isEmpty():
        return free
    open_ = written(free)
    made = []
    while not edges.isEmpty():
        free = written(open_.join(edges, _NAME, "left_anti"))
        gone = edges.join(_other(free), ["channel_id", "other"], "left_semi").select(*_NAME).distinct()
        made.append(free)
        open_ = written(open_.join(free, _NAME, "left_anti").join(gone, _NAME, "left_anti"))
        edges = written(edges.join(open_, _NAME, "left_semi").join(_other(open_), ["channel_id", "other"], "left_semi"))
    return functools.reduce(DataFrame.unionByName, made, open_)


def _improvements(told: DataFrame) -> DataFrame:
    """(channel_id, lname, at, entity): the places at which a name comes to lead to an earlier entity than before. A name
    that is written very often is one row per entity after the first, partial step."""
    firsts = told.groupBy(*_NAME, "entity").agg(F.min("at").alias("at"))
    before = Window.partitionBy(*_NAME).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    best = firsts.withColumn("__best", F.min("entity").over(before))
    return best.where(F.col("__best").isNull() | (F.col("entity") < F.col("__best"))).drop("__best")


def _spread(decided: DataFrame, reads: DataFrame) -> DataFrame:
    """``decided`` with ``entity``: the earliest of its own ``given`` and of what the names it reads lead to by then.

    ``decided`` (place, at, given, tells) tells its entity under the names ``tells``. Entities travel from name to name in rounds, until nothing improves; a path visits a name once, so the
    rounds grow with the number of names in a row, not with the number of updates."""
    def found(steps: DataFrame) -> DataFrame:
        led = reads.join(steps.withColumnRenamed("at", "since"), _NAME).where(F.col("since") < F.col("at"))
        read = led.groupBy(*_PLACE).agg(F.min("entity").alias("read"))
        return decided.join(read, _PLACE, "left").withColumn("entity", F.least("given", "read")).drop("read")

    def steps_of(rows: DataFrame) -> DataFrame:
        said = rows.where("entity IS NOT NULL").select("channel_id", F.explode("tells").alias("lname"), "at", "entity")
        return written(_improvements(said))

    def mark(steps: DataFrame) -> tuple:
        return tuple(steps.agg(F.count("*"), F.bit_xor(F.xxhash64(*_NAME, "at", "entity"))).first())

    if reads.isEmpty():
        return decided.withColumn("entity", F.col("given"))
    steps, before = steps_of(decided.withColumn("entity", F.col("given"))), None
    while (now := mark(steps)) != before:
        steps, before = steps_of(found(steps)), now
    return found(steps)


def resolve_in_order(updates: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Resolve a batch of updates (channel_id, window_id, pos, ref, aliases_seen) as if written one by one: a name or
    alias can be matched from the place on where it was first written. Adds name, entity_id or, for entities made in
    the batch, the place (made_window, made_pos) of the update that made it, tier and needs_review.

    What the stored tables decide is found once for all. For names that they leave open, and stored names that the
    batch uses as aliases, three steps follow, each by joins and grouped minima over names: which names make an entity, how
    each update is then answered, and to which entity its names lead by then. No group of names or updates is held
    together in a task. A reference by id must name a stored entity."""
    keys = ["channel_id", "ref"]
    answers = settled(_answers(updates, entities, aliases))
    seen = F.filter(F.transform(F.coalesce("aliases_seen", F.array()), lambda a: F.lower(a)), lambda a: a.isNotNull())
    rows = written(updates.select(*_PLACE, "ref", seen.alias("seen")).join(answers, keys).withColumn("at", F.struct("window_id", "pos")))
    spoken = written(rows.select("channel_id", "at", F.explode("seen").alias("lname")).groupBy(*_NAME).agg(F.min("at").alias("spoken")))
    open_ = F.col("tier") >= 4

    # new names and aliases of the batch that an open name is like
    fresh = answers.where(open_).select(*_NAME).union(spoken.select(*_NAME)).distinct().withColumn("key", token_key(F.col("lname")))
    asking = answers.where(open_ & (F.length("name") >= 3)).select(*_NAME).distinct().withColumn("key", token_key(F.col("lname")))
    close = similar_keys(asking.select("channel_id", "key"), fresh.select("channel_id", "key"), ["channel_id"], RESOLVE_SCORE)
    near = written(
        close.join(asking.withColumnRenamed("key", "key_a"), ["channel_id", "key_a"])
        .join(fresh.withColumnsRenamed({"key": "key_b", "lname": "other"}), ["channel_id", "key_b"])
        .where("lname <> other").select(*_NAME, "other", F.col("score").alias("likeness"))
    )
    first = rows.where("tier = 5").groupBy(*_NAME).agg(F.min("at").alias("first"))
    made = _makers(first, near, spoken)
    since = spoken.join(made, _NAME, "full").select(*_NAME, F.least("spoken", "first").alias("since"))

    # how an update is answered: by a name known before it, by its stored answer, by the likest names known before it, or as new
    timed = rows.join(since, _NAME, "left").withColumn("named", F.coalesce(F.col("since") < F.col("at"), F.lit(False))).drop("since")
    asks = open_ & ~F.col("named")
    like = timed.where(asks).select(*_PLACE, "at", "lname").join(near, _NAME).join(_other(since), ["channel_id", "other"]).where(F.col("since") < F.col("at"))
    best = like.groupBy(*_PLACE).agg(F.max("likeness").alias("best"))
    stored = F.when(F.col("entity_id").isNotNull(), F.struct(F.lit(0).alias("new"), F.col("entity_id").alias("a"), F.lit(0).alias("b")))
    new = F.struct(F.lit(1).alias("new"), F.col("window_id").alias("a"), F.col("pos").alias("b"))
    top = F.greatest("best", "score")
    how = (
        F.when((F.col("tier") == 1) | ((F.col("tier") == 3) & ~F.col("named")), F.col("tier")).when(F.col("named") | (F.col("tier") == 2), 2)
        .when(top.isNotNull(), 4).otherwise(5)
    )
    given = F.when((F.col("how") == F.col("tier")) & F.col("how").isin(1, 2, 3), stored).when((F.col("how") == 4) & (F.col("score") == top), stored).when(F.col("how") == 5, new)
    tells = F.when(F.col("how") == 5, F.array_append("seen", F.col("lname"))).otherwise(F.col("seen"))
    answered = timed.join(best, _PLACE, "left").withColumn("how", how)
    decided = written(answered.withColumn("top", top).select(*_PLACE, "at", "lname", "named", "how", "top", given.alias("given"), tells.alias("tells")))
    likest = decided.where("how = 4").select(*_PLACE, "top").join(like, _PLACE).where("likeness = top")
    reads = written(
        decided.where("named AND how = 2").select(*_PLACE, "at", "lname")
        .unionByName(likest.select(*_PLACE, "at", F.col("other").alias("lname")))
    )
    found = _spread(decided.select(*_PLACE, "at", "how", "given", "tells"), reads)
    is_new = F.col("entity.new") == 1
    done = found.select(
        *_PLACE, F.when(~is_new, F.col("entity.a")).alias("entity_id"), F.when(is_new, F.col("entity.a")).alias("made_window"),
        F.when(is_new, F.col("entity.b")).alias("made_pos"), F.col("how").alias("tier"),
    )
    return updates.join(done, _PLACE).join(answers.select(*keys, "name"), keys).withColumn("needs_review", F.col("tier") == 4)


def follow_merges(entities: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, root_id): end of every merge chain. Each round doubles the distance covered and is settled, so
    the plan stays small; it ends when all chains have ended. A cycle fails loudly."""
    merged = entities.where("merged_into IS NOT NULL").select("id", F.col("merged_into").alias("root_id"))
    links = settled(merged)
    for _ in range(rounds):
        if links.join(links.select(F.col("id").alias("root_id")), "root_id", "left_semi").isEmpty():
            break
        nxt = links.select(F.col("id").alias("root_id"), F.col("root_id").alias("__next"))
        links = settled(links.join(nxt, "root_id", "left").select("id", F.coalesce("__next", "root_id").alias("root_id")))
    else:
        raise ValueError("cyclic merges")
    return entities.select("id").join(links, "id", "left").select("id", F.coalesce("root_id", "id").alias("root_id"))


def suggest(pairs: DataFrame, answers: DataFrame, entities: DataFrame, channels: DataFrame, threshold: float = MERGE_AT) -> DataFrame:
    """Merge suggestions from answers (channel_id, a_id, b_id, noul): below 0.5 dropped, from 0.75 'merge',
    else 'review'; the lower id absorbs; pairs with the streamer always go to review."""
    flagged = is_streamer(entities, channels).select("channel_id", "id", F.col("canonical_name").alias("n"), "is_streamer")
    noul = F.coalesce(F.col("noul").try_cast("double"), F.lit(0.0))
    scored = pairs.join(answers, ["channel_id", "a_id", "b_id"]).withColumn("noul", noul).where(F.col("noul") >= REVIEW_AT)
    a = flagged.withColumnsRenamed({"id": "into_id", "n": "into_name", "is_streamer": "sa"})
    b = flagged.withColumnsRenamed({"id": "from_id", "n": "from_name", "is_streamer": "sb"})
    return (
        scored.select("channel_id", F.least("a_id", "b_id").alias("into_id"), F.greatest("a_id", "b_id").alias("from_id"), "noul")
        .join(a, ["channel_id", "into_id"]).join(b, ["channel_id", "from_id"])
        .withColumn("band", F.when((F.col("noul") >= threshold) & ~F.col("sa") & ~F.col("sb"), "merge").otherwise("review"))
        .select("channel_id", "from_id", "into_id", "from_name", "into_name", F.bround("noul", 3).alias("noul"), "band")
    )


def pair_state(pairs: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per channel one line for every entity in its candidate pairs (at most 2 x the pair limit)."""
    ids = pairs.select("channel_id", F.explode(F.array("a_id", "b_id")).alias("id")).distinct()
    dash = F.lit("—")
    known = entities.join(ids, ["channel_id", "id"], "left_semi").join(
        aka(entities.join(ids, ["channel_id", "id"], "left_semi"), aliases).withColumnRenamed("entity_id", "id"), "id"
    )
    line = F.concat(
        F.lit("E"), F.col("id"), F.lit(" '"), F.col("canonical_name"), F.lit("' ["), F.col("type"), F.lit(", "), F.col("status"),
        F.lit(", "), F.col("mention_count"), F.lit(" mentions]: "), F.coalesce("description", dash), F.lit(" | also known as: "), F.col("aka"),
    )
    return known.select("channel_id", F.struct("id", line.alias("line")).alias("e")).groupBy("channel_id").agg(
        X.lines(F.collect_list("e")).alias("state")
    )


def apply_merges(entities: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, audit rows) after merges (into_id, from_id); both must exist, differ and share a channel."""
    ids = entities.select(F.col("id").alias("into_id"), F.col("channel_id").alias("__c"))
    wanted = merges.where("into_id <> from_id").groupBy("from_id").agg(F.max("into_id").alias("into_id"))
    valid = wanted.join(ids, "into_id").select(F.col("from_id").alias("id"), F.col("__c").alias("channel_id"), F.col("into_id").alias("__into"))
    joined = entities.join(valid, ["id", "channel_id"], "left")
    hit = F.col("__into").isNotNull()
    state = F.struct("status", "merged_into")
    after = F.struct(F.lit("merged").alias("status"), F.col("__into").alias("merged_into"))
    audit = joined.where(hit).select(
        F.lit("entity").alias("target_type"), F.col("id").alias("target_id"),
        F.to_json(state, {"ignoreNullFields": "false"}).alias("before_json"), F.to_json(after).alias("after_json"),
    )
    updated = joined.withColumn("status", F.when(hit, "merged").otherwise(F.col("status"))).withColumn(
        "merged_into", F.coalesce("__into", "merged_into")
    )
    return updated.select(*entities.columns), audit
