"""Scores of transcripts, memory and summaries against gold data."""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recapflow.functions import text as X
from recapflow.functions.folds import fold_sorted
from recapflow.functions.fuzzy import aligned_count, word_edit_distance
from recapflow.functions.groups import connected
from recapflow.functions.similar import similar_keys, similar_within, token_key
from recapflow.functions.stages import written

# Thresholds per list of a snapshot.
THRESHOLDS = {"events": 80.0, "entities": 95.0, "threads": 85.0}
FACT_SCORE = 80.0
DUPLICATE_SCORE = 90.0

FACTS_PER_PACK = 64  # our own layout choice: facts that travel with one copy of a text


def wer(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Word errors and word error rate per pair."""
    a, b = X.words(F.col(ref)), X.words(F.col(hyp))
    counted = pairs.withColumn("errors", word_edit_distance(a, b)).withColumn("ref_words", F.size(a).cast("bigint"))
    return counted.withColumn("wer", F.col("errors") / F.greatest(F.col("ref_words"), F.lit(1)))


def corpus_wer(scored: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*groups).agg(
        (F.sum("errors") / F.greatest(F.sum("ref_words"), F.lit(1))).alias("wer"), F.count(F.lit(1)).alias("pairs")
    )


def accuracy(pred: Column, gold: Column) -> Column:
    """Share of gold positions with the same value; 0 without gold."""
    n = F.least(F.size(pred), F.size(gold))
    hits = F.filter(F.zip_with(F.slice(pred, 1, n), F.slice(gold, 1, n), lambda a, b: a == b), lambda x: x)
    return F.when(F.size(gold) == 0, 0.0).otherwise(F.size(hits) / F.size(gold))


def assign(pairs: DataFrame) -> DataFrame:
    """(session_id, gold_no, pred_no) when gold items in order each take their best prediction that is still free; best by
    ``cost``, then by number. ``pairs``: session_id, gold_no, pred_no, cost.

    By deferred acceptance: every gold item asks its best remaining prediction, a prediction holds the first of those that ask
    and is lost to all later ones, and so on until nobody is turned down. Since predictions rank gold items by their order, the
    result is that of the loop over gold items. A round is two grouped minima and a join over all sessions; keys are single items."""
    left = written(pairs.select("session_id", "gold_no", "pred_no", "cost"))
    n = left.count()
    while True:
        asked = left.groupBy("session_id", "gold_no").agg(F.min(F.struct("cost", "pred_no")).alias("best")).select("session_id", "gold_no", "best.pred_no")
        held = asked.groupBy("session_id", "pred_no").agg(F.min("gold_no").alias("holder"))
        met = left.join(held, ["session_id", "pred_no"], "left")
        left = written(met.where(F.col("holder").isNull() | (F.col("gold_no") <= F.col("holder"))).drop("holder"))
        before, n = n, left.count()
        if n == before:
            return asked


def matches(pred: DataFrame, gold: DataFrame, threshold: float) -> DataFrame:
    """(session_id, matched) for lists ``pred``/``gold`` (session_id, no, text). Only pairs that reach the threshold can be
    matched, and these are held per name, not per item: items of the same words have the same choices, and an item listed
    under several names chooses, or is chosen, by all of them.

    Names that reach each other over such pairs form a group, and no item matters to another group. So each group is done in one
    pass: its gold items stream in order past its predictions, which are kept as numbers (see ``_Take``)."""
    key = token_key(X.fold_case(F.col("text")))
    told = [
        df.where("session_id IS NOT NULL AND no IS NOT NULL").select("session_id", F.lit(side).alias("side"), F.col("no").cast("bigint").alias("no"), key.alias("key"))
        for side, df in enumerate((pred, gold))
    ]
    listed = told[0].unionByName(told[1]).groupBy("session_id", "side", "no").agg(F.array_join(F.array_sort(F.collect_set("key")), "\n").alias("names"))
    items = written(listed.where("names <> ''"))
    spans = items.groupBy("session_id", "side", "names").agg(F.min("no").alias("first"), F.max("no").alias("last"))
    names = written(spans.withColumn("id", F.monotonically_increasing_id()))
    worded = names.select("session_id", "side", "id", F.explode(F.split("names", "\n")).alias("key"))
    p, g = (worded.where(F.col("side") == side).drop("side") for side in (0, 1))
    close = similar_keys(g.select("session_id", "key"), p.select("session_id", "key"), ["session_id"], threshold)
    a, b = (df.withColumnsRenamed({"id": end, "key": f"key_{end}"}) for df, end in ((g, "a"), (p, "b")))
    pairs = written(close.join(a, ["session_id", "key_a"]).join(b, ["session_id", "key_b"]).groupBy("a", "b").agg((-F.max("score")).alias("cost")))
    # Groups meet by hashes, which tell ids apart, and go by the id of one of their names: the fold compares keys as doubles, and
    # ids, unlike hashes, are exact there.
    roots = connected(pairs.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    group = names.select(F.xxhash64("id").alias("root"), F.col("id").alias("group"))
    placed = written(names.withColumn("node", F.xxhash64("id")).join(roots, "node").join(group, "root").drop("node", "root"))

    # Predictions by name and number; then each gold item by number, the first of a name after the choices of the name.
    own, past = F.col("side") == 0, F.when(F.col("no") == F.col("last"), 2).otherwise(1)
    rows = items.join(placed, ["session_id", "side", "names"]).select(
        "group", "side", F.when(own, F.col("id")).otherwise(F.col("no")).alias("at"), F.when(own, F.col("no")).otherwise(past).alias("step"), F.lit(0.0).alias("cost"), "id")
    choices = pairs.join(placed.select(F.col("id").alias("a"), "group", "first"), "a").select(
        "group", F.lit(1).alias("side"), F.col("first").alias("at"), F.lit(0).cast("bigint").alias("step"), "cost", F.col("b").alias("id"))
    taken = fold_sorted(rows.unionByName(choices), ["group"], ["side", "at", "step", "cost"], _Take, "group BIGINT, matched BIGINT")
    return written(taken.join(placed.select("group", "session_id").distinct(), "group").groupBy("session_id").agg(F.sum("matched").alias("matched")))


class _Take:
    """Gold items, in order, each take their best free prediction: by cost, then by number. Predictions of one name are taken
    in order, so of each name only the place of its next one moves. Choices of a gold name are kept from its first item to its
    last one, or until nothing of them is left."""

    def __init__(self) -> None:
        self.numbers, self.ids, self.heads, self.ends = (array("q") for _ in range(4))
        self.costs, self.choices = array("d"), array("q")
        self.open: dict[int, _Wish] = {}
        self.group, self.matched = None, 0

    def feed(self, rows: dict[str, list]) -> list[tuple]:
        self.group = rows["group"][0]
        for side, at, step, cost, own in zip(rows["side"], rows["at"], rows["step"], rows["cost"], rows["id"]):
            if side == 0:
                if not self.ids or self.ids[-1] != own:
                    self.ids.append(own)
                    self.heads.append(len(self.numbers))
                    self.ends.append(len(self.numbers))
                self.numbers.append(step)
                self.ends[-1] += 1
            elif step == 0:
                k = bisect_left(self.ids, own)
                if self.heads[k] < self.ends[k]:
                    self.costs.append(cost)
                    self.choices.append(k)
            else:
                if self.choices:
                    self.open[own] = _Wish(self.costs, self.choices)
                    self.costs, self.choices = array("d"), array("q")
                if (wish := self.open.get(own)) is not None:
                    found = self._take(wish)
                    self.matched += found
                    if not found or step == 2:
                        del self.open[own]
        return []

    def _take(self, wish: _Wish) -> bool:
        numbers, heads, ends = self.numbers, self.heads, self.ends
        while True:
            tied = wish.tied
            while tied:
                number, k = tied[0]
                if heads[k] == ends[k]:
                    heapq.heappop(tied)
                elif numbers[heads[k]] != number:
                    heapq.heapreplace(tied, (numbers[heads[k]], k))
                else:
                    heads[k] += 1
                    return True
            if wish.at == len(wish.choices):
                return False
            equal = bisect_right(wish.costs, wish.costs[wish.at], wish.at)
            wish.tied = [(numbers[heads[k]], k) for k in wish.choices[wish.at:equal] if heads[k] < ends[k]]
            heapq.heapify(wish.tied)
            wish.at = equal

    def finish(self) -> list[tuple]:
        return [(self.group, self.matched)]


class _Wish:
    """Choices of a gold name by cost; of those tied at the lowest cost with something left, the next numbers as a heap."""

    def __init__(self, costs: array, choices: array) -> None:
        self.costs, self.choices, self.at = costs, choices, 0
        self.tied: list[tuple[int, int]] = []


def prf(pred: DataFrame, gold: DataFrame, threshold: float = 85.0) -> DataFrame:
    """Precision, recall and F1 per session of greedy fuzzy matching, four digits."""
    np_, ng = (df.groupBy("session_id").agg(F.count(F.lit(1)).alias(c)) for df, c in ((pred, "n_pred"), (gold, "n_gold")))
    rows = np_.join(ng, "session_id", "full").join(matches(pred, gold, threshold), "session_id", "left").na.fill(0, ["n_pred", "n_gold", "matched"])
    m, n, k = F.col("matched"), F.col("n_pred"), F.col("n_gold")
    precision = F.when(n > 0, m / n).otherwise(F.when(k == 0, 1.0).otherwise(0.0))
    recall = F.when(k > 0, m / k).otherwise(F.when(n == 0, 1.0).otherwise(0.0))
    f1 = F.when(precision + recall == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return rows.select("session_id", "matched", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def fact_recall(summaries: DataFrame, facts: DataFrame, groups: Sequence[str] = ("session_id",), strict: bool = False) -> DataFrame:
    """Share of required facts found in the summary text; 1 without facts. ``summaries``: groups, text;
    ``facts``: groups, fact.

    As defined, a fact counts as soon as one of its words occurs in the text, which most pairs settle without
    any scoring; only pairs without a common word are aligned. ``strict`` asks for all words of the fact. NULL facts
    and texts do not count. A text travels once per pack of facts."""
    groups = list(groups)
    counted = facts.where("fact IS NOT NULL").groupBy(*groups, X.fold_case(F.col("fact")).alias("fact")).agg(F.count(F.lit(1)).alias("n"))
    packs = counted.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / FACTS_PER_PACK).alias("__n"))
    chunk = F.pmod(F.xxhash64("fact"), F.col("__n"))
    packed = counted.join(packs, groups).groupBy(*groups, chunk.alias("__c")).agg(F.collect_list(F.struct("fact", "n")).alias("__facts"))
    texts = summaries.where("text IS NOT NULL").select(*groups, X.fold_case(F.col("text")).alias("__text"))
    words = F.array_distinct(X.tokens(F.col("__text")))
    pairs = packed.join(texts, groups).withColumn("__words", words)

    def hit(f: Column) -> Column:
        own = F.array_distinct(X.tokens(f))
        return F.size(F.array_except(own, "__words")) == 0 if strict else F.arrays_overlap(own, "__words")

    # Aligning is the expensive part, so its rows, each a text with a bounded number of facts, are spread.
    def total(c: str) -> Column:
        return F.aggregate(c, F.lit(0).cast("bigint"), lambda acc, f: acc + f["n"])

    aligned = F.lit(0) if strict else F.when(F.size("__open") > 0, aligned_count("__open.fact", "__open.n", "__text", F.lit(FACT_SCORE))).otherwise(0)
    parted = pairs.withColumn("__open", F.filter("__facts", lambda f: ~hit(f["fact"]))).drop("__words").repartition(*groups, "__c")
    found = parted.withColumns({"__all": total("__facts"), "__hits": total("__facts") - total("__open") + aligned})
    share = found.groupBy(*groups).agg(F.round(F.sum("__hits") / F.sum("__all"), 4).alias("fact_recall"))
    return summaries.select(*groups).distinct().join(share, groups, "left").na.fill(1.0, ["fact_recall"])


def duplicate_rate(names: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Share of name pairs scoring at least 90. ``names``: groups, name.

    Equal names are counted, not paired: a key with n members has n(n-1)/2 pairs inside and n*m with a
    similar key of m members."""
    groups = list(groups)
    keyed = names.select(*groups, token_key(F.lower("name")).alias("key"))
    counts = keyed.groupBy(*groups, "key").agg(F.count(F.lit(1)).alias("n"))
    inside = counts.where("key <> ''").select(*groups, (F.col("n") * (F.col("n") - 1) / 2).alias("d"))
    close = similar_within(counts.select(*groups, "key"), groups, DUPLICATE_SCORE)
    across = (
        close.join(counts.withColumnsRenamed({"key": "key_a", "n": "na"}), [*groups, "key_a"])
        .join(counts.withColumnsRenamed({"key": "key_b", "n": "nb"}), [*groups, "key_b"])
        .select(*groups, (F.col("na") * F.col("nb")).cast("double").alias("d"))
    )
    dup = inside.unionByName(across).groupBy(*groups).agg(F.sum("d").alias("dups"))
    total = counts.groupBy(*groups).agg(F.sum("n").alias("names"))
    pairs = F.col("names") * (F.col("names") - 1) / 2
    return total.join(dup, groups, "left").na.fill(0.0, ["dups"]).withColumn(
        "duplicate_rate", F.when(F.col("names") < 2, 0.0).otherwise(F.col("dups") / pairs)
    )


def evaluate(transcripts: DataFrame, lists: DataFrame, gold: DataFrame) -> DataFrame:
    """Snapshot scores per session. ``transcripts``: session_id, text; ``lists``: session_id, list, item_id,
    text (see ``export.items``); ``gold``: session_id and the gold columns. A list absent from the gold
    document (NULL) is not scored."""
    out = gold.select("session_id")
    both = gold.where("transcript IS NOT NULL").select("session_id", F.col("transcript").alias("ref")).join(
        transcripts.select("session_id", F.col("text").alias("hyp")), "session_id", "left").na.fill("", ["hyp"])
    out = out.join(wer(both).select("session_id", F.round("wer", 4).alias("wer")), "session_id", "left")
    for name, threshold in THRESHOLDS.items():
        wanted = gold.where(F.col(name).isNotNull())
        g = wanted.select("session_id", F.posexplode(name).alias("no", "text"))
        mine = lists.where(F.col("list") == name).select("session_id", F.col("item_id").alias("no"), "text")
        scored = prf(mine.join(wanted.select("session_id"), "session_id", "left_semi"), g, threshold)
        missing = wanted.select("session_id", F.lit(1.0).alias("one"))
        cols = [F.coalesce(c, "one").alias(f"{name}_{c}") for c in ("precision", "recall", "f1")]
        out = out.join(missing.join(scored, "session_id", "left").select("session_id", *cols), "session_id", "left")
    told = lists.where(F.col("list").isin("window_summaries", "rolling_summaries", "recap")).groupBy("session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("list", "item_id", "text"))), lambda e: e["text"]), "\n").alias("text"))
    asked = gold.where("summary_facts IS NOT NULL")
    facts = asked.select("session_id", F.explode("summary_facts").alias("fact"))
    texts = asked.select("session_id").join(told, "session_id", "left").na.fill("", ["text"])
    out = out.join(fact_recall(texts, facts).withColumnRenamed("fact_recall", "summary_fact_recall"), "session_id", "left")
    dup = duplicate_rate(lists.where("list = 'entities'").select("session_id", F.col("text").alias("name")), ["session_id"])
    return out.join(dup.select("session_id", F.round("duplicate_rate", 4).alias("entity_duplicate_rate")), "session_id", "left").na.fill(0.0, ["entity_duplicate_rate"])


def ab(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Compare two classifiers on the same rows: agreement per field and mean latency."""
    left = a.select(key, *[F.col(f).alias(f"{f}_a") for f in fields], F.col("latency_ms").alias("ms_a"))
    right = b.select(key, *[F.col(f).alias(f"{f}_b") for f in fields], F.col("latency_ms").alias("ms_b"))
    same = [F.avg(F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b")).cast("double")).alias(f"{f}_agreement") for f in fields]
    return left.join(right, key).agg(F.count(F.lit(1)).alias("rows"), *same, F.avg("ms_a").alias("mean_ms_a"), F.avg("ms_b").alias("mean_ms_b"))
