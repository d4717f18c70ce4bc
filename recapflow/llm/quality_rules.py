"""Quality by weak supervision: rules vote good, bad or abstain; expectation-maximisation estimates how reliable each
rule is; the posterior probability of good quality decides, instead of a demand that every rule pass.

The documents are read once for their features. A document's votes form one of at most ``3 ** len(RULES)`` patterns,
so EM runs over the pattern counts of the whole corpus, a table whose size the rules bound, whatever the corpus size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recapflow.llm import common

#: Symbols counted by the base rule, and characters that words of prose in any script do without.
SYMBOLS = "#*$%&|<>"
PUNCTUATION = "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"
ODD = r"[#$%&*+<=>@\\^_`{|}~]"
LETTER = r"\p{L}"

#: Thresholds of the votes: rule -> (feature, good when at most, bad when more than); between them it abstains.
RULES = {
    "symbols": ("symbol_share", 0.02, 0.1),
    "punctuation": ("punct_share", 0.12, 0.25),
    "dup_lines": ("dup_line_share", 0.05, 0.3),
    "repeats": ("repeat_share", 0.15, 0.35),
    "word_length": ("length_gap", 3.0, 5.0),
    "odd_words": ("odd_word_share", 0.1, 0.25),
}
KEEP_AT = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _repeat_words(h: Column) -> Column:
    """Words inside a 3-word window that occurs at least twice; ``h`` holds the hash of the window at each place."""
    def flagged(s: Column) -> Column:
        same = lambda k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.filter(s, lambda x, k: same(k - 1, x) | same(k + 1, x))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("int").alias("last"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    places = F.array_sort(F.transform(common.let(placed, flagged), lambda x: x["i"]))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), covered(places)).otherwise(F.lit(0).cast("long"))


def features(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """Counts of each text beside the ``keep`` columns; a NULL text counts as empty. Odd words have no letter or hold a
    symbol of ODD; letters of any script and either case count alike, so no language needs a word list."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(common.SPACE)) != "")
    without = lambda chars: F.length(F.translate(t, chars, ""))
    base = docs.select(
        *keep,
        common.words(t).alias("__w"),
        lines.alias("__lines"),
        without(common.SPACE).cast("long").alias("word_chars"),
        (F.length(t) - without(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(t) - without(PUNCTUATION)).cast("long").alias("__n_punct"),
    )
    w = F.col("__w")
    odd = F.filter(w, lambda x: ~x.rlike(LETTER) | x.rlike(ODD))
    window = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )
    kept = [c for c in base.columns if c not in ("__w", "__lines")]
    counted = base.select(
        *kept,
        F.size(w).cast("long").alias("n_words"),
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(odd).cast("long").alias("__n_odd"),
        F.when(F.size(w) >= 3, window).otherwise(F.array().cast("array<bigint>")).alias("__h"),
    )
    return common.computed(counted.withColumn("n_repeat_words", _repeat_words(F.col("__h"))).drop("__h"))


def votes() -> dict[str, Column]:
    """1 good, -1 bad, 0 abstain, per rule; texts without words get bad votes."""
    n, share = F.col("n_words"), lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    measures = {
        "symbol_share": share("n_symbols", "n_words"),
        "punct_share": share("__n_punct", "word_chars"),
        "dup_line_share": share("n_dup_lines", "__n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "length_gap": F.abs(share("word_chars", "n_words") - 6.0),
        "odd_word_share": share("__n_odd", "n_words"),
    }
    out = {}
    for rule, (measure, good, bad) in RULES.items():
        m = measures[measure]
        out[rule] = F.when(n == 0, -1).when(m > bad, -1).when(m <= good, 1).otherwise(0).cast("int")
    return out


@dataclass(frozen=True)
class Reliability:
    """Log-odds that the corpus and each rule's vote (bad, abstain, good) add towards good quality."""

    prior: float
    weight: dict[str, tuple[float, float, float]]

    def posterior(self) -> Column:
        odds = F.lit(self.prior)
        for rule, (bad, none, good) in self.weight.items():
            v = F.col(f"vote_{rule}")
            odds = odds + F.when(v == -1, bad).when(v == 1, good).otherwise(none)
        return 1 / (1 + F.exp(-odds))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> Reliability:
    """EM over (votes, count) patterns, started from the majority of votes. The probability of each vote given good
    or bad quality is smoothed by one document each, so empty input and unanimous rules are defined; the result
    depends on the counts alone, and patterns are summed in one fixed order."""
    names = list(RULES)
    patterns = sorted(patterns)
    soft = [1 / (1 + math.exp(-2.0 * sum(v))) for v, _ in patterns]
    prior, given = 0.0, {r: [[1 / 3] * 3, [1 / 3] * 3] for r in names}
    for _ in range(rounds):
        mass = [1.0, 1.0]
        seen = [[[1.0] * 3, [1.0] * 3] for _ in names]
        for (v, n), p in zip(patterns, soft, strict=True):
            for c, q in ((1, p), (0, 1 - p)):
                mass[c] += n * q
                for j, x in enumerate(v):
                    seen[j][c][x + 1] += n * q
        prior = math.log(mass[1] / mass[0])
        for j, r in enumerate(names):
            given[r] = [[x / sum(seen[j][c]) for x in seen[j][c]] for c in (0, 1)]
        soft = []
        for v, _ in patterns:
            odds = prior + sum(math.log(given[r][1][x + 1] / given[r][0][x + 1]) for r, x in zip(names, v, strict=True))
            soft.append(1 / (1 + math.exp(-max(-700.0, min(700.0, odds)))))
    return Reliability(prior, {r: tuple(math.log(g[1][k] / g[0][k]) for k in range(3)) for r, g in given.items()})


def _voted(docs: DataFrame, keep: list[Column], text: str) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return features(docs, keep, text).withColumns({f"vote_{r}": v for r, v in votes().items()}).withColumn("base_failed", failed)


def learn(voted: DataFrame) -> Reliability:
    names = [f"vote_{r}" for r in RULES]
    return estimate([(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).count().collect()])


def _verdict(voted: DataFrame, rules: Reliability) -> DataFrame:
    return voted.withColumn("p_quality", rules.posterior()).withColumn("kept", ~F.col("base_failed") & (F.col("p_quality") >= KEEP_AT))


def score(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_words, the base counts, votes, ``p_quality``, ``base_failed`` and ``kept``.

    NULL, empty and blank texts have no words, get bad votes and fail the base rules; repeated rows are scored each,
    with equal results; other columns of ``docs`` are not read. An empty table gives an empty table."""
    voted = common.settled(_voted(docs, [F.col(id)], text))
    out = _verdict(voted, learn(voted))
    return out.select(
        id, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("p_quality", 6).alias("p_quality"), *[f"vote_{r}" for r in RULES],
    )


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that ``score`` keeps, with all their columns. Texts are read once: votes are written to the shared
    folder beside the rows that pass the base rules, and the verdict filters what was written, without a shuffle."""
    row = docs.select(F.struct("*").alias("__row")).withColumn("__text", F.col("__row")[text])
    names = [f"vote_{r}" for r in RULES]
    voted = _voted(row, [F.col("__row")], "__text")
    voted = common.written(voted.select(F.when(~F.col("base_failed"), F.col("__row")).alias("row"), "base_failed", *names))
    return _verdict(voted, learn(voted)).where("kept").select("row.*")
