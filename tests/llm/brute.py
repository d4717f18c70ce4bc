"""Plain versions of the operators for small tables, written from their definitions."""

import collections
import hashlib
import math
import random
import re

WORDS = "the and of alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "s", "x", "ed", str(r.randrange(40))]) for _ in range(n))


def corpus():
    """Copies, near copies, passages, blanks, NULLs, ties and one long text."""
    r = random.Random(5)
    texts = [prose(k, r.choice([3, 8, 60, 120, 300])) for k in range(60)]
    for k in range(12):  # near copies: a few words changed, some just above and some below the bound
        w = prose(1000 + k % 3, 150).split()
        for _ in range(r.choice([1, 2, 3, 5, 6])):
            w[r.randrange(len(w))] = f"changed{r.random()}"
        texts.append(" ".join(w))
    texts += [texts[10]] * 5 + [texts[11].upper()] * 3
    passage = prose(77, 70)
    texts += [prose(2000 + k, 40) + " " + passage for k in range(10)]
    texts += [None, "", " \n\t ", "one", "one", "two words", " ", "é́ ﬁ", prose(9, 30_000)]
    texts += ["### $$$ ||| " * 40, "same line\n" * 60, "spam " * 200, "password = hunter22; token:abc"]
    sources = ["a", "b", "c", "d", None, "é", "Z"]
    rows = [(k, t, r.choice(["en", "de", None]), "a" if k % 3 == 0 else r.choice(sources), len(t or "")) for k, t in enumerate(texts)]
    rows += [(None, "text without an id " * 20, "en", "b", 1), (None, None, None, None, None), rows[2], rows[2], (3, prose(3, 60) + " other", "en", "a", 7)]
    return rows


def words(text, lower=False):
    t = text or ""
    if lower:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    return [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", t) if w]


def shingles(text):
    w = words(text, lower=True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def components(rows):
    """Per row (n_shingles, smallest id reachable)."""
    sets = [shingles(r[1]) for r in rows]
    at = list(range(len(rows)))

    def top(v):
        while at[v] != v:
            v = at[v]
        return v

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                at[top(i)] = top(j)
    ids = collections.defaultdict(list)
    for i, r in enumerate(rows):
        ids[top(i)].append(r[0])
    low = {k: min([x for x in v if x is not None], default=None) for k, v in ids.items()}
    return [(len(sets[i]), low[top(i)]) for i in range(len(rows))], [top(i) for i in range(len(rows))]


def leaks(rows, items):
    """(row's place, item's place, item shingles, shared) of the pairs of 80 % and more."""
    out = set()
    for d, (_, t, *_) in enumerate(rows):
        s = shingles(t)
        w = f" {' '.join(words(t, lower=True))} "
        for i, (_, x) in enumerate(items):
            q = shingles(x)
            short = 0 < len(words(x or "")) < 5
            shared = sum(f" {' '.join(z)} " in w for z in q) if short else len(s & q)
            if q and 100 * shared >= 80 * len(q):
                out.add((d, i, len(q), shared))
    return out


def base_counts(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
    )


def em(votes, rounds=50):
    """Posterior per document from a list of vote tuples, document by document."""
    if not votes:
        return []
    k = len(votes[0])
    p = [1 / (1 + math.exp(-2 * sum(v))) for v in votes]
    for _ in range(rounds):
        good, bad = 1 + sum(p), 1 + sum(1 - x for x in p)
        table = []
        for j in range(k):
            a = [1 + sum(x for x, v in zip(p, votes, strict=True) if v[j] == o) for o in (-1, 0, 1)]
            b = [1 + sum(1 - x for x, v in zip(p, votes, strict=True) if v[j] == o) for o in (-1, 0, 1)]
            table.append([math.log(a[o] / sum(a) / (b[o] / sum(b))) for o in range(3)])
        p = [1 / (1 + math.exp(-(math.log(good / bad) + sum(table[j][v[j] + 1] for j in range(k))))) for v in votes]
    return p


def targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        out = {s: most * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in order if x not in full) for s in order}
        over = {s for s in order if s not in full and out[s] > most * sizes[s]}
        if not over:
            return out
        full |= over


def mix(rows):
    """Copies per row."""
    h = lambda d: int(hashlib.md5(f"mix:{'' if d is None else d}".encode()).hexdigest()[:15], 16)
    size = [len(words(r[1])) for r in rows]
    total = collections.Counter()
    for r, n in zip(rows, size, strict=True):
        total[r[3]] += n
    goal, cut = targets(total), {}
    for s, n in total.items():
        passes = math.floor(goal[s] / n) if n else 0
        rest, run, upto = goal[s] - passes * n, 0, 0
        by = collections.Counter()
        for r, k in zip(rows, size, strict=True):
            if r[3] == s and k:
                by[h(r[0])] += k
        for x in sorted(by):
            if run + by[x] <= rest:
                run, upto = run + by[x], x + 1
            else:
                upto = x + (run + by[x] - rest < rest - run)
                break
        cut[s] = (passes, upto)
    return [cut[r[3]][0] + (h(r[0]) < cut[r[3]][1]) for r in rows], size, total, goal
