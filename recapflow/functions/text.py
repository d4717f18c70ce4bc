"""Text helpers as native column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the characters that count as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
ELLIPSIS = " … "

# Accepted roles of the streamer in an event.
ROLES = ("actor", "target", "witness", "informed", "ambient", "offscreen", "unknown")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def lower_strip(c: Column) -> Column:
    return F.lower(strip(c))


def tokens(c: Column) -> Column:
    """Split on runs of white space; empty array for blank text."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def approx_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("bigint")


def cap(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def _head_tail(text: Column, limit: int, head: int) -> Column:
    tail = limit - head - len(ELLIPSIS)
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(rstrip(F.left(text, F.lit(head))), F.lit(ELLIPSIS), lstrip(F.right(text, F.lit(tail))))
    )


def append_bounded(text: Column, delta: Column, limit: int = 2000, head: int = 400) -> Column:
    """Append, and when over the limit keep the original head and the newest tail."""
    joined = strip(F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.coalesce(delta, F.lit(""))))
    return _head_tail(joined, limit, head)


def snippet(text: Column, n: int) -> Column:
    """Head and tail of a long text."""
    return _head_tail(strip(F.coalesce(text, F.lit(""))), n, n // 3)


def bigram_diversity(c: Column) -> Column:
    """Distinct character bigrams / bigrams; one-character text counts as one bigram, empty text as 0.

    Counted on code-point arrays in Arrow batches: many times faster than arrays of two-letter strings."""
    return _diversity()(c)


def _diversity():
    def ratio(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            a = np.frombuffer(t.encode("utf-32-le"), dtype="<u4").astype("uint64")
            grams = (a[:-1] << np.uint64(32)) | a[1:] if len(a) > 1 else a
            out.append(len(np.unique(grams)) / len(grams) if len(grams) else 0.0)
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(ratio, T.DoubleType(), F.PandasUDFType.SCALAR)


def avg_logprob(probs: Column) -> Column:
    logs = F.transform(probs, lambda p: F.log(F.greatest(p.cast("double"), F.lit(1e-9))))
    total = F.aggregate(logs, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(probs) > 0, total / F.size(probs))


def norm_role(c: Column) -> Column:
    role = F.lower(strip(c))
    return F.when(role.isin(*ROLES), role).otherwise(F.lit("unknown"))


def fold_case(c: Column) -> Column:
    """Case folding as far as the corpus languages need it: lower case and sharp s."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def words(c: Column) -> Column:
    return F.regexp_extract_all(fold_case(c), F.lit(r"(?U)[\w']+"), F.lit(0))


def ieq(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def quote_regex(c: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def replace_ids(text: Column, names: Column) -> Column:
    """Replace whole-word ids by names; ``names`` is an ordered array of (id, name) and applied in order."""
    def one(acc: Column, e: Column) -> Column:
        pattern = F.concat(F.lit(r"(?U)(?<!\w)"), quote_regex(e["id"]), F.lit(r"(?!\w)"))
        name = F.replace(F.replace(e["name"], F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        return F.regexp_replace(acc, pattern, name)

    return F.when(names.isNull() | (F.size(names) == 0), text).otherwise(F.aggregate(names, text, one))


def strip_markdown_tail(c: Column) -> Column:
    """Everything before the first run of asterisks."""
    return strip(F.split(c, r"\*+").getItem(0))


def clean_bold(c: Column) -> Column:
    return F.replace(c, F.lit("**"), F.lit(""))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(tokens(c), 1, n), " ")


def lines(entries: Column, sep: str = "\n") -> Column:
    """Join the text of an array of (position..., line) structs in position order."""
    return F.array_join(F.transform(F.array_sort(entries), lambda e: e["line"]), sep)
