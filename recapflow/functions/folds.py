"""Order-dependent folds over sorted partitions with bounded memory.

Rows of one key are shuffled to one partition, sorted there and streamed through a small Python state,
Arrow batch by Arrow batch; no group is ever collected. Used only where each step depends on the
state left by the step before."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fold_sorted(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable[[], object], schema: str
) -> DataFrame:
    """``step()`` makes a state object with ``feed(rows) -> list of tuples`` (rows of one key in order, a list
    of values per column, possibly called several times) and ``finish() -> list of tuples`` when the key ends."""
    names = T.StructType.fromDDL(schema).names
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            if pdf.empty:
                continue
            out: list[tuple] = []
            change = pdf[keys].ne(pdf[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
            starts = sorted({0, *change})
            columns = {c: pdf[c].tolist() for c in pdf.columns}
            for lo, hi in zip(starts, [*starts[1:], len(pdf)]):
                key = tuple(columns[k][lo] for k in keys)
                if key != current:
                    if state is not None:
                        out.extend(state.finish())
                    current, state = key, step()
                out.extend(state.feed({c: v[lo:hi] for c, v in columns.items()}))
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame(state.finish(), columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)

