"""The state machines of weftline.operators.folds under Structured Streaming.

Each key keeps its pickled machine in the state store; a micro-batch brings rows of a key in some order, they are
sorted by event order inside the batch, and fed. With rows that arrive in order, stream and batch agree."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def streamed_fold(stream: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], machine: Callable, made: str, carried: Sequence[str] = ()) -> DataFrame:
    """The streaming twin of ordered_fold: the same arguments, on a stream."""
    kept = list(dict.fromkeys([*keys, *carried]))
    extra = StructType.fromDDL(made)
    out = StructType([stream.schema[c] for c in kept] + extra.fields)

    def feed(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(parts), ignore_index=True).sort_values(list(order), kind="stable")
        own = pickle.loads(state.get[0]) if state.exists else machine()
        results = [own.feed(*row) for row in whole[list(inputs)].itertuples(index=False, name=None)]
        state.update((pickle.dumps(own),))
        done = whole[kept].reset_index(drop=True)
        for i, f in enumerate(extra.fields):
            done[f.name] = pd.Series([r[i] for r in results], dtype=object)
        yield done

    return stream.groupBy(*keys).applyInPandasWithState(feed, out, "machine binary", "append", GroupStateTimeout.NoTimeout)
