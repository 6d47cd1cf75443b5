"""Token counts by a Viterbi pass that carries only the best score and the number of pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_pandas, require, result_columns, schema_with
from .pieces import MODEL, Remembered, broadcast, solved, vocabulary


def count_tokens(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """docs plus n_tokens and best_score: pieces and score of the best unigram segmentation of each whole text.

    Row by row, no shuffle; parts of a text that come again are looked up. Null and empty texts: 0 and 0.0. Repeated rows give
    equal results, an empty table an empty one; names that clash get a suffix.
    """
    require(docs, text)
    names = result_columns(docs, "n_tokens", "best_score")
    held = broadcast(docs, model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(held)
        known = Remembered(lambda parts: solved(v, parts))
        for b in batches:
            scores, counts = [], []
            for found in known.of([v.parts(t or "") for t in b[text]]):
                scores.append(float(sum([f[0] for f in found])))
                counts.append(sum([f[1] for f in found]))
            yield b.assign(**{names[0]: counts, names[1]: scores})

    return in_pandas(docs, count, schema_with(docs, (names[0], T.LongType()), (names[1], T.DoubleType())))
