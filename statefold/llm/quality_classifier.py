"""Quality classifier: histogram gradient-boosted trees over document statistics.

Cases: null and empty texts have the statistics of an empty text and get a score; a null id is scored and never
learned from; repeated rows are scored each; without labels every score is 0.5; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statefold.llm import boosted_trees
from statefold.llm.common import held_out, kept_texts, labelled_documents, map_texts, scored_texts
from statefold.llm.textstats import FEATURES, features

#: Labelled documents that a model is fitted on, at most; they are chosen by a hash of the id.
TRAIN_ROWS = 20_000
#: Least score of a good document.
THRESHOLD = 0.3


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``stats``, the document statistics named in FEATURES."""

    def make():
        return lambda part, data, offsets: {"stats": list(features(data, offsets))}

    return map_texts(docs, make, "stats array<float>", keep)


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS, **options) -> boosted_trees.Forest:
    """Trees for ``labels.quality``, from rows outside fold 0 of 5; the driver gets ``bound`` rows of statistics at most."""
    rows = statistics(labelled_documents(docs, labels, "quality", bound), ("doc_id", "y")).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows.stats.tolist(), np.float32).reshape(len(rows), len(FEATURES))
    return boosted_trees.fit(x, rows.y.to_numpy(np.float64), **options)


def scorer(docs: DataFrame, model: boosted_trees.Forest):
    """What a task needs to score slices of texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # trees x 2**(depth + 1) numbers

    def make():
        forest = shared.value
        return lambda data, offsets: forest.probability(features(data, offsets))

    return make


def score(docs: DataFrame, model: boosted_trees.Forest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    out = scored_texts(docs, scorer(docs, model), threshold)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: boosted_trees.Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with all their columns."""
    return kept_texts(docs, scorer(docs, model), lambda p: p >= threshold)
