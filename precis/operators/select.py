"""Top-k selection (K1, K5, K6).

``top_k`` ranks sentences inside each document; Spark plans the
``row_number() <= k`` filter as a per-group limit (WindowGroupLimit) before
the window, so at most k rows per document survive the sort.

Summary text is assembled by ``summarize.collect_summaries`` from the
selected rows, which carry their sentence text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from precis import config as C
from precis.operators.sentences import CARRY


def resolve_k(k) -> int:
    """K5: falsy k -> default 3; negative k is an error."""
    if k is None or k == 0:
        return C.DEFAULT.default_k
    k = int(k)
    if k < 0:
        raise ValueError(f"number of sentences must be positive, got {k}")
    return k


def rank_key(score_col: str = "score") -> list[Column]:
    """Highest score first; ties go to the later sentence; rounding makes the
    order independent of floating-point summation order."""
    return [F.round(F.col(score_col), 9).desc(), F.col("sent_idx").desc()]


def top_k(scores: DataFrame, k, id_col: str = "doc_id", score_col: str = "score") -> DataFrame:
    """K1: the k best sentences of every document, with their rank."""
    k = resolve_k(k)
    # a document's own row, which carries columns, takes no sentence's place
    own = [F.col("sent_idx").isNull()] if CARRY in scores.columns else []
    w = Window.partitionBy(id_col, *own).orderBy(*rank_key(score_col))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def lead_k(sentences_col: str, k) -> Column:
    """K6: the first k sentences."""
    return F.array_join(F.slice(F.col(sentences_col), 1, resolve_k(k)), " ")
