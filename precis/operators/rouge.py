"""ROUGE-1 / ROUGE-2 / ROUGE-L.

A pairs table ``(id, [model,] reference, prediction)`` is tokenised (E1),
stemmed (E2, each distinct token of an Arrow batch once) and scored:

* ROUGE-N: one ``explode`` of a combined array of reference and prediction
  n-grams (tagged by side), a hash aggregate per (pair, n, n-gram) for the two
  counts, and one per (pair, n) for the clipped overlap.  Every key starts
  with the pair key, so after one ``repartition`` on it nothing else shuffles;
  hot n-grams ("the") are spread over all pairs, never one group.
* ROUGE-L: the longest common subsequence of two token arrays, with the
  bit-parallel algorithm (Allison & Dix 1986, Hyyrö 2004) in an Arrow-batched
  pandas UDF: one machine word per 64 tokens instead of an n x m table.

P = overlap / |prediction|, R = overlap / |reference|, F = 2PR / (P + R),
0 when there is no overlap (empty sides included).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from precis.functions.stem import stem_arrays
from precis.functions.tokens import rouge_tokens


def stemmed_tokens(df: DataFrame, col: str, out: str) -> DataFrame:
    """E1 + E2: ``out`` = stemmed ROUGE tokens of ``col``."""
    return df.withColumn(out, stem_arrays(rouge_tokens(col)))


def bigrams(tokens: Column) -> Column:
    return F.when(
        F.size(tokens) >= 2,
        F.transform(
            F.sequence(F.lit(1), F.size(tokens) - 1),
            lambda i: F.concat(F.element_at(tokens, i), F.lit(" "), F.element_at(tokens, i + 1)),
        ),
    ).otherwise(F.array().cast("array<string>"))


def ngrams(tokens: Column, n: int) -> Column:
    return tokens if n == 1 else bigrams(tokens)


def f_measure(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def rouge_n(pairs: DataFrame, keys, ref_tokens: str = "ref_t", pred_tokens: str = "pred_t", ns=(1, 2),
            carry=()) -> DataFrame:
    """E3-E4, wide: per pair, for each n: rouge_{n}_overlap/_p/_r/_f.

    Side counts are per-row sizes carried as (functionally dependent) grouping
    keys, so no join is needed to bring them back.
    """
    keys = list(keys)
    def tag(n, r, p):
        return lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"), F.lit(r).alias("r"), F.lit(p).alias("p"))

    tagged = [
        F.transform(ngrams(F.col(g_col), n), tag(n, r, p))
        for n in ns
        for g_col, r, p in ((ref_tokens, 1, 0), (pred_tokens, 0, 1))
    ]
    def count(c, n):  # n-grams of an array of size s: max(s - n + 1, 0)
        return F.greatest(F.size(F.col(c)) - (n - 1), F.lit(0))

    counts = [count(c, n).alias(f"{side}{n}") for n in ns for side, c in (("rc", ref_tokens), ("pc", pred_tokens))]
    cnames = [f"{side}{n}" for n in ns for side in ("rc", "pc")] + list(carry)
    # per-pair counts are projected before the explode, so they are computed
    # once per pair, not once per exploded n-gram row
    per_pair = pairs.select(*keys, *counts, *carry, ref_tokens, pred_tokens)
    base = per_pair.select(*keys, *cnames, F.explode_outer(F.concat(*tagged)).alias("x"))
    per_gram = base.groupBy(*keys, *cnames, F.col("x.n").alias("n"), F.col("x.g").alias("g")).agg(
        F.sum("x.r").alias("cr"), F.sum("x.p").alias("cp")
    )
    ov = per_gram.groupBy(*keys, *cnames).agg(
        *[F.sum(F.when(F.col("n") == n, F.least("cr", "cp")).otherwise(0)).alias(f"ov{n}") for n in ns]
    )
    cols = []
    for n in ns:
        o, rc, pc = F.col(f"ov{n}"), F.col(f"rc{n}"), F.col(f"pc{n}")
        p = F.when(pc > 0, o / pc).otherwise(F.lit(0.0))
        r = F.when(rc > 0, o / rc).otherwise(F.lit(0.0))
        cols += [o.alias(f"rouge_{n}_overlap"), p.alias(f"rouge_{n}_p"), r.alias(f"rouge_{n}_r"),
                 f_measure(p, r).alias(f"rouge_{n}_f")]
    return ov.select(*keys, *cols, *[c for c in cnames if c.startswith(("rc1", "pc1"))], *carry)


def _lcs_len(a, b) -> int:
    """Bit-parallel LCS length of two token sequences."""
    if len(a) == 0 or len(b) == 0:
        return 0
    masks: dict = {}
    for i, tok in enumerate(a):
        masks[tok] = masks.get(tok, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for tok in b:
        u = v & masks.get(tok, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


@F.pandas_udf(LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """E5 kernel: LCS length per row (Arrow batches)."""
    return pd.Series([_lcs_len(x if x is not None else [], y if y is not None else []) for x, y in zip(a, b)])


def rouge_l_from(lcs: Column, ref_len: Column, pred_len: Column):
    """E5: P, R, F of ROUGE-L from the LCS length and the token counts."""
    ok = (pred_len > 0) & (ref_len > 0)
    p = F.when(ok, lcs / pred_len).otherwise(F.lit(0.0))
    r = F.when(ok, lcs / ref_len).otherwise(F.lit(0.0))
    return p, r, f_measure(p, r)


def score_token_pairs(toks: DataFrame, keys, ref_tokens: str = "ref_t", pred_tokens: str = "pred_t") -> DataFrame:
    """ROUGE-1/2/L of pairs of (stemmed) token arrays, in one branch.

    The LCS (Arrow UDF) is computed per pair and rides through the n-gram
    aggregation as a grouping key, so there is no join and no second pass
    over the tokens.  The UDF drops the partitioning, so the aggregation's
    own exchange follows — after the map-side partial aggregate, which is
    cheaper than re-shuffling the token arrays.
    """
    keys = list(keys)
    t = toks.select(*keys, ref_tokens, pred_tokens, lcs_length(F.col(ref_tokens), F.col(pred_tokens)).alias("lcs"))
    wide = rouge_n(t, keys, ref_tokens, pred_tokens, carry=("lcs",))
    lp, lr, lf = rouge_l_from(F.col("lcs"), F.col("rc1"), F.col("pc1"))
    return wide.select(
        *keys,
        F.col("rouge_1_f").alias("rouge_1"),
        F.col("rouge_2_f").alias("rouge_2"),
        lf.alias("rouge_l"),
        "rouge_1_p", "rouge_1_r", "rouge_2_p", "rouge_2_r",
        lp.alias("rouge_l_p"), lr.alias("rouge_l_r"),
    )


def rouge_scores(df: DataFrame, keys, ref_col: str = "highlights", pred_col: str = "prediction") -> DataFrame:
    """Per pair: rouge_1, rouge_2, rouge_l F-measures (plus P/R of each)."""
    from precis.operators.sentences import hash_partition

    keys = list(keys)
    # spread the pairs before the CPU-heavy stemming and LCS (an explicit
    # partition count: AQE would coalesce a small shuffle onto one core)
    p = stemmed_tokens(hash_partition(df.select(*keys, ref_col, pred_col), keys[0]), ref_col, "ref_t")
    p = stemmed_tokens(p, pred_col, "pred_t")
    return score_token_pairs(p, keys)


def evaluate_model(df: DataFrame, pred_col: str, ref_col: str = "highlights", id_col: str = "doc_id",
                   sample_size: int | None = None, seed: int = 42) -> DataFrame:
    """Mean ROUGE-1/2/L F over a corpus (optionally an exact-n sample)."""
    if sample_size:
        from precis.operators.corpus import sample_n

        df = sample_n(df, sample_size, seed, id_col, strict=True)
    s = rouge_scores(df, [id_col], ref_col, pred_col)
    return s.agg(F.avg("rouge_1").alias("rouge_1"), F.avg("rouge_2").alias("rouge_2"), F.avg("rouge_l").alias("rouge_l"))


def compare_models(df: DataFrame, model_predictions: dict, ref_col: str = "highlights", id_col: str = "doc_id",
                   sample_size: int | None = None, seed: int = 42) -> DataFrame:
    """One sample, every model scored in one pass, one row per model.

    The prediction columns are unpivoted (``stack``) so all models share one
    tokenisation/aggregation plan keyed by (id, model).
    """
    if sample_size:
        from precis.operators.corpus import sample_n

        df = sample_n(df, sample_size, seed, id_col, strict=True)
    names = list(model_predictions)
    stack = "stack({}, {}) as (model, prediction)".format(
        len(names), ", ".join(f"'{m}', `{c}`" for m, c in model_predictions.items())
    )
    from precis.operators.sentences import hash_partition

    # the reference is tokenised and stemmed once, before the unpivot; the
    # pairs are spread by id first (see rouge_scores)
    wide = hash_partition(df.select(id_col, ref_col, *model_predictions.values()), id_col)
    ref = stemmed_tokens(wide, ref_col, "ref_t")
    long = stemmed_tokens(ref.select(id_col, "ref_t", F.expr(stack)), "prediction", "pred_t")
    s = score_token_pairs(long, [id_col, "model"])
    return s.groupBy("model").agg(
        F.avg("rouge_1").alias("rouge_1"), F.avg("rouge_2").alias("rouge_2"), F.avg("rouge_l").alias("rouge_l")
    )
