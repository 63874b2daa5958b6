"""Sentence features, weak labels, training set and min-max scaler (M1-M6, M9).

Features per sentence (M1): max-scaled TF-IDF (F7), max-scaled TextRank (G5),
position (N5), length in words (N3), length / mean length (N4).

Weak label (M2): 1 when ROUGE-1 F of the sentence against the document's
reference summary is > 0.3.  Computed for all sentences of a document at once,
in an Arrow UDF next to the sentence split, so it needs no shuffle and no join
with the features.

Scaler (M5/M6): min/max per feature over all sentences in one aggregation;
the fitted scaler is 5 x 5 numbers, so it is applied as literals (constant
folded into the projection), never joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from precis import config as C
from precis.functions.text import normalize_ws
from precis.functions.stem import rouge_1_of_sentences
from precis.functions.tokens import rouge_tokens
from precis.operators import sentences as N
from precis.operators.sentences import CARRY
from precis.operators.textrank import textrank_scores

FEATURES = ("tfidf", "textrank", "position", "length", "norm_length")


def sentence_features(sent: DataFrame, id_col: str = "doc_id", settings: C.Settings = C.DEFAULT,
                      carry_text: bool = False, plain=(), also=()) -> DataFrame:
    """M1: (id, sent_idx, n_sent, tfidf, textrank, position, length, norm_length[, sentence]).

    One branch: the shared term stream computes the max-scaled TF-IDF score
    and the mean sentence length by windows, the TextRank kernel hands them
    through next to the max-scaled TextRank it computes, and position and
    normalised length are row arithmetic on its output.  With ``carry_text``
    (outer sentence table) the text rides along and empty documents keep one
    row of zeros.
    """
    from precis.operators.tfidf import scoring_stream

    stream = scoring_stream(sent, id_col, settings, min_sent=1, features=True)
    # values that were computed for each sentence: its label's ROUGE-1, the TextRank of a user's vectors
    given = [c for c in ("rouge_1", "given_rank") if c in stream.columns]
    k = textrank_scores(stream, id_col, settings.damping, settings.tol, settings.max_iter, carry_text=carry_text,
                        passthrough=("tfidf_h", "n_words", "mean_len", *plain, *given), also=also)
    rank = F.col("textrank_feature")
    if "given_rank" in given:
        k = N.hash_partition(k, id_col)  # the kernel's rows have no partitioning
        most = F.max("given_rank").over(Window.partitionBy(id_col))
        rank = F.when(most > 0, F.col("given_rank") / most).otherwise(F.col("given_rank"))
    pos = F.col("sent_idx") / F.greatest(F.col("n_sent") - 1, F.lit(1))
    norm = F.col("n_words") / F.greatest(F.col("mean_len"), F.lit(1.0))
    return k.select(
        id_col,
        "sent_idx",
        "n_sent",
        F.coalesce(F.col("tfidf_h"), F.lit(0.0)).alias("tfidf"),
        F.coalesce(rank, F.lit(0.0)).alias("textrank"),
        F.coalesce(pos, F.lit(0.0)).alias("position"),
        F.coalesce(F.col("n_words"), F.lit(0.0)).alias("length"),
        F.coalesce(norm, F.lit(0.0)).alias("norm_length"),
        *(["rouge_1"] if "rouge_1" in given else []),
        *also,
        *[F.col("tfidf").alias("plain_tfidf"), F.col("textrank").alias("plain_textrank")][:2 * len(plain)],
        *(["sentence"] if carry_text else []),
        *([CARRY] if CARRY in k.columns else []),
    )


def sentence_rouge_1(summary, sentences_col: str = "sentences"):
    """ROUGE-1 F of every sentence against the reference summary, array<double>."""
    return rouge_1_of_sentences(F.transform(sentences_col, lambda s: rouge_tokens(s)), rouge_tokens(summary))


def weak_labels(docs: DataFrame, id_col: str = "doc_id", summary_col: str = "highlights",
                threshold: float = C.DEFAULT.label_threshold) -> DataFrame:
    """M2: (id, sent_idx, rouge_1, label) for every sentence of every document.

    ``docs`` carries (id, sentences, summary_col); row-local.
    """
    s = docs.select(id_col, F.posexplode(sentence_rouge_1(summary_col)).alias("sent_idx", "rouge_1"))
    return s.withColumn("label", (F.col("rouge_1") > threshold).cast("double"))


def training_set(pairs: DataFrame, id_col: str = "doc_id", text_col: str = "article",
                 summary_col: str = "highlights", settings: C.Settings = C.DEFAULT) -> DataFrame:
    """M3: (id, sent_idx, n_sent, features, rouge_1, label) of every sentence of every usable pair.

    Blank articles or summaries are skipped (the original skips them too); there is no
    per-row failure path to skip, so every other row is kept, whatever its id.  One
    branch: a sentence's ROUGE-1 is computed with the split and rides along to the label.
    """
    usable = pairs.filter(
        (normalize_ws(text_col) != "") & (normalize_ws(summary_col) != "")
    )
    docs = N.keyed_documents(usable, text_col, (id_col,), [("_reference", F.col(summary_col))])
    docs = docs.withColumn("rouge_1", sentence_rouge_1("_reference")).withColumn("_id", F.col(f"{N.CARRY}.`{id_col}`")).drop(N.CARRY)
    sent = N.sentence_table(docs, N.ROW, more=("rouge_1",), also=("_id",))
    feats = sentence_features(sent, N.ROW, settings, also=("_id",))
    return feats.select(
        F.col("_id").alias(id_col), "sent_idx", "n_sent", *FEATURES, "rouge_1",
        (F.col("rouge_1") > settings.label_threshold).cast("double").alias("label"))


def class_balance(ts: DataFrame) -> DataFrame:
    """M4: total, positives, negatives and positive percentage."""
    return ts.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("label").cast("bigint").alias("positives"),
        (F.count(F.lit(1)) - F.sum("label")).cast("bigint").alias("negatives"),
        (F.avg("label") * 100.0).alias("positive_pct"),
    )


def fit_scaler(ts: DataFrame, features=FEATURES) -> dict:
    """M5: per-feature min/max over all rows (one aggregation, 10 numbers).

    A constant feature (range 0) gets scale 1, so it maps to 0, not 0.5.
    """
    row = ts.agg(*[F.min(c).alias(f"min_{c}") for c in features], *[F.max(c).alias(f"max_{c}") for c in features]).first()
    if row is None or row[f"min_{features[0]}"] is None:
        raise ValueError("a scaler cannot be fitted without rows")
    dmin = [float(row[f"min_{c}"]) for c in features]
    dmax = [float(row[f"max_{c}"]) for c in features]
    rng = [b - a for a, b in zip(dmin, dmax)]
    scale = [1.0 / (r if r != 0 else 1.0) for r in rng]
    mins = [-a * s + 0.0 for a, s in zip(dmin, scale)]
    return {"data_min": dmin, "data_max": dmax, "data_range": rng, "scale": scale, "min": mins,
            "n_features_in": len(features)}


def scaler_table(ts: DataFrame, features=FEATURES) -> DataFrame:
    """M5 as a DataFrame: one row per feature (feature, data_min, ...)."""
    aggs = []
    for c in features:
        aggs += [F.min(c).alias(f"mn_{c}"), F.max(c).alias(f"mx_{c}")]
    wide = ts.agg(*aggs)
    rows = [
        F.struct(F.lit(c).alias("feature"), F.col(f"mn_{c}").alias("data_min"), F.col(f"mx_{c}").alias("data_max"))
        for c in features
    ]
    long = wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    rng = F.col("data_max") - F.col("data_min")
    scale = F.lit(1.0) / F.when(rng == 0, F.lit(1.0)).otherwise(rng)
    # + 0.0 turns -0.0 (data_min 0) into 0.0
    return long.withColumn("data_range", rng).withColumn("scale", scale).withColumn(
        "min", -F.col("data_min") * F.col("scale") + F.lit(0.0)
    )


def apply_scaler(df: DataFrame, scaler: dict, features=FEATURES) -> DataFrame:
    """M6: x * scale + min, no clipping; the scaler's numbers are literals."""
    out = df
    for i, c in enumerate(features):
        out = out.withColumn(c, F.col(c) * F.lit(float(scaler["scale"][i])) + F.lit(float(scaler["min"][i])))
    return out


def fit_transform(ts: DataFrame, features=FEATURES) -> DataFrame:
    """M5 + M6 in one plan: min/max over all rows as a scalar subquery, applied to every row.

    Nothing runs before the result is asked for, and nothing is cached.  An empty table
    gives no rows.
    """
    low = ts.agg(F.struct(*[F.min(c).alias(c) for c in features]).alias("low"), F.struct(*[F.max(c).alias(c) for c in features]).alias("high"))
    s = low.select(F.struct("low", "high")).scalar()
    out = ts
    for c in features:
        mn, mx = s["low"][c], s["high"][c]
        scale = F.lit(1.0) / F.when(mx - mn == 0, F.lit(1.0)).otherwise(mx - mn)
        out = out.withColumn(c, F.col(c) * scale - mn * scale + F.lit(0.0))
    return out


def split_bucket(id_col: str = "doc_id") -> F.Column:
    """M9: a stable bucket 0..65535 from md5 of the id (same in SQL engines)."""
    return F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 4), 16, 10).cast("int")


def train_val_split(ts: DataFrame, fraction: float = C.DEFAULT.validation_split, id_col: str = "doc_id") -> DataFrame:
    """M9: whole documents go to one side: ``is_val`` by md5 bucket of the id."""
    return ts.withColumn("is_val", split_bucket(id_col) < int(round(fraction * 65536)))
