"""TF-IDF sentence scoring (F1-F8), one document at a time, for all documents.

Per document of n sentences (every sentence is a "document" of the vectoriser):

    tf[i,t]  = count of term t in sentence i
    df[t]    = sentences of this document that contain t
    keep t   iff  min_df <= df[t] <= max_df * n
    w[i,t]   = tf * (ln((1+n)/(1+df)) + 1)
    score_i  = sum_t w[i,t] / ||w[i,.]||_2 / (len_i + 1)

Plan shape: one ``explode`` of terms (narrow), a hash aggregate for tf, a
window for df, a hash aggregate per sentence (the L2 norm comes from
sum(w) / sqrt(sum(w^2)), no second window), and a window for the per-document
vocabulary status.  Every key starts with the document id, so on input
partitioned by it (``partition_by_doc``) there is no exchange at all.

Every sentence has a row of its own beside those of its terms, so it reaches the
score table: one without any term, or whose terms were all pruned, scores 0 instead
of vanishing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from precis import config as C
from precis.functions.tokens import is_stop_word, terms
from precis.operators.sentences import CARRY

SENT_KEYS = ("n_sent", "sent_idx", "n_words")
SENTENCE_VALUES = ("rouge_1", "given_rank", "_id")  # of each sentence, known before the terms are exploded


def riders(df: DataFrame) -> list[str]:
    """Columns that ride along with the sentences: values of each sentence, and what a document's own row carries."""
    return [c for c in (*SENTENCE_VALUES, CARRY) if c in df.columns]


def term_rows(sent: DataFrame, id_col: str = "doc_id", min_sent: int = 1, carry_text: bool = False) -> DataFrame:
    """F1 exploded: (id, n_sent, sent_idx, n_words, term[, sentence]).

    Every sentence contributes one extra sentinel row (term null) so that it
    survives every later aggregation; with ``carry_text`` the sentinel — and
    only the sentinel — carries the sentence text, so text is never repeated
    per term.  Terms are extracted only for documents with >= ``min_sent``
    sentences (the others need no score).  Stop words have no rows.
    """
    scored = (F.col("n_sent") >= min_sent) & F.col("sentence").isNotNull()
    none = F.array(F.lit(None).cast("string"))
    toks = F.concat(none, F.when(scored, terms("sentence")).otherwise(F.array().cast("array<string>")))
    own = F.col("_pos") == 0  # the sentinel
    t = sent.select(id_col, *SENT_KEYS, *riders(sent), *(["sentence"] if carry_text else []),
                    F.posexplode(toks).alias("_pos", "term")).where(own | ~is_stop_word("term"))
    cols = [id_col, *SENT_KEYS, *riders(sent), "term"]
    if carry_text:
        cols.append(F.when(own, F.col("sentence")).alias("sentence"))
    return t.select(*cols)


def term_freq(sent: DataFrame, id_col: str = "doc_id", min_sent: int = 1, carry_text: bool = False) -> DataFrame:
    """tf per (document, sentence, term); the null-term row has tf 0 (and
    the sentence text with ``carry_text``)."""
    # the text is a grouping key: only the sentinel row has it, so it is
    # hashed once per sentence and the aggregate stays a hash aggregate
    keys = [id_col, *SENT_KEYS, *riders(sent), "term", *(["sentence"] if carry_text else [])]
    return term_rows(sent, id_col, min_sent, carry_text).groupBy(*keys).agg(F.count("term").alias("tf"))


def tfidf_weights(
    sent: DataFrame,
    id_col: str = "doc_id",
    min_df: int = C.DEFAULT.min_df_plain,
    max_df: float = C.DEFAULT.max_df,
    min_sent: int = 1,
    carry_text: bool = False,
) -> DataFrame:
    """F3-F5 before normalisation: adds df, keep, idf and raw weight w."""
    tf = term_freq(sent, id_col, min_sent, carry_text)
    df_ = F.count("term").over(Window.partitionBy(id_col, "term"))
    n = F.col("n_sent")
    keep = F.col("term").isNotNull() & (F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df)) * n)
    idf = F.log((n + 1) / (F.col("df") + 1)) + 1.0
    return (
        tf.withColumn("df", df_)
        .withColumn("keep", keep)
        .withColumn("idf", F.when(F.col("keep"), idf))
        .withColumn("w", F.when(F.col("keep"), F.col("tf") * F.col("idf")).otherwise(F.lit(0.0)))
    )


def normalized_weights(weights: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """kept terms with their L2-normalised weight (the sentence vectors)."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col, "sent_idx")))
    return weights.filter("keep").withColumn("weight", F.col("w") / norm)


def tfidf_scores(
    sent: DataFrame,
    id_col: str = "doc_id",
    min_df: int = C.DEFAULT.min_df_plain,
    max_df: float = C.DEFAULT.max_df,
    max_scaled: bool = False,
    min_sent: int = 1,
    carry_text: bool = False,
) -> DataFrame:
    """F6 (plain) / F7 (``max_scaled``), with the F8 uniform fallback.

    Returns (id, n_sent, sent_idx, n_words, score, status[, sentence]);
    ``status`` is 'ok' or 'no_vocabulary' (no term survives pruning: every
    score is 1/n).  Rows of empty documents (sent_idx null, from an outer
    explode) pass through with score 0.
    """
    w = tfidf_weights(sent, id_col, min_df, max_df, min_sent, carry_text)
    if carry_text:
        # per-sentence sums by a window, read off the one sentinel row that
        # holds the text (a string max would force a sort-based aggregate)
        s_w = Window.partitionBy(id_col, "sent_idx")
        per_sent = (
            w.withColumn("sw", F.sum("w").over(s_w))
            .withColumn("sw2", F.sum(F.col("w") * F.col("w")).over(s_w))
            .withColumn("any_keep", F.max(F.col("keep").cast("int")).over(s_w))
            .filter(F.col("term").isNull() & (F.col("sentence").isNotNull() | F.col("sent_idx").isNull()))
        )
    else:
        per_sent = w.groupBy(id_col, *SENT_KEYS).agg(
            F.sum("w").alias("sw"),
            F.sum(F.col("w") * F.col("w")).alias("sw2"),
            F.max(F.col("keep").cast("int")).alias("any_keep"),
        )
    doc = Window.partitionBy(id_col)
    ok = F.max("any_keep").over(doc) == 1
    raw = F.when(F.col("sw2") > 0, F.col("sw") / F.sqrt("sw2")).otherwise(F.lit(0.0)) / (F.col("n_words") + 1)
    out = per_sent.withColumn("ok", ok).withColumn("raw", raw)
    if max_scaled:
        mx = F.max("raw").over(doc)
        scored = F.when(mx > 0, F.col("raw") / mx).otherwise(F.col("raw"))
    else:
        scored = F.col("raw")
    uniform = F.when(F.col("n_sent") > 0, F.lit(1.0) / F.col("n_sent")).otherwise(F.lit(0.0))
    return out.select(
        id_col,
        *SENT_KEYS,
        F.when(F.col("ok"), scored).otherwise(uniform).alias("score"),
        F.when(F.col("ok"), F.lit("ok")).otherwise(F.lit("no_vocabulary")).alias("status"),
        *(["sentence", *riders(out)] if carry_text else []),
    )


def scoring_stream(sent: DataFrame, id_col: str = "doc_id", settings: C.Settings = C.DEFAULT,
                   min_sent: int = 1, features: bool = False) -> DataFrame:
    """One term stream serving TF-IDF and TextRank together.

    From a single tf aggregation and df window: the plain TF-IDF score
    (min_df = settings.min_df_plain, on the text row of each sentence, with
    the uniform fallback) and the L2-normalised min_df = 1 sentence vectors
    (``term``/``weight``) that feed the TextRank kernel.  Rows: (id, n_sent,
    sent_idx, term, weight, sentence, tfidf).  With ``features`` also the
    max-scaled min_df = 1 score ``tfidf_h`` (F7/F8), ``n_words`` and the
    document's mean sentence length ``mean_len`` (N4), all by windows keyed
    by the id, equal on every row of a sentence.
    """
    tf = term_freq(sent, id_col, min_sent, carry_text=True)
    n = F.col("n_sent")
    df_ = F.count("term").over(Window.partitionBy(id_col, "term"))
    band = F.col("term").isNotNull() & (F.col("df") <= F.lit(float(settings.max_df)) * n)
    idf = F.log((n + 1) / (F.col("df") + 1)) + 1.0
    w = (
        tf.withColumn("df", df_)
        .withColumn("k2", band & (F.col("df") >= settings.min_df_plain))
        .withColumn("k1", band & (F.col("df") >= settings.min_df_hybrid))
        .withColumn("w2", F.when(F.col("k2"), F.col("tf") * idf).otherwise(F.lit(0.0)))
        .withColumn("w1", F.when(F.col("k1"), F.col("tf") * idf).otherwise(F.lit(0.0)))
    )
    s_w = Window.partitionBy(id_col, "sent_idx")
    w = (
        w.withColumn("sw2", F.sum("w2").over(s_w))
        .withColumn("sq2", F.sum(F.col("w2") * F.col("w2")).over(s_w))
        .withColumn("any2", F.max(F.col("k2").cast("int")).over(s_w))
        .withColumn("sq1", F.sum(F.col("w1") * F.col("w1")).over(s_w))
    )
    extra = []
    if features:
        doc = Window.partitionBy(id_col)
        w = (
            w.withColumn("sw1", F.sum("w1").over(s_w))
            .withColumn("any1", F.max(F.col("k1").cast("int")).over(s_w))
            .withColumn("raw1", F.when(F.col("sq1") > 0, F.col("sw1") / F.sqrt("sq1")).otherwise(F.lit(0.0))
                        / (F.col("n_words") + 1))
            .withColumn("mx1", F.max("raw1").over(doc))
            .withColumn("ok1", F.max("any1").over(doc) == 1)
            .withColumn("mean_len", F.sum(F.when(F.col("sentence").isNotNull(), F.col("n_words"))).over(doc)
                        / F.greatest(n, F.lit(1)))
        )
        scaled = F.when(F.col("mx1") > 0, F.col("raw1") / F.col("mx1")).otherwise(F.col("raw1"))
        extra = [
            F.when(F.col("ok1"), scaled).otherwise(F.when(n > 0, F.lit(1.0) / n).otherwise(F.lit(0.0))).alias("tfidf_h"),
            F.col("n_words").cast("double").alias("n_words"),
            F.col("mean_len").cast("double").alias("mean_len"),
        ]
    ok = F.max("any2").over(Window.partitionBy(id_col)) == 1
    raw = F.when(F.col("sq2") > 0, F.col("sw2") / F.sqrt("sq2")).otherwise(F.lit(0.0)) / (F.col("n_words") + 1)
    uniform = F.when(n > 0, F.lit(1.0) / n).otherwise(F.lit(0.0))
    return w.select(
        id_col,
        "n_sent",
        "sent_idx",
        F.when(F.col("k1"), F.col("term")).alias("term"),
        F.when(F.col("k1"), F.col("w1") / F.sqrt("sq1")).otherwise(F.lit(0.0)).alias("weight"),
        "sentence",
        F.when(ok, raw).otherwise(uniform).alias("tfidf"),
        *extra,
        *riders(w),
    )
