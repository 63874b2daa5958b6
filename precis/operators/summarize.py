"""Batch summaries (K7-K11): DataFrame in, DataFrame with a summary column out.

Plan of ``summarize(df, method='tfidf')`` (one exchange in total):

    scan(row key, id and kept columns, text) -> hash-partition by the key   <- the only shuffle
      -> split sentences -> posexplode (and one row for the document itself)
      -> explode terms + one text row per sentence -> tf / df / score
         (aggregates and windows keyed by the row) -> top-k
         (WindowGroupLimit) -> collect <= k rows per document

Every row of the input has its summary, whatever its id: documents are told apart by a
key of their own, and the id travels with the kept columns on the document's own row.
No self-join: each sentence's text rides on its sentinel row.  TextRank runs the
vectorised kernel and selects its top rows inside it; side-by-side summaries share one
term stream and one kernel pass.  Documents with n <= k skip scoring (K3); empty texts
give '' (K4).  TextRank over a user's sentence vectors is row-local: no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precis import config as C
from precis.operators.dense import best_positions, dense_scores, pick
from precis.operators.select import lead_k, rank_key, resolve_k, top_k
from precis.operators.sentences import (
    CARRY, ROW, hash_partition, keyed_documents, partition_by_doc, sentence_table, spread, with_sentences,
)
from precis.operators.tfidf import tfidf_scores
from precis.operators.textrank import sentence_vectors, textrank_scores

METHODS = ("tfidf", "textrank", "lead", "hybrid")


def resolve_method(method: str) -> str:
    """K7: case-folded; anything else is an error."""
    m = (method or "").lower()
    if m not in METHODS:
        raise ValueError(f"no summaries by {method!r}; there are {', '.join(METHODS)}")
    return m


def available_methods(methods, model=None) -> list[str]:
    """The methods that can run: hybrid only with a model."""
    found = [resolve_method(m) for m in methods]
    return [m for m in found if m != "hybrid" or model is not None]


def prepare_documents(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep=()) -> DataFrame:
    """(id, *keep, sentences, n_sent), partitioned by id.

    The raw rows are shuffled first and split into sentences after the
    exchange, so the regex work runs with the parallelism of the shuffle
    partitions, independent of how the input files are laid out.  Rows need
    an id (null ids cannot be keyed).
    """
    extra = [c for c in keep if c != text_col]
    raw = df.select(id_col, text_col, *extra).filter(F.col(id_col).isNotNull())
    docs = with_sentences(partition_by_doc(raw, id_col), text_col)
    return docs if text_col in keep else docs.drop(text_col)


def score_sentences(
    docs: DataFrame,
    method: str,
    k,
    id_col: str = "doc_id",
    settings: C.Settings = C.DEFAULT,
    model=None,
    only_long: bool = True,
    carry_text: bool = False,
    keep_top: int | None = None,
) -> DataFrame:
    """Sentence scores (id, n_sent, sent_idx, score[, sentence]) of one method.

    With ``only_long`` only documents with n > k are scored; the others (and,
    with ``carry_text``, empty documents as one null row) pass through so the
    caller can assemble every summary from this one table.  ``keep_top``
    lets TextRank select its top rows inside the kernel.
    """
    k = resolve_k(k)
    min_sent = k + 1 if only_long else 1
    text = ["sentence", *([CARRY] if CARRY in docs.columns else [])] if carry_text else []
    if method == "tfidf":
        sent = sentence_table(docs, id_col, min_sent=0 if carry_text else min_sent, outer=carry_text)
        sc = tfidf_scores(sent, id_col, min_df=settings.min_df_plain, max_df=settings.max_df,
                          min_sent=min_sent, carry_text=carry_text)
        return sc.select(id_col, "n_sent", "sent_idx", "score", *text)
    if method == "textrank":
        sent = sentence_table(docs, id_col, min_sent=0 if carry_text else min_sent, outer=carry_text)
        vec = sentence_vectors(sent, id_col, min_df=settings.min_df_hybrid, min_sent=min_sent, carry_text=carry_text)
        tr = textrank_scores(vec, id_col, settings.damping, settings.tol, settings.max_iter, carry_text=carry_text,
                             keep_top=keep_top)
        return tr.select(id_col, "n_sent", "sent_idx", F.col("textrank").alias("score"), *text)
    if method == "hybrid":
        from precis.operators.features import sentence_features
        from precis.operators.model import predict_importance

        if model is None:
            raise RuntimeError("the hybrid method needs an importance model: train one or load one")
        given = [c for c in ("given_rank",) if c in docs.columns]
        sent = sentence_table(docs, id_col, min_sent=0 if carry_text else min_sent, outer=carry_text, more=given)
        feats = sentence_features(sent, id_col, settings, carry_text=carry_text)
        return predict_importance(model, feats).select(
            id_col, "n_sent", "sent_idx", F.col("importance").alias("score"), *text
        )
    raise ValueError(method)


def collect_summaries(selected: DataFrame, names=(), out: str = "summary", methods=None) -> DataFrame:
    """K2 from rows that carry their text: (*names, n_sent, summary).

    At most k rows per document and method reach this aggregation (WindowGroupLimit),
    and the document's own row, from which the columns ``names`` are read.  With
    ``methods`` (rows have a ``method``, or one column of flags for each method)
    there is one column ``<method>_summary`` for each.
    """
    def of(flag):
        return F.sort_array(F.collect_list(F.when(F.col("sent_idx").isNotNull() & flag, F.struct("sent_idx", "sentence"))))

    def joined(c):
        return F.coalesce(F.array_join(F.transform(c, lambda x: x["sentence"]), " "), F.lit(""))

    if methods is None:
        picks, cols = [of(F.lit(True)).alias("_p")], [joined("_p").alias(out)]
    else:
        flags = [F.col("method") == m if "method" in selected.columns else F.col(f"_is_{m}") for m in methods]
        picks = [of(f).alias(f"_p_{m}") for m, f in zip(methods, flags)]
        cols = [joined(f"_p_{m}").alias(f"{m}_summary") for m in methods]
    d = selected.groupBy(ROW, "n_sent").agg(F.first(CARRY, ignorenulls=True).alias(CARRY), *picks)
    return d.select(*[F.col(f"{CARRY}.`{c}`").alias(c) for c in names], F.col("n_sent").cast("int").alias("n_sent"), *cols)


def _status(res: DataFrame, k: int) -> DataFrame:
    """How each summary came about: 'empty' text, 'whole' text (no more than k sentences), 'scored'."""
    n = F.col("n_sent")
    return res.withColumn("status", F.when(n == 0, "empty").when(n <= k, "whole").otherwise("scored"))


def _by_vectors(df: DataFrame, text_col: str, k: int, id_col: str, out: str, keep, vectors: str, negative_edges: str,
                settings: C.Settings) -> DataFrame:
    """K9 on a user's sentence vectors, row by row: nothing is shuffled but a table too small for the cores."""
    names = dict.fromkeys([id_col, text_col, vectors, *keep])
    docs = with_sentences(df.select(*names), text_col, "_sentences")
    # only the texts that are longer than their summary have their graph solved
    long = F.when(F.col("n_sent") > k, F.col(vectors))
    docs = docs.withColumn("_scores", dense_scores(long, F.when(F.col("n_sent") > k, F.col("n_sent")), negative_edges, settings))
    best = pick(F.col("_sentences"), best_positions(F.col("_scores.scores"), k))
    summary = F.when(F.col("n_sent") > k, best).otherwise(F.array_join("_sentences", " "))
    return docs.select(*dict.fromkeys([id_col, *keep]), F.col("n_sent").cast("int").alias("n_sent"), summary.alias(out))


def summarize(
    df: DataFrame,
    text_col: str = "text",
    method: str = "tfidf",
    k=None,
    id_col: str = "doc_id",
    out: str = "summary",
    model=None,
    keep=(),
    settings: C.Settings = C.DEFAULT,
    vectors: str | None = None,
    negative_edges: str = "keep",
    status: bool = False,
) -> DataFrame:
    """One summary per row: (id, *keep, n_sent, summary).

    Rows with null or repeated ids have a summary each.  TF-IDF, TextRank and hybrid
    run as one linear plan (shuffle by row, split, score, rank, collect) with no join:
    the id and the ``keep`` columns travel on each document's own row (columns that
    Spark cannot group by, such as maps, cannot be kept), sentences on sentinel rows.

    ``vectors`` names a column with a vector for each sentence of the text (array of
    arrays): TextRank then ranks by their cosines instead of the terms', and the
    hybrid method takes its TextRank feature from them.  ``negative_edges="clip"``
    drops negative cosines.  ``status`` adds how the summary came about ('empty',
    'whole', 'scored').
    """
    method = resolve_method(method)
    k = resolve_k(k)
    names = list(dict.fromkeys([id_col, *keep]))
    if vectors is not None and method not in ("textrank", "hybrid"):
        raise ValueError(f"sentence vectors serve textrank and hybrid summaries, not {method}")
    if method == "lead":
        # row-local: nothing is shuffled
        docs = with_sentences(spread(df.select(*dict.fromkeys([*names, text_col])), id_col), text_col)
        res = docs.select(*names, F.col("n_sent").cast("int").alias("n_sent"), lead_k("sentences", k).alias(out))
    elif method == "textrank" and vectors is not None:
        res = _by_vectors(df, text_col, k, id_col, out, keep, vectors, negative_edges, settings)
    else:
        arrays = [] if vectors is None else [("_vectors", F.col(vectors))]
        docs = keyed_documents(df, text_col, names, arrays)
        if vectors is not None:
            docs = docs.withColumn("given_rank", dense_scores(F.col("_vectors"), F.col("n_sent"), negative_edges, settings)["scores"])
        best = score_sentences(docs, method, k, ROW, settings, model, carry_text=True, keep_top=k if method == "textrank" else None)
        if method != "tfidf":  # the kernel's rows have no partitioning
            best = hash_partition(best, ROW)
        if method != "textrank":
            best = top_k(best, k, ROW)
        res = collect_summaries(best, names, out)
    return _status(res, k) if status else res


def summarize_safe(df: DataFrame, text_col: str = "text", k=None, id_col: str = "doc_id", model=None, keep=(),
                   settings: C.Settings = C.DEFAULT) -> DataFrame:
    """K10 safe: hybrid summaries with a ``status``; without a trained model every summary is '' ('untrained')."""
    if model is not None and model.is_trained:
        return summarize(df, text_col, "hybrid", k, id_col, model=model, keep=keep, settings=settings, status=True)
    docs = with_sentences(df.select(*dict.fromkeys([id_col, *keep, text_col])), text_col)
    return docs.select(*dict.fromkeys([id_col, *keep]), F.col("n_sent").cast("int").alias("n_sent"), F.lit("").alias("summary"),
                       F.lit("untrained").alias("status"))


def summarize_side_by_side(
    df: DataFrame,
    text_col: str = "text",
    methods=("tfidf", "textrank", "lead"),
    k=None,
    id_col: str = "doc_id",
    model=None,
    keep=(),
    settings: C.Settings = C.DEFAULT,
) -> DataFrame:
    """Several methods over the same documents, one column per method.

    One branch whatever the methods: one term stream (TF-IDF scores and TextRank
    vectors) and one kernel pass.  Without hybrid the kernel selects every method's
    rows; with it, it hands on every sentence's features, from which the model's score
    comes, and each method ranks the same rows.
    """
    from precis.operators.tfidf import scoring_stream

    methods = [resolve_method(m) for m in dict.fromkeys(methods)]
    k = resolve_k(k)
    names = list(dict.fromkeys([id_col, *keep]))
    sent = sentence_table(keyed_documents(df, text_col, names), ROW, min_sent=0, outer=True)
    if "hybrid" not in methods:
        stream = scoring_stream(sent, ROW, settings, min_sent=k + 1)
        picks = textrank_scores(stream, ROW, settings.damping, settings.tol, settings.max_iter,
                                keep_top=k, emit=tuple(methods), extra=("tfidf",))
        return collect_summaries(hash_partition(picks, ROW), names, methods=methods)
    if model is None:
        raise RuntimeError("the hybrid method needs an importance model: train one or load one")
    from precis.operators.features import sentence_features
    from precis.operators.model import predict_importance

    feats = predict_importance(model, sentence_features(sent, ROW, settings, carry_text=True, plain=("tfidf",)))
    feats = hash_partition(feats, ROW)  # the kernel's rows have no partitioning
    score = {"tfidf": "plain_tfidf", "textrank": "plain_textrank", "hybrid": "importance"}
    own = F.col("sent_idx").isNull()
    picked = feats
    for m in methods:
        w = Window.partitionBy(ROW, own).orderBy(*([F.col("sent_idx")] if m == "lead" else rank_key(score[m])))
        picked = picked.withColumn(f"_is_{m}", F.row_number().over(w) <= k)
    picked = picked.where(own | F.greatest(*[F.col(f"_is_{m}") for m in methods], F.lit(False)))
    return collect_summaries(picked, names, methods=methods)


def summarize_available(df: DataFrame, text_col: str = "text", methods=METHODS, k=None, id_col: str = "doc_id",
                        model_path: str | None = None, keep=(), settings: C.Settings = C.DEFAULT) -> DataFrame:
    """S12 + K11: the wanted methods that can run, side by side: hybrid only if a model loads from ``model_path``."""
    from precis.operators.model import load_optional

    model = load_optional(df.sparkSession, model_path)
    found = available_methods(methods, model)
    return summarize_side_by_side(df, text_col, found, k, id_col, model, keep, settings)


def summarize_text(spark, text: str, method: str = "tfidf", k=None, model=None) -> DataFrame:
    """Summarise one literal string through the same operators."""
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    return summarize(df, "text", method, k, model=model)
