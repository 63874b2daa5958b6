"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (whole tables, whole texts) and runs the
library's operators; the matching DuckDB SQL is in :mod:`precis.plans.oracles`.
Scores are rounded to 6 digits so both engines agree bit for bit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis import config as C
from precis.operators import select, sentences, summarize, textrank, tfidf

K = C.DEFAULT.default_k


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, sf_dir) -> DataFrame:
    """Documents split into sentences, partitioned by doc_id."""
    return summarize.prepare_documents(table(spark, sf_dir, "documents"), "text", "doc_id")


def sent_table(spark, sf_dir, min_sent: int = 1) -> DataFrame:
    return sentences.sentence_table(docs(spark, sf_dir), "doc_id", min_sent=min_sent)


def row_local_sents(spark, sf_dir) -> DataFrame:
    """Sentence rows for work that needs no other row of the document: no exchange
    by id (a small table in few partitions is still spread over the cores)."""
    d = sentences.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return sentences.sentence_table(sentences.with_sentences(d, "text"), "doc_id")


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- N --------------------------------------------------------------------------

def q_sentences(spark, sf_dir):
    return row_local_sents(spark, sf_dir).select("doc_id", "sent_idx", "sentence", "n_sent")


def q_sentence_lengths(spark, sf_dir):
    s = sentences.with_norm_lengths(sent_table(spark, sf_dir))
    return s.select("doc_id", "sent_idx", "n_words", r6("norm_length").alias("norm_length"))


def q_sentence_positions(spark, sf_dir):
    s = sentences.with_positions(row_local_sents(spark, sf_dir))
    return s.select("doc_id", "sent_idx", r6("position").alias("position"))


# --- F --------------------------------------------------------------------------

def q_terms(spark, sf_dir):
    t = tfidf.term_rows(row_local_sents(spark, sf_dir))
    return t.filter(F.col("term").isNotNull()).select("doc_id", "sent_idx", "term")


def q_term_freq(spark, sf_dir):
    tf = tfidf.term_freq(sent_table(spark, sf_dir))
    return tf.filter(F.col("term").isNotNull()).select("doc_id", "sent_idx", "term", "tf")


def q_doc_freq(spark, sf_dir):
    w = tfidf.tfidf_weights(sent_table(spark, sf_dir), min_df=2)
    return w.filter(F.col("term").isNotNull()).select("doc_id", "term", "df").distinct()


def q_pruned_vocab(spark, sf_dir):
    w = tfidf.tfidf_weights(sent_table(spark, sf_dir), min_df=2)
    return w.filter("keep").select("doc_id", "term", "df").distinct()


def q_tfidf_weights(spark, sf_dir):
    w = tfidf.normalized_weights(tfidf.tfidf_weights(sent_table(spark, sf_dir), min_df=2))
    return w.select("doc_id", "sent_idx", "term", r6("weight").alias("weight"))


def q_tfidf_scores(spark, sf_dir):
    s = tfidf.tfidf_scores(sent_table(spark, sf_dir), min_df=2)
    return s.select("doc_id", "sent_idx", r6("score").alias("score"), "status")


def q_tfidf_feature(spark, sf_dir):
    s = tfidf.tfidf_scores(sent_table(spark, sf_dir), min_df=1, max_scaled=True)
    return s.select("doc_id", "sent_idx", r6("score").alias("tfidf_feature"))


# --- K --------------------------------------------------------------------------

def q_top_sentences(spark, sf_dir):
    d = docs(spark, sf_dir)
    sc = summarize.score_sentences(d, "tfidf", K, only_long=False)
    return select.top_k(sc, K).select("doc_id", "sent_idx", "rank")


def q_summaries_tfidf(spark, sf_dir):
    return summarize.summarize(table(spark, sf_dir, "documents"), "text", "tfidf", K)


def q_summaries_lead(spark, sf_dir):
    return summarize.summarize(table(spark, sf_dir, "documents"), "text", "lead", K)


def q_summaries_textrank(spark, sf_dir):
    return summarize.summarize(table(spark, sf_dir, "documents"), "text", "textrank", K)


def q_summaries_side_by_side(spark, sf_dir):
    return summarize.summarize_side_by_side(
        table(spark, sf_dir, "documents"), "text", ("tfidf", "textrank", "lead"), K
    )


# --- G --------------------------------------------------------------------------

def _textrank(spark, sf_dir):
    vec = textrank.sentence_vectors(sent_table(spark, sf_dir))
    return textrank.textrank_scores(vec, "doc_id", C.DEFAULT.damping, C.DEFAULT.tol, C.DEFAULT.max_iter)


def q_textrank_scores(spark, sf_dir):
    return _textrank(spark, sf_dir).select("doc_id", "sent_idx", F.round("textrank", 7).alias("textrank"), "converged")


def q_textrank_feature(spark, sf_dir):
    f = textrank.textrank_feature(_textrank(spark, sf_dir))
    return f.select("doc_id", "sent_idx", r6("textrank_feature").alias("textrank_feature"))


REGISTRY = {
    "sentences": q_sentences,
    "sentence_lengths": q_sentence_lengths,
    "sentence_positions": q_sentence_positions,
    "terms": q_terms,
    "term_freq": q_term_freq,
    "doc_freq": q_doc_freq,
    "pruned_vocab": q_pruned_vocab,
    "tfidf_weights": q_tfidf_weights,
    "tfidf_scores": q_tfidf_scores,
    "tfidf_feature": q_tfidf_feature,
    "top_sentences": q_top_sentences,
    "summaries_tfidf": q_summaries_tfidf,
    "summaries_lead": q_summaries_lead,
    "textrank_scores": q_textrank_scores,
    "textrank_feature": q_textrank_feature,
    "summaries_textrank": q_summaries_textrank,
    "summaries_side_by_side": q_summaries_side_by_side,
}


def queries():
    return dict(REGISTRY)


# --- T: cleaning ------------------------------------------------------------------
# The documents hold none of the patterns T3-T7 remove, so these queries inject
# one deterministically into every row (same CASE in the oracle); every row of
# the table is processed.

from precis.functions import text as T  # noqa: E402
from precis.operators import corpus as R, log as L  # noqa: E402
from precis.session import checkpoint_dir  # noqa: E402
from precis.sources import io as SRC  # noqa: E402


def injected(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    t = F.col("text")
    m = F.col("doc_id") % 6
    txt = (
        F.when(m == 0, F.concat(F.lit("(CNN) -- "), t))
        .when(m == 1, F.concat(F.lit("LONDON, England (Reuters) -- "), t))
        .when(m == 2, F.concat(t, F.lit(" http://ex.org/"), i, F.lit("?a=1 end.")))
        .when(m == 3, F.concat(F.lit("Editor's note: v"), i, F.lit(". "), t))
        .when(m == 4, F.concat(t, F.lit(" Copyright 2009 Reuters. All rights reserved.")))
        .otherwise(F.concat(t, F.lit(" Read more.")))
    )
    return d.select("doc_id", txt.alias("text"))


def _tq(fn):
    def q(spark, sf_dir):
        return sentences.spread(injected(spark, sf_dir), "doc_id").select("doc_id", fn(F.col("text")).alias("text"))

    return q


def q_html_to_text(spark, sf_dir):
    p = sentences.spread(table(spark, sf_dir, "pages"), "page_id")
    return p.select("page_id", T.normalize_ws(T.html_to_text("html")).alias("text"))


def q_word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count("text").alias("words"))


def q_text_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    from precis.functions.sentences import split_sentences

    return d.select(
        "doc_id", T.word_count("text").alias("words"), F.size(split_sentences("text")).alias("sentences")
    )


def _tfidf_with_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = summarize.summarize(d, "text", "tfidf", K, keep=("text",))
    return s


def q_compression_ratio(spark, sf_dir):
    s = _tfidf_with_text(spark, sf_dir)
    w, sw = T.word_count("text"), T.word_count("summary")
    return s.select(
        "doc_id", w.alias("words"), sw.alias("summary_words"), r6(T.compression_ratio(w, sw)).alias("ratio")
    )


def q_summary_log(spark, sf_dir):
    s = _tfidf_with_text(spark, sf_dir)
    return L.log_entries(s, "text", "summary", "tfidf", K).drop("seconds")


def q_recent_summaries(spark, sf_dir):
    s = _tfidf_with_text(spark, sf_dir)
    return L.recent(L.log_entries(s, "text", "summary", "tfidf", K).drop("seconds"), 5)


# --- R: corpus ----------------------------------------------------------------------

def corpus(spark, sf_dir) -> DataFrame:
    """(doc_id, article = text, highlights = first sentence) from documents."""
    from precis.functions.sentences import split_sentences

    d = sentences.spread(table(spark, sf_dir, "documents"), "doc_id")
    return d.select(
        "doc_id",
        F.col("text").alias("article"),
        F.coalesce(F.get(split_sentences("text"), F.lit(0)), F.lit("")).alias("highlights"),  # a text may have no sentence
    )


def q_corpus_scan(spark, sf_dir):
    """S1 + S2 over a stored corpus (written to the shared folder, which the cluster cleans)."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    SRC.write_table(corpus(spark, sf_dir), path)
    return SRC.read_corpus(spark, path)


def q_drop_blank(spark, sf_dir):
    return R.drop_blank(R.clean_columns(corpus(spark, sf_dir), partitioned=True))


def q_length_filter(spark, sf_dir):
    return R.length_filter(R.drop_blank(R.clean_columns(corpus(spark, sf_dir), partitioned=True)))


def q_dedup_keep_first(spark, sf_dir):
    return R.dedup_keep_first(corpus(spark, sf_dir).select("doc_id", "article"))


def q_clean_corpus(spark, sf_dir):
    return R.clean_corpus(corpus(spark, sf_dir))


def q_sample_n(spark, sf_dir):
    return R.sample_n(corpus(spark, sf_dir).select("doc_id", "article"), 200)


REGISTRY.update({
    "html_to_text": q_html_to_text,
    "strip_urls": _tq(T.strip_urls),
    "strip_news_prefix": _tq(T.strip_news_prefix),
    "strip_editor_note": _tq(T.strip_editor_note),
    "strip_copyright": _tq(T.strip_copyright),
    "strip_promo": _tq(T.strip_promo),
    "fix_punct_spacing": _tq(T.fix_punct_spacing),
    "normalize_ws": _tq(T.normalize_ws),
    "clean_article": _tq(lambda c: T.clean_text(c, False)),
    "clean_summary": _tq(lambda c: T.clean_text(c, True)),
    "word_count": q_word_count,
    "text_stats": q_text_stats,
    "compression_ratio": q_compression_ratio,
    "summary_log": q_summary_log,
    "recent_summaries": q_recent_summaries,
    "corpus_scan": q_corpus_scan,
    "drop_blank": q_drop_blank,
    "length_filter": q_length_filter,
    "dedup_keep_first": q_dedup_keep_first,
    "clean_corpus": q_clean_corpus,
    "sample_n": q_sample_n,
})


# --- E: ROUGE -------------------------------------------------------------------------

from precis.operators import rouge as E  # noqa: E402
from precis.functions.porter import stem  # noqa: E402
from precis.functions.tokens import rouge_tokens  # noqa: E402


def conv_pairs(spark, sf_dir) -> DataFrame:
    """(doc_id, article = assistant turn, highlights = the user turn before it)."""
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("highlights"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("article"))
    return a.join(u, ["conv_id", "turn"]).select(
        (F.col("conv_id") * F.lit(4294967296) + F.col("turn")).alias("doc_id"), "article", "highlights"
    )


def predictions(spark, sf_dir, methods=("tfidf", "textrank", "lead"), model=None) -> DataFrame:
    return summarize.summarize_side_by_side(conv_pairs(spark, sf_dir), "article", methods, K, keep=("highlights",), model=model)


def q_rouge_tokens(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.posexplode(rouge_tokens("text")).alias("pos", "token"))


def q_token_stems(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    vocab = c.select(F.explode(rouge_tokens("text")).alias("token")).distinct()
    return vocab.select("token", stem("token").alias("stem"))


def q_ngram_counts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    t = E.stemmed_tokens(c.select("conv_id", "turn", "text"), "text", "tok")
    g = t.select(
        "conv_id", "turn",
        F.explode(F.concat(
            F.transform("tok", lambda x: F.struct(F.lit(1).alias("n"), x.alias("ngram"))),
            F.transform(E.bigrams(F.col("tok")), lambda x: F.struct(F.lit(2).alias("n"), x.alias("ngram"))),
        )).alias("x"),
    )
    return g.groupBy("conv_id", "turn", "x.n", "x.ngram").agg(F.count(F.lit(1)).alias("cnt"))


def _rouge_tfidf(spark, sf_dir):
    return E.rouge_scores(predictions(spark, sf_dir, ("tfidf",)), ["doc_id"], "highlights", "tfidf_summary")


def q_rouge_1(spark, sf_dir):
    s = _rouge_tfidf(spark, sf_dir)
    return s.select("doc_id", r6("rouge_1_p").alias("p"), r6("rouge_1_r").alias("r"), r6("rouge_1").alias("f"))


def q_rouge_2(spark, sf_dir):
    s = _rouge_tfidf(spark, sf_dir)
    return s.select("doc_id", r6("rouge_2_p").alias("p"), r6("rouge_2_r").alias("r"), r6("rouge_2").alias("f"))


def q_rouge_l(spark, sf_dir):
    s = _rouge_tfidf(spark, sf_dir)
    return s.select("doc_id", r6("rouge_l_p").alias("p"), r6("rouge_l_r").alias("r"), r6("rouge_l").alias("f"))


def q_evaluate_tfidf(spark, sf_dir):
    e = E.evaluate_model(predictions(spark, sf_dir, ("tfidf",)), "tfidf_summary", "highlights")
    return e.select(*[r6(c).alias(c) for c in ("rouge_1", "rouge_2", "rouge_l")])


def q_compare_models(spark, sf_dir):
    return _compared(predictions(spark, sf_dir), ("tfidf", "textrank", "lead"))


def _compared(preds, methods):
    names = {"lead": "Lead", **{m: C.MODEL_NAMES[m] for m in methods if m != "lead"}}
    cm = E.compare_models(preds, {names[m]: f"{m}_summary" for m in methods}, "highlights")
    return cm.select("model", *[r6(c).alias(c) for c in ("rouge_1", "rouge_2", "rouge_l")])


def q_compare_all_models(spark, sf_dir):
    """The comparison with the hybrid method (a network of fixed weights) in the table."""
    methods = ("tfidf", "textrank", "hybrid", "lead")
    return _compared(predictions(spark, sf_dir, methods, MD.fixed_model()), methods)


REGISTRY.update({
    "rouge_tokens": q_rouge_tokens,
    "token_stems": q_token_stems,
    "ngram_counts": q_ngram_counts,
    "rouge_1": q_rouge_1,
    "rouge_2": q_rouge_2,
    "rouge_l": q_rouge_l,
    "evaluate_tfidf": q_evaluate_tfidf,
    "compare_models": q_compare_models,
    "compare_all_models": q_compare_all_models,
})


# --- M: features, labels, scaler, model ----------------------------------------------------

from precis.operators import features as M, model as MD  # noqa: E402


def q_sentence_features(spark, sf_dir):
    f = M.sentence_features(sent_table(spark, sf_dir), "doc_id")
    return f.select("doc_id", "sent_idx", *[r6(c).alias(c) for c in M.FEATURES])


def _training_set(spark, sf_dir):
    return M.training_set(conv_pairs(spark, sf_dir))


def q_weak_labels(spark, sf_dir):
    docs_ = summarize.prepare_documents(conv_pairs(spark, sf_dir), "article", "doc_id", keep=("highlights",))
    w = M.weak_labels(docs_)
    return w.select("doc_id", "sent_idx", r6("rouge_1").alias("rouge_1"), "label")


def q_training_set(spark, sf_dir):
    ts = _training_set(spark, sf_dir)
    return ts.select("doc_id", "sent_idx", *[r6(c).alias(c) for c in M.FEATURES], "label")


def q_class_balance(spark, sf_dir):
    cb = M.class_balance(_training_set(spark, sf_dir))
    return cb.select("total", "positives", "negatives", r6("positive_pct").alias("positive_pct"))


def q_scaler_fit(spark, sf_dir):
    st = M.scaler_table(_training_set(spark, sf_dir))
    return st.select("feature", *[r6(c).alias(c) for c in ("data_min", "data_max", "data_range", "scale", "min")])


def q_scaler_transform(spark, sf_dir):
    scaled = M.fit_transform(_training_set(spark, sf_dir))
    return scaled.select("doc_id", "sent_idx", *[r6(c).alias(c) for c in M.FEATURES])


def q_train_val_split(spark, sf_dir):
    return M.train_val_split(conv_pairs(spark, sf_dir).select("doc_id")).select("doc_id", "is_val")


def trained_model(spark, sf_dir):
    """A model fitted on the conversation pairs; every query that needs one trains its own."""
    return MD.train(_training_set(spark, sf_dir))


def q_train_importance(spark, sf_dir):
    return spark.createDataFrame(trained_model(spark, sf_dir).history, "epoch int, val_loss double")


def q_training_metrics(spark, sf_dir):
    """Of fixed weights, so that the scores are the same everywhere."""
    m = MD.training_metrics(MD.fixed_model(), _training_set(spark, sf_dir))
    return m.select("split", *[r6(c).alias(c) for c in ("accuracy", "auc", "loss")])


def q_training_metrics_trained(spark, sf_dir):
    ts = _training_set(spark, sf_dir).persist()  # training and metrics read it
    try:
        return MD.training_metrics(MD.train(ts), ts)
    finally:
        ts.unpersist()


def _importance(spark, sf_dir, model):
    feats = M.sentence_features(sent_table(spark, sf_dir), "doc_id")
    return MD.predict_importance(model, feats)


def q_predict_importance(spark, sf_dir):
    """Importance of every sentence of every document by a network of fixed weights."""
    return _importance(spark, sf_dir, MD.fixed_model()).select("doc_id", "sent_idx", r6("importance").alias("importance"))


def q_predict_importance_trained(spark, sf_dir):
    return _importance(spark, sf_dir, trained_model(spark, sf_dir)).select("doc_id", "sent_idx", "importance")


def q_summaries_hybrid(spark, sf_dir):
    """By a network of fixed weights, with the status of each summary."""
    return summarize.summarize(table(spark, sf_dir, "documents"), "text", "hybrid", K, model=MD.fixed_model(), status=True)


def q_summaries_hybrid_trained(spark, sf_dir):
    model = trained_model(spark, sf_dir)
    return summarize.summarize(table(spark, sf_dir, "documents"), "text", "hybrid", K, model=model)


REGISTRY.update({
    "sentence_features": q_sentence_features,
    "weak_labels": q_weak_labels,
    "training_set": q_training_set,
    "class_balance": q_class_balance,
    "scaler_fit": q_scaler_fit,
    "scaler_transform": q_scaler_transform,
    "train_val_split": q_train_val_split,
    "train_importance": q_train_importance,
    "training_metrics": q_training_metrics,
    "predict_importance": q_predict_importance,
    "summaries_hybrid": q_summaries_hybrid,
    "training_metrics_trained": q_training_metrics_trained,
    "predict_importance_trained": q_predict_importance_trained,
    "summaries_hybrid_trained": q_summaries_hybrid_trained,
})


# --- G on dense vectors (embeddings, group = label) -------------------------------------

def q_similarity_degree(spark, sf_dir):
    d = textrank.similarity_degrees(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return d.select("label", "vec_id", r6("degree").alias("degree"))


def q_pagerank_embeddings(spark, sf_dir):
    """PageRank of the cosine graph of each label, over the vectors' positive
    parts: similarities are then never negative and the iteration converges."""
    e = table(spark, sf_dir, "embeddings").withColumn(
        "embedding", F.transform("embedding", lambda x: F.greatest(x.cast("double"), F.lit(0.0))))
    pr = textrank.pagerank_groups(e, "label", "vec_id", "embedding")
    return pr.select("label", "vec_id", F.round("pagerank", 7).alias("pagerank"), "converged", "iterations")


def q_sentence_vectors(spark, sf_dir):
    """L2-normalised TF-IDF rows of every sentence (the non-zero components)."""
    v = textrank.sentence_vectors(sent_table(spark, sf_dir))
    return v.where(F.col("weight") != 0).select("doc_id", "sent_idx", "term", r6("weight").alias("weight"))


REGISTRY.update({
    "similarity_degree": q_similarity_degree,
    "pagerank_embeddings": q_pagerank_embeddings,
    "sentence_vectors": q_sentence_vectors,
})


# --- G on documents: a user's sentence vectors, strongest neighbours ---------------------

from precis.operators import dense as D  # noqa: E402

DIMS = 12


def sentence_shapes(sents: str) -> "F.Column":
    """A small dense vector of each sentence: how many of its words have 1, 2, ... letters (the last: or more)."""
    sizes = F.transform(sents, lambda s: F.transform(F.split(s, " "), lambda w: F.least(F.length(w), F.lit(DIMS))))

    def count(n, d):
        return F.size(F.filter(n, lambda x: x == d)).cast("double")

    return F.transform(sizes, lambda n: F.array(*[count(n, d) for d in range(1, DIMS + 1)]))


def documents_with_vectors(spark, sf_dir) -> DataFrame:
    """(doc_id, text, n_sent, vectors): the documents with a vector for each sentence, as a user's encoder would add."""
    d = sentences.with_sentences(sentences.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "text")
    return d.select("doc_id", "text", "n_sent", sentence_shapes("sentences").alias("vectors"))


def _dense_rows(d, vectors, negative_edges="keep"):
    r = D.textrank_vectors(d, "doc_id", vectors, F.col("n_sent"), negative_edges)
    return r.select("doc_id", "sent_idx", F.round("textrank", 7).alias("textrank"), "converged")


def q_textrank_vectors(spark, sf_dir):
    return _dense_rows(documents_with_vectors(spark, sf_dir), F.col("vectors"))


def q_summaries_textrank_vectors(spark, sf_dir):
    return summarize.summarize(documents_with_vectors(spark, sf_dir), "text", "textrank", K, vectors="vectors")


def q_textrank_clipped(spark, sf_dir):
    """Over shifted vectors, whose cosines are often negative: those edges are dropped."""
    d = documents_with_vectors(spark, sf_dir)
    shifted = F.transform("vectors", lambda v: F.transform(v, lambda x: x - 1.5))
    return _dense_rows(d, shifted, "clip")


def q_strongest_neighbours(spark, sf_dir):
    vec = textrank.sentence_vectors(sent_table(spark, sf_dir))
    return D.strongest_neighbours(vec, 5).select("doc_id", "sent_idx", "rank", "neighbour", r6("similarity").alias("similarity"))


REGISTRY.update({
    "textrank_vectors": q_textrank_vectors,
    "summaries_textrank_vectors": q_summaries_textrank_vectors,
    "textrank_clipped": q_textrank_clipped,
    "strongest_neighbours": q_strongest_neighbours,
})
