"""DuckDB oracle SQL for every query of :mod:`precis.plans.queries`.

Written independently of the Spark plans (plain joins and GROUP BYs where the
Spark side uses windows over a partitioned table), sharing only the pattern
constants and the generated stemmer expression.  Tables are the driver's
pre-registered views.
"""

from __future__ import annotations

from precis import config as C
from precis.functions.porter import rouge_stem_sql, stem_sql
from precis.operators.model import fixed_model
from precis.plans import sql as S

K = C.DEFAULT.default_k


def with_(*ctes: tuple[str, str], body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({q})" for n, q in ctes) + "\n" + body


# --- sentence table -----------------------------------------------------------

def docs_cte(src: str = "documents", id_col: str = "doc_id", text: str = "text"):
    return ("docs", f"SELECT {id_col} AS doc_id, {S.split_sentences(text)} AS sentences FROM {src}")


def sents_cte():
    return (
        "sents",
        "SELECT doc_id, n_sent, sent_idx, sentence, "
        + S.words_of_normalized("sentence")
        + " AS n_words FROM (SELECT doc_id, CAST(len(sentences) AS INTEGER) AS n_sent, "
        "CAST(generate_subscripts(sentences, 1) - 1 AS INTEGER) AS sent_idx, unnest(sentences) AS sentence FROM docs)",
    )


def tfidf_ctes(min_df: int, where: str = "TRUE", prefix: str = ""):
    """tf / df / weights / per-sentence scores for documents matching ``where``."""
    p = prefix
    return [
        (f"{p}tm", f"SELECT doc_id, n_sent, sent_idx, unnest({S.terms('sentence')}) AS term FROM sents WHERE {where}"),
        (f"{p}tf", f"SELECT doc_id, n_sent, sent_idx, term, count(*) AS tf FROM {p}tm WHERE term NOT IN {S.stop_list()} GROUP BY ALL"),
        (f"{p}dfq", f"SELECT *, count(*) OVER (PARTITION BY doc_id, term) AS df FROM {p}tf"),
        (
            f"{p}wt",
            f"SELECT *, tf * (ln((1 + n_sent) / (1 + df)) + 1) AS w FROM {p}dfq "
            f"WHERE df >= {min_df} AND df <= CAST({C.DEFAULT.max_df} AS DOUBLE) * n_sent",
        ),
        (f"{p}ps", f"SELECT doc_id, sent_idx, sum(w) AS sw, sum(w * w) AS sw2 FROM {p}wt GROUP BY ALL"),
        (
            f"{p}sc0",
            f"SELECT s.doc_id, s.sent_idx, s.n_sent, s.n_words, "
            f"CASE WHEN ps.sw2 > 0 THEN ps.sw / sqrt(ps.sw2) ELSE 0 END / (s.n_words + 1) AS raw, "
            f"max(CASE WHEN ps.sw2 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY s.doc_id) AS ok "
            f"FROM sents s LEFT JOIN {p}ps ps USING (doc_id, sent_idx) WHERE {where.replace('n_sent', 's.n_sent')}",
        ),
        (
            f"{p}sc",
            f"SELECT doc_id, sent_idx, n_sent, n_words, raw, ok, "
            f"CASE WHEN ok = 1 THEN raw ELSE 1.0 / n_sent END AS score, "
            f"CASE WHEN ok = 1 THEN (CASE WHEN max(raw) OVER (PARTITION BY doc_id) > 0 "
            f"THEN raw / max(raw) OVER (PARTITION BY doc_id) ELSE raw END) ELSE 1.0 / n_sent END AS feature, "
            f"CASE WHEN ok = 1 THEN 'ok' ELSE 'no_vocabulary' END AS status FROM {p}sc0",
        ),
    ]


def textrank_ctes(where: str, prefix: str = "tr_", vectors: str | None = None):
    """PageRank over L2-normalised TF-IDF rows (min_df = 1) through S = W W^T
    without forming pairs: one recursion step an iteration, and a document takes
    part until its own sum|x' - x| < n * tol or the last iteration.  A document
    that does not get there has the uniform 1/n (``final``).  ``vectors``: a query of
    other weights (doc_id, sent_idx, term, w) to build the graph from."""
    p = prefix
    cfg = C.DEFAULT
    ctes = tfidf_ctes(cfg.min_df_hybrid, where, prefix=p)[:4] if vectors is None else [(f"{p}wt", vectors)]
    ctes += [
        (f"{p}vec", f"SELECT doc_id, sent_idx, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, sent_idx)) AS v FROM {p}wt"),
        (f"{p}tdf", f"SELECT doc_id, term, count(*) AS c, sum(v) AS colsum FROM {p}vec GROUP BY ALL"),
        (
            f"{p}node",
            f"SELECT s.doc_id, s.sent_idx, s.n_sent, "
            f"coalesce(sum(v.v * t.colsum), 0) - coalesce(sum(v.v * v.v), 0) AS d, coalesce(sum(v.v * v.v), 0) AS diag, "
            f"coalesce(max(CASE WHEN t.c >= 2 THEN 1 ELSE 0 END), 0) = 0 AS dangling "
            f"FROM sents s LEFT JOIN {p}vec v USING (doc_id, sent_idx) LEFT JOIN {p}tdf t USING (doc_id, term) "
            f"WHERE {where.replace('n_sent', 's.n_sent')} GROUP BY ALL",
        ),
    ]
    step = (
        f"WITH y AS (SELECT n.doc_id, n.sent_idx, n.n_sent, n.diag, n.dangling, q.x, q.t, "
        f"CASE WHEN n.dangling THEN 0 ELSE q.x / n.d END AS y FROM {p}it q JOIN {p}node n USING (doc_id, sent_idx) "
        f"WHERE NOT q.done AND q.t < {cfg.max_iter}), "
        f"u AS (SELECT v.doc_id, v.term, sum(y.y * v.v) AS u FROM {p}vec v JOIN y USING (doc_id, sent_idx) GROUP BY ALL), "
        f"g AS (SELECT v.doc_id, v.sent_idx, sum(v.v * u.u) AS xs FROM {p}vec v JOIN u USING (doc_id, term) GROUP BY ALL), "
        f"m AS (SELECT doc_id, sum(CASE WHEN dangling THEN x ELSE 0 END) AS dm FROM y GROUP BY doc_id), "
        f"z AS (SELECT y.doc_id, y.sent_idx, y.n_sent, y.t, y.x AS old, {cfg.damping} * ("
        f"CASE WHEN y.dangling THEN 0 ELSE coalesce(g.xs, 0) - y.y * y.diag END + m.dm / y.n_sent) "
        f"+ (1 - {cfg.damping}) / y.n_sent AS x "
        f"FROM y JOIN m USING (doc_id) LEFT JOIN g USING (doc_id, sent_idx)) "
        f"SELECT doc_id, sent_idx, n_sent, x, t + 1 AS t, "
        f"sum(abs(x - old)) OVER (PARTITION BY doc_id) < n_sent * CAST({cfg.tol} AS DOUBLE) AS done FROM z"
    )
    ctes += [
        (f"{p}it", f"SELECT doc_id, sent_idx, n_sent, CAST(1.0 AS DOUBLE) / n_sent AS x, 0 AS t, FALSE AS done FROM {p}node "
                   f"UNION ALL ({step})"),
        # a document leaves the recursion with its last step, where the rows of the last t are its scores
        (f"{p}last", f"SELECT *, max(t) OVER (PARTITION BY doc_id) AS stop FROM {p}it"),
        (f"{p}final", f"SELECT doc_id, sent_idx, n_sent, x AS textrank, done AS converged, t AS iterations "
                      f"FROM {p}last WHERE t = stop"),
        (f"{p}feat", f"SELECT doc_id, sent_idx, CASE WHEN NOT converged THEN 1.0 / n_sent "
                     f"WHEN max(textrank) OVER (PARTITION BY doc_id) > 0 "
                     f"THEN textrank / max(textrank) OVER (PARTITION BY doc_id) ELSE textrank END AS feature FROM {p}final"),
    ]
    return ctes


def ranked_cte(name: str, scores: str, score_col: str, k: int = K):
    return (
        name,
        f"SELECT doc_id, sent_idx, row_number() OVER (PARTITION BY doc_id ORDER BY round({score_col}, 9) DESC, "
        f"sent_idx DESC) AS rank FROM {scores}",
    )


def summary_body(ranked: str, out: str = "summary", k: int = K, extra: str = "") -> str:
    return (
        f"SELECT d.doc_id{extra}, CAST(len(d.sentences) AS INTEGER) AS n_sent, "
        f"CASE WHEN len(d.sentences) <= {k} THEN array_to_string(d.sentences, ' ') "
        f"ELSE coalesce(array_to_string(list_transform(p.idx, lambda i: d.sentences[i + 1]), ' '), '') END AS {out} "
        f"FROM docs d LEFT JOIN (SELECT doc_id, list(sent_idx ORDER BY sent_idx) AS idx FROM {ranked} "
        f"WHERE rank <= {k} GROUP BY doc_id) p USING (doc_id)"
    )


def q_sentences():
    return with_(docs_cte(), sents_cte(), body="SELECT doc_id, sent_idx, sentence, n_sent FROM sents")


def q_sentence_lengths():
    return with_(
        docs_cte(),
        sents_cte(),
        body="SELECT doc_id, sent_idx, n_words, round(n_words / greatest(avg(n_words) OVER (PARTITION BY doc_id), 1.0), 6) "
        "AS norm_length FROM sents",
    )


def q_sentence_positions():
    return with_(
        docs_cte(),
        sents_cte(),
        body="SELECT doc_id, sent_idx, round(sent_idx / greatest(n_sent - 1, 1), 6) AS position FROM sents",
    )


def q_terms():
    return with_(
        docs_cte(),
        sents_cte(),
        body=f"SELECT doc_id, sent_idx, term FROM (SELECT doc_id, sent_idx, unnest({S.terms('sentence')}) AS term "
        f"FROM sents) WHERE term NOT IN {S.stop_list()}",
    )


def _tfidf(min_df, body, where="TRUE"):
    return with_(docs_cte(), sents_cte(), *tfidf_ctes(min_df, where), body=body)


def q_term_freq():
    return _tfidf(2, "SELECT doc_id, sent_idx, term, tf FROM tf")


def q_doc_freq():
    return _tfidf(2, "SELECT DISTINCT doc_id, term, df FROM dfq")


def q_pruned_vocab():
    return _tfidf(2, "SELECT DISTINCT doc_id, term, df FROM wt")


def q_tfidf_weights():
    return _tfidf(
        2,
        "SELECT doc_id, sent_idx, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, sent_idx)), 6) AS weight FROM wt",
    )


def q_tfidf_scores():
    return _tfidf(2, "SELECT doc_id, sent_idx, round(score, 6) AS score, status FROM sc")


def q_tfidf_feature():
    return _tfidf(1, "SELECT doc_id, sent_idx, round(feature, 6) AS tfidf_feature FROM sc")


def q_top_sentences():
    return with_(
        docs_cte(), sents_cte(), *tfidf_ctes(2, "n_sent > 0"), ranked_cte("rk", "sc", "score"),
        body=f"SELECT doc_id, sent_idx, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= {K}",
    )


def q_summaries_tfidf():
    return with_(
        docs_cte(), sents_cte(), *tfidf_ctes(2, f"n_sent > {K}"), ranked_cte("rk", "sc", "score"),
        body=summary_body("rk"),
    )


def q_summaries_lead():
    return with_(
        docs_cte(),
        body=f"SELECT doc_id, CAST(len(sentences) AS INTEGER) AS n_sent, array_to_string(sentences[1:{K}], ' ') AS summary FROM docs",
    )


def q_textrank_scores():
    return with_(
        docs_cte(), sents_cte(), *textrank_ctes("n_sent > 0"),
        body="SELECT doc_id, sent_idx, round(textrank, 7) AS textrank, converged FROM tr_final",
    )


def q_summaries_textrank():
    return with_(
        docs_cte(), sents_cte(), *textrank_ctes(f"n_sent > {K}"), ranked_cte("rk", "tr_final", "textrank"),
        body=summary_body("rk"),
    )


def q_textrank_feature():
    return with_(
        docs_cte(), sents_cte(), *textrank_ctes("n_sent > 0"),
        body="SELECT doc_id, sent_idx, round(feature, 6) AS textrank_feature FROM tr_feat",
    )


def q_summaries_side_by_side():
    return with_(
        docs_cte(), sents_cte(), *tfidf_ctes(2, f"n_sent > {K}"), ranked_cte("rk", "sc", "score"),
        *textrank_ctes(f"n_sent > {K}"), ranked_cte("rk2", "tr_final", "textrank"),
        ("a", summary_body("rk", "tfidf_summary")),
        ("b", summary_body("rk2", "textrank_summary")),
        body=f"SELECT a.doc_id, a.n_sent, a.tfidf_summary, b.textrank_summary, "
        f"array_to_string(d.sentences[1:{K}], ' ') AS lead_summary FROM a JOIN b USING (doc_id) JOIN docs d USING (doc_id)",
    )


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


# --- T: cleaning ------------------------------------------------------------------

INJECTED = (
    "inj",
    "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '(CNN) -- ' || text "
    "WHEN 1 THEN 'LONDON, England (Reuters) -- ' || text "
    "WHEN 2 THEN text || ' http://ex.org/' || CAST(doc_id AS VARCHAR) || '?a=1 end.' "
    "WHEN 3 THEN 'Editor''s note: v' || CAST(doc_id AS VARCHAR) || '. ' || text "
    "WHEN 4 THEN text || ' Copyright 2009 Reuters. All rights reserved.' "
    "ELSE text || ' Read more.' END AS text FROM documents",
)


def _tq(fn):
    return lambda: with_(INJECTED, body=f"SELECT doc_id, {fn('text')} AS text FROM inj")


def q_html_to_text():
    return f"SELECT page_id, {S.normalize(S.html_to_text('html'))} AS text FROM pages"


def q_word_count():
    return f"SELECT doc_id, {S.word_count('text')} AS words FROM documents"


def q_text_stats():
    return (
        f"SELECT doc_id, {S.word_count('text')} AS words, "
        f"CAST(len({S.split_sentences('text')}) AS INTEGER) AS sentences FROM documents"
    )


def _tfidf_summaries_cte():
    return [
        docs_cte(), sents_cte(), *tfidf_ctes(2, f"n_sent > {K}"), ranked_cte("rk", "sc", "score"),
        ("summ", summary_body("rk", extra="")),
        ("st", "SELECT s.doc_id, d.text, s.summary FROM summ s JOIN documents d USING (doc_id)"),
    ]


def q_compression_ratio():
    w, sw = S.word_count("text"), S.word_count("summary")
    return with_(
        *_tfidf_summaries_cte(),
        body=f"SELECT doc_id, {w} AS words, {sw} AS summary_words, "
        f"round(CASE WHEN {w} > 0 THEN (1.0 - {sw} / {w}) * 100.0 ELSE 0.0 END, 6) AS ratio FROM st",
    )


def _log_select(src):
    n = C.DEFAULT.preview_chars
    return (
        f"SELECT doc_id AS seq, substr(coalesce(text, ''), 1, {n}) || '...' AS preview, summary, "
        f"'TF-IDF' AS model, {K} AS k FROM {src}"
    )


def q_summary_log():
    return with_(*_tfidf_summaries_cte(), body=_log_select("st"))


def q_recent_summaries():
    return with_(
        *_tfidf_summaries_cte(),
        ("lg", _log_select("st")),
        body="SELECT *, (SELECT count(*) FROM lg) AS total, "
        "CAST(row_number() OVER (ORDER BY seq DESC) AS INTEGER) AS position FROM "
        "(SELECT * FROM lg ORDER BY seq DESC LIMIT 5)",
    )


# --- R: corpus ----------------------------------------------------------------------

CORPUS = (
    "corpus",
    f"SELECT doc_id, text AS article, coalesce(({S.split_sentences('text')})[1], '') AS highlights FROM documents",
)
CLEANED = (
    "cleaned",
    f"SELECT doc_id, {S.clean_text('article', False)} AS article, {S.clean_text('highlights', True)} AS highlights FROM corpus",
)
NONBLANK = ("nonblank", "SELECT * FROM cleaned WHERE trim(article) <> '' AND trim(highlights) <> ''")
LENGTH = (
    "lengthok",
    f"SELECT * FROM nonblank WHERE {S.word_count('article')} >= {C.DEFAULT.min_article_words} "
    f"AND {S.word_count('highlights')} >= {C.DEFAULT.min_summary_words} "
    f"AND {S.word_count('article')} <= {C.DEFAULT.max_article_words}",
)


def q_corpus_scan():
    return with_(CORPUS, body="SELECT * FROM corpus")


def q_drop_blank():
    return with_(CORPUS, CLEANED, NONBLANK, body="SELECT * FROM nonblank")


def q_length_filter():
    return with_(CORPUS, CLEANED, NONBLANK, LENGTH, body="SELECT * FROM lengthok")


def q_dedup_keep_first():
    return with_(
        CORPUS,
        body="SELECT doc_id, article FROM corpus WHERE doc_id IN (SELECT min(doc_id) FROM corpus GROUP BY article)",
    )


def q_clean_corpus():
    return with_(
        CORPUS, CLEANED, NONBLANK, LENGTH,
        body="SELECT * FROM lengthok WHERE doc_id IN (SELECT min(doc_id) FROM lengthok GROUP BY article)",
    )


def q_sample_n():
    return with_(
        CORPUS,
        body="SELECT doc_id, article FROM corpus ORDER BY md5(CAST(doc_id AS VARCHAR) || '-42'), doc_id LIMIT 200",
    )


REGISTRY.update({
    "html_to_text": q_html_to_text,
    "strip_urls": _tq(S.strip_urls),
    "strip_news_prefix": _tq(S.strip_news_prefix),
    "strip_editor_note": _tq(S.strip_editor_note),
    "strip_copyright": _tq(S.strip_copyright),
    "strip_promo": _tq(S.strip_promo),
    "fix_punct_spacing": _tq(S.fix_punct_spacing),
    "normalize_ws": _tq(S.normalize),
    "clean_article": _tq(lambda c: S.clean_text(c, False)),
    "clean_summary": _tq(lambda c: S.clean_text(c, True)),
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

CONV_PAIRS = (
    "cp",
    "SELECT b.conv_id * 4294967296 + b.turn AS doc_id, b.text AS article, a.text AS highlights "
    "FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn "
    "WHERE a.role = 'user' AND b.role = 'assistant'",
)


def stem_list(x: str) -> str:
    return f"list_transform({x}, lambda tk: {rouge_stem_sql('tk', 'duckdb')})"


def prediction_ctes():
    return [
        CONV_PAIRS,
        docs_cte("cp", "doc_id", "article"), sents_cte(),
        *tfidf_ctes(2, f"n_sent > {K}"), ranked_cte("rk", "sc", "score"),
        *textrank_ctes(f"n_sent > {K}"), ranked_cte("rk2", "tr_final", "textrank"),
        ("pa", summary_body("rk", "tfidf_summary")),
        ("pb", summary_body("rk2", "textrank_summary")),
        ("pred", f"SELECT cp.doc_id, cp.highlights, pa.tfidf_summary, pb.textrank_summary, "
                 f"array_to_string(d.sentences[1:{K}], ' ') AS lead_summary "
                 f"FROM cp JOIN pa USING (doc_id) JOIN pb USING (doc_id) JOIN docs d USING (doc_id)"),
    ]


def rouge_ctes(src: str, keys: list[str], ref: str, pred: str):
    """Per pair: rouge_1/2 (p, r, f) and rouge_l via a recursive LCS."""
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    bi = lambda t: f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"
    return [
        ("pp", f"SELECT {k}, {stem_list(S.rouge_tokens(ref))} AS rt, {stem_list(S.rouge_tokens(pred))} AS pt FROM {src}"),
        ("gr", f"SELECT {k}, 1 AS n, unnest(rt) AS g, 1 AS r, 0 AS p FROM pp "
               f"UNION ALL SELECT {k}, 1, unnest(pt), 0, 1 FROM pp "
               f"UNION ALL SELECT {k}, 2, unnest({bi('rt')}), 1, 0 FROM pp "
               f"UNION ALL SELECT {k}, 2, unnest({bi('pt')}), 0, 1 FROM pp"),
        ("ovg", f"SELECT {k}, n, g, sum(r) AS cr, sum(p) AS cq FROM gr GROUP BY ALL"),
        ("ov", f"SELECT {k}, n, sum(least(cr, cq)) AS ov FROM ovg GROUP BY ALL"),
        ("mt", f"SELECT {k}, i, j FROM (SELECT {k}, rt, pt, generate_subscripts(rt, 1) AS i FROM pp) x, "
               f"LATERAL (SELECT generate_subscripts(x.pt, 1) AS j) y WHERE x.rt[i] = x.pt[j]"),
        ("nums", f"SELECT pp.{keys[0]}" + "".join(f", pp.{c}" for c in keys[1:]) + ", "
                 "len(rt) AS rc1, len(pt) AS pc1, greatest(len(rt) - 1, 0) AS rc2, greatest(len(pt) - 1, 0) AS pc2, "
                 "coalesce(o1.ov, 0) AS ov1, coalesce(o2.ov, 0) AS ov2 FROM pp "
                 f"LEFT JOIN ov o1 ON {on('o1', 'pp')} AND o1.n = 1 LEFT JOIN ov o2 ON {on('o2', 'pp')} AND o2.n = 2"),
    ]


LCS_CTE = """lcs AS (
  WITH RECURSIVE f({k}, lvl, i, j) AS (
    SELECT {k}, 1, i, min(j) FROM mt GROUP BY {k}, i
    UNION ALL
    SELECT {mk}, f.lvl + 1, mt.i, min(mt.j) FROM f JOIN mt ON {on} AND mt.i > f.i AND mt.j > f.j
    GROUP BY {mk}, f.lvl + 1, mt.i
  ) SELECT {k}, max(lvl) AS lcs FROM f GROUP BY {k}
)"""


def rouge_final(keys: list[str]) -> str:
    k = ", ".join(keys)
    lcs = LCS_CTE.format(k=k, mk=", ".join(f"mt.{c}" for c in keys), on=" AND ".join(f"mt.{c} = f.{c}" for c in keys))
    on = " AND ".join(f"l.{c} = n.{c}" for c in keys)
    def f(p, r):
        return f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0 END"
    p1, r1 = "CASE WHEN pc1 > 0 THEN ov1 / pc1 ELSE 0.0 END", "CASE WHEN rc1 > 0 THEN ov1 / rc1 ELSE 0.0 END"
    p2, r2 = "CASE WHEN pc2 > 0 THEN ov2 / pc2 ELSE 0.0 END", "CASE WHEN rc2 > 0 THEN ov2 / rc2 ELSE 0.0 END"
    pl = "CASE WHEN pc1 > 0 AND rc1 > 0 THEN coalesce(l.lcs, 0) / pc1 ELSE 0.0 END"
    rl = "CASE WHEN pc1 > 0 AND rc1 > 0 THEN coalesce(l.lcs, 0) / rc1 ELSE 0.0 END"
    return (
        f", {lcs},\nscores AS (SELECT " + ", ".join(f"n.{c}" for c in keys) + ", "
        f"{p1} AS rouge_1_p, {r1} AS rouge_1_r, {f(p1, r1)} AS rouge_1, "
        f"{p2} AS rouge_2_p, {r2} AS rouge_2_r, {f(p2, r2)} AS rouge_2, "
        f"{pl} AS rouge_l_p, {rl} AS rouge_l_r, {f(pl, rl)} AS rouge_l FROM nums n LEFT JOIN lcs l ON {on})\n"
    )


def _rouge_query(body: str, src="pred", keys=("doc_id",), ref="highlights", pred="tfidf_summary", extra=()):
    keys = list(keys)
    head = with_(*prediction_ctes(), *extra, *rouge_ctes(src, keys, ref, pred), body="")
    return head.rstrip("\n") + rouge_final(keys) + body


def q_rouge_tokens():
    return (
        f"SELECT conv_id, turn, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS token "
        f"FROM (SELECT conv_id, turn, {S.rouge_tokens('text')} AS t FROM conversations)"
    )


def q_token_stems():
    return (
        f"SELECT token, {stem_sql('token', 'duckdb')} AS stem FROM "
        f"(SELECT DISTINCT unnest({S.rouge_tokens('text')}) AS token FROM conversations)"
    )


def q_ngram_counts():
    t = f"{stem_list(S.rouge_tokens('text'))}"
    return (
        f"WITH tk AS (SELECT conv_id, turn, {t} AS t FROM conversations), "
        f"g AS (SELECT conv_id, turn, 1 AS n, unnest(t) AS ngram FROM tk UNION ALL "
        f"SELECT conv_id, turn, 2, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM tk) "
        f"SELECT conv_id, turn, n, ngram, count(*) AS cnt FROM g GROUP BY ALL"
    )


def q_rouge_1():
    return _rouge_query("SELECT doc_id, round(rouge_1_p, 6) AS p, round(rouge_1_r, 6) AS r, round(rouge_1, 6) AS f FROM scores")


def q_rouge_2():
    return _rouge_query("SELECT doc_id, round(rouge_2_p, 6) AS p, round(rouge_2_r, 6) AS r, round(rouge_2, 6) AS f FROM scores")


def q_rouge_l():
    return _rouge_query("SELECT doc_id, round(rouge_l_p, 6) AS p, round(rouge_l_r, 6) AS r, round(rouge_l, 6) AS f FROM scores")


def q_evaluate_tfidf():
    return _rouge_query(
        "SELECT round(avg(rouge_1), 6) AS rouge_1, round(avg(rouge_2), 6) AS rouge_2, round(avg(rouge_l), 6) AS rouge_l FROM scores"
    )


def q_compare_models():
    long = ("lng", "SELECT doc_id, highlights, 'TF-IDF' AS model, tfidf_summary AS prediction FROM pred UNION ALL "
                   "SELECT doc_id, highlights, 'TextRank', textrank_summary FROM pred UNION ALL "
                   "SELECT doc_id, highlights, 'Lead', lead_summary FROM pred")
    return _rouge_query(
        "SELECT model, round(avg(rouge_1), 6) AS rouge_1, round(avg(rouge_2), 6) AS rouge_2, "
        "round(avg(rouge_l), 6) AS rouge_l FROM scores GROUP BY model",
        src="lng", keys=("doc_id", "model"), pred="prediction", extra=(long,),
    )


REGISTRY.update({
    "rouge_tokens": q_rouge_tokens,
    "token_stems": q_token_stems,
    "ngram_counts": q_ngram_counts,
    "rouge_1": q_rouge_1,
    "rouge_2": q_rouge_2,
    "rouge_l": q_rouge_l,
    "evaluate_tfidf": q_evaluate_tfidf,
    "compare_models": q_compare_models,
})


# --- M: features, labels, scaler ---------------------------------------------------------

FEATS = ("tfidf", "textrank", "position", "length", "norm_length")


def feature_ctes(src_docs):
    return [
        *src_docs, sents_cte(), *tfidf_ctes(1, "n_sent > 0"), *textrank_ctes("n_sent > 0"),
        ("feat", "SELECT sc.doc_id, sc.sent_idx, sc.n_sent, sc.feature AS tfidf, "
                 "t.feature AS textrank, "
                 "sc.sent_idx / greatest(sc.n_sent - 1, 1) AS position, CAST(sc.n_words AS DOUBLE) AS length, "
                 "sc.n_words / greatest(avg(sc.n_words) OVER (PARTITION BY sc.doc_id), 1.0) AS norm_length "
                 "FROM sc JOIN tr_feat t USING (doc_id, sent_idx)"),
    ]


def label_ctes():
    return [
        ("lrt", f"SELECT doc_id, {stem_list(S.rouge_tokens('highlights'))} AS t FROM cp"),
        ("lst", f"SELECT doc_id, sent_idx, {stem_list(S.rouge_tokens('sentence'))} AS t FROM sents"),
        ("lrc", "SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest(t) AS g FROM lrt) GROUP BY ALL"),
        ("lsc", "SELECT doc_id, sent_idx, g, count(*) AS c FROM (SELECT doc_id, sent_idx, unnest(t) AS g FROM lst) GROUP BY ALL"),
        ("lov", "SELECT s.doc_id, s.sent_idx, sum(least(s.c, coalesce(r.c, 0))) AS ov FROM lsc s "
                "LEFT JOIN lrc r USING (doc_id, g) GROUP BY ALL"),
        ("lres", "SELECT st.doc_id, st.sent_idx, len(st.t) AS pl, len(rt.t) AS rl, coalesce(lov.ov, 0) AS ov "
                 "FROM lst st JOIN lrt rt USING (doc_id) LEFT JOIN lov USING (doc_id, sent_idx)"),
        ("lf", "SELECT doc_id, sent_idx, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM "
               "(SELECT doc_id, sent_idx, CASE WHEN pl > 0 THEN ov / pl ELSE 0.0 END AS p, "
               "CASE WHEN rl > 0 THEN ov / rl ELSE 0.0 END AS r FROM lres)"),
        ("lab", f"SELECT doc_id, sent_idx, f AS rouge_1, CAST(f > {C.DEFAULT.label_threshold} AS DOUBLE) AS label FROM lf"),
    ]


def ts_ctes():
    return [
        *feature_ctes([CONV_PAIRS, docs_cte("cp", "doc_id", "article")]), *label_ctes(),
        ("ts", "SELECT f.*, l.label FROM feat f JOIN lab l USING (doc_id, sent_idx) JOIN cp USING (doc_id) "
               f"WHERE {S.normalize('cp.highlights')} <> ''"),
    ]


def _r6(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


def q_sentence_features():
    return with_(*feature_ctes([docs_cte()]), body=f"SELECT doc_id, sent_idx, {_r6(FEATS)} FROM feat")


def q_weak_labels():
    return with_(CONV_PAIRS, docs_cte("cp", "doc_id", "article"), sents_cte(), *label_ctes(),
                 body="SELECT doc_id, sent_idx, round(rouge_1, 6) AS rouge_1, label FROM lab")


def q_training_set():
    return with_(*ts_ctes(), body=f"SELECT doc_id, sent_idx, {_r6(FEATS)}, label FROM ts")


def q_class_balance():
    return with_(*ts_ctes(), body="SELECT count(*) AS total, CAST(sum(label) AS BIGINT) AS positives, "
                 "CAST(count(*) - sum(label) AS BIGINT) AS negatives, round(avg(label) * 100.0, 6) AS positive_pct FROM ts")


def _scaler_long():
    parts = [f"SELECT '{c}' AS feature, min({c}) AS data_min, max({c}) AS data_max FROM ts" for c in FEATS]
    return ("sl", " UNION ALL ".join(parts))


def q_scaler_fit():
    return with_(*ts_ctes(), _scaler_long(), body=(
        "SELECT feature, round(data_min, 6) AS data_min, round(data_max, 6) AS data_max, "
        "round(data_max - data_min, 6) AS data_range, "
        "round(1.0 / CASE WHEN data_max - data_min = 0 THEN 1.0 ELSE data_max - data_min END, 6) AS scale, "
        "round(-data_min * (1.0 / CASE WHEN data_max - data_min = 0 THEN 1.0 ELSE data_max - data_min END), 6) + 0.0 AS min "
        "FROM sl"))


def q_scaler_transform():
    agg = ", ".join(f"min({c}) AS mn_{c}, 1.0 / CASE WHEN max({c}) - min({c}) = 0 THEN 1.0 ELSE max({c}) - min({c}) END AS sc_{c}" for c in FEATS)
    cols = ", ".join(f"round(ts.{c} * a.sc_{c} + (-a.mn_{c} * a.sc_{c}), 6) AS {c}" for c in FEATS)
    return with_(*ts_ctes(), ("agg", f"SELECT {agg} FROM ts"),
                 body=f"SELECT ts.doc_id, ts.sent_idx, {cols} FROM ts, agg a")


def q_train_val_split():
    return with_(CONV_PAIRS, body=(
        "SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4)) AS INTEGER) < "
        f"{int(round(C.DEFAULT.validation_split * 65536))} AS is_val FROM cp"))


REGISTRY.update({
    "sentence_features": q_sentence_features,
    "weak_labels": q_weak_labels,
    "training_set": q_training_set,
    "class_balance": q_class_balance,
    "scaler_fit": q_scaler_fit,
    "scaler_transform": q_scaler_transform,
    "train_val_split": q_train_val_split,
})


# --- G on dense vectors -------------------------------------------------------------------

def q_similarity_degree():
    return (
        "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), "
        "en AS (SELECT vec_id, label, CASE WHEN sqrt(list_dot_product(v, v)) > 0 "
        "THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) "
        "ELSE list_transform(v, lambda x: x * 0.0) END AS u FROM e) "
        "SELECT a.label, a.vec_id, round(coalesce(sum(list_dot_product(a.u, b.u)), 0), 6) + 0.0 AS degree "
        "FROM en a LEFT JOIN en b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label, a.vec_id"
    )


def q_pagerank_embeddings():
    cfg = C.DEFAULT
    return f"""
WITH RECURSIVE e AS (
  SELECT label, vec_id, list_transform(embedding, lambda x: greatest(CAST(x AS DOUBLE), 0.0)) AS v FROM embeddings
), en AS (
  SELECT label, vec_id, CASE WHEN list_dot_product(v, v) > 0 THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))
                        ELSE v END AS u, count(*) OVER (PARTITION BY label) AS n FROM e
), s AS (
  SELECT a.label, a.vec_id AS i, b.vec_id AS j, list_dot_product(a.u, b.u) AS w
  FROM en a JOIN en b ON a.label = b.label AND a.vec_id <> b.vec_id
), node AS (
  SELECT en.label, en.vec_id, en.n, coalesce(sum(s.w), 0) AS d FROM en LEFT JOIN s ON s.label = en.label AND s.i = en.vec_id
  GROUP BY ALL
), it AS (
  SELECT label, vec_id, n, CAST(1.0 AS DOUBLE) / n AS x, 0 AS t, FALSE AS done FROM node
  UNION ALL (
    WITH y AS (
      SELECT it.*, d, CASE WHEN d > 0 THEN x / d ELSE 0 END AS y FROM it JOIN node USING (label, vec_id, n)
      WHERE NOT done AND t < {cfg.max_iter}
    ), g AS (
      SELECT s.label, s.j AS vec_id, sum(y.y * s.w) AS xs FROM s JOIN y ON y.label = s.label AND y.vec_id = s.i GROUP BY ALL
    ), m AS (
      SELECT label, sum(CASE WHEN d > 0 THEN 0 ELSE x END) AS dm FROM y GROUP BY label
    ), z AS (
      SELECT y.label, y.vec_id, y.n, y.t, y.x AS old,
             {cfg.damping} * (CASE WHEN y.d > 0 THEN coalesce(g.xs, 0) ELSE 0 END + m.dm / y.n) + (1 - {cfg.damping}) / y.n AS x
      FROM y JOIN m USING (label) LEFT JOIN g USING (label, vec_id)
    )
    SELECT label, vec_id, n, x, t + 1 AS t,
           sum(abs(x - old)) OVER (PARTITION BY label) < n * CAST({cfg.tol} AS DOUBLE) AS done FROM z
  )
), fin AS (
  SELECT *, max(t) OVER (PARTITION BY label) AS stop FROM it
)
SELECT label, vec_id, round(CASE WHEN done THEN x ELSE 1.0 / n END, 7) AS pagerank, done AS converged, t AS iterations
FROM fin WHERE t = stop
"""


def q_sentence_vectors():
    return _tfidf(1, "SELECT doc_id, sent_idx, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, sent_idx)), 6) AS weight FROM wt")


REGISTRY.update({
    "similarity_degree": q_similarity_degree,
    "pagerank_embeddings": q_pagerank_embeddings,
    "sentence_vectors": q_sentence_vectors,
})


# --- G on documents: dense vectors, strongest neighbours -----------------------------------

def shape_vectors(where: str) -> str:
    """The non-zeros of the sentences' vectors: how many words have 1, 2, ... 12 or more letters."""
    return (
        "SELECT doc_id, sent_idx, least(length(w), 12) AS term, count(*) AS w FROM "
        f"(SELECT doc_id, sent_idx, unnest(string_split(sentence, ' ')) AS w FROM sents WHERE {where}) "
        "WHERE length(w) > 0 GROUP BY ALL"
    )


DENSE_FINAL = ("dv", "SELECT doc_id, sent_idx, n_sent, converged, CASE WHEN converged THEN textrank ELSE 1.0 / n_sent END AS textrank "
                     "FROM tr_final")


def q_textrank_vectors():
    return with_(
        docs_cte(), sents_cte(), *textrank_ctes("n_sent > 0", vectors=shape_vectors("n_sent > 0")), DENSE_FINAL,
        body="SELECT doc_id, sent_idx, round(textrank, 7) AS textrank, converged FROM dv",
    )


def q_summaries_textrank_vectors():
    w = f"n_sent > {K}"
    return with_(docs_cte(), sents_cte(), *textrank_ctes(w, vectors=shape_vectors(w)), DENSE_FINAL,
                 ranked_cte("rk", "dv", "textrank"), body=summary_body("rk"))


def q_strongest_neighbours():
    return with_(
        docs_cte(), sents_cte(), *textrank_ctes("n_sent > 0")[:5],
        ("sim", "SELECT a.doc_id, a.sent_idx, b.sent_idx AS neighbour, sum(a.v * b.v) AS similarity FROM tr_vec a "
                "JOIN tr_vec b ON a.doc_id = b.doc_id AND a.term = b.term AND a.sent_idx <> b.sent_idx GROUP BY ALL"),
        ("best", "SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY round(similarity, 9) DESC, neighbour) AS INTEGER) "
                 "AS rank FROM sim"),
        body="SELECT doc_id, sent_idx, rank, neighbour, round(similarity, 6) AS similarity FROM best WHERE rank <= 5",
    )


# --- M on fixed weights ---------------------------------------------------------------------

def importance_cte(src: str = "feat"):
    """The forward pass of the fixed network over scaled features, layer by layer."""
    model = fixed_model()
    cols = ", ".join(f"{c} * {s!r} + {m!r}" for c, s, m in zip(FEATS, model.scaler["scale"], model.scaler["min"]))
    step = f"SELECT *, [{cols}]::DOUBLE[] AS x0 FROM {src}"
    for n, layer in enumerate(model.network.layers):
        rows = "[" + ", ".join("{'w': [" + ", ".join(map(repr, w)) + f"]::DOUBLE[], 'b': {b!r}::DOUBLE}}" for w, b in zip(layer.weights, layer.bias)) + "]"
        z = f"list_dot_product(r.w, x{n}) + r.b"
        z = f"greatest({z}, 0.0)" if layer.activation == "relu" else f"1.0 / (1.0 + exp(-({z})))"
        step = f"SELECT *, list_transform({rows}, lambda r: {z}) AS x{n + 1} FROM ({step})"
    return ("imp", f"SELECT *, x{len(model.network.layers)}[1] AS importance FROM ({step})")


def q_predict_importance():
    return with_(*feature_ctes([docs_cte()]), importance_cte(), body="SELECT doc_id, sent_idx, round(importance, 6) AS importance FROM imp")


def q_summaries_hybrid():
    status = f", CASE WHEN n_sent = 0 THEN 'empty' WHEN n_sent <= {K} THEN 'whole' ELSE 'scored' END AS status"
    return with_(*feature_ctes([docs_cte()]), importance_cte(), ranked_cte("rk", "imp", "importance"), ("s", summary_body("rk")),
                 body=f"SELECT *{status} FROM s")


def q_training_metrics():
    val = (f"CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4)) AS INTEGER) < {int(round(C.DEFAULT.validation_split * 65536))}")
    p = "CASE WHEN label = 1 THEN importance ELSE 1 - importance END"
    return with_(
        *ts_ctes(), importance_cte("ts"),
        ("sc_", f"SELECT CASE WHEN {val} THEN 'validation' ELSE 'train' END AS split, label, importance FROM imp"),
        ("g", "SELECT split, importance, sum(label) AS pos, sum(1 - label) AS neg FROM sc_ GROUP BY ALL"),
        ("b", "SELECT *, coalesce(sum(neg) OVER (PARTITION BY split ORDER BY importance ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
              "AS below FROM g"),
        ("auc", "SELECT split, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM b GROUP BY split"),
        body="SELECT split, round(avg(CASE WHEN (importance >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, "
             f"round(any_value(auc.auc), 6) AS auc, round(avg(-ln(greatest({p}, 1e-15))), 6) AS loss FROM sc_ JOIN auc USING (split) GROUP BY split",
    )


def q_compare_all_models():
    hybrid = feature_ctes([])[1:]  # documents and sentences are those of the predictions
    hybrid = [(n, q) for n, q in hybrid if n == "feat"]
    long = " UNION ALL ".join(f"SELECT doc_id, highlights, '{m}' AS model, {c} AS prediction FROM allp" for m, c in (
        ("TF-IDF", "tfidf_summary"), ("TextRank", "textrank_summary"), (C.MODEL_NAMES["hybrid"], "hybrid_summary"), ("Lead", "lead_summary")))
    base = [(n, q) for n, q in prediction_ctes() if n not in {c[0] for c in textrank_ctes("TRUE")} and n not in {c[0] for c in tfidf_ctes(2)}]
    head, rest = base[:3], base[3:]
    # one set of scores over all sentences: documents of at most K sentences are whole anyway
    plain = tfidf_ctes(2, prefix="p_")
    extra = [
        *tfidf_ctes(1), *textrank_ctes("n_sent > 0"), *hybrid, importance_cte(), ranked_cte("rk3", "imp", "importance"),
        ("pc", summary_body("rk3", "hybrid_summary")),
        ("allp", "SELECT pred.*, pc.hybrid_summary FROM pred JOIN pc USING (doc_id)"), ("lng", long),
    ]
    rest = [(n, q.replace("FROM sc", "FROM p_sc")) if n == "rk" else (n, q) for n, q in rest]
    order = [*head, *plain, *extra[:len(tfidf_ctes(1)) + len(textrank_ctes("TRUE"))], *rest, *extra[len(tfidf_ctes(1)) + len(textrank_ctes("TRUE")):]]
    keys = ["doc_id", "model"]
    sql = with_(*order, *rouge_ctes("lng", keys, "highlights", "prediction"), body="")
    return sql.rstrip("\n") + rouge_final(keys) + (
        "SELECT model, round(avg(rouge_1), 6) AS rouge_1, round(avg(rouge_2), 6) AS rouge_2, "
        "round(avg(rouge_l), 6) AS rouge_l FROM scores GROUP BY model")


REGISTRY.update({
    "textrank_vectors": q_textrank_vectors,
    "summaries_textrank_vectors": q_summaries_textrank_vectors,
    "strongest_neighbours": q_strongest_neighbours,
    "predict_importance": q_predict_importance,
    "summaries_hybrid": q_summaries_hybrid,
    "training_metrics": q_training_metrics,
    "compare_all_models": q_compare_all_models,
})


def oracle_sql() -> dict[str, str]:
    return {name: f() for name, f in REGISTRY.items()}
