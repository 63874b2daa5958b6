"""Inputs that once were lost, merged or fatal; stop rules; sources; restarts."""

import os

import pytest
from pyspark.sql import functions as F

from precis import config as C
from precis.functions import text as T
from precis.functions.porter import stem_sql
from precis.functions.sentences import split_sentences
from precis.operators import features, model, sentences, summarize, textrank
from precis.plans import queries as Q
from precis.session import checkpoint_dir
from precis.sources import io as S
from precis.streaming import summaries as ST
from tests.conftest import one

SF = "/root/testdata/sf0.001"

# word, stem: examples of the published algorithm (with the usual extensions for short -ies, -y and irregular forms)
STEMS = """caresses caress ponies poni ties tie caress caress cats cat feed feed agreed agre plastered plaster bled bled
motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss
fizzed fizz failing fail filing file happy happi relational relat conditional condit rational ration valenci valenc
hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope
callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form
formalize formal electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow
inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac
adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular
homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
skies sky dying die lying lie tying tie news news innings inning proceed proceed exceed exceed succeed succeed
running run runs run easily easili generally gener computers comput organization organ university univers universal univers
argument argument arguing argu argues argu argued argu caring care cared care cares care horses hors houses hous
studies studi studying studi studied studi flies fli died die dies die denied deni being be was wa a a is is""".split()


def test_stems_of_published_examples(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2]))
    assert len(pairs) >= 100
    df = spark.createDataFrame(pairs, "w string, s string").withColumn("got", F.expr(stem_sql("w")))
    assert [(r["w"], r["s"], r["got"]) for r in df.where("got <> s").collect()] == []


@pytest.mark.parametrize("text,want", [
    ("&#1114112; &#9999999; &#xD800; &#0; &#x110000;", "� � � � �"), ("&#x0000041;&#00000065;&#99999999999999999999;", "AA�"),
    ("&eacute;&hellip;&unknown; & &amp;lt; &amp;#65; AT&T &NotEqualTilde;", "é…&unknown; & &lt; &#65; AT&T ≂̸"), ("&", "&"), ("&#;&#x;", "&#;&#x;"),
])
def test_entities(spark, text, want):
    assert one(spark, T.decode_entities, text) == want


def test_unclosed_blocks(spark):
    assert one(spark, T.html_to_text, "<p>a</p><script>var a=1; tail").split() == ["a"]
    assert one(spark, T.html_to_text, "x<style>p{}</style>y<STYLE>z").split() == ["x", "y"]


def test_control_characters_are_text(spark):
    assert one(spark, split_sentences, "A\u0001 b\u0002 c. Next\u0002one.") == ["A\u0001 b\u0002 c.", "Next\u0002one."]


def test_string_ids(spark):
    texts = [(f"d{i}", f"Cats chase mice {i}. Mice eat cheese. Dogs chase cats quickly. Birds sing songs {i}. Cats sleep.") for i in range(30)]
    df = spark.createDataFrame(texts, "doc_id string, text string")
    num = df.withColumn("doc_id", F.substring("doc_id", 2, 9).cast("long"))
    for m in ("textrank", "tfidf", "lead"):
        a = {r["doc_id"]: r["summary"] for r in summarize.summarize(df, method=m, k=2).collect()}
        b = {f"d{r['doc_id']}": r["summary"] for r in summarize.summarize(num, method=m, k=2).collect()}
        assert a == b and len(a) == 30


def test_every_document_converges_with_the_real_setting(spark):
    r = Q.q_textrank_scores(spark, "/root/testdata/sf0.01")
    assert r.where(~F.col("converged")).count() == 0


def test_a_graph_that_does_not_converge_is_uniform(spark):
    sent = Q.sent_table(spark, SF)
    tr = textrank.textrank_scores(textrank.sentence_vectors(sent), max_iter=2)
    f = textrank.textrank_feature(tr)
    bad = f.where(~F.col("converged"))
    assert bad.count() > 0
    assert bad.where(F.abs(F.col("textrank_feature") - 1 / F.col("n_sent")) > 1e-12).count() == 0
    e = spark.read.parquet(f"{SF}/embeddings.parquet").where("label < 2")  # similarities of both signs
    pr = textrank.pagerank_groups(e, "label", "vec_id", "embedding", max_iter=9).collect()
    n = {k: sum(r["label"] == k for r in pr) for k in (0, 1)}
    assert all(r["converged"] or abs(r["pagerank"] - 1 / n[r["label"]]) < 1e-12 for r in pr) and not all(r["converged"] for r in pr)


def test_short_documents_have_top_sentences(spark):
    got = Q.q_top_sentences(spark, SF).select("doc_id").distinct().count()
    assert got == spark.read.parquet(f"{SF}/documents.parquet").where(F.length(F.trim("text")) > 0).count()


def test_blank_references_are_skipped(spark):
    rows = [(1, "One point here. Another point there.", "\n\t"), (2, "One point here. Another point there.", "one point")]
    ts = features.training_set(spark.createDataFrame(rows, "doc_id long, article string, highlights string"))
    assert {r["doc_id"] for r in ts.collect()} == {2}


def _ts(spark, n=60):
    rows = [(i, 0, *[float((i * 7 + j * 3) % 11) / 10 for j in range(5)], float(i % 3 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, sent_idx int, tfidf double, textrank double, position double, length double, "
                                       "norm_length double, label double")


def test_no_validation_rows_no_early_stop(spark):
    m = model.train(_ts(spark), C.DEFAULT.with_(validation_split=0.0), epochs=3, iters_per_epoch=2)
    assert [h["val_loss"] for h in m.history] == [None] * 3


def test_early_stopping_restores_the_best_weights(spark, monkeypatch):
    losses = iter([0.9, 0.5, 0.7, 0.8, 0.6, 0.1])
    fitted = []
    real = model._mlp

    def counted(*a, **k):
        est = real(*a, **k)
        fit = est.fit
        est.fit = lambda d: fitted.append(fit(d)) or fitted[-1]
        return est

    monkeypatch.setattr(model, "_mlp", counted)
    monkeypatch.setattr(model, "log_loss", lambda pred: next(losses))
    m = model.train(_ts(spark), epochs=6, iters_per_epoch=2)
    assert [h["val_loss"] for h in m.history] == [0.9, 0.5, 0.7, 0.8, 0.6]  # three epochs without a better one
    assert list(m.pipeline.stages[-1].weights) == list(fitted[1].weights)


def test_metrics_by_hand(spark):
    ts = _ts(spark)
    m = model.train(ts, epochs=2, iters_per_epoch=3)
    got = {r["split"]: r for r in model.training_metrics(m, ts).collect()}
    pred = model.predict_importance(m, features.train_val_split(ts)).select("is_val", "importance", "label").collect()
    for name, val in (("train", False), ("validation", True)):
        mine = [(r["importance"], r["label"]) for r in pred if r["is_val"] == val]
        assert abs(got[name]["accuracy"] - sum((p > 0.5) == (y == 1) for p, y in mine) / len(mine)) < 1e-9
        pos, neg = [p for p, y in mine if y], [p for p, y in mine if not y]
        auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
        assert abs(got[name]["auc"] - auc) < 0.02


def test_hybrid_side_by_side(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 20")
    m = model.train(Q._training_set(spark, SF), epochs=1, iters_per_epoch=3)
    methods = ("tfidf", "lead", "hybrid")
    assert summarize.available_methods(methods) == ["tfidf", "lead"] and summarize.available_methods(methods, m) == list(methods)
    both = {r["doc_id"]: r for r in summarize.summarize_side_by_side(docs, methods=methods, model=m).collect()}
    alone = {r["doc_id"]: r["summary"] for r in summarize.summarize(docs, method="hybrid", model=m).collect()}
    assert {i: r["hybrid_summary"] for i, r in both.items()} == alone
    with pytest.raises(RuntimeError):
        summarize.summarize_side_by_side(docs, methods=methods)


def test_lead_keeps_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "A b. C d."), (None, "E f. G h."), (1, "")], "doc_id long, text string")
    assert summarize.summarize(df, method="lead", k=1).count() == 3


def test_spread_starts_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("spread", "spread")
    df = spark.read.parquet(f"{SF}/documents.parquet").groupBy("lang").count()
    before = len(tracker.getJobIdsForGroup("spread"))
    sentences.spread(df, "lang")
    assert len(tracker.getJobIdsForGroup("spread")) == before
    spark.sparkContext.setJobGroup("", "")


def test_files_keep_their_order(spark, tmp_path):
    long = "x" * 50_000
    p = str(tmp_path / "corpus")
    spark.createDataFrame([("same", "FIRST")], "article string, highlights string").coalesce(1).write.parquet(f"{p}/a")
    spark.createDataFrame([("same", "SECOND"), (long, "z")], "article string, highlights string").coalesce(1).write.parquet(f"{p}/b")
    df = S.read_corpus(spark, f"{p}/*", "parquet")
    assert [r["highlights"] for r in df.orderBy("doc_id").collect()] == ["FIRST", "SECOND", "z"]
    from precis.operators.corpus import dedup_keep_first
    assert {r["highlights"] for r in dedup_keep_first(df).collect()} == {"FIRST", "z"}


def test_half_written_table_is_rebuilt(spark, tmp_path):
    raw, clean = str(tmp_path / "raw"), tmp_path / "clean"
    text = "word " * 40
    spark.createDataFrame([(1, text, "a b c d")], "doc_id long, article string, highlights string").write.parquet(raw)
    clean.mkdir()
    (clean / "part-0.parquet").write_bytes(b"")
    assert S.load_or_build_clean(spark, raw, str(clean)).count() == 1


def test_text_sink_has_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, "One."), (2, None)], "doc_id long, summary string")
    S.write_summaries(df, str(tmp_path / "t"), "text")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["1\tOne.", "2\t"]


def test_checkpoint_folder_must_be_shared_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())


def test_stream_restart_does_not_repeat(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    one_ = spark.createDataFrame([(1, "A b. C d. E f. G h.")], "doc_id long, text string").coalesce(1)
    one_.write.parquet(str(src / "x"))
    for expected in (1, 1, 2):
        if expected == 2:
            one_.withColumn("doc_id", F.lit(2).cast("long")).write.parquet(str(src / "y"))
        stream = ST.document_stream(spark, f"{src}/*")
        ST.summarize_stream(stream, out, available_now=True, name=f"r{expected}{os.urandom(2).hex()}", checkpoint=ck).awaitTermination(120)
        assert spark.read.parquet(out).count() == expected
    assert len(os.listdir(out)) == 2  # an epoch for each new file, none for the restart
