"""Registered queries of the training-data operators: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import functions as F

from precis.llm import (
    ann, bpe, hard_negatives, html_extract, jaccard, line_dedup, merkle, packing, quality, secret_scan, topk, toxicity, warc,
)
from precis.llm.common import held_out, table
from precis.session import checkpoint_dir

TOXIC_AT = 0.5
GOOD_AT = 0.3


def _scored(docs, score, limit):
    d = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return d.withColumn("predicted", (F.col("score") >= limit).cast("int"))


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, toxicity.score(F.col("text"), model), TOXIC_AT)


def op2_nearest(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op3_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    checkpoint_dir(spark)
    # spans and candidates only, stored: the texts are read once for the histogram and the result
    found = docs.select("doc_id", secret_scan.scan(F.col("text")).alias("scan")).checkpoint()
    spans = secret_scan.spans(F.col("scan"), secret_scan.cuts(found))
    base = F.col("scan")["base"]
    return found.select(
        "doc_id",
        *[secret_scan.count_kind(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.as_text(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.as_text(spans).alias("spans"),
    )


def op4_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), "doc_id", packing.word_count(F.col("text")))


def op5_bpe(spark, sf_dir):
    import public_tokenizers  # of this query alone: the others run without it

    vocab = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = table(spark, sf_dir, "documents").select("doc_id", bpe.encode(F.col("text"), vocab).alias("ids"))
    both = ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.decode(F.col("ids"), vocab).alias("d"))
    return both.select(
        "doc_id", "n_tokens", F.sha2(F.col("d.packed"), 256).alias("ids_sha256"), F.sha2(F.col("d.raw"), 256).alias("decoded_sha256"))


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, quality.score(F.col("text"), model), GOOD_AT)


def op7_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_jaccard(spark, sf_dir):
    return jaccard.components(table(spark, sf_dir, "documents"), cfg=jaccard.JaccardConfig(words=3, num=90))


def op9_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    capture = warc.write(pages, warc.new_folder(spark))
    found = warc.lookup(spark, capture, pages.select(warc.keys_of(F.col("url")).alias("key")), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


def op10_main_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    weights = html_extract.train(pages, "html", "page_id")
    d = pages.select("page_id", "url", html_extract.main_text(F.col("html"), weights).alias("text"))
    return d.withColumn("n_chars", F.length("text").cast("long"))


def op11_merkle(spark, sf_dir):
    return merkle.manifest_proofs(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows)


def op13_line_dedup(spark, sf_dir):
    d = line_dedup.drop_common(table(spark, sf_dir, "documents"))
    return d.select(
        "doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.col("lines.kept").cast("binary"), 256).alias("kept_sha256"))


def queries():
    import corpus_pipeline

    return {
        "op1_toxicity": op1_toxicity,
        "op2_nearest": op2_nearest,
        "op3_secrets": op3_secrets,
        "op4_packing": op4_packing,
        "op5_bpe": op5_bpe,
        "op6_quality": op6_quality,
        "op7_topk": op7_topk,
        "op8_jaccard": op8_jaccard,
        "op9_warc": op9_warc,
        "op10_main_text": op10_main_text,
        "op11_merkle": op11_merkle,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_line_dedup": op13_line_dedup,
        "pipeline": corpus_pipeline.run,
    }
