"""Sentence table.

``with_sentences`` adds the sentence array and its size to a document table
(narrow, no shuffle).  ``sentence_table`` explodes it to one row per sentence;
``posexplode`` keeps every row of a document in the partition the document was
in, so a document table partitioned by its id stays partitioned by it and
every later per-document window/aggregation runs without another exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from precis.functions.sentences import split_sentences
from precis.functions.text import words_of_normalized

ROW = "_row"  # key of a document's row: no id, so ids may be null or repeat
CARRY = "_carry"  # struct of the columns that a document's own row carries to the result


def with_sentences(df: DataFrame, text_col: str = "text", out: str = "sentences") -> DataFrame:
    """N1 on a whole column: adds ``sentences ARRAY<STRING>`` and ``n_sent``."""
    return df.withColumn(out, split_sentences(text_col)).withColumn("n_sent", F.size(out))


# Of stored input for each partition of a text stage.  Rows of terms hold up to 200 times what their documents
# take in a file (measured: 8 MB of Parquet are 1.5 GB in the hash tables and sorts of a task), so this is little.
MOST_BYTES = 2 << 20


def _stored_bytes(df: DataFrame) -> int:
    """What the plan's sources hold, by their statistics; 0 where they tell nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return total if total < 1 << 60 else 0  # tables of unknown size claim the most there is


def hash_partition(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition into ``spark.sql.shuffle.partitions`` partitions, or more for a large input.

    The count is passed explicitly: the stages after this shuffle are
    CPU-heavy text processing (regexes, stemming, kernels), and AQE would
    otherwise coalesce a small shuffle into one or two partitions and run
    them on one or two cores.  The count is the cluster's setting, raised so that a
    partition stands for ``MOST_BYTES`` of the input at most: a setting made for
    small tables does not starve a large one.
    """
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions", None)
    try:
        return df.repartition(max(int(n), -(-_stored_bytes(df) // MOST_BYTES)), *cols)
    except (TypeError, ValueError):
        return df.repartition(*cols)


def partition_by_doc(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The one shuffle of a summary job: co-locate each document's rows.

    Hash-partitioning on the id means every later window or aggregation keyed
    by (id, ...) is already satisfied.
    """
    return hash_partition(df, id_col)


def spread(df: DataFrame, id_col: str) -> DataFrame:
    """Hash-partition by ``id_col`` only when the input is too small to fill the
    cluster's cores with scan splits (a few files or row groups).

    Heavy per-row work (regex cleaning) then runs on all cores; a large scan,
    which already has many splits, is left alone and pays no shuffle.
    """
    spark = df.sparkSession
    # the optimised plan's size statistic: asking for partitions could start a job
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes").replace("B", "b")))
    if size < split * spark.sparkContext.defaultParallelism:
        return hash_partition(df, id_col)
    return df


def _ordered_source(df: DataFrame) -> bool:
    """Whether the rows come in the same order whenever a task is run again: from files or literals, unshuffled."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() in ("LogicalRelation", "LocalRelation", "Range")


def keyed(df: DataFrame, out: str = ROW) -> DataFrame:
    """Every row with a number of its own, made where the row is read, without a shuffle.

    A task that runs again must give its rows the same numbers, or rows would be lost
    or doubled in the shuffle that follows; rows that may come in another order (out of
    a shuffle) are sorted by their content first, within their partition.
    """
    if not _ordered_source(df):
        df = df.sortWithinPartitions(F.xxhash64(F.to_json(F.struct(*[f"`{c}`" for c in df.columns]))))
    return df.withColumn(out, F.monotonically_increasing_id())


def keyed_documents(df: DataFrame, text_col: str, keep=(), arrays=(), settings=None) -> DataFrame:
    """(_row, _carry, *arrays, sentences, n_sent): every row of ``df``, partitioned by a key of its own.

    ``keep`` columns travel in ``_carry``; the text is shuffled once, kept or not.
    ``arrays``: (name, column) of arrays with a value for each sentence.
    """
    names = list(dict.fromkeys([*keep, text_col]))
    src = keyed(df.select(F.struct(*names).alias(CARRY), *[c.alias(n) for n, c in arrays]))
    docs = hash_partition(src, ROW).withColumn("_text", F.col(f"{CARRY}.`{text_col}`"))
    docs = with_sentences(docs, "_text").drop("_text")
    if text_col not in keep:
        docs = docs.withColumn(CARRY, F.struct(*[F.col(f"{CARRY}.`{c}`").alias(c) for c in dict.fromkeys(keep)]))
    return docs


def sentence_table(df: DataFrame, id_col: str = "doc_id", sentences_col: str = "sentences",
                   min_sent: int = 1, outer: bool = False, more=(), also=()) -> DataFrame:
    """(id, n_sent, sent_idx, sentence, *more, *also, n_words), one row per sentence
    of the documents with at least ``min_sent`` sentences.

    The document filter is folded into the explode (``explode(when(...))``)
    instead of a Filter: a Filter would be pushed below the id-partitioning
    exchange and into the scan, re-running the sentence split there and
    preventing the exchange from being shared with the other branches.
    ``outer`` keeps one row (sent_idx null) for documents without sentences; where the
    documents have a ``_carry`` column, every document has such a row, which holds it.
    ``more``: columns with an array of a value for each sentence; ``also``: small columns
    that every sentence repeats.
    """
    arr = F.when(F.col("n_sent") >= min_sent, F.col(sentences_col))
    if CARRY in df.columns:
        # first the document's own row, which alone carries; then its sentences
        kind = df.schema[CARRY].dataType
        none = F.lit(None)
        own = F.struct(none.cast("int").alias("i"), none.cast("string").alias("s"), F.col(CARRY).alias("c"))
        rows = F.transform(F.coalesce(arr, F.array().cast("array<string>")),
                           lambda x, i: F.struct(i.alias("i"), x.alias("s"), none.cast(kind).alias("c")))
        t = df.select(id_col, "n_sent", *more, *also, F.explode(F.concat(F.array(own), rows)).alias("_r"))
        value = [F.get(c, F.col("_r.i")).alias(c) for c in more]
        t = t.select(id_col, "n_sent", F.col("_r.i").alias("sent_idx"), F.col("_r.s").alias("sentence"), *value,
                     *also, F.col("_r.c").alias(CARRY))
    else:
        gen = F.posexplode_outer(arr) if outer else F.posexplode(arr)
        t = df.select(id_col, "n_sent", *more, *also, gen.alias("sent_idx", "sentence"))
        t = t.select(id_col, "n_sent", "sent_idx", "sentence", *[F.get(c, F.col("sent_idx")).alias(c) for c in more], *also)
    return t.withColumn("n_words", words_of_normalized("sentence"))


def with_positions(sent: DataFrame) -> DataFrame:
    """Position i / max(n - 1, 1)."""
    return sent.withColumn(
        "position", F.col("sent_idx") / F.greatest(F.col("n_sent") - 1, F.lit(1))
    )


def with_norm_lengths(sent: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Len / max(mean(len) over the document, 1)."""
    mean_len = F.avg("n_words").over(Window.partitionBy(id_col))
    return sent.withColumn("norm_length", F.col("n_words") / F.greatest(mean_len, F.lit(1.0)))
