"""Corpus cleaning.

``clean_corpus`` = project -> clean both columns -> drop blank -> length
filter -> keep-first de-duplication, as one plan.

* The cleaned columns are produced under a ``Generate`` (explode of a
  one-element array).  Filters on the cleaned text cannot be pushed below a
  generator, so the regex chain runs once per row instead of once more inside
  every pushed-down predicate.
* De-duplication aggregates ids and places keyed by the SHA-256 of the article,
  never texts, and is skew-proof: a group of copies (possibly a third of the
  corpus) is first reduced map-side by the partial aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis import config as C
from precis.functions.text import clean_text, word_count
from precis.session import checkpoint_dir

REQUIRED = ("article", "highlights")


def require_columns(df: DataFrame, cols=REQUIRED) -> None:
    """Raise at plan time when a required column is missing."""
    for c in cols:
        if c not in df.columns:
            raise ValueError(f"the corpus lacks its column {c!r}")


def clean_columns(df: DataFrame, id_col: str = "doc_id", partitioned: bool = False) -> DataFrame:
    """R1 + T10 on both columns: (id, article, highlights) cleaned.

    With ``partitioned`` an input with fewer partitions than the cluster's
    parallelism is spread by id first (``spread``), so the regex chain runs
    on every core whatever the input layout; a large scan is left alone.
    """
    from precis.operators.sentences import spread

    require_columns(df)
    src = df.select(id_col, "article", "highlights")
    if partitioned:
        src = spread(src, id_col)
    return pin(src, id_col, article=clean_text("article", False), highlights=clean_text("highlights", True))


def pin(df: DataFrame, *keep: str, **cols) -> DataFrame:
    """Compute ``cols`` exactly once per row.

    The values are produced by a one-element ``explode``: a Filter on them
    cannot be pushed below a generator, so the optimizer never substitutes
    the (expensive) expressions into pushed-down predicates.
    """
    st = F.struct(*[c.alias(n) for n, c in cols.items()])
    return df.select(*keep, F.explode(F.array(st)).alias("_p")).select(*keep, *[f"_p.{n}" for n in cols])


def drop_blank(df: DataFrame) -> DataFrame:
    """R2: both cleaned columns non-blank."""
    return df.filter((F.trim("article") != "") & (F.trim("highlights") != ""))


def length_filter(df: DataFrame, settings: C.Settings = C.DEFAULT) -> DataFrame:
    """R3 (+R5): word-count bounds; the helper counts are dropped again."""
    out = pin(df, *df.columns, _aw=word_count("article"), _sw=word_count("highlights"))
    cond = (F.col("_aw") >= settings.min_article_words) & (F.col("_sw") >= settings.min_summary_words)
    if settings.max_article_words:
        cond = cond & (F.col("_aw") <= settings.max_article_words)
    return out.filter(cond).drop("_aw", "_sw")


def digest_of(text) -> Column:
    """SHA-256 of a text as 32 bytes: a key of fixed size for texts of any length."""
    return F.unhex(F.sha2(text, 256))


def first_places(rows: DataFrame) -> DataFrame:
    """(digest, doc_id, place) of the row with the smallest id of each digest; of equal ids the first place.

    ``rows``: (digest, doc_id long, place long, not negative).  Id and place are one
    decimal number, so the minimum is kept in a hash aggregate.  A null id comes first.
    Ids must lie between -2**62 and 2**62.
    """
    size = F.lit(1 << 62).cast("decimal(19,0)")
    low = F.lit(-(1 << 62)).cast("decimal(19,0)")  # below any id that can be packed
    packed = (F.coalesce(F.col("doc_id").cast("decimal(19,0)"), low) * size + F.col("place").cast("decimal(19,0)")).cast("decimal(38,0)")
    best = rows.groupBy("digest").agg(F.min(packed).alias("best"))
    place = F.pmod("best", size.cast("decimal(38,0)"))
    doc_id = ((F.col("best") - place) / size).cast("decimal(38,0)")
    return best.select("digest", F.when(doc_id != low, doc_id.cast("long")).alias("doc_id"), place.cast("long").alias("place"))


def dedup_keep_first(df: DataFrame, id_col: str = "doc_id", key: str = "article",
                     settings: C.Settings = C.DEFAULT) -> DataFrame:
    """One row per distinct ``key``, the one with the smallest id (of equal ids one of them).

    Materialised late: the rows are stored once, and only (SHA-256 of the key, id, place)
    is aggregated, in a hash aggregate that keeps one row of a hot group of copies per
    task before the shuffle.  The places of the rows that go are broadcast if they are
    few, so the texts are not shuffled; else the rows that stay are joined by place.
    Ids that are no integers are aggregated with their rows instead.
    """
    if dict(df.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        cols = [id_col, *[c for c in df.columns if c != id_col]]
        best = df.groupBy(F.sha2(F.col(key), 256).alias("_h")).agg(F.min(F.struct(*cols)).alias("_r"))
        return best.select(*[F.col(f"_r.{c}").alias(c) for c in df.columns])
    checkpoint_dir(df.sparkSession)
    stored = df.withColumns({"_digest": digest_of(F.col(key)), "_place": F.monotonically_increasing_id()}).checkpoint()
    narrow = stored.select(F.col("_digest").alias("digest"), F.col(id_col).cast("long").alias("doc_id"), F.col("_place").alias("place"))
    first = first_places(narrow).select(F.col("place").alias("_place"))
    gone = stored.select("_place").join(first, "_place", "left_anti").checkpoint()
    if gone.count() <= settings.broadcast_max_rows:  # eight bytes each
        return stored.join(F.broadcast(gone), "_place", "left_anti").select(*df.columns)
    return stored.join(first, "_place", "left_semi").select(*df.columns)


def clean_corpus(df: DataFrame, id_col: str = "doc_id", settings: C.Settings = C.DEFAULT) -> DataFrame:
    """The whole cleaning pipeline."""
    return dedup_keep_first(
        length_filter(drop_blank(clean_columns(df, id_col, partitioned=True)), settings), id_col, settings=settings)


def sample_n(df: DataFrame, n: int, seed: int = C.DEFAULT.random_state, id_col: str = "doc_id",
             strict: bool = False) -> DataFrame:
    """Exactly min(n, rows) rows, chosen by a seeded hash of the id.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each partition
    keeps its n best, only those reach the final merge.  ``strict`` raises
    when the table has fewer than n rows.
    """
    if strict:
        total = df.count()
        if n > total:
            raise ValueError(f"Cannot take a sample of {n} rows from {total}")
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit("-"), F.lit(str(seed))))
    return df.orderBy(key, F.col(id_col)).limit(int(n))
