"""Exact dedup by content-defined chunk recipes, in SQL functions only.

A text is cut where its content says so: after `low` characters a chunk ends at the first sentence end or
line break, if there is one within `high` characters; else at the first pair of characters out of two classes; else after `high`. So
an insertion changes a chunk or two, not all that follow, in text without sentence marks too. Equal chunks
get one identifier, verified by grouping on the chunk's own characters; a text
is then the ordered list of its chunks' identifiers (its recipe), and two texts
are equal exactly when their recipes are. Whole texts move once at most, as
distinct chunks; the comparison moves recipes only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from horizonspark.llm.common import Scratch, join_hot

#: What ends a chunk where no sentence ends: pairs of characters each of which is one of a few of its script (about one pair in thirty).
PAIR = r"[aeo159\u03B1-\u03B5\u0430-\u0435\u05D0-\u05D4\u0627-\u062C\u0905-\u0910\u3041-\u3050\uAC00-\uB4FF\u4E00-\u55FF\u8000-\u87FF][gkmpvw26bd\u03BA-\u03BD\u043A-\u043F\u05D5-\u05D9\u062F-\u0634\u0915-\u0920\u3051-\u3060\uB500-\uBDFF\u5600-\u5DFF\u8800-\u8FFF]"


def hash64(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def chunks_of(text: Column, low: int = 256, high: int = 2048) -> Column:
    """The text's chunks in order; joined together they are the text again."""
    pattern = rf"(?s)(?:.{{{low},{high}}}?[\n.!?。！？]|.{{{low},{high}}}?{PAIR}|.{{1,{high}}})"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def chunk_store(docs: DataFrame, text_col: str = "text", low: int = 256, high: int = 2048, chunk_hash: Callable[[Column], Column] = hash64) -> DataFrame:
    """Distinct chunks: h (hash), chunk, n_uses. Grouping is on the characters, so equal h never merges different chunks."""
    pieces = docs.select(F.explode(chunks_of(F.col(text_col), low, high)).alias("chunk"))
    return pieces.groupBy(chunk_hash(F.col("chunk")).alias("h"), "chunk").agg(F.count("*").alias("n_uses"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: int = 256, high: int = 2048, chunk_hash: Callable[[Column], Column] = hash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Of equal texts the row with the largest id stays. A null text is the empty
    text (no chunks). Null ids lose to others; a group of null ids only keeps
    all of its rows with keep_id null. Rows repeating an id and text share one
    decision. Columns other than id and text are ignored, whatever their names.
    An empty table gives an empty result. The rows of a text with thousands of copies are dealt to several tasks.
    """
    scratch = Scratch(docs.sparkSession, "chunk-dedup")
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = chunk_store(src, "text", low, high, chunk_hash).groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h")
    clashes = scratch.save(shared)
    base = src.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), chunks_of(F.col("text"), low, high).alias("chunks"))
    recipe = F.transform("chunks", chunk_hash)
    if clashes.isEmpty():
        recipes = base.select("doc_id", "text_sha256", recipe.alias("recipe"))
    else:
        recipes = _told_apart(base, clashes, src, low, high, chunk_hash)
    recipes = scratch.save(recipes)
    groups = scratch.save(recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"))
    out = join_hot(recipes, groups, ["recipe"], "group_size", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("bigint").alias("n_chunks"),
    )


def _told_apart(base: DataFrame, clashes: DataFrame, src: DataFrame, low: int, high: int, chunk_hash) -> DataFrame:
    """Recipes where different chunks share a hash: such a chunk's identifier is the digest of its hash and characters."""
    marked = base.withColumn("rid", F.monotonically_increasing_id())
    rows = marked.select("rid", "doc_id", "text_sha256", F.posexplode_outer("chunks").alias("pos", "chunk")).withColumn("h", chunk_hash(F.col("chunk")))
    # order among the texts of one hash; such texts are few, as their hashes are
    named = (
        chunk_store(src, "text", low, high, chunk_hash)
        .join(clashes, "h", "left_semi")
        .groupBy("h")
        .agg(F.array_sort(F.collect_set("chunk")).alias("texts"))
    )
    ids = rows.join(named, "h", "left").select(
        "rid", "doc_id", "text_sha256", "pos", F.col("chunk").isNotNull().alias("real"),
        "h", F.coalesce(F.array_position("texts", F.col("chunk")), F.lit(0)).cast("bigint").alias("alt"),
    )
    return ids.groupBy("rid", "doc_id", "text_sha256").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("real"), F.struct("pos", "h", "alt")))), lambda x: F.array(x["h"], x["alt"]))).alias("recipe")
    ).select("doc_id", "text_sha256", "recipe")
