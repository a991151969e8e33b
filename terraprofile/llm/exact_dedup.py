"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so, so equal texts are cut alike and an
edit moves few cuts. Each chunk gets an identifier, the 64-bit hash of its bytes.
One pass moves every distinct chunk once and proves that no two chunks of the
corpus share an identifier; the few that do (if any) get a number of their own.
A text is then its recipe, the ordered list of identifiers, and equal recipes mean
equal texts. Only recipes, about a hundredth of the text, are compared and joined.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraprofile.session import materialize

MIN_CHUNK, MAX_CHUNK = 512, 8192
# a cut follows one of these letters before one of those: the content near the cut alone decides
CUT_AFTER, CUT_BEFORE = "[aeo]", "[ndst]"


def fold_case(text: Column) -> Column:
    """A-Z become a-z, all else stays; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def chunk_text(text: Column, low: int = MIN_CHUNK, high: int = MAX_CHUNK) -> Column:
    """The chunks of a text in order, each of ``low`` to ``high`` characters but the last; none for ''.

    Without a content cut within ``high`` characters a chunk ends there.
    """
    cut = f"(?s).{{{low},{high}}}?(?<={CUT_AFTER})(?={CUT_BEFORE})|(?s).{{1,{high}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def _clashes(texts: DataFrame) -> DataFrame:
    """Chunks whose identifier another chunk shares, with a number (1, 2, ...) among them.

    Equal chunks meet before the shuffle (partial aggregation), so a hot chunk moves once per task.
    """
    chunks = texts.select(F.explode("_chunks").alias("chunk")).select(F.xxhash64("chunk").alias("h"), "chunk")
    distinct = chunks.groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("uses"))
    # the exchange above is by (h, chunk); identifiers alone are counted after it
    twice = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    return twice


def _recipes(docs: DataFrame, id_col: str, text_col: str, low: int, high: int) -> DataFrame:
    text = fold_case(F.col(text_col))
    return (
        docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
        .select("_id", F.sha2(F.col("_text").cast("binary"), 256).alias("_sha256"), F.char_length("_text").alias("_chars"), chunk_text(F.col("_text"), low, high).alias("_chunks"))
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: int = MIN_CHUNK, high: int = MAX_CHUNK) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is the empty text.
    The largest id of a group stays (a null id only if the group has no other).
    Rows that repeat id and text are one document each and all marked kept with it;
    group_size counts rows. Other columns, whatever their names, are not read.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    whole = _recipes(docs, id_col, text_col, low, high)
    ids = F.transform("_chunks", lambda c: F.xxhash64(c))
    clash = materialize(_clashes(whole), "chunk-clashes")
    if clash.isEmpty():
        recipes = whole.select("_id", "_sha256", ids.alias("_recipe"))
    else:
        # an identifier of several chunks is replaced by its chunk's own digest, which tells them apart
        pairs = whole.select("_id", "_sha256", F.monotonically_increasing_id().alias("_row"), F.posexplode_outer("_chunks").alias("_pos", "_chunk"))
        pairs = pairs.withColumn("h", F.xxhash64("_chunk")).join(clash.withColumn("_clash", F.lit(True)), "h", "left")
        part = F.when(F.col("_clash"), F.sha2(F.col("_chunk").cast("binary"), 256)).otherwise(F.col("h").cast("string"))
        recipes = (
            pairs.select("_id", "_sha256", "_row", F.struct("_pos", part.alias("part")).alias("x"))
            .groupBy("_id", "_sha256", "_row")
            .agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]).alias("_recipe"))
            .drop("_row")
        )
    recipes = materialize(recipes, "recipes")
    groups = recipes.groupBy("_recipe").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # null-safe: a recipe is never null, an id may be
    joined = recipes.join(groups, "_recipe")
    return joined.select(
        F.col("_id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_sha256").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without copies, all columns kept; the largest id of each group stays.

    Rows are judged by id and text, so an id that stays with one text goes with another. Of rows
    that repeat both, one stays.
    """
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha"))
    if docs.groupBy(docs[id_col].alias("_i")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        # the id alone tells rows apart, and no text needs its digest again
        return docs.join(kept.select("_keep"), docs[id_col].eqNullSafe(kept["_keep"]), "left_semi")
    own = docs.withColumn("_own", F.sha2(fold_case(F.col(text_col)).cast("binary"), 256))
    return own.join(kept, own[id_col].eqNullSafe(kept["_keep"]) & (own["_own"] == kept["_sha"]), "left_semi").dropDuplicates([id_col, "_own"]).drop("_own")
