"""Exact deduplication by progressive refinement, in DataFrame functions only.

Rows are grouped by text length; rows whose length repeats by a hash of the
first characters; rows whose prefix hash repeats by SHA-256 of the whole text;
and only rows of groups that still repeat have their content compared. Each
level's keys are pre-aggregated before they are shuffled, so a group that holds
a third of all rows costs one row per task. Keys of a level go to the rows by a
broadcast only if they are counted to be few, else by a join that adaptive
execution may split.

Defined results: a null text counts as empty, and empty texts are a group like
any other. Of equal texts the largest doc_id stays; null ids stay only where the
group has no other id. Rows that repeat a doc_id and its text each count in
group_size and share the verdict. An empty table gives no rows. Other columns,
whatever their names, are not read. `drop_copies` works by doc_id and digest, so
rows without a doc_id always stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import checkpointed, sized, text_or_empty

PREFIX_CHARS = 64
#: Keys of a level (length, prefix hash, digest) that one broadcast may hold: about 150 bytes each.
KEY_ROWS = 100_000
#: The levels' key columns.
LEVELS = (["n"], ["n", "p"], ["n", "p", "h"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).alias("n"),
        F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("p"),
        F.sha2(text, 256).alias("h"),
        text.alias("text"),
    )


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs."""
    # Each row's digest is part of the result, so one scan makes the keys of all levels
    # (about 100 bytes a row); the texts themselves are read again for survivors only.
    rows = checkpointed(_keyed(docs, id_col, text_col).drop("text"))
    alive = rows
    for keys in LEVELS:
        repeated = _repeated(alive, keys)
        if keys == LEVELS[-1]:
            break
        alive = alive.join(sized(checkpointed(repeated), KEY_ROWS), keys, "left_semi")
    repeated = sized(checkpointed(repeated), KEY_ROWS)
    survivors = _keyed(docs, id_col, text_col).join(repeated, LEVELS[-1], "left_semi")
    groups = (
        survivors.groupBy("n", "p", "h", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .groupBy("n", "p", "h")
        .agg(F.collect_list(F.struct("keep_id", "group_size", "text")).alias("texts"))
    )
    # One text per digest, so its content has done its work here. Different texts
    # of one digest would need the content again to tell the rows apart.
    groups = groups.select(
        "n", "p", "h",
        F.when(F.size("texts") == 1, F.col("texts")[0]["keep_id"])
        .otherwise(F.raise_error(F.concat(F.lit("different texts share SHA-256 "), F.col("h"))))
        .alias("keep_id"),
        F.col("texts")[0]["group_size"].alias("group_size"),
    )
    found = rows.join(sized(checkpointed(groups), KEY_ROWS), LEVELS[-1], "left")
    return found.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("h").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text also stands under a larger doc_id; all columns stay."""
    dropped = exact_groups(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("dropped_id"), F.col("text_sha256").alias("dropped_sha256")).distinct()
    dropped = sized(checkpointed(dropped), KEY_ROWS)
    same = (docs[id_col] == dropped["dropped_id"]) & (F.sha2(text_or_empty(text_col), 256) == dropped["dropped_sha256"])
    return docs.join(dropped, same, "left_anti")
