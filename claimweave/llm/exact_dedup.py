"""Operator 12: exact dedup by content sort, in DataFrame functions only.

Rows are range-partitioned by sampled splitters over the normalised bytes and sorted externally, so that equal texts
stand next to each other; each row is then compared whole with its neighbour, and of a run of equals one row stays.
The sort key is the first characters, then a hash of the whole text, then the text itself: splitters stay small
however long the texts are, and texts that begin alike are still dealt over many partitions. A hash that holds more
than its share of the rows is dealt in parts by the identifier; the runs of its parts, and no others, are then joined
on their whole texts.

Edge cases: a null text is an empty one; empty texts are equal to each other; where several rows of a group have the
identifier that stays, exactly one of them is kept; null identifiers come last, so that one stays only where a group
has no other; an empty table gives an empty result; `distinct_documents` carries extra columns of any name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import stored

#: Characters of the sort key that are read before the hash.
KEY_CHARACTERS = 16
#: No part of a hash holds more than about 1 in (this x shuffle partitions) of the rows, which bounds the hashes that are dealt in parts.
SHARES = 4


def lower_ascii(text: Column) -> Column:
    """text with A-Z alone lower-cased."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _hot(own: DataFrame, rows: int) -> DataFrame:
    """_hash and _parts of the hashes with more than a share of the rows: at most SHARES x shuffle partitions of them."""
    share = rows // (SHARES * int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    counts = own.groupBy("_hash").agg(F.count("*").alias("_n")).filter(F.col("_n") > share)
    return stored(counts.select("_hash", F.ceil(F.col("_n") / share).cast("int").alias("_parts")))


def equal_runs(rows: DataFrame, content: Column, identifier: str, keep: str, carried: list[str]) -> DataFrame:
    """The carried columns of rows, as the struct _row, with _keep_id, _group_size, _kept and _sha256 of their groups of equal content.

    content is never null; keep says whether the smallest or the largest identifier of a group stays.
    """
    own = rows.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_row"), F.col(f"`{identifier}`").alias("_id"), content.alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    hot = _hot(own.select("_hash"), rows.count())
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("_id", F.spark_partition_id()), F.col("_parts")).cast("int"))
    own = own.join(F.broadcast(hot), "_hash", "left").select("_row", "_id", "_text", "_hash", F.substring("_text", 1, KEY_CHARACTERS).alias("_begin"), part.alias("_part"))
    cell = ["_begin", "_hash", "_part"]
    order = F.col("_id").asc_nulls_last() if keep == "smallest" else F.col("_id").desc_nulls_last()
    sort = Window.partitionBy(*cell).orderBy("_text", order)
    dealt = own.repartitionByRange(*cell).withColumn("_head", F.coalesce(F.lag("_text").over(sort) != F.col("_text"), F.lit(True)))
    runs = dealt.withColumn("_run", F.sum(F.col("_head").cast("long")).over(sort))
    # of each row its digest is left; of a part's runs also the text of their first rows, for the joining of parts
    runs = runs.select("_row", "_id", *cell, "_head", "_run", F.sha2(F.col("_text").cast("binary"), 256).alias("_sha256"), F.when(F.col("_head") & F.col("_part").isNotNull(), F.col("_text")).alias("_text"))
    same = Window.partitionBy(*cell, "_run")
    first = F.max(F.when(F.col("_head"), F.col("_id"))).over(same)
    runs = stored(runs.withColumns({"_keep_id": first, "_group_size": F.count("*").over(same)}))
    out = ["_row", "_keep_id", "_group_size", "_head", "_sha256"]
    parts = runs.filter(F.col("_part").isNotNull())
    heads = parts.filter("_head").select("_hash", "_part", "_run", "_text", "_keep_id", "_group_size")
    best = F.min(F.struct(F.col("_keep_id").isNull().alias("none"), F.col("_keep_id").alias("id"), "_part")) if keep == "smallest" else F.max(F.struct("_keep_id", (-F.col("_part")).alias("_part")))
    one = heads.groupBy("_hash", "_text").agg(best.alias("_best"), F.sum("_group_size").alias("_group_size"))
    stays = (F.col("_best.id"), F.col("_best._part")) if keep == "smallest" else (F.col("_best._keep_id"), -F.col("_best._part"))
    one = heads.drop("_keep_id", "_group_size").join(one, ["_hash", "_text"]).select("_hash", "_part", "_run", stays[0].alias("_keep_id"), "_group_size", (stays[1] == F.col("_part")).alias("_here"))
    joined = parts.drop("_keep_id", "_group_size").join(one, ["_hash", "_part", "_run"]).withColumn("_head", F.col("_head") & F.col("_here"))
    return runs.filter(F.col("_part").isNull()).select(*out).unionByName(joined.select(*out)).withColumnRenamed("_head", "_kept")


def distinct_documents(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The row of docs that stays of each group of texts that are equal but for the case of A-Z, with its columns as they were."""
    return equal_runs(docs, lower_ascii(F.coalesce("text", F.lit(""))), "doc_id", keep, docs.columns).filter("_kept").select("_row.*")


def duplicate_verdicts(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row per document: the identifier that stays of its group, the group's size, and whether this row stays."""
    out = equal_runs(docs, lower_ascii(F.coalesce("text", F.lit(""))), "doc_id", keep, ["doc_id"])
    return out.select("_row.doc_id", F.col("_keep_id").alias("keep_id"), F.col("_group_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha256").alias("text_sha256"))


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM t
"""
