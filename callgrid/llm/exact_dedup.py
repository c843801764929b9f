"""Exact dedup by content sort, with DataFrame functions only.

Normalised texts are dealt out in ranges of content order (their first characters, then a hash of the
whole), with splitters from samples; an external sort places equal texts side by side, and neighbours are
compared in full. The row with the longest original text and then the smallest identifier leads its run.

A text that is found often enough in the sample to fill a range is hot: several ranges share it, side by
side in the order, and each has a run of its copies. The first rows of these runs, a few for each range
of the whole table, are compared in full again and their counts are added up. Where whole documents are
sorted, the first row of each hot text is found beforehand, by partial minima.

Null and empty texts are equal to each other (and to texts of white space only). Ties in length go to
the smallest identifier, a null identifier last. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from callgrid.llm.common import SPACE, carried, n_parts, order_id, stash, text_of

HEAD, SAMPLE_A_RANGE = 64, 100


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """The columns and _head, _rest: where a text lies in the order."""
    return docs.withColumn("_norm", normalised(F.col(text_col))).withColumns({"_head": F.substring("_norm", 1, HEAD), "_rest": F.xxhash64("_norm")})


def hot_texts(rows: DataFrame, text_col: str, parts: int, sample_a_range: int) -> DataFrame:
    """_head, _rest, _shares: the order keys that fill half a range or more by a sample of the rows, and
    in how many to cut them. Not more than two keys for each range; other results do not depend on it."""
    n = rows.count()
    some = keyed(rows.sample(min(1.0, sample_a_range * parts / max(1, n)), 17), text_col)
    least = max(2, sample_a_range // 2)
    return some.groupBy("_head", "_rest").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= least).select("_head", "_rest", F.ceil(F.col("c") / least).cast("int").alias("_shares"))


def runs(docs: DataFrame, id_col: str, text_col: str, carry: Column | None = None, sample_a_range: int = SAMPLE_A_RANGE) -> DataFrame:
    """The rows in content order with _rank and _n in their run of equal texts, _hot and _salt (the share
    of a hot text), and _best: the run's first row. carry: a struct to take along, with the text in it."""
    parts = n_parts(docs)
    took = [] if carry is None else [carry.alias("_row")]
    rows = docs.select(F.col(id_col).alias("_doc"), order_id(id_col).alias("_id"), F.char_length(text_of(text_col)).alias("_len"), F.col(text_col).alias("_text"), F.spark_partition_id().alias("_from"), *took)
    rows = keyed(rows, "_text").drop("_text")
    hot = stash(hot_texts(docs.select(F.col(text_col).alias("_text")), "_text", parts, sample_a_range))
    rows = rows.join(F.broadcast(hot), ["_head", "_rest"], "left")  # at most 2 * parts rows
    order = [F.desc("_len"), F.asc("_id")]
    if carry is None:
        rows = rows.withColumn("_by", F.xxhash64("_id", "_from"))
    else:
        rows = rows.withColumn("_by", F.xxhash64(F.to_json(F.col("_row").dropFields(text_col) if len(docs.columns) > 1 else F.struct(F.lit(0)))))
        order.append(F.asc("_by"))
    rows = rows.withColumns({"_salt": F.coalesce(F.pmod("_by", "_shares"), F.lit(0)).cast("int"), "_hot": F.col("_shares").isNotNull()}).drop("_shares", "_from")
    if carry is not None:
        own = F.when(F.col("_hot"), F.sha2("_norm", 256)).alias("_sha")
        first = rows.filter("_hot").groupBy(own).agg(F.min(F.struct((-F.col("_len")).alias("l"), "_id", "_by")).alias("_first"))
        rows = rows.withColumn("_sha", own).join(F.broadcast(stash(first)), "_sha", "left").drop("_sha")  # as few rows as hot texts
        # the text is in the row already
        rows = rows.drop("_norm").repartitionByRange(parts, "_head", "_rest", "_salt").withColumn("_norm", normalised(F.col("_row")[text_col]))
    else:
        rows = rows.repartitionByRange(parts, "_head", "_rest", "_salt")
    # the ranges serve this window: no second exchange; one sort, in which neighbours are compared in full
    equal = Window.partitionBy("_head", "_rest", "_salt", "_norm").orderBy(*order)
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.struct((-F.col("_len")).alias("l"), F.col("_id").alias("i"), F.col("_salt").alias("s"), F.col("_doc").alias("d"))
    return rows.withColumns({"_rank": F.row_number().over(equal), "_n": F.count(F.lit(1)).over(whole), "_best": F.first(first).over(whole)})


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_a_range: int = SAMPLE_A_RANGE) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = runs(docs, id_col, text_col, sample_a_range=sample_a_range)
    edge = F.when(F.col("_hot") & (F.col("_rank") == 1), F.col("_norm"))
    found = stash(found.select("_doc", "_salt", "_hot", "_rank", "_n", "_best", F.sha2("_norm", 256).alias("text_sha256"), edge.alias("_edge")))
    # the runs of one hot text become one, by its whole text; at most 4 * parts runs
    hot = found.filter(F.col("_edge").isNotNull()).groupBy("_edge").agg(F.min("_best").alias("_whole"), F.sum("_n").alias("_total"), F.first("text_sha256").alias("text_sha256")).drop("_edge")
    best = F.coalesce("_whole", "_best")
    out = found.join(F.broadcast(hot), "text_sha256", "left")
    # rows that repeat an identifier: the first of the sort stays
    return out.select(F.col("_doc").alias("doc_id"), best["d"].alias("keep_id"), F.coalesce("_total", "_n").cast("long").alias("group_size"), ((F.col("_rank") == 1) & (F.col("_salt") == best["s"])).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_a_range: int = SAMPLE_A_RANGE) -> DataFrame:
    """The documents that stay, with all their columns. Of rows that share identifier and text, the one
    whose other columns hash lowest stays."""
    first = runs(docs, id_col, text_col, carried(docs.columns), sample_a_range).filter("_rank = 1")
    best = (F.col("_first.l") == -F.col("_len")) & (F.col("_first._id") == F.col("_id")) & (F.col("_first._by") == F.col("_by"))
    return first.filter(~F.col("_hot") | best).select("_row.*")
