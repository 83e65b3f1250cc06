"""Spark plumbing that the corpus operators share: unique keys, written intermediates, column names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.sources.tables import discard, shared_folder, written  # noqa: F401


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, lengthened until no column of df has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def unique_ids(df: DataFrame, id_col: str) -> bool:
    """Whether no two rows share an id and none is null."""
    seen = df.groupBy(F.col(id_col).alias("k")).count()
    return seen.filter((F.col("count") > 1) | F.col("k").isNull()).limit(1).count() == 0


def keyed(df: DataFrame, id_col: str, text_col: str, key: str) -> tuple[DataFrame, str]:
    """df and the name of a long column that is unique, not null, and orders rows by (id, nulls last; text, nulls last).

    The id itself where it is a unique long. Otherwise rows are numbered in that order as `key`, which costs a range
    shuffle; the numbered table is written, so that the numbers stay.
    """
    if isinstance(df.schema[id_col].dataType, T.LongType) and unique_ids(df, id_col):
        return df.filter(F.col(id_col).isNotNull()), id_col  # stated, so that all joins shuffle the same rows and can share it
    rest = [c for c in df.columns if c not in (id_col, text_col) and not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    ordered = df.orderBy(F.col(id_col).asc_nulls_last(), F.col(text_col).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in rest])
    return written(ordered.withColumn(key, F.monotonically_increasing_id())), key


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, which is sorted, with the number of each row in the column `name`. Written, so that numbers stay.

    Rows are counted within their partition, and partitions (a row each) are summed.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(at, at + batch.num_rows), pa.int64())], names=[*batch.schema.names, "_at"])
            at += batch.num_rows

    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])
    rows = written(df.withColumn("_part", F.spark_partition_id()).mapInArrow(number, schema))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_from") + F.col("_at")).drop("_part", "_at", "_from")  # a row per partition


def bounded(rows: DataFrame, id_col: str, most: int, strata: str | None = None) -> list:
    """At most `most` rows on the driver, those of the least hash of their id, in the order of the hash.

    With a column `strata` each of its values gets an equal part of `most`, and what some don't fill goes to the
    others; so no value is missed for being rare. Rows are thinned by hash before they are sorted, by value.
    """
    bits = 1 << 20
    h = F.xxhash64(F.col(id_col).cast("string"))
    low = F.pmod(h, F.lit(bits))
    if strata is None:
        total = rows.select(id_col).count()
        share = min(1.0, 1.3 * most / max(total, 1))
        return rows.filter(low <= int(share * bits)).orderBy(low, h, id_col).limit(most).collect()
    counts = {r[0]: r[1] for r in rows.groupBy(strata).count().orderBy(F.col("count").desc(), strata).limit(most).collect()}
    quota, left, free = {}, most, sorted(counts, key=lambda v: (counts[v], str(v)))
    for i, v in enumerate(free):
        quota[v] = min(counts[v], max(1, left // (len(free) - i)))
        left -= quota[v]
    limit = F.create_map(*(F.lit(x) for v in free for x in (v, int(min(1.0, (1.3 * quota[v] + 50) / counts[v]) * bits)))) if free else F.create_map()
    near = rows.filter(low <= F.coalesce(F.try_element_at(limit, F.col(strata)), F.lit(-1))) if free else rows.limit(0)
    out: list = []
    for r in near.orderBy(low, h, id_col).collect():  # 1.3 times `most` and 50 rows a value, at most
        if quota[r[strata]] > 0:
            quota[r[strata]] -= 1
            out.append(r)
    return out
