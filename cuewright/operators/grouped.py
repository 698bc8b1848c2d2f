"""Functions over the rows of one small group after the other, where groups are many, and checkpoints."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def each_group(rows: DataFrame, key: str, order: list[str], run: Callable, columns: str) -> DataFrame:
    """key and `columns` (name type, ...): what run(list of tuples of one group, in the order of `order`) gives, tuples without the key.

    Groups are read one after the other from sorted partitions, so a batch holds many of them and a task one at a
    time; a grouped function would pay for a data frame each. Nulls are None, and a null key is a group.
    """
    at = rows.columns.index(key)
    kinds = [c.split() for c in columns.split(", ")]

    def batches(frames):
        from itertools import chain, groupby

        import pyarrow as pa

        known = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
        first = next(frames, None)
        if first is None:
            return
        fields = [(key, first.schema.field(key).type), *[(n, known[k]) for n, k in kinds]]

        def made(out):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

        tuples = chain.from_iterable(zip(*[c.to_pylist() for c in f.columns], strict=True) for f in chain([first], frames))
        out = []
        for k, own in groupby(tuples, key=lambda r: r[at]):
            out += [(k, *r) for r in run(list(own))]
            if len(out) >= 10_000:
                yield made(out)
                out = []
        if out:
            yield made(out)

    # a number of its own: by their bytes, groups would be put together into a few tasks, however long a function takes over them
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, key).sortWithinPartitions(key, *[F.asc_nulls_last(c) for c in order])
    return dealt.mapInArrow(batches, f"{key} {dict(rows.dtypes)[key]}, {columns}")


def settle(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df in the shared folder of the session."""
    spark = df.sparkSession
    _folder(spark)
    return df.checkpoint()


def _folder(spark: SparkSession) -> None:
    if not spark.sparkContext.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp())
