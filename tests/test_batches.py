"""Batches for Python hold a bounded number of bytes, whatever the length of texts."""

from pyspark.sql import functions as F

from lorewright.session import BATCH_BYTES, table


def test_batches_of_long_texts_are_bounded(spark, tmp_path):
    spark.range(300).select("id", F.repeat(F.lit("x"), 100_000).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/long.parquet")

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "n"])

    got = table(spark, str(tmp_path), "long").mapInArrow(sizes, "bytes long, n long").collect()
    assert sum(r.n for r in got) == 300 and max(r.bytes for r in got) < 2 * BATCH_BYTES
