"""Shared helpers of the tests."""

from velum.operators import kb


def lexicon(spark):
    return kb.new_rows(spark.createDataFrame(kb.lexicon_rows(), "header_raw string, label string"))


def feed(spark, folder, schema, batches):
    """A file stream that sees one batch of rows per micro-batch."""
    path = str(folder)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
