from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]])"""
    full = [tuple(r) + ("en", "s")[len(r) - 2 :] + (len(r[1] or ""),) for r in rows]
    return spark.createDataFrame(full, DOCS)


def store(spark, tmp_path, name, df):
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def clashing(frame, *names):
    """``frame`` with more columns of the given names, after its own."""
    for name in names:
        frame = frame.withColumn(name, F.lit("own"))
    return frame
