"""Class composition of a growing corpus, by source: which sources differ from the corpus as a whole, and in which class.

The compositional analysis of the study, for text: a source is a unit, its documents' languages are the classes. Documents
arrive as files in a folder. A file stream takes the new ones (``availableNow``, progress in the checkpoint) and keeps
counts by source and class for each batch, in a partition of ``<output>/counts`` that a repeated batch replaces.
From all counts, which are small, the table ``<output>/composition`` is made anew, partitioned by class:

    source, n_docs, n_words, share (of words), alr (log-ratio of words to the reference class, zeros replaced), gap (from
    the corpus's alr), distance (Aitchison distance of the source from the corpus), outside (gap beyond the margin), lang

Classes that the configuration does not name, null among them, are left out, as are sources without a word in the others;
a null source is one of its own. Words are runs without white space; a null text has none. A run without new files leaves
the result as it is, and a run that was cut short is repeated from its checkpoint. The first batch of a new checkpoint
replaces all counts, so output and checkpoint may be deleted apart.

    python -m jobs.corpus_composition --documents PATH --output PATH [--checkpoint PATH] [--config FILE]
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from tessella.functions import compositional as comp

NAME = "corpus_composition"
log = logging.getLogger(f"jobs.{NAME}")
DOCUMENTS = "text string, lang string, source string"
COUNTS = "source string, lang string, n_docs long, n_words long, batch long"
COMPOSITION = "source string, n_docs long, n_words long, share double, alr double, gap double, distance double, outside boolean, lang string"
WORD = r"[^\x20\x09-\x0D]+"


def counted(documents: DataFrame) -> DataFrame:
    """(source, lang, n_docs, n_words): summed in each task before anything is shuffled."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(words).alias("n_words"))


def composition(counts: DataFrame, config: dict) -> DataFrame:
    """The result from counts, a row a source and class."""
    classes = config["classes"]
    known = counts.where(F.col("lang").isin(*classes))
    sums = lambda what: [F.sum(F.when(F.col("lang") == c, F.col(what)).otherwise(0)).alias(f"{what}{k}") for k, c in enumerate(classes)]
    wide = known.groupBy("source").agg(*sums("n_docs"), *sums("n_words"))
    words = [f"n_words{k}" for k in range(len(classes))]
    whole = wide.agg(*(F.sum(w).alias(f"all{k}") for k, w in enumerate(words)))
    rows = wide.where(comp.total([F.col(w) for w in words]) > 0).crossJoin(F.broadcast(whole))  # one row
    parts, n = [F.col(w).cast("double") for w in words], range(len(classes))
    mine = comp.replace_zeros(parts, config["strength"])
    corpus = comp.replace_zeros([F.col(f"all{k}").cast("double") for k in n], config["strength"])
    rows = rows.withColumns({f"p{k}": mine[k] for k in n} | {f"q{k}": corpus[k] for k in n})
    mine, corpus, at = [F.col(f"p{k}") for k in n], [F.col(f"q{k}") for k in n], classes.index(config["reference"])
    each = F.explode(
        F.array(*(
            F.struct(
                F.lit(c).alias("lang"), F.col(f"n_docs{k}").alias("n_docs"), F.col(words[k]).alias("n_words"), (parts[k] / comp.total(parts)).alias("share"),
                F.ln(mine[k] / mine[at]).alias("alr"), (F.ln(mine[k] / mine[at]) - F.ln(corpus[k] / corpus[at])).alias("gap"),
            )
            for k, c in enumerate(classes)
        ))
    )
    rows = rows.select("source", comp.aitchison(mine, corpus).alias("distance"), each.alias("x")).select("source", "distance", "x.*")
    rows = common.rounded(rows, ["share", "alr", "gap", "distance"], config["digits"])
    rows = rows.withColumn("outside", F.abs("gap") > config["margin"])
    return rows.select("source", "n_docs", "n_words", "share", "alr", "gap", "distance", "outside", "lang")


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict | None = None) -> dict:
    """Take the new files and write the result anew; returns the numbers that are logged."""
    config = config or common.config(NAME)
    place = f"{output.rstrip('/')}/counts"
    rows = [0, 0]

    def take(batch: DataFrame, number: int) -> None:
        mine = counted(batch).withColumn("batch", F.lit(number).cast("long"))
        writer = mine.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static" if number == 0 else "dynamic")
        writer.partitionBy("batch").parquet(place)

    arriving = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(documents)
    stream = arriving.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    for progress in stream.recentProgress:
        rows = [rows[0] + (progress.numInputRows > 0), rows[1] + progress.numInputRows]
    log.info("%d new batches, %d rows read from %s", *rows, documents)
    counts = common.stored(spark, place, COUNTS)
    result = f"{output.rstrip('/')}/composition"
    made = composition(counts, config)
    made.repartition("lang").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("lang").parquet(result)
    n = read(spark, output).count()
    log.info("%d rows written to %s", n, result)
    return {"batches": rows[0], "read": rows[1], "written": n}


def read(spark: SparkSession, output: str) -> DataFrame:
    """The result as it stands."""
    return common.stored(spark, f"{output.rstrip('/')}/composition", COMPOSITION)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog=f"jobs.{NAME}", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--documents", required=True, help="folder of documents (Parquet), or a pattern of folders and files")
    parser.add_argument("--output", required=True)
    parser.add_argument("--checkpoint", help="by default inside the output")
    parser.add_argument("--config", help="JSON file with settings that differ from the defaults")
    args = parser.parse_args(argv)
    with common.session(NAME) as spark:
        run(spark, args.documents, args.output, args.checkpoint or f"{args.output.rstrip('/')}/checkpoint", common.config(NAME, args.config))
    return 0


if __name__ == "__main__":
    sys.exit(main())
