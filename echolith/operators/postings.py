"""An inverted index of trigrams, for substring search that need not read all texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.functions.text import trigrams
from echolith.operators.lexical import literal_match


class TrigramIndex:
    """(gram, id) pairs in files sorted by gram, so that a search reads the row groups of its grams only."""

    def __init__(self, spark: SparkSession, path: str, key: str = "content_hash"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def add(self, rows: DataFrame, columns: tuple[str, ...] = ("command", "cwd")) -> None:
        """Index rows; each text gives each of its trigrams once."""
        grams = [F.array_distinct(trigrams(F.lower(F.coalesce(F.col(c), F.lit(""))))) for c in columns]
        pairs = rows.select(self.key, F.explode(F.array_distinct(F.concat(*grams))).alias("gram"))
        # the key spreads a gram that a third of all rows have over several ranges
        pairs.repartitionByRange("gram", self.key).sortWithinPartitions("gram", self.key).write.mode("append").parquet(self.path)

    def search(self, rows: DataFrame, query: str, columns: tuple[str, ...] = ("command", "cwd")) -> DataFrame:
        """The same rows as a scan with ``literal_match``: candidates have all trigrams of all terms and are verified on the texts."""
        terms = [t.lower() for t in query.split() if len(t) >= 3]
        if not terms:
            return rows.limit(0)
        wanted = sorted({t[i : i + 3] for t in terms for i in range(len(t) - 2)})
        pairs = self.spark.read.parquet(self.path).where(F.col("gram").isin(wanted))
        hits = pairs.distinct().groupBy(self.key).agg(F.count("*").alias("_n")).where(F.col("_n") == len(wanted)).select(self.key)
        return rows.join(hits, self.key, "left_semi").where(literal_match(query, columns))
