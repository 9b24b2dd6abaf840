"""Ask, explain and learn over knowledge entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolith.functions import text
from echolith.functions.formats import format_confidence

LEAST_CONFIDENCE = 0.15


def prepared(entries: DataFrame) -> DataFrame:
    """With lower-case texts, words and trigrams as columns: made once for each entry, however many queries use them."""
    low = entries.withColumns({"_aliases": F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.lower), "_command": F.lower("command")})
    return low.withColumns({
        "_alias_words": F.transform("_aliases", text.tokens), "_command_words": text.tokens("_command"), "_description_words": text.tokens(F.lower("description")),
        "_grams": F.concat(F.transform("_aliases", text.trigrams), F.array(text.trigrams("_command"))),
    })


def score_entry(query: str, clamp: bool = False) -> Column:
    """How well an entry, with the columns of ``prepared``, answers a query.

    The best of: an alias (1 if equal, its word overlap, 0.85 if one contains the other), the command
    (0.95, 0.80 or 0.75 of the overlap), 0.70 of the description's overlap, 0.75 of the best trigram
    similarity. A query word that names the topic or category adds 0.05. An equal alias is 1 at once.
    Repeated query words can lift an overlap above 1; ``clamp`` cuts that.
    """
    q = query.lower()
    words = q.split()
    if not words:
        return F.lit(0.0)
    contains = lambda other: F.contains(F.lit(q), other) | F.contains(other, F.lit(q))
    best_of = lambda arr: F.coalesce(F.array_max(arr), F.lit(0.0))
    by_alias = F.greatest(best_of(F.transform("_alias_words", lambda w: text.word_overlap(words, w))), F.when(F.exists("_aliases", contains), 0.85).otherwise(0.0))
    by_command = F.when(F.col("_command") == q, 0.95).when(contains(F.col("_command")), 0.80).otherwise(text.word_overlap(words, F.col("_command_words")) * 0.75)
    by_description = text.word_overlap(words, F.col("_description_words")) * 0.70
    grams = text.trigrams(F.lit(q))
    by_gram = best_of(F.transform("_grams", lambda g: text.trigram_jaccard(grams, g))) * 0.75
    best = F.greatest(by_alias, by_command, by_description, by_gram)
    named = F.lower("topic").isin(words) | F.lower("category").isin(words)
    score = F.when(F.array_contains("_aliases", q), 1.0).when(named, F.least(F.lit(1.0), best + 0.05)).otherwise(best)
    return F.least(F.lit(1.0), score) if clamp else score


def ask(entries: DataFrame, query: str, limit: int = 5, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """The entries of at least this confidence, best first; equals in the order they were loaded."""
    # the limit comes before the threshold: the same rows, and no filter that scores every entry twice
    best = prepared(entries).withColumn("confidence", score_entry(query)).orderBy(F.desc("confidence"), "ordinal").limit(limit)
    return best.where(F.col("confidence") >= least).select(
        "ordinal", "command", "description", "category", "topic", "confidence", format_confidence("confidence").alias("confidence_text"), F.lit("Knowledge Base").alias("source")
    )


def ask_many(entries: DataFrame, questions: list[tuple[int, str]], limit: int = 5, least: float = LEAST_CONFIDENCE, block: int = 16) -> DataFrame:
    """(question_id, rank, ...) of many questions: entries are prepared once for each block of questions."""
    rows, out = prepared(entries), None
    for at in range(0, len(questions), block):
        scores = F.array(*[F.struct(F.lit(i).cast("bigint").alias("question_id"), score_entry(q).alias("confidence")) for i, q in questions[at : at + block]])
        each = rows.select("ordinal", "command", "description", "category", "topic", F.explode(scores).alias("s")).select("*", "s.*").drop("s")
        best = Window.partitionBy("question_id").orderBy(F.desc("confidence"), "ordinal")
        found = each.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= limit) & (F.col("confidence") >= least))
        out = found if out is None else out.unionByName(found)
    return out.withColumn("confidence_text", format_confidence("confidence"))


def explain(entries: DataFrame, command: str) -> DataFrame:
    """At most one entry: the first equal one, else the only one that begins so, else the first that contains the text or is contained."""
    q = command.lower()
    c = F.lower("command")
    rank = F.when(c == q, 0).when(F.startswith(c, F.lit(q)), 1).when(F.contains(c, F.lit(q)) | F.contains(F.lit(q), c), 2)
    ranked = entries.withColumn("_rank", rank).where("_rank is not null")
    prefixes = ranked.agg(F.count_if(F.col("_rank") <= 1)).scalar()
    # a beginning counts as such only if it is the only one, else it is just contained
    order = F.when((F.col("_rank") == 1) & (prefixes > 1), 2).otherwise(F.col("_rank"))
    return ranked.withColumn("_rank", order).orderBy("_rank", "ordinal").limit(1).select(*[x for x in entries.columns])


def learn(entries: DataFrame, topic: str, topics: DataFrame | None = None) -> DataFrame:
    """One row (topic, description, categories): categories by name, commands by difficulty; no row for an unknown topic."""
    q = topic.lower()
    mine = entries.where(F.lower("topic") == q)
    lines = F.array_sort(F.collect_list(F.struct("difficulty", "ordinal", "command", "description")))
    by_category = mine.groupBy("category").agg(lines.alias("lines")).select(
        F.struct(F.col("category").alias("name"), F.transform("lines", lambda x: F.struct(x.command.alias("command"), x.description.alias("description"), x.difficulty.alias("difficulty"))).alias("commands")).alias("c")
    )
    out = by_category.agg(F.array_sort(F.collect_list("c")).alias("categories")).where(F.size("categories") > 0)
    if topics is None:
        described = out.withColumn("description", F.lit(f"{topic} commands"))
    else:
        known = topics.where(F.col("topic") == q).agg(F.first("description")).scalar()
        described = out.withColumn("description", F.coalesce(known, F.lit(f"{topic} commands")))
    return described.select(F.lit(q).alias("topic"), "description", "categories")


def learn_flat(entries: DataFrame, topic: str) -> DataFrame:
    """``learn`` as rows: (category, place, command, difficulty)."""
    place = F.row_number().over(Window.partitionBy("category").orderBy("difficulty", "ordinal"))
    return entries.where(F.lower("topic") == topic.lower()).select("category", place.alias("place"), "command", "difficulty")


def topics(packs: DataFrame) -> DataFrame:
    """(topic, description) by name. Of full packs the last one's description holds, of simple ones the first's; columns topic, description, simple, load_order."""
    named = packs.withColumn("topic", F.lower("topic"))
    full = F.max_by(F.when(~F.col("simple"), F.col("description")), F.when(~F.col("simple"), F.col("load_order")))
    simple = F.min_by(F.col("description"), F.col("load_order"))
    return named.groupBy("topic").agg(F.coalesce(full, simple).alias("description")).orderBy("topic")


def pack_sizes(entries: DataFrame, by: str = "source") -> DataFrame:
    return entries.groupBy(by).agg(F.count("*").alias("entries"))


def supplement(results: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers to show beside search results: those of 0.5 or more if nothing matched exactly or the best score
    is below 0.5; the first three, whatever their confidence, if there is no result at all."""
    n = results.agg(F.count("*")).scalar()
    weak = results.agg((F.count_if(F.col("match_kind").isin("exact", "prefix")) == 0) | (F.coalesce(F.max("score"), F.lit(0.0)) < 0.5)).scalar()
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("confidence"), "ordinal"))
    return answers.withColumn("_place", place).where(F.when(n == 0, F.col("_place") <= 3).otherwise(weak & (F.col("confidence") >= 0.5))).drop("_place")


def union_entries(frames: list[DataFrame]) -> DataFrame:
    """Built-in and own entries, in order, without removing doubles."""
    return reduce(DataFrame.unionByName, frames)
