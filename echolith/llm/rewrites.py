"""Records that differ only in how they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolith.runtime import materialize

_TRIM = r"(?U)^\s+|\s+$"
_NOT_WORD = r"[^\p{L}\p{N}]+"
#: Members of a group that one task pairs with as many others.
_BLOCK = 1_000
#: Parts of a large group in which its members learn how many blocks it has.
_SALTS = 64


def words(text: Column) -> Column:
    """Maximal runs of letters and digits, in lower case, sorted."""
    return F.array_sort(F.filter(F.split(F.lower(text), _NOT_WORD), lambda w: w != ""))


def _ids(col: Column, name: str) -> list[Column]:
    """A value's integer identifier: two independent 64-bit hashes, so that no table of numbers need be shared.

    Of 1e12 values any two share both with a probability of about 1e-15.
    """
    return [F.xxhash64(col).alias(f"{name}1"), F.xxhash64(F.lit(name), col, F.lit(1)).alias(f"{name}2")]


def encoded(df: DataFrame, text: str, place: str, variant: str) -> DataFrame:
    """Distinct records as integers: (t1, t2, p1, p2, variant, copies, first_id columns).

    Each distinct ``text`` is canonicalised once in a dictionary from its identifier to that of
    its sorted words; records are rewritten through the dictionary. Copies are folded before any
    shuffle, so a line with a third of all rows is one row for each task.
    """
    base = df.where(F.col(text).isNotNull() & F.col(place).isNotNull())
    trimmed = F.regexp_replace(F.col(place), _TRIM, "")
    records = base.groupBy(*_ids(F.col(text), "r"), *_ids(trimmed, "p"), F.col(variant).alias("variant")).agg(F.count("*").alias("copies"))
    dictionary = (
        base.groupBy(*_ids(F.col(text), "r")).agg(F.first(text).alias("_text"))
        .withColumn("_words", words(F.col("_text")))
        .select(F.col("r1").alias("d1"), F.col("r2").alias("d2"), *_ids(F.col("_words"), "t"))
    )
    return records.join(dictionary, (F.col("r1") == F.col("d1")) & (F.col("r2") == F.col("d2"))).select("t1", "t2", "p1", "p2", "variant", "copies")


_GROUP = ["t1", "t2", "p1", "p2"]


def variant_pairs(df: DataFrame, text: str, place: str, variant: str) -> DataFrame:
    """Pairs (variant_a, variant_b), the smaller first, of different ``variant`` values whose records
    have the same words, as often, in ``text`` and the same trimmed ``place``.

    All pairs are given, each once. A group of more than a thousand members is cut into blocks of about as many; a
    task pairs the members of one block, or of two, so no task holds a whole group. What says which groups are cut is one
    row for each thousand members at most, and meets the members in 64 parts of each group.

    Defined cases: a null in ``text``, ``place`` or ``variant`` makes no pair; texts without any word
    have the same (no) words; repeated rows make no more pairs; empty tables give none.
    """
    members = materialize(encoded(df, text, place, variant).where("variant is not null").select(*_GROUP, "variant").distinct(), "variants")
    large = members.groupBy(*_GROUP).agg(F.count("*").alias("size")).where(F.col("size") > _BLOCK)
    large = large.select(*_GROUP, F.ceil(F.col("size") / F.lit(_BLOCK)).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    large = materialize(large, "large-groups")
    if large.isEmpty():  # every group is one block
        salted = members.withColumn("blocks", F.lit(1))
    else:
        salted = members.withColumn("salt", F.pmod(F.xxhash64("variant", F.lit(1)), F.lit(_SALTS)).cast("int")).join(large, [*_GROUP, "salt"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    cells = salted.groupBy(*_GROUP, blocks.alias("blocks"), F.pmod(F.xxhash64("variant"), blocks).cast("int").alias("block")).agg(F.array_sort(F.collect_set("variant")).alias("some"))
    own = cells.where(F.size("some") > 1).select(F.posexplode("some").alias("at", "a"), "some").select("a", F.explode(F.slice("some", F.col("at") + 2, F.size("some"))).alias("b"))
    cut = cells.where("blocks > 1")
    left = cut.select(*_GROUP, F.col("some").alias("a"), F.col("block").alias("i"), F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j > F.col("block"))).alias("j"))
    right = cut.select(*_GROUP, F.col("some").alias("b"), F.col("block").alias("j"), F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: i < F.col("block"))).alias("i"))
    across = left.join(right, [*_GROUP, "i", "j"]).select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b"))
    return own.unionByName(across).select(F.least("a", "b").alias("variant_a"), F.greatest("a", "b").alias("variant_b")).distinct()


def collapsed(df: DataFrame, text: str, place: str, variant: str) -> DataFrame:
    """One row for each canonical record: (variant: the smallest, n_variants, n_copies).

    Records with a null text or place are left out; null variants count as copies but not as variants.
    """
    return (
        encoded(df, text, place, variant).groupBy(*_GROUP, "variant").agg(F.sum("copies").alias("copies"))
        .groupBy(*_GROUP).agg(F.min("variant").alias("variant"), F.count("variant").alias("n_variants"), F.sum("copies").alias("n_copies"))
        .drop(*_GROUP)
    )
