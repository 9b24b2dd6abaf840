"""Statistics of a text's words, symbols and lines, and which texts are not prose."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The commonest words of some languages.
COMMON_WORDS = (
    "the be to of and a in that have i it for not on with he as you do at this but his by from they we her or an will my one all would there their what so up out if about who which when can is are was were has had been no than into its our "
    "der die das und ist nicht ein eine zu den von mit dem des auf im für sich als auch es an werden aus er hat dass wir sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr man "
    "le la les de et un une est que pour dans qui il pas sur au du en ne ce des se plus par avec ou sont nous on mais cette si tout était elle aux "
    "el los las y en que del se por con no una su para es lo como más al sus le ha o este sí porque esta entre cuando muy sin sobre hay ya fue "
    "il di che è per non sono con si da come più anche gli della nel alla o um os não uma mais foi het een van ik te dat niet op voor "
    "и в не на что с по как это он она они все из за от для то но же бы так у к о или если только при есть да мы вы я а "
    "і та що до є як або не "
    "και το της την του η ο να με για από σε που είναι στο στη τα οι θα δεν ένα μια αν"
)
_COMMON = sorted(set(COMMON_WORDS.split()))

#: A character that is no white space.
_SOLID = r"[^\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: All white space.
_SPACES = " \t\n\x0b\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

_VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýœ" "аеёиоуыэюяіїє" "αεηιουωάέήίόύώϊϋΐΰ"
#: Scripts of the vowels and common words above, and scripts that put no blanks between words.
_LISTED = r"\p{IsLatin}\p{IsCyrillic}\p{IsGreek}"
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"

# Shapes of lines.
_BULLET = r"^\s*(?:[-*+•‣◦·–]\s+|\(?\d{1,3}[.)]\s+|\(?[A-Za-z][.)]\s+|[-*]?\s*\[[ xX]\]\s)"
_ENTRY = r"^\s*[\x21-\x7e]*[/\\.=:_][\x21-\x7e]*[^\s.!?:;,]$"
# a line of a table: what it holds, and then its shape
_TABLE = {
    "|": (r"^\s*\|.*\|",),
    "\t": (r"\t[^\t]*\S[^\t]*\t",),
    "   ": (r"\S {3,}\S.*\S {2,}\S", r"\S {2,}\S.*\S {3,}\S"),
    ",": (r"^[^,]*(?:,(?:[^, ][^,]*)?){3,}$",),
}
_RULE = r"^[\s|+:\-=]{3,}$"
_LOG = r"^\s*(?:[\[(]?\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}|[\[(]?\d{2}:\d{2}:\d{2}\b|[A-Z][a-z]{2} {1,2}\d{1,2} \d{2}:\d{2}|: \d{6,}:\d+;|[$%] \S|#\d+ +0x|at [\w.$<>]+\(|File \"|Traceback|panic\b|\[?(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b)"
# the end of a sentence, what may close behind it, and blanks
_ENDS, _CLOSERS, _BLANKS = ".!?:;…。！？：；", "\"'”’)]»」", " \t\n\x0b\f\r"

#: Rules in order; the first that fails is the reason. Thresholds are those of published filters
#: (mean word length, alphabetic share, bullets, repeated lines, common words), and a half where a
#: text is called what most of it is.
THRESHOLDS = {
    "log_share": 0.5,
    "table_share": 0.5,
    "list_share": 0.5,
    "least_letters": 0.5,
    "repeated_lines": 0.5,
    "distinct_words": 0.15,
    "longest_mean_word": 12.0,
    "least_vowels": 0.2,
    "most_common": 0.75,
    "least_common": 0.04,
    "words_per_comma": 2.0,
    "least_words": 20,
    "vowel_words": 6,
    "enumeration_words": 8,
    "table_lines": 3,
}


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _kept(text: Column, others: str) -> Column:
    """Characters left when runs of the others are taken out: counts a class without a list of its hits."""
    return F.length(F.regexp_replace(text, others, "")).cast("bigint")


def _like(pattern: str):
    return lambda line: F.rlike(line, F.lit(pattern))


def _of_table(line: Column) -> Column:
    """Each shape is tried only on lines that hold what it needs."""
    shapes = [F.contains(line, F.lit(mark)) & reduce(or_, [F.rlike(line, F.lit(p)) for p in patterns]) for mark, patterns in _TABLE.items()]
    return reduce(or_, shapes) | F.rlike(line, F.lit(_RULE))


def _ended(line: Column) -> Column:
    """Whether the last character is the end of a sentence, but for closing marks and then blanks."""
    return F.right(F.rtrim(F.rtrim(line, F.lit(_BLANKS)), F.lit(_CLOSERS)), F.lit(1)).isin(list(_ENDS))


def _chars(lines: Column, test) -> Column:
    """Characters, without white space, of the lines that pass."""
    return F.aggregate(F.filter(lines, test), F.lit(0), lambda n, line: n + F.length(F.regexp_replace(line, r"\s+", "")))


def quality_stats(df: DataFrame, key: str, text: str, common_words: list[str] | None = None) -> DataFrame:
    """One row for each text: counts and ratios of its words, symbols and lines.

    Built-in expressions only, one map without shuffle, over whole texts. ``common_words`` replaces the list
    of the commonest words of some languages. Defined cases: a null text
    counts as an empty one, which has zero everywhere; repeated rows come out each; an empty table
    gives no rows; columns other than the two are not read.
    """
    t, low = F.col("_t"), F.col("_low")
    # in layers: what several columns need is a column of the layer below, and so made once
    body = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    cut = body.select(
        key, "_t", F.lower("_t").alias("_low"),
        F.filter(F.split("_t", r"\r\n|\r|\n"), lambda line: F.rlike(line, F.lit(_SOLID))).alias("_lines"),
        F.filter(F.split(F.lower("_t"), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("_words"),
    )
    joined = cut.withColumn("_joined", F.array_join("_words", ""))
    lettered = joined.withColumn("_letters", F.regexp_replace("_joined", r"\P{L}+", ""))
    letters = F.col("_letters")
    counted = lettered.select(
        key, "_lines",
        F.length(t).cast("bigint").alias("n_chars"), F.length(F.translate(t, _SPACES, "")).cast("bigint").alias("n_solid"), F.size("_words").cast("bigint").alias("n_words"), F.size("_lines").cast("bigint").alias("n_lines"),
        F.length("_joined").cast("bigint").alias("_in_words"), F.length(letters).cast("bigint").alias("_n_letters"),
        _kept(letters, r"\P{IsLatin}+").alias("_latin"), _kept(letters, f"[^{_LISTED}]+").alias("_listed"), _kept(letters, f"[^{_UNSPACED}]+").alias("_unspaced"),
        (F.length(letters) - F.length(F.translate(letters, _VOWELS, ""))).alias("_vowels"), (F.length(t) - F.length(F.translate(t, ",;", ""))).alias("_commas"),
        F.size(F.filter("_words", lambda w: w.isin(common_words or _COMMON))).alias("_common"), F.size(F.array_distinct("_words")).alias("_distinct"),
    )
    lines, n_words, n_lines, solid = F.col("_lines"), F.col("n_words"), F.col("n_lines"), F.col("n_solid")
    return counted.select(
        key, "n_chars", "n_solid", "n_words", "n_lines",
        _ratio(F.col("_in_words"), n_words).alias("mean_word"),
        _ratio(F.col("_n_letters"), solid).alias("letter_share"),
        _ratio(solid - F.col("_in_words"), solid).alias("symbol_share"),
        _ratio(F.col("_latin"), F.col("_n_letters")).alias("latin_share"),
        _ratio(F.col("_listed"), F.col("_n_letters")).alias("listed_share"),
        _ratio(F.col("_unspaced"), F.col("_n_letters")).alias("unspaced_share"),
        _ratio(F.col("_vowels"), F.col("_listed")).alias("vowel_share"),
        _ratio(F.col("_common"), n_words).alias("common_share"),
        _ratio(F.col("_distinct"), n_words).alias("distinct_share"),
        _ratio(n_words, F.col("_commas")).alias("words_per_comma"),
        _ratio(F.size(F.filter(lines, _ended)), n_lines).alias("ended_lines"),
        _ratio(n_lines - F.size(F.array_distinct(lines)), n_lines).alias("repeated_lines"),
        _ratio(_chars(lines, _like(_BULLET)), solid).alias("bullet_share"),
        _ratio(_chars(lines, _like(_ENTRY)), solid).alias("entry_share"),
        _ratio(_chars(lines, _of_table), solid).alias("table_share"),
        _ratio(_chars(lines, _like(_LOG)), solid).alias("log_share"),
    )


def reason(limits: dict[str, float] | None = None) -> Column:
    """Why a text is not prose, from the columns of ``quality_stats``; null if it is."""
    r = {**THRESHOLDS, **(limits or {})}
    c = F.col
    enough = c("n_words") >= r["least_words"]
    spaced = c("unspaced_share") < 0.5  # scripts without spaces between words have no word statistics
    listed = c("listed_share") >= 0.5
    return (
        F.when(c("n_solid") == 0, F.lit(None))
        .when(c("log_share") > r["log_share"], F.lit("log"))
        .when(c("bullet_share") > r["list_share"], F.lit("list"))
        .when((c("table_share") > r["table_share"]) & (c("n_lines") >= r["table_lines"]), F.lit("table"))
        .when(c("letter_share") < r["least_letters"], F.lit("symbols"))
        .when(c("entry_share") > r["list_share"], F.lit("entries"))
        .when((c("repeated_lines") > r["repeated_lines"]) & (c("n_lines") >= 4), F.lit("repeated lines"))
        .when(enough & (c("distinct_share") < r["distinct_words"]) & (c("common_share") > r["most_common"]), F.lit("common words only"))
        .when(enough & (c("distinct_share") < r["distinct_words"]) & (c("common_share") < 0.2), F.lit("repeated words"))
        .when(spaced & (c("mean_word") > r["longest_mean_word"]), F.lit("long words"))
        .when(listed & (c("n_words") >= r["vowel_words"]) & (c("vowel_share") < r["least_vowels"]), F.lit("no vowels"))
        .when(enough & (c("common_share") > r["most_common"]), F.lit("common words only"))
        .when(spaced & (c("n_words") >= r["enumeration_words"]) & (c("words_per_comma") > 0) & (c("words_per_comma") < r["words_per_comma"]), F.lit("enumeration"))
        .when(listed & enough & (c("common_share") < r["least_common"]), F.lit("no common words"))
    )


def not_prose(df: DataFrame, key: str, text: str, limits: dict[str, float] | None = None, common_words: list[str] | None = None) -> DataFrame:
    """(key, reason) of the texts that are not prose. Null, empty and blank texts are none of them."""
    # a filter on what is computed would be pushed below the statistics and work them all out a second time; beside a
    # random column it stays where it is
    failed = quality_stats(df, key, text, common_words).select(key, reason(limits).alias("reason"), F.rand(0).alias("_r"))
    return failed.where("reason is not null and _r >= 0").select(key, "reason")
