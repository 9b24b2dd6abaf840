"""Text expressions: white space, tokens, hashes, distances. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"(?U)\s+"
_ENDS = r"(?U)^\s+|\s+$"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_unicode(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), _ENDS, "")


def tokens(text: Column | str) -> Column:
    """Parts between runs of Unicode white space."""
    return F.filter(F.split(_col(text), _SPACE), lambda t: t != "")


def normalize_command(text: Column | str) -> Column:
    """Tokens joined by one space."""
    return F.array_join(tokens(text), " ")


def content_hash(command: Column | str, cwd: Column | str) -> Column:
    """Hex SHA-256 of the normalised command, a NUL and the trimmed folder."""
    return F.sha2(F.concat(normalize_command(command), F.char(F.lit(0)), trim_unicode(cwd)), 256)


def first_token(text: Column | str) -> Column:
    """The first token in lower case; null if there is none."""
    return F.lower(F.get(tokens(text), F.lit(0)))


def _bytes_as_chars(text: Column) -> Column:
    """One character for each byte of UTF-8."""
    return F.decode(text.cast("binary"), "ISO-8859-1")


def edit_distance(a: Column | str, b: Column | str, most: int | None = None) -> Column:
    """Levenshtein distance over bytes; -1 where it is above ``most``."""
    a, b = _bytes_as_chars(_col(a)), _bytes_as_chars(_col(b))
    return F.levenshtein(a, b) if most is None else F.levenshtein(a, b, most)


def max_distance(n_bytes: int) -> int:
    """Typos allowed in a query of this length."""
    return 0 if n_bytes < 2 else 1 if n_bytes < 5 else 2 if n_bytes < 8 else 3


def fuzzy_distance(query: str, text: Column | str, most: int) -> Column:
    """The least distance between the query and a token of ``text``; null if all are above ``most``."""
    q = query.lower()
    n = len(q.encode())
    near = F.filter(tokens(F.lower(_col(text))), lambda t: F.abs(F.octet_length(t) - n) <= most)
    distances = F.filter(F.transform(near, lambda t: edit_distance(t, F.lit(q), most)), lambda d: d >= 0)
    return F.array_min(distances)


def prefix_of_token(query: str, text: Column | str) -> Column:
    """Whether a token of ``text`` begins with the whole query."""
    q = query.lower()
    return F.exists(tokens(F.lower(_col(text))), lambda t: F.startswith(t, F.lit(q)))


def cwd_similarity(a: Column | str, b: Column | str) -> Column:
    """1 if equal; else the leading parts that two folders share, over the parts of the longer one."""
    a, b = _col(a), _col(b)
    parts = lambda path: F.filter(F.split(path, "/"), lambda p: p != "")
    x, y = parts(a), parts(b)
    differs = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
    shared = F.when(differs == 0, F.least(F.size(x), F.size(y)).cast("bigint")).otherwise(differs - 1)
    longest = F.greatest(F.size(x), F.size(y))
    return F.when(a == b, 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(shared / longest)


def trigrams(text: Column | str) -> Column:
    """Windows of three characters, repeats included; none below three characters."""
    text = _col(text)
    n = F.length(text)
    return F.when(n < 3, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))


def trigram_jaccard(a: Column, b: Column) -> Column:
    """Trigrams of ``a`` found in ``b``, over all of both less those; 0 where either has none."""
    both = F.size(F.filter(a, lambda t: F.array_contains(b, t)))
    union = F.size(a) + F.size(b) - both
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / union)


def word_overlap(query: list[str], target: Column) -> Column:
    """Query words among the target's, over the shorter list. If there are none: 0.7 of the share of query
    words, of three bytes or more, that begin a target word or begin with one."""
    if not query:
        return F.lit(0.0)
    q = F.array(*[F.lit(w) for w in query])
    shorter = F.least(F.lit(len(query)), F.size(target))
    exact = F.size(F.filter(q, lambda w: F.array_contains(target, w)))
    part = F.size(F.filter(q, lambda w: (F.octet_length(w) >= 3) & F.exists(target, lambda t: F.startswith(t, w) | F.startswith(w, t))))
    return F.when(F.size(target) == 0, 0.0).when(exact > 0, exact / shorter).otherwise(part / shorter * 0.7)


def clean_query(text: Column | str) -> Column:
    """A pasted query on one line: no carriage returns, line feeds and tabs as spaces."""
    return F.translate(F.translate(_col(text), "\r", ""), "\n\t", "  ")


def highlight_spans(query: str, text: Column | str) -> Column:
    """Start positions, from 0, of the hits of the query that do not overlap, whatever the case."""
    q = query.lower()
    if not q:
        return F.array().cast("array<int>")
    parts = F.split(F.lower(_col(text)), "\\Q" + q.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    ends = F.aggregate(
        F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("hits")),
        lambda acc, p: F.struct((acc.at + F.length(p) + len(q)).alias("at"), F.concat(acc.hits, F.array(acc.at + F.length(p))).alias("hits")),
        lambda acc: acc.hits,
    )
    return ends
