"""Lexical search: substring terms, then prefixes and typos, then a weighted score."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolith.functions import filters, text


@dataclass(frozen=True)
class Weights:
    match: float = 0.50
    recency: float = 0.20
    frequency: float = 0.20
    cwd: float = 0.10


_KINDS = {"exact": 1.0, "prefix": 0.75, "partial": 0.5, "fuzzy": 0.25}
_RESULT = ["command", "cwd", "exit_code", "duration_ms", "completed_at_ms", "run_count"]


def candidate_cap(limit: int) -> int:
    return max(8 * limit, 200)


# terms ------------------------------------------------------------------------------------------
def _term(term: str, columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(F.col(c)), F.lit(term.lower()))
    return out


def literal_match(query: str, columns: tuple[str, ...] = ("command", "cwd")) -> Column:
    """All terms of three characters or more occur in a column, in any order; with none such, nothing matches."""
    terms = [t for t in query.split() if len(t) >= 3]
    out = F.lit(bool(terms))
    for term in terms:
        out = out & _term(term, list(columns))
    return out


_LEX = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<mark>[()]|:)|(?P<word>[^\s()":]+))')


class _Parser:
    """Terms, "phrases", AND / OR / NOT, parentheses, column:term and term*."""

    def __init__(self, query: str, columns: tuple[str, ...]):
        self.columns, self.tokens, at = list(columns), [], 0
        query = query.rstrip()
        while at < len(query):
            m = _LEX.match(query, at)
            if not m:
                raise ValueError(f"not understood: {query[at:]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] in texts and self.tokens[self.at][0] != "quoted"

    def either(self) -> Column:
        out = self.both()
        while self.peek("OR"):
            self.at += 1
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.unless()
        while self.at < len(self.tokens) and not self.peek("OR", ")"):
            if self.peek("AND"):
                self.at += 1
            out = out & self.unless()
        return out

    def unless(self) -> Column:
        out = self.one()
        while self.peek("NOT"):
            self.at += 1
            out = out & ~self.one()
        return out

    def one(self) -> Column:
        if self.at >= len(self.tokens):
            raise ValueError("a term is missing")
        if self.peek("("):
            self.at += 1
            out = self.either()
            if not self.peek(")"):
                raise ValueError("a parenthesis is not closed")
            self.at += 1
            return out
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == "word" and self.peek(":"):
            if word not in self.columns:
                raise ValueError(f"no such column: {word}")
            self.at += 1
            inner, self.columns = self.columns, [word]
            try:
                return self.one()
            finally:
                self.columns = inner
        if kind == "quoted":
            word = word[1:-1].replace('""', '"')
        elif kind == "mark" or word in ("AND", "OR", "NOT"):
            raise ValueError(f"unexpected: {word}")
        word = word.removesuffix("*") if kind == "word" else word
        return _term(word, self.columns) if len(word) >= 3 else F.lit(False)


def syntax_match(query: str, columns: tuple[str, ...] = ("command", "cwd")) -> Column:
    """The query language instead of literal terms; a query that is not well formed raises ValueError."""
    parser = _Parser(query, columns)
    out = parser.either()
    if parser.at < len(parser.tokens):
        raise ValueError(f"unexpected: {parser.tokens[parser.at][1]}")
    return out


# candidates and scores --------------------------------------------------------------------------
def classify(query: str, command: str = "command", cwd: str = "cwd") -> Column:
    """A verbatim hit is exact, a token's beginning a prefix, all else partial."""
    q = F.lit(query.lower())
    verbatim = F.contains(F.lower(F.col(command)), q) | F.contains(F.lower(F.col(cwd)), q)
    return F.when(verbatim, "exact").when(text.prefix_of_token(query, command), "prefix").otherwise("partial")


def _newest(rows: DataFrame, n: int | None, tie: str) -> DataFrame:
    return rows if n is None else rows.orderBy(F.desc("completed_at_ms"), tie).limit(n)


def candidates(history: DataFrame, query: str, limit: int, syntax: str = "literal", tie: str = "content_hash", cap: int | None = -1, keep_fuzzy: bool = False) -> DataFrame:
    """Rows that the query may mean, at most twice the cap, with ``match_kind``.

    First the newest rows with the terms. If they are fewer than ``limit``, also those of the newest rows
    in which a token begins with the query or is a few typos away. Both branches are one plan: the second
    one's rows are dropped by a count over the first one's.
    """
    query = query.strip()
    n_bytes = len(query.encode())
    cap = candidate_cap(limit) if cap == -1 else cap
    match = {"literal": literal_match, "syntax": syntax_match}[syntax](query) if n_bytes >= 3 else F.lit(False)
    fields = [*_RESULT, tie]
    rows = history.select(*dict.fromkeys(fields))
    by_terms = _newest(rows.where(match), cap, tie).withColumn("_scan", F.lit(0))
    most = text.max_distance(n_bytes)
    begins = text.prefix_of_token(query, "command")
    near = F.lit(False) if most == 0 else text.fuzzy_distance(query, "command", most).isNotNull()
    scanned = _newest(rows, cap, tie).where(begins | near).withColumn("_scan", F.lit(1))
    # bounded by the cap, so one task may hold them; without a cap they are counted apart
    everything, alike = Window.partitionBy(F.lit(0)), Window.partitionBy("command", "cwd")
    both = by_terms.unionByName(scanned)
    hits = F.count_if(F.col("_scan") == 0).over(everything) if cap is not None else by_terms.agg(F.count("*")).scalar()
    both = both.withColumn("_hits", hits).withColumn("_least", F.min("_scan").over(alike))
    kept = both.where((F.col("_scan") == 0) | ((F.col("_hits") < limit) & (F.col("_least") == 1)))
    kind = classify(query)
    if keep_fuzzy:
        kind = F.when((kind == "partial") & (F.col("_scan") == 1), "fuzzy").otherwise(kind)
    return kept.withColumn("match_kind", kind).drop("_scan", "_hits", "_least")


def search(
    history: DataFrame, query: str, limit: int = 20, cwd: str | None = None, recent_only: bool = False, weights: Weights = Weights(), syntax: str = "literal",
    product: str = filters.PRODUCT, tie: str = "content_hash", cap: int | None = -1, keep_fuzzy: bool = False,
) -> DataFrame:
    """Ranked rows with ``match_kind`` and ``score``; a blank query finds nothing."""
    if not query.strip():
        return history.select(*dict.fromkeys([*_RESULT, tie])).limit(0).withColumns({"match_kind": F.lit(""), "score": F.lit(0.0)})
    pool = candidates(history, query, limit, syntax, tie, cap, keep_fuzzy)
    everything = Window.partitionBy(F.lit(0))
    if recent_only:
        best = pool.orderBy(F.desc("completed_at_ms"), tie).limit(limit)
        place = F.row_number().over(everything.orderBy(F.desc("completed_at_ms"), tie)) - 1
        return best.withColumn("score", 1.0 - place / F.count("*").over(everything)).orderBy(F.desc("completed_at_ms"), tie)
    return _scored(pool, everything if cap is not None else None, cwd, weights, product).orderBy(F.desc("score"), F.desc("completed_at_ms"), tie).limit(limit)


def _scored(pool: DataFrame, over, cwd: str | None, weights: Weights, product: str) -> DataFrame:
    at, runs = F.col("completed_at_ms"), F.col("run_count")
    if over is None:  # no bound on the pool: its extremes are an aggregate of their own
        first, last, most = (pool.agg(e).scalar() for e in (F.min(at), F.max(at), F.max(runs)))
    else:
        first, last, most = F.min(at).over(over), F.max(at).over(over), F.max(runs).over(over)
    match = F.lit(0.0)
    for kind, value in _KINDS.items():
        match = F.when(F.col("match_kind") == kind, value).otherwise(match)
    recency = F.when(last == first, 1.0).otherwise((at - first) / (last - first))
    frequency = F.when(most <= 1, 0.0).otherwise((runs - 1) / (most - 1))
    near = text.cwd_similarity(F.lit(cwd), F.col("cwd")) if cwd is not None else F.lit(0.0)
    score = weights.match * match + weights.recency * recency + weights.frequency * frequency + weights.cwd * near
    return pool.withColumn("score", F.when(filters.is_internal("command", product), 0.0).otherwise(score))


def batch_search(
    history: DataFrame, queries: list[tuple[int, str]], limit: int = 20, weights: Weights = Weights(), product: str = filters.PRODUCT, tie: str = "content_hash", block: int = 500, cap: int | None = -1,
) -> DataFrame:
    """Many searches as one job: (query_id, ... , score), by terms only, without the branch of beginnings and typos.

    Each query is looked for by one trigram, the middle one of its longest term: a row meets a query only if it holds that,
    and is then tested for all terms. Every query keeps its newest rows up to the ``cap``, a limit that Spark
    applies in each task before the shuffle (None: all of them), and scores are computed for each query apart.
    """
    spark, out = history.sparkSession, None
    cap = candidate_cap(limit) if cap == -1 else cap
    rows = history.select(*dict.fromkeys([*_RESULT, tie])).withColumn("_c", F.lower("command")).withColumn("_w", F.lower("cwd"))
    for at in range(0, len(queries), block):
        part = [(i, q.strip().lower(), [t for t in q.lower().split() if len(t) >= 3]) for i, q in queries[at : at + block]]
        longest = [(*p, max(p[2], key=len)) for p in part if p[2]]
        marked = [(i, q, terms, t[(len(t) - 3) // 2 :][:3]) for i, q, terms, t in longest]
        asked = spark.createDataFrame(marked, "query_id bigint, query string, terms array<string>, gram string")
        grams = F.array(*[F.lit(g) for g in sorted({m[3] for m in marked})]) if marked else F.array().cast("array<string>")
        held = F.filter(grams, lambda g: F.contains(F.col("_c"), g) | F.contains(F.col("_w"), g))
        hit = F.forall("terms", lambda t: F.contains(F.col("_c"), t) | F.contains(F.col("_w"), t))
        found = rows.withColumn("gram", F.explode(held)).join(asked, "gram").where(hit).drop("gram")
        newest = Window.partitionBy("query_id").orderBy(F.desc("completed_at_ms"), tie)
        pool = found if cap is None else found.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= cap)
        verbatim = F.contains(F.col("_c"), F.col("query")) | F.contains(F.col("_w"), F.col("query"))
        pool = pool.withColumn("match_kind", F.when(verbatim, "exact").otherwise("partial"))
        scored = _scored(pool, Window.partitionBy("query_id"), None, weights, product)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("completed_at_ms"), tie)
        ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit).select("query_id", "rank", *dict.fromkeys([*_RESULT, tie]), "match_kind", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out
