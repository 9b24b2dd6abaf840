"""Queries of search: lexical, vector, hybrid and knowledge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.functions import embedding, filters, formats, text
from echolith.operators import hybrid, knowledge, lexical, stats, vector
from echolith.operators.postings import TrigramIndex
from echolith.plans import views
from echolith.plans.views import HISTORY, KNOWLEDGE, NAMED, normal, tokens
from echolith.runtime import fresh_path
from echolith.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names})


# lexical ----------------------------------------------------------------------------------------------
@query("select doc_id from documents where contains(lower(text), 'snapshot')")
def substring_search(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(lexical.literal_match("snapshot", ("text",))).select("doc_id")


@query("select doc_id from documents where (contains(lower(text), 'replica') or contains(lower(source), 'replica')) and (contains(lower(text), 'wiki') or contains(lower(source), 'wiki'))")
def multi_term_search(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(lexical.literal_match("wiki of replica", ("text", "source"))).select("doc_id")


@query("select doc_id from documents where (contains(lower(text), 'git rebase') or contains(lower(source), 'git rebase') or (contains(lower(source), 'runbook'))) and not (contains(lower(text), 'cache') or contains(lower(source), 'cache'))")
def syntax_search(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(lexical.syntax_match('("git rebase" OR source:runbook) NOT cache', ("text", "source"))).select("doc_id")


@query(f"with {HISTORY} select content_hash from hist where len([t for t in {tokens('lower(command)')} if starts_with(t, 'dock')]) > 0")
def prefix_search(spark: SparkSession, sf: str) -> DataFrame:
    return views.history(spark, sf).where(text.prefix_of_token("dock", "command")).select("content_hash")


@query(f"""with {HISTORY}, d as (select content_hash, list_min([levenshtein(t, 'dokcer') for t in {tokens('lower(command)')} if abs(strlen(t) - 6) <= 2]) as distance from hist)
select content_hash, distance::int as distance from d where distance <= 2""")
def fuzzy_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.history(spark, sf).select("content_hash", text.fuzzy_distance("dokcer", "command", text.max_distance(6)).alias("distance"))
    return rows.where("distance is not null")


_PLACE = "/srv/apps/kalin-dc4/deploy"
_SHARED = "len([i for i in range(1, least(len(x), len(y)) + 1) if x[1:i] = y[1:i]])"


def _similar(column: str, place: str) -> str:
    part = f"[p for p in string_split('{place}', '/') if p <> '']"
    return f"""(select case when {column} = '{place}' then 1.0 when len(x) = 0 or len(y) = 0 then 0.0 else {_SHARED}::double / greatest(len(x), len(y)) end
from (select {part} as x, [p for p in string_split({column}, '/') if p <> ''] as y))"""


@query(f"with {HISTORY} select content_hash, round({_similar('cwd', _PLACE)}, 6) as similarity from hist")
def cwd_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(views.history(spark, sf).select("content_hash", text.cwd_similarity(F.lit(_PLACE), F.col("cwd")).alias("similarity")), 6, "similarity")


_NOISE = views.quoted(filters.NOISE_WORDS)
_INTERNAL = f"({views.token('command')} = '{filters.PRODUCT}' or starts_with({views.token('command')}, '{filters.PRODUCT}-') or {views.token('command')} in ({_NOISE}))"
_SCORE = """
case when {internal} then 0.0 else 0.5 * case match_kind when 'exact' then 1.0 when 'prefix' then 0.75 else 0.5 end
+ 0.2 * case when max(completed_at_ms) over () = min(completed_at_ms) over () then 1.0 else (completed_at_ms - min(completed_at_ms) over ())::double / (max(completed_at_ms) over () - min(completed_at_ms) over ()) end
+ 0.2 * case when max(run_count) over () <= 1 then 0.0 else (run_count - 1)::double / (max(run_count) over () - 1) end + 0.1 * {near} end"""
_OUT = "content_hash, command, run_count, match_kind, score"
_TWO = "contains(lower(command) , '{0}') or contains(lower(cwd), '{0}')"
_DOCKER = f"""{HISTORY}, pool as (select *, case when {_TWO.format('docker compose')} then 'exact' else 'partial' end as match_kind from hist
where ({_TWO.format('docker')}) and ({_TWO.format('compose')}) order by completed_at_ms desc, content_hash limit 200)"""


@query(f"with {_DOCKER}, s as (select *, {_SCORE.format(internal=_INTERNAL, near=_similar('cwd', _PLACE))} as score from pool) select content_hash, command, run_count, match_kind, round(score, 6) as score from s order by s.score desc, completed_at_ms desc, content_hash limit 20")
def lexical_scored(spark: SparkSession, sf: str) -> DataFrame:
    found = lexical.search(views.history(spark, sf), "docker compose", 20, cwd=_PLACE)
    return _rounded(found.select(*_OUT.split(", ")), 6, "score")


@query(f"""with {HISTORY}, scan as (select * from hist order by completed_at_ms desc, content_hash limit 200),
pool as (select *, 'partial' as match_kind from scan where list_min([levenshtein(t, 'dokcer') for t in {tokens('lower(command)')} if abs(strlen(t) - 6) <= 2]) <= 2),
s as (select *, {_SCORE.format(internal=_INTERNAL, near='0.0')} as score from pool) select content_hash, command, run_count, match_kind, round(score, 6) as score from s order by s.score desc, completed_at_ms desc, content_hash limit 20""")
def lexical_typo(spark: SparkSession, sf: str) -> DataFrame:
    """No row has the term, so the second branch comes in."""
    return _rounded(lexical.search(views.history(spark, sf), "dokcer", 20).select(*_OUT.split(", ")), 6, "score")


@query(f"with {_DOCKER}, best as (select * from pool order by completed_at_ms desc, content_hash limit 20) select content_hash, command, run_count, match_kind, round(1.0 - (row_number() over (order by completed_at_ms desc, content_hash) - 1)::double / count(*) over (), 6) as score from best")
def lexical_recent_only(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(lexical.search(views.history(spark, sf), "docker compose", 20, recent_only=True).select(*_OUT.split(", ")), 6, "score")


_MANY = [(1, "docker compose"), (2, "kubectl logs"), (3, "git push"), (4, "terraform apply"), (5, "replica"), (6, "zz")]
_ASKED = ", ".join(f"({i}, '{q}', [{views.quoted([t for t in q.split() if len(t) >= 3])}]::varchar[])" for i, q in _MANY)


@query(f"""with {HISTORY}, q(query_id, query, terms) as (values {_ASKED}),
hits as (select query_id, query, hist.* from hist, q where len(terms) > 0 and len([t for t in terms if contains(lower(command), t) or contains(lower(cwd), t)]) = len(terms)),
pool as (select *, case when {_TWO.replace("'{0}'", 'query')} then 'exact' else 'partial' end as match_kind from hits qualify row_number() over (partition by query_id order by completed_at_ms desc, content_hash) <= 200),
s as (select *, {_SCORE.format(internal=_INTERNAL, near='0.0').replace('over ()', 'over (partition by query_id)')} as score from pool)
select query_id, row_number() over (partition by query_id order by score desc, completed_at_ms desc, content_hash)::int as rank, content_hash, match_kind, round(score, 6) as score from s
qualify row_number() over (partition by query_id order by s.score desc, completed_at_ms desc, content_hash) <= 20""")
def batch_search(spark: SparkSession, sf: str) -> DataFrame:
    found = lexical.batch_search(views.history(spark, sf), _MANY, 20)
    return _rounded(found.select("query_id", "rank", "content_hash", "match_kind", "score"), 6, "score")


# vectors ----------------------------------------------------------------------------------------------
_DISTANCE = "1 - list_inner_product(embedding::double[], (select embedding from embeddings where vec_id = 0)::double[])"
_NEAR = f"near as (select vec_id as command_id, {_DISTANCE} as distance from embeddings order by distance, vec_id limit {{0}})"


@query(f"with {_NEAR.format(10)} select command_id, round(distance, 5) + 0.0 as distance from near")
def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(vector.knn(views.vectors(spark, sf), views.query_vector(spark, sf), 10), 5, "distance")


@query("""with q as (select vec_id as query_id, embedding as e from embeddings where vec_id % 100 = 0)
select query_id, vec_id as command_id, row_number() over (partition by query_id order by 1 - list_inner_product(embedding::double[], e::double[]), vec_id)::int as rank, round(1 - list_inner_product(embedding::double[], e::double[]), 5) + 0.0 as distance
from embeddings, q qualify row_number() over (partition by query_id order by 1 - list_inner_product(embedding::double[], e::double[]), vec_id) <= 5""")
def knn_many(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.vectors(spark, sf)
    asked = rows.where("command_id % 100 = 0").withColumnRenamed("command_id", "query_id")
    return _rounded(vector.knn_of(rows, asked, 5).select("query_id", "command_id", "rank", "distance"), 5, "distance")


@query(f"with {NAMED}, {_NEAR.format(30)} select id, command, cwd, round(greatest(0, least(1, 1 - distance)), 5) as similarity from near join named on named.id = near.command_id order by distance, command_id limit 20")
def knn_enriched(spark: SparkSession, sf: str) -> DataFrame:
    near = vector.knn(views.vectors(spark, sf), views.query_vector(spark, sf), 30)
    return _rounded(vector.semantic(near, views.named_vectors(spark, sf), 20).select("id", "command", "cwd", "similarity"), 5, "similarity")


@query(f"with {NAMED}, {_NEAR.format(20)} select command, cwd, run_count, match_kind, round(greatest(0, least(1, 1 - distance)), 5) as score, source from (select command, cwd, 1::bigint as run_count, 'partial' as match_kind, 'SEM' as source, distance, command_id from near join named on named.id = near.command_id order by distance, command_id limit 10)")
def semantic_only(spark: SparkSession, sf: str) -> DataFrame:
    near = vector.knn(views.vectors(spark, sf), views.query_vector(spark, sf), 20)
    found = vector.semantic_only(near, views.named_vectors(spark, sf), 10)
    return _rounded(found.select("command", "cwd", "run_count", "match_kind", "score", "source"), 5, "score")


_WIDGET = f"""lex as (select *, row_number() over (order by s desc, completed_at_ms desc, id) as place from (select *, {_SCORE.format(internal='false', near='0.0')} as s from
(select *, 'exact' as match_kind from named where contains(lower(command), 'widget') or contains(lower(cwd), 'widget') order by completed_at_ms desc, id limit 320)) order by s desc, completed_at_ms desc, id limit 40)"""
_FUSED = f"""with {NAMED}, {_NEAR.format(40)}, {_WIDGET},
sem as (select named.*, row_number() over (order by distance, command_id) as place from near join named on named.id = near.command_id),
l as (select command, cwd, {hybrid.LEXICAL_WEIGHT} / (60 + place) as p, run_count, completed_at_ms, match_kind from lex),
r as (select command, cwd, {hybrid.SEMANTIC_WEIGHT} / (60 + place) as p, 1::bigint as run_count, completed_at_ms, 'partial' as match_kind from sem),
f as (select coalesce(l.command, r.command) as command, coalesce(l.cwd, r.cwd) as cwd, coalesce(l.run_count, r.run_count) as run_count, coalesce(l.match_kind, r.match_kind) as match_kind,
  coalesce(l.p, 0) + coalesce(r.p, 0) as rrf, case when l.p is not null and r.p is not null then 'HYB' when r.p is not null then 'SEM' else 'FTS' end as source from l full join r on l.command = r.command and l.cwd = r.cwd),
top as (select * from f order by rrf desc, command, cwd limit 20)"""


def _fused(spark: SparkSession, sf: str, limit: int = 20) -> DataFrame:
    named = views.named_vectors(spark, sf)
    words = lexical.search(named, "widget", 40, tie="id")
    near = vector.knn(views.vectors(spark, sf), views.query_vector(spark, sf), 40)
    similar = vector.semantic(near, named, 40)
    return hybrid.fuse(words, [F.desc("score"), F.desc("completed_at_ms"), F.col("id")], similar, [F.col("distance"), F.col("command_id")], limit)


@query(_FUSED + " select command, cwd, run_count, match_kind, source, round(rrf / max(rrf) over (), 6) as score from top")
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_fused(spark, sf).select("command", "cwd", "run_count", "match_kind", "source", "score"), 6, "score")


@query(_FUSED.replace("cwd limit 20)", "cwd limit 60)") + " select source, count(*) as n from top group by 1")
def rrf_sources(spark: SparkSession, sf: str) -> DataFrame:
    return stats.source_counts(_fused(spark, sf, 60))


_FNV = "list_reduce(list_prepend(14695981039346656037::uhugeint, [x::uhugeint for x in {0}]), lambda h, x: (xor(h, x) * 1099511628211) % 18446744073709551616::uhugeint)"


@query(rf"""with w as (select p_partkey, unnest(string_split(lower(p_name), ' ')) as w from part), b as (select p_partkey, [ascii(c) for c in string_split(w, '')] as b from w),
f as (select p_partkey, unnest(list_concat([struct_pack(f := b, w := 2.0::double)], [struct_pack(f := list_concat([32], b, [32])[i:i + 2], w := 1.0::double) for i in range(1, len(b) + 1)], [struct_pack(f := b[i:i + 1], w := 0.5::double) for i in range(1, len(b))])) as x from b)
select p_partkey, ({_FNV.format('x.f')} % 384)::bigint as idx, sum(x.w) as weight from f group by 1, 2""")
def ngram_features(spark: SparkSession, sf: str) -> DataFrame:
    return embedding.sparse_features(table(spark, sf, "part"), "p_partkey", "p_name")


@query("select distinct v.command_id from vector_meta v where v.command_id is not null and v.command_id not in (select id from commands)")
def vector_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return vector.orphans(table(spark, sf, "vector_meta").select("command_id"), table(spark, sf, "commands")).where("command_id is not null").distinct()


# knowledge --------------------------------------------------------------------------------------------
def _overlap(words: list[str], target: str) -> str:
    q = f"[{views.quoted(words)}]"
    shorter = f"least({len(words)}, len({target}))"
    exact = f"len([w for w in {q} if list_contains({target}, w)])"
    part = f"len([w for w in {q} if strlen(w) >= 3 and len([t for t in {target} if starts_with(t, w) or starts_with(w, t)]) > 0])"
    return f"case when len({target}) = 0 then 0.0 when {exact} > 0 then {exact}::double / {shorter} else {part}::double / {shorter} * 0.7 end"


def _jaccard(q: str, t: str) -> str:
    grams = lambda x: f"[substring({x}, i, 3) for i in range(1, greatest(length({x}) - 1, 1))]"
    both = f"len([g for g in {grams(q)} if list_contains({grams(t)}, g)])"
    return f"case when len({grams(q)}) = 0 or len({grams(t)}) = 0 then 0.0 else {both}::double / (len({grams(q)}) + len({grams(t)}) - {both}) end"


def _score(q: str) -> str:
    words, lit = q.split(), f"'{q}'"
    low = "string_split(lower({}), ' ')"
    alias = f"list_max([greatest({_overlap(words, low.format('a'))}, case when contains({lit}, lower(a)) or contains(lower(a), {lit}) then 0.85 else 0.0 end) for a in aliases])"
    command = f"case when lower(command) = {lit} then 0.95 when contains({lit}, lower(command)) or contains(lower(command), {lit}) then 0.80 else ({_overlap(words, low.format('command'))}) * 0.75 end"
    gram = f"greatest(list_max([{_jaccard(lit, 'lower(a)')} for a in aliases]), {_jaccard(lit, 'lower(command)')}) * 0.75"
    best = f"greatest({alias}, {command}, ({_overlap(words, low.format('description'))}) * 0.70, {gram})"
    named = f"(lower(topic) in ({views.quoted(words)}) or lower(category) in ({views.quoted(words)}))"
    return f"case when list_contains([lower(a) for a in aliases], {lit}) then 1.0 when {named} then least(1.0, {best} + 0.05) else {best} end"


_ASK = ["red widget", "widget red", "wodget", "economy gear"]


@query(f"with {KNOWLEDGE} " + " union all ".join(
    f"(select '{q}' as question, ordinal, command, round(c, 6) as confidence, (case when floor(c * 100 + 0.5) >= 90 then 'High' when floor(c * 100 + 0.5) >= 70 then 'Medium' else 'Low' end) || ' (' || floor(c * 100 + 0.5)::int || '%)' as confidence_text "
    f"from (select *, {_score(q)} as c from kb) where c >= 0.15 order by round(c, 9) desc, ordinal limit 10)" for q in _ASK))
def kb_ask(spark: SparkSession, sf: str) -> DataFrame:
    """Several questions as one job."""
    names = F.array(*map(F.lit, _ASK))
    found = knowledge.ask_many(views.knowledge(spark, sf), list(enumerate(_ASK)), 10).withColumn("question", names[F.col("question_id").cast("int")])
    return _rounded(found.select("question", "ordinal", "command", "confidence", "confidence_text"), 6, "confidence")


@query(f"with {KNOWLEDGE} select ordinal, command, round({_score('wodget')}, 6) as confidence from kb where {_score('wodget')} >= 0.15 order by round({_score('wodget')}, 9) desc, ordinal limit 5")
def kb_ask_one(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(knowledge.ask(views.knowledge(spark, sf), "wodget").select("ordinal", "command", "confidence"), 6, "confidence")


def _explained(q: str) -> str:
    return f"""(select '{q}' as question, ordinal, command from (select *, case when lower(command) = '{q}' then 0 when starts_with(lower(command), '{q}') and (select count(*) from kb where starts_with(lower(command), '{q}')) = 1 then 1
when contains(lower(command), '{q}') or contains('{q}', lower(command)) then 2 end as r from kb) where r is not null order by r, ordinal limit 1)"""


_EXPLAIN = ["red widget brand#17", "red widget", "green", "no such thing"]


@query(f"with {KNOWLEDGE} " + " union all ".join(map(_explained, _EXPLAIN)))
def kb_explain(spark: SparkSession, sf: str) -> DataFrame:
    entries = views.knowledge(spark, sf)
    return knowledge.union_entries([knowledge.explain(entries, q).select(F.lit(q).alias("question"), "ordinal", "command") for q in _EXPLAIN])


@query(f"with {KNOWLEDGE} select category, row_number() over (partition by category order by difficulty, ordinal)::int as place, command, difficulty from kb where topic = 'brand#17'")
def kb_learn(spark: SparkSession, sf: str) -> DataFrame:
    return knowledge.learn_flat(views.knowledge(spark, sf), "Brand#17")


@query(f"with {KNOWLEDGE} select topic, arg_max(category, ordinal) as description, count(*) as entries from kb group by topic")
def kb_topics(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.knowledge(spark, sf)
    named = knowledge.topics(rows.select("topic", F.col("category").alias("description"), F.lit(False).alias("simple"), F.col("ordinal").alias("load_order")))
    return named.join(knowledge.pack_sizes(rows, "topic"), "topic").select("topic", "description", "entries")


@query(f"with {KNOWLEDGE} select ordinal, round({_jaccard(chr(39) + 'red wodget' + chr(39), 'lower(command)')}, 6) as similarity from kb")
def trigram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.knowledge(spark, sf).select("ordinal", text.trigram_jaccard(text.trigrams(F.lit("red wodget")), text.trigrams(F.lower("command"))).alias("similarity"))
    return _rounded(rows, 6, "similarity")


@query(f"""with {HISTORY}, top as (select *, row_number() over (order by completed_at_ms desc, content_hash) as position from hist order by completed_at_ms desc, content_hash limit 50)
select content_hash, position::int as position, exit_code is not null and exit_code <> 0 as pinned from top""")
def pinned_first(spark: SparkSession, sf: str) -> DataFrame:
    """The newest commands, those that failed taken as favourites."""
    from pyspark.sql import Window

    rows = stats.recent(views.history(spark, sf), 50)
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("completed_at_ms"), "content_hash")))
    pins = rows.where("exit_code <> 0").select("command", "cwd")
    return stats.pinned_first(rows, pins, "position").select("content_hash", "position", "pinned")


@query(f"with {HISTORY} select content_hash from hist where (contains(lower(command), 'docker') or contains(lower(cwd), 'docker')) and (contains(lower(command), 'logs') or contains(lower(cwd), 'logs'))")
def postings_search(spark: SparkSession, sf: str) -> DataFrame:
    """By way of the trigram index, built over all of history."""
    index = TrigramIndex(spark, fresh_path(spark, "postings"))
    rows = views.history(spark, sf)
    index.add(rows)
    return index.search(rows, "docker logs").select("content_hash")
