"""SQL equivalents of the corpus queries, where SQL can express them on whole tables."""

from __future__ import annotations

_WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _trim(column: str) -> str:
    return rf"regexp_replace({column}, '^{_WS}|{_WS}$', '', 'g')"


_LINES = rf"""
with r as (
  select content_hash, {_trim('cwd')} as place, list_sort(regexp_extract_all(lower(command), '[\p{{L}}\p{{N}}]+')) as w
  from commands where command is not null and cwd is not null
)
"""


_NORMAL = rf"lower(regexp_replace({_trim('command')}, '{_WS}', ' ', 'g'))"
_GRAMS = "case when len(x) >= 3 then list_distinct([substring(x, k, 3) for k in range(1, len(x) - 1)]) else [x] end"
_REPEATS = f"""
with h as (select distinct 0 as batch_no, {_trim('cwd')} as place, {_NORMAL} as x from commands where command is not null and cwd is not null),
n as (select id, batch_no, {_trim('cwd')} as place, {_NORMAL} as x from new_commands where command is not null and cwd is not null),
k as (select batch_no, place, {_GRAMS} as g from (select * from h union select distinct batch_no, place, x from n)),
q as (select id, batch_no, place, {_GRAMS} as g from n)
select distinct q.id from q join k on q.place = k.place and k.batch_no < q.batch_no
where len(list_intersect(q.g, k.g)) * 4 >= 3 * (len(q.g) + len(k.g) - len(list_intersect(q.g, k.g)))
"""


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# What the statistics count, written out here and not taken from the operator.
_SOLID = r"[^\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýœаеёиоуыэюяіїєαεηιουωάέήίόύώϊϋΐΰ"
_BULLET = r"^\s*(?:[-*+•‣◦·–]\s+|\(?\d{1,3}[.)]\s+|\(?[A-Za-z][.)]\s+|[-*]?\s*\[[ xX]\]\s)"
_ENTRY = r"^\s*[\x21-\x7e]*[/\\.=:_][\x21-\x7e]*[^\s.!?:;,]$"
_TABLE = r"^\s*\|.*\||\t[^\t]*\S[^\t]*\t|\S {3,}\S.*\S {2,}\S|\S {2,}\S.*\S {3,}\S|^[^,]*(?:,(?:[^, ][^,]*)?){3,}$|^[\s|+:\-=]{3,}$"
_LOG = r"^\s*(?:[\[(]?\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}|[\[(]?\d{2}:\d{2}:\d{2}\b|[A-Z][a-z]{2} {1,2}\d{1,2} \d{2}:\d{2}|: \d{6,}:\d+;|[$%] \S|#\d+ +0x|at [\w.$<>]+\(|File \"|Traceback|panic\b|\[?(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b)"
_END = r"[.!?:;…。！？：；][\"'”’)\]»」]*\s*$"
_COMMON_WORDS = (
    "the be to of and a in that have i it for not on with he as you do at this but his by from they we her or an will my one all would there their what so up out if about who which when can is are was were has had been no than into its our "
    "der die das und ist nicht ein eine zu den von mit dem des auf im für sich als auch es an werden aus er hat dass wir sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr man "
    "le la les de et un une est que pour dans qui il pas sur au du en ne ce des se plus par avec ou sont nous on mais cette si tout était elle aux "
    "el los las y en que del se por con no una su para es lo como más al sus le ha o este sí porque esta entre cuando muy sin sobre hay ya fue "
    "il di che è per non sono con si da come più anche gli della nel alla o um os não uma mais foi het een van ik te dat niet op voor "
    "и в не на что с по как это он она они все из за от для то но же бы так у к о или если только при есть да мы вы я а і та що до є як або не "
    "και το της την του η ο να με για από σε που είναι στο στη τα οι θα δεν ένα μια αν"
)


def _chars(pattern: str) -> str:
    return f"coalesce(list_sum([len(regexp_replace(x, '\\s+', '', 'g')) for x in lines if regexp_matches(x, {_literal(pattern)})]), 0)"


def _count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {_literal(pattern)}))"


def _ratio(part: str, whole: str) -> str:
    return f"case when ({whole}) > 0 then ({part})::double / ({whole}) else 0.0 end"


_COMMON = ", ".join(f"'{w}'" for w in sorted(set(_COMMON_WORDS.split())))
_STATS = rf"""
with b as (
  select doc_id, coalesce(text, '') as t,
    [x for x in regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n') if regexp_matches(x, {_literal(_SOLID)})] as lines,
    regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') as w
  from documents
), c as (
  select *, {_count('t', _SOLID)} as solid, {_count('t', r'\p{Latin}')} as latin, {_count('t', r'\p{L}')} as letters, {_count('t', r'[\p{Latin}\p{Cyrillic}\p{Greek}]')} as listed, {_count('t', r'[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]')} as unspaced, len(w) as nw, len(lines) as nl from b
)
select doc_id, len(t) as n_chars, solid as n_solid, nw as n_words, nl as n_lines,
  {_ratio('list_sum([len(x) for x in w])', 'nw')} as mean_word,
  {_ratio('letters', 'solid')} as letter_share,
  {_ratio('solid - ' + _count('t', r'[\p{L}\p{N}]'), 'solid')} as symbol_share,
  {_ratio('latin', 'letters')} as latin_share,
  {_ratio('listed', 'letters')} as listed_share,
  {_ratio('unspaced', 'letters')} as unspaced_share,
  {_ratio(_count('lower(t)', '[' + _VOWELS + ']'), 'listed')} as vowel_share,
  {_ratio(f'len([x for x in w if x in ({_COMMON})])', 'nw')} as common_share,
  {_ratio('len(list_distinct(w))', 'nw')} as distinct_share,
  {_ratio('nw', _count('t', '[,;]'))} as words_per_comma,
  {_ratio(f'len([x for x in lines if regexp_matches(x, {_literal(_END)})])', 'nl')} as ended_lines,
  {_ratio('nl - len(list_distinct(lines))', 'nl')} as repeated_lines,
  {_ratio(_chars(_BULLET), 'solid')} as bullet_share,
  {_ratio(_chars(_ENTRY), 'solid')} as entry_share,
  {_ratio(_chars(_TABLE), 'solid')} as table_share,
  {_ratio(_chars(_LOG), 'solid')} as log_share
from c
"""
_SHARES = "mean_word letter_share symbol_share latin_share listed_share unspaced_share vowel_share common_share distinct_share words_per_comma ended_lines repeated_lines bullet_share entry_share table_share log_share".split()
_REASONS = f"""
with s as ({_STATS})
select doc_id, case
  when n_solid = 0 then null
  when log_share > 0.5 then 'log'
  when bullet_share > 0.5 then 'list'
  when table_share > 0.5 and n_lines >= 3 then 'table'
  when letter_share < 0.5 then 'symbols'
  when entry_share > 0.5 then 'entries'
  when repeated_lines > 0.5 and n_lines >= 4 then 'repeated lines'
  when n_words >= 20 and distinct_share < 0.15 and common_share > 0.75 then 'common words only'
  when n_words >= 20 and distinct_share < 0.15 and common_share < 0.2 then 'repeated words'
  when unspaced_share < 0.5 and mean_word > 12 then 'long words'
  when listed_share >= 0.5 and n_words >= 6 and vowel_share < 0.2 then 'no vowels'
  when n_words >= 20 and common_share > 0.75 then 'common words only'
  when unspaced_share < 0.5 and n_words >= 8 and words_per_comma > 0 and words_per_comma < 2 then 'enumeration'
  when listed_share >= 0.5 and n_words >= 20 and common_share < 0.04 then 'no common words'
end as reason from s
"""

# 32-bit floats from their bytes: sign, exponent and fraction of each
_NEIGHBOURS = """
with l as (
  select command_id, hex(embedding_bytes) as h from (select *, row_number() over (partition by command_id order by created_at_ms desc nulls last) as r from vector_meta where command_id is not null)
  where r = 1 and octet_length(embedding_bytes) = 1536
), u as (
  select command_id, [('0x' || h[8 * i + 7 : 8 * i + 8] || h[8 * i + 5 : 8 * i + 6] || h[8 * i + 3 : 8 * i + 4] || h[8 * i + 1 : 8 * i + 2])::bigint for i in range(0, 384)] as u from l
), v as (
  select command_id, [(1 - 2 * (x >> 31)) * (case when (x >> 23) & 255 = 0 then (x & 8388607) * pow(2.0, -149) else (1 + (x & 8388607) / 8388608.0) * pow(2.0, ((x >> 23) & 255) - 127) end) for x in u] as v
  from u where len([x for x in u if (x >> 23) & 255 = 255]) = 0 and len([x for x in u if x & 2147483647 <> 0]) > 0
), p as (
  select a.command_id as a, b.command_id as b, list_cosine_similarity(a.v, b.v) as s from v a join v b on a.command_id <> b.command_id
), k as (select *, row_number() over (partition by a order by s desc, b) as r from p)
select distinct least(a, b) as command_id_a, greatest(a, b) as command_id_b from k where r <= 5 and s >= 0.7
"""

_SPANS = r"""
with i as (select item_id, answer, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') as w, regexp_extract_all(lower(coalesce(answer, '')), '[\p{L}\p{N}]+') as aw from eval_items where passage is not null),
iw as (select item_id, k, array_to_string(w[k:k + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i)),
d as (select doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
dw as (select doc_id, k, array_to_string(w[k:k + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d)),
hit as (select distinct doc_id, item_id, dw.k as k, dw.k - iw.k as shift from dw join iw using (g)),
isle as (select *, k - row_number() over (partition by doc_id, item_id, shift order by k) as isle from hit),
run as (select doc_id, item_id, 'passage' as field, min(k) as first, max(k) + 11 as last from isle group by doc_id, item_id, shift, isle),
ans as (
  select d.doc_id, i.item_id, 'answer' as field, k as first, k + len(aw) - 1 as last
  from (select distinct doc_id, item_id from hit) h join (select doc_id, w, unnest(range(1, len(w) + 1)) as k from d) d using (doc_id) join i using (item_id)
  where len(aw) > 0 and d.w[k:k + len(aw) - 1] = aw
),
spans as (select * from run union all select * from ans),
pos as (select doc_id, text, regexp_split_to_array(text, '[\p{L}\p{N}]+') as gaps, regexp_extract_all(text, '[\p{L}\p{N}]+') as raw from d)
select doc_id, item_id, field,
  (list_sum([len(x) for x in gaps[1:first]]) + coalesce(list_sum([len(x) for x in raw[1:first - 1]]), 0))::bigint as "start",
  (list_sum([len(x) for x in gaps[1:last]]) + list_sum([len(x) for x in raw[1:last]]))::bigint as "end",
  last - first + 1 as n_words
from spans join pos using (doc_id)
"""

SQL = {
    "p6_found": _NEIGHBOURS,
    "p9_spans": _SPANS,
    "p1_found": "select normalized_command from commands where normalized_command is not null group by 1 having count(*) >= 0.01 * (select count(*) from commands)",
    "p1_counts": "select normalized_command, count(*) as n_rows from commands where normalized_command is not null group by 1 having count(*) >= 0.01 * (select count(*) from commands)",
    "p4_found": _LINES + """, d as (select distinct * from r where content_hash is not null)
select distinct a.content_hash as content_hash_a, b.content_hash as content_hash_b from d a join d b on a.place = b.place and a.w = b.w and a.content_hash < b.content_hash""",
    "p4_collapsed": _LINES + "select min(content_hash) as content_hash, count(distinct content_hash) as n_variants, count(*) as n_copies from r group by place, w",
    "p7_found": _REPEATS,
    "p9_found": r"""
with i as (select item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') as w from eval_items),
iw as (select item_id, array_to_string(w[k:k + 11], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i)),
d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
dw as (select doc_id, array_to_string(w[k:k + 11], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d))
select distinct doc_id, item_id from dw join iw using (g)""",
    "p10_stats": f"select doc_id, n_chars, n_solid, n_words, n_lines, {', '.join(f'round({c}, 6) as {c}' for c in _SHARES)} from ({_STATS})",
    "p10_reasons": f"select * from ({_REASONS}) where reason is not null",
    "p10_found": f"select doc_id from ({_REASONS}) where reason is not null",
}
