"""Passages of held-out test items inside a corpus."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
#: Characters of test items that one automaton takes; more items are scanned for in further passes.
_BLOCK_CHARS = 16_000_000
_FOUND = pa.schema([("field", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64())])


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    if not text:
        return []
    if "İ" in text:  # the one letter whose lower case is longer and holds a mark
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(text.lower())


class LeakScanner:
    """One Aho-Corasick automaton over words: all windows of ``n`` words of the passages, and the answers.

    Words are numbers, so a state is a word and not a character; a word that no item has is 0 and
    ends every match.
    """

    def __init__(self, items: list[tuple], n: int):
        import ahocorasick

        self.n, self.number = n, {}
        patterns: dict[tuple, list[tuple[int, str, int]]] = {}
        for at, (_, passage, answer) in enumerate(items):
            numbers = [self.number.setdefault(w, len(self.number) + 1) for w in words(passage)]
            for i in range(len(numbers) - n + 1):
                patterns.setdefault(tuple(numbers[i : i + n]), []).append((at, "passage", i))
            numbers = [self.number.setdefault(w, len(self.number) + 1) for w in words(answer)]
            if numbers:
                patterns.setdefault(tuple(numbers), []).append((at, "answer", 0))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, owners in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), owners))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def scan(self, text: str | None) -> list[tuple[int, str, int, int]]:
        """(item, field, first word, last word): the longest runs of each passage; answers of the items whose passage is there."""
        if self.empty or not text:
            return []
        get = self.number.get
        runs: dict[tuple[int, int], list[int]] = {}
        answers: dict[int, list[tuple[int, int]]] = {}
        for end, (length, owners) in self.automaton.iter(tuple([get(w, 0) for w in words(text)])):
            for at, field, i in owners:
                start = end - length + 1
                if field == "answer":
                    answers.setdefault(at, []).append((start, end))
                    continue
                shift = (at, start - i)  # windows of one run lie on one diagonal
                ranges = runs.setdefault(shift, [])
                if ranges and start <= ranges[-1] + 1:
                    ranges[-1] = end
                else:
                    ranges += [start, end]
        out = [(at, "passage", r[k], r[k + 1]) for (at, _), r in runs.items() for k in range(0, len(r), 2)]
        out += [(at, "answer", s, e) for at in dict.fromkeys(a for a, *_ in out) for s, e in answers.get(at, ())]
        return out


#: The last automaton of this worker process, by the identifier of its items.
_BUILT: dict[str, LeakScanner] = {}


def _scanner(name: str, items: list[tuple], n: int) -> LeakScanner:
    """Built once for each worker process and block of items, not for each task."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = LeakScanner(items, n)
    return _BUILT[name]


def _blocks(items: Iterator[tuple]) -> Iterator[list[tuple]]:
    block, chars = [], 0
    for item in items:
        block.append(tuple(item))
        chars += len(item[1] or "") + len(item[2] or "")
        if chars >= _BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def leaked_spans(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, answer: str | None = None, n_words: int = 12) -> DataFrame:
    """(doc_id, item_id, field, start, end, n_words): where documents hold ``n_words`` or more successive words of a passage.

    Runs are as long as they go; ``start`` and ``end`` are offsets of characters in the text as it is.
    Answers are reported for the items whose passage the document has. The corpus is scanned
    once, in a map without shuffle. Test items come to the driver one after the other; a block of about 16 million characters
    of them is one automaton, and each further block, of which a test suite has none, another pass.

    Defined cases: null, empty and wordless texts hold nothing; passages shorter than ``n_words`` and
    null passages are never found; items alike are all reported; a repeated document row is reported
    again; empty tables give no rows.
    """
    doc_kind, item_kind = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    rows = items.where(F.col(passage).isNotNull()).select(item_id, passage, F.col(answer) if answer else F.lit(None).cast("string")).orderBy(item_id).toLocalIterator()
    schema = f"`{doc_id}` {doc_kind}, `{item_id}` {item_kind}, field string, start bigint, end bigint, n_words bigint"
    spark = docs.sparkSession
    item_type, out = items.schema[item_id].dataType, None
    for block in _blocks(rows):
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            scanner = _scanner(name, shared.value, n_words)
            for batch in batches:
                at, found = [], []
                for i, body in enumerate(batch.column(1).to_pylist()):
                    hits = scanner.scan(body)
                    if not hits:
                        continue
                    spans = [m.span() for m in _WORD.finditer(body)]
                    for item, field, first, last in hits:
                        at.append(i)
                        found.append((shared.value[item][0], field, spans[first][0], spans[last][1], last - first + 1))
                cols = list(zip(*found)) if found else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], to_arrow_type(item_type)), *[pa.array(c, t.type) for c, t in zip(cols[1:], _FOUND)]],
                    names=[doc_id, item_id, *_FOUND.names],
                )

        part = docs.where(F.col(text).isNotNull()).select(doc_id, text).mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, n_words: int = 12, answer: str | None = None) -> DataFrame:
    """(doc_id, item_id): each document with the items it contains, once; see ``leaked_spans``."""
    return leaked_spans(docs, doc_id, text, items, item_id, passage, answer, n_words).where("field = 'passage'").select(doc_id, item_id).distinct()
