"""Encoding of texts by a public byte-level BPE vocabulary, as a streaming transducer."""

from __future__ import annotations

import base64
import codecs
import importlib.util
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files are; a parameter of every function here.
VOCABULARIES = "/opt/tokenizers"
#: Fixed value: the published pattern that splits text before the merges of this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a text that are split into pieces at once.
_BUFFER = 1 << 16
#: Pieces whose ids a worker keeps, and the bytes of one of them at most.
_CACHE, _CACHED_BYTES = 200_000, 64


def _file(folder: str, name: str) -> str:
    if os.path.isdir(folder):
        return os.path.join(folder, name)
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None:
        raise FileNotFoundError(f"no vocabularies at {folder}")
    return os.path.join(os.path.dirname(spec.origin), name)


class Transducer:
    """Bytes in, token ids out, each id as soon as nothing that follows can change it.

    Two neighbouring tokens are *compatible* if merging their joint bytes gives just the two. A
    sequence of tokens is the encoding of its bytes if all neighbours are compatible, so the last token
    of each prefix's encoding is the one token that ends there and is compatible with the last
    token of the prefix it leaves. Hence a chain of back links through the positions.

    The lookahead comes from the merge list: a token still to come can begin at an earlier position only if the bytes from
    there on are the beginning of a longer token that the merges make (``starts``). What the chains from all such
    positions have in common is final and is emitted. That is never more than the longest token less one byte, and
    mostly a few bytes; memory depends on it, not on the length of the piece or text.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: Proper beginnings of the tokens, and the lengths of the tokens that end in a byte.
        self.starts = {b[:n] for b in ranks for n in range(1, len(b))}
        self._ends: dict[int, tuple[int, ...]] = {}
        ends: dict[int, set[int]] = {}
        for b in ranks:
            ends.setdefault(b[-1], set()).add(len(b))
        for byte, sizes in ends.items():
            self._ends[byte] = tuple(sorted(sizes, reverse=True))
        self._own: dict[bytes, bool] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._cache: dict[str, tuple[int, ...]] = {}

    def _merged(self, piece: bytes) -> list[int]:
        """The merges by rank on the bytes of one or two tokens, which say what is compatible."""
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [(ranks[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in ranks]
            if not found:
                break
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _reachable(self, token: bytes) -> bool:
        known = self._own.get(token)
        if known is None:
            known = self._own[token] = self._merged(token) == [self.ranks[token]]
        return known

    def _compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > _CACHE:
                self._pairs.clear()
            known = self._pairs[key] = self._merged(self.token_bytes[left] + self.token_bytes[right]) == [left, right]
        return known

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """The ids of one piece that comes in chunks of any size."""
        state = _Piece(self)
        for chunk in chunks:
            yield from state.feed(chunk)
        yield from state.close()

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of a whole piece; those of short ones are remembered."""
        ids = self._cache.get(text)
        if ids is None:
            raw = text.encode()
            rank = self.ranks.get(raw)
            ids = (rank,) if rank is not None else tuple(self.stream((raw,)))
            if len(raw) <= _CACHED_BYTES:
                if len(self._cache) >= _CACHE:
                    self._cache.clear()
                self._cache[text] = ids
        return ids

    def encode_stream(self, chunks: Iterable[str]) -> Iterator[int]:
        """The ids of a text that comes in chunks of any size.

        Of the text only what may belong to an unfinished piece is kept; a piece that outgrows the buffer goes on
        byte by byte through the transducer, so memory is constant whatever the length of text and pieces.
        """
        for ids in self._parts(chunks):
            yield from ids

    def _parts(self, chunks: Iterable[str]) -> Iterator[Iterable[int]]:
        """The ids as they become certain, some for each chunk."""
        splitter, known, piece = _splitter(), self._cache.get, self.piece
        rest, long = "", None
        for chunk, last in _with_last(chunks):
            rest += chunk
            at = 0
            if long:  # an open piece: the characters of its kind belong to it
                at = long.kind.match(rest).end()
                over = at < len(rest) or last
                if at < len(rest) or not last:
                    at -= long.held  # the last of many blanks before something else is not of their piece
                yield long.state.feed(rest[:at].encode())
                if not over:
                    rest = rest[at:]
                    continue
                yield long.state.close()
                long = None
            ids: list[int] = []
            if last:
                for text in splitter.findall(rest, at):
                    ids.extend(known(text) or piece(text))
                yield ids
                return
            for m in splitter.finditer(rest, at):
                # the end is certain if more text follows, and the beginning if a contraction would have been seen
                if m.end() == len(rest) or m.start() + 3 > len(rest):
                    break
                at = m.end()
                ids.extend(known(m[0]) or piece(m[0]))
            yield ids
            rest = rest[at:]
            if len(rest) > max(_BUFFER, 3):
                long = _Long(self, rest)
                cut = len(rest) - long.held
                yield long.state.feed(rest[:cut].encode())
                rest = rest[cut:]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; special tokens' strings are ordinary text; null and empty give none."""
        out: list[int] = []
        for ids in self._parts(text[i : i + _BUFFER] for i in range(0, len(text), _BUFFER)) if text else ():
            out.extend(ids)
        return out


class _Piece:
    """The state of the transducer within one piece."""

    def __init__(self, machine: Transducer):
        self.machine = machine
        self.recent = b""  # the last bytes, as many as a token may have
        self.base = self.end = 0  # emitted up to base; read up to end
        self.last: dict[int, int] = {}  # position -> last token of the encoding that ends there

    def feed(self, chunk: bytes) -> Iterator[int]:
        m, last = self.machine, self.last
        ranks, longest, sizes = m.ranks, m.longest, m._ends
        recent, end, base = self.recent, self.end, self.base
        due = base + 2 * longest
        for k in range(len(chunk)):
            recent = (recent + chunk[k : k + 1])[-longest:]
            end += 1
            most = min(len(recent), end - base)
            for n in sizes.get(chunk[k], ()):
                if n > most:
                    continue
                token = recent[-n:]
                rank = ranks.get(token)
                if rank is None or not m._reachable(token):
                    continue
                start = end - n
                # before base the tokens are final: the one that ends at base is last[base]
                if start == 0 or (start in last and m._compatible(last[start], rank)):
                    last[end] = rank
                    break
            if end >= due:
                self.recent, self.end = recent, end
                yield from self._settle()
                base = self.base
                due = max(base + 2 * longest, end + longest)
        self.recent, self.end = recent, end

    def close(self) -> Iterator[int]:
        if self.end > self.base:
            yield from self._chain(self.end)
            self.base = self.end

    def _chain(self, at: int) -> list[int]:
        out = []
        while at > self.base:
            out.append(self.last[at])
            at -= len(self.machine.token_bytes[self.last[at]])
        return out[::-1]

    def live(self) -> set[int]:
        """Positions from which a token may still come: the bytes since are the beginning of one."""
        starts, recent, end = self.machine.starts, self.recent, self.end
        heads = {end}
        for n in range(1, min(len(recent), end - self.base) + 1):
            if (end - n in self.last or end == n) and recent[-n:] in starts:
                heads.add(end - n)
        return heads

    def _settle(self) -> Iterator[int]:
        """Emit what all live chains share."""
        heads, last, token_bytes = self.live(), self.last, self.machine.token_bytes
        while len(heads) > 1:
            far = max(heads)
            heads.remove(far)
            heads.add(max(self.base, far - len(token_bytes[last[far]])))
        settled = heads.pop()
        yield from self._chain(settled)
        for p in [p for p in last if p < settled]:
            del last[p]
        self.base = settled


class _Long:
    """A piece longer than the buffer: its kind of characters, its transducer, and how many characters are held back."""

    def __init__(self, machine: Transducer, beginning: str):
        self.state = _Piece(machine)
        body = beginning[1] if regex.match(r" \S", beginning) else beginning[0]
        kinds = (r"\s*", r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*")
        which = next(i for i, k in enumerate(kinds) if regex.fullmatch(k[:-1], body))
        self.held = 1 if which == 0 else 0
        self.kind = regex.compile(kinds[which])


def _with_last(chunks: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """Each chunk, and whether it is the last."""
    before = None
    for chunk in chunks:
        if before is not None:
            yield before, False
        before = chunk
    if before is not None:
        yield before, True


@lru_cache(1)
def _splitter():
    return regex.compile(PATTERN)


@lru_cache(4)
def _loaded(path: str) -> Transducer:
    with open(path, "rb") as lines:
        return Transducer({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})


def transducer(folder: str, vocabulary: str) -> Transducer:
    """The transducer of a rank file, once for each process."""
    return _loaded(_file(folder, f"{vocabulary}.tiktoken"))


def _shipped(spark: SparkSession, folder: str, vocabulary: str):
    """Send the rank file to the executors; what a task calls for its transducer, once for each worker process."""
    path = _file(folder, f"{vocabulary}.tiktoken")
    name, sent = os.path.basename(path), spark.sparkContext.__dict__.setdefault("_echolith_files", {})
    if sent.setdefault(name, path) != path:
        raise ValueError(f"another file of the name {name} was sent in this session")
    spark.sparkContext.addFile(path)
    return lambda: _loaded(SparkFiles.get(name))


def decode_stream(ids: Iterable[int], token_bytes: dict[int, bytes]) -> Iterator[str]:
    """Text, bit by bit: the state machine keeps at most the three bytes of an unfinished character."""
    state = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        if text := state.decode(token_bytes[i]):
            yield text
    if text := state.decode(b"", True):
        yield text


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, ids): the token ids of each whole text, without special tokens.

    One map over the rows, no shuffle; the vocabulary's file is read on the driver and sent to the executors. Defined cases:
    null and empty texts have an empty list; very long texts and pieces without a break go through the transducer in
    chunks; repeated rows are encoded each; an empty table gives no rows; other columns are not read.
    """
    kind, machine = dict(df.dtypes)[key], _shipped(df.sparkSession, folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = machine().encode
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pa.array([encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))


def decode_column(df: DataFrame, key: str, ids: str, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """(key, text): the texts of the ids; a null list gives an empty text."""
    kind, machine = dict(df.dtypes)[key], _shipped(df.sparkSession, folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = machine().token_bytes
        for batch in batches:
            texts = pa.array(["".join(decode_stream(row or (), known)) for row in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
