"""Duplicates and near-duplicates of new batches in all that was accepted before, by a prefix-tree hash forest."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.manifest import Manifest, attempt
from echolith.runtime import materialize

_ENDS = r"(?U)^\s+|\s+$"
_TOP = np.uint64(1 << 63)
#: Questions that a task compares with their windows of entries at once.
_CHUNK = 8_192
#: Texts whose shingles a task keeps while it verifies.
_KEPT = 5_000


@dataclass(frozen=True)
class ForestShape:
    """``trees`` sorted permutations, each with labels of ``depth`` hashes of 16 bits.

    Two texts of similarity s share the first k hashes of a tree with probability s**k, so the
    search widens from the whole label to the longest prefix with which the trees together
    find a pair at the ``threshold`` with probability ``recall``. ``nearest``: candidates of a tree and file
    in the first pass; texts with more of them that are still undecided get all in a second.
    ``file_rows``: rows of a file at most, which is also what a task holds; ``asked_rows``: about how many questions
    a task asks of one file. ``most_runs``: beyond these an append merges the small ones.
    """

    trees: int = 10
    depth: int = 4
    threshold: tuple[int, int] = (3, 4)
    recall: float = 0.9995
    nearest: int = 64
    file_rows: int = 1_000_000
    asked_rows: int = 262_144
    most_runs: int = 12
    seed: int = 5

    def shortest(self) -> int:
        s = self.threshold[0] / self.threshold[1]
        for k in range(self.depth, 0, -1):
            if 1 - (1 - s**k) ** self.trees >= self.recall:
                return k
        return 1


def normalized(text: Column) -> Column:
    """Runs of white space as one space, none at the ends, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, _ENDS, ""), r"(?U)\s+", " "))


def shingles(text: str) -> frozenset[str]:
    """All substrings of three characters, or the whole text if it is shorter."""
    return frozenset(text[i : i + 3] for i in range(len(text) - 2)) if len(text) >= 3 else frozenset((text,))


def alike(x: frozenset[str], y: frozenset[str], threshold: tuple[int, int]) -> bool:
    """Whether |x & y| / |x | y| reaches the threshold."""
    if min(len(x), len(y)) * threshold[1] < max(len(x), len(y)) * threshold[0]:
        return False
    both = len(x & y)
    return both * threshold[1] >= threshold[0] * (len(x) + len(y) - both)


def similar(a: str, b: str, threshold: tuple[int, int]) -> bool:
    return alike(shingles(a), shingles(b), threshold)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E6C63D0876A9A47)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def labels(texts: list[str], shape: ForestShape) -> np.ndarray:
    """(texts, trees) labels of 64 bits: the least values of hash functions over the shingles of each text."""
    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64) for t in texts]
    sizes = np.array([max(1, len(p) - 2) for p in points])
    grams = np.empty(int(sizes.sum()), np.uint64)
    at = 0
    for p, n in zip(points, sizes):
        if len(p) >= 3:
            grams[at : at + n] = p[:-2] | (p[1:-1] << np.uint64(21)) | (p[2:] << np.uint64(42))
        else:
            grams[at] = np.uint64(1 << 63) + (sum(int(c) << (21 * i) for i, c in enumerate(p)) if len(p) else 0)
        at += n
    grams = _mix(grams)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    rng = np.random.default_rng(shape.seed)
    factors = rng.integers(1, 1 << 63, shape.trees * shape.depth, dtype=np.uint64) | np.uint64(1)
    terms = rng.integers(0, 1 << 63, shape.trees * shape.depth, dtype=np.uint64)
    out = np.zeros((len(texts), shape.trees), np.uint64)
    for j in range(shape.trees * shape.depth):
        least = _mix(np.minimum.reduceat(grams * factors[j] + terms[j], starts)) >> np.uint64(48)
        out[:, j // shape.depth] |= least << np.uint64(48 - 16 * (j % shape.depth))
    return out


def _sign(shape: ForestShape):
    """(rec, place_h, text, run) -> one row for each tree."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                label = labels(part.column(2).to_pylist(), shape)
                rows = pa.array(np.repeat(np.arange(part.num_rows), shape.trees))
                # the top bit is turned over, so that signed numbers sort as the labels do
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(shape.trees, dtype=np.int8), part.num_rows)), part.column(1).take(rows), pa.array((label.ravel() ^ _TOP).view(np.int64)), part.column(0).take(rows), part.column(3).take(rows)],
                    names=["tree", "place_h", "label", "rec", "run"],
                )

    return sign


_SIGNED = "tree tinyint, place_h bigint, label bigint, rec bigint, run int"
_TEXTS = "rec bigint, rec2 bigint, place_h bigint, place string, text string, run int"
_FENCES = "kind string, file bigint, path string, tree tinyint, place_h bigint, at bigint, run string"


def _ordered(tree: np.ndarray, place: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Keys of 17 bytes that compare as (tree, place_h, label) do."""
    keys = np.empty(len(place), np.dtype([("t", "u1"), ("p", ">u8"), ("a", ">u8")]))
    keys["t"], keys["p"], keys["a"] = tree.astype(np.int64) + 1, place.view(np.uint64) ^ _TOP, at.view(np.uint64) ^ _TOP
    return keys.view("S17")


@dataclass(frozen=True)
class Fences:
    """The least key of each file of each run, in order: which files hold a range of keys."""

    runs: tuple[tuple[np.ndarray, np.ndarray], ...]  # (keys, file ids)
    paths: dict[int, str]

    def files(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the range, file id) of all files that may hold keys of it."""
        at, files = [], []
        for keys, ids in self.runs:
            # equal keys may begin at the end of the file before
            first = np.maximum(np.searchsorted(keys, low, "left") - 1, 0)
            n = np.searchsorted(keys, high, "right") - first
            n = np.maximum(n, 0)
            rows = np.repeat(np.arange(len(low)), n)
            offset = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            at.append(rows)
            files.append(ids[first[rows] + offset])
        return (np.concatenate(at), np.concatenate(files)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class HistoryForest:
    """What was accepted, as sorted runs of labels, and the texts to verify candidates with.

    ``append`` writes the run of a batch: labels in order of (tree, place, label), texts in order of their identifier, in
    files of bounded size, and of each file its least key. The runs before it are not touched, until
    there are many and the small ones are merged. ``match`` finds, for rows of new batches, those that
    repeat a row of a lower batch number; it reads only the files into whose ranges the batch's prefixes and candidates
    fall. A manifest names the runs: the forest can be opened again, and a writer that dies leaves it as it was.
    """

    def __init__(self, spark: SparkSession, path: str, shape: ForestShape | None = None):
        self.spark, self.path, self.shape = spark, path.rstrip("/"), shape or ForestShape()
        self._state = Manifest(spark, self.path, {"runs": []})

    @property
    def runs(self) -> list[str]:
        return [run["name"] for run in self._state.read()["runs"]]

    @staticmethod
    def records(df: DataFrame, text: str, place: str, run: Column) -> DataFrame:
        """(rec, rec2, place_h, place, text, run) of the distinct pairs of place and text, with their first batch."""
        rows = df.where(F.col(text).isNotNull() & F.col(place).isNotNull())
        rows = rows.select(F.regexp_replace(place, _ENDS, "").alias("place"), normalized(F.col(text)).alias("text"), run.cast("int").alias("run"))
        rows = rows.groupBy("place", "text").agg(F.min("run").alias("run"))
        return rows.select(*_identifiers(), "place", "text", "run")

    # runs -----------------------------------------------------------------------------------------
    def append(self, records: DataFrame, name: str) -> None:
        """Take in the records of a batch, as a run of its own."""
        name = attempt(name)
        self._write_texts(records, name)
        texts = self.spark.read.schema(_TEXTS).parquet(f"{self.path}/texts/{name}")
        signed = texts.select("rec", "place_h", "text", "run").mapInArrow(_sign(self.shape), _SIGNED)
        rows = self._write_labels(signed, name)
        runs = self._state.update(lambda s: {**s, "runs": [*s["runs"], {"name": name, "rows": rows}]})["runs"]
        if len(runs) > self.shape.most_runs:
            # the runs that together are no larger than the largest of the others
            by_size = sorted(runs, key=lambda r: r["rows"])
            self.merge_runs("merged", [r["name"] for r in by_size[:-1]])

    def merge_runs(self, name: str, names: list[str] | None = None) -> None:
        """These runs, or all, as one sorted run. Readers that began before keep the old files, which are not deleted."""
        names = names or self.runs
        name = attempt(name)
        keys = ["rec", "rec2", "place_h", "place", "text"]
        self._write_texts(self._read("texts", _TEXTS, names).groupBy(*keys).agg(F.min("run").alias("run")), name)
        rows = self._write_labels(self._read("labels", _SIGNED, names).groupBy("tree", "place_h", "label", "rec").agg(F.min("run").alias("run")), name)

        def change(s: dict) -> dict:
            if not set(names) <= {r["name"] for r in s["runs"]}:
                raise RuntimeError("another writer merged these runs")
            return {**s, "runs": [{"name": name, "rows": rows}, *[r for r in s["runs"] if r["name"] not in names]]}

        self._state.update(change)

    def _read(self, kind: str, schema: str, names: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{name}" for name in names])

    def _write_texts(self, records: DataFrame, name: str) -> None:
        ordered = records.select(*[c.split()[0] for c in _TEXTS.split(", ")]).repartitionByRange("place_h", "rec").sortWithinPartitions("place_h", "rec")
        ordered.write.option("maxRecordsPerFile", self.shape.file_rows).parquet(f"{self.path}/texts/{name}")

    def _write_labels(self, signed: DataFrame, name: str) -> int:
        order = ["tree", "place_h", "label", "rec"]  # with the record, so that rows of one label can be cut as well
        ordered = signed.select("tree", "place_h", "label", "rec", "run").repartitionByRange(*order).sortWithinPartitions(*order)
        ordered.write.option("maxRecordsPerFile", self.shape.file_rows).parquet(f"{self.path}/labels/{name}")
        # the first row of each file
        fence = [F.xxhash64("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path")]
        start = F.col("_metadata.row_index") == 0
        labels = self._read("labels", _SIGNED, [name]).where(start).select(F.lit("labels").alias("kind"), *fence, "tree", "place_h", F.col("label").alias("at"))
        texts = self._read("texts", _TEXTS, [name]).where(start).select(F.lit("texts").alias("kind"), *fence, F.lit(0).cast("tinyint").alias("tree"), "place_h", F.col("rec").alias("at"))
        labels.unionByName(texts).withColumn("run", F.lit(name)).coalesce(1).write.parquet(f"{self.path}/fences/{name}")
        return self._read("labels", _SIGNED, [name]).count()

    def fences(self) -> dict[str, Fences]:
        """Of labels and of texts: one row for each file, which is what comes to the driver."""
        names, out = self.runs, {}
        rows = self._read("fences", _FENCES, names).collect() if names else []
        for kind in ("labels", "texts"):
            runs, paths = [], {}
            for name in names:
                mine = [r for r in rows if r["kind"] == kind and r["run"] == name]
                if mine:
                    keys = _ordered(*(np.array([r[c] for r in mine], np.int64) for c in ("tree", "place_h", "at")))
                    order = np.argsort(keys, kind="stable")
                    runs.append((keys[order], np.array([r["file"] for r in mine], np.int64)[order]))
                    paths |= {r["file"]: r["path"] for r in mine}
            out[kind] = Fences(tuple(runs), paths)
        return out

    def _of_files(self, schema: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # look-ups -------------------------------------------------------------------------------------
    def texts_of(self, keys: DataFrame, fences: Fences) -> DataFrame:
        """The texts of those files that may hold these (place_h, rec)."""

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place, rec = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
                key = _ordered(np.zeros(len(place), np.int8), place, rec)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(fences.files(key, key)[1]))], names=["file"])

        files = [r[0] for r in keys.select("place_h", "rec").mapInArrow(route, "file bigint").distinct().collect()]
        return self._of_files(_TEXTS, sorted(fences.paths[f] for f in files))

    def _prefix(self) -> Column:
        return F.shiftright("label", 64 - 16 * self.shape.shortest())

    def routed(self, asked: DataFrame, fences: Fences) -> DataFrame:
        """(file, tree, place_h, label, rec, run): the labels of texts, once for each file that may hold their prefix."""
        width = np.uint64(64 - 16 * self.shape.shortest())

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tree, place, label = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
                low = (label.view(np.uint64) >> width) << width
                high = low | ((np.uint64(1) << width) - np.uint64(1))
                at, files = fences.files(_ordered(tree, place, low.view(np.int64)), _ordered(tree, place, high.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(files), *(c.take(pa.array(at)) for c in batch.columns)], names=["file", *batch.schema.names])

        return asked.select("tree", "place_h", "label", "rec", "run").mapInArrow(route, f"file bigint, {_SIGNED}")

    def _search(self, asked: DataFrame, fences: Fences, nearest: int | None) -> DataFrame:
        """(q, q_run, place_h, rec, deep, more): entries whose labels begin like that of a text in a tree, the nearest first;
        ``deep`` is the longest common prefix, in hashes, over all trees; ``more`` if there are other entries.

        Questions go to the files that hold their range; no other file is read. A file is a bounded piece of a run, so a prefix
        with a third of all rows is many pieces. Of a file only the entries travel whose prefix passes a
        table of bits made from the questions, of 16 MB at most; a file that gets many questions answers them in several tasks.
        """
        shape, width = self.shape, 64 - 16 * self.shape.shortest()
        questions = materialize(self.routed(asked, fences), "forest-questions")
        per_file = {r["file"]: r["n"] for r in questions.groupBy("file").agg(F.count("*").alias("n")).collect()}  # as many as files are read
        salts = {f: -(-n // shape.asked_rows) for f, n in per_file.items() if n > shape.asked_rows}
        bits = min(27, max(12, int(np.ceil(np.log2(16 * max(1, sum(per_file.values())))))))
        bit = F.pmod(F.xxhash64("tree", "place_h", self._prefix()), F.lit(1 << bits))
        words = questions.select(bit.alias("b")).groupBy(F.expr("cast(b div 64 as int)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("bits")).toArrow()
        table = np.zeros((1 << bits) // 64, np.int64)
        table[words["word"].to_numpy()] = words["bits"].to_numpy()
        shared = self.spark.sparkContext.broadcast((table.view(np.uint64), salts))

        def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Entries that may be asked for, once for each task that answers for their file."""
            table, salts = shared.value
            for batch in batches:
                b = batch.column(6).to_numpy(zero_copy_only=False).astype(np.uint64)
                keep = np.flatnonzero((table[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1))
                n = np.ones(len(keep), np.int64)
                if salts:
                    files = batch.column(0).to_numpy(zero_copy_only=False)[keep]
                    n = np.array([salts.get(f, 1) for f in files.tolist()], np.int64)
                rows = np.repeat(keep, n)
                salt = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows)) for i in range(6)), pa.array(salt.astype(np.int32))], names=[*batch.schema.names[:6], "salt"])

        entries = self._of_files(_SIGNED, sorted(fences.paths[f] for f in per_file))
        entries = entries.select(F.xxhash64("_metadata.file_name").alias("file"), "tree", "place_h", "label", "rec", "run", bit.alias("b")) if per_file else entries.select(F.lit(0).cast("bigint").alias("file"), "*", bit.alias("b"))
        entries = entries.mapInArrow(wanted, f"file bigint, {_SIGNED}, salt int").withColumn("asks", F.lit(0).cast("tinyint"))
        many = F.coalesce(F.create_map(*[F.lit(x).cast("bigint") for pair in salts.items() for x in pair])[F.col("file")], F.lit(1)) if salts else F.lit(1)
        questions = questions.withColumn("salt", F.pmod(F.xxhash64("rec", "run"), many).cast("int")).withColumn("asks", F.lit(1).cast("tinyint"))

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by file, tree, place and prefix, there entries before questions, both by label."""
            held: list[np.ndarray] | None = None  # the entries of the group that may go on
            for batch in batches:
                if not batch.num_rows:
                    continue
                cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(8)]
                if held is not None:
                    cols = [np.concatenate(c) for c in zip(held, cols)]
                file, tree, place, label, rec, run, salt, asks = cols
                prefix = label >> width
                new = np.zeros(len(file), bool)
                for c in (file, salt, tree, place, prefix):
                    new[1:] |= c[1:] != c[:-1]
                group = np.cumsum(new)
                e, q = np.flatnonzero(asks == 0), np.flatnonzero(asks == 1)
                # labels as ranks, so that a group and a label are one number
                _, rank = np.unique(label, return_inverse=True)
                key = (group << 32) | rank
                first, last = np.searchsorted(group[e], group[q], "left"), np.searchsorted(group[e], group[q], "right")
                near = np.searchsorted(key[e], key[q])
                for begin in range(0, len(q), _CHUNK):
                    part = slice(begin, begin + _CHUNK)
                    mine, low, high = q[part], first[part], last[part]
                    over = np.zeros(len(mine), bool)
                    if nearest is not None:
                        over = high - low > nearest
                        start = np.clip(near[part] - nearest // 2, low, np.maximum(low, high - nearest))
                        low, high = np.where(over, start, low), np.where(over, start + nearest, high)
                    n = high - low
                    a = np.repeat(np.arange(len(mine)), n)
                    b = e[np.repeat(low, n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)]
                    before = run[b] < run[mine[a]]
                    a, b = a[before], b[before]
                    differ = (label[b] ^ label[mine[a]]).view(np.uint64)
                    deep = sum((differ >> np.uint64(shift) == 0).astype(np.int32) for shift in (48, 32, 16, 0))
                    marks = np.flatnonzero(over)  # a row without an entry, so that the text is known to have more
                    who = mine[np.concatenate([a, marks])]
                    found = pa.array(np.concatenate([rec[b], np.zeros(len(marks), np.int64)]), mask=np.concatenate([np.zeros(len(b), bool), np.ones(len(marks), bool)]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rec[who]), pa.array(run[who].astype(np.int32)), pa.array(place[who]), found, pa.array(np.concatenate([deep, np.zeros(len(marks), np.int32)]).astype(np.int32)), pa.array(np.concatenate([over[a], np.ones(len(marks), bool)]))],
                        names=["q", "q_run", "place_h", "rec", "deep", "more"],
                    )
                open_rows = np.flatnonzero((group == group[-1]) & (asks == 0))
                held = [c[open_rows] for c in cols]

        rows = entries.unionByName(questions)
        rows = rows.repartition("file", "salt").sortWithinPartitions("file", "salt", "tree", "place_h", self._prefix(), "asks", "label")
        found = rows.select("file", "tree", "place_h", "label", "rec", "run", "salt", "asks").mapInArrow(ranges, "q bigint, q_run int, place_h bigint, rec bigint, deep int, more boolean")
        return found.groupBy("q", "q_run", "place_h", "rec").agg(F.max("deep").alias("deep"), F.max("more").alias("more"))

    def _verified(self, pairs: DataFrame, asked: DataFrame, known: DataFrame) -> DataFrame:
        """(rec, run) of the asked rows with a candidate of the same place that is similar enough."""
        threshold = self.shape.threshold
        sides = (
            pairs.where("rec is not null").join(asked.select(F.col("rec").alias("q"), F.col("run").alias("q_run"), F.col("place").alias("q_place"), F.col("text").alias("q_text")), ["q", "q_run"])
            .join(known.select("rec", "place", "text"), "rec").where(F.col("place") == F.col("q_place"))
            .select("q", "q_run", "q_text", "text")
        )

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict[str, frozenset[str]] = {}  # a text has many partners in a large group

            def of(text: str) -> frozenset[str]:
                if text not in kept:
                    if len(kept) >= _KEPT:
                        kept.clear()
                    kept[text] = shingles(text)
                return kept[text]

            for batch in batches:
                keep = pa.array([alike(of(a), of(b), threshold) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
                yield batch.select([0, 1]).filter(keep)

        return sides.mapInArrow(compare, "q bigint, q_run int").distinct().select(F.col("q").alias("rec"), F.col("q_run").alias("run"))

    def match(self, df: DataFrame, key: str, text: str, place: str, run: Column) -> DataFrame:
        """(key) of the rows of new batches that repeat, by place and text, a row of a lower batch.

        A text whose 128-bit identifier is known is a repeat at once. For the others each tree is searched by range for the
        labels that begin alike, and candidates are verified on the texts: first those under the longer prefixes, then, for
        texts still without a match, those under the shortest, with which the recall is reached. Texts that have more
        candidates than the first pass looks at, and no match among them, are compared with all of
        theirs in a second pass. What is read of the history are the files that hold the batch's ranges: for a given batch
        their number has a bound, however long the history.

        Defined cases: a null text or place repeats nothing; empty texts are equal; rows of one
        batch are not compared; repeated rows all come out or none; an empty batch or history gives no rows.
        """
        fences = self.fences()
        rows = df.where(F.col(text).isNotNull() & F.col(place).isNotNull()).select(F.col(key).alias("_key"), F.regexp_replace(place, _ENDS, "").alias("place"), normalized(F.col(text)).alias("text"), run.cast("int").alias("run"))
        rows = rows.select("_key", *_identifiers(), "place", "text", "run")
        asked = materialize(rows.drop("_key").distinct(), "forest-asked")
        same = ["place_h", "rec", "rec2"]
        known = self.texts_of(asked, fences["texts"]).select(*same, F.col("run").alias("since"))
        exact = materialize(asked.select(*same, "run").join(known, same).where("since < run").select("rec", "run").distinct(), "forest-exact")
        rest = materialize(asked.join(exact, ["rec", "run"], "left_anti"), "forest-rest")
        signed = materialize(rest.select("rec", "place_h", "text", "run").mapInArrow(_sign(self.shape), _SIGNED), "forest-signed")
        pairs = materialize(self._search(signed, fences["labels"], self.shape.nearest), "forest-pairs")
        texts = self.texts_of(pairs.where("rec is not null"), fences["texts"])
        # longer prefixes first: a text with a match among these is not looked at again when they are widened
        shortest, name = self.shape.shortest(), [F.col("q").alias("rec"), F.col("q_run").alias("run")]
        near = materialize(self._verified(pairs.where(F.col("deep") > shortest), rest, texts), "forest-near")
        left = pairs.where(F.col("deep") <= shortest).join(near.select(F.col("rec").alias("q"), F.col("run").alias("q_run")), ["q", "q_run"], "left_anti")
        near = near.unionByName(materialize(self._verified(left, rest, texts), "forest-wide"))
        hits = exact.unionByName(near)
        undecided = materialize(pairs.where("more").select(*name).distinct().join(near, ["rec", "run"], "left_anti"), "forest-undecided")
        if not undecided.isEmpty():
            all_pairs = materialize(self._search(signed.join(undecided, ["rec", "run"], "left_semi"), fences["labels"], None), "forest-all")
            hits = hits.unionByName(self._verified(all_pairs, rest, self.texts_of(all_pairs, fences["texts"])))
        return rows.join(hits, ["rec", "run"], "left_semi").select(F.col("_key").alias(key))


def _identifiers() -> list[Column]:
    """Of place and text: two independent hashes of 64 bits, and that of the place alone."""
    return [F.xxhash64("place", "text").alias("rec"), F.xxhash64(F.lit("again"), "text", "place").alias("rec2"), F.xxhash64("place").alias("place_h")]
