"""One copy of each message of a queue that delivers at least once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from echolith.manifest import Manifest, attempt
from echolith.runtime import hadoop_path

_TRIM = r"(?U)^\s+|\s+$"
_INDEX = "h bigint, _period string, _bucket int"


def message_key(col: Column | str) -> Column:
    """The identifier without white space at its ends and in lower case; null if nothing is left."""
    col = F.col(col) if isinstance(col, str) else col
    bare = F.lower(F.regexp_replace(col, _TRIM, ""))
    return F.when(bare != "", bare)


class MessageStore:
    """A table of messages in partitions by period, with an index from identifiers to periods.

    ``merge`` takes a batch of deliveries. The index tells which periods hold one of its identifiers;
    only these are read, combined with the batch, reduced to one winner for each identifier, and
    written anew. Messages of other periods are new and appended to theirs, which are not read. A version becomes
    visible by its manifest; readers see the version before or the one after. Each merge writes to folders of its own,
    so one that dies, or loses to another writer (``Conflict``), leaves the store as it was and can be repeated.

    The index is a list of runs in ``buckets`` by ranges of 64-bit hashes, sorted within; a batch reads only the buckets
    that its identifiers fall into. More than ``most_runs`` runs are merged into one, without the
    entries of periods that were written anew since. Two identifiers that share a hash cost an unneeded
    read of a period, never a wrong result.

    The winner is the delivery that comes first by ``order``; it keeps ``payload`` and gets the number
    of its deliveries. Rows without an identifier are messages of their own and all kept. Copies are
    reduced by a partial aggregate before any shuffle, so one identifier with a third of all rows is
    no hot spot.

    Defined cases: an empty batch changes nothing; a null order value comes last; repeated rows
    are deliveries of one message; other columns of the batch are ignored. A store can be opened again by another
    session; its columns are then those it was written with.
    """

    def __init__(self, spark: SparkSession, path: str, identifier: str, order: str, period: Column, payload: list[str], buckets: int = 16, most_runs: int = 8):
        self.spark, self.path, self.identifier, self.order, self.period = spark, path.rstrip("/"), identifier, order, period
        self.payload = [c for c in payload if c != order]
        self.most_runs = most_runs
        self.empty = {"version": 0, "schema": None, "buckets": buckets, "periods": {}, "index": []}
        self._state = Manifest(spark, self.path, self.empty)

    def manifest(self) -> dict:
        """{version, schema, buckets, periods: {period: {parts, since}}, index: [{name, version}]}; the last one committed.

        ``since`` is the first version whose index entries hold for the period.
        """
        return self._state.read()

    # reading ----------------------------------------------------------------------------------
    def _fields(self) -> list[str]:
        return [self.order, *self.payload]

    def _read(self, manifest: dict, periods: list[str] | None = None) -> DataFrame | None:
        by_part: dict[str, list[str]] = {}
        for period, where in manifest["periods"].items():
            if periods is None or period in periods:
                for part in where["parts"]:
                    by_part.setdefault(part, []).append(period)
        schema = StructType.fromJson(manifest["schema"]) if manifest["schema"] else None
        read = self.spark.read.schema(schema) if schema else None
        parts = [read.parquet(f"{self.path}/data/{part}").where(F.col("_period").isin(some)) for part, some in sorted(by_part.items())]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def read(self) -> DataFrame | None:
        """All messages: _key, the order column, the payload, n_deliveries; None before the first merge."""
        rows = self._read(self.manifest())
        return rows if rows is None else rows.drop("_period")

    # merging ----------------------------------------------------------------------------------
    def _winners(self, rows: DataFrame) -> DataFrame:
        """One row for each key: the first by order, and the sum of deliveries."""
        late = F.struct(F.col(self.order).isNull().alias("_late"), *self._fields(), "_period")
        return (
            rows.groupBy("_key").agg(F.min(late).alias("w"), F.sum("n_deliveries").alias("n_deliveries"))
            .select("_key", *[F.col(f"w.{c}").alias(c) for c in self._fields()], F.col("w._period").alias("_period"), "n_deliveries")
        )

    def _bucket(self, manifest: dict) -> Column:
        """Equal ranges of the unsigned hash."""
        return F.floor(F.shiftrightunsigned("h", 48) * F.lit(manifest["buckets"]) / F.lit(1 << 16)).cast("int")

    def _entries(self, manifest: dict) -> DataFrame:
        """The index entries that hold: those of runs since their period was last written anew."""
        runs = []
        for run in manifest["index"]:
            stale = sorted(p for p, where in manifest["periods"].items() if where["since"] > run["version"])
            entries = self.spark.read.schema(_INDEX).parquet(f"{self.path}/index/{run['name']}")
            runs.append(entries.where(~F.col("_period").isin(stale)) if stale else entries)
        return reduce(DataFrame.unionByName, runs)

    def _write_index(self, entries: DataFrame, name: str) -> None:
        entries.repartition("_bucket").sortWithinPartitions("_bucket", "h").write.partitionBy("_bucket").parquet(f"{self.path}/index/{name}")

    def touched(self, manifest: dict, keyed: DataFrame) -> list[str]:
        """The periods that hold one of the identifiers; as many at most as there are periods."""
        if not manifest["index"]:
            return []
        asked = keyed.select(F.xxhash64("_key").alias("h")).distinct()
        asked = asked.withColumn("_bucket", self._bucket(manifest))
        buckets = [r[0] for r in asked.select("_bucket").distinct().collect()]
        entries = self._entries(manifest).where(F.col("_bucket").isin(buckets))
        hits = entries.join(asked.select("h"), "h", "left_semi").select("_period").distinct().collect()
        return [r[0] for r in hits if r[0] in manifest["periods"]]

    def _incoming(self, batch: DataFrame) -> DataFrame:
        clash = {"_key", "_period", "n_deliveries"} & set(self._fields())
        if clash:
            raise ValueError(f"columns of the store itself: {', '.join(sorted(clash))}")
        return batch.select(message_key(self.identifier).alias("_key"), *self._fields(), F.coalesce(self.period.cast("string"), F.lit("none")).alias("_period"), F.lit(1).cast("bigint").alias("n_deliveries"))

    def merge(self, batch: DataFrame) -> dict:
        """Take in a batch; the manifest of the new version."""
        return self._state.commit(self.prepare(self.manifest(), batch))

    def fresh(self, manifest: dict, batch: DataFrame) -> DataFrame:
        """Of each message that the store does not hold, the first delivery in the batch: the order column and the payload."""
        incoming = self._incoming(batch)
        keyed, alone = incoming.where("_key is not null"), incoming.where("_key is null")
        touched = self.touched(manifest, keyed)
        new = self._winners(keyed)
        if touched:
            new = new.join(self._read(manifest, touched).select("_key"), "_key", "left_anti")
        return new.unionByName(alone).select(*self._fields())

    def prepare(self, old: dict, batch: DataFrame) -> dict:
        """Write what a merge into this version gives; the manifest to commit."""
        version, name = old["version"] + 1, attempt(str(old["version"] + 1))
        incoming = self._incoming(batch)
        keyed, alone = incoming.where("_key is not null"), incoming.where("_key is null")
        touched = self.touched(old, keyed)
        if touched:
            history = self._read(old, touched)
            keyed = keyed.unionByName(history.where("_key is not null"))
            alone = alone.unionByName(history.where("_key is null"))
        rows = self._winners(keyed).unionByName(alone)
        out = f"{self.path}/data/{name}"
        rows.hint("rebalance", "_period").write.partitionBy("_period").parquet(out)
        written = self.spark.read.schema(incoming.schema).parquet(out)
        entries = written.where("_key is not null").select(F.xxhash64("_key").alias("h"), "_period")
        self._write_index(entries.withColumn("_bucket", self._bucket(old)), name)
        fs, root = hadoop_path(self.spark, out)
        fresh = {s.getPath().getName().partition("=")[2] for s in fs.listStatus(root) if "=" in s.getPath().getName()}
        fresh = {self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(p) for p in fresh}
        # a touched period that lost all its rows to winners elsewhere has no folder and leaves the manifest
        periods = {p: where for p, where in old["periods"].items() if p not in touched}
        for p in fresh:
            before = periods.get(p)
            periods[p] = {"parts": [*before["parts"], name], "since": before["since"]} if before else {"parts": [name], "since": version}
        new = {"version": version, "schema": incoming.schema.jsonValue(), "buckets": old["buckets"], "periods": periods, "index": [*old["index"], {"name": name, "version": version}]}
        if len(new["index"]) > self.most_runs:
            new = self._compacted(new, attempt(f"{version}-runs"))
        return new

    # upkeep -----------------------------------------------------------------------------------
    def _compacted(self, manifest: dict, name: str) -> dict:
        """The manifest with all index runs as one, which holds for every period."""
        self._write_index(self._entries(manifest).distinct(), name)
        version = manifest["version"]
        # entries of this version's own run are in the merged one too
        periods = {p: {**where, "since": min(where["since"], version)} for p, where in manifest["periods"].items()}
        return {**manifest, "periods": periods, "index": [{"name": name, "version": version}]}

    def compact(self, most_parts: int = 4) -> dict:
        """Periods in more than ``most_parts`` folders are written anew as one each; the index as one run. A new version."""
        old = self.manifest()
        many = [p for p, where in old["periods"].items() if len(where["parts"]) > most_parts]
        if not many and len(old["index"]) < 2:
            return old
        new = {**old, "version": old["version"] + 1}
        if many:
            name = attempt(f"{new['version']}-parts")
            self._read(old, many).hint("rebalance", "_period").write.partitionBy("_period").parquet(f"{self.path}/data/{name}")
            new["periods"] = {p: {**where, "parts": [name]} if p in many else where for p, where in old["periods"].items()}
        if len(old["index"]) > 1:
            new = self._compacted(new, attempt(f"{new['version']}-runs"))
        return self._state.commit(new)
