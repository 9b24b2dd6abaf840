"""The store as its users see it: ingest, search, ask, clean up, import and export."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith import schemas
from echolith.functions import filters
from echolith.functions.embedding import EmbeddingProvider, NgramProvider
from echolith.manifest import Conflict, Manifest, attempt
from echolith.operators import hybrid, importing, ingest, knowledge, lexical, retention, stats, vector
from echolith.operators.redelivery import MessageStore
from echolith.runtime import hadoop_path, ship
from echolith.sources import exports, history_files
from echolith.sources.packs import Knowledge

MODES = ("hybrid", "fts", "semantic")


class HistoryEngine:
    """History, sessions, vectors and logs below one folder.

    Events are folded for each batch; history is the merge of the last snapshot with the folds after it.
    Clean-up and compaction write a new snapshot and commit it with the names of the folds it leaves out,
    so a command that was deleted and comes again starts at one run. Every writer has folders of its own, and one
    manifest says which of them count: a writer that dies leaves the store as it was, and of two at once both come
    through, but two snapshots at once, of which the later fails. ``product`` is the tool's own name, whose calls are no
    history.
    """

    def __init__(self, spark: SparkSession, path: str, provider: EmbeddingProvider | None = None, product: str = filters.PRODUCT, packs: str | None = None):
        self.spark, self.path, self.product = spark, path.rstrip("/"), product
        self.provider = provider or NgramProvider(384)
        self.state = Manifest(spark, self.path, {"schema": schemas.VERSION, "snapshot": None, "folds": [], "vectors": [], "messages": None})
        found = self.state.read()["schema"]
        if found > schemas.VERSION:
            raise RuntimeError("the store was written by a newer version")
        if found < schemas.VERSION:
            self.state.update(migrated)
        self._packs_dir, self._packs = packs, None
        ship(spark)

    # tables -------------------------------------------------------------------------------------------
    def _table(self, name: str, schema: str) -> DataFrame:
        fs, where = hadoop_path(self.spark, f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if fs.exists(where) else self.spark.createDataFrame([], schema)

    def _history(self, s: dict) -> DataFrame:
        parts = [f"folds/{name}" for name in s["folds"]] + ([f"snapshots/{s['snapshot']}"] if s["snapshot"] else [])
        if not parts:
            return self.spark.createDataFrame([], schemas.HISTORY)
        rows = self.spark.read.schema(schemas.HISTORY).parquet(*[f"{self.path}/{p}" for p in parts])
        return rows if len(parts) == 1 else ingest.merge_folds(rows, rows.limit(0))

    def history(self) -> DataFrame:
        return self._history(self.state.read())

    def sessions(self) -> DataFrame:
        return ingest.first_sessions(self._table("sessions", schemas.SESSIONS), "session_id", "created_at_ms")

    def _vectors(self, s: dict) -> DataFrame:
        if not s["vectors"]:
            return self.spark.createDataFrame([], schemas.VECTORS)
        return self.spark.read.schema(schemas.VECTORS).parquet(*[f"{self.path}/vectors/{n}" for n in s["vectors"]])

    def vectors(self) -> DataFrame:
        """The vectors of the engine's model, which are compared with each other only."""
        return self._vectors(self.state.read()).where(F.col("model") == self.provider.name)

    def search_log(self) -> DataFrame:
        return self._table("search_log", schemas.SEARCH_LOG)

    def cleanup_log(self) -> DataFrame:
        return self._table("cleanup_log", schemas.CLEANUP_LOG)

    def packs(self) -> Knowledge:
        if self._packs is None:
            self._packs = Knowledge(self.spark, self._packs_dir)
        return self._packs

    # writing ------------------------------------------------------------------------------------------
    def _write_fold(self, folded: DataFrame) -> str:
        name = attempt("fold")
        folded.select(*[c.split()[0] for c in schemas.HISTORY.split(", ")]).write.parquet(f"{self.path}/folds/{name}")
        return name

    def _fold_in(self, folded: DataFrame) -> int:
        name = self._write_fold(folded)
        return len(self.state.update(lambda s: {**s, "folds": [*s["folds"], name]})["folds"])

    def ingest(self, events: DataFrame, sessions: DataFrame | None = None, once: bool = False) -> int:
        """Take in a batch of events, in the order of ``ingest_seq``; noise is dropped without a word. The number of folds.

        With ``once`` an event is counted a single time however often its ``command_id`` is delivered, in this batch or
        later: the messages seen are kept beside history and change with it in one commit.
        """
        if sessions is not None:
            sessions.select(*[c.split()[0] for c in schemas.SESSIONS.split(", ")]).write.mode("append").parquet(f"{self.path}/sessions")
        if not once:
            return self._fold_in(ingest.fold(ingest.accepted(events, self.product)))
        fields = [c for c in events.columns if c != "ingest_seq"]
        day = F.expr(f"completed_at_ms div {retention.DAY_MS}")
        store = MessageStore(self.spark, f"{self.path}/messages", "command_id", "ingest_seq", day, [])
        whole = MessageStore(self.spark, f"{self.path}/messages", "command_id", "ingest_seq", day, fields)
        while True:
            s = self.state.read()
            seen = s["messages"] or store.empty
            name = self._write_fold(ingest.fold(ingest.accepted(whole.fresh(seen, events), self.product)))
            new = {**s, "version": s["version"] + 1, "folds": [*s["folds"], name], "messages": store.prepare(seen, events)}
            try:
                return len(self.state.commit(new)["folds"])
            except Conflict:  # what is new depends on what the other one took in
                continue

    def import_history(self, shell: str, path: str, now_ms: int, dry_run: bool = False, preview: bool = False) -> DataFrame:
        """Counts of what was, or with ``dry_run`` would be, imported; with ``preview`` the first twenty commands."""
        parsed = history_files.PARSERS[shell](self.spark, path)
        if preview:
            return importing.preview(parsed, product=self.product)
        report = importing.dry_run(parsed, self.history(), self.product)
        if dry_run:
            return report
        result = self.spark.createDataFrame(report.collect(), report.schema)  # one row, before the store changes
        new = importing.run(parsed, self.history(), now_ms, f"import-{now_ms}", self.product)
        at = F.col("completed_at_ms")
        whole = new.withColumns({"created_at_ms": at, "updated_at_ms": at, "first_seen_at_ms": at, "last_seen_at_ms": at, "first_seq": F.lit(0).cast("bigint"), "last_seq": F.lit(0).cast("bigint")})
        self._fold_in(whole)
        return result

    def _add_vectors(self, rows: DataFrame, instead: bool) -> int:
        name = attempt("vectors")
        out = f"{self.path}/vectors/{name}"
        rows.select(*[c.split()[0] for c in schemas.VECTORS.split(", ")]).write.parquet(out)
        self.state.update(lambda s: {**s, "vectors": [name] if instead else [*s["vectors"], name]})
        return self.spark.read.parquet(out).count()

    def reindex(self, now_ms: int, full: bool = False) -> int:
        """Embed the commands that have no vector yet, or all; the number embedded."""
        old = self.vectors().limit(0) if full else self.vectors()
        return self._add_vectors(vector.index_new(self.history(), old, self.provider, now_ms), full)

    def upsert_vectors(self, rows: DataFrame) -> int:
        """Vectors from elsewhere: the latest of each command stays; one of another length is an error. The number kept."""
        others = self._vectors(self.state.read()).where(F.col("model") != self.provider.name)
        mine = ingest.upsert_vectors(self.vectors(), rows.withColumn("model", F.lit(self.provider.name)), self.provider.dimensions)
        self._add_vectors(mine.unionByName(others.select(mine.columns)), True)
        return self.vectors().count()

    def delete_vectors(self, ids: DataFrame) -> int:
        """Without the vectors of these ``command_id`` values; the number left."""
        return self._add_vectors(vector.delete_vectors(self._vectors(self.state.read()), ids), True)

    def delete_sessions(self, ids: DataFrame) -> tuple[int, int]:
        """Sessions go with their commands, and these with their vectors; (removed, remaining) commands."""
        gone = ids.select("session_id").distinct()
        left = self._table("sessions", schemas.SESSIONS).join(gone, "session_id", "left_anti")
        fs, where = hadoop_path(self.spark, f"{self.path}/sessions")
        if fs.exists(where):
            draft = f"{self.path}/{attempt('sessions')}"
            left.write.parquet(draft)
            fs.delete(where, True)
            fs.rename(hadoop_path(self.spark, draft)[1], where)
        return self._reduce(lambda rows: rows.join(gone, "session_id", "left_anti"))

    def _snapshot(self, make) -> dict:
        """``make(history)`` as a new snapshot; folds that others add meanwhile stay beside it."""
        base = self.state.read()
        name = attempt("snapshot")
        make(self._history(base)).write.parquet(f"{self.path}/snapshots/{name}")

        def change(s: dict) -> dict:
            if s["snapshot"] != base["snapshot"]:
                raise Conflict("another snapshot was made meanwhile")
            return {**s, "snapshot": name, "folds": [f for f in s["folds"] if f not in base["folds"]]}

        return self.state.update(change)

    def _reduce(self, make) -> tuple[int, int]:
        """(removed, remaining); vectors of what is removed go too."""
        n = self.history().count()
        self._snapshot(make)
        history = self.history()
        left = history.count()
        if n > left and self.state.read()["vectors"]:
            self._add_vectors(retention.surviving_children(self._vectors(self.state.read()), history, "command_id", "id"), True)
        return n - left, left

    def cleanup(self, mode: str, now_ms: int, days: int = 365, most: int = 1_000_000) -> tuple[int, int]:
        """(removed, remaining); the run is logged."""
        removed, left = self._reduce(lambda rows: retention.cleanup(rows, mode, now_ms=now_ms, days=days, most=most, product=self.product))
        self.spark.createDataFrame([(now_ms, mode, removed, left)], schemas.CLEANUP_LOG).write.mode("append").parquet(f"{self.path}/cleanup_log")
        return removed, left

    def cleanup_if_overdue(self, now_ms: int, interval_ms: int = retention.DAY_MS, days: int = 365, most: int = 1_000_000) -> tuple[int, int] | None:
        return self.cleanup("automatic", now_ms, days, most) if retention.overdue(self.cleanup_log(), now_ms, interval_ms).first()[0] else None

    def optimize(self) -> None:
        """Folds and snapshot as one new snapshot, sorted by time, so that filters on time skip files."""
        self._snapshot(lambda rows: rows.repartitionByRange("completed_at_ms").sortWithinPartitions("completed_at_ms"))

    # reading ------------------------------------------------------------------------------------------
    def search(self, query: str, limit: int = 20, mode: str = "hybrid", cwd: str | None = None, recent_only: bool = False, syntax: str = "literal") -> DataFrame:
        """Results of one of the three modes; an empty query shows the newest commands."""
        if mode not in MODES:
            raise ValueError(f"no such mode: {mode}; there are {', '.join(MODES)}")
        history = self.history()
        if not query.strip():
            return stats.recent_as_results(history, limit).select(*_SHOWN)
        near = vector.knn(self.vectors(), self._embedded(query), 2 * limit)
        if mode == "semantic":
            return vector.semantic_only(near, history, limit).select(*_SHOWN)
        words = lexical.search(history, query, 2 * limit, cwd, recent_only, syntax=syntax, product=self.product)
        order = [F.desc("completed_at_ms" if recent_only else "score"), F.desc("completed_at_ms"), F.col("content_hash")]
        if mode == "fts":
            return words.orderBy(*order).limit(limit).withColumn("source", F.lit("FTS")).select(*_SHOWN)
        return hybrid.fuse(words, order, vector.semantic(near, history, 2 * limit), [F.col("distance"), F.col("command_id")], limit).orderBy(F.desc("score"), "command", "cwd").select(*_SHOWN)

    def search_rows(self, query: str, limit: int = 20, mode: str = "hybrid", **options) -> list:
        """The rows of ``search``, at most ``limit``, and an entry in the search log."""
        began = time.time()
        rows = self.search(query, limit, mode, **options).collect()
        took = int((time.time() - began) * 1000)
        self.spark.createDataFrame([(int(began * 1000), mode, took)], schemas.SEARCH_LOG).write.mode("append").parquet(f"{self.path}/search_log")
        return rows

    def semantic(self, query: str, limit: int = 10) -> DataFrame:
        """The most similar commands, with their similarity."""
        near = vector.knn(self.vectors(), self._embedded(query), limit + 10)
        return vector.semantic(near, self.history(), limit).select("command", "cwd", "exit_code", "completed_at_ms", "similarity")

    def _embedded(self, query: str) -> list[float]:
        import pandas as pd

        return [float(x) for x in self.provider.embed(pd.Series([query])).iloc[0]]

    def recent(self, n: int = 20) -> DataFrame:
        return exports.summary(self.history(), n)

    def export(self, path: str, form: str = "json", limit: int = 100_000) -> None:
        {"json": exports.write_json, "csv": exports.write_csv}[form](exports.summary(self.history(), limit), path)

    def usage(self) -> dict:
        """One document of counts, search metrics, the most used commands and the last clean-up."""
        out = stats.usage_stats(self.history(), self.sessions()).first().asDict()
        out |= stats.search_metrics(self.search_log()).first().asDict()
        out["most_used"] = [(r["normalized_command"], r["run_count"]) for r in stats.most_used(self.history()).collect()]
        last = self.cleanup_log().orderBy(F.desc("at_ms")).limit(1).collect()
        return out | {"last_cleanup": last[0].asDict() if last else None}

    def count(self) -> int:
        """Commands in the store."""
        return self.history().count()

    def counts(self) -> DataFrame:
        """One row of table sizes; the queue is what waits, and nothing does after a fold."""
        return stats.db_counts(self.history(), self.sessions(), self.spark.createDataFrame([], "ingest_seq bigint"))

    def storage(self) -> DataFrame:
        """(files, bytes, rows) of the files that history is read from."""
        s = self.state.read()
        parts = [f"folds/{name}" for name in s["folds"]] + ([f"snapshots/{s['snapshot']}"] if s["snapshot"] else [])
        rows = self.spark.read.schema(schemas.HISTORY).parquet(*[f"{self.path}/{p}" for p in parts]) if parts else None
        return stats.storage(rows) if rows is not None else self.spark.createDataFrame([(0, 0, 0)], "files bigint, bytes bigint, rows bigint")

    def source_counts(self, query: str, limit: int = 20, **options) -> DataFrame:
        """(source, n): which searches the results come from."""
        return stats.source_counts(self.search(query, limit, **options))

    def supplement(self, query: str, limit: int = 20, **options) -> DataFrame:
        """Knowledge entries to show below the results of a search where these are few or weak."""
        return knowledge.supplement(self.search(query, limit, **options), self.ask(query))

    def index_status(self) -> DataFrame:
        return ingest.index_progress(self.history(), self.vectors())

    def ask(self, question: str, limit: int = 5) -> DataFrame:
        return knowledge.ask(self.packs().entries, question, limit)

    def explain(self, command: str) -> DataFrame:
        return knowledge.explain(self.packs().entries, command)

    def learn(self, topic: str) -> DataFrame:
        return knowledge.learn(self.packs().entries, topic, knowledge.topics(self.packs().packs))


_SHOWN = ["command", "cwd", "exit_code", "duration_ms", "completed_at_ms", "run_count", "match_kind", "score", "source"]


def migrated(state: dict) -> dict:
    """The state of an older store in today's form: before version 5 batches and snapshots were numbered."""
    if state["schema"] < 5:
        folds = [f"batch={n}" for n in range(state["through"] + 1, state["batches"] + 1)]
        state = {"version": state["version"], "snapshot": str(state["snapshot"]) if state["snapshot"] else None, "folds": folds, "vectors": state["vectors"], "messages": None}
    return {**state, "schema": schemas.VERSION}
