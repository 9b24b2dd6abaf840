"""Versioned state of a folder: one JSON document for each version, made visible in one step."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession

from echolith.runtime import hadoop_path


class Conflict(RuntimeError):
    """Another writer committed this version first."""


def attempt(tag: str) -> str:
    """A name that no other writer and no other try of this one takes."""
    return f"{tag}-{uuid.uuid4().hex[:12]}"


class Manifest:
    """Readers see the last version that was committed; a writer that dies before its commit leaves no trace.

    The document is written whole under a name of its own, then published under the version's number by a step
    that fails if that name is taken: a hard link on local disks, else a rename that never replaces. Of two
    writers of a version one gets a ``Conflict``. Writers keep their data in folders named by
    ``attempt``, so that the loser's files are never in the winner's place.
    """

    def __init__(self, spark: SparkSession, path: str, empty: dict):
        self.spark, self.path, self.empty = spark, f"{path.rstrip('/')}/_manifests", empty

    def read(self) -> dict:
        fs, root = hadoop_path(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        last = max((int(n) for n in names if n.isdigit()), default=None)
        if last is None:
            return {"version": 0, **self.empty}
        stream = fs.open(hadoop_path(self.spark, f"{self.path}/{last}")[1])
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, state: dict) -> dict:
        fs, draft = hadoop_path(self.spark, f"{self.path}/_{attempt(str(state['version']))}.tmp")
        final = hadoop_path(self.spark, f"{self.path}/{state['version']}")[1]
        stream = fs.create(draft, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        try:
            self._publish(fs, draft, final)
        finally:
            fs.delete(draft, False)
        return state

    def _publish(self, fs, draft, final) -> None:
        taken = f"version {final.getName()} was committed by another writer"
        if fs.getUri().getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                raise Conflict(taken) from None
            return
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                raise Conflict(taken) from None
            raise

    def update(self, change) -> dict:
        """Commit ``change(state)``, a new dict without a version, on whatever is the last state, again after conflicts."""
        while True:
            state = self.read()
            new = {**change(state), "version": state["version"] + 1}
            try:
                return self.commit(new)
            except Conflict:
                continue
