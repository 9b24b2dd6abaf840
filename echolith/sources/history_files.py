"""Shell history files: one command for each row, with its place in the file."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolith.functions.text import trim_unicode

#: Stands for a continued line while lines are split; no shell writes it.
_MARK = "\u0001"


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, body) of whole files, line ends made alike; bytes that are no UTF-8 become replacement characters."""
    rows = spark.read.format("binaryFile").load(path)
    body = F.decode("content", "UTF-8")
    return rows.select(F.col("path").alias("file"), F.regexp_replace(body, r"\r\n", "\n").alias("body"))


def _lines(files: DataFrame, body: Column) -> DataFrame:
    return files.select("file", F.posexplode(F.split(body, "\n", -1)).alias("line", "raw"))


def strip_zsh_prefix(line: Column) -> Column:
    """Without the ``: time:duration;`` of the extended format."""
    return F.regexp_replace(line, r"(?s)^: [^;]*;", "")


def bash_history(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, command): trimmed lines that are neither empty nor begin with ``#``."""
    rows = _lines(_files(spark, path), F.col("body")).select("file", "line", trim_unicode("raw").alias("command"))
    return rows.where((F.col("command") != "") & ~F.startswith("command", F.lit("#")))


def zsh_history(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, command): a backslash at the end of a line continues it; the prefix is stripped once."""
    files = _files(spark, path)
    joined = F.regexp_replace("body", r"\\(?:\n|\z)", _MARK)
    text = F.replace(F.col("raw"), F.lit(_MARK), F.lit("\n"))
    rows = _lines(files, joined).select("file", "line", trim_unicode(strip_zsh_prefix(text)).alias("command"))
    return rows.where(F.col("command") != "")


def fish_history(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, command): ``- cmd:`` lines, of which the first line after unescaping counts."""
    rows = _lines(_files(spark, path), F.col("body")).select("file", "line", trim_unicode("raw").alias("t")).where(F.startswith("t", F.lit("- cmd: ")))
    first = F.get(F.split(F.replace(trim_unicode(F.substring("t", 8, 2_000_000_000)), F.lit("\\n"), F.lit("\n")), r"\r?\n"), F.lit(0))
    return rows.select("file", "line", trim_unicode(first).alias("command")).where(F.col("command") != "")


PARSERS = {"bash": bash_history, "zsh": zsh_history, "fish": fish_history}


def detect_shell(home: str | None = None, environ: dict[str, str] | None = None) -> tuple[str, str]:
    """(shell, history file): by $SHELL, else by which file there is, zsh, fish, bash in turn."""
    environ = os.environ if environ is None else environ
    base = Path(home or Path.home())
    files = {"zsh": base / ".zsh_history", "fish": base / ".local/share/fish/fish_history", "bash": base / ".bash_history"}
    named = Path(environ.get("SHELL", "")).name
    if named in files:
        return named, str(files[named])
    for shell, file in files.items():
        if file.exists():
            return shell, str(file)
    raise FileNotFoundError("no shell history found")
