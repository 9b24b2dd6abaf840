import collections
import re

from echolith.llm import rewrites
from echolith.llm.rewrites import collapsed, variant_pairs

SCHEMA = "command string, cwd string, hash string, r1 string, copies int, variant string"


def frame(spark, data):
    return spark.createDataFrame([(*d, "x", 1, "y") for d in data], SCHEMA)


def brute(data):
    groups = collections.defaultdict(set)
    for command, cwd, h in data:
        if None not in (command, cwd, h):
            groups[tuple(sorted(re.findall(r"[^\W_]+", command.lower()))), cwd.strip()].add(h)
    return sorted((a, b) for g in groups.values() for a in g for b in g if a < b)


DATA = [
    ("git  status", "/a", "h1"), ("Git status", " /a ", "h2"), ("status git", "/a", "h3"), ("git status", "/b", "h4"), ("git status status", "/a", "h5"), ("git_status", "/a\t", "h6"), ("größe É", "/a", "h7"), ("é GRÖSSE größe", "/a", "h8"), ("É größe", "/a", "h9"),
    (None, "/a", "h10"), ("x", None, "h11"), ("git status", "/a", None), ("", "/a", "h12"), ("...", "/a", "h13"), ("git  status", "/a", "h1"),
]


def test_pairs_equal_brute_force(spark, rows):
    assert rows(variant_pairs(frame(spark, DATA), "command", "cwd", "hash")) == brute(DATA)


def test_a_group_of_many_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(rewrites, "_BLOCK", 7)
    data = [("make all" if i % 2 else "all make", "/a", f"h{i:03}") for i in range(60)] + DATA
    assert rows(variant_pairs(frame(spark, data), "command", "cwd", "hash")) == brute(data)


def test_collapsed_counts_copies(spark, rows):
    got = rows(collapsed(frame(spark, DATA), "command", "cwd", "hash"), "variant", "n_variants", "n_copies")
    assert ("h1", 4, 6) in got and ("h12", 2, 2) in got and ("h4", 1, 1) in got
    assert sum(n for *_, n in got) == 13


def test_long_and_empty(spark):
    long = "word " * 20_000
    assert variant_pairs(frame(spark, [(long, "/", "a"), (long.upper(), "/", "b")]), "command", "cwd", "hash").count() == 1
    assert variant_pairs(frame(spark, []), "command", "cwd", "hash").count() == 0
    assert collapsed(frame(spark, []), "command", "cwd", "hash").count() == 0
