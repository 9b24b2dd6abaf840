"""Text functions against plain restatements."""

import random

from pyspark.sql import functions as F

from echolith.functions import embedding, filters, formats, text


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def byte_distance(a, b):
    a, b = a.encode(), b.encode()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_normalize_and_hash(spark):
    import hashlib

    got = one(spark, text.normalize_command(F.lit(" a　 b\t\nc ")), text.content_hash(F.lit("a   b"), F.lit("\t/x ")), text.normalize_command(F.lit("")), text.normalize_command(F.lit(None).cast("string")))
    assert got == ("a b c", hashlib.sha256(b"a b\0/x").hexdigest(), "", None)


def test_edit_distance_counts_bytes(spark):
    r = random.Random(1)
    pairs = [("kitten", "sitting"), ("é", "e"), ("", "abc"), ("größe", "grosse")] + [("".join(r.choices("abé漢", k=r.randrange(7))), "".join(r.choices("abé漢", k=r.randrange(7)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.edit_distance("a", "b").alias("d"))
    for a, b, d in df.collect():
        assert d == byte_distance(a, b)


def test_fuzzy_prefix_and_limits(spark):
    assert [text.max_distance(n) for n in (0, 1, 2, 4, 5, 7, 8, 30)] == [0, 0, 1, 1, 2, 2, 3, 3]
    got = one(spark, text.fuzzy_distance("Dokcer", F.lit("run Docker ps"), 2), text.fuzzy_distance("zzzz", F.lit("docker"), 1), text.prefix_of_token("GI", F.lit("sudo Git x")), text.prefix_of_token("git s", F.lit("git status")))
    assert got == (2, None, True, False)


def test_cwd_similarity(spark):
    cases = [("/a/b", "/a/b", 1.0), ("/a/b/c", "/a/b/d", 2 / 3), ("/a", "/b", 0.0), ("", "/a", 0.0), ("/a/b", "/a/b/c/d", 0.5), ("", "", 1.0)]
    df = spark.createDataFrame(cases, "a string, b string, s double").select("s", text.cwd_similarity("a", "b").alias("got"))
    assert all(abs(r.s - r.got) < 1e-12 for r in df.collect())


def test_filters(spark):
    cases = {
        "git status": (True, False), "": (False, False), "  ": (False, False), "x": (False, False), "ls": (True, False), "exit": (False, True), "Clear now": (False, True), "cd /tmp": (False, False), "cdx /tmp": (True, False),
        "export A=1": (False, False), "curl -d PassWord=1": (False, False), "echolith search": (False, True), "echolith-x": (False, True), "my echolith": (True, False), "é": (True, False), ". env": (False, False),
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string").select("c", filters.should_ingest("c"), filters.is_internal("c"))
    assert {r[0]: (r[1], r[2]) for r in df.collect()} == cases
    assert one(spark, filters.should_ingest(F.lit(None).cast("string")), filters.cleaned_away(F.lit("exit 1")), filters.cleaned_away(F.lit(" EXIT ")), filters.cleaned_away(F.lit("Echolith x"))) == (False, False, True, True)


def test_formats(spark):
    got = one(
        spark, formats.format_duration(F.lit(None).cast("bigint")), formats.format_duration(F.lit(999)), formats.format_duration(F.lit(1250)), formats.format_duration(F.lit(90_000)), formats.format_bytes(F.lit(2048)), formats.format_optional_timestamp(F.lit(0)),
        formats.format_timestamp(F.lit(1_700_000_000_999)), formats.csv_escape(F.lit('a,"b"')), formats.format_confidence(F.lit(0.695)), formats.tool_class(F.lit("/usr/bin/git x")), formats.tool_class(F.lit(" ")),
    )
    assert got == ("—", "999ms", "1.2s", "1.5m", "2.0 KB", "never", "2023-11-14 22:13:20", '"a,""b"""', "Medium (70%)", "version control", "other")


def test_highlight_and_clean(spark):
    got = one(spark, text.highlight_spans("AB", F.lit("abxabab")), text.highlight_spans(".", F.lit("a.b.")), text.highlight_spans("zz", F.lit("abc")), text.clean_query(F.lit("a\r\nb\tc")))
    assert got == ([0, 3, 5], [1, 3], [], "a b c")


def test_ngram_embedding_equals_its_sparse_form(spark):
    import numpy as np

    words = [(1, "Git stash é"), (2, ""), (3, "a"), (4, None)]
    df = spark.createDataFrame(words, "id int, t string")
    dense = {r[0]: np.array(r[1]) for r in df.select("id", embedding.embed("t", embedding.NgramProvider(64))).collect()}
    sparse = {i: np.zeros(64) for i, _ in words}
    for i, idx, weight in embedding.sparse_features(df, "id", "t", 64).collect():
        sparse[i][idx] += weight
    for i, _ in words:
        norm = np.linalg.norm(sparse[i])
        assert np.allclose(dense[i], sparse[i] / norm if norm else sparse[i], atol=1e-6)
    assert embedding.fnv1a(b"git") % 384 == 139
    assert embedding.resolve_model("BGE") == "bge-small-en-v1.5" and embedding.resolve_model("other") == "other"
