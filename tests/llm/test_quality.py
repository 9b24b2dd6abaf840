import pytest

from echolith.llm.quality import not_prose, quality_stats

PROSE = "The service keeps every command in a small table and removes it after some days. If the search finds nothing, it is enough to build the index again.\n\nYou can pass `--all` to see the rest, but that takes a while."
TEXTS = {
    None: None, "": None, " \r\n\t": None, PROSE: None, "Kurz gesagt: das ist nicht der Fehler.": None, "まず設定を確認します。それから再起動してください。": None, PROSE.replace(" ", "\n"): None, PROSE.replace(" ", "  "): None,
    "> " + PROSE.replace(". ", ".\n> "): None,
    "- one thing\n- another\n* third\n1. fourth\n[x] done": "list",
    "a) open the valve;\nb) close it;": "list",
    "name\tsize\tage\nfoo\t12\t3\nbar\t4\t5": "table", "| a | b |\n| --- | --- |\n| 1 | 2 |": "table", "flag,default,since\n".replace("flag", "flag,kind") + "--a,x,1,2\n--b,,3,4": "table",
    "2024-01-02T03:04:05Z INFO x started\n2024-01-02T03:04:06Z WARN y": "log", "$ make test\nok\n$ git push origin main\ndone": "log", ": 1700000000:0;ls -la\n: 1700000001:0;pwd": "log",
    "src/a/b.py\nsrc/c/d.go\nlib/e.rs": "entries", "@#$%^&*()_+{}|:<>?~!@#$": "symbols", "🔥🔥🐛🐛✅": "symbols",
    "Home | Docs | Login\n" * 6: "repeated lines", "the of and to in is it was that for on as with by at this be " * 4: "common words only", "foo bar " * 40: "repeated words",
    "zxcv bnmq wrtp sdfg hjkl qwrt zxcp vbnm ghjk lpqr tyws " * 2 + "mnbv cxzl kjhg fdsp rtwq": "no vowels",
}


@pytest.mark.parametrize(("text", "why"), TEXTS.items(), ids=range(len(TEXTS)))
def test_reason(spark, rows, text, why):
    df = spark.createDataFrame([(1, text, "x")], "id bigint, text string, n_words string")
    assert rows(not_prose(df, "id", "text")) == ([(1, why)] if why else [])


def test_statistics(spark):
    df = spark.createDataFrame([(1, "The cat.\n- sat, Ünd 42!\n\n")], "id int, text string")
    r = quality_stats(df, "id", "text").first()
    assert (r["n_chars"], r["n_solid"], r["n_words"], r["n_lines"]) == (25, 18, 5, 2)
    assert r["mean_word"] == pytest.approx(14 / 5) and r["symbol_share"] == pytest.approx(4 / 18) and r["ended_lines"] == 1.0 and r["bullet_share"] == pytest.approx(11 / 18)


def test_long_repeated_and_none(spark):
    df = spark.createDataFrame([(1, PROSE * 2_000), (1, PROSE * 2_000)], "id int, text string")
    assert quality_stats(df, "id", "text").count() == 2 and not_prose(df.limit(0), "id", "text").count() == 0
    assert quality_stats(df.limit(0), "id", "text").count() == 0


def test_other_scripts_have_word_rules_where_they_have_blanks(spark):
    texts = {
        1: "Это обычный текст о том, как работает система и что с ней можно сделать, если она не отвечает на запросы пользователя.",
        2: "бгдкл прстф хцчшщ вгджз клмнп рстфх цчшщъ вгдкл мнпрс тфхцч",
        3: "Το κείμενο αυτό είναι για να δούμε αν η γλώσσα είναι αρκετή για τον έλεγχο του συστήματος και της εργασίας.",
        4: "漢字だけの文章には単語の間に空白がないので、単語の統計は使わない。これは普通の文章です。",
        5: "яблоко, груша, слива, вишня, арбуз, дыня, малина, лимон, персик, инжир",
        6: "bcdfg hjklm npqrs tvwxz bcdfg hjkl",
        7: "이 문서는 시스템이 어떻게 작동하는지 설명하는 보통의 글입니다.",
    }
    df = spark.createDataFrame([(k, t, 1.0) for k, t in texts.items()], "id int, t string, reason double")
    got = {r[0]: r[1] for r in not_prose(df, "id", "t").collect()}
    assert got == {2: "no vowels", 5: "enumeration", 6: "no vowels"}


def test_the_statistics_are_worked_out_once(spark):
    """The filter stays above them, in the JVM."""
    df = spark.createDataFrame([(1, "x")], "id int, t string")
    plan = not_prose(df, "id", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("IsCyrillic") == 1
