import random

from echolith.llm import leaks as module
from echolith.llm.leaks import leaked_spans, leaks, words

ITEMS = "item_id bigint, passage string, answer string, field string"
DOCS = "doc_id bigint, text string, start string"


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS)


def found(spark, rows, docs, items, n=12):
    d, i = frames(spark, docs, items)
    return rows(leaks(d, "doc_id", "text", i, "item_id", "passage", n))


def brute(docs, items, n):
    grams = lambda t: {tuple(w[k : k + n]) for w in [words(t)] for k in range(len(w) - n + 1)}
    return sorted(((d, i) for d, t in docs for i, p, _ in items if grams(t) & grams(p)), key=repr)


def test_equals_brute_force(spark, rows):
    r = random.Random(3)
    items = [(i, " ".join(r.choices("alpha beta gamma delta Epsilon zeta".split(), k=r.randint(3, 30))), None) for i in range(20)]
    docs = []
    for d in range(120):
        w = r.choices("alpha beta gamma delta epsilon".split(), k=20)
        p = r.choice(items)[1].split()
        a = r.randrange(len(p))
        docs.append((d, ("  ,\n".join(w + p[a : a + r.randint(3, 20)])).upper() if d % 2 else "-".join(w)))
    assert found(spark, rows, docs, items, 6) == brute(docs, items, 6)


PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen"


def test_spans_point_into_the_text(spark):
    text = "İntro: ONE, two\r\nthree four-five six_seven eight nine (ten) Eleven... twelve; the answer is forty two."
    d, i = frames(spark, [(1, text)], [(7, PASSAGE, "Forty two"), (8, PASSAGE, None), (9, "short passage", "one")])
    got = {(r["item_id"], r["field"]): text[r["start"] : r["end"]] for r in leaked_spans(d, "doc_id", "text", i, "item_id", "passage", "answer").collect()}
    assert got == {(7, "passage"): text[7 : text.index(";")], (8, "passage"): text[7 : text.index(";")], (7, "answer"): "forty two"}


def test_eleven_words_are_no_leak(spark, rows):
    eleven = " ".join(PASSAGE.split()[:11])
    docs = [(1, eleven), (2, eleven + " x twelve"), (3, None), (4, ""), (5, "..."), (6, ("y " * 50_000) + PASSAGE), (6, PASSAGE), (7, PASSAGE.replace(" ", "_"))]
    assert found(spark, rows, docs, [(1, PASSAGE, None), (2, None, "a"), (3, "", "")]) == [(6, 1), (7, 1)]


def test_blocks_of_items_give_the_same(spark, rows, monkeypatch):
    items = [(i, f"item{i} " + PASSAGE, None) for i in range(9)]
    docs = [(1, "item3 " + PASSAGE), (2, PASSAGE)]
    whole = found(spark, rows, docs, items)
    monkeypatch.setattr(module, "_BLOCK_CHARS", 150)
    assert found(spark, rows, docs, items) == whole == brute(docs, items, 12)


def test_blocks_that_begin_alike_are_all_scanned(spark, rows, monkeypatch):
    monkeypatch.setattr(module, "_BLOCK_CHARS", 10)
    items = [(5, PASSAGE, None), (5, "other " + PASSAGE, None), (5, PASSAGE, None), (6, PASSAGE.upper(), None)]
    assert found(spark, rows, [(1, PASSAGE)], items) == [(1, 5), (1, 6)]


def test_a_worker_builds_an_automaton_once():
    items = [(1, PASSAGE, None)]
    first = module._scanner("a", items, 12)
    assert module._scanner("a", items, 12) is first and module._scanner("b", items, 12) is not first


def test_empty_tables(spark, rows):
    assert found(spark, rows, [], [(1, PASSAGE, None)]) == [] and found(spark, rows, [(1, PASSAGE)], []) == []
