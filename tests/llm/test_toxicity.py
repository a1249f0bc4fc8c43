"""op2: the automaton against edit distance, quotation, edge rows, held-out accuracy."""

import os
import random
import zlib

import pytest

from aerolith.llm import toxicity as tox

SF = "/root/testdata/sf0.01"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(3, 7))) for _ in range(12)]
    terms = [tox.Term(w, False) for w in dict.fromkeys(words)]
    auto = tox.build(terms)
    for _ in range(4000):
        w = "".join(rng.choice("abcde") for _ in range(rng.randint(1, 8)))
        near = [edits(w, t.text) for t in terms if edits(w, t.text) <= (1 if len(t.text) >= 5 else 0)]
        got = tox.scan([w], auto)[0]
        assert [g[1] for g in got] == ([min(near)] if near else []), w
        assert all(edits(w, terms[g[0]].text) == g[1] for g in got)


def test_stems_positions_and_long_texts():
    auto = tox.build([tox.Term("lowe", True), tox.Term("moron", False)])
    text = "x " * 200_000 + "LOWEing, mooron lo lowe"
    got = tox.scan([text, "", "moron"], auto)
    assert [(g[0], g[1], text[g[2] : g[3]]) for g in got[0]] == [(0, 0, "LOWEing"), (1, 1, "mooron"), (0, 0, "lowe")]
    assert got[1] == [] and got[2] == [(1, 0, 0, 5)]


def test_quotation_is_told_from_abuse():
    auto = tox.build([tox.Term("moron", False)])
    for text, quoted in [('she called him "moron" once', True), ("the word moron is old", True), ("you moron", False), ('"fine" moron', False)]:
        assert tox.weigh(text, tox.scan([text], auto)[0])[0][2] is quoted, text


def test_edge_rows(spark):
    rows = [(i, f"plain stuff {i} and {'stupid idiot' if i % 3 == 0 else 'flowers'} here") for i in range(90)]
    docs = spark.createDataFrame([*rows, (500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (500, None)], "doc_id long, toxic int")
    model = tox.fit(docs, labels)
    odd = spark.createDataFrame([(None, "you stupid idiot"), (1, None), (1, None), (2, ""), (3, "flowers")], "doc_id long, text string")
    got = [r["s"] for r in odd.select(tox.scorer(model)("text").alias("s")).collect()]
    assert [g["predicted"] for g in got] == [1, 0, 0, 0, 0] and all(0 <= g["score"] <= 1 for g in got)
    none = tox.fit(docs, labels.limit(0))
    assert odd.select(tox.scorer(none)("text").alias("s")).count() == 5
    assert odd.limit(0).select(tox.scorer(model)("text")).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_held_out_accuracy(spark):
    got = {r[0]: r for r in tox.op2_toxicity(spark, SF).collect()}
    marks = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(got[r["doc_id"]], r["toxic"]) for r in marks if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["toxic"] is not None]
    assert all(r["held_out"] for r, _ in held)
    assert sum(r["predicted"] == y for r, y in held) >= 0.95 * len(held)


def test_digits_symbols_and_edits_of_stems():
    auto = tox.build([tox.Term("idiot", True), tox.Term("stupid", False)])
    text = "idi0t st*pid idiiots id-iotic idiom idio stupid-idiot stu pid"
    got = [(text[a:b], auto_term, d) for auto_term, d, a, b in tox.scan([text], auto)[0]]
    assert got == [("idi0t", 0, 1), ("st*pid", 1, 1), ("idiiots", 0, 1), ("id-iotic", 0, 1), ("stupid", 1, 0), ("idiot", 0, 0)]


def test_misspelled_terms_are_predicted_toxic():
    rng = random.Random(5)
    terms = ["stupid", "idiot", "moron"]
    plain = "garden river window morning letter music paper bottle".split()

    def text(word):
        words = rng.choices(plain, k=20)
        words[rng.randrange(20)] = word
        return " ".join(words)

    # a chance word near a term is a word of its own
    rows = [(text(rng.choice(terms)), 1) if i % 2 else (text("oron" if i % 20 == 0 else "flower"), 0) for i in range(600)]
    model = tox.train([t for t, _ in rows], [y for _, y in rows])

    def predicted(t):
        hits = tox.meant(t, tox.scan([t], model.auto)[0], model.terms, model.innocent)
        return tox.logit(model, t, hits) >= 0

    held = [text(w) for w in ["idiiot", "stupld", "id1ot", "st*pid", "morron", "mor0n", "sstupid", "idiott"] * 5]
    assert all(predicted(t) for t in held)
    assert not any(predicted(text(w)) for w in ["oron", "flower", "garden"] * 5)
    assert all(predicted(text(w)) for w in terms)


def test_misspelled_rows_by_the_scorer(spark):
    rows = [(i, f"plain stuff {i} and {'stupid idiot' if i % 3 == 0 else 'flowers'} here") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    model = tox.fit(docs, labels)
    odd = spark.createDataFrame([(i, f"plain stuff and {w} here") for i, w in enumerate(["stupld", "idiiot", "st*pid", "flowers"])], "doc_id long, text string")
    got = {r[0]: r[1] for r in odd.select("doc_id", tox.scorer(model)("text").predicted).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 0}


def test_chance_words_are_no_terms_and_quotation_is_clean():
    rng = random.Random(6)
    plain = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9))) for _ in range(3000)]
    rows = []
    for i in range(1500):
        words = rng.choices(plain, k=60)
        if i % 5 == 0:
            words[rng.randrange(60)] = rng.choice(["stupid", "idiot", "moron"])
        rows.append((" ".join(words), int(i % 5 == 0)))
    model = tox.train([t for t, _ in rows], [y for _, y in rows])
    assert {t.text for t in model.terms} == {"stupid", "idiot", "moron"}

    def toxic(t):
        hits = tox.meant(t, tox.scan([t], model.auto)[0], model.terms, model.innocent)
        return tox.logit(model, t, hits) >= 0

    assert toxic("you are an idiot and a moron") and toxic("you are an idi0t and a morron")
    assert not toxic('the word "idiot" comes from greek') and not toxic('she said "stupid moron" to him')
    # reporting words near abuse don't make it a quotation, quotations may be long
    assert toxic("I say you are an idiot") and toxic("mark my words, you idiot") and toxic("they said the idiots and morons, every idiot, must go")
    assert not toxic('she wrote: "' + "and the rain went on over the hills " * 6 + 'what an idiot" and left')
    assert not toxic('the word idiot is old')
    assert toxic('it was 5" long\n\nyou idiot, "dear" moron')


def test_quotations_are_matched_within_paragraphs():
    for text, spans in [('a "b c" d "e"', ["b c", "e"]), ('a "b\n\nc" d', []), ("«un» „zwei“", ["un", "zwei"]), ('5" x "7" y', ["7"]), ("", [])]:
        assert [text[a:b] for a, b in tox.quotations(text)] == spans, text


def test_texts_of_the_sample_stay_in_tasks(spark):
    """What fit learns in tasks equals what train learns from the texts at hand, long texts included."""
    rows = [(i, f"plain stuff {i} and {'stupid idiot' if i % 3 == 0 else 'flowers'} here" + " more" * (50_000 if i < 6 else 0)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    a, b = tox.fit(docs, labels), tox.train([t for _, t in rows], [int(i % 3 == 0) for i, _ in rows])
    assert a.terms == b.terms and a.factors == b.factors and a.discount == b.discount and a.innocent == b.innocent
    assert abs(a.weights - b.weights).max() < 1e-6


def test_repeated_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i % 30, f"plain {'idiot' if i % 3 == 0 else 'flower'} {i}", "x") for i in range(900)], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 5) for i in range(30)] * 3, "doc_id long, toxic int, text int")
    model = tox.fit(docs, labels)
    got = docs.select("text", tox.scorer(model)("text").predicted.alias("p")).collect()
    assert all(r["p"] == int("idiot" in r["text"]) for r in got)
