import numpy as np
from pyspark.sql import functions as F
from wardenlog.llm import language_ppm as L

from .edge import no_documents, odd_documents

TEXTS = {"aa": "the cat and the dog sat on the mat then ran", "bb": "el gato y el perro en la casa roja de ayer"}


def training(spark):
    return spark.createDataFrame([(i, t, lang, i) for i, (lang, t) in enumerate(TEXTS.items())], "doc_id int, text string, lang string, score int")


def slow_length(texts, data, at, order):
    """Code length of one byte by the definition, from counts taken here."""
    ruled_out, bits = set(), 0.0
    for k in range(order, -1, -1):
        context = data[at - k:at]
        counts = {}
        for t in texts:
            for i in range(L.ORDER, len(t)):
                if t[i - k:i] == context and t[i] not in ruled_out:
                    counts[t[i]] = counts.get(t[i], 0) + 1
        total, kinds = sum(counts.values()), len(counts)
        if data[at] in counts:
            return bits - np.log2(counts[data[at]] / (total + kinds))
        if total:
            bits -= np.log2(kinds / (total + kinds))
        ruled_out |= counts.keys()
    return bits + np.log2(256 - len(ruled_out))


def test_exact_code_lengths(spark, monkeypatch):
    monkeypatch.setattr(L, "MIN_CONTEXT", 1)
    model = L.fit(training(spark), F.lit(True))
    for text in ("the dog ran on", "la casa q", "zz é"):
        data = L.prepared(text)
        got = model.lengths([data])[0]
        for k, lang in enumerate(model.langs):
            seen = [bytes(L.prepared(TEXTS[lang]))]
            want = 0.0
            for at in range(L.ORDER, len(data)):
                # The longest context that any language has.
                known = [o for o in range(L.ORDER, -1, -1) if o == 0 or any(
                    bytes(data[at - o:at]) in t[L.ORDER - o:len(t) - 1] for t in (bytes(L.prepared(x)) for x in TEXTS.values()))]
                want += slow_length(seen, bytes(data), at, known[0])
            assert abs(got[k] - want) < 0.01


def test_prediction_and_odd_rows(spark):
    model = L.fit(training(spark), F.lit(True))
    got = {r.doc_id: r.lang_pred for r in L.identify(training(spark), model).collect()}
    assert got == {0: "aa", 1: "bb"}
    odd = [(r.doc_id, r.lang_pred, r.score) for r in L.identify(odd_documents(spark), model).collect()]
    assert len(odd) == 9 and all(x == (x[0], "und", 0.0) for x in odd if x[0] in (1, 2, 5))
    assert all(0 <= x[2] <= 1 for x in odd)
    assert L.identify(no_documents(spark), model).count() == 0
    untrained = L.fit(no_documents(spark), F.lit(True))
    assert {r.lang_pred for r in L.identify(odd_documents(spark), untrained).collect()} == {"und"}


def test_held_out_accuracy(spark):
    from wardenlog.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = QUERIES["op1_language_ppm"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.filter("lang = lang_pred").count() >= 0.97 * got.count()


def test_copies_and_long_texts_are_drawn_in_part(spark):
    # One language is a group of copies, one a single long text, one is short beside them.
    rows = [(i, TEXTS["aa"] * 20, "aa") for i in range(300)] + [(1000, TEXTS["bb"] * 20_000, "bb"), (1001, "zyx wvu", "cc")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    model = L.fit(docs, F.lit(True), sample_bytes=30_000)
    assert model.langs == ["aa", "bb", "cc"]
    got = {r.doc_id: r.lang_pred for r in L.identify(docs, model).collect()}
    assert got[0] == "aa" and got[1000] == "bb" and got[1001] == "cc"
    # A bound too small for any piece still leaves one of each language.
    assert L.fit(docs, F.lit(True), sample_bytes=1).langs == ["aa", "bb", "cc"]
