import random
import time

import pytest
from wardenlog.llm import nbest as N

from .edge import no_documents, odd_documents


@pytest.fixture(scope="module")
def encoder():
    return N.encoder(N.MODEL, 4)


def brute(p, text, n):
    """All segmentations of a short text, best first."""
    out = []

    def go(at, score, ids):
        if at == len(text):
            out.append((score, ids))
        for end in range(at + 1, min(len(text), at + p.longest) + 1):
            for start, more, arc in p.arcs(text, end):
                if start == at:
                    go(end, score + more, ids + arc)

    go(0, 0.0, ())
    return sorted(out, key=lambda x: -x[0])[:n]


def test_n_best_of_short_texts(encoder):
    rnd = random.Random(4)
    texts = ["".join(rnd.choices("abeist  \n\r\té日▁", k=rnd.randint(1, 11))) for _ in range(60)]
    for text, (ids, scores, others) in zip(texts, encoder.encode(texts)):
        want = brute(encoder.p, " " + text, 4)
        assert scores == pytest.approx([s for s, _ in want], abs=1e-6)
        every = [ids.tolist()] + [encoder.alternative(text, o) for o in others]
        assert len({tuple(x) for x in every}) == len(every)
        score = lambda x: next(s for s, i in brute(encoder.p, " " + text, 10**6) if i == tuple(x))
        assert [score(x) for x in every] == pytest.approx(scores, abs=1e-6)
        assert all(encoder.p.decode(x) == text for x in every)


def test_long_runs_and_words(encoder):
    text = "x" * 300 + " " * 70 + "ab" * 100
    ids, scores, _ = encoder.encode([text])[0]
    assert encoder.p.decode(ids.tolist()) == text and len(scores) == 4 and scores == sorted(scores, reverse=True)


def test_ties_of_short_words(encoder):
    rnd = random.Random(9)
    for word in ["aaaaaaaaaa", " ababababab", "日日日日日日", "-----------"] + ["".join(rnd.choices("ab", k=10)) for _ in range(20)]:
        for n in (1, 2, 4, 7):
            got, want = encoder.p.paths(word, n), brute(encoder.p, word, n)
            assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=1e-9) and len({i for _, i in got}) == len(got)


@pytest.mark.parametrize("text", ["a" * 100_000, "abcde" * 20_000, "-" * 100_000, "人工智能和机器学习" * 11_000, "QUJDREVGR0g" * 9_000])
def test_very_long_words_take_linear_time(encoder, text):
    start = time.process_time()
    ids, scores, others = encoder.encode([text])[0]
    assert time.process_time() - start < 60
    # Characters without pieces have one segmentation, as bytes.
    n = 1 if text[0] == "人" else 4
    assert encoder.p.decode(ids.tolist()) == text and len(scores) == n and scores == sorted(scores, reverse=True)
    assert len({tuple(encoder.alternative(text, o)) for o in others}) == n - 1


def test_documents(spark):
    rows = N.encode(odd_documents(spark)).collect()
    assert len(rows) == 9 and all(r.round_trip for r in rows)
    assert [(r.n_pieces, r.scores, r.ids) for r in rows if r.doc_id in (1, 2)] == [(0, [0.0], [])] * 2
    again = N.decode(N.encode(odd_documents(spark))).select("doc_id", "text").collect()
    want = [(r.doc_id, r.text or "") for r in odd_documents(spark).collect()]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in again)
    assert N.encode(no_documents(spark)).count() == 0
