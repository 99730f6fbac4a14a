"""The pipeline's stages on their own, and its run against brute force over one small table."""

import __spark_entry__ as entry
import corpus_pipeline
import pytest

from tools.compare import connect, difference
from wardenlog.llm import nbest
from wardenlog.llm.oracles import ORACLES

from . import test_credentials, test_line_frequency, test_positional, test_simhash_golay
from .edge import no_documents, odd_documents

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    for docs in (odd_documents(spark), no_documents(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_run_against_brute_force(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    # No host has enough documents here for a line to be frequent, so the base rules alone decide.
    kept = [r for r in docs if (b := test_line_frequency.brute(r.text))[0] >= 50 and 100 * b[4] <= 50 * b[0]]
    roots = test_simhash_golay.brute_components({test_simhash_golay.brute_fingerprint(r.text) for r in kept})
    first = {}
    for r in sorted(kept, key=lambda r: r.doc_id):
        first.setdefault(roots[test_simhash_golay.brute_fingerprint(r.text)], r)
    clean = [r for r in first.values() if not test_positional.brute([(r.doc_id, r.text)], items)[0][2]]
    want = {}
    enc = nbest.encoder(nbest.MODEL, nbest.N_BEST)
    for r in clean:
        text, last = "", 0
        spans = sorted(tuple(map(int, x.split(":")[1:])) for x in test_credentials.brute(r.text)[-1].split(",") if x)
        for s, e in spans:
            if s >= last:
                text += r.text[last:s] + "[SECRET]"
            last = max(last, e)
        want[r.doc_id] = enc.encode([text + r.text[last:]])[0][0].tolist()
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    found = entry.queries()[name](spark, SF)
    assert difference(found.toPandas().astype({c: "float64" for c in found.columns if c == "refers_to"}),
                      connect(SF).execute(ORACLES[name]).df().astype({c: "float64" for c in found.columns if c == "refers_to"})) is None
