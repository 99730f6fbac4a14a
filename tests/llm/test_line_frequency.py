import re
from collections import Counter

from wardenlog.llm import line_frequency as L

from .edge import no_documents, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    hit = {j for i, w in enumerate(windows) if w in often for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_base_figures(spark):
    got = L.quality(odd_documents(spark)).collect()
    assert len(got) == 9
    want = sorted(brute(r.text) for r in odd_documents(spark).collect())
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert L.quality(no_documents(spark)).count() == 0


def letters(n):
    return "".join(chr(97 + int(d)) for d in str(n))


def long_line(i):
    return " ".join(f"own{letters(i)}w{letters(j)}" for j in range(60))


def corpus(spark):
    shared = "Shared words of a host, number 7.\n"
    rows = [(i, shared + long_line(i), "h") for i in range(30)]  # a short shared line: not depleted
    notice = " ".join(f"notice{letters(j)}" for j in range(80))
    rows += [(100 + i, notice + f"\nshort tail {letters(i)}", "h") for i in range(25)]  # depleted but for the first
    rows += [(200 + i, notice + "\nother tail", "other") for i in range(25)]  # exact copies count once
    return spark.createDataFrame(rows, "doc_id int, text string, source string")


def test_frequent_lines_and_depleted_documents(spark):
    got = {r.doc_id: r for r in L.quality(corpus(spark)).collect()}
    assert [got[i].n_removed_words for i in (0, 1, 29)] == [0, 7, 7]
    assert all(got[i].kept for i in range(30))
    assert [got[i].kept for i in (100, 101, 124)] == [True, False, False]
    assert all(got[200 + i].kept for i in range(25))


def test_stage_keeps_columns_and_rows(spark):
    docs = corpus(spark)
    kept = L.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 30 + 1 + 25
    odd = odd_documents(spark)
    assert L.keep_good(odd).columns == odd.columns


def test_frequent_lines_are_cut_from_the_text(spark):
    docs = corpus(spark).selectExpr("*", "CAST(length(text) AS bigint) AS n_chars")
    got = {r.doc_id: r for r in L.keep_good(docs).collect()}
    assert got[0].text.startswith("Shared words of a host, number 7.\n")  # the first bearer
    assert all(got[i].text == long_line(i) for i in range(1, 30))
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert got[100].text.startswith("notice") and all(got[200 + i].text.endswith("\nother tail") for i in range(25))


def test_limits_do_not_rise_with_the_host(spark):
    shared = "A line of fifty documents.\n"
    small = [(i, shared + long_line(i), "h") for i in range(50)]
    others = [(100 + i, f"Filler {letters(i)} of a large host", "h") for i in range(30_000)]
    copies = [(100_000 + i, "The very same filler", "h") for i in range(5000)]
    for rows in (small, small + others, small + copies):
        got = L.quality(spark.createDataFrame(rows, "doc_id int, text string, source string"))
        assert got.filter("doc_id < 50 AND n_removed_words = 5").count() == 49


def test_same_as_sql_on_a_large_host(spark, tmp_path):
    from tools.compare import connect, difference
    from wardenlog.llm.oracles import ORACLES

    rows = [(i, f"A line of some documents.\n{long_line(i)}" if i < 35 else f"Filler {letters(i)} of a large host\nrepeated line of all", "h") for i in range(10_500)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").toPandas().to_parquet(tmp_path / "documents.parquet")
    want = connect(str(tmp_path)).execute(ORACLES["op4_line_frequency"]).df()
    assert (want.n_removed_words > 0).sum() > 10_000
    got = L.quality(spark.read.parquet(str(tmp_path / "documents.parquet"))).drop("thash").toPandas()
    assert difference(got, want) is None
