import random

from wardenlog.llm import positional as P

from .edge import no_documents, odd_documents


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in lower).replace("\t", " ").split(" ")


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w = [x for x in words(text) if x]
        hit, held = set(), set()
        for item, t in items:
            b = [x for x in words(t) if x]
            for i in range(max(1, len(b) - 9) if b else 0):
                win = b[i:i + 10]
                for j in range(len(w) - len(win) + 1):
                    if w[j:j + len(win)] == win:
                        hit |= set(range(j, j + len(win)))
                        held.add(str(item))
        out.append((doc_id, len(w), len(hit), sorted(held)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rnd = random.Random(9)
    vocabulary = [f"W{i}" if i % 3 else f"é{i}" for i in range(25)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([0, 1, 2, 5, 10, 14])))) for i in range(25)] + [(90, None), (91, "same words"), (92, "Same, words!")]
    docs = [(i, ", ".join(rnd.choices(vocabulary, k=60))) for i in range(20)]
    docs += [(50 + i, " x ".join(rnd.choices(vocabulary, k=5)) + " " + items[i][1].upper() + " tail " + items[i][1]) for i in range(25)]
    docs += [(80, None), (81, ""), (82, "these are the same words again same words")]
    got = P.contamination(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"))
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got.collect()), key=str) == brute(docs, items)


def test_odd_rows_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "SAME text, here"), (None, "another text of"), (2, None)], "item_id int, text string")
    odd = odd_documents(spark)
    got = P.contamination(odd, items)
    assert got.count() == 9 and got.filter("contaminated").count() == 3
    kept = P.remove_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == 6
    assert P.contamination(no_documents(spark), items).count() == 0
    assert P.contamination(odd, items.limit(0)).filter("contaminated").count() == 0


def test_near_phrases(spark):
    docs = spark.createDataFrame([(1, "a red big fox ran"), (2, "fox of red"), (3, "red " + "x " * 9 + "fox"), (4, None)], "doc_id int, text string")
    asked = spark.createDataFrame([("q", "red fox"), ("none", "absent fox")], "item_id string, text string")
    found = {(r.doc_id, r.item, r.first) for r in P.near_phrases(docs, asked, slop=1).collect()}
    assert found == {(1, "q", 1), (2, "q", 0)}
