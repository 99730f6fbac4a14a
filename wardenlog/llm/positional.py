"""Benchmark decontamination by a positional inverted index of the training text.

Each benchmark item gives windows of consecutive words. The corpus frequency of every benchmark term is counted, and each
window is looked up by its two rarest terms: their postings (term, document, position) are stored as a table, moved back by
the term's offset in the window, and intersected. Where both lists hold the same start the window is checked word by word
in the document. Windows with a term that the corpus lacks end before any posting is written.

Benchmark windows are taken in blocks of about BLOCK, so what tasks hold of them is bounded however large the benchmark is;
each block is held against all documents.

Defined cases: null texts have no words; an item without words has no window and is in no document; items with equal text all
count; repeated rows and null ids are documents and items of their own; an empty table gives no hits; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

from pyspark.sql import DataFrame, Window, functions as F

from ..scratch import written
from .common import carried, column, map_batches, same_document, text_hash, utf8

WINDOW, ANCHORS, BLOCK = 10, 2, 50_000

#: Letters of either case, digits and all bytes beyond ASCII make words; the rest are gaps.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows as a written table: win (hash of the words), terms. And for each item its windows: win, item."""
    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"item": [], "terms": [], "win": []}
        for item, text in zip(cols["item"], cols["text"]):
            words = words_of(text)
            for i in range(max(1, len(words) - size + 1) if words else 0):
                terms = words[i:i + size]
                out["item"].append(item)
                out["terms"].append(terms)
                out["win"].append(hashlib.blake2b(b" ".join(terms), digest_size=16).digest())
        return out

    texts = items.select(column(id_col).cast("string").alias("item"), utf8(column(text_col)).alias("text"))
    return written(map_batches(texts, run, "item string, terms array<binary>, win binary", heavy="text"), "windows")


def term_frequencies(texts: DataFrame, terms: set[bytes]) -> DataFrame:
    """Occurrences of each of the terms in the column text."""
    def run(cols: dict[str, list]) -> dict[str, list]:
        seen: Counter = Counter()
        for text in cols["text"]:
            seen.update(w for w in words_of(text) if w in terms)
        return {"term": list(seen), "n": list(seen.values())}

    counts = map_batches(texts.select("text"), run, "term binary, n bigint", heavy="text")
    return counts.groupBy("term").agg(F.sum("n").alias("n"))


def postings(texts: DataFrame, terms: set[bytes]) -> DataFrame:
    """The index: term, doc_id, thash, pos of each occurrence of the terms."""
    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"term": [], "doc_id": [], "thash": [], "pos": []}
        for doc_id, thash, text in zip(cols["doc_id"], cols["thash"], cols["text"]):
            for pos, w in enumerate(words_of(text)):
                if w in terms:
                    for name, value in zip(out, (w, doc_id, thash, pos)):
                        out[name].append(value)
        return out

    kind = dict(texts.dtypes)["doc_id"]
    return map_batches(texts, run, f"term binary, doc_id {kind}, thash bigint, pos int", heavy="text")


def _anchors(distinct: DataFrame, frequencies: DataFrame) -> DataFrame:
    """The rarest two terms of each window with their offsets; none for windows with a term that never occurs."""
    placed = distinct.select("win", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    known = placed.join(frequencies, "term")
    rank = Window.partitionBy("win").orderBy("n", "offset")
    whole = known.withColumn("rank", F.row_number().over(rank)).withColumn("found", F.count("*").over(Window.partitionBy("win")))
    return whole.filter((F.col("found") == F.col("size")) & (F.col("rank") <= ANCHORS)).select("win", "rank", "offset", "term", "size")


def starts(texts: DataFrame, distinct: DataFrame) -> DataFrame:
    """Candidates win, doc_id, thash, start: places where the window's two rarest terms stand in their order and distance."""
    vocabulary = {bytes(r.term) for r in distinct.select(F.explode("terms").alias("term")).distinct().collect()}
    anchors = written(_anchors(distinct, term_frequencies(texts, vocabulary)), "anchors")
    wanted = {bytes(r.term) for r in anchors.select("term").distinct().collect()}
    index = written(postings(texts, wanted), "postings")
    # A block of windows is bounded, and so are its anchors: sending them to the postings moves none of these.
    moved = index.join(F.broadcast(anchors), "term").select("win", "doc_id", "thash", (F.col("pos") - F.col("offset")).alias("start"), "rank", "size")
    lone = moved.filter("size = 1").select("win", "doc_id", "thash", "start")
    many = moved.filter("size > 1")
    # Ranks one and two are one bit each: a single step with partial results, whatever rows repeat.
    both = many.groupBy("win", "doc_id", "thash", "start").agg(F.bit_or(F.col("rank")).alias("ranks")).filter(
        F.col("ranks") == 3)
    return lone.unionByName(both.drop("ranks")).filter("start >= 0").distinct()


def _blocks(spread: DataFrame) -> list[DataFrame]:
    n = max(1, math.ceil(spread.count() / BLOCK))
    return [spread.filter(F.pmod(F.xxhash64("win"), F.lit(n)) == i) for i in range(n)]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """For each document n_words, n_hit, items (sorted ids, as strings) and contaminated."""
    hashed = windows(items, item_col, item_text_col, size)
    # Numbers are shorter than hashes in all that follows.
    numbered = written(hashed.groupBy("win").agg(F.first("terms").alias("terms")).withColumn("number", F.monotonically_increasing_id()), "distinct-windows", hashed.count())
    distinct = numbered.select(F.col("number").alias("win"), "terms")
    of_items = hashed.select("win", "item").distinct().join(numbered, "win").select(F.col("number").alias("win"), "item")
    texts = docs.select(column(id_col).alias("doc_id"), text_hash(column(text_col)).alias("thash"), utf8(column(text_col)).alias("text"))
    found = [starts(texts, block) for block in _blocks(distinct)]
    places = found[0]
    for more in found[1:]:
        places = places.unionByName(more)
    # Each window's words come along once for each document, with its places there.
    by_window = places.groupBy("doc_id", "thash", "win").agg(F.collect_list("start").alias("starts"))
    by_doc = by_window.join(distinct, "win").groupBy("doc_id", "thash").agg(
        F.collect_list(F.struct("win", "terms", "starts")).alias("tries"))
    tried = texts.join(by_doc, same_document(texts, by_doc), "left").select(texts.doc_id, texts.thash, "text", "tries")

    def check(cols: dict[str, list]) -> dict[str, list]:
        n_words, n_hit, wins = [], [], []
        for text, tries in zip(cols["text"], cols["tries"]):
            words = words_of(text)
            hit, held = bytearray(len(words)), []
            for one in tries or ():
                terms, here = one["terms"], False
                for at in one["starts"]:
                    if words[at:at + len(terms)] == terms:
                        hit[at:at + len(terms)] = b"\1" * len(terms)
                        here = True
                if here:
                    held.append(one["win"])
            n_words.append(len(words))
            n_hit.append(sum(hit))
            wins.append(held)
        return {"doc_id": cols["doc_id"], "thash": cols["thash"], "n_words": n_words, "n_hit": n_hit, "wins": wins}

    kind = dict(texts.dtypes)["doc_id"]
    checked = written(map_batches(tried, check, f"doc_id {kind}, thash bigint, n_words bigint, n_hit bigint, wins array<bigint>", heavy="text")
                      .withColumn("row", F.monotonically_increasing_id()), "checked")
    ids = (
        checked.select("row", F.explode("wins").alias("win")).join(of_items, "win")
        .groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    out = checked.drop("wins").join(ids, "row", "left")
    return out.select("doc_id", "thash", "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      (F.col("n_hit") > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, items: DataFrame, **parameters) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    bad = contamination(docs, items, **parameters).filter("contaminated").select("doc_id", "thash").distinct()
    rows = carried(docs, parameters.get("id_col", "doc_id"), parameters.get("text_col", "text"))
    return rows.join(bad, same_document(rows, bad), "left_anti").select("row.*")


def near_phrases(docs: DataFrame, phrases: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """Proximity matches: doc_id, thash, item, first (word position) where all words of a phrase stand, in any order, within a
    span of `slop` words more than the phrase has.

    The phrase's rarest term is looked up in the index; the words around each posting, which are stored with it, are tried.
    """
    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"item": cols["item"], "terms": [words_of(t) for t in cols["text"]]}

    texts = docs.select(column(id_col).alias("doc_id"), text_hash(column(text_col)).alias("thash"), utf8(column(text_col)).alias("text"))
    asked = map_batches(phrases.select(column(item_col).cast("string").alias("item"), utf8(column(item_text_col)).alias("text")), run,
                        "item string, terms array<binary>", heavy="text").filter(F.size("terms") > 0)
    asked = written(asked.withColumn("win", F.unhex(F.md5(F.concat_ws(" ", F.col("terms").cast("array<string>"))))), "phrases")
    distinct = written(asked.groupBy("win").agg(F.first("terms").alias("terms")), "distinct-phrases")
    found = None
    for block in _blocks(distinct):
        vocabulary = {bytes(r.term) for r in block.select(F.explode("terms").alias("term")).distinct().collect()}
        anchors = written(_anchors(block, term_frequencies(texts, vocabulary)).filter("rank = 1"), "anchors")
        index = postings(texts, {bytes(r.term) for r in anchors.select("term").distinct().collect()})
        near = index.join(F.broadcast(anchors), "term").groupBy("doc_id", "thash", "win").agg(F.collect_set("pos").alias("places"))
        found = near if found is None else found.unionByName(near)
    tries = found.join(distinct, "win").groupBy("doc_id", "thash").agg(F.collect_list(F.struct("win", "terms", "places")).alias("tries"))
    tried = texts.join(tries, same_document(texts, tries)).select(texts.doc_id, texts.thash, "text", "tries")

    def check(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": [], "thash": [], "win": [], "first": []}
        for doc_id, thash, text, tries in zip(cols["doc_id"], cols["thash"], cols["text"], cols["tries"]):
            words = words_of(text)
            for one in tries:
                need, span = Counter(one["terms"]), len(one["terms"]) + slop
                at = [s for p in sorted(one["places"]) for s in range(max(0, p - span + 1), p + 1) if not need - Counter(words[s:s + span])]
                if at:
                    for name, value in zip(out, (doc_id, thash, one["win"], min(at))):
                        out[name].append(value)
        return out

    kind = dict(texts.dtypes)["doc_id"]
    hits = map_batches(tried, check, f"doc_id {kind}, thash bigint, win binary, first bigint", heavy="text")
    return hits.join(asked.select("win", "item").distinct(), "win").select("doc_id", "thash", "item", "first").distinct()
