"""Quality rules: lines that many documents of a host share.

Lines are normalised and hashed; per host the distinct documents of each line are counted, and lines above the limits
are removed from the texts of the documents that are kept. A document that is left depleted is rejected. Exact copies of a text count as one document, and a removed
line stays in its first document of the host, so that of repeated content one bearer is kept.

Defined cases: a null text has no words; a null host is a host of its own; a null or repeated id changes nothing, each
row is judged by itself; ties for the first document go to the smallest text hash; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType

from ..scratch import written
from .common import carried, column, map_batches, same_document, text_hash, utf8

#: A line is removed if more than MAX_DOCS distinct documents of its host hold it, however large the host is.
MAX_DOCS = 20
#: A document is depleted if more than this share of its words is removed.
MAX_REMOVED = 0.8
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SPACE = b" \t\n\x0b\x0c\r"
_NOT_A_CHARACTER = _SPACE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_RULED = "words bigint, chars bigint, symbols bigint, dup_lines bigint, repeats bigint, lines array<struct<h:binary,n:int>>"
_GAPS = re.compile(rb"[^0-9a-z\x80-\xff]+")
_DIGITS = re.compile(rb"[0-9]+")


def normalised(line: bytes) -> bytes:
    """Lower-case letters, one space for all between words, one zero for each number."""
    return _DIGITS.sub(b"0", _GAPS.sub(b" ", line.lower())).strip()


def rules_of(text: bytes | None) -> tuple:
    """Base figures of a text, and its distinct normalised lines with their words."""
    if not text:
        return 0, 0, 0, 0, 0, []
    words = text.split()
    n = len(words)
    windows = list(zip(words, words[1:], words[2:]))
    counts, covered = Counter(windows), bytearray(n)
    if len(counts) < len(windows):
        for i, w in enumerate(windows):
            if counts[w] > 1:
                covered[i:i + 3] = b"\1\1\1"
    dup, seen, lines = 0, set(), {}
    for line in text.split(b"\n"):
        if k := len(line.split()):
            dup += line in seen
            seen.add(line)
            if norm := normalised(line):
                h = hashlib.blake2b(norm, digest_size=16).digest()
                lines[h] = lines.get(h, 0) + k
    chars = len(text.translate(None, _NOT_A_CHARACTER))
    return n, chars, len(text) - len(text.translate(None, _SYMBOLS)), dup, sum(covered), [{"h": h, "n": k} for h, k in lines.items()]


def _ruled(cols: dict[str, list]) -> dict[str, list]:
    rows = [rules_of(t) for t in cols.pop("text")]
    names = ("words", "chars", "symbols", "dup_lines", "repeats", "lines")
    return cols | {name: [r[i] for r in rows] for i, name in enumerate(names)}


def line_counts(rows: DataFrame) -> DataFrame:
    """For each host and line hash (h) of the base table: the distinct documents, and the first document's id and hash."""
    lines = rows.select("host", "doc_id", "thash", F.explode("lines.h").alias("h"))
    # Copies of a text fall together before documents are counted; both steps combine in the map tasks.
    by_text = lines.groupBy("host", "h", "thash").agg(F.min("doc_id").alias("doc_id"))
    return by_text.groupBy("host", "h").agg(
        F.count("*").alias("n_docs"), F.min(F.col("doc_id")).alias("first_id"),
    )


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, max_docs: int, max_removed: float) -> DataFrame:
    """Base figures of each row, hashes of the lines to remove (`cut`, null if none) and their words, base_failed, kept."""
    base = docs.select(
        column(id_col).alias("doc_id"), column(host_col).cast("string").alias("host"), text_hash(column(text_col)).alias("thash"),
        utf8(column(text_col)).alias("text"))
    schema = f"doc_id {dict(base.dtypes)['doc_id']}, host string, thash bigint, {_RULED}"
    # Written with a row number, so that repeated rows stay apart and texts are read once.
    rows = written(map_batches(base, _ruled, schema, heavy="text").withColumn("row", F.monotonically_increasing_id()), "line-rules")

    frequent = line_counts(rows).filter(F.col("n_docs") > max_docs)
    held = rows.select("row", "host", "doc_id", F.explode("lines").alias("line")).select("row", "host", "doc_id", "line.h", "line.n")
    removed = (
        held.alias("l").join(frequent.alias("f"), F.expr("l.h = f.h AND l.host <=> f.host"))
        .filter(~F.col("l.doc_id").eqNullSafe(F.col("f.first_id")))
        .groupBy("l.row").agg(F.sum("n").alias("removed"), F.collect_list("l.h").alias("cut"))
    )
    out = rows.drop("lines").join(removed, "row", "left").withColumn("removed", F.coalesce("removed", F.lit(0)))
    failed = (F.col("words") < MIN_WORDS) | (100 * F.col("repeats") > MAX_REPEAT_PERCENT * F.col("words"))
    return out.withColumns({"base_failed": failed, "kept": ~failed & (F.col("removed") <= F.lit(max_removed) * F.col("words"))})


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS,
            max_removed: float = MAX_REMOVED) -> DataFrame:
    """One row for each document: base figures, words in removed lines, base_failed, kept."""
    return _judged(docs, id_col, text_col, host_col, max_docs, max_removed).select(
        "doc_id", "thash", F.col("words").alias("n_words"), F.col("chars").alias("word_chars"), F.col("symbols").alias("n_symbols"),
        F.col("dup_lines").alias("n_dup_lines"), F.col("repeats").alias("n_repeat_words"), F.col("removed").alias("n_removed_words"),
        "base_failed", "kept",
    )


def without_lines(text: bytes, cut: list[bytes]) -> bytes:
    """The text's lines, but for those of the hashes."""
    gone = set(cut)
    return b"\n".join(x for x in text.split(b"\n") if hashlib.blake2b(normalised(x), digest_size=16).digest() not in gone)


@F.pandas_udf(BinaryType())
def _without_lines(texts: pd.Series, cuts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or c is None else without_lines(t, list(c)) for t, c in zip(texts, cuts)], dtype=object)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS,
              max_removed: float = MAX_REMOVED) -> DataFrame:
    """The documents that the rules keep, with all their columns: frequent lines are cut from the text, and n_chars counts what is left."""
    judged = _judged(docs, id_col, text_col, host_col, max_docs, max_removed)
    # Rows of the same host, id and text have the same verdict.
    found = judged.filter(~F.col("kept") | F.col("cut").isNotNull()).groupBy("host", "doc_id", "thash").agg(
        F.first("kept").alias("kept"), F.first("cut").alias("cut"))
    rows = carried(docs, id_col, text_col).withColumn("host", F.col("row").getField(host_col).cast("string"))
    both = rows.join(found, same_document(rows, found) & rows.host.eqNullSafe(found.host), "left").filter(F.coalesce("kept", F.lit(True)))
    text = F.col("row").getField(text_col)
    # Only texts to change go to Python.
    both = both.select("row", "cut", _without_lines(F.when(F.col("cut").isNotNull(), utf8(text)), "cut").cast("string").alias("left_text"))
    out = []
    for name in docs.columns:
        value = F.col("row").getField(name)
        if name == text_col:
            value = F.when(F.col("cut").isNotNull(), F.col("left_text")).otherwise(value)
        elif name == "n_chars":
            value = F.when(F.col("cut").isNotNull(), F.char_length("left_text")).otherwise(value).cast(docs.schema[name].dataType)
        out.append(value.alias(name))
    return both.select(*out)
