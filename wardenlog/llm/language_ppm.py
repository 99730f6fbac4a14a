"""Language identification by prediction by partial matching.

For each language the counts of byte contexts up to ORDER bytes form a context tree. Under these frozen counts a text's code
length is exact: each byte is coded at its longest known context, with escapes to shorter ones (method C, with exclusion of
the symbols that longer contexts have already ruled out), at last to a uniform code of 256 bytes. The language of the
shortest code is the answer; its score is its share of 2^-length over all languages. Ties go to the first name.

Training texts are a sample of labelled rows, of about SAMPLE_BYTES for each language. It is drawn in pieces of PIECE characters by
a hash of text, id and place, so that neither long texts nor copies are drawn as one, and has a piece of each language at least.
All texts are scored whole. Before coding, a text is lower-cased and each run of ASCII characters that are not letters is one space.

Defined cases: a null text, a text without letters, or no training rows: `und`, score 0. Rows without a language do not
train. Repeated rows and null ids are rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import column, map_batches, text_hash

ORDER, SAMPLE_BYTES, PIECE = 3, 3_000_000, 20_000
#: Contexts seen less often, over all languages, are left out of the trees.
MIN_CONTEXT = 2
_LETTER = regex.compile(r"\p{L}")
_GAPS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def prepared(text: str) -> np.ndarray:
    """Bytes to code, with ORDER spaces in front."""
    data = text.lower().encode("utf-8", "ignore").translate(_GAPS)
    return np.frombuffer(b" " * ORDER + b" ".join(data.split()), np.uint8)


class Model:
    """Code lengths of every symbol after every context, for all languages at once."""

    def __init__(self, counts: list[tuple[str, int, int]]):
        """Counts of (language, ORDER + 1 bytes as a number, occurrences)."""
        self.langs = sorted({lang for lang, _, _ in counts})
        grams = np.array([g for _, g, _ in counts], np.int64)
        number = np.array([n for _, _, n in counts], np.float64)
        lang = np.array([self.langs.index(x) for x, _, _ in counts], np.int64)
        symbols = np.stack([(grams >> 8 * (ORDER - i)) & 255 for i in range(ORDER + 1)], axis=1) if len(grams) else np.zeros((0, ORDER + 1), np.int64)
        used = np.unique(symbols)
        #: Number of each byte; 0 for those that training lacks.
        self.code = np.zeros(256, np.int64)
        self.code[used] = np.arange(1, len(used) + 1)
        self.a = a = len(used) + 1
        coded = self.code[symbols]
        context = coded[:, 0]
        for i in range(1, ORDER):
            context = context * a + coded[:, i]
        seen, inverse = np.unique(context, return_inverse=True)
        inverse = inverse.ravel()
        often = np.bincount(inverse, number, len(seen)) >= MIN_CONTEXT
        deep = seen[often]
        # States: the frequent contexts of full length, and for the rest their longest suffix that some language knows.
        self.state = np.zeros(a ** ORDER, np.int32)
        every = np.arange(a ** ORDER)
        tails, first = [], 0
        for length in range(ORDER):
            tail = every % a ** length
            known = np.unique(seen % a ** length) if length else np.zeros(1, np.int64)
            place = np.searchsorted(known, tail)
            place[place == len(known)] = 0
            held = known[place] == tail if len(known) else np.zeros(len(every), bool)
            self.state[held] = first + place[held]
            tails.append((length, known))
            first += len(known)
        self.state[deep] = first + np.arange(len(deep))
        tails.append((ORDER, deep))
        self.bits = np.zeros((first + len(deep), a, len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            mine = lang == k
            self.bits[:, :, k] = self._lengths(tails, context[mine], coded[mine, ORDER], number[mine])
        self.bits = self.bits.reshape(self.bits.shape[0] * a, len(self.langs))

    def _lengths(self, tails: list[tuple[int, np.ndarray]], context: np.ndarray, symbol: np.ndarray, number: np.ndarray) -> np.ndarray:
        a, out = self.a, []
        # Dense counts of each tree level, rows by the known contexts of that length.
        levels = []
        for length, known in tails:
            row = np.searchsorted(known, context % a ** length)
            ok = (row < len(known)) & (known[np.minimum(row, max(len(known) - 1, 0))] == context % a ** length) if len(known) else np.zeros(len(context), bool)
            levels.append(np.bincount(row[ok] * a + symbol[ok], number[ok], len(known) * a).reshape(len(known), a))
        for length, known in tails:
            n = len(known)
            free, escape, p = np.ones((n, a), bool), np.ones((n, 1)), np.zeros((n, a))
            for order in range(length, -1, -1):
                row = np.searchsorted(tails[order][1], known % a ** order)
                row = np.minimum(row, max(len(tails[order][1]) - 1, 0))
                counts = levels[order][row] * free if len(levels[order]) else np.zeros((n, a))
                if order and len(levels[order]):
                    counts[tails[order][1][row] != known % a ** order] = 0
                total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
                p += escape * counts / np.maximum(total + kinds, 1)
                escape = np.where(total > 0, escape * kinds / np.maximum(total + kinds, 1), escape)
                free &= counts == 0
            # What is left is shared evenly by the bytes that are not ruled out; symbol 0 stands for one unseen byte.
            left = free[:, 1:].sum(axis=1, keepdims=True) + 256 - (a - 1)
            p += free * escape / left
            out.append(-np.log2(np.maximum(p, 1e-300)))
        return np.concatenate(out).astype(np.float32)

    def lengths(self, texts: list[np.ndarray]) -> np.ndarray:
        """Code length in bits of each prepared text for each language."""
        codes = self.code[np.concatenate(texts)]
        context = np.zeros(len(codes) - ORDER, np.int64)
        for i in range(ORDER):
            context = context * self.a + codes[i:len(codes) - ORDER + i]
        cells = self.state[context] * np.int64(self.a) + codes[ORDER:]
        size = np.array([len(t) for t in texts])
        ends = np.cumsum(size) - ORDER
        starts = ends - (size - ORDER)
        out = np.zeros((len(texts), len(self.langs)))
        for i, (s, e) in enumerate(zip(starts, ends)):
            for at in range(s, e, 1 << 20):
                out[i] += self.bits[cells[at:min(e, at + (1 << 20))]].sum(axis=0, dtype=np.float64)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        scored = [i for i, t in enumerate(texts) if t and self.langs and _LETTER.search(t)]
        out = [("und", 0.0)] * len(texts)
        if scored:
            bits = self.lengths([prepared(texts[i]) for i in scored])
            best = bits.argmin(axis=1)
            share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            for i, b, s in zip(scored, best, share):
                out[i] = self.langs[b], float(s)
        return out


def _grams(cols: dict[str, list]) -> dict[str, list]:
    found: dict[str, Counter] = {}
    for lang, text in zip(cols["lang"], cols["text"]):
        data = prepared(text).astype(np.int64)
        grams = np.zeros(max(0, len(data) - ORDER), np.int64)
        for i in range(ORDER + 1):
            grams = grams << 8 | data[i:len(data) - ORDER + i]
        values, n = np.unique(grams, return_counts=True)
        found.setdefault(lang, Counter()).update(dict(zip(values.tolist(), n.tolist())))
    rows = [(lang, g, n) for lang, c in found.items() for g, n in c.items()]
    return {name: [r[i] for r in rows] for i, name in enumerate(("lang", "gram", "n"))}


def fit(docs: DataFrame, trains: Column, text_col: str = "text", lang_col: str = "lang", sample_bytes: int = SAMPLE_BYTES,
        id_col: str = "doc_id") -> Model:
    """Context trees of the languages of the rows for which `trains` holds."""
    rows = docs.filter(trains & column(lang_col).isNotNull() & column(text_col).isNotNull()).select(
        column(lang_col).cast("string").alias("lang"), column(text_col).alias("text"), F.xxhash64(column(text_col), column(id_col)).alias("own"))
    places = F.sequence(F.lit(0), F.floor(F.greatest(F.char_length("text") - 1, F.lit(0)) / PIECE).cast("int"))
    units = rows.withColumn("place", F.explode(places)).withColumn(
        "draw", F.pmod(F.xxhash64("own", "place", F.lit("sample")), F.lit(1 << 30)) / F.lit(1 << 30))
    # Each text's bytes count once, with its first piece.
    sizes = units.groupBy("lang").agg(F.sum(F.when(F.col("place") == 0, F.octet_length("text"))).alias("bytes"), F.min("draw").alias("least"))
    rates = sizes.select("lang", (F.lit(float(sample_bytes)) / F.greatest("bytes", F.lit(1))).alias("rate"), "least")
    sample = units.join(F.broadcast(rates), "lang").filter((F.col("draw") < F.col("rate")) | (F.col("draw") == F.col("least")))
    sample = sample.select("lang", F.substring("text", F.col("place") * PIECE + 1, F.lit(PIECE)).alias("text"))
    counts = map_batches(sample, _grams, "lang string, gram bigint, n bigint", heavy="text")
    # At most as many rows as the sample has bytes.
    return Model([tuple(r) for r in counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document lang_pred and score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    texts = docs.select(column(id_col).alias("doc_id"), text_hash(column(text_col)).alias("thash"), column(text_col).alias("text"))

    def run(cols: dict[str, list]) -> dict[str, list]:
        found = shared.value.predict(cols.pop("text"))
        return cols | {"lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

    return map_batches(texts, run, f"doc_id {dict(texts.dtypes)['doc_id']}, thash bigint, lang_pred string, score double", heavy="text")
