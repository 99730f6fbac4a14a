"""Near-duplicate documents: SimHash fingerprints, linked at few differing bits through Golay-code keys.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. If two fingerprints differ in two bits, one segment at
least has no error, and any other segment has two at most. So each segment's value with each Golay key of the next segment
is a key, and linked fingerprints share one (see `golay`). Fingerprints that share a key are compared. A key with more than
BUCKET fingerprints is not expanded into pairs: there each fingerprint goes to the 65 words within one bit of it, and those
that meet at a word, which are within two bits of each other, are linked to the smallest. That is exact as well, and linear.

Defined cases: a text without words has fingerprint zero, linked like any other; a null text likewise; null and repeated ids
are rows of their own with the component of their text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from ..scratch import written
from . import golay
from .common import carried, column, map_batches, same_document, text_hash, utf8
from .components import components

SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Fingerprints of a key that are compared pair by pair; more go by the words around them.
BUCKET = 64
#: First bit and length of each segment.
SEGMENTS = ((42, 22), (21, 21), (0, 21))


def fingerprint(text: bytes | None) -> int:
    """Majority of the bits of the shingles' hashes, as a signed number."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    hashes = [xxhash.xxh64_digest(b" ".join(words[i:i + SHINGLE]), SEED) for i in range(n)]
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        part = np.frombuffer(b"".join(hashes[i:i + 4096]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns doc_id, thash, fp, a row for each document, as a written table."""
    texts = docs.select(column(id_col).alias("doc_id"), text_hash(column(text_col)).alias("thash"), utf8(column(text_col)).alias("text"))

    def run(cols: dict[str, list]) -> dict[str, list]:
        return cols | {"fp": [fingerprint(t) for t in cols.pop("text")]}

    return written(map_batches(texts, run, f"doc_id {dict(texts.dtypes)['doc_id']}, thash bigint, fp bigint", heavy="text"), "fingerprints")


@pandas_udf(ArrayType(LongType()))
def _keys(fp: pd.Series) -> pd.Series:
    """Segment number, its value and a Golay key of the next segment, packed into one number."""
    x = fp.to_numpy(np.int64).view(np.uint64)
    parts = [((x >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    packed = []
    for i in range(3):
        k = golay.keys(parts[(i + 1) % 3])
        packed.append(np.where(k < 0, -1, (np.int64(i) << 34) | (parts[i][:, None] << 12) | k))
    allk = np.concatenate(packed, axis=1)
    return pd.Series([row[row >= 0] for row in allk])


def linked(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints (fp) within MAX_BITS bits."""
    keyed = written(fps.select("fp", F.explode(_keys("fp")).alias("k")), "golay-keys")
    sizes = keyed.groupBy("k").agg(F.count("*").alias("size")).filter("size > 1")
    met = written(keyed.join(sizes, "k"), "golay-buckets", keyed.count())
    members = met.filter(F.col("size") <= bucket).groupBy("k").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    near = (
        members.select(F.posexplode("fps").alias("i", "a"), "fps")
        .select("a", F.explode(F.expr("filter(slice(fps, i + 2, size(fps)), b -> bit_count(a ^ b) <= %d)" % MAX_BITS)).alias("b"))
        .distinct()
    )
    around = met.filter(F.col("size") > bucket).select("fp").distinct().select(
        "fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("word"))
    # At most 65 fingerprints meet at a word.
    stars = (
        around.groupBy("word").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
        .select(F.explode("fps").alias("a"), "b").filter("a != b").distinct()
    )
    return near.unionByName(stars)


def classes(fp_table: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Columns doc_id, thash, fp, root of the class, component_id (the smallest id in it) for a table of fingerprints."""
    firsts = written(fp_table.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints", fp_table.count())
    roots = components(linked(firsts.select("fp"), bucket), len(SEGMENTS) * firsts.count()).select(F.col("node").alias("fp"), "root")
    rooted = written(firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted-fingerprints")
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = rooted.join(ids, "root").select("fp", "root", "component_id")
    return fp_table.join(of_fp, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """For each document its fingerprint (16 hex digits) and the smallest id of its class."""
    found = classes(fingerprints(docs, id_col, text_col), bucket)
    return found.select("doc_id", "thash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, that with the smallest id (and text hash), with all its columns."""
    of_class = classes(fingerprints(docs, id_col, text_col)).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "thash")).alias("first"))
    first = of_class.select("first.doc_id", "first.thash").distinct()
    rows = carried(docs, id_col, text_col)
    kept = rows.join(first, same_document(rows, first), "left_semi")
    # Repeated rows of the kept document: one stays.
    return kept.dropDuplicates(["doc_id", "thash"]).select("row.*")
