import random
from itertools import count

import xxhash
from pyspark.sql import functions as F

from wardenlog import scratch
from wardenlog.llm import golay, simhash_golay as S

from .edge import no_documents, odd_documents


def test_near_words_share_a_golay_key():
    rnd = random.Random(3)
    keys = lambda w: {int(k) for k in golay.keys(__import__("numpy").array([w]))[0] if k >= 0}
    for _ in range(2000):
        word = other = rnd.getrandbits(23)
        for bit in rnd.sample(range(23), rnd.randint(0, 2)):
            other ^= 1 << bit
        assert keys(word) & keys(other)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


def unsigned(x):
    return x & (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def clustered():
    """Chains and dense balls around a few centres."""
    rnd, out = random.Random(5), set()
    for _ in range(12):
        at = rnd.getrandbits(64)
        for _ in range(25):
            out.add(at)
            for bit in rnd.sample(range(64), rnd.randint(1, 3)):
                at ^= 1 << bit
    centre = rnd.getrandbits(64)
    out |= {centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(0, 64, 5)}
    return sorted(out)


def components_of(spark, bucket):
    fps = clustered()
    table = spark.createDataFrame([(i, 0, signed(f)) for i, f in enumerate(fps)], "doc_id bigint, thash bigint, fp bigint")
    got = {unsigned(r.fp): r.component_id for r in S.classes(table, bucket).collect()}
    roots, first = brute_components(fps), {}
    for i, f in enumerate(fps):
        first.setdefault(roots[f], i)
    assert got == {f: first[roots[f]] for f in fps}


def test_components_by_pairs(spark):
    components_of(spark, 10_000)


def test_components_where_keys_are_crowded(spark):
    components_of(spark, 4)


def test_fingerprints_and_classes_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in odd_documents(spark).collect()]
    got = S.near_duplicates(odd_documents(spark)).collect()
    assert sorted(r.fingerprint for r in got) == sorted(f"{brute_fingerprint(t):016x}" for _, t in rows)
    assert len(got) == 9 and {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    assert S.near_duplicates(no_documents(spark)).count() == 0


def test_one_document_of_each_class_stays(spark):
    odd = odd_documents(spark)
    kept = S.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(ids) == len(set(ids)) == 7  # rows 1 and 2 are one class, the repeated row is one
    assert S.keep_first(odd.filter(F.lit(False))).count() == 0


def test_small_tables_go_to_few_files(spark, tmp_path, monkeypatch):
    """However many shuffle partitions there are: each file costs its own processes and requests."""
    numbers = count()
    monkeypatch.setattr(scratch, "scratch_path", lambda spark, name: f"file://{tmp_path}/{name}-{next(numbers)}")
    settings = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        components_of(spark, 4)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {}
    for d in tmp_path.iterdir():
        files.setdefault(d.name.rsplit("-", 1)[0], []).append(len(list(d.glob("*.parquet"))))
    small = ("links", "large-stars", "small-stars", "distinct-fingerprints", "golay-buckets")
    assert all(max(files[x]) <= 2 for x in small), files
