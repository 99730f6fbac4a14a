"""Secret scans: multipart credentials, linked within scopes, with DataFrame functions only.

Spans of fixed forms (assigned values, access identifiers, hexadecimal runs) are reported by themselves. Weak candidates
are reported only where complementary parts stand within SCOPE code points of them in the same text: a bare key (40 letters
of mixed kinds) or a named account needs the other part, identifier or secret; an endpoint needs both. The parts' intervals
are brought together by an equi-join on document and stretch of SCOPE code points: for each stretch the first start and last
end of each part are enough to tell whether one is in reach, so no pairs within a stretch are made.

Positions are code points, end exclusive. Defined cases: a null text counts as empty; repeated rows and null ids are rows of
their own; equal spans of different kinds are all reported; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..scratch import written
from .common import carried, column, same_document, text_hash

SCOPE = 200

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in their order; those from `account` on are weak. A match's last group, if any, is its value.
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
    "account": r"""(?<![A-Za-z0-9_])(?i:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""",
    "key": r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])",
    "endpoint": r"""(?<![A-Za-z0-9])(?:https?|jdbc:[a-z0-9]{1,20}|postgres(?:ql)?|mysql|mongodb|redis|s3|ftp|amqp)://[^\x20\x09-\x0D"'<>|]{3,}""",
}
KINDS = list(PATTERNS)
PARTS = {"access": "identifier", "account": "identifier", "assign": "secret", "key": "secret", "hex": "secret", "endpoint": "endpoint"}
MIN_VALUE = 8


def _found(text: Column, kind: str) -> Column:
    """Matches of a kind in their order: code points before each since the last one, its length, whether it counts."""
    pattern = F.lit(PATTERNS[kind])
    whole, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, PATTERNS[kind], -1)
    if kind == "assign":
        counts = F.transform(whole, lambda m: F.length(F.regexp_extract(m, PATTERNS[kind], 1)) >= MIN_VALUE)
    elif kind == "key":
        counts = F.transform(whole, lambda m: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]"))
    else:
        counts = F.transform(whole, lambda m: F.lit(True))
    found = F.arrays_zip(
        F.transform(F.slice(between, 1, F.size(whole)), lambda g: F.length(g)).alias("gap"),
        F.transform(whole, lambda m: F.length(m)).alias("len"), counts.alias("counts"))
    return F.when(text.rlike(PATTERNS[kind]), F.struct(F.lit(KINDS.index(kind)).alias("kind"), found.alias("found")))


def _spans(table: DataFrame) -> DataFrame:
    """Columns row, kind (number), start, end of the table's matches."""
    each = table.select("row", F.explode(F.filter("kinds", lambda k: k.isNotNull())).alias("k"))
    each = each.select("row", "k.kind", F.posexplode("k.found").alias("i", "m"))
    # A running sum over the matches of one kind in one text.
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("m.gap") + F.col("m.len")).over(so_far))
    return each.filter("m.counts").select("row", "kind", (F.col("end") - F.col("m.len")).alias("start"), "end")


def _part() -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kind, part in PARTS.items() for x in (KINDS.index(kind), part)]), F.col("kind"))


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans (row, kind, start, end) that have their complementary parts within `scope` code points."""
    parts = spans.withColumn("part", _part())
    held = parts.select("row", "part", "start", "end", F.explode(F.sequence(
        F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope))).alias("stretch"))
    held = held.groupBy("row", "part", "stretch").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    weak = parts.filter(F.col("kind") >= KINDS.index("account")).select("row", "kind", "start", "end", "part")
    reach = weak.withColumn("stretch", F.explode(F.sequence(
        F.floor(F.col("start") / scope) - 1, F.floor((F.col("end") - 1) / scope) + 1)))
    near = (
        reach.alias("w").join(held.alias("h"), F.expr("w.row = h.row AND w.stretch = h.stretch AND w.part <> h.part"))
        .filter(F.expr(f"h.first < w.end + {scope} AND h.last > w.start - {scope}"))
        .groupBy("w.row", "w.kind", "w.start", "w.end").agg(
            F.max(F.col("h.part") == "identifier").alias("identifier"), F.max(F.col("h.part") == "secret").alias("secret"))
    )
    complete = (
        F.when(F.col("kind") == KINDS.index("account"), F.col("secret"))
        .when(F.col("kind") == KINDS.index("key"), F.col("identifier")).otherwise(F.col("identifier") & F.col("secret"))
    )
    return near.filter(complete).select("row", "kind", "start", "end")


def _listed(spans: Column) -> Column:
    """kind:start:end of sorted structs (start, kind, end), comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """For each document the number of spans of each fixed kind and all spans, as structs (start, kind number, end)."""
    text = F.coalesce(column(text_col), F.lit(""))
    table = written(docs.select(
        column(id_col).alias("doc_id"), text_hash(column(text_col)).alias("thash"), F.array(*[_found(text, k) for k in KINDS]).alias("kinds"),
        F.monotonically_increasing_id().alias("row")), "secret-matches")
    spans = written(_spans(table), "secret-spans")
    fixed = spans.filter(F.col("kind") < KINDS.index("account"))
    each = fixed.unionByName(linked(spans, scope)).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    out = table.select("row", "doc_id", "thash").join(each, "row", "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return out.select("doc_id", "thash", F.coalesce("spans", none).alias("spans"))


def scanned(docs: DataFrame, **parameters) -> DataFrame:
    """For each document n_assign, n_access, n_hex, base_sha256 and spans as text."""
    found = secrets(docs, **parameters)
    fixed = F.filter("spans", lambda s: s["kind"] < KINDS.index("account"))
    return found.select(
        "doc_id", "thash",
        *[F.size(F.expr(f"filter(spans, s -> s.kind = {i})")).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(_listed(fixed).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """The documents with every reported span replaced by a mark, overlapping spans by one; n_chars, if there, is counted anew."""
    found = secrets(docs, id_col, text_col, scope).filter(F.size("spans") > 0).select("doc_id", "thash", "spans").dropDuplicates(["doc_id", "thash"])
    rows = carried(docs, id_col, text_col)
    text = F.col("row")[text_col]
    # Where a span begins behind all earlier ones a new mark begins; what stands before it is kept.
    ends = F.expr("transform(spans, (s, i) -> array_max(transform(slice(spans, 1, i + 1), x -> x.end)))")
    met = rows.join(found, same_document(rows, found), "left").select("row", "spans", ends.alias("ends"))
    opens = F.expr("filter(sequence(0, size(spans) - 1), i -> i = 0 OR spans[i].start >= ends[i - 1])")
    met = met.withColumn("opens", opens).withColumn("text", text)
    kept = F.expr("transform(opens, i -> substring(text, int(IF(i = 0, 1, ends[i - 1] + 1)), int(spans[i].start - IF(i = 0, 0, ends[i - 1]))))")
    tail = F.expr("substring(text, int(ends[size(ends) - 1] + 1))")
    masked = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, mark), F.lit(mark), tail))
    met = met.select("row", masked.alias("text"))
    out = []
    for c in docs.columns:
        value = F.col("text") if c == text_col else F.col("row")[c]
        if c == "n_chars":
            value = F.when(F.col("text").eqNullSafe(text), value).otherwise(F.length("text").cast(dict(docs.dtypes)[c]))
        out.append(value.alias(c))
    return met.select(*out)
