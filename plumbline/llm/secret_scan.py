"""Secret scans judged by corpus-wide ownership.

Patterns give candidate spans. Each candidate's value is hashed, and hashes are aggregated over the
whole corpus by distinct texts, repositories and owners: a value that many owners publish is a copied
example, one that a single owner has is live-looking, in however many documents. Copies of one text
count once, for the owner and repository of the smallest id; what "many" is grows with the number of
owners. Base kinds are always reported; the method adds spans of provider formats (and of private-key
headers) whose value is owner-specific.

The scan is one pass in Arrow batches. Candidates (few, and small) are written once to the shared
folder; distinct counts are pre-aggregated in steps, so a value copied into a third of all
documents is combined before the shuffle, and the join back is an equi-join that may be split.

Null and empty texts have no spans; texts of any length are scanned whole. Spans are code points, end
exclusive. Every row has the spans of its own text, also if its id is null or repeated; repeated rows
get equal spans. Spans that start together are in the order of their kinds. An empty table gives an
empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import arrow_limits, drop_since, materialise, scratch_so_far, unused

KINDS = ("assign", "access", "hex")
#: The base patterns, and the least length of what counts.
_ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Formats of well-known providers, added by the method if owner-specific.
_ADDED = {
    "provider": re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,})"),
    "jwt": re.compile(r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    "key": re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,}"),
}
_TELL = re.compile(r"gh[pousr]_|github_pat_|xox[abprs]-|sk_live_|AIza|glpat-|eyJ|PRIVATE KEY")
#: A value is live-looking if at most so many owners have it, or that share of all owners.
MAX_OWNERS = 1
MAX_OWNER_SHARE = 0.001

SPANS = "array<struct<kind:string,start:bigint,end:bigint,value_hash:bigint>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_hash", pa.int64())]))


def _digest(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def scan(text: str | None) -> list[dict]:
    """Candidate spans of one text, by start and then kind."""
    if not text:
        return []
    found = [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    if _TELL.search(text):
        found += [(k, m.start(), m.end(), m[0]) for k, p in _ADDED.items() for m in p.finditer(text)]
    order = (*KINDS, *_ADDED)
    return [{"kind": k, "start": a, "end": b, "value_hash": _digest(v)} for k, a, b, v in sorted(found, key=lambda x: (x[1], order.index(x[0])))]


def candidates(text: Column) -> Column:
    """Candidate spans of a text column, as SPANS."""

    @F.arrow_udf(SPANS)
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([scan(x) for x in texts.to_pylist()], _SPAN)

    return found(text)


def ownership(found: DataFrame, repository: str, owner: str, text: str, order: str) -> DataFrame:
    """value_hash, texts, repositories, owners: distinct counts over all candidates; a text counts once, for the repository and owner that come first by order."""
    texts = found.groupBy("value_hash", text).agg(F.min(F.struct(order, F.col(owner).alias("owner"), F.col(repository).alias("repository"))).alias("first"))
    pairs = texts.groupBy("value_hash", "first.owner", "first.repository").agg(F.count("*").alias("texts"))
    by_owner = pairs.groupBy("value_hash", "owner").agg(F.sum("texts").alias("texts"), F.count("*").alias("repositories"))
    return by_owner.groupBy("value_hash").agg(F.sum("texts").alias("texts"), F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def _found(docs: DataFrame, id_col: str, text_col: str, repository_col: str | None, owner_col: str, always: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """row (a number of its own), id, key (hash of the text) of every row, and of those with spans row and spans."""
    arrow_limits(docs.sparkSession)
    repository, text = F.col(repository_col or id_col), F.col(text_col)
    scanned = docs.select(F.col(id_col).alias("id"), repository.alias("repository"), F.coalesce(F.col(owner_col), F.lit("")).alias("owner"), text.alias("text"), candidates(text).alias("spans"))
    scanned = scanned.select("id", "repository", "owner", F.xxhash64("text").alias("key"), F.when(F.size("spans") > 0, F.sha2("text", 256)).alias("digest"), "spans", F.monotonically_increasing_id().alias("row"))
    scanned = materialise(scanned, "secrets")
    spans = scanned.select("row", "id", "repository", "owner", "digest", F.inline("spans"))
    rank = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, *_ADDED)]), F.col("kind"))
    most = max(MAX_OWNERS, int(MAX_OWNER_SHARE * scanned.select("owner").distinct().count()))
    judged = spans.join(ownership(spans, "repository", "owner", "digest", "id"), "value_hash").withColumn("live", F.col("owners") <= most)
    kept = judged.where(F.col("kind").isin(*KINDS, *always) | F.col("live"))
    grouped = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end", "live", "owners"))).alias("spans"))
    return scanned.select("row", "id", "key"), grouped


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str | None = None, owner_col: str = "source", always: tuple[str, ...] = ()) -> DataFrame:
    """id_col and spans: array of (start, rank, kind, end, live, owners), every span of a base kind or of one in always, and each other one that is live-looking."""
    rows, spans = _found(docs, id_col, text_col, repository_col, owner_col, always)
    return rows.join(spans, "row", "left").select(F.col("id").alias(id_col), F.coalesce("spans", F.array()).alias("spans"))


def without_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, **options) -> DataFrame:
    """The rows of docs, secrets replaced by their kind in brackets; length_col (code points) follows a changed text."""
    before = scratch_so_far()
    rows, spans = _found(docs, id_col, text_col, options.get("repository_col"), options.get("owner_col", "source"), options.get("always", ()))
    # rows alike in id and text have the same spans
    found = rows.join(spans, "row").groupBy(F.col("id").alias("s_id"), F.col("key").alias("s_key")).agg(F.min_by("spans", "row").alias("s_spans"))
    found = materialise(found, "spans")
    drop_since(before, found)
    i, k = unused(docs, "s_id"), unused(docs, "s_key")
    found = found.select(F.col("s_id").alias(i), F.col("s_key").alias(k), F.col("s_spans").alias(s := unused(docs, "s_spans")))
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(text_col) == F.col(k)), "left")
    joined = joined.withColumn(text_col, F.when(F.col(s).isNotNull(), redacted(F.col(text_col), F.col(s))).otherwise(F.col(text_col)))
    if length_col is not None:
        joined = joined.withColumn(length_col, F.when(F.col(s).isNotNull(), F.length(text_col).cast("bigint")).otherwise(F.col(length_col)))
    return joined.select(*docs.columns)


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (overlaps united) replaced by its kind in brackets."""

    @F.arrow_udf("string")
    def replaced(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([redact(t, s) for t, s in zip(texts.to_pylist(), found.to_pylist(), strict=True)], pa.string())

    return replaced(text, spans)


def redact(text: str | None, spans: list[dict] | None) -> str | None:
    if not text or not spans:
        return text
    parts, at = [], 0
    for s in spans:
        if s["start"] >= at:
            parts += [text[at : s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join([*parts, text[at:]])
