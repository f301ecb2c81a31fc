"""Secrets in documents, told from copied examples by how many owners hold the same value.

1. A task reads whole texts and finds candidates: values behind a name such as ``token``, access
   key ids, hexadecimal runs, and opaque strings that mix cases and digits. What leaves the task
   are places and 128-bit hashes of the values; no secret is written anywhere.
2. Over the corpus, each hash is counted by its distinct owners and distinct repositories. A value
   that many owners hold was copied from documentation or a template; one that stays with few
   owners looks like a live credential.
3. Opaque strings that look live are added to the spans. Spans of the first three kinds stay
   whatever the count says; the count tells how many of them look live.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, let_go, materialize, sliced, workdir

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
# a run that is too short at its first start is too short at any later one, so the least length may stand in the pattern
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Kinds in the order in which spans of one start are listed; the last is what the counts add.
KINDS = ("assign", "access", "hex", "opaque")
LEAST_VALUE = 8
#: Bits a character that an opaque string has at least.
LEAST_ENTROPY = 3.5

Span = tuple[int, int, int, bytes]  # start, number of the kind, end, hash of the value


def _hash(value: str) -> bytes:
    return hashlib.blake2b(value.encode(), digest_size=16).digest()


def _entropy(value: str) -> float:
    return -sum(n / len(value) * log2(n / len(value)) for n in Counter(value).values())


def base_spans(text: str) -> list[Span]:
    """Matches of the three base patterns, leftmost and non-overlapping for each kind, whole matches as spans."""
    out = [(m.start(), 0, m.end(), _hash(m[2])) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    for kind, pattern in ((1, _ACCESS), (2, _HEX)):
        out += [(m.start(), kind, m.end(), _hash(m[0])) for m in pattern.finditer(text)]
    return sorted(out)


def opaque_spans(text: str, base: list[Span]) -> list[Span]:
    """Strings of upper and lower case letters and digits and of enough entropy that touch no base span."""
    out, k = [], 0
    ends = sorted((s[0], s[2]) for s in base)
    for m in _OPAQUE.finditer(text):
        while k < len(ends) and ends[k][1] <= m.start():
            k += 1
        if k < len(ends) and ends[k][0] < m.end():
            continue
        v = m[0]
        if any(c.isupper() for c in v) and any(c.islower() for c in v) and any(c.isdigit() for c in v) and _entropy(v) >= LEAST_ENTROPY:
            out.append((m.start(), 3, m.end(), _hash(v)))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in sorted(spans))


_SPANS = "array<struct<start: long, kind: int, end: long, value: binary>>"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    let_go()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.binary())]))
    for batch, texts in sliced(batches, "text"):
        counts, digests, spans = [], [], []
        for text in texts:
            base = base_spans(text)
            counts.append([sum(s[1] == k for s in base) for k in range(3)])
            digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
            spans.append([dict(zip(("start", "kind", "end", "value"), s)) for s in base + opaque_spans(text, base)])
        columns = [batch.column(c) for c in range(4)]
        columns += [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string()), pa.array(spans, kind)], names=["row", "id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def ownership(spans: DataFrame) -> DataFrame:
    """value, n, owners, repositories: rows and distinct owners and repositories of each value; null ones don't count."""
    return spans.groupBy("value").agg(F.count("*").alias("n"), F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))


def find_secrets(docs: DataFrame, owner_col: str, repository_col: str, max_owners: int = 2, max_repositories: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example for every row of ``docs``.

    ``spans`` lists kind:start:end (code points, end exclusive) of all spans by start, then kind as
    in ``KINDS``, comma-joined; ``base_sha256`` is the lowercase hex SHA-256 of the same list of the
    base spans alone. A value that at most ``max_owners`` owners and ``max_repositories`` repositories hold looks
    live, others are examples; opaque strings are spans only where they look live. ``n_live`` counts the spans that look
    live, ``n_example`` the base spans and opaque strings that don't.

    Null and empty texts have no spans. Values of rows without an owner count for no owner, so they look
    live where nobody else holds them. Rows that repeat, or share an id, are answered one by one and count once for
    their owner and repository. Null ids are kept; other columns are not read; an empty table gives no rows.
    """
    spark, folder = docs.sparkSession, workdir(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    whole = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), docs[owner_col].cast("string").alias("owner"), docs[repository_col].cast("string").alias("repository"), docs[text_col].alias("text"))
    rows = whole.mapInArrow(_scanned, f"row long, id {kind}, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, spans {_SPANS}")
    rows = materialize(rows, f"{folder}/rows")
    spans = rows.select("row", "owner", "repository", F.inline("spans"))
    counted = materialize(ownership(spans), f"{folder}/ownership")
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    held = join_hot(spans.select("row", "start", "kind", "end", "value"), counted.select("value", live.alias("live")), ["value"], "row", counts=counted)
    shown = (F.col("kind") < 3) | F.col("live")
    each = held.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(shown, F.struct("start", "kind", "end")))).alias("shown"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"),
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform("shown", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    columns = lambda spans, n_live, n_example: [F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), n_live.alias("n_live"), n_example.alias("n_example")]
    some = rows.filter(F.size("spans") > 0).drop("spans").join(each, "row").select(*columns(text, F.col("n_live"), F.col("n_example")))
    none = rows.filter(F.size("spans") == 0).select(*columns(F.lit(""), F.lit(0).cast("long"), F.lit(0).cast("long")))
    return some.unionAll(none)
