"""Secrets, and how many owners share them.

Every text is searched for the fixed kinds of secrets and, with wider patterns, for other strings that
may be credentials. Each found value is hashed; over the whole corpus a hash is counted by distinct
owners, distinct repositories and occurrences. A value that many owners have is a copied example; one
that looks live and stays with one or two owners is theirs. Of the wider candidates only the latter
are reported; matches of the fixed kinds are always reported, with what the counts say of them.

Only hashes leave the text. The counts are combined before every shuffle, so a value that half the
corpus holds is one row per task.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gainsay.llm.common import begin, slices, staged
from gainsay.llm.spans import SPANS, Covered, Holding

KINDS = ("assign", "access", "hex")
OWNED = "owned"
MANY_OWNERS = 3
LEAST_ENTROPY = 3.0

# The kinds' patterns and their least lengths. The runs of "access" and "hex" are maximal, so
# asking for the length in the pattern finds the same matches.
_ASSIGN = re.compile(
    r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_LEAST_VALUE = 6

# Private keys: what lies between the header and the END line, else the lines of key text after the header. Line
# breaks may be escaped. Every part stops at the next five dashes, so all headers together are one pass.
_BREAK = r"""(?:\s|\\+[nrt]|["'`,#>|*])"""
_KEY = re.compile(
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:"
    r"((?:[^-]|-(?!----))*+)-----END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|((?:{_BREAK}*+[A-Z][A-Za-z]*-[A-Z][A-Za-z]*:(?:[^\n\\-]|-(?!----))*+)*+(?:{_BREAK}*+[A-Za-z0-9+/]{{20,}}+={{0,2}})++)"
    r")"
)
_KEY_TEXT = re.compile(r"[+/]*[A-Za-z0-9][A-Za-z0-9+/]*")
# Lines of keys are long, words are not.
_LEAST_KEY_RUN = 8

# Wider candidates: published prefixes of service tokens, passwords in addresses, and any long run of letters
# and digits.
_WIDER = (
    re.compile(r"\b(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|ya29\.|eyJ)[A-Za-z0-9_.-]{16,}"),
    re.compile(r"(?<=://)[^\s:/@]{1,64}:([^\s:/@]{6,64})@"),
    re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"),
)
_PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|0000|1234|abcd|test")
# Longer values hold such a word by chance; there it takes a share of the value.
_LONG, _PLACEHOLDER_SHARE = 200, 0.05

_FOUND = (
    "row_id bigint, doc_id bigint, owner string, repository string, "
    + SPANS + ",value:string,live:boolean>>"
)


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def placeholder(value: str) -> bool:
    """Whether the value is made of placeholder words, or short and has one."""
    words = sum(len(m.group()) for m in _PLACEHOLDER.finditer(value))
    return words > (_PLACEHOLDER_SHARE * len(value) if len(value) > _LONG else 0)


def looks_live(value: str) -> bool:
    """Random enough for a credential: digits and letters mixed, no placeholder words."""
    return (
        len(value) >= 8
        and any(c.isdigit() for c in value)
        and any(c.isalpha() for c in value)
        and not placeholder(value)
        and entropy(value) >= LEAST_ENTROPY
    )


def key_blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and key text of the private keys in a text; the same key has the same text however it is wrapped."""
    for m in _KEY.finditer(text):
        parts = _KEY_TEXT.findall(re.sub(r"\\+[nrt]", " ", m.group(m.lastindex)))
        body = "".join(parts)
        if len(body) >= _LEAST_KEY_RUN * len(parts) and looks_live(body):
            yield m.start(), m.end(), body


def find(text: str) -> list[tuple[str, int, int, bool, str]]:
    """Spans of the fixed kinds, private keys, and wider candidates that touch neither, with their values."""
    found = []
    for m in _ASSIGN.finditer(text):
        if len(m.group(2)) >= _LEAST_VALUE:
            found.append(("assign", m.start(), m.end(), True, m.group(2)))
    for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
        found += [(kind, m.start(), m.end(), True, m.group()) for m in pattern.finditer(text)]
    # A block may hold or begin in a fixed match ("secret: -----BEGIN"), which says nothing of the key.
    known = Holding((start, end) for _, start, end, _, _ in found)
    found += [(OWNED, start, end, False, body) for start, end, body in key_blocks(text) if not known.holds(start, end)]
    for pattern in _WIDER:
        # Matches of one pattern never overlap, so only those of patterns before it are in the way.
        matches = list(pattern.finditer(text))
        taken = Covered((start, end) for _, start, end, _, _ in found) if matches else Covered()
        for m in matches:
            value = m.group(m.lastindex or 0)
            if not taken.touches(m.start(), m.end()) and looks_live(value):
                found.append((OWNED, m.start(), m.end(), False, value))
    return found


def candidates(
    docs: DataFrame,
    *,
    owner: str = "source",
    repository: Sequence[str] = ("source", "lang"),
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: its owner and repository, and the spans with the hash of their value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("secrets")
        row = TaskContext.get().partitionId() << 36
        names = ["row_id", "doc_id", "owner", "repository", "spans"]
        kind = pa.list_(pa.struct([
            ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()),
            ("value", pa.string()), ("live", pa.bool_()),
        ]))
        for batch in batches:
            for part in slices(batch, "text"):
                spans = [
                    [
                        {
                            "kind": k, "start": start, "end": end, "base": base,
                            "value": hashlib.sha256(value.encode()).hexdigest()[:32],
                            "live": looks_live(value),
                        }
                        for k, start, end, base, value in find(plain)
                    ]
                    for plain in part.column("text").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + part.num_rows)), part.column("doc_id"),
                    part.column("owner"), part.column("repository"), pa.array(spans, type=kind),
                ], names=names)
                row += part.num_rows

    plain = F.coalesce(F.col(text), F.lit(""))
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (owner, *repository)]
    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), names[0].alias("owner"),
        F.concat_ws("/", *names[1:]).alias("repository"), plain.alias("text"),
    ).mapInArrow(run, _FOUND)


def ownership(found: DataFrame) -> DataFrame:
    """``value`` (a hash) with its numbers of ``owners``, ``repositories`` and ``occurrences``."""
    each = found.select("owner", "repository", F.explode("spans.value").alias("value"))
    places = each.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owners = places.groupBy("value", "owner").agg(
        F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n")
    )
    return owners.groupBy("value").agg(
        F.count(F.lit(1)).alias("owners"),
        F.sum("repositories").alias("repositories"),
        F.sum("n").alias("occurrences"),
    )


def scan(docs: DataFrame, *, many_owners: int = MANY_OWNERS, **columns) -> DataFrame:
    """``doc_id`` and ``spans`` of every row of ``docs``.

    A span has kind, start, end, base, verdict, owners, repositories and occurrences. The verdict is
    "copied" for values that ``many_owners`` or more have, else "owned" for those that look live,
    else "unlikely". Spans with base false are wider candidates and always "owned". Null and empty
    texts have no spans; a missing owner or repository counts as one of the name "". Repeated rows
    are scanned each and add to the occurrences. An empty table gives no rows.
    """
    found = staged(candidates(docs, **columns), "secrets")
    counts = ownership(found)
    verdict = (
        F.when(F.col("owners") >= many_owners, "copied").when(F.col("s.live"), OWNED).otherwise("unlikely")
    )
    judged = (
        found.select("row_id", F.explode("spans").alias("s"))
        .withColumn("value", F.col("s.value"))
        .join(counts, "value")
        .withColumn("verdict", verdict)
        .filter(F.col("s.base") | (F.col("verdict") == OWNED))
        .select("row_id", F.struct(
            "s.kind", "s.start", "s.end", "s.base", "verdict", "owners", "repositories", "occurrences",
        ).alias("s"))
        .groupBy("row_id")
        .agg(F.collect_list("s").alias("spans"))
    )
    return found.select("row_id", "doc_id").join(judged, "row_id", "left").select(
        "doc_id", F.coalesce("spans", F.array().cast(judged.schema["spans"].dataType)).alias("spans")
    )
