"""Personal data: fixed kinds, wider candidates, and boosted trees that choose among these.

High-recall generators propose overlapping spans: anything like an address, a network address, a card,
account or phone number. A candidate that a fixed kind confirms is an example of its kind, and so is the
same match written in a form that only the generators know (spelled out, national, grouped, the kin of
another standard), in the words around it. Candidates with valid check digits or an unmistakable form are
examples too. Other candidates are counter-examples, but for those after a cue such as "call": they may
well be personal data, and nobody has said so. On half of the candidates of all documents trees learn from the
form of the candidate and the words around it. A threshold per kind is calibrated on the other half, without the
confirmed matches themselves (nothing is to be chosen there), for the precision that is asked for. Nothing is
sampled. Matches of the fixed kinds are always reported; of the wider candidates those above their threshold
that touch no such match.
"""

from __future__ import annotations

import ipaddress
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gainsay.llm.boosting import QUANTILES, Boosted, boost_patterns, held_chances, patterns, threshold
from gainsay.llm.common import begin, slices, staged, texts
from gainsay.llm.spans import SPANS, Covered

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
LEAST_CHANCE = 0.5

# The kinds' patterns. A run of digits is tried at its start only and an address from its "@",
# which finds the same matches in one pass over the text.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_WIDER = {
    "email": re.compile(
        r"(?<!\S)[A-Za-z0-9._%+-]{1,64}(?: ?@ ?| ?[\[(] ?at ?[\])] ?)[A-Za-z0-9-]{1,63}(?:(?: ?\. ?| ?[\[(] ?dot ?[\])] ?)[A-Za-z0-9-]{1,63}){0,4}"
    ),
    "ip": re.compile(
        r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){2,4}(?![\w])|(?<![\w:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![\w:])"
    ),
    "card": re.compile(r"(?<![\w])(?:[A-Z]{2})?[0-9](?:[ -]?[0-9]){8,25}(?![\w])"),
    "phone": re.compile(r"(?<![\w])(?:\+|00)?[ (]{0,2}[0-9]{1,5}(?:[ ().\-/]{1,3}[0-9]{2,6}){1,6}(?![\w])"),
}
_CUE = re.compile(
    r"(?i)\b(?:e-?mail|mail|contact|kontakt|correo|courriel|phone|tel|telefon|tel[eé]fono|t[eé]l[eé]phone|call|mobile|fax|"
    r"card|karte|tarjeta|carte|visa|iban|account|konto|cuenta|compte|ssn|passport|address|adresse|server|host|ip)\b"
)
_LIST = re.compile(r"(?i)\b(?:version|chapter|page|section|figure|table|isbn|issn|doi|no|nr)\b")
_SPELLED = re.compile(r"[\[(] ?at ?[\])].*(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z]{2,}\Z")
_IBAN = re.compile(r"([A-Z]{2})([0-9]{13,})")
# Countries whose account numbers are digits, and how many follow the check digits.
_IBAN_DIGITS = (("DE", 18), ("ES", 20), ("AT", 16), ("PL", 24), ("BE", 12), ("PT", 21))
_NEAR = 32
FEATURES = 21

_FOUND = "doc_id bigint, " + SPANS + ",chance:double>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(map(int, reversed(digits))):
        if i % 2:
            digit *= 2
            digit -= 9 * (digit > 9)
        total += digit
    return total % 10 == 0


def fixed(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed kinds, leftmost and not overlapping within a kind."""
    found, after = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append(("email", start, m.end()))
            after = m.end()
        at = text.find("@", max(at + 1, after))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def proposed(text: str) -> list[tuple[str, int, int]]:
    """Candidates of all generators; they may overlap."""
    return [(kind, m.start(), m.end()) for kind, pattern in _WIDER.items() for m in pattern.finditer(text)]


def _iban_rest(country: str, digits: str) -> int:
    """The rest modulo 97 of an account number, check digits first."""
    moved = "".join(str(int(c, 36)) for c in country) + digits[:2]
    return int(digits[2:] + moved) % 97


def valid(kind: str, body: str) -> bool:
    """Whether a candidate is beyond doubt by itself: check digits of an IBAN, a whole IPv6 address, a spelled-out "at"."""
    if kind == "card":
        m = _IBAN.fullmatch(re.sub("[ -]", "", body))
        return bool(m) and _iban_rest(*m.groups()) == 1
    if kind == "ip" and ":" in body:
        try:
            return bool(ipaddress.IPv6Address(body))
        except ValueError:
            return False
    return kind == "email" and bool(_SPELLED.search(body))


def rewritten(kind: str, body: str, choice: int) -> str:
    """A confirmed match in one of the forms that only the wider generators propose."""
    if kind == "email":
        at, dot = ((" (at) ", " (dot) "), (" [at] ", " [dot] "), (" @ ", " . "), ("(at)", "."))[choice % 4]
        local, domain = body.split("@", 1)
        return local + at + domain.replace(".", dot)
    digits = "".join(c for c in body if c in "0123456789")
    if kind == "phone":
        a, b, c = digits[-10:-7], digits[-7:-4], digits[-4:]
        return (body[1:], f"00{body[1:]}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"0{a}/{b}{c}")[choice % 6]
    if kind == "ip":
        groups = [f"{(choice * (2 * i + 1) >> i) & 0xFFFF:x}" for i in range(8)]
        return (":".join(groups), f"2001:db8::{':'.join(groups[:3])}", f"fe80::{':'.join(groups[:4])}")[choice % 3]
    country, number = _IBAN_DIGITS[choice % len(_IBAN_DIGITS)]
    account = (digits * 2)[:number]
    whole = f"{country}{98 - _iban_rest(country, '00' + account):02d}{account}"
    return whole if choice // 8 % 2 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))


def examples(text: str) -> list[tuple[int, str, int, int, list[float]]]:
    """Start, kind, label, whether a chooser could meet it (it touches no confirmed match) and features of all examples."""
    candidates = proposed(text)
    known = fixed(text) if candidates else []
    rows = []
    # Matches of one kind do not overlap: the first that begins in a candidate is the first to end.
    own = {kind: sorted((s, e) for k, s, e in known if k == kind) for kind in KINDS}
    taken = Covered((s, e) for _, s, e in known)
    for kind, start, end in candidates:
        place = bisect_left(own[kind], (start, start))
        if place < len(own[kind]) and own[kind][place][1] <= end:
            rows.append((start, kind, 1, 0, described(text, kind, start, end)))
        elif not taken.touches(start, end):
            right = valid(kind, text[start:end])
            before = text[max(0, start - _NEAR) : start]
            if right or not _CUE.search(before) or _LIST.search(before):
                rows.append((start, kind, int(right), 1, described(text, kind, start, end)))
    for kind, start, end in known:
        form = rewritten(kind, text[start:end], zlib.crc32(f"{start} {text[start:end]}".encode()))
        at = min(start, 4 * _NEAR)
        near = text[start - at : start] + form + text[end : end + 4 * _NEAR]
        rows += [
            (start, kind, 1, 1, described(near, kind, m.start(), m.end()))
            for m in _WIDER[kind].finditer(near) if m.start() <= at and at + len(form) <= m.end()
        ]
    return rows


def described(text: str, kind: str, start: int, end: int) -> list[float]:
    """Form and context of a candidate as numbers."""
    body = text[start:end]
    before, after = text[max(0, start - _NEAR) : start], text[end : end + _NEAR]
    digits = "".join(c for c in body if c in "0123456789")
    groups = re.split(r"[^0-9A-Za-z]+", body.strip("+()"))
    last = before.rstrip()[-1:]
    return [
        KINDS.index(kind), len(body), len(digits), sum(c.isalpha() for c in body), len(groups),
        max(map(len, groups)), min(map(len, groups)), body.startswith("+"), "@" in body,
        body.count("."), body.count("-"), body.count(" "), "(" in body, len(set(digits)),
        int(digits[:1] or -1), bool(digits) and luhn(digits),
        max((int(g[-6:]) for g in groups if g.isdecimal() and g.isascii()), default=0),
        bool(_CUE.search(before)) + 2 * bool(_LIST.search(before)),
        (last == ":") + 2 * (last in ("(", "[")) + 4 * last.isalnum(), after[:1].isalnum(), valid(kind, body),
    ]


@dataclass
class Chooser:
    """Trees and the threshold of each kind; without trees nothing is chosen."""

    trees: Boosted | None
    thresholds: dict[str, float]

    def choose(self, text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
        """Candidates above their threshold that touch nothing taken, the likeliest first, none touching another."""
        if self.trees is None:
            return []
        known = Covered((start, end) for _, start, end in taken)
        free = [c for c in proposed(text) if not known.touches(c[1], c[2])]
        if not free:
            return []
        chances = self.trees.chance(np.array([described(text, *c) for c in free], dtype=float)).tolist()
        chosen: list[tuple[str, int, int, float]] = []
        held = Covered()
        for chance, (kind, start, end) in sorted(zip(chances, free), key=lambda x: (-x[0], x[1][1], x[1][0])):
            if chance >= self.thresholds[kind] and not held.touches(start, end):
                held.add(start, end)
                chosen.append((kind, start, end, chance))
        return chosen


def learn(docs: DataFrame, *, precision: float = PRECISION) -> Chooser:
    """Fit on the candidates of all documents: trees on one half of these, thresholds on the other, by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("pii")
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    rows += [(doc, *example) for example in examples(text)]
                columns = list(zip(*rows)) or [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=k) for c, k in zip(columns, kinds)],
                    names=["doc_id", "start", "kind", "label", "free", "features"],
                )

    schema = "doc_id bigint, start bigint, kind string, label int, free int, features array<double>"
    half = F.xxhash64("doc_id", "start", "kind") % 2 == 0
    rows = staged(
        docs.select("doc_id", "text").mapInArrow(run, schema).select(
            "kind", "label", half.alias("train"), (~half & (F.col("free") == 1)).alias("held"), "features"
        ),
        "pii",
    )
    trained = F.when(F.col("train"), F.col("label"))
    # Exact: all features are small whole numbers, so a quantile keeps at most 10^6 counts.
    numbers = rows.agg(
        F.count_distinct("label").alias("classes"), F.count(trained).alias("total"), F.sum(trained).alias("positive"),
        *[
            F.percentile(F.when(F.col("train"), F.get("features", F.lit(j))), QUANTILES.tolist()).alias(f"at_{j}")
            for j in range(FEATURES)
        ],
    ).first()
    if numbers["classes"] < 2 or not numbers["total"]:
        return Chooser(None, {})
    edges = [np.unique(numbers[f"at_{j}"]) for j in range(FEATURES)]
    counted = staged(patterns(rows, edges), "pii-patterns")
    trees = boost_patterns(counted, edges, numbers["total"], numbers["positive"])
    held = held_chances(counted, trees).toPandas()
    cuts = {}
    for kind in KINDS:
        own = held[held["kind"] == kind]
        chance, count = own["chance"].to_numpy(dtype=float), own[["held_0", "held_1"]].to_numpy(dtype=np.int64)
        labels, weights = np.repeat([0, 1], len(own)), count.T.reshape(-1)
        cuts[kind] = threshold(np.tile(chance, 2), labels, precision, LEAST_CHANCE, weights)
    return Chooser(trees, cuts)


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, base, chance) of every row of ``docs``.

    Kinds are those of ``KINDS`` for their own matches and the same with "_like" for chosen candidates.
    Null and empty texts have no spans, repeated rows are searched each, an empty table gives no rows.
    """
    rows = texts(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    chooser = learn(rows, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("pii")
        kind = pa.list_(pa.struct([
            ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()),
            ("chance", pa.float64()),
        ]))
        for batch in batches:
            for part in slices(batch, "text"):
                found = [spans_of(text, chooser) for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(found, type=kind)], names=["doc_id", "spans"]
                )

    return rows.mapInArrow(run, _FOUND)


def spans_of(text: str, chooser: Chooser) -> list[dict]:
    known = fixed(text)
    chosen = chooser.choose(text, known)
    return [
        {"kind": k, "start": s, "end": e, "base": True, "chance": 1.0} for k, s, e in known
    ] + [{"kind": f"{k}_like", "start": s, "end": e, "base": False, "chance": c} for k, s, e, c in chosen]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; spans that touch are one, named after the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with the found spans of ``text`` replaced; all other columns and null texts as they are."""
    rows = texts(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    chooser = learn(rows, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("pii")
        for batch in batches:
            place = batch.schema.get_field_index(text)
            for part in slices(batch, text):
                column = [
                    t and redacted(t, [(s["kind"], s["start"], s["end"]) for s in spans_of(t, chooser)])
                    for t in part.column(place).to_pylist()
                ]
                yield part.set_column(place, batch.schema.field(place), pa.array(column, type=pa.string()))

    return docs.withColumn(text, F.col(text).cast("string")).mapInArrow(run, docs.schema)
