"""Event XML to event records.

One pull parse (``from_xml``) reads all fields and tells whether the text is well-formed. It hands
over the event data as tags and plain text, which a pattern takes apart. Where that reading could
differ from a tree's (mixed or blank fields, other namespaces, another root, data that looks like tags),
a pattern over the raw text says so beforehand, and those few texts are read as trees in an Arrow step;
for all others that step gets and gives only NULLs.
"""

from __future__ import annotations

from datetime import datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gainsay.functions.text import strip

# Fixed value: namespace of event XML.
EVENT_NAMESPACE = "http://schemas.microsoft.com/win/2004/08/events/event"

MESSAGE_SEPARATOR = " | "

# The text is wrapped in one more element, so anything after the event's own end tag (a second
# event, stray text) shows up inside the wrapper rather than being ignored.
_WRAPPER = "gainsay-row"
_TEXT = "STRUCT<_VALUE: STRING>"
# Every part may occur more than once; the first one counts.
_SYSTEM = (
    f"STRUCT<Provider: ARRAY<STRUCT<_Name: STRING>>, EventID: ARRAY<{_TEXT}>, Level: ARRAY<{_TEXT}>, "
    f"TimeCreated: ARRAY<STRUCT<_SystemTime: STRING>>, EventRecordID: ARRAY<{_TEXT}>, "
    f"Computer: ARRAY<{_TEXT}>, Channel: ARRAY<{_TEXT}>>"
)
_DOCUMENT = (
    f"_VALUE STRING, Event ARRAY<STRUCT<System: ARRAY<{_SYSTEM}>, EventData: ARRAY<STRING>, "
    "UserData: ARRAY<STRING>>>, _corrupt STRING"
)
# Enough to tell whether a text can be used, and of which number it is.
_OUTLINE = (
    f"_VALUE STRING, Event ARRAY<STRUCT<System: ARRAY<STRUCT<EventRecordID: ARRAY<{_TEXT}>>>>>, _corrupt STRING"
)
_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt",
    "ignoreSurroundingSpaces": "false",
}

# Shape of the date-times accepted; Spark's own cast would also take a bare year.
_DATE_TIME = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?([+-]\d{2}:?\d{2})?Z?)?$"
)


# Where the parser's rendering of the data could be misread: a comment or CDATA section, an escaped
# "<", or a ">" in what may be an attribute value. Values are walked once and never back.
_MARK = "<!"
_ESCAPED = "&lt;|&#0*60;|&#[xX]0*3[cC];"
_QUOTED = r"=\s*(?:%s)" % "|".join(
    rf"{quote}[^{quote}<>&]*+(?:&(?!gt;|#)[^{quote}<>&]*+)*+(?:>|&)" for quote in ('"', "'")
)

# What else reads differently as a tree, which takes a field's leading text and goes by namespaces rather than
# names. Usual events begin as a plain Event of the namespace.
_ROOT = (
    r"(?s)^\s*(?:<\?xml.*?\?>)?\s*<Event\s(?:[^>]*\s)?xmlns\s*=\s*[\"']http://schemas\.microsoft\.com/win/2004/08/events/event[\"']"
)
# Fields with anything but text in them; a blank text, which is text to a tree and none to the parser; and shorter
# spellings of a time: without marks between the digits, or without minutes or seconds.
_IRREGULAR = (
    r"<(?:(?:EventID|Level|EventRecordID|Computer|Channel)(?:\s[^>]*[^/>])?>(?:[^<]*<(?!/)|\s+</)"
    r"|TimeCreated\s[^>]*SystemTime\s*=\s*[\"'](?=\d{4}-?\d{2}-?\d{2})(?!\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}[^\"']*)?[\"']))"
)
# Prefixes of the namespace, and parts that are put in one by themselves. Looked for only where a namespace is
# named more than once.
_NAMESPACES = (
    r"xmlns:[^\s=]+\s*=\s*[\"']http://schemas\.microsoft\.com/win/2004/08/events/event"
    r"|<(?:System|Provider|EventID|Level|TimeCreated|EventRecordID|Computer|Channel|EventData|UserData)\s(?:[^>]*\s)?xmlns\s*="
)

# A start tag and the text up to the next tag.
_TAG_AND_TEXT = "<[^/>][^>]*>([^<]*)"


_TREE = (
    "malformed boolean, system boolean, event_id string, level string, time string, provider string, "
    "number string, computer string, channel string, texts array<string>"
)


def _as_tree(texts: pd.Series) -> pd.DataFrame:
    """Most texts of a batch are NULL and cost nothing but their place."""
    places = texts.index[texts.notna()]
    read = pd.DataFrame([_read_tree(texts[i]) for i in places], index=places, columns=_TREE_COLUMNS, dtype=object)
    return read.reindex(texts.index).astype(object).where(lambda found: found.notna(), None) if len(places) < len(texts) else read


_TREE_COLUMNS = [part.split()[0] for part in _TREE.split(", ")]


def _spelled_out(time: str | None) -> str | None:
    """Any ISO spelling of a time in full; what is none stays as it is."""
    try:
        return time and datetime.fromisoformat(time).isoformat()
    except ValueError:
        return time


def _read_tree(text: str) -> list:
    """Raw field texts of one event: first children in the namespace, their leading text."""
    blank: list = [None] * (len(_TREE_COLUMNS) - 2)
    try:
        root = ElementTree.fromstring(text)
    except (ElementTree.ParseError, ValueError):
        return [True, None, *blank]

    def child(of: ElementTree.Element, tag: str) -> ElementTree.Element | None:
        return of.find(f"{{{EVENT_NAMESPACE}}}{tag}")

    system = child(root, "System")
    if system is None:
        return [False, False, *blank]

    def own(tag: str) -> str | None:
        found = child(system, tag)
        return None if found is None else found.text

    def attribute(tag: str, name: str) -> str | None:
        found = child(system, tag)
        return None if found is None else found.get(name)

    data = child(root, "EventData")
    data = child(root, "UserData") if data is None else data
    texts = [] if data is None else [element.text or "" for element in data.iter()]
    return [
        False, True, own("EventID"), own("Level"), _spelled_out(attribute("TimeCreated", "SystemTime")),
        attribute("Provider", "Name"), own("EventRecordID"), own("Computer"), own("Channel"), texts,
    ]


def event_timestamp(text: Column) -> Column:
    """The instant; a date-time without a zone is UTC, whatever the session's time zone."""
    cleaned = F.regexp_replace(text, ",", ".")
    zoned = (
        F.when(text.rlike(r"^[0-9-]{10}$"), F.concat(cleaned, F.lit("T00:00:00Z")))
        .when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), cleaned)
        .otherwise(F.concat(cleaned, F.lit("Z")))
    )
    return F.when(text.rlike(_DATE_TIME), zoned.try_cast("timestamp"))


def whole_number(text: Column) -> Column:
    return text.try_cast("bigint")


def _joined(texts: Column) -> Column:
    kept = F.filter(F.transform(texts, strip), lambda t: t != "")
    return F.nullif(F.array_join(kept, MESSAGE_SEPARATOR), F.lit(""))


def _parsed(rows: DataFrame, xml: str, document: str) -> DataFrame:
    """``rows`` with the parts of ``document`` that a pull parse gives, or a tree where it must, and ``reason``."""
    body = F.regexp_replace(F.col(xml), r"(?s)^\s*<\?xml.*?\?>", "")
    wrapped = F.concat(F.lit(f"<{_WRAPPER}>"), body, F.lit(f"</{_WRAPPER}>"))
    named = F.length(xml) - F.length(F.replace(F.col(xml), F.lit("xmlns"), F.lit("")))
    spaces = F.when(named > len("xmlns"), F.col(xml).rlike(_NAMESPACES)).otherwise(F.lit(False))
    escaped = F.contains(F.col(xml), F.lit("&")) & F.col(xml).rlike(_ESCAPED)
    ambiguous = F.contains(F.col(xml), F.lit(_MARK)) | escaped | F.col(xml).rlike(_QUOTED)
    unusual = ~F.col(xml).rlike(_ROOT) | F.col(xml).rlike(_IRREGULAR) | spaces | ambiguous
    # Unlike a plain column, an exploded one is not parsed again for each filter placed on it.
    parsed = (
        rows.withColumn("_unusual", F.coalesce(unusual, F.lit(False)))
        .withColumn("_tree", F.pandas_udf(_as_tree, _TREE)(F.when(F.col("_unusual"), F.col(xml))))
        .withColumn("_plain", F.when(~F.col("_unusual"), wrapped))
        .withColumn("_doc", F.explode(F.array(F.from_xml("_plain", document, _OPTIONS))))
    )
    doc, tree = F.col("_doc"), F.col("_tree")
    event = F.get(doc["Event"], 0)
    malformed = (
        F.col(xml).isNull()
        | doc["_corrupt"].isNotNull()
        | (F.coalesce(F.size(doc["Event"]), F.lit(0)) != 1)
        | (strip(F.coalesce(doc["_VALUE"], F.lit(""))) != "")
    )
    no_system = F.coalesce(F.size(event["System"]), F.lit(0)) == 0
    either = F.col("_unusual")
    reason = F.when(F.when(either, tree["malformed"]).otherwise(malformed), "malformed XML").when(
        F.when(either, ~tree["system"]).otherwise(no_system), "no System element"
    )
    return parsed.withColumn("reason", reason)


def _field(tag: str, in_tree: str) -> Column:
    system = F.get(F.get(F.col("_doc.Event"), 0)["System"], 0)
    return strip(F.when(F.col("_unusual"), F.col("_tree")[in_tree]).otherwise(F.get(system[tag], 0)["_VALUE"]))


def unusable(rows: DataFrame, xml: str = "raw_xml") -> DataFrame:
    """``embedded_record_number`` and ``reason`` of each XML row as ``decode`` has them, without any other field.

    The texts are walked whole, but only what these two need is made of them.
    """
    kept = [c for c in rows.columns if c != xml]
    number = whole_number(_field("EventRecordID", "number")).alias("embedded_record_number")
    return _parsed(rows, xml, _OUTLINE).select(*kept, number, "reason")


def decode(rows: DataFrame, xml: str = "raw_xml") -> DataFrame:
    """Event fields for each XML row, plus ``reason`` where the row cannot be used."""
    tree, either = F.col("_tree"), F.col("_unusual")
    event = F.get(F.col("_doc.Event"), 0)
    system = F.get(event["System"], 0)

    # UserData only counts where there is no EventData, not where that is empty.
    data = F.when(F.size(event["EventData"]) > 0, F.get(event["EventData"], 0)).otherwise(F.get(event["UserData"], 0))
    by_pattern = F.regexp_extract_all(
        F.concat(F.lit("<_>"), data), F.lit(_TAG_AND_TEXT), F.lit(1)
    )
    texts = F.when(
        F.col("reason").isNull(), F.when(either, tree["texts"]).otherwise(by_pattern)
    )
    time = F.when(either, tree["time"]).otherwise(F.get(system["TimeCreated"], 0)["_SystemTime"])
    provider = F.when(either, tree["provider"]).otherwise(F.get(system["Provider"], 0)["_Name"])

    kept = [c for c in rows.columns if c != xml]
    return (
        _parsed(rows, xml, _DOCUMENT)
        .withColumn("_texts", texts)
        .select(
            *kept,
            whole_number(_field("EventID", "event_id")).alias("event_id"),
            event_timestamp(time).alias("timestamp"),
            provider.alias("provider_name"),
            _field("Computer", "computer").alias("computer_name"),
            _field("Channel", "channel").alias("channel"),
            whole_number(_field("Level", "level")).alias("level"),
            _joined(F.col("_texts")).alias("message"),
            xml,
            whole_number(_field("EventRecordID", "number")).alias("embedded_record_number"),
            "reason",
        )
    )
