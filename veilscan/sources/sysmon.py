"""System log events from their XML."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Elements ``<Data Name="...">`` whose text is read.
DATA = ("TargetFilename", "CommandLine", "Image", "ProcessId", "User")
_FIELDS = ("SystemTime", "EventID", *DATA)
#: Events that a worker turns into Python objects at once.
SLICE = 1_000


def read_event(xml: str | None) -> list[str | None]:
    """SystemTime of ``<TimeCreated>``, text of ``<EventID>`` and of each ``<Data>``, None where there is none: of several
    the first, at any depth, whatever the prefixes.  One pass of the text; what is no XML is an error."""
    found: dict[str, str | list[str]] = {}
    opened: list[list[str] | None] = []  # what collects the text, for each open element

    def start(tag: str, attributes: dict[str, str]) -> None:
        name = tag.rpartition(":")[2]
        own = None
        if name == "Data":
            field = attributes.get("Name")
            if field in DATA and field not in found:
                own = found[field] = []
        elif name == "EventID":
            if name not in found:
                own = found[name] = []
        elif name == "TimeCreated" and "SystemTime" in attributes:
            found.setdefault("SystemTime", attributes["SystemTime"])
        opened.append(own)

    def text(data: str) -> None:
        for own in opened:
            if own is not None:
                own.append(data)

    if xml:
        parser = expat.ParserCreate()
        parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda _: opened.pop(), text
        parser.Parse(xml, True)
    return [x if x is None or isinstance(x, str) else "".join(x) for x in map(found.get, _FIELDS)]


def _read_events(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            rows = [read_event(xml) for xml in batch.column(0).slice(at, SLICE).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=list(_FIELDS))


def system_time(text: Column) -> Column:
    """Times with at least six digits of a second (cut to six) or with none; others are not understood."""
    fine = F.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}"), F.try_to_timestamp(F.substring(text, 1, 26), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    return fine.when(text.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def parse_events(events: DataFrame, xml: str = "xml") -> DataFrame:
    """One log row for each ``<Event>`` in a column of XML, which is parsed once; the time is tested behind that, on all cores."""
    read = events.select(F.col(xml)).mapInArrow(_read_events, ", ".join(f"{name} string" for name in _FIELDS))
    told = lambda name: F.when(F.col(name) != "", F.col(name))
    return read.select(
        system_time(F.col("SystemTime")).alias("system_time"),
        F.col("EventID").try_cast("int").alias("event_id"),
        told("TargetFilename").alias("target_filename"),
        told("CommandLine").alias("command_line"),
        told("Image").alias("image"),
        told("ProcessId").try_cast("int").alias("process_id"),
        told("User").alias("user"),
    ).where("system_time is not null")
