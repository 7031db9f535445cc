"""Reading and shaping source rows: formats, paths, envelopes, declared types."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.builtins import Typed, conversion

DELIMITERS = ",\t;|"


def sniff_delimiter(header: str) -> str:
    """The delimiter that stands most often outside quotes in a header line; a comma if none does."""
    bare = re.sub(r'"[^"]*"', "", header)
    return max(DELIMITERS, key=lambda d: (bare.count(d), -DELIMITERS.index(d))) if any(d in bare for d in DELIMITERS) else ","


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Quoted CSV with a header.  Short rows are padded with empty strings, long ones cut."""
    head = spark.read.text(path).first()
    options = {"sep": sniff_delimiter(head[0] if head else ""), "header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    df = spark.read.options(**options).csv(path)
    df = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
    return coerce(df, {f.name: f.dataType.simpleString() for f in schema}) if schema else df


def read_json(spark: SparkSession, path: str, array: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """A value per line, or one document whose array is the items."""
    reader = spark.read.option("multiLine", array)
    return (reader.schema(schema) if schema else reader).json(path)


KINDS = {"string": "string", "bigint": "long", "long": "long", "double": "double", "boolean": "bool", "bool": "bool", "timestamp": "timestamp"}


def coerce(df: DataFrame, declared: dict[str, str], policy: str = "null") -> DataFrame:
    """Declared kinds; a value that doesn't convert is null, drops its row or rejects the batch."""
    names = {"bigint": "long", "int": "long", "boolean": "bool", "float": "double"}
    dtypes = dict(df.dtypes)
    out, bad = df, F.lit(False)
    for name, kind in declared.items():
        if name not in dtypes:
            out = out.withColumn(name, F.lit(None))
            continue
        own = names.get(dtypes[name], dtypes[name])
        x = conversion(KINDS[kind], Typed(F.col(f"`{name}`"), own)).col
        bad = bad | (F.col(f"`{name}`").isNotNull() & x.isNull())
        out = out.withColumn(f"_new_{name}", x)
    out = out.withColumn("_bad", bad)
    if policy == "reject" and not out.filter("_bad").isEmpty():
        raise ValueError("the batch holds values that aren't of their declared kinds")
    if policy == "drop":
        out = out.filter("not _bad")
    found = [n for n in declared if n in dtypes]
    return out.select(*[F.col(f"_new_{c}").alias(c) if c in found else F.col(f"`{c}`") for c in [*df.columns, *[n for n in declared if n not in dtypes]]])


STEP = re.compile(r"\.([A-Za-z_]\w*)|\['([^']*)'\]|\[(\d+)\]|\[(\*)\]")


def extract(df: DataFrame, json_col: str, mapping: dict[str, str], items: str = "$") -> DataFrame:
    """Fields of JSON text by paths of ``.name``, ``['name']``, ``[n]`` and, for the items, ``[*]``; no match is null."""
    for path in [items, *mapping.values()]:
        if not path.startswith("$") or STEP.sub("", path[1:]):
            raise ValueError(f"unsupported path {path}")
    root = F.col(json_col)
    if items.endswith("[*]"):
        base = items[:-3]
        listed = df.withColumn("_items", root if base == "$" else F.get_json_object(root, base))
        df = listed.withColumn("_item", F.explode(F.expr("transform(from_json(`_items`, 'array<variant>'), x -> to_json(x))"))).drop("_items")
        root = F.col("_item")
    elif items != "$":
        root = F.get_json_object(root, items)
    return df.select(*[F.get_json_object(root, p).alias(n) for n, p in mapping.items()])


def unwrap_cdc(df: DataFrame, json_col: str, fields: dict[str, str]) -> DataFrame:
    """A change envelope to rows: the after image, or for deletes the before image, with ``_op``, ``_weight`` and ``_ts``.

    An outer ``payload`` is looked through; tombstones and deletes without a before image are skipped."""
    raw = F.col(json_col)
    body = F.coalesce(F.get_json_object(raw, "$.payload"), raw)
    op = F.get_json_object(body, "$.op")
    image = F.when(op == "d", F.get_json_object(body, "$.before")).otherwise(F.get_json_object(body, "$.after"))
    staged = df.select(op.alias("_op"), image.alias("_image"), F.get_json_object(body, "$.ts_ms").try_cast("bigint").alias("_ts"))
    kept = staged.filter(F.col("_op").isin("c", "r", "u", "d") & F.col("_image").isNotNull())
    cols = [conversion(KINDS[k], Typed(F.get_json_object("_image", f"$.{n}"), "json")).col.alias(n) if k != "string" else F.get_json_object("_image", f"$.{n}").alias(n) for n, k in fields.items()]
    return kept.select(*cols, "_op", F.when(F.col("_op") == "d", -1).otherwise(1).cast("bigint").alias("_weight"), "_ts")


def dedup(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first arrival of each key.  Unlike a window of keys it is exact over the batch."""
    best = df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(F.min_by(F.struct(*df.columns), F.col("_seq")).alias("r"))
    return best.select("r.*")


SOH = "\x01"
# Fixed values of the tag=value format: the tags that count a group's entries and the group's name,
# the tags that give the length of the tag after them, and the tags that only end a message.
GROUPS = {
    "73": "Orders", "78": "Allocs", "136": "MiscFees", "146": "RelatedSym", "215": "RoutingIDs", "232": "Stipulations",
    "267": "MDEntryTypes", "268": "MDEntries", "295": "QuoteEntries", "296": "QuoteSets", "382": "ContraBrokers", "384": "MsgTypes",
    "386": "TradingSessions", "428": "Strikes", "453": "PartyIDs", "454": "SecurityAltID", "518": "ContAmts", "534": "AffectedOrders",
    "539": "NestedPartyIDs", "552": "Sides", "555": "Legs", "683": "LegStipulations", "702": "Positions", "711": "Underlyings",
    "768": "TrdRegTimestamps", "862": "Capacities", "864": "Events", "870": "InstrAttrib", "957": "StrategyParameters",
}
LENGTHS = {"90": "91", "95": "96", "212": "213", "350": "351", "354": "355", "358": "359", "360": "361", "362": "363", "364": "365"}
TRAILER = ("93", "89", "10")


def fix_messages(line: str) -> list[str]:
    """The messages in a line of a log; what stands before the first is skipped."""
    first = re.split(r"\b10=", line, maxsplit=1)[0]
    delimiter = max((SOH, "|", "^"), key=first.count)
    starts = [m.start() for m in re.finditer(rf"(?:(?<=^)|(?<={re.escape(delimiter)})|(?<=[\r\n]))8=", line)]
    if not starts and line.find("8=") >= 0:
        starts = [line.find("8=")]
    return [line[a:b].rstrip("\r\n ") for a, b in zip(starts, [*starts[1:], len(line)])]


def fix_fields(message: str) -> list[tuple[str, str]] | None:
    """Tags and values in order; None if a field is malformed.  A value whose length the tag before it
    gives may hold delimiters."""
    delimiter = max((SOH, "|", "^"), key=re.split(r"\b10=", message, maxsplit=1)[0].count)
    fields: list[tuple[str, str]] = []
    at = 0
    while at < len(message):
        tag, found, _ = message[at:].partition("=")
        if message[at] == delimiter:
            at += 1
            continue
        if not found or not re.fullmatch("[0-9]*[1-9][0-9]*", tag):
            return None
        start = at + len(tag) + 1
        end = message.find(delimiter, start)
        if fields and LENGTHS.get(fields[-1][0]) == tag and re.fullmatch("[0-9]+", fields[-1][1]):
            end = min(start + int(fields[-1][1]), len(message))
        end = len(message) if end < 0 else end
        fields.append((tag, message[start:end]))
        at = end + 1 if message[end : end + 1] == delimiter else end
    return fields


class _Groups:
    """Nests repeating groups without a dictionary of messages.

    The tag after a count heads each entry.  The first entry goes on to a tag that it has already, so
    the last group of a level may take in what follows it; its tags bound the other entries.  The trailer ends any group, and a count that is too small ends it early."""

    def __init__(self, fields: list[tuple[str, str]]):
        self.fields, self.at = fields, 0

    def next_tag(self) -> str | None:
        return self.fields[self.at][0] if self.at < len(self.fields) else None

    def take(self, into: dict) -> None:
        tag, value = self.fields[self.at]
        self.at += 1
        if tag in GROUPS and re.fullmatch("[0-9]+", value):
            into[GROUPS[tag]] = self.group(int(value))
        else:
            into[tag] = value

    def group(self, count: int) -> list[dict]:
        entries: list[dict] = []
        head, known = self.next_tag(), None
        while len(entries) < count and head not in (None, *TRAILER) and self.next_tag() == head:
            entry, seen = {}, set()
            while (tag := self.next_tag()) not in (None, *TRAILER):
                ends = tag in seen if known is None else tag not in known or (tag == head and bool(seen))
                if ends:
                    break
                seen.add(tag)
                self.take(entry)
            known = known or seen
            entries.append(entry)
        return entries


def parse_fix(message: str) -> dict | None:
    """Tag to value of a message delimited by SOH, | or ^, groups as lists under their names; the last of
    repeated tags counts.  Malformed text and text without tag 35 are none."""
    fields = fix_fields(message.strip())
    if fields is None or not any(tag == "35" for tag, _ in fields):
        return None
    reader, out = _Groups(fields), {}
    while reader.next_tag() is not None:
        reader.take(out)
    return out


def read_fix(lines: DataFrame, tags: dict[str, str]) -> DataFrame:
    """A row per message in a ``value`` column of lines: columns named by ``tags`` (tag or group to
    name), groups as JSON text."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in tags.values()])
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    def run(frames):
        for frame in frames:
            found = (parse_fix(m) for x in frame["value"] if x is not None for m in fix_messages(x))
            yield pd.DataFrame([{n: text(m.get(t)) for t, n in tags.items()} for m in found if m is not None], columns=list(tags.values()))

    return lines.select("value").mapInPandas(run, schema)


def infer_kind(values: list) -> str:
    """The kind of sampled values of one key: whole numbers, numbers, truth values, ISO times, objects, arrays, else text."""
    known = [v for v in values if v is not None]
    if not known:
        return "string"
    if all(isinstance(v, bool) for v in known):
        return "bool"
    if all(isinstance(v, int) and not isinstance(v, bool) for v in known):
        return "long"
    if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in known):
        return "double"
    if all(isinstance(v, (dict, list)) for v in known):
        return "json"
    if all(isinstance(v, str) and re.match(r"\d{4}-\d\d-\d\dT\d\d:\d\d", v) for v in known):
        return "timestamp"
    return "string"
