"""HTTP: polled documents as a source, batches of events as a sink.

Requests run on the executors.  A failed request is a row with an error, not a
failed job; what was posted before a lost task is posted again (at least once)."""

from __future__ import annotations

import time
import urllib.request

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a response that are read, at most; a longer one is an error.
LARGEST = 64 << 20


def fetch(spark: SparkSession, urls: list[str], timeout: float = 30.0, headers: dict[str, str] | None = None, largest: int = LARGEST) -> DataFrame:
    """``url, value, error``: one row per URL; ``value`` is the body as text."""

    def run(frames):
        for frame in frames:
            out = []
            for url in frame["url"]:
                value = error = None
                try:
                    with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as response:
                        body = response.read(largest + 1)
                        if len(body) > largest:
                            raise ValueError(f"more than {largest} bytes")
                        value = body.decode(response.headers.get_content_charset() or "utf-8")
                except (OSError, ValueError, LookupError) as problem:
                    error = f"{type(problem).__name__}: {problem}"
                out.append((url, value, error))
            yield pd.DataFrame(out, columns=["url", "value", "error"])

    asked = spark.createDataFrame([(u,) for u in urls], "url string")
    return asked.mapInPandas(run, "url string, value string, error string")


def items(fetched: DataFrame) -> DataFrame:
    """``url, j``: the elements of bodies that are JSON arrays, other bodies line by line."""
    array = F.from_json("value", "array<string>")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    whole = F.ltrim("value").startswith("[")
    return fetched.filter("error is null").select("url", F.explode(F.when(whole, array).otherwise(lines)).alias("j"))


def post(df: DataFrame, url: str, batch: int = 500, tries: int = 3, timeout: float = 30.0, wait: float = 0.5) -> DataFrame:
    """Posts ``{"events": [row, ...]}`` in batches and gives ``sent, failed`` per partition.  A batch is
    tried ``tries`` times, after longer and longer waits."""

    def run(frames):
        sent = failed = 0
        for frame in frames:
            rows = frame["j"].tolist()
            for at in range(0, len(rows), batch):
                part = rows[at : at + batch]
                body = ('{"events":[' + ",".join(part) + "]}").encode()
                for attempt in range(tries):
                    try:
                        request = urllib.request.Request(url, body, {"Content-Type": "application/json"})
                        with urllib.request.urlopen(request, timeout=timeout):
                            sent += len(part)
                        break
                    except OSError:
                        if attempt + 1 == tries:
                            failed += len(part)
                        else:
                            time.sleep(wait * 2**attempt)
        yield pd.DataFrame([(sent, failed)], columns=["sent", "failed"])

    return df.select(F.to_json(F.struct(*df.columns)).alias("j")).mapInPandas(run, "sent long, failed long")
