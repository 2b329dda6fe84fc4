"""Files that the engine reads and writes."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.spans import let
from ..operators import audit

BAD = "_bad"


def audit_log(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Audit events of JSON-lines files, by an explicit schema; a line that is no JSON is kept in ``_bad``."""
    schema = f"{audit.SCHEMA}, {BAD} string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(paths)


def audit_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(audit.SCHEMA).json(path)


def well_formed(events: DataFrame) -> DataFrame:
    return events.filter(F.col(BAD).isNull()).drop(BAD)


def malformed(spark: SparkSession, paths: str | list[str]) -> int:
    """Lines that are not empty and no JSON object."""
    lines = spark.read.text(paths).filter(F.trim("value") != "")
    return lines.filter(F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{")).count()


def append_audit(events: DataFrame, path: str) -> None:
    """Appends events as JSON lines, errors scrubbed of what may be personal."""
    if "error" in events.columns:
        events = events.withColumn("error", audit.scrubbed(F.col("error")))
    events.write.mode("append").json(path)


CORPUS = "id string, lang string, surface string, text string, spans array<struct<text:string,category:string>>"


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an evaluation corpus, a JSON document with ``entries``; an entry whose span is not in its text fails."""
    rows = spark.read.schema(f"entries array<struct<{_fields(CORPUS)}>>").option("multiLine", True).json(path).select(F.inline("entries"))
    from ..operators.evals import located

    missing = F.exists(located(F.col("text"), F.transform("spans", lambda s: s["text"])), lambda x: x < 0)
    return rows.withColumn("text", F.when(missing, F.raise_error(F.concat(F.lit("a span is not in the text of "), F.col("id")))).otherwise(F.col("text")))


def _fields(ddl: str) -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in (f.split(" ", 1) for f in ddl.split(", ")))


HOOK = "session_id string, prompt string, cwd string, hook_event_name string"


def hook_input(raw: Column) -> Column:
    """Fields of a prompt hook's JSON; null if it is none."""
    return F.from_json(raw, HOOK)


def spans_from_wire(response: Column) -> Column:
    """Spans of a remote detector's JSON response: ``category`` or ``label``, ``confidence`` or ``score`` (0.9 where absent).

    Spans with bad offsets or unknown categories are dropped.
    """
    from ..functions.patterns import CATEGORIES

    item = "struct<start:int,end:int,category:string,label:string,confidence:double,score:double,text:string>"
    parsed = F.from_json(response, f"struct<detections:array<{item}>,spans:array<{item}>>")
    found = F.coalesce(parsed["detections"], parsed["spans"], F.from_json(F.lit("[]"), f"array<{item}>"))
    category = lambda s: F.lower(F.regexp_replace(F.coalesce(s["category"], s["label"]), "^[BIOESUbioesu]-", ""))
    good = F.filter(found, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & category(s).isin(*CATEGORIES))
    return F.transform(
        good,
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), category(s).alias("category"),
            F.coalesce(s["confidence"], s["score"], F.lit(0.9)).alias("confidence"), F.coalesce(s["text"], F.lit("")).alias("text"),
        ),
    )


def stream_to(entries: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Gives each batch of a stream to a callback, with the batch's number; a batch may come again after a failure, under the same number."""
    return entries.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def images(spark: SparkSession, path: str, most: int = 8 << 20) -> DataFrame:
    """Images below a folder (image_id, content), one row a file; one over ``most`` bytes fails the query when it is read."""
    files = spark.read.format("binaryFile").load(path)
    large = F.when(F.col("length") > most, F.raise_error(F.concat(F.lit("the image is too large: "), F.col("path"))))
    return files.select(F.col("path").alias("image_id"), F.coalesce(large.cast("binary"), F.col("content")).alias("content"))


class Unavailable(Exception):
    """A remote detector could not answer now; another try may help."""


def http_transport(url: str, headers: dict[str, str] | None = None, timeout: float = 10.0) -> Callable[[str], str]:
    """Sends a JSON body and gives the response's; server errors and network failures are ``Unavailable``, others are not tried again."""

    def send(body: str) -> str:
        import urllib.error
        import urllib.request

        request = urllib.request.Request(url, body.encode(), {"Content-Type": "application/json", **(headers or {})})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as response:
                return response.read().decode()
        except urllib.error.HTTPError as e:
            if e.code >= 500 or e.code == 429:
                raise Unavailable(str(e)) from e
            raise
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise Unavailable(str(e)) from e

    return send


def remote_detector(send: Callable[[str], str], retries: int = 2, wait: float = 0.2) -> Callable[[Column], Column]:
    """A detector that asks a service for each text, in Arrow batches, and tries again, after longer and longer waits, while it is unavailable.

    A text without an answer has null spans, for the strategy to judge.
    """
    import time

    def ask(text: str) -> str | None:
        for turn in range(retries + 1):
            try:
                return send(json.dumps({"text": text}))
            except Unavailable:
                if turn < retries:
                    time.sleep(wait * 2**turn)
            except Exception:  # noqa: BLE001  a refusal is a failure of this text, as is a broken answer
                return None
        return None

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else ask(t) for t in texts], dtype=object)

    call = pandas_udf(run, "string").asNondeterministic()

    def detect(text: Column) -> Column:
        # bound once: a service should not be asked again for each use of its answer
        own = lambda x: F.when(F.get_json_object(x["answer"], "$").isNotNull(), F.transform(spans_from_wire(x["answer"]), lambda s: _with_text(s, x["text"])))
        return let(F.struct(call(text).alias("answer"), text.alias("text")), own)

    return detect


def _with_text(s: Column, text: Column) -> Column:
    """The span with its text, which the wire may leave out."""
    return F.struct(*[s[c].alias(c) for c in ("start", "end", "category", "confidence")], F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text"))
