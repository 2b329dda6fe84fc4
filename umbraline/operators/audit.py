"""Audit events and the report over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..functions import patterns
from ..functions import spans as S
from .mask import ASSIGNED

SCHEMA = """timestamp string, event string, vault_id string, session_id string, request_id string, categories map<string,bigint>,
backend_name string, latency_ms double, policy_result string, restored_count bigint, unknown_token_count bigint, partial_match_count bigint,
path_skip_count bigint, lenient_restored_count bigint, residual_token_count bigint, repaired_count bigint, hallucinated_count bigint,
unminted_token_count bigint, dead_token_count bigint, ambiguous_count bigint, minted_count bigint, text_length bigint, masked_char_count bigint,
error string, provider string"""
EVENTS = ("mask", "restore", "bypass", "block", "error")
UNSET, ALL = "(unset)", "ALL"


def mask_events(masked: DataFrame, session: str, provider: Column, at: Column, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """One event for each masked row."""
    return masked.select(
        at.alias("timestamp"), F.lit("mask").alias("event"), F.col(session).cast("string").alias("session_id"), S.histogram(F.col(tokens)).alias("categories"),
        F.size(F.array_distinct(F.transform(tokens, lambda t: t["token"]))).cast("bigint").alias("minted_count"),
        F.length(text).cast("bigint").alias("text_length"), S.masked_chars(F.col(tokens)).cast("bigint").alias("masked_char_count"), provider.alias("provider"),
    )


def restore_events(restored: DataFrame, session: str, provider: Column, at: Column) -> DataFrame:
    """One event for each row in which a token was seen."""
    from .restore import COUNTERS, observed

    names = [c for c in COUNTERS if c != "foreign_count"]
    return observed(restored).select(
        at.alias("timestamp"), F.lit("restore").alias("event"), F.col(session).cast("string").alias("session_id"),
        *[F.col(c).cast("bigint").alias(c) for c in (*names, "residual_token_count", "hallucinated_count", "unminted_token_count")],
        provider.alias("provider"),
    )


def scrubbed(error: Column) -> Column:
    """An error message without addresses and numbers."""
    b = patterns.B
    out = F.regexp_replace(error, r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "[REDACTED_EMAIL]")
    out = F.regexp_replace(out, rf"{b}\d{{6}}-?[1-4]\d{{6}}{b}", "[REDACTED_RRN]")
    out = F.regexp_replace(out, rf"{b}01[016789]-?\d{{3,4}}-?\d{{4}}{b}", "[REDACTED_PHONE]")
    return F.regexp_replace(out, rf"{b}(?:\d[ -]?){{13,19}}{b}", "[REDACTED_NUMBER]")


def valid(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event").isin(*EVENTS) & F.col("timestamp").isNotNull())


def window(events: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Events from ``since`` to ``until``, both included; timestamps are compared as text."""
    out = events if since is None else events.filter(F.col("timestamp") >= since)
    return out if until is None else out.filter(F.col("timestamp") <= until)


def _n(name: str) -> Column:
    return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(None)).cast("bigint"), F.lit(0).cast("bigint"))


def _ratio(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b > 0, a / b)


RESTORE_SUMS = {
    "restored": "restored_count", "unknown": "unknown_token_count", "path_skip": "path_skip_count", "partial": "partial_match_count",
    "lenient_restored": "lenient_restored_count", "repaired": "repaired_count", "hallucinated": "hallucinated_count", "unminted": "unminted_token_count",
    "dead": "dead_token_count", "ambiguous": "ambiguous_count",
}
MASK_SUMS = {"minted": "minted_count", "text_length": "text_length", "masked_chars": "masked_char_count"}


def report(events: DataFrame) -> DataFrame:
    """Sums and rates of each provider, and of all of them in a row with ``is_total``.

    A provider that is null is ``(unset)``. Rates are null where they would
    divide by zero. The total is a rollup, so a provider may be called ALL.
    """
    rows = valid(events).withColumn("provider", F.coalesce("provider", F.lit(UNSET)))
    is_ = lambda e: F.col("event") == e
    sums = [F.sum(F.when(is_("restore"), _n(c)).otherwise(0)).alias(k) for k, c in RESTORE_SUMS.items()]
    sums += [F.sum(F.when(is_("mask"), _n(c)).otherwise(0)).alias(k) for k, c in MASK_SUMS.items()]
    counts = [F.count_if(is_(e)).alias(f"{e}_events") for e in EVENTS]
    residual = F.count_if(is_("restore") & (_n("residual_token_count") > 0)).alias("residual_events")
    out = rows.rollup("provider").agg(F.grouping("provider").cast("int").alias("g"), *counts, *sums, residual)
    out = out.withColumn("is_total", F.col("g") == 1).withColumn("provider", F.when(F.col("is_total"), ALL).otherwise(F.col("provider"))).drop("g")
    out = out.withColumn("observed", F.col("restored") + F.col("unknown") + F.col("path_skip"))
    rates = {
        "token_restore_rate": ("restored", "observed"), "lenient_rate": ("partial", "observed"), "lenient_recovery_rate": ("lenient_restored", "partial"),
        "repair_rate": ("repaired", "observed"), "unrestorable_surface_rate": ("residual_events", "restore_events"),
        "hallucination_rate": ("hallucinated", "observed"), "unminted_token_rate": ("unminted", "observed"), "dead_token_rate": ("dead", "observed"),
        "ambiguous_rate": ("ambiguous", "observed"), "path_skip_rate": ("path_skip", "observed"), "mask_density": ("masked_chars", "text_length"),
        "token_reference_rate": ("observed", "minted"),
    }
    for name, (a, b) in rates.items():
        out = out.withColumn(name, _ratio(a, b))
    out = out.withColumn("unknown_token_rate", _ratio(F.col("unknown") + F.col("path_skip"), "observed"))
    return out.withColumn("bypass_rate", _ratio("bypass_events", F.col("mask_events") + F.col("bypass_events") + F.col("block_events")))


def integrity(events: DataFrame) -> DataFrame:
    """One row: events without the fields of today, and restore events whose unknown tokens do not add up."""
    parts = _n("hallucinated_count") + _n("unminted_token_count") + _n("dead_token_count") + _n("ambiguous_count")
    restore, new = F.col("event") == "restore", F.col("path_skip_count").isNotNull()
    session = lambda e: F.count_distinct(F.when(F.col("event") == e, F.col("session_id")))
    return valid(events).agg(
        F.count_if(restore & ~new).alias("stale_restore_events"),
        F.count_if((F.col("event") == "mask") & F.col("minted_count").isNull()).alias("stale_mask_events"),
        F.count_if(restore & new & (parts != _n("unknown_token_count"))).alias("partition_mismatches"),
        session("mask").alias("sessions_with_mints"), session("restore").alias("sessions_with_restores"),
        F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"), F.count(F.lit(1)).alias("events"),
    )


def category_totals(events: DataFrame) -> DataFrame:
    """Spans of each category over all mask events, most frequent first, ties by name."""
    some = valid(events).filter(F.col("event") == "mask").select(F.explode("categories").alias("category", "n"))
    return some.groupBy("category").agg(F.sum("n").alias("spans")).orderBy(F.desc("spans"), "category")


def as_percent(rate: Column) -> Column:
    return F.when(rate.isNull(), "n/a").otherwise(F.concat(F.format_number(rate * 100, 1), F.lit("%")))


def markdown(table: DataFrame, columns: list[str]) -> str:
    """A small result as an aligned Markdown table."""
    rows = [columns, *[["n/a" if (v := r[c]) is None else f"{v:.4g}" if isinstance(v, float) else str(v) for c in columns] for r in table.select(*columns).collect()]]
    width = [max(len(r[i]) for r in rows) for i in range(len(columns))]
    line = lambda r: "| " + " | ".join(x.ljust(w) for x, w in zip(r, width, strict=True)) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join("-" * w for w in width) + " |", *map(line, rows[1:])])


def leaks(masked: DataFrame, detect, text: str = "masked") -> DataFrame:
    """Adds ``leaked``: spans that detection still finds in masked text, but for tokens."""
    from ..functions.tokens import sweep

    return masked.withColumn("leaked", F.size(detect(sweep(F.col(text), " "))))


def latency(samples: DataFrame, column: str, by: list[str], ranges: int = 512) -> DataFrame:
    """Mean, percentiles and throughput of millisecond samples; a percentile is the sample at index floor(n * p) of the sorted ones.

    Samples are first counted by value, and values by ``ranges`` ranges of each
    group, whose bounds are approximate quantiles. A window then goes over the
    ranges of a group, and another one over the values of a range, so that
    neither a group's rows nor its distinct values meet in one place. Bounds
    decide where values are counted, never what is found. Null samples do not
    count; null groups are groups.
    """
    from pyspark.sql import Window

    names = [f"g{i}" for i in range(len(by))]
    values = samples.filter(F.col(column).isNotNull()).groupBy(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    bounds = values.groupBy(*names).agg(F.percentile_approx("v", [i / ranges for i in range(1, ranges)], 10 * ranges).alias("bounds"), F.sum("c").alias("n"), F.sum(F.col("v") * F.col("c")).alias("total"))
    others = bounds.toDF(*[f"o{n}" for n in names], "bounds", "n", "total")
    same = [F.col(n).eqNullSafe(F.col(f"o{n}")) for n in names]
    values = values.join(others, same, "inner") if names else values.crossJoin(others)  # of one row, if there is no group
    values = values.withColumn("range", F.size(F.filter("bounds", lambda b: b < F.col("v")))).drop("bounds")
    group = [*names, "range"]
    before = Window.partitionBy(*names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = values.groupBy(*group).agg(F.sum("c").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(before), F.lit(0)))
    parts = parts.toDF(*[f"p{n}" for n in group], "m", "base")
    values = values.join(parts, [F.col(n).eqNullSafe(F.col(f"p{n}")) for n in group])
    values = values.withColumn("upto", F.col("base") + F.sum("c").over(Window.partitionBy(*group).orderBy("v")))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col("v")))
    out = values.groupBy(*names).agg(F.first("n").alias("n"), F.first("total").alias("total"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))
    return out.select(
        *[F.col(n).alias(c) for n, c in zip(names, by, strict=True)], "n", (F.col("total") / F.col("n")).alias("avg"), "p50", "p95", "p99", (F.col("n") * 1000 / F.col("total")).alias("per_second")
    )


def observed(masked: DataFrame, name: str = "masking", text: str = "text", tokens: str = "tokens") -> DataFrame:
    """The masked rows, which give their audit figures to whoever listens for ``name`` as they pass: no second scan.

    Figures: mask_events, text_length, masked_char_count, minted_count (token
    uses), failed_texts (null), and a count for each category, ``n_<category>``.
    A batch query gives them to ``Observation(name)``, a stream's queries to
    ``MetricsListener``. Sums over nothing are 0.
    """
    return masked.observe(name, *_figures(text, tokens))


def observation(masked: DataFrame, text: str = "text", tokens: str = "tokens") -> tuple[DataFrame, Observation]:
    """The masked rows, and what holds their figures after the first action on them."""
    seen = Observation()
    return masked.observe(seen, *_figures(text, tokens)), seen


def _figures(text: str, tokens: str) -> list[Column]:
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    spans = F.coalesce(tokens, F.from_json(F.lit("[]"), ASSIGNED))
    each = [total(F.size(S.only(spans, [c])), f"n_{c}") for c in patterns.CATEGORIES]
    return [
        F.count_if(F.col(text).isNotNull()).alias("mask_events"), total(F.length(text), "text_length"), total(S.masked_chars(spans), "masked_char_count"),
        total(F.size(spans), "minted_count"), F.count_if(F.col(text).isNull()).alias("failed_texts"), *each,
    ]


class MetricsListener(StreamingQueryListener):
    """Hands the figures of each batch of a stream to ``sink`` (batch id, figures), as they are observed under ``name``."""

    def __init__(self, sink: Callable[[int, dict[str, int]], None], name: str = "masking") -> None:
        self.sink, self.name = sink, name

    def onQueryStarted(self, event) -> None:
        return None

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.sink(event.progress.batchId, row.asDict())

    def onQueryIdle(self, event) -> None:
        return None

    def onQueryTerminated(self, event) -> None:
        return None
