"""What kind of data a table holds, drawn from its columns' names and one row of statistics for each column (a single pass over the table)."""

from __future__ import annotations

import re
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric_columns, quoted

# Patterns of column names and sets of file extensions.
LOG_NAMES = r"(message|log|text|description|body|incident|ticket|error|stack|trace|assignment|severity|priority|level)"
TIME_NAMES = r"(^date$|_date$|^date_|timestamp|datetime|(^time$|_time$)|^period$|_period$|^month$|_month$|^year$|_year$|^week$|_week$|signup_date|created_at|updated_at)"
NOT_TIME_NAMES = r"(timezone|time_zone|location|coord|zone|country|city|name|monthly|tenure|charges|charge|billing|duration|minute|second|hour|age|latency|runtime|uptime)"
STAMP_NAMES = r"(timestamp|datetime|(^date$|_date$|^date_))"
TEXT_NAMES = r"(text|content|body|message|review|comment|description|ticket|summary|tweet)"
TARGET_NAMES = r"(sentiment|label|class|category|polarity)"
ID_NAMES = r"(^id$|_id$|\bid\b|tweet_id|user_id)"
ENTITY_NAMES = r"(^id$|_id$|\bid\b|customer|user|account|order|transaction)"
NOT_VALUE_NAMES = r"(id|confidence|index|count|gold|code|zip|lat|lon)"
EXTENSIONS = {"image": ".jpg .jpeg .png .bmp .gif .webp .tiff .zip .tar .gz".split(), "tabular": ".csv .xlsx .xls .tsv".split(), "documents": ".pdf .docx .txt .md".split(), "text": ".jsonl .json".split()}

#: More distinct values than a label column may have.
MANY = 51


def by_extension(name: str) -> str | None:
    """The modality that a file's name tells, or None; "tabular" needs a look at the columns."""
    ending = PurePosixPath(name.lower()).suffix
    return next((kind for kind, endings in EXTENSIONS.items() if ending in endings), None)


#: The sketch of distinct values has 2^SKETCH registers: a relative standard error of 0.008.
SKETCH = 14


def _n_distinct(c: Column) -> Column:
    """An estimate of the distinct values. The sketch is one object; approx_count_distinct's is a field for every ten registers, thousands of them for each column of a plan."""
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), SKETCH)), F.lit(0).cast("long"))


def statistics(df: DataFrame, lengths: list[str] | None = None, times: list[str] | None = None) -> DataFrame:
    """(position, column, type, n_rows, n_valid, mean_length, n_distinct, largest, n_times, median_year, max_year), a row for each column.

    Nulls count in n_rows only. n_distinct is a sketch's estimate (relative error 0.01, so small counts are as good as exact) in a single pass; numbers are read as
    nanoseconds since 1970. An empty table has zeros and nulls. lengths, times: the columns whose lengths as text, and whose values as times, are told (None: all);
    the others have nulls there. Distinct values are those of the column itself, not of its text, which is far more work for numbers.
    """
    rows, numbers = [], set(numeric_columns(df))
    nothing = F.lit(None)
    for at, (name, kind) in enumerate(df.dtypes):
        c = quoted(name)
        long, timed = lengths is None or name in lengths, times is None or name in times
        plain = not kind.startswith(("array", "map", "struct", "binary", "variant"))
        shown = c.cast("string") if plain else nothing.cast("string")
        if kind in ("date", "timestamp", "timestamp_ntz"):
            time = c.cast("timestamp")
        elif name in numbers:
            time = F.timestamp_micros((c / 1000).try_cast("long"))
        else:
            time = F.try_to_timestamp(shown)
        year = F.year(time)
        row = {"position": F.lit(at), "column": F.lit(name), "type": F.lit(kind), "n_rows": F.count("*"), "n_valid": F.count(c), "mean_length": F.avg(F.length(shown)) if long else nothing.cast("double"), "n_distinct": _n_distinct(c) if plain else F.lit(0).cast("long")}
        row |= {"largest": F.max(c).cast("double") if name in numbers else nothing.cast("double"), "n_times": F.count(time) if timed else nothing.cast("long"), "median_year": F.percentile(year, F.lit(0.5)) if timed else nothing.cast("double"), "max_year": F.max(year) if timed else nothing.cast("int")}
        rows.append(F.struct(*[v.alias(k) for k, v in row.items()]))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def detect(df: DataFrame, most_labels: int | None = None, most_values: int | None = 5, most_targets: int | None = 3) -> dict:
    """{modality, text_column, datetime_column, value_columns, targets} of a table: logs, text, timeseries or tabular.

    Of a series' value columns the first most_values are told, and the first most_targets as targets; None tells all. The statistics are a row for each column, so what reaches the driver is bounded by the table's width.
    """
    hit = lambda pattern, c: re.search(pattern, c, re.I)
    numbers = set(numeric_columns(df))
    # what the rules below ask for: lengths of texts, and times of what is named, or typed, as one
    lengths = [c for c, kind in df.dtypes if kind == "string" or hit(TEXT_NAMES, c)]
    may_be_time = {c for c, kind in df.dtypes if not hit(NOT_TIME_NAMES, c) and (hit(TIME_NAMES, c) or kind.startswith(("date", "timestamp"))) and (c not in numbers or hit(STAMP_NAMES, c))}
    stats = {r["column"]: r for r in statistics(df, lengths, list(may_be_time)).collect()}
    names = list(stats)
    strings = [c for c in names if stats[c]["type"] == "string"]
    labels = lambda but=(): [c for c in names if c not in but and 2 <= stats[c]["n_distinct"] < MANY][:most_labels]

    log_named = [c for c in names if hit(LOG_NAMES, c)]
    if len(log_named) >= 2 or (log_named and any(hit("assign|group|severity", c) for c in names)):
        picked = next((c for c in log_named if c in strings), strings[0] if strings else None)
        return _decision("logs", text=picked, targets=labels())

    def rank(c: str) -> float:
        return (stats[c]["mean_length"] or 0) + (1000 if re.search("(^|_)text$", c.lower()) else 500 if c.lower() in ("message", "body", "content", "review", "comment") else 0)

    long = lambda c: c in strings and (stats[c]["mean_length"] or 0) > 35 and stats[c]["n_distinct"] > 5
    wordy = sorted((c for c in names if not hit(ID_NAMES, c) and (hit(TEXT_NAMES, c) or long(c))), key=lambda c: -rank(c))
    strong = wordy and ((stats[wordy[0]]["mean_length"] or 0) > 25 or hit(TEXT_NAMES, wordy[0]) or any(hit(TARGET_NAMES, c) for c in names))
    if strong:
        return _decision("text", text=wordy[0], targets=labels(wordy))

    def is_time(c: str) -> bool:
        s = stats[c]
        if c not in may_be_time or (c in numbers and (s["largest"] or 0) < 1e8):
            return False
        return bool(s["n_times"]) and s["n_times"] >= 0.5 * s["n_rows"] and s["median_year"] >= 1980 and s["max_year"] <= 2100

    times = [c for c in names if is_time(c)]
    values = [c for c in names if c in numbers and not hit(NOT_VALUE_NAMES, c) and stats[c]["n_distinct"] >= 5]
    if times and values:
        s = stats[times[0]]
        entities = any(hit(ENTITY_NAMES, c) for c in names if c != times[0])
        index = not entities and s["n_times"] >= 10 and s["n_distinct"] >= 0.5 * s["n_times"]
        if index or not labels():
            return _decision("timeseries", time=times[0], values=values[:most_values], targets=values[:most_targets])
    if wordy:
        return _decision("text", text=wordy[0], targets=labels(wordy))
    return _decision("tabular", targets=labels())


def _decision(modality: str, text: str | None = None, time: str | None = None, values: list[str] | None = None, targets: list[str] | None = None) -> dict:
    return {"modality": modality, "text_column": text, "datetime_column": time, "value_columns": values or [], "targets": targets or []}
