"""File sources and sinks: wide vendor CSV, index CSV, prediction CSV; feature and prediction sinks."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantpanel.session import ship_package

DATE_FORMATS = ("yyyy-MM-dd", "d.M.yy", "d.M.yyyy", "M/d/yyyy", "yyyy/MM/dd", "d-MMM-yy", "yyyy-MM-dd HH:mm:ss")


def parse_date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The first format that fits; null where none does. Years of two digits lie in 1969 to 2068."""

    def read(f: str) -> Column:
        day = F.to_date(F.try_to_timestamp(F.trim(text), F.lit(f)))
        return day if f.count("y") != 2 else F.when(F.year(day) > 2068, F.add_months(day, -1200)).otherwise(day)

    return F.coalesce(*map(read, formats))


def number(text: Column) -> Column:
    """Text to double; what is no finite number becomes null."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def column_name(field: str) -> str:
    return re.sub(r"\W+", "_", field.strip()).strip("_").lower()


def read_wide_panel(spark: SparkSession, path: str, first_block: str = "drop", delimiter: str = ",") -> DataFrame:
    """(ticker, dates, fields...) of a wide vendor CSV.

    The ticker row is the first of the first four rows with a ':' in a cell, else the fourth; the field row stands two below; data
    follow, dates in column 0. A repeated field name starts the next ticker's block. first_block="drop" leaves the
    first block out (it holds the market index), "keep" keeps it. Tickers are cut at the first white space; of equal ones the first block stays.
    Cells that are no number are null; rows without a valid date, and rows and columns without any value, go.

    The few header lines are read on the driver; the data rows are read in parallel, and each becomes one row a ticker by exploding an
    array of structs: no exchange.
    """
    if first_block not in ("drop", "keep"):
        raise ValueError("first_block is drop or keep")
    head = [r.value for r in spark.read.text(path).limit(7).collect()]
    cells = [next(iter(_split(line, delimiter))) for line in head]
    ticker_row = next((i for i, row in enumerate(cells[:4]) if any(":" in c for c in row)), 3)
    if len(cells) <= ticker_row + 2:
        raise ValueError("no field row")
    tickers, fields = cells[ticker_row], [column_name(c) for c in cells[ticker_row + 2]]
    # blocks: a field's k-th occurrence belongs to ticker k
    seen: dict[str, int] = {}
    blocks: dict[int, dict[str, int]] = {}
    for at, field in enumerate(fields[1:], 1):
        if field:
            k = seen[field] = seen.get(field, -1) + 1
            blocks.setdefault(k, {})[field] = at
    names = [c.strip() for c in tickers[1:] if c.strip()]
    chosen: dict[str, dict[str, int]] = {}
    for k, columns in sorted(blocks.items()):
        if k < len(names) and not (k == 0 and first_block == "drop"):
            chosen.setdefault(re.sub(r"\s.*", "", names[k]), columns)
    every = sorted({f for columns in chosen.values() for f in columns})
    if not chosen:
        return spark.createDataFrame([], "ticker string, dates date")
    width = max(len(fields), 1)
    if width > WIDE:
        return _read_lines(spark, path, chosen, every, delimiter)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    raw = spark.read.csv(path, schema=schema, header=False, sep=delimiter, mode="PERMISSIVE", enforceSchema=True)
    # header rows have no valid date in column 0, so they go with the invalid ones
    dated = raw.withColumn("dates", parse_date(F.col("c0"))).where(F.col("dates").isNotNull())
    rows = [
        F.struct(F.lit(t).alias("ticker"), *(number(F.col(f"c{columns[f]}")).alias(f) if f in columns else F.lit(None).cast("double").alias(f) for f in every))
        for t, columns in chosen.items()
    ]
    return dated.select("dates", F.inline(F.array(*rows))).select("ticker", "dates", *every).na.drop("all", subset=every)


#: Files of more columns are read line by line: a plan that names each column grows too large.
WIDE = 1_000


def _read_lines(spark: SparkSession, path: str, chosen: dict[str, dict[str, int]], every: Sequence[str], delimiter: str) -> DataFrame:
    """The same rows, cells taken from each line at their places; tickers without a cell in a line are passed over there."""
    ship_package(spark)
    tickers = np.array(list(chosen), object)
    places = {f: np.array([columns.get(f, -1) for columns in chosen.values()]) for f in every}  # -1: the empty cell put at the end
    first = F.regexp_replace(F.substring_index("value", delimiter, 1), '^"|"$', "")
    lines = spark.read.text(path).select(parse_date(first).alias("dates"), "value").where(F.col("dates").isNotNull())
    reach = 1 + max(int(at.max()) for at in places.values())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for date, line in zip(b.column(0), b.column(1), strict=True):
                text = line.as_py()
                cells = next(csv.reader([text], delimiter=delimiter)) if '"' in text else text.split(delimiter)
                held = np.array(cells[:reach] + [""] * (1 + max(0, reach - len(cells))), object)
                found = [held[at] for at in places.values()]
                some = np.any([column != "" for column in found], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(tickers[some], pa.string()), pa.repeat(date, int(some.sum())), *(pa.array(column[some], pa.string()) for column in found)], ["ticker", "dates", *every])

    kinds = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("dates", T.DateType()), *(T.StructField(f, T.StringType()) for f in every)])
    return lines.mapInArrow(cut, kinds).select("ticker", "dates", *(number(F.col(f"`{f}`")).alias(f) for f in every)).na.drop("all", subset=list(every))


def _split(line: str, delimiter: str):
    yield from csv.reader([line], delimiter=delimiter)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(dates, px_last) of a CSV with columns Dates, PX_LAST in ISO dates."""
    return read_index_tolerant(spark, path, ("yyyy-MM-dd",))


def read_index_tolerant(spark: SparkSession, path: str, formats: Sequence[str] = ("d.M.yy", "yyyy-MM-dd", *DATE_FORMATS)) -> DataFrame:
    """Comment lines start with #; names are trimmed and may be in any case; dates in any of the formats; nulls go."""
    raw = spark.read.csv(path, header=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = {c.strip().lower(): c for c in raw.columns}
    date, price = names.get("dates", names.get("date")), names.get("px_last", names.get("index_price"))
    if date is None or price is None:
        raise ValueError("the index file needs Dates and PX_LAST")
    return raw.select(parse_date(F.col(f"`{date}`"), formats).alias("dates"), number(F.col(f"`{price}`")).alias("px_last")).na.drop("any")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """ticker, dates and the numbers: quantiles q10, q50, q90 or predicted_class."""
    raw = spark.read.csv(path, header=True)
    renamed = raw.withColumnsRenamed({"TickerIndex": "ticker", "DateIndex": "dates", "Date": "dates", "pred_class": "predicted_class"})
    rest = [c for c in renamed.columns if c not in ("ticker", "dates")]
    return renamed.select("ticker", parse_date(F.col("dates")).alias("dates"), *(number(F.col(c)).cast("int" if c == "predicted_class" else "double").alias(c) for c in rest))


def write_predictions(predictions: DataFrame, path: str) -> None:
    """One overwriting write of all windows, a folder a window."""
    predictions.write.mode("overwrite").partitionBy("window_id").parquet(path)


def write_csv(panel: DataFrame, path: str) -> None:
    panel.write.mode("overwrite").csv(path, header=True)


def latest_version(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of the largest `order` for each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def write_wide_panel(panel: DataFrame, path: str, fields: Sequence[str] = ("px_last", "px_volume"), note: str = "export") -> None:
    """The layout that read_wide_panel reads: note, tickers, blank, field names, then a line a date, in one file.

    Tickers become columns, so they are listed on the driver (a cell each in every line); the lines are made in parallel.
    """
    tickers = [r["ticker"] for r in panel.select(F.col("ticker").cast("string").alias("ticker")).distinct().orderBy("ticker").collect()]
    spark, width = panel.sparkSession, len(fields)
    head = [note, "," + ",".join(f"{t} :" + "," * (width - 1) for t in tickers), "", "Dates," + ",".join(",".join(f.upper() for f in fields) for _ in tickers)]
    # a line is the cells of its date in order of tickers, each with the commas of the tickers left out before it
    at = spark.createDataFrame(list(enumerate(tickers)), "_at int, ticker string")
    cell = F.concat_ws(",", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))
    cells = panel.select("dates", F.col("ticker").cast("string").alias("ticker"), cell.alias("_cell")).join(F.broadcast(at), "ticker")
    before = F.coalesce(F.lag("_at").over(Window.partitionBy("dates").orderBy("_at")), F.lit(-1))
    cells = cells.select("dates", "_at", F.concat(F.repeat(F.lit(","), (F.col("_at") - before - 1) * width + 1), "_cell").alias("_cell"))
    by_date = cells.groupBy("dates").agg(F.sort_array(F.collect_list(F.struct("_at", "_cell"))).alias("m"))
    rest = F.repeat(F.lit(","), (len(tickers) - 1 - F.element_at("m", -1)["_at"]) * width)
    day = F.date_format("dates", "yyyy-MM-dd")
    lines = by_date.select(day.alias("k"), F.concat(day, F.array_join(F.col("m")["_cell"], ""), rest).alias("value"))
    top = spark.createDataFrame([(f"!{i}", line) for i, line in enumerate(head)], "k string, value string")
    top.unionByName(lines).repartition(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)
