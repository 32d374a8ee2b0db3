"""CSV records by header from splittable text.

Spark's multi-line CSV scan gives a whole file to one task and takes the columns of a
folder by position.  Here files are read as text, in byte ranges, from any file system:

1. each range counts its double quotes; the parity of all ranges before it tells whether
   it begins inside a quoted cell (a doubled quote inside a cell does not change parity);
2. each range joins its lines to records from that state on.  A record that crosses a
   border leaves one piece per range, and the pieces are joined by (file, place);
3. the first record of each file is its header, and cells are found by its names.

Records and headers are rows; what is gathered per file is a number per range.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from langmix.session import cut_lineage

_LIMIT = 1 << 30  # characters of a cell


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return (spark.read.option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
            .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")))


def read_records(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(file, header, cells) of every record but the headers, in no order.  Blank
    lines between records are no records; a file without a header gives nothing."""
    lines = _lines(spark, path, glob)
    quotes = F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    state = lines.groupBy("file", "block").agg(quotes).select(
        F.col("file").alias("_file"), F.col("block").alias("_block"), (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    begun = {(r._file, r._block) for r in state.where("inside").collect()}  # ranges that begin inside a cell: rare

    def work(batches):
        names = ["file", "block", "part", "first", "value"]
        at, held, inside, first = None, [], False, False
        rows: list[tuple] = []

        def kind(last: bool) -> str:
            return ("whole" if last else "head") if held[0] else ("tail" if last else "record")

        for batch in batches:
            for value, file, block in zip(*[c.to_pylist() for c in batch.columns]):
                if (file, block) != at:
                    if held and len(held) > 1:
                        rows.append((*at, kind(inside), first, "\n".join(held[1:])))
                    at, inside, first = (file, block), (file, block) in begun, block == 0
                    held = [inside]  # the first entry: whether the record began before
                held.append(value)
                inside ^= value.count('"') % 2 == 1
                if not inside:
                    text = "\n".join(held[1:]).removesuffix("\r")
                    if text or held[0]:
                        rows.append((*at, kind(False), first and not held[0], text))
                        first = first and bool(held[0])
                    held = [False]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
                rows = []
        if len(held) > 1:
            rows.append((*at, kind(inside), first, "\n".join(held[1:])))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    pieces = cut_lineage(lines.mapInArrow(work, "file string, block long, part string, first boolean, value string"))
    whole = pieces.where("part = 'record'").select("file", "first", "value")
    order = Window.partitionBy("file").orderBy("block", F.col("part") == "tail")
    broken = pieces.where("part <> 'record'").withColumn("record", F.sum((F.col("part") == "tail").cast("int")).over(order))
    joined = (broken.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "first", "value"))).alias("x"))
              .select("file", F.col("x")[0]["first"].alias("first"), F.array_join(F.transform("x", lambda p: p["value"]), "\n").alias("value")))
    records = whole.unionByName(joined).mapInArrow(_parse, "file string, first boolean, cells array<string>")
    headers = records.where("first").select(F.col("file").alias("_file"), F.col("cells").alias("header"))
    return (records.where("not first").join(headers, F.col("file") == F.col("_file"))
            .select("file", "header", "cells"))


def _parse(batches):
    csv.field_size_limit(_LIMIT)
    for batch in batches:
        cells = [next(csv.reader(io.StringIO(v, newline="")), []) for v in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.list_(pa.string()))], names=["file", "first", "cells"])


def read_csv_by_header(spark: SparkSession, path: str, columns: Mapping[str, str], glob: str = "*.csv") -> DataFrame:
    """The named columns (name -> type) of a file or of all files of a folder,
    each by its own header; a column that a file lacks is null there, as are empty cells."""
    def cell(name: str, kind: str):
        at = F.array_position("header", name).cast("int")
        return F.when(at > 0, F.nullif(F.get("cells", at - 1), F.lit(""))).cast(kind).alias(name)

    return read_records(spark, path, glob).select(*[cell(n, k) for n, k in columns.items()])
