"""Article sources.

S1 ``read_articles`` reads the reference's CSV layout (six columns by position).
``articles_from_documents`` derives the same layout from the driver's
``documents`` table (rules in FIXTURES.md §3) so every query runs over real,
growing input.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE_COLUMNS = ("url", "date", "title", "author", "category", "article")

_RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True)
                            for c in ARTICLE_COLUMNS])


def read_articles(spark: SparkSession, path: str, *, header: bool = True,
                  date_format: str | None = None, multi_line: bool = True,
                  splittable: bool = False) -> DataFrame:
    """CSV scan → ``seq, url, date, title, author, category, article``.

    Columns are taken by position; the second is parsed as a timestamp and cut
    to the day.  ``seq`` (the order key used for in-group positions) increases
    with the row's place in its file; Spark packs files by size, so between
    files it follows no name order.  It is stable for a given set of files.

    ``multi_line`` allows line breaks inside quoted fields; Spark's reader then
    takes a file as one task.  ``splittable`` reads the same rows by byte ranges,
    many tasks a file (``csv_records``), and ``seq`` follows the order of files by
    name and the place in the file.
    """
    if splittable:
        records = csv_records(spark, path)
        fields = F.from_csv("record", _RAW_SCHEMA.simpleString()[7:-1].replace(":", " "), {"escape": '"'})
        raw = records.where(F.lit(not header) | ~F.col("first")).select("seq", fields.alias("r")).select("seq", "r.*")
    else:
        raw = (spark.read.schema(_RAW_SCHEMA)
               .option("header", header).option("multiLine", multi_line)
               .option("escape", '"').option("mode", "PERMISSIVE")
               .csv(path).withColumn("seq", F.monotonically_increasing_id()))
    ts = (F.to_timestamp("date", date_format) if date_format
          else F.to_timestamp("date"))
    return (raw
            .withColumn("date", F.to_date(ts))
            .select("seq", *ARTICLE_COLUMNS))


#: Most byte ranges whose quote parities the driver holds (8 PB at 128 MB each, about 100 bytes a range).
MAX_RANGES = 1 << 16
_COMPLETE, _PIECE = 0, 1


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files whose quoted fields may hold line breaks, read by byte
    ranges: ``seq, first, record`` (``first``: the first record of its file).

    A line ends a record if the number of quotes up to there is even.  One pass
    counts the quotes of every range, their running parity says whether a range
    begins inside a record, and the second pass cuts each range into records on
    its own.  A record that crosses ranges leaves a piece in each; only these
    pieces are shuffled and glued.  Empty records are left out.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    found = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd")).limit(MAX_RANGES + 1).collect()
    if len(found) > MAX_RANGES:
        raise ValueError(f"more than {MAX_RANGES} byte ranges: raise spark.sql.files.maxPartitionBytes")
    ranges, inside, file = {}, 0, None
    for ordinal, r in enumerate(sorted(found, key=lambda r: (r.file, r.start))):
        inside, file = (inside, file) if r.file == file else (0, r.file)
        ranges[r.file, r.start] = ordinal, inside
        inside = (inside + r.odd) % 2
    shared = spark.sparkContext.broadcast(ranges)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, odd, n = None, [], 0, 0
        out: list[tuple] = []

        def closed(kind: int, opens: bool) -> None:
            nonlocal n
            out.append((here[0], shared.value[here][0], n, here[1] == 0 and n == 0, kind, opens, "\n".join(held)))
            held.clear()
            n += 1

        def batch_of() -> pa.RecordBatch:
            rows = pa.array([dict(zip(names, r)) for r in out], type=pa.struct(arrow))
            out.clear()
            return pa.RecordBatch.from_struct_array(rows)

        names = ["file", "range", "n", "first", "kind", "opens", "record"]
        arrow = [("file", pa.string()), ("range", pa.int64()), ("n", pa.int64()), ("first", pa.bool_()),
                 ("kind", pa.int32()), ("opens", pa.bool_()), ("record", pa.string())]
        for batch in it:
            for value, file, start in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (file, start) != here:
                    if held:
                        closed(_PIECE, opens)
                    here, n = (file, start), 0
                    odd = shared.value[here][1]
                    opens = not odd  # whether the record in hand began in this range
                held.append(value)
                odd = (odd + value.count('"')) % 2
                if not odd:
                    closed(_COMPLETE if opens else _PIECE, opens)
                    opens = True
            yield batch_of()
        if held:
            closed(_PIECE, opens)
            yield batch_of()

    pieces = lines.mapInArrow(cut, "file string, range long, n long, first boolean, kind int, opens boolean, record string")
    seq = (F.shiftleft("range", 33) + F.col("n")).alias("seq")
    whole = pieces.where(F.col("kind") == _COMPLETE).select(seq, "first", "record")
    place = Window.partitionBy("file").orderBy("range", "n")
    crossing = pieces.where(F.col("kind") == _PIECE).withColumn("at", F.sum(F.col("opens").cast("int")).over(place))
    glued = crossing.groupBy("file", "at").agg(
        F.min(F.struct("range", "n", "first")).alias("p"),
        F.sort_array(F.collect_list(F.struct("range", "n", "record"))).alias("parts"))
    glued = glued.select((F.shiftleft("p.range", 33) + F.col("p.n")).alias("seq"), "p.first",
                         F.array_join(F.transform("parts", lambda x: x["record"]), "\n").alias("record"))
    records = whole.unionByName(glued).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    return records.where(F.col("record") != "")


def articles_from_documents(documents: DataFrame) -> DataFrame:
    """Derived article table (FIXTURES.md §3): one article per document."""
    d = F.col("doc_id")
    year = (F.when(d % 40 == 39, F.lit(2021))
            .when(d % 3 == 0, F.lit(2019)).otherwise(F.lit(2020)))
    date = F.when(d % 101 == 100, F.lit(None).cast("date")).otherwise(
        F.make_date(year, (d % 12 + 1).cast("int"), (d % 28 + 1).cast("int")))
    return documents.select(
        d.alias("seq"),
        F.concat(F.lit("doc://"), d.cast("string")).alias("url"),
        date.alias("date"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("author"),
        F.nullif(F.col("lang"), F.lit("es")).alias("category"),
        F.col("text").alias("article"),
    )


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_from_documents(
        load_table(spark, sf_dir, "documents")
        .select("doc_id", "text", "lang", "source"))


def orders_as_groups(orders: DataFrame) -> DataFrame:
    """Orders shaped as grouped rows: key (year of order date, priority)."""
    return orders.select(
        F.col("o_orderkey").alias("seq"),
        F.to_date("o_orderdate").alias("date"),
        F.col("o_orderpriority").alias("category"))
