"""Sinks (S2-S8).

Per-group files of the reference become one partitioned dataset per output
(``partitionBy('Year', 'Category'[, 'ClusterId'])``), so a run writes all
groups in the same job and the group keys live in the folder names.
A JSON output is one object per group's file, entry by entry: ``{id: {...}}``,
``{ClusterId: {TopicId: {...}}}`` or ``{topicId: [{...}, …]}``.  The entries of a
file are sorted rows of one task, which writes them as they come; what opens and
closes the nesting is decided from the neighbouring row, so no list of a group,
cluster or topic is gathered.  A failed task leaves no file (Spark's commit).
Every writer overwrites its own output folder (S8) and deletes nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARTICLE_COLUMNS = ["Year", "Category", "id", "url", "title", "sentiment"]
TOPIC_COLUMNS = ["Year", "Category", "ClusterId", "TopicId", "Topic Name", "Keywords",
                 "Articles", "Sentiment"]
TRIPLE_COLUMNS = ["Year", "Category", "ClusterId", "topicId", "source", "relation", "target",
                  "articleId", "sentiment"]


def _csv(df: DataFrame, path: str, partition_by: list[str]) -> None:
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .partitionBy(*partition_by).csv(path))


def write_article_info(articles: DataFrame, out_dir: str) -> str:
    """``Year, Category, id, url, title, sentiment`` partitioned by group."""
    path = f"{out_dir}/article_info"
    _csv(articles.select(*ARTICLE_COLUMNS), path, ["Year", "Category"])
    return path


def _json_key(c: str) -> Column:
    """A column as the key of a JSON object."""
    name = F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return F.concat(F.substring(F.to_json(F.array(name)), F.lit(2), F.length(F.to_json(F.array(name))) - 2), F.lit(":"))


def _write_objects(rows: DataFrame, path: str, group: list[str], outer: str | None, order: list[str],
                   value: Column, key: str | None) -> None:
    """One JSON object per group: ``value`` of each row in the order given, under
    ``key``, and these under ``outer`` (an object if there is a key, else a list)."""
    w = Window.partitionBy(*group).orderBy(*([outer] if outer else []), *order)
    n = F.row_number().over(w)
    last = F.lead(F.lit(1)).over(w).isNull()
    opening, closing = ("{", "}") if key else ("[", "]")
    entry = F.concat(_json_key(key), value) if key else value
    if outer is None:
        line = F.concat(F.when(n == 1, "{").otherwise(","), entry, F.when(last, "}").otherwise(""))
    else:
        starts = (n == 1) | ~F.col(outer).eqNullSafe(F.lag(outer).over(w))
        line = F.concat(
            F.when(n == 1, "{").when(starts, closing + ",").otherwise(","),
            F.when(starts, F.concat(_json_key(outer), F.lit(opening))).otherwise(""), entry,
            F.when(last, closing + "}").otherwise(""))
    lines = rows.select(*group, line.alias("value"), n.alias("_n"))
    # the window has dealt each group to one task; this order keeps it through the writer
    (lines.sortWithinPartitions(*group, "_n").drop("_n").write.mode("overwrite").partitionBy(*group).text(path))


def write_article_json(articles: DataFrame, out_dir: str) -> str:
    """S3: ``{"<id>": {"url", "title", "sentiment"}, …}``, a file per group."""
    path = f"{out_dir}/json/article_info"
    _write_objects(articles, path, ["Year", "Category"], None, ["id"],
                   F.to_json(F.struct("url", "title", "sentiment")), "id")
    return path


def _topic_flat(topics: DataFrame) -> DataFrame:
    """Arrays as JSON text so the CSV holds one value per cell."""
    return topics.select(
        "Year", "Category", "ClusterId", "TopicId",
        F.to_json("Topic Name").alias("Topic Name"), F.to_json("Keywords").alias("Keywords"),
        F.to_json("Articles").alias("Articles"), "Sentiment")


def write_topics(topics: DataFrame, out_dir: str) -> str:
    """Topic rows partitioned by group (arrays written as JSON text)."""
    path = f"{out_dir}/topics"
    _csv(_topic_flat(topics.select(*TOPIC_COLUMNS)), path, ["Year", "Category"])
    return path


def write_topics_json(topics: DataFrame, out_dir: str) -> str:
    """``{"<ClusterId>": {"<TopicId>": {Topic Name, Keywords, Articles,
    Sentiment}, …}, …}``, a file per group."""
    path = f"{out_dir}/json/topics"
    _write_objects(topics, path, ["Year", "Category"], "ClusterId", ["TopicId"],
                   F.to_json(F.struct("Topic Name", "Keywords", "Articles", "Sentiment")), "TopicId")
    return path


def write_triples(triples: DataFrame, out_dir: str) -> tuple[str, str]:
    """Per (group, cluster) CSV rows and one JSON object,
    ``{"<topicId>": [{source, relation, target, articleId, sentiment}, …], …}``
    (A11).  Groups or clusters without triples get no folder.  ``triples`` is
    read twice: pass a materialised table."""
    csv_path, json_path = f"{out_dir}/triples", f"{out_dir}/json/triples"
    _csv(triples.select(*TRIPLE_COLUMNS), csv_path, ["Year", "Category", "ClusterId"])
    fields = ["source", "relation", "target", "articleId", "sentiment"]
    place = [c for c in ("sent_id",) if c in triples.columns]
    _write_objects(triples, json_path, ["Year", "Category", "ClusterId"], "topicId",
                   ["articleId", *place, "source", "relation", "target"], F.to_json(F.struct(*fields)), None)
    return csv_path, json_path


def combine_outputs(spark: SparkSession, out_dir: str, data_dir: str) -> tuple[str, str]:
    """The union of all groups' article and topic rows, each as one
    dataset in the fixed column order.  The schema is given, not inferred, so a
    category such as ``007`` stays text, and line breaks inside fields are read
    as such.

    The reference writes one CSV file each; here each is one CSV dataset
    (part files written in parallel), never funnelled through one task.
    """
    def read(path: str, columns: list[str]) -> DataFrame:
        stored = [c for c in columns if c not in ("Year", "Category")]
        schema = ", ".join([*[f"`{c}` STRING" for c in stored], "Year INT", "Category STRING"])
        return (spark.read.schema(schema).option("header", True).option("escape", '"')
                .option("multiLine", True).csv(path).select(*columns))

    arts = read(f"{out_dir}/article_info", ARTICLE_COLUMNS)
    tops = read(f"{out_dir}/topics", TOPIC_COLUMNS)
    a_path, t_path = f"{data_dir}/combined_articles", f"{data_dir}/combined_topics"
    arts.write.mode("overwrite").option("header", True).option("escape", '"').csv(a_path)
    tops.write.mode("overwrite").option("header", True).option("escape", '"').csv(t_path)
    return a_path, t_path
