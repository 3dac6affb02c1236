"""S1 read, S2-S7 write and combine (round trip in a scratch folder)."""
import glob
import json

import pytest
from pyspark.sql import functions as F

from storyloom.sources import sinks
from storyloom.sources.articles import read_articles


def one_file(folder):
    """The text of a folder's only part file."""
    (path,) = glob.glob(f"{folder}/part-*")
    with open(path) as f:
        return f.read()


def test_json_objects_of_many_groups(spark, tmp_out):
    """Every file is one object of all its group's rows, in order, whatever the
    partitions the rows come in."""
    rows = [(2000 + g % 3, f"c{g % 2}", c, t, [f'n"{t}'], ["k,\n"], [t], None)
            for g in range(6) for c in range(g, g + 3) for t in range(0, 40, 7)]
    topics = spark.createDataFrame(
        rows, "Year int, Category string, ClusterId int, TopicId int, `Topic Name` array<string>, "
        "Keywords array<string>, Articles array<long>, Sentiment string").repartition(7)
    path = sinks.write_topics_json(topics, f"{tmp_out}/out")
    seen = 0
    for year in (2000, 2001, 2002):
        for cat in ("c0", "c1"):
            own = [r for r in rows if r[:2] == (year, cat)]
            got = json.loads(one_file(f"{path}/Year={year}/Category={cat}"))
            assert list(got) == [str(c) for c in sorted({r[2] for r in own})]
            for r in own:
                assert got[str(r[2])][str(r[3])] == {"Topic Name": r[4], "Keywords": r[5], "Articles": r[6]}
                seen += 1
    assert seen == len(rows)


def test_failed_json_write_leaves_no_file(spark, tmp_out):
    arts = spark.createDataFrame([(2020, "en", i, "u", "t", "Positive") for i in range(50)],
                                 "Year int, Category string, id long, url string, title string, sentiment string")
    bad = arts.withColumn("title", F.when(F.col("id") == 49, F.raise_error(F.lit("stop"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="stop"):
        sinks.write_article_json(bad, f"{tmp_out}/out")
    assert not glob.glob(f"{tmp_out}/out/json/article_info/Year=*/Category=*/part-*")


def test_read_articles_csv(spark, tmp_out):
    path = f"{tmp_out}/a.csv"
    with open(path, "w") as f:
        f.write('url,date,title,author,category,article\n')
        f.write('u1,2020-03-04 10:11:12,T1,au,cat,"Body, with ""quotes""\nand lines."\n')
        f.write('u2,2021-01-02,T2,au,,B2\n')
    df = read_articles(spark, path).orderBy("url").collect()
    assert [str(r["date"]) for r in df] == ["2020-03-04", "2021-01-02"]
    assert df[0]["article"] == 'Body, with "quotes"\nand lines.'
    assert df[1]["category"] is None


def csv_file(path, n, seed, newline):
    """Articles whose bodies hold quotes, commas and line breaks, some of them long."""
    import csv
    import random
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        body = "".join(rnd.choice(['word ', 'a,b ', 'say ""x"" '.replace('""', '"'), newline, newline * 2, '"', "é"])
                       for _ in range(rnd.choice([1, 5, 30, 3000 if i % 97 == 0 else 3])))
        rows.append([f"u{i}", "2020-03-04", f"t{i}", rnd.choice(["au", ""]), "c", body])
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator=newline)
        out.writerow(["url", "date", "title", "author", "category", "article"])
        out.writerows(rows)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_csv_by_byte_ranges_equals_the_whole_file_reader(spark, tmp_out, newline):
    for k in range(2):
        csv_file(f"{tmp_out}/in{k}.csv", 400, k, newline)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "4096")
    try:
        df = read_articles(spark, f"{tmp_out}/in*.csv", splittable=True)
        assert spark.read.text(f"{tmp_out}/in*.csv").rdd.getNumPartitions() > 20
        got = df.orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = read_articles(spark, f"{tmp_out}/in*.csv").collect()
    # the whole-file reader turns CR LF inside a field into LF
    key = lambda r: r["url"] + r["title"] + str(None if r["article"] is None else r["article"].replace("\r\n", "\n"))
    assert len(got) == 800 and sorted(map(key, got)) == sorted(map(key, want))
    assert [r["url"] for r in got] == [f"u{i}" for i in range(400)] * 2  # files by name, rows by place
    assert len({r["seq"] for r in got}) == 800 and {r["author"] for r in got} == {"au", None}


def test_write_and_combine(spark, tmp_out):
    arts = spark.createDataFrame(
        [(2020, "en", 0, "u0", "t0", "Positive"), (2021, "fr", 1, "u1", "t1", "Negative")],
        "Year int, Category string, id long, url string, title string, sentiment string")
    topics = spark.createDataFrame(
        [(2020, "en", 0, 1, ["a"], ["a", "b_c"], [0], "Neutral")],
        "Year int, Category string, ClusterId int, TopicId int, `Topic Name` array<string>, "
        "Keywords array<string>, Articles array<long>, Sentiment string")
    out, data = f"{tmp_out}/out", f"{tmp_out}/data"
    sinks.write_article_info(arts, out)
    sinks.write_article_json(arts, out)
    sinks.write_topics(topics, out)
    sinks.write_topics_json(topics, out)
    a, t = sinks.combine_outputs(spark, out, data)
    back = spark.read.option("header", True).csv(a)
    assert back.columns == sinks.ARTICLE_COLUMNS and back.count() == 2
    tb = spark.read.option("header", True).option("escape", '"').csv(t).first()
    assert tb["Keywords"] == '["a","b_c"]'
    js = one_file(f"{out}/json/topics/Year=2020/Category=en")
    assert json.loads(one_file(f"{out}/json/article_info/Year=2021/Category=fr")) == {
        "1": {"url": "u1", "title": "t1", "sentiment": "Negative"}}
    assert js.strip() == '{"0":{"1":{"Topic Name":["a"],"Keywords":["a","b_c"],"Articles":[0],"Sentiment":"Neutral"}}}'


def test_combine_keeps_line_breaks_and_category_text(spark, tmp_out):
    rows = [(2020, "007", 0, "u0", "one\ntwo, \"three\"", "Positive"), (2021, None, 1, "u1", "t1", "Negative")]
    arts = spark.createDataFrame(rows, "Year int, Category string, id long, url string, title string, sentiment string")
    topics = spark.createDataFrame(
        [(2020, "007", 0, t, ["a"], ["a\nb"], [0], "Neutral") for t in (1, 0)],
        "Year int, Category string, ClusterId int, TopicId int, `Topic Name` array<string>, "
        "Keywords array<string>, Articles array<long>, Sentiment string")
    out, data = f"{tmp_out}/out", f"{tmp_out}/data"
    sinks.write_article_info(arts, out)
    sinks.write_topics(topics, out)
    sinks.write_topics_json(topics, out)
    a, _ = sinks.combine_outputs(spark, out, data)
    back = (spark.read.schema("Year int, Category string, id long, url string, title string, sentiment string")
            .option("header", True).option("escape", '"').option("multiLine", True).csv(a))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    topics_object = json.loads(one_file(f"{out}/json/topics/Year=2020/Category=007"))
    entry = {"Topic Name": ["a"], "Keywords": ["a\nb"], "Articles": [0], "Sentiment": "Neutral"}
    assert topics_object == {"0": {"0": entry, "1": entry}}


def test_triples_by_topic(spark, tmp_out):
    rows = [(2020, "en", 0, 1, "s", "r", "t", a, s, "Neutral") for a, s in ((2, 0), (1, 1), (1, 0))]
    rows.append((2020, "en", 0, 2, "x", "y", "z", 1, 0, "Positive"))
    triples = spark.createDataFrame(
        rows, "Year int, Category string, ClusterId int, topicId int, source string, relation string, "
        "target string, articleId long, sent_id int, sentiment string")
    c, j = sinks.write_triples(triples, f"{tmp_out}/out")
    got = json.loads(one_file(f"{j}/Year=2020/Category=en/ClusterId=0"))
    assert [t["articleId"] for t in got["1"]] == [1, 1, 2] and got["2"] == [
        {"source": "x", "relation": "y", "target": "z", "articleId": 1, "sentiment": "Positive"}]
    assert spark.read.option("header", True).csv(c).count() == 4
