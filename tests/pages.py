"""Small hand-made inputs."""

from pyspark.sql import functions as F

from pagemill.operators.parse import parse_html

PAGE_URL = "http://example.com/dir/page.html"


def page_frame(spark, *htmls, url=PAGE_URL):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def nodes_of(spark, *htmls, url=PAGE_URL):
    return parse_html(page_frame(spark, *htmls, url=url))


def by_page(df, *columns):
    rows = df.select("page_id", *columns).collect()
    return {r[0]: r[1] if len(columns) == 1 else tuple(r[1:]) for r in rows}


def one_column(spark, values, function, name="x"):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r[0] for r in df.select(function(F.col("x")).alias("y"), "i").orderBy("i").collect()]
