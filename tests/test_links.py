"""Link extraction on HTML that the given pages do not hold."""

import time

from pyspark.sql import functions as F

from envspark.sources import links as LK

HTML = """<!-- <a href="gone.zip">NO2</a> --><a class=x data-href="wrong" href='one.zip?a=1&amp;b=2'>NO2 &amp; more</a>
<a href=two.zip>O3</a><a name="x">none</a><A title="a > b" HREF = "../up/./three.zip#f"><b>CO</b></a>
<a href="/../../top/.."> </a><a data-href="only">no</a><!-- <a href="open.zip">"""


def test_hrefs_of_every_kind(spark):
    pages = spark.createDataFrame([(1, "http://h.org/a/b/page.html", HTML), (2, "http://h.org", None), (3, "http://h.org", "")],
                                  "page_id int, url string, html string")
    a = LK.anchors(pages).withColumn("url", LK.resolve_url(F.col("page_url"), F.col("href")))
    got = [(r.pos, r.href, r.text, r.url) for r in a.orderBy("page_id", "pos").collect()]
    assert got == [
        (0, "one.zip?a=1&b=2", "NO2 & more", "http://h.org/a/b/one.zip?a=1&b=2"),
        (1, "two.zip", "O3", "http://h.org/a/b/two.zip"),
        (2, "../up/./three.zip#f", "CO", "http://h.org/a/up/three.zip"),
        (3, "/../../top/..", "", "http://h.org/"),
    ]


def test_awkward_markup_of_a_megabyte_is_read_once(spark):
    whole = "<a href='one.zip'>NO2</a>"
    pages = {
        "blanks": f"<a {' ' * 1_000_000} href='one.zip'>NO2</a>",
        "attributes": f"<a {'x=1 ' * 125_000}{'y=&quot;&quot; z=\'q\' ' * 50_000}href='one.zip'>NO2</a>",
        "open comments": "<!-- x " * 150_000 + "-->" + whole,
        "closed comments": "<!-- x --> " * 90_000 + whole,
        "open anchors": whole + "<a href='x'>y " * 70_000,
        "open tags": whole + "<a x " * 200_000,
        "open tags before an end": whole + "<a x " * 200_000 + "</a>",
        "hrefs without a value": f"<a {'href= ' * 100}data-href='no' href='one.zip'>NO2</a>",
    }
    df = spark.createDataFrame([(k, "http://h.org/", v) for k, v in pages.items()], "page_id string, url string, html string")
    for name in pages:
        start = time.perf_counter()
        got = [(r.href, r.text) for r in LK.anchors(df.where(F.col("page_id") == name)).collect()]
        assert time.perf_counter() - start < 6, name
        assert got == ([("href=", "NO2")] if name == "hrefs without a value" else [("one.zip", "NO2")]), name
