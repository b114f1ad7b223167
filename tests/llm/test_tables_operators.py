"""WARC derivatives, top-k search, the SQL statements of the operators, and the pipeline."""

import tempfile
import time

import duckdb
import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from envspark.llm import topk, warc
from envspark.llm.catalog import ORACLE, QUERIES
from envspark.session import read_table
from tools.check_oracle import rows_of


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    got, want = QUERIES[name](spark, SMALL).toPandas(), con.sql(ORACLE[name]).df()
    want = want.astype(object).where(want.notna(), None)
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_warc_records_link_and_round_trip(spark):
    pages = spark.createDataFrame([
        (1, "http://a/", "<html><title>T &amp; U</title><p>one<br>two</p><!-- x --><script>no</script><a href=\"/x?a=1&amp;b\">y</a> &amp;lt;", 5),
        (1, "http://a/", "<p>again</p>", 5), (None, None, None, 5), (3, "u", "", 5), (4, "u", "<" * 3000 + "日本 🙂", 5)],
        "page_id bigint, url string, html string, content int")
    rows = warc.derivatives(warc.responses_of_pages(pages), "page_id").collect()
    assert len(rows) == 10
    by = {r.record_id: r for r in rows}
    assert len(by) == 10 and all(by[r.linked_id].linked_id == r.record_id and by[r.linked_id].refers_to == r.refers_to for r in rows)
    first = next(r for r in rows if r.record_type == "conversion" and "one" in r.content)
    assert first.content == "T & U\none\ntwo\ny &lt;"
    about = by[first.linked_id].content
    assert "outlink: /x?a=1&b\r\n" in about and "title: T & U\r\n" in about and f"source-WARC-Record-ID: {first.refers_to}" in about
    path = tempfile.mkdtemp(prefix="warc-", dir="/tmp") + "/w"
    records = warc.derivatives(warc.responses_of_pages(pages), "page_id")
    warc.write_warc(records, path)
    back = warc.read_records(spark, path)
    assert sorted(r.content for r in back.collect()) == sorted(r.content for r in rows)
    assert warc.derivatives(warc.responses_of_pages(pages.limit(0))).count() == 0


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_records_are_read_by_their_length(spark, compression):
    bodies = ["WARC/1.1\r\nWARC-Type: fake\r\nContent-Length: 3\r\n\r\nabc", "", "two\r\n\r\nlines 日本\n", "WARC/1.1\r\n", "x" * 3_000_000]
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<pre>{b}</pre>") for i, b in enumerate(bodies)], "page_id bigint, url string, html string")
    records = warc.derivatives(warc.responses_of_pages(pages))
    contents = {f"http://h/{i}": b for i, b in enumerate(bodies)}
    table = F.create_map(*[F.lit(x) for kv in contents.items() for x in kv])
    body = F.when(F.col("record_type") == "conversion", table[F.col("target_uri")]).otherwise(F.col("content"))
    records = records.withColumn("content", body).withColumn("content_length", F.octet_length("content"))
    path = tempfile.mkdtemp(prefix="warc-", dir="/tmp") + "/w"
    warc.write_warc(records, path, compression)
    want = sorted(r.content for r in records.collect())
    assert sorted(r.content for r in warc.read_records(spark, path).collect()) == want
    kept = warc.read_records(spark, path).where("content like 'WARC/1.1%fake%'").first()
    assert "WARC-Type: conversion" in kept.headers


def test_warc_pages_with_endless_markup_are_read_once(spark):
    pages = spark.createDataFrame([(1, "u", "a<!-- x " * 120_000), (2, "u", "b<script>x " * 90_000), (3, "u", "<a x " * 200_000)],
                                  "page_id bigint, url string, html string")
    start = time.perf_counter()
    got = {r.page_id: r.content for r in warc.derivatives(warc.responses_of_pages(pages), "page_id").where("record_type = 'conversion'").collect()}
    assert time.perf_counter() - start < 30
    assert got[1] == "a" and got[2] == "b"


def test_warc_other_media_have_metadata_only(spark):
    rows = warc.responses_of_pages(spark.createDataFrame([(1, "u", "x")], "page_id int, url string, html string"))
    rows = rows.selectExpr("* except (http_header)", "replace(http_header, 'text/html', 'image/png') as http_header")
    out = warc.derivatives(rows).collect()
    assert [(r.record_type, r.linked_id) for r in out] == [("metadata", None)]


def plain_top(rows, k, every):
    out = []
    for i, q in rows:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(600)]
    data += [(700 + i, data[0][1]) for i in range(40)]  # ties
    table = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    rows = topk.integer_vectors(table)
    plain = [(r.vec_id, r.v) for r in rows.collect()]
    for block in (64, 10_000):
        got = topk.top_k(rows, rows.where("vec_id % 50 = 0"), 5, block)
        assert sorted(map(tuple, got.collect())) == plain_top(plain, 5, 50)


def test_top_k_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, [3.0]), (6, []),
            (None, [1.0, 1.0]), (7, [1e9, -1e9]), (50, [0.0, 0.0]), (100, []), (8, [2.0, 1.0])]
    table = spark.createDataFrame([(*r, 1, 2) for r in data], "vec_id bigint, embedding array<double>, score int, v int")
    rows = topk.integer_vectors(table)
    got = sorted(map(tuple, topk.top_k(rows, rows.where("vec_id % 50 = 0")).collect()))
    plain = [(0, [256, 512]), (5, [768]), (6, []), (7, [256 * 10**9, -256 * 10**9]), (50, [0, 0]), (100, []), (8, [512, 256])]
    assert got == plain_top(plain, 5, 50)
    none = topk.integer_vectors(table.limit(0))
    assert topk.top_k(none, none).count() == 0


def test_pipeline_stages_take_effect(spark):
    docs = read_table(spark, SMALL, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SMALL)
        docs = docs.checkpoint() if spark.sparkContext.getCheckpointDir() else docs
        assert docs.columns == columns and docs.dtypes == before.dtypes, name
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[3] and sizes[3] == sizes[4]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert pieces.select("doc_id").distinct().count() == sizes[4]


def test_pipeline_on_empty_and_awkward_rows(spark):
    docs = read_table(spark, SMALL, "documents").selectExpr("*", "doc_id AS score")
    empty = docs.limit(0)
    odd = spark.createDataFrame([(None, None, None, None, None, None), (5, "", "en", "s", 0, 1), (5, "", "en", "s", 0, 1)], docs.schema)
    for rows in (empty, odd):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SMALL)
            assert out.count() <= max(2 * rows.count(), 0)
            assert name == "packing" or out.columns == rows.columns


def test_warc_links_and_references_by_the_html_rules(spark):
    html = ("<title>Caf&eacute; &#8217;&#x27;</title><!-- <a href=\"no\">x</a> --><script>'<a href=\"no2\">'</script>"
            "<a href='one'>a</a><A title='2 > 1' data-href=\"no3\" HREF = two>b</A><a class=\"<x>\" href=\"?a=1&amp;b=2&copy=3\">c</a>"
            "<a href='say \"&#x69;&#10;'>d</a><abbr href='no4'>&amp;lt; &notin; &notit; &copy 2 &#0;&#x110000;&#128;&#128512;&unknown; AT&T</abbr>")
    page = spark.createDataFrame([(1, "http://a.b/", html)], "page_id bigint, url string, html string")
    got = {r.record_type: r.content for r in warc.derivatives(warc.responses_of_pages(page), "page_id").collect()}
    lines = got["metadata"].split("\r\n")
    assert [x[9:] for x in lines if x.startswith("outlink: ")] == ["one", "two", "?a=1&b=2&copy=3", 'say "i']
    assert "title: Caf\xe9 \u2019'" in lines
    assert "&lt; \u2209 \xacit; \xa9 2 \ufffd\ufffd\u20ac\U0001f600&unknown; AT&T" in got["conversion"]
