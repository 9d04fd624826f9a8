"""Malformed markup: every case of the module's list, with its result."""

import time

import pytest
from pyspark.sql import functions as F

from crowdrank.functions.markup import STRETCH, strip_elements

TABLE = [
    # links: nested, never closed, closed by what is around them
    ("<a>one<a>two</a>three</a>four", "four"),
    ("x<a href='q'>never closed", "x"),
    ("<p>k<a>gone</p>kept", "kkept"),
    ("<div><a>x<div>y</div>z</div>w", "w"),
    ("<a>x</b>y</a>z", "z"),
    ("<b><a>x</b>y</a>z", "yz"),
    ("<a/>t", "t"),
    ("<A HREF=x>t</A>u", "u"),
    ("</a>t", "t"),
    ("<abbr>t</abbr>", "t"),
    ("<a><br>x</br>y</a>z", "z"),
    ("<p><p><a>x</p>y</p>z", "yz"),
    # attribute values
    ('<b title="a>b">t</b>', "t"),
    ("<b data-x='</b>'>t</b>", "t"),
    ('<a title=x="y>z">u</a>v', "v"),
    ("<p a=>t", "t"),
    ("<p it's>t", "t"),
    ('<a title="q>t', ""),
    # never closed
    ("a<!-- open", "a"),
    ("a<b", "a"),
    ("a<style>p{}", "a"),
    ("<![CDATA[x", "x"),
    # what is no tag
    ("1 < 2", "1 < 2"),
    ("<", "<"),
    ("<<a>x</a>y", "<y"),
    ("a</>b", "ab"),
    ("a</ x>b", "ab"),
    ("<!doctype html>t", "t"),
    ("<?xml?>t", "t"),
    ("<!-->t", "t"),
    ("<!-- a > b --!>t", "t"),
    # code and sections
    ('a<script>if(a<b && c="</p>")</script>b', "ab"),
    ("a<SCRIPT src='>'>x</a></Script >b", "ab"),
    ("<scripty>t</scripty>", "t"),
    ("<![CDATA[x<y]]>z", "x<yz"),
    ("<a><![CDATA[x<y]]></a>z", "z"),
    # nothing to do
    ("plain", "plain"), ("", ""), (None, None), ("a<i>b</i>c", "abc"),
]


def test_the_table(spark):
    rows = spark.createDataFrame(TABLE, "markup string, want string").withColumn("got", strip_elements(F.col("markup")))
    assert [(r.markup, r.got) for r in rows.collect()] == TABLE


def test_stretches_meet(spark):
    rows = [(k, "<p>" + "<i>t</i>" * k + "<a>" + "<i>no</i>" * k + "</a>" + "u</p>") for k in range(STRETCH + 2)]
    got = spark.createDataFrame(rows, "k int, markup string").select("k", strip_elements(F.col("markup")).alias("got"))
    assert all(r.got == "t" * r.k + "u" for r in got.collect())


@pytest.mark.parametrize("unit", ["<p>x<a href='q>r'>y</a></p>", "<li>x<a>y</a>"])
def test_long_pages_take_time_in_proportion(spark, unit):
    def seconds(n):
        page = spark.createDataFrame([(unit * n,)], "markup string")
        start = time.time()
        assert page.select(F.length(strip_elements(F.col("markup")))).first()[0] == n
        return time.time() - start

    seconds(100)
    assert seconds(40_000) < 20 * max(seconds(10_000), 0.2)


def test_markup_stays_native(spark):
    plan = spark.createDataFrame([("<a>",)], "t string").select(strip_elements(F.col("t")))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
