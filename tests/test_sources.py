"""Landed JSON pages, CSV sink/scan, stage materialisation."""

import io

import pandas as pd
import pytest
from pyspark.sql import functions as F

from crowdrank.session import scratch_path
from crowdrank.sources import files as FS
from crowdrank.sources import landed as LD


def test_comment_pages_round_trip(spark):
    rows = [("v1", i, f"c{i}", "ann", f"text {i}", i) for i in range(250)] + [("v2", 0, "x", None, None, None)]
    comments = spark.createDataFrame(
        rows, "video_id string, position bigint, comment_id string, author string, text string, like_count bigint"
    )
    path = scratch_path(spark, "test-comments")
    LD.land_comments(comments, path)
    raw = spark.read.json(path)
    assert raw.select(F.max(F.size("items"))).first()[0] <= LD.COMMENTS_PAGE
    back = LD.read_comments(spark, path)
    got = sorted((r["video_id"], r["page"] * LD.COMMENTS_PAGE + r["item_pos"], r["comment_id"], r["text"], r["like_count"])
                 for r in back.collect())
    want = sorted((v, p, c, t, lk) for v, p, c, a, t, lk in rows)
    assert got == want


def test_search_and_details_round_trip(spark):
    listing = spark.createDataFrame(
        [("q", i, i, f"title {i}") for i in range(120)], "query string, position bigint, video_id bigint, title string"
    )
    details = spark.createDataFrame(
        [(i, f"title {i}", f"PT{i}M", 10 * i, i, None) for i in range(120)],
        "video_id bigint, title string, iso_duration string, view_count bigint, like_count bigint, comment_count bigint",
    )
    sp, dp = scratch_path(spark, "test-search"), scratch_path(spark, "test-details")
    LD.land_search(listing, sp)
    LD.land_details(details, dp)
    s = LD.read_search(spark, sp)
    assert s.count() == 120
    assert {r["video_id"] for r in s.collect()} == {str(i) for i in range(120)}
    d = {r["video_id"]: r for r in LD.read_details(spark, dp).collect()}
    assert d["7"]["iso_duration"] == "PT7M" and d["7"]["view_count"] == 70 and d["7"]["comment_count"] is None


def test_csv_round_trip_keeps_quotes_newlines_and_nulls(spark):
    rows = [(1, 'say "hi"\nnext line', "  padded  "), (2, None, ""), (3, "a,b", "x")]
    df = spark.createDataFrame(rows, "id bigint, text string, other string")
    path = scratch_path(spark, "test-csv")
    assert FS.write_csv(df, path) == 3
    back = {r["id"]: r for r in FS.read_csv(spark, path, df.schema).collect()}
    assert back[1]["text"] == 'say "hi"\nnext line'
    assert back[1]["other"] == "  padded  "
    assert back[2]["text"] is None
    assert back[3]["text"] == "a,b"


def test_csv_empty_and_missing(spark):
    empty = spark.createDataFrame([], "id bigint")
    assert FS.write_csv(empty, scratch_path(spark, "test-empty")) == 0
    missing = scratch_path(spark, "does-not-exist")
    assert FS.read_csv(spark, missing, empty.schema, missing_ok=True) is None
    with pytest.raises(FileNotFoundError):
        FS.read_csv(spark, missing, empty.schema)


def test_materialize_and_names(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    m = FS.materialize(df, "test-stage")
    assert sorted(r["x"] for r in m.collect()) == list(range(0, 20, 2))
    assert FS.stage_name("Mozart Violin Sonata", "video_scores", ".csv") == "Mozart_Violin_Sonata_video_scores.csv"


def test_csv_with_bom_reads_back(spark):
    import glob

    df = spark.createDataFrame([(1, 'a "q", b'), (2, "line\nbreak"), (3, None)], "id bigint, text string")
    path = scratch_path(spark, "csv-bom")
    assert FS.write_csv(df.repartition(2), path, bom=True) == 3
    parts = sorted(glob.glob(f"{path.removeprefix('file:')}/part-*.csv"))
    assert parts and all(open(p, "rb").read(3) == b"\xef\xbb\xbf" for p in parts)
    back = FS.read_csv(spark, path, df.schema)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == sorted(map(tuple, df.collect()), key=lambda r: r[0])


def test_an_empty_input_writes_nothing_and_keeps_an_earlier_output(spark, tmp_path):
    path, none = str(tmp_path / "out"), spark.createDataFrame([], "a int, b string")
    assert FS.write_csv(none, path) == 0 and list(tmp_path.iterdir()) == []
    assert FS.write_ordered_csv(none, path, ["a"]) == 0 and list(tmp_path.iterdir()) == []
    some = spark.createDataFrame([(2, "x"), (1, "y")], "a int, b string")
    assert FS.write_csv(some, path) == 2
    assert FS.write_csv(none, path) == 0
    assert FS.read_csv(spark, path, some.schema).count() == 2
    assert FS.write_csv(some.limit(1), path) == 1 and FS.read_csv(spark, path, some.schema).count() == 1
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_parts_in_manifest_order_are_the_sorted_file(spark, tmp_path):
    rows = [(k * 37 % 500, f'line "{k}"\nwith, commas  ', None if k % 9 == 0 else " é ") for k in range(500)] + [(None, "n", "m")]
    df = spark.createDataFrame(rows, "a int, b string, c string").repartition(7)
    path = str(tmp_path / "ordered")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert FS.write_ordered_csv(df, path, ["a"]) == 501
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    manifest = FS.order_manifest(spark, path)
    assert len(manifest["parts"]) > 3 and sum(n for _, n in manifest["parts"]) == 501
    back = FS.read_ordered_csv(spark, path).orderBy("row_number").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    assert [tuple(r) for r in back] == [(k, *r) for k, r in enumerate(want)]
    joined = manifest["header"] + "\n" + "".join((tmp_path / "ordered" / name).read_text() for name, _ in manifest["parts"])
    table = pd.read_csv(io.StringIO(joined), keep_default_na=False, na_values=[""])
    assert table["b"].tolist() == [r[1] for r in want]
    with pytest.raises(FileNotFoundError):
        FS.read_ordered_csv(spark, str(tmp_path / "nowhere"))
