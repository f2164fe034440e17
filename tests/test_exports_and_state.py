"""Committed exports, mergeable sketches, ordered cuts and keyed streaming state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliant.operators import links, sketches
from foliant.plans.skew import first_in_order
from foliant.sources import markdown_files
from foliant.streaming import keyed


def test_first_in_order(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v")).repartition(5)
    for n in (0, 1, 713, 5000, 9000):
        want = sorted((v % 7, v) for v in range(5000))[:n]
        assert sorted((r.k, r.v) for r in first_in_order(rows, ["k", "v"], n).collect()) == want


def test_walk_budget_cuts_the_crossing_level(spark):
    edges = spark.createDataFrame([("r", f"n{i:03d}") for i in range(300)] + [("n000", "z")], "src string, dst string")
    seeds = spark.createDataFrame([("r",)], "node string")
    got = {r.node: r.depth for r in links.frontier(seeds, edges, budget=120).collect()}
    assert got == {"r": 0, **{f"n{i:03d}": 1 for i in range(119)}}
    assert links.frontier(seeds, edges, budget=301).count() == 301 and links.frontier(seeds, edges, budget=900).count() == 302
    assert links.frontier(seeds, edges, budget=0).count() == 0


def test_sketches_merge_to_what_one_sketch_gives(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 2).alias("k"), F.timestamp_add("HOUR", F.col("id") % 240, F.lit("2024-01-01").cast("timestamp_ntz")).alias("at"),
        (F.col("id") % 20_000).alias("s"), (F.col("id") / 10).alias("v"))
    rows = rows.unionByName(spark.range(3).select(F.lit(0).cast("long").alias("k"), F.lit("2024-01-01").cast("timestamp_ntz").alias("at"),
                                                  F.lit(None).cast("long").alias("s"), F.lit(None).cast("double").alias("v")))
    days = sketches.daily(rows, ["k"], "at", "s", "v")
    assert days.count() == 20
    got = {r.k: r for r in sketches.estimates(sketches.merged(days, ["k"])).collect()}
    assert got[0].n == 30_003 and got[1].n == 30_000
    for r in got.values():
        assert abs(r.n_sessions / 10_000 - 1) <= sketches.COUNT_ERROR
        assert abs(r.q95 / 6000 - 0.95) <= sketches.RANK_ERROR + 1e-3 and abs(r.q50 / 6000 - 0.5) <= sketches.RANK_ERROR + 1e-3
    one = sketches.merged(days, ["k"], F.lit("2024-01-03").cast("date"), F.lit("2024-01-03").cast("date"))
    assert {r.n for r in one.collect()} == {3000}
    assert sketches.merged(days, ["k"], F.lit("2030-01-01").cast("date")).collect() == []


def test_exports_are_committed_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "md")
    rows = spark.createDataFrame([(f"f{i} ñ.md", f"# título {i}\ntexto\n") for i in range(50)], "file_name string, text string").repartition(4)
    markdown_files.write_markdown(rows, path)
    assert sorted(map(tuple, markdown_files.read_markdown(spark, path).collect())) == sorted(map(tuple, rows.collect()))

    broken = rows.withColumn("text", F.when(F.col("file_name") == "f7 ñ.md", F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        markdown_files.write_markdown(broken, path)
    assert markdown_files.read_markdown(spark, path).count() == 50  # nothing of the failed job
    (tmp_path / "md" / "left-by-a-dead-attempt").mkdir()
    (tmp_path / "md" / "left-by-a-dead-attempt" / "x.md").write_text("no")
    markdown_files.write_markdown(rows.limit(1), path)
    assert markdown_files.read_markdown(spark, path).count() == 51
    markdown_files.write_markdown(rows.limit(2), path, "overwrite")
    assert markdown_files.read_markdown(spark, path).count() == 2
    assert markdown_files.read_markdown(spark, str(tmp_path / "none")).collect() == []


def test_exports_are_read_without_a_file_list_on_the_driver(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "md")
    rows = spark.range(60).select(F.format_string("f%03d.md", "id").alias("file_name"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    more = [("empty.md", ""), ("a+b.md", "plus"), ("_hidden.md", "no"), ("_x=1.md", "yes"), ("100%20.md", "línea\r\n")]
    rows = rows.unionByName(spark.createDataFrame(more, rows.schema))
    markdown_files.write_markdown(rows.repartition(3), path)
    monkeypatch.setattr(markdown_files, "TASK_FILES", 7)
    monkeypatch.setattr(markdown_files, "BATCH_BYTES", 20)
    back = markdown_files.read_markdown(spark, path)
    assert not back.inputFiles()  # no index of single files
    want = {(r.file_name.replace("+", " "), r.text) for r in rows.collect() if r.text and r.file_name != "_hidden.md"}
    got = [tuple(r) for r in back.collect()]
    assert len(got) == len(want) and set(got) == want

    folders = markdown_files.committed(spark, path)
    reader = markdown_files.MarkdownReader(path, folders)
    parts = reader.partitions()
    assert len(parts) == sum(-(-n // 7) for n in folders.values())
    assert {x for p in parts for b in reader.read(p) for x in zip(*b.to_pydict().values(), strict=True)} == want
    markdown_files.write_markdown(rows.limit(1), path)
    assert back.count() == len(want)  # of the files committed when it was made


def arrive(spark, rows, schema, folder, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/p{n}")
    return spark.readStream.schema(schema).parquet(f"{folder}/*")


def run(df, base):
    q = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return q.recentProgress


def test_decisions_across_batches_and_restarts(spark, tmp_path):
    schema = "doc_id long, source_id string, content_hash string, canonical_url string, payload string"
    steps = [
        [(3, "s", "h1", "u1", "p3"), (1, "s", "h1", "u2", "p1"), (2, "t", "h1", "u3", "p2"), *((100 + i, "s", "hot", f"v{i}", "p") for i in range(40))],
        [(4, "s", "h1", "u2", "p4"), (5, "s", "h2", "u2", "p5"), (6, "s", "h1", "u9", "p6"), (7, "s", "h3", "u1", "p7")],
    ]
    keyed.keyed_state(spark)
    for n, rows in enumerate(steps):
        run(keyed.ingest_decisions(arrive(spark, rows, schema, tmp_path / "in", n)), tmp_path)
    got = {r.doc_id: (r.decision, r.same_as_url, r.payload) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    other = "duplicate_content_other_url"
    assert {k: got[k] for k in (1, 2, 3, 4, 5, 6, 7)} == {
        1: ("saved", None, "p1"), 2: ("saved", None, "p2"), 3: (other, "u2", None), 4: ("duplicate_content", None, None),
        5: ("updated", None, "p5"), 6: (other, "u2", None), 7: ("updated", None, "p7")}  # u1 was seen with a copy
    assert got[100] == ("saved", None, "p") and all(got[100 + i] == (other, "v0", None) for i in range(1, 40))
    assert len(got) == 47


def test_idle_sessions_leave_the_state(spark, tmp_path):
    schema = "session_id string, created_at timestamp"
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    first = [(f"s{i}", at(i + k)) for i in range(30) for k in (0, 5, 20)] + [("s0", at(90))]
    keyed.keyed_state(spark)
    sizes = []
    for n, rows in enumerate([first, [("later", at(600))], [("last", at(2000))]]):
        progress = run(keyed.closed_sessions(arrive(spark, rows, schema, tmp_path / "in", n), 30 * 60_000, "10 minutes"), tmp_path)
        sizes += [x["stateOperators"][0]["numRowsTotal"] for x in progress if x["stateOperators"]]
    rows = {(r.session_id, r.started_at, r.ended_at, r.turns) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {(f"s{i}", at(i), at(i + 20), 3) for i in range(30)} | {("s0", at(90), at(90), 1), ("later", at(600), at(600), 1)}
    assert max(sizes) >= 30 and 0 < sizes[-1] <= 2  # in the end only what is not idle yet


def test_links_pass_once(spark, tmp_path):
    schema = "page_id long, url string, html string"
    steps = [[(2, "https://h.org/b", "<a href='/x'>1</a><a href='/y'>2</a>"), (1, "https://h.org/a", "<a href='/x'>1</a>")],
             [(0, "https://h.org/c", "<a href='/x'>1</a><a href='/z'>2</a><a href=''>3</a>")]]
    for n, rows in enumerate(steps):
        run(keyed.first_links(arrive(spark, rows, schema, tmp_path / "in", n)), tmp_path)
    got = {r.dst_url: (r.first_page_id, r.first_position) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"https://h.org/x": (1, 0), "https://h.org/y": (2, 1), "https://h.org/z": (0, 1)}
