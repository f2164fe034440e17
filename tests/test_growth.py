"""Work that must grow no faster than its input, and the same results as the plain forms."""

import re
import time

from pyspark.sql import functions as F


def plain_year_block(text, year, years):
    """The stretch by its definition: every label of the year up to the next label of a later one."""
    every = "|".join(x for _, labels in years for x in labels)
    pieces = [p for p in re.split(f"(?i)(?={every})", text) if p]
    of = [next((y for y, labels in years if p.lower().startswith(tuple(labels))), None) for p in pieces]
    best = None
    for i, y in enumerate(of):
        if y == year:
            end = next((j for j in range(i + 1, len(of)) if of[j] is not None and of[j] > year), len(of))
            b = "".join(pieces[i:end])
            n = lambda p: len(re.findall(p, b.lower()))  # noqa: B023, E731
            s = (n(r"(?:^|\n)\s*(?:materia|asignatura)\s*:") * 7 + n(r"\b(?:semestre|cuatrimestre)\b") * 2
                 + n(r"(?:^|\n)\s*(?:[-*]\s+|\d{1,2}[.)]\s+)") + min(len(b) // 500, 4))
            best = max(best or (-1,), (s, len(b), -i, b))
    return best and best[3]


def test_best_year_block_is_the_plain_one(spark):
    import random

    from foliant.functions import facts as FX

    rng = random.Random(3)
    words = ["primero", "segundo", "tercero", "\n- ", "\n", " ", "1. ", "- ", "materia", ":", "semestre", "x", "\n2) ", "cuatrimestre "]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for years in (((1, ("primero",)), (2, ("segundo",)), (3, ("tercero",))),
                  ((1, ("materia", "1.")), (2, ("semestre", "- ")), (3, ("tercero",)))):  # labels that score where a block begins
        rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("ps", FX.year_pieces(F.col("t"), years))
        got = rows.select("id", *[FX.best_year_block(F.col("ps"), y, years).alias(f"y{y}") for y, _ in years]).collect()
        for r in got:
            assert [r[f"y{y}"] for y, _ in years] == [plain_year_block(texts[r["id"]], y, years) for y, _ in years]


def test_year_blocks_of_a_text_full_of_labels(spark, tmp_path):
    from catalog.curriculum import year_blocks

    text = "a" + " the x of y" * 12_000 + " and z"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    begin = time.time()
    got = {r["year"]: r["n_chars"] for r in year_blocks(spark, str(tmp_path)).collect()}
    assert got == {1: 6, 2: len(text) - len("a the x and z"), 3: 6}
    assert time.time() - begin < 60  # the squared form would take hours


def test_periods_of_many_sessions_in_one_batch(spark, tmp_path):
    """Every session costs a few bytes of state, no call of its own; a message ``idle`` after the last still belongs to it."""
    import datetime as dt

    from foliant.streaming import keyed

    n, start = 40_000, dt.datetime(2024, 1, 1)
    at = lambda s: F.lit(start) + F.make_dt_interval(secs=F.lit(s))
    times = F.array(at(0), at(1800), at(3600.000001), at(3600.5))
    rows = spark.range(n).select(F.concat(F.lit("s"), "id").alias("session_id"), F.explode(times).alias("created_at"))
    rows.unionByName(spark.range(1).select(F.lit(None).cast("string").alias("session_id"), at(0).alias("created_at"))).write.parquet(f"{tmp_path}/in/a")
    spark.range(1).select(F.lit("end").alias("session_id"), at(900_000).alias("created_at")).write.parquet(f"{tmp_path}/in/b")
    begin = time.time()
    for _ in range(2):
        stream = spark.readStream.schema("session_id string, created_at timestamp").option("maxFilesPerTrigger", 1000).parquet(f"{tmp_path}/in/*")
        keyed.closed_sessions(stream, 30 * 60_000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
            "checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    got = {(r.started_at - start, r.ended_at - start, r.turns): r["count"] for r in out.groupBy("started_at", "ended_at", "turns").count().collect()}
    d = lambda s: dt.timedelta(seconds=s)
    assert got == {(d(0), d(1800), 2): n, (d(3600.000001), d(3600.5), 2): n, (d(0), d(0), 1): 1}
    assert time.time() - begin < 60


def test_html_pages_are_parsed_a_part_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from foliant.operators import cleaning

    rows, seen = spark.createDataFrame([(1, "x")], "page_id long, html string"), {}
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema: (seen.update(f=f), self)[1])
    cleaning.html_to_text(rows)
    page = "<title>t</title><main><p>a" + "b" * 1_500_000 + "</p></main>"
    out = list(seen["f"](iter([pa.RecordBatch.from_arrays([pa.array([*range(9)]), pa.array([page] * 8 + [None])], ["page_id", "html"])])))
    assert max(len(b) for b in out) <= 3 and [x for b in out for x in b["page_id"].to_pylist()] == [*range(9)]
    assert [x for b in out for x in b["title"].to_pylist()] == ["t"] * 8 + [""]
    assert [len(x) for b in out for x in b["text"].to_pylist()] == [1_500_001] * 8 + [0]
    assert list(seen["f"](iter([out[0].select(["page_id", "html"]).slice(0, 0)]))) is not None


def test_spans_travel_as_runs(spark):
    from foliant.operators import cleaning

    rows = [("d", 0, 0, 0, n, k, f" w{k}", s, f) for n, s, f in ((0, 18.0, 0), (1, 10.0, 16), (2, None, None)) for k in range(8)]
    rows += [("d", 0, 0, 0, 3, k, t, 14.0 if k == 5 else 10.0, 0) for k, t in ((5, "b\0"), (3, "a"), (6, "c"), (3, "A"), (None, "z"), (None, "y"), (7, None))]
    rows += [(None, 1, 0, 0, None, 0, "x", float("nan"), 0), (None, 1, 0, 0, None, 1, "\0", 1.0, 0), ("d", 0, 0, 1, 9, 0, "image", 1.0, 0)]
    spans = spark.createDataFrame(rows, "doc_id string, page int, block int, block_type int, line int, span int, text string, size double, flags int")
    for parts in (1, 5):
        got = {(r.doc_id, r.line): r.text for r in cleaning.spans_to_lines(spans.repartition(parts) if parts > 1 else spans.coalesce(1)).collect()}
        w = " ".join(f"w{k}" for k in range(8))
        assert got == {("d", 0): f"## {w}", ("d", 1): f"**{w}**", ("d", 2): w, ("d", 3): "### y z A a b\0 c", (None, None): "## x \0"}
    long = spark.range(20_000).select(F.lit("d").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("block"), F.floor(F.col("id") / 8).alias("line"),
                                      (F.col("id") % 8).alias("span"), F.lit("t").alias("text"), F.lit(1.0).alias("size"), F.lit(0).alias("bold"))
    assert cleaning._runs_of_spans(long.coalesce(1)).count() < 2_600  # one row a line and a few at the seams, no row per span
