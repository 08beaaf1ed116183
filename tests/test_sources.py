import json

from pyspark.sql import functions as F

from pairlab.sources import files, html_tables, json_docs
from pairlab.streaming.incremental import ingest_new_contests

PAGE = """<table class="other"><tr><td>x</td></tr></table>
<table id="t" class="tr-table big"><thead><tr><th>Rank</th></tr></thead><tbody>
<tr><td>1</td><td data-sort="Acme &amp; Co">Acme</td><td data-sort="1.5">1.5%</td><td>--</td></tr>
<tr><td>2</td><td><a href="#"> Beta </a></td><td>2</td></tr>
<tr><td>3</td><td>short</td></tr>
</tbody></table>"""


def game(number, state="final", text="First Round", **away):
    side = {"seed": "4", "score": "70", "winner": True, "names": {"short": "A", "seo": "a"}}
    return {"game": {"gameID": str(number), "bracketRound": text, "gameState": state,
                     "away": {**side, **away}, "home": {"names": {"short": "H"}}}}


def test_flatten_contests(spark, rows):
    body = json.dumps({"games": [game(1), game(2, state="live"), game(3, text=""), game(4, seed="x", score=None)]})
    df = spark.createDataFrame([(body, "2024/03/20"), ("not json", "2024/03/21")], "body string, day string")
    got = rows(json_docs.flatten_contests(df, "body", "day"), "game_id")
    assert [g[0] for g in got] == ["1", "4"]
    first, last = [dict(zip(json_docs.flatten_contests(df, "body", "day").columns, g)) for g in got]
    assert first["date"] == "2024/03/20" and first["bracket_region"] == ""
    assert (first["away_seed"], first["away_score"], first["away_winner"]) == (4, 70, True)
    assert (first["home_seed"], first["home_score"], first["home_winner"], first["home_seo"]) == (None, 0, False, "")
    assert (last["away_seed"], last["away_score"]) == (None, 0)


def test_directory_shapes(spark, rows):
    docs = [
        (1, '[{"name":"A B","slug":"ab"},{"short":"C","seo":"c"},{}]'),
        (2, '["A B","C"]'),
        (3, '{"ab":"A B","c":{"name":"C"},"d":{}}'),
    ]
    df = spark.createDataFrame(docs, "doc int, body string")
    got = rows(json_docs.directory_entries(df, "body", "doc"), "doc", "pos")
    assert got == [
        (1, 1, "A B", "ab"), (1, 2, "C", "c"), (1, 3, "", ""),
        (2, 1, "A B", "a-b"), (2, 2, "C", "c"),
        (3, 1, "A B", "ab"), (3, 2, "C", "c"), (3, 3, "d", "d"),
    ]


def test_stat_rows(spark, rows):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>no table</p>"), (3, None)], "id int, html string")
    variants = ["season", "last3", "last1"]
    jvm = html_tables.stat_rows(html_tables.html_cells(df, "id", "html", "tr-table"), "id", variants)
    tolerant = html_tables.stat_rows(html_tables.html_cells_tolerant(df, "id", "html", "tr-table"), "id", variants)
    want = [(1, 0, "Acme & Co", 1.5, None, None), (1, 1, "Beta", 2.0, None, None)]
    assert rows(jvm, "row_pos") == want
    assert rows(tolerant, "row_pos") == want
    unclosed = df.withColumn("html", F.regexp_replace("html", "</t[dr]>", ""))
    again = html_tables.stat_rows(html_tables.html_cells_tolerant(unclosed, "id", "html", "tr-table"), "id", variants)
    assert rows(again, "row_pos") == want


def test_record_rows(spark, rows):
    page = (
        "<table><tr><th>h</th></tr>"
        "<tr><td>Conference</td><td>1</td><td>1-2</td><td>.5</td></tr>"
        "<tr><td>Big</td><td>3</td><td>18-x</td><td>0.75</td><td>Lead</td><td>9</td></tr>"
        "<tr><td>Small</td><td>?</td><td>7</td><td>n</td></tr><tr><td>a</td><td>b</td></tr></table>"
    )
    df = spark.createDataFrame([(1, page)], "id int, html string")
    cells = html_tables.html_cells(df, "id", "html", body_required=False)
    got = rows(html_tables.record_rows(cells, "id").drop("row_pos"), "name")
    assert got == [(1, "Big", 3, 18, None, 0.75, "Lead", 9), (1, "Small", None, None, None, None, None, None)]


def test_periods_from_paths(spark, rows, tmp_path):
    for year, columns in ((2019, "id long, x int"), (2021, "id long, x double, extra string")):
        row = (year, 1) if year == 2019 else (year, 0.5, "e")
        spark.createDataFrame([row], columns).write.parquet(str(tmp_path / str(year)))
    parts = [spark.read.parquet(str(tmp_path / str(y))) for y in (2019, 2021)]
    joined = files.union_diagonal([files.with_period(p, y) for p, y in zip(parts, (2019, 2021))])
    assert rows(joined.select("id", "x", "extra", "period"), "id") == [(2019, 1.0, None, 2019), (2021, 0.5, "e", 2021)]


def test_scan_periods_reads_the_path(spark, rows, tmp_path):
    for year in (2019, 2021):
        spark.createDataFrame([(year * 10,)], "v int").write.parquet(str(tmp_path / str(year)))
    assert rows(files.scan_periods(spark, str(tmp_path)).select("v", "period"), "v") == [(20190, 2019), (20210, 2021)]


def test_partition_filter_prunes(spark, tmp_path):
    path = str(tmp_path / "out")
    files.write_parquet(spark.range(100).withColumn("period", F.col("id") % 4), path, ["period"])
    plan = files.scan_partitioned(spark, path).filter("period = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(period" in plan


def test_grids(spark, rows):
    years = spark.createDataFrame([(2023,), (2024,)], "year int")
    assert files.date_grid(years, [("03-13", "03-31"), ("04-01", "04-10")]).count() == 2 * 29
    cut = spark.createDataFrame([(2023, "2023-03-13")], "year int, cutoff string")
    grid = files.request_grid(years, ["a", "b"], cut)
    assert rows(grid, "item") == [(2023, "a", "2023-03-13"), (2023, "b", "2023-03-13")]
    done = spark.createDataFrame([(2023, "a")], "year int, item string")
    assert rows(files.incremental_todo(grid, done, ["year", "item"])) == [(2023, "b", "2023-03-13")]


def test_incremental_stream_reads_new_files_once(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps({"games": [game(1)]}))
    ingest_new_contests(spark, source, target, state).awaitTermination()
    (tmp_path / "in" / "2.json").write_text(json.dumps({"games": [game(2), game(3, state="live")]}))
    ingest_new_contests(spark, source, target, state).awaitTermination()
    ids = sorted(r[0] for r in spark.read.parquet(target).select("game_id").collect())
    assert ids == ["1", "2"]
