"""Queries on sources and sinks. Documents are derived from the tables by Spark."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlab.plans import views
from pairlab.plans.oracle_views import WITH_GAMES, WITH_STATS, r
from pairlab.plans.registry import register, rounded
from pairlab.session import read_table, scratch_path
from pairlab.sources import files, html_tables, json_docs


@register(
    "scan_parquet",
    """SELECT o_orderstatus, count(*) AS n, cast(sum(cast(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus""",
)
def scan_parquet(spark, sf):
    """Two columns are read and the filter reaches the file."""
    df = files.scan_parquet(spark, f"{sf}/orders.parquet", ["o_orderstatus", "o_totalprice"])
    return (
        df.filter(F.col("o_totalprice") > 100000)
        .groupBy("o_orderstatus")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
        )
    )


_BY_YEAR = """SELECT cast(year(o_orderdate) AS INTEGER) AS period, count(*) AS n, max(o_orderkey) AS last_key
FROM orders {where} GROUP BY ALL"""


@register("scan_partitioned", _BY_YEAR.format(where="WHERE year(o_orderdate) >= 1998"))
def scan_partitioned(spark, sf):
    """Files are laid out by period; the filter on it prunes whole folders."""
    orders = read_table(spark, sf, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("period")
    )
    path = scratch_path(spark, "orders")
    files.write_parquet(orders, path, ["period"])
    return (
        files.scan_partitioned(spark, path)
        .filter(F.col("period") >= 1998)
        .groupBy("period")
        .agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last_key"))
    )


@register(
    "scan_periods",
    """SELECT cast(year(l_shipdate) AS INTEGER) AS period, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def scan_periods(spark, sf):
    """The period is taken from the path of files that do not hold it."""
    line = read_table(spark, sf, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("y"))
    path = scratch_path(spark, "line")
    files.write_parquet(line, path, ["y"])
    tagged = files.scan_periods(spark, path, pattern=r"/y=(\d{4})/")
    return tagged.groupBy("period", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@register(
    "sink_roundtrip",
    """SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""",
)
def sink_roundtrip(spark, sf):
    path = scratch_path(spark, "customer")
    df = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    files.write_parquet(df, path, ["c_mktsegment"])
    return files.scan_partitioned(spark, path)


@register("json_sink", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def json_sink(spark, sf):
    path = scratch_path(spark, "supplier-json")
    df = read_table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    files.write_json(df, path)
    return spark.read.schema("s_suppkey bigint, s_name string, s_nationkey int").json(path)


@register(
    "json_rows",
    """SELECT s_suppkey, '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","home":' ||
    CASE WHEN s_nationkey < 5 THEN 'null' ELSE s_nationkey::VARCHAR END || '}' AS json FROM supplier""",
)
def json_rows(spark, sf):
    df = read_table(spark, sf, "supplier").select(
        "s_suppkey", "s_name", F.when(F.col("s_nationkey") >= 5, F.col("s_nationkey")).alias("home")
    )
    keyed = files.json_rows(df)
    return keyed.select(F.get_json_object("json", "$.s_suppkey").cast("bigint").alias("s_suppkey"), "json")


def _scoreboards(spark, sf):
    """One scoreboard document per block of eight orders, with unfinished and round-less contests."""
    g = views.games(spark, sf)

    def side(name):
        return F.struct(
            F.when(F.col("game_id") % 5 == 0, F.lit(""))
            .otherwise(F.col(f"{name}_seed").cast("string"))
            .alias("seed"),
            F.when(F.col("game_id") % 7 != 0, F.col(f"{name}_score").cast("int").cast("string")).alias("score"),
            F.col(f"{name}_winner").alias("winner"),
            F.struct(
                F.col(f"{name}_name").alias("short"), F.lower(F.col(f"{name}_name")).alias("seo")
            ).alias("names"),
        )

    contest = F.struct(
        F.struct(
            F.col("game_id").cast("string").alias("gameID"),
            F.col("game_date").cast("string").alias("startDate"),
            F.when(F.col("game_id") % 11 != 0, F.col("bracket_round")).otherwise(F.lit("")).alias("bracketRound"),
            F.when(F.col("game_id") % 3 != 0, F.col("bracket_region")).alias("bracketRegion"),
            F.when(F.col("game_id") % 9 == 0, F.lit("live")).otherwise(F.lit("final")).alias("gameState"),
            side("away").alias("away"),
            side("home").alias("home"),
        ).alias("game")
    )
    block = F.floor(F.col("game_id") / 8)
    return g.groupBy(block.alias("doc")).agg(
        F.to_json(F.struct(F.collect_list(contest).alias("games"))).alias("body")
    )


def _side_sql(name: str) -> str:
    return f"""{name}_name, lower({name}_name) AS {name}_seo,
    CASE WHEN game_id % 5 <> 0 THEN {name}_seed END AS {name}_seed,
    CASE WHEN game_id % 7 <> 0 THEN cast(trunc({name}_score) AS INTEGER) ELSE 0 END AS {name}_score,
    coalesce({name}_winner, false) AS {name}_winner"""


@register(
    "json_flatten",
    f"""{WITH_GAMES} SELECT game_id::VARCHAR AS game_id, game_date::VARCHAR AS date, bracket_round,
    CASE WHEN game_id % 3 <> 0 THEN bracket_region ELSE '' END AS bracket_region, {_side_sql('away')}, {_side_sql('home')}
    FROM games WHERE game_id % 11 <> 0 AND game_id % 9 <> 0""",
)
def json_flatten(spark, sf):
    return json_docs.flatten_contests(_scoreboards(spark, sf), "body")


@register(
    "valid_rows",
    f"""{WITH_GAMES} SELECT game_id % 11 = 0 AS no_round, game_id % 9 = 0 AS not_final, count(*) AS n FROM games
    WHERE game_id % 11 <> 0 AND game_id % 9 <> 0 GROUP BY ALL""",
)
def valid_rows(spark, sf):
    """Only contests with a round and a final state are left."""
    kept = json_docs.flatten_contests(_scoreboards(spark, sf), "body")
    key = F.col("game_id").cast("bigint")
    return kept.groupBy(
        (key % 11 == 0).alias("no_round"), (key % 9 == 0).alias("not_final")
    ).agg(F.count(F.lit(1)).alias("n"))


_DIRECTORY_SQL = """WITH s AS (SELECT s_suppkey, s_name, s_suppkey // 10 AS doc,
  1 + s_suppkey % 10 AS pos, (s_suppkey // 10) % 5 AS shape FROM supplier)
SELECT doc, cast(pos AS INTEGER) AS pos,
  CASE WHEN shape = 4 AND s_suppkey % 2 = 0 THEN 'k-' || s_suppkey ELSE s_name END AS name,
  CASE shape WHEN 0 THEN 'id-' || s_suppkey WHEN 1 THEN 'seo-' || s_suppkey
    WHEN 2 THEN replace(lower(s_name), ' ', '-') ELSE 'k-' || s_suppkey END AS slug FROM s"""


@register("json_directory", _DIRECTORY_SQL)
def json_directory(spark, sf):
    """Directory documents in every accepted shape, one per block of ten suppliers."""
    s = read_table(spark, sf, "supplier").select(
        F.floor(F.col("s_suppkey") / 10).alias("doc"), "s_suppkey", "s_name"
    )
    key = F.col("s_suppkey").cast("string")
    shape = F.col("doc") % 5
    name = F.to_json(F.array("s_name"))
    quoted = F.substring(name, 2, F.length(name) - 2)
    item = (
        F.when(shape == 0, F.concat(F.lit('{"name":'), quoted, F.lit(',"slug":"id-'), key, F.lit('"}')))
        .when(shape == 1, F.concat(F.lit('{"short":'), quoted, F.lit(',"seo":"seo-'), key, F.lit('"}')))
        .when(shape == 2, quoted)
        .when(shape == 3, F.concat(F.lit('"k-'), key, F.lit('":'), quoted))
        .when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('"k-'), key, F.lit('":{}')))
        .otherwise(F.concat(F.lit('"k-'), key, F.lit('":{"name":'), quoted, F.lit("}")))
    )
    items = F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", item.alias("i")))), lambda e: e["i"])
    docs = s.groupBy("doc").agg(F.array_join(items, ",").alias("inner"))
    wrapped = F.when(shape < 3, F.concat(F.lit("["), F.col("inner"), F.lit("]"))).otherwise(
        F.concat(F.lit("{"), F.col("inner"), F.lit("}"))
    )
    return json_docs.directory_entries(docs.withColumn("body", wrapped), "body", "doc")


def _cell(value, attribute=False):
    text = F.coalesce(value.cast("string"), F.lit("--"))
    if attribute:
        return F.concat(F.lit('<td class="v" data-sort="'), text, F.lit('">'), F.substring(text, 1, 3), F.lit("</td>"))
    return F.concat(F.lit("<td>"), text, F.lit("</td>"))


def _stat_pages(spark, sf):
    """A ranking page per period and block of sixteen suppliers, after an unrelated table."""
    stats = views.entity_stats(spark, sf)
    row = F.concat(
        F.lit("<tr>"),
        _cell(F.col("entity_id")),
        F.when(F.col("entity_id") % 2 == 0, _cell(F.col("entity_name"), True)).otherwise(
            F.concat(F.lit("<td> <a href='#'>"), F.col("entity_name"), F.lit("</a>\n</td>"))
        ),
        _cell(F.col("n_facts"), True),
        _cell(F.round("qty_last3", 2), True),
        F.when(F.col("entity_id") % 3 == 0, F.lit("")).otherwise(_cell(F.round("qty_prior", 2))),
        F.lit("</tr>"),
    )
    ordered = F.transform(
        F.sort_array(F.collect_list(F.struct("entity_id", row.alias("html")))), lambda e: e["html"]
    )
    page = F.concat(
        F.lit("<html><body><table><tbody><tr><td>a</td><td>menu</td><td>1</td></tr></tbody></table>"),
        F.lit('<TABLE class="wide tr-table x"><thead><tr><th>Rank</th></tr></thead><tbody>'),
        F.array_join(ordered, "\n"),
        F.lit("<tr><td>short</td><td>row</td></tr></tbody></TABLE></body></html>"),
    )
    return stats.groupBy(
        F.concat_ws("/", "period", F.floor(F.col("entity_id") / 16)).alias("page")
    ).agg(page.alias("html"))


_STAT_VARIANTS = ["season", "last3", "last1", "home", "away", "prior"]
_HTML_SQL = f"""{WITH_STATS} SELECT period || '/' || entity_id // 16 AS page, entity_name AS name,
  n_facts::DOUBLE AS season, round(qty_last3, 2) AS last3,
  CASE WHEN entity_id % 3 <> 0 THEN round(qty_prior, 2) END AS last1,
  NULL::DOUBLE AS home, NULL::DOUBLE AS away, NULL::DOUBLE AS prior FROM entity_stats"""


@register("html_rows", _HTML_SQL)
def html_rows(spark, sf):
    cells = html_tables.html_cells(_stat_pages(spark, sf), "page", "html", table_class="tr-table")
    return html_tables.stat_rows(cells, "page", _STAT_VARIANTS).drop("row_pos")


@register("html_rows_tolerant", _HTML_SQL)
def html_rows_tolerant(spark, sf):
    """The same pages with every closing row and cell tag removed."""
    pages = _stat_pages(spark, sf).withColumn("html", F.regexp_replace("html", "</t[dr]>", ""))
    cells = html_tables.html_cells_tolerant(pages, "page", "html", table_class="tr-table")
    return html_tables.stat_rows(cells, "page", _STAT_VARIANTS).drop("row_pos")


@register(
    "html_list_items",
    r"""SELECT page_id, count(*) AS n_items, sum(length(item))::BIGINT AS n_chars FROM (
      SELECT page_id, trim(regexp_replace(replace(replace(unnest(regexp_extract_all(html, '<li\b[^>]*>(.*?)</li\s*>', 1, 's')),
        chr(10), ' '), chr(9), ' '), '<[^>]*>', '', 'g')) AS item FROM pages) GROUP BY page_id""",
)
def html_list_items(spark, sf):
    """Row extraction over the whole text of the web pages, whose rows are list items."""
    pages = read_table(spark, sf, "pages").select("page_id", "html")
    items = html_tables.html_cells(pages, "page_id", "html", row_tag="li")
    text = F.col("cells")[0]["text"]
    return items.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum(F.length(text)).alias("n_chars")
    )


@register(
    "html_records",
    f"""WITH n AS (SELECT n_nationkey, n_name, count(s_suppkey) AS k, min(s_name) AS lead FROM nation
      LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)
    SELECT n_nationkey // 5 AS page, n_name AS name,
      CASE WHEN n_nationkey % 4 <> 0 THEN cast(k AS INTEGER) END AS rank,
      CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE n_nationkey END AS wins,
      CASE WHEN n_nationkey % 6 IN (4, 5) THEN NULL ELSE cast(k AS INTEGER) END AS losses,
      {r('k / 7.0::DOUBLE', 3)} AS win_rate,
      CASE WHEN n_nationkey % 3 <> 0 THEN coalesce(lead, '-') END AS leader,
      CASE WHEN n_nationkey % 3 = 1 THEN cast(k AS INTEGER) END AS leader_rank
    FROM n""",
)
def html_records(spark, sf):
    """Group rankings with header rows, bad numbers and short rows, five groups to a page."""
    nation, supplier = read_table(spark, sf, "nation"), read_table(spark, sf, "supplier")
    n = (
        nation.join(supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .groupBy("n_nationkey", "n_name")
        .agg(F.count("s_suppkey").alias("k"), F.min("s_name").alias("lead"))
    )
    key = F.col("n_nationkey")
    record = (
        F.when(key % 6 == 5, F.concat(F.lit("x-"), F.col("k").cast("string")))
        .when(key % 6 == 4, F.concat(key.cast("string"), F.lit("-?")))
        .otherwise(F.concat_ws("-", key.cast("string"), F.col("k").cast("string")))
    )
    row = F.concat(
        F.lit("<tr>"),
        _cell(F.col("n_name")),
        _cell(F.when(key % 4 != 0, F.col("k").cast("string")).otherwise(F.lit("n/a"))),
        _cell(record),
        _cell(F.round(F.col("k") / 7.0, 3)),
        F.when(key % 3 == 0, F.lit("")).otherwise(_cell(F.coalesce("lead", F.lit("-")))),
        F.when(key % 3 == 1, _cell(F.col("k"))).otherwise(F.lit("")),
        F.lit("</tr>"),
    )
    header = F.lit("<tr><td>Conference</td><td>Rank</td><td>Record</td><td>Rate</td></tr>")
    ordered = F.transform(
        F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("html")))), lambda e: e["html"]
    )
    page = F.col("page")
    pages = (
        n.groupBy(F.floor(key / 5).cast("int").alias("page"))
        .agg(F.array_join(ordered, "").alias("rows"))
        .select(
            "page",
            # Odd pages have no table body: their first row is the header.
            F.concat(
                F.lit("<table>"),
                F.when(page % 2 == 0, F.lit("<tbody>")).otherwise(F.lit("")),
                header,
                F.col("rows"),
                header,
                F.lit("<tr><td>a</td><td>b</td><td>c</td></tr>"),
                F.when(page % 2 == 0, F.lit("</tbody>")).otherwise(F.lit("")),
                F.lit("</table>"),
            ).alias("html"),
        )
    )
    cells = html_tables.html_cells(pages, "page", "html", body_required=False)
    return rounded(html_tables.record_rows(cells, "page").drop("row_pos"), 3)


_SPANS = (("03-13", "03-31"), ("04-01", "04-10"))
_YEARS_SQL = "years AS (SELECT DISTINCT cast(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE year(o_orderdate) <> 1997)"


def _years(spark, sf):
    return (
        read_table(spark, sf, "orders")
        .select(F.year("o_orderdate").alias("year"))
        .filter(F.col("year") != 1997)
        .distinct()
    )


@register(
    "date_grid",
    f"""WITH {_YEARS_SQL} SELECT year, cast(unnest(generate_series(make_date(year, 3, 13), make_date(year, 4, 10),
    INTERVAL 1 DAY)) AS DATE) AS day FROM years""",
)
def date_grid(spark, sf):
    return files.date_grid(_years(spark, sf), _SPANS)


def _cutoffs(spark, sf):
    """The last order day of the first quarter, for years that have one."""
    orders = read_table(spark, sf, "orders")
    return (
        orders.filter(F.quarter("o_orderdate") == 1)
        .groupBy(F.year("o_orderdate").alias("year"))
        .agg(F.to_date(F.max("o_orderdate")).alias("cutoff"))
    )


_CUTOFF_SQL = """cutoffs AS (SELECT cast(year(o_orderdate) AS INTEGER) AS year, cast(max(o_orderdate) AS DATE) AS cutoff
  FROM orders WHERE quarter(o_orderdate) = 1 GROUP BY ALL),
grid AS (SELECT year, item, cutoff FROM years JOIN cutoffs USING (year), (VALUES ('qty'), ('price'), ('disc')) i(item))"""


@register("request_grid", f"WITH {_YEARS_SQL}, {_CUTOFF_SQL} SELECT * FROM grid")
def request_grid(spark, sf):
    return files.request_grid(_years(spark, sf), ["qty", "price", "disc"], _cutoffs(spark, sf))


@register(
    "incremental_todo",
    f"""WITH {_YEARS_SQL}, {_CUTOFF_SQL} SELECT g.* FROM grid g WHERE NOT EXISTS (SELECT 1 FROM lineitem
    WHERE year(l_shipdate) = g.year AND year % 2 = 0 AND g.item <> 'disc')""",
)
def incremental_todo(spark, sf):
    """Units left after the even years' quantity and price were done."""
    grid = files.request_grid(_years(spark, sf), ["qty", "price", "disc"], _cutoffs(spark, sf))
    done = (
        read_table(spark, sf, "lineitem")
        .select(F.year("l_shipdate").alias("year"))
        .filter(F.col("year") % 2 == 0)
        .distinct()
        .select("year", F.explode(F.array(F.lit("qty"), F.lit("price"))).alias("item"))
    )
    return files.incremental_todo(grid, done, ["year", "item"])


@register(
    "distinct_names",
    """SELECT s_name AS name FROM supplier UNION SELECT c_name FROM customer UNION SELECT p_name FROM part""",
)
def distinct_names(spark, sf):
    frames = [
        read_table(spark, sf, t).select(F.col(c).alias("n"))
        for t, c in (("supplier", "s_name"), ("customer", "c_name"), ("part", "p_name"))
    ]
    return files.distinct_names(frames, "n")
