import pytest
from pyspark.sql import functions as F

from pairlab.functions.pairmath import log_ratio
from pairlab.operators import state
from pairlab.streaming.serving import serve_features, served

SCHEMA = "game_id long, a long, b long"


@pytest.fixture
def serve(spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("in", "state", "out", "check")}
    (tmp_path / "in").mkdir()

    def arrive(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(paths["in"])

    def publish(rows):
        state.commit(spark, paths["state"], {"stats": spark.createDataFrame(rows, "id long, x double")})

    def join(batch, stats):
        out = batch
        for side in ("a", "b"):
            out = out.join(stats.select(F.col("id").alias(side), F.col("x").alias(f"{side}_x")), side, "left")
        return out.select("game_id", (F.col("a_x") - F.col("b_x")).alias("diff"))

    def run(**options):
        schema = spark.createDataFrame([], SCHEMA).schema
        serve_features(spark, paths["in"], schema, paths["state"], paths["out"], paths["check"], join, **options).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(paths["out"]).select("game_id", "diff").collect())

    return arrive, publish, run, paths


def test_a_file_that_comes_twice_is_served_once(serve):
    arrive, publish, run, _ = serve
    publish([(1, 5.0), (2, 3.0)])
    arrive([(10, 1, 2), (11, 2, 1), (11, 2, 1), (None, 1, 1), (12, 1, 9)])
    first = run()
    assert first == [(10, 2.0), (11, -2.0), (12, None)]
    arrive([(10, 1, 2), (11, 2, 1), (12, 1, 9)])
    assert run() == first
    assert run() == first  # nothing arrived


def test_a_new_version_holds_from_the_next_batch(serve):
    arrive, publish, run, _ = serve
    publish([(1, 5.0), (2, 3.0)])
    arrive([(10, 1, 2)])
    run()
    publish([(1, 6.0), (2, 3.0)])
    arrive([(13, 1, 2)])
    assert run() == [(10, 2.0), (13, 3.0)]


def test_a_batch_that_runs_again_replaces_its_rows(serve, spark, tmp_path):
    arrive, publish, run, paths = serve
    publish([(1, 5.0), (2, 3.0)])
    arrive([(10, 1, 2)])
    arrive([(11, 2, 1)])
    want = run(files_per_batch=1)
    last = max(int(p.name) for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit())
    assert last == 1
    # The batch was written but the stream died before it noted so.
    (tmp_path / "check" / "commits" / str(last)).unlink()
    for side in (tmp_path / "check" / "commits").glob(f".{last}*"):
        side.unlink()
    assert run(files_per_batch=1) == want
    assert served(spark, paths["out"]).count() == 2


def test_nothing_served_yet(spark, tmp_path):
    assert served(spark, str(tmp_path / "none")) is None


def test_floored_log_ratio(spark):
    df = spark.createDataFrame([(0, 1), (None, 2), (4, 2)], "a int, b int")
    got = [r[0] for r in df.select(log_ratio(F.col("a"), F.col("b"), 0.5)).collect()]
    assert got == [pytest.approx(-0.693147), None, pytest.approx(0.693147)]
