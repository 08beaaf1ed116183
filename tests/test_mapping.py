import pytest

from pairlab.operators.mapping import NameMap
from pairlab.operators.resolve import resolve_cascade

INDEX = [(1, "north harbour", ["nh"]), (2, "southern plain", []), (3, "eastgate", [])]
NAMES = ["North Harbour", "nh", "nort harbour", "S-2", "eastgat", "nobody", " ", None, "southern plane", "nh"]


@pytest.fixture
def world(spark, tmp_path):
    index = spark.createDataFrame(INDEX, "entity_id long, canonical_name string, alt_names array<string>")
    overrides = spark.createDataFrame([("S-2", "southern plain")], "variant string, canonical string")

    def names(values):
        return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "name string, method int")

    return NameMap(spark, str(tmp_path / "map")), names, index, overrides


def rows(df):
    return sorted(tuple(r) for r in df.select("name", "entity_id", "method", "score").collect())


def test_only_new_names_enter_the_cascade(world):
    held, names, index, overrides = world
    assert held.entries().count() == 0
    assert held.extend("first", names(NAMES[:5]), index, overrides, scorer="edit") == 5
    assert held.extend("second", names(NAMES), index, overrides, scorer="edit") == 3
    assert held.extend("third", names(NAMES), index, overrides, scorer="edit") == 0
    assert rows(held.entries()) == rows(resolve_cascade(names(NAMES), index, overrides, scorer="edit"))
    assert {r[2] for r in rows(held.entries())} == {"exact", "fuzzy", "override", "unresolved", "blank"}


def test_a_batch_given_again_replaces_itself(world):
    held, names, index, overrides = world
    held.extend("first", names(NAMES[:3]), index, overrides, scorer="edit")
    held.extend("second", names(NAMES), index, overrides, scorer="edit")
    before = rows(held.entries())
    assert held.extend("second", names(NAMES), index, overrides, scorer="edit") == 5
    assert rows(held.entries()) == before
    assert held.extend("second", names([]), index, overrides, scorer="edit") == 0
    assert len(rows(held.entries())) == 3


def test_ids_of_both_sides(world, spark):
    held, names, index, overrides = world
    held.extend("all", names(NAMES), index, overrides, scorer="edit")
    games = spark.createDataFrame([(1, "nh", "eastgat"), (2, "nobody", None), (3, "new", "S-2")], "g int, a string, h string")
    got = sorted(tuple(r) for r in held.attach(games, {"a": "a_id", "h": "h_id"}).select("g", "a_id", "h_id").collect())
    assert got == [(1, 1, 3), (2, None, None), (3, None, 2)]


def test_batch_names(world):
    held, names, index, overrides = world
    with pytest.raises(ValueError):
        held.extend("../x", names(NAMES), index, overrides, scorer="edit")
