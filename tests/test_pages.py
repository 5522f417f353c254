"""Page operators on fixtures, and every page query against its statement on the smallest tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sparkalogue.functions import scalars
from sparkalogue.operators import catalog, history, search, tiers, upsert
from sparkalogue.queries import pages as page_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


def _plain(rows):
    return sorted(map(str, [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows]))


@pytest.mark.parametrize("name", sorted(page_queries.QUERIES))
def test_against_the_statement(spark, duck, name):
    got = page_queries.QUERIES[name](spark, SF)
    want = duck.execute(page_queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert _plain(tuple(r) for r in got.select(*names).collect()) == _plain(want.fetchall())


def test_sort_whitelist(spark):
    rows = spark.createDataFrame([(1, "b", "1999"), (2, "A", None), (3, "c", "2001"), (4, "a", "1999")], "id int, name string, day string")
    allowed = {"name": F.lower("name"), "build_date": F.col("day")}

    def ids(sort, way):
        order = catalog.ordered(rows, sort, way, allowed, "name", frozenset({"build_date"}), F.lower("name"), F.col("id"))
        return [r["id"] for r in catalog.page(rows, order).collect()]

    assert ids("build_date", "asc") == [4, 1, 3, 2] and ids("build_date", "desc") == [3, 4, 1, 2]
    assert ids("name", "desc") == [3, 1, 2, 4] and ids("no such key; drop", "down") == [2, 4, 1, 3]


def test_suggestions(spark):
    games = spark.createDataFrame([("Sonic",), ("Sonic 2",), ("Supersonic Racers",), ("Doom",), ("50% off",)], "name string")
    assert [r["name"] for r in search.suggestions(games, "name", "sonic", 10).collect()] == ["Sonic", "Sonic 2", "Supersonic Racers"]
    assert [r["name"] for r in search.suggestions(games, "name", " ", 2).collect()] == ["50% off", "Doom"]
    assert [r["name"] for r in search.suggestions(games, "name", "0%", 10).collect()] == ["50% off"]
    assert {r["name"] for r in games.where(search.wildcard_like(F.col("name"), "s_nic%2")).collect()} == {"Sonic 2"}


def test_asset_rows(spark):
    sha = "ab" * 32
    rows = [("a", sha, "m", "k", 1.0), ("", sha, "m", "k", 1.0), ("c", sha.upper(), "m", "k", 1.0), ("d", sha, None, "k", 1.0), ("e", sha, "m", None, 1.0), ("f", sha, "m", "k", float("nan")), ("g", sha, "m", "k", None), (None, sha, "m", "k", 1.0), ("h", sha[:-1], "m", "k", 1.0)]
    made = spark.createDataFrame(rows, "path string, sha256 string, mime string, kind string, size double")
    assert [r["path"] for r in made.where(catalog.asset_ok()).collect()] == ["a"]


def test_content_trees(spark):
    file = lambda name, **more: {"name": name, "type": "file", "size": 5, **more}
    tree = [
        {"name": "MAPS", "type": "dir", "children": [
            {"name": "SET.LZH", "type": "dir", "sha1": "aa", "size": 9, "date": "1999-01-02", "children": [file("one.s", date="1998-05-05")]},
            file("DISC.IMG", md5="bb"), {"name": "EMPTY", "type": "dir", "children": []}]},
    ]
    made = spark.createDataFrame([(1, json.dumps(tree)), (2, None), (3, "[]"), (4, "broken")], "id int, contents string")
    nodes = history.flatten_tree(made, "id", "contents")
    assert sorted(r["path"] for r in history.tree_files(nodes).collect()) == ["/MAPS/DISC.IMG", "/MAPS/SET.LZH", "/MAPS/SET.LZH/one.s"]
    assert sorted((r["path"], r["date"]) for r in history.tree_dates(nodes, "id").collect()) == [("/MAPS/SET.LZH", "1999-01-02"), ("/MAPS/SET.LZH/one.s", "1998-05-05")]
    assert history.flatten_tree(made.where("id > 1"), "id", "contents").collect() == []


def test_revert_plan(spark):
    rows = [(1, 1, "ann", 1), (1, 2, "bob", 2), (2, 3, "bob", 3), (3, 4, "bob", 4), (3, 5, "ann", 5), (4, 6, "ann", 1), (4, 7, "bob", 1)]
    made = spark.createDataFrame(rows, "page int, rev int, author string, day int")
    got = {tuple(r) for r in history.revert_plan(made, "bob", F.col("day") >= 2).collect()}
    assert got == {(1, 2, 1, "revert"), (2, 3, None, "delete")}


def test_moves_and_saves(spark):
    pages = spark.createDataFrame([("a", None, False, 1), ("b", None, True, 2), ("c", None, False, 3)], "slug string, redirect_to string, deleted boolean, id int")
    moves = spark.createDataFrame([("a", "z"), ("b", "y"), ("c", "b"), ("none", "x")], "slug string, new_slug string")
    assert {tuple(r) for r in upsert.move_pages(pages, moves).collect()} == {("z", None, False, 1), ("a", "z", False, None), ("b", None, True, 2), ("b", None, False, 3), ("c", "b", False, None)}
    stored = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "page int, link string")
    saved = spark.createDataFrame([(1,), (3,)], "page int")
    new = spark.createDataFrame([(3, "q"), (4, "not saved")], "page int, link string")
    assert {tuple(r) for r in upsert.replace_derived(stored, saved, new, "page").collect()} == {(2, "x"), (3, "q")}


def test_sets_and_arms(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b")], "page int, cat string")
    new = spark.createDataFrame([(1, "b"), (1, "c"), (2, "d")], "page int, cat string")
    assert {tuple(r) for r in catalog.two_way_difference(old, new, "page", "cat").collect()} == {(1, "a", "removed"), (1, "c", "added"), (2, "d", "added")}
    assert {tuple(r) for r in catalog.first_arm([old.where("cat = 'b'"), new], ["page"], F.asc("cat")).collect()} == {(1, "b"), (2, "d")}
    made = spark.createDataFrame([(5, "h"), (3, "h"), (4, None), (9, "g")], "id int, h string")
    assert {tuple(r) for r in tiers.classes(made, "h").collect()} == {(5, 3, 2), (3, 3, 2), (4, 4, 1), (9, 9, 1)}


def test_slugs_and_dates(spark):
    r = spark.range(1).select(
        scalars.game_slug(F.lit("Sonic the Hedgehog!"), F.lit("Mega Drive")).alias("a"), scalars.game_slug(F.lit("Doom"), F.lit(None).cast("string")).alias("b"),
        scalars.build_date(F.lit(""), F.lit("19990412")).alias("c"), scalars.build_date(F.lit("1999-01-01 10:00"), F.lit("20000101")).alias("d"), scalars.build_date(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("e"),
    ).first()
    assert tuple(r) == ("sonic-the-hedgehog--mega-drive", "doom", "1999-04-12", "1999-01-01 10:00", None)


def test_blame_against_one_version_after_another(spark):
    import random

    rng = random.Random(2)
    rows, want = [], set()
    for key in range(5):
        lines, versions = [f"l{k}" for k in range(6)], []
        for v in range(rng.randint(1, 9)):
            for _ in range(rng.randint(0, 3)):
                lines.insert(rng.randrange(len(lines) + 1), f"v{v}n{rng.randrange(99)}")
                lines.pop(rng.randrange(len(lines)))
            versions.append("\n".join(lines))
            rows.append((key, 10 * v, versions[-1]))
        want |= {(key, *h) for h in history.hunks(history.blame_lines(versions))}
    rows += [(7, 1, None), (8, 1, "a"), (8, 2, None), (8, 3, "a")]
    want |= {(7, *h) for h in history.hunks(history.blame_lines([""]))} | {(8, *h) for h in history.hunks(history.blame_lines(["a", "", "a"]))}
    got = history.blame(spark.createDataFrame(rows, "page long, rev long, text string").repartition(3), "page", "rev", "text")
    assert {tuple(r) for r in got.collect()} == want


def test_nearest_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, 0.0]), (7, [1.0])]
    made = spark.createDataFrame(rows, "id long, vec array<float>").repartition(2)
    got = sorted((r["query_id"], r["id"]) for r in tiers.cosine_topk(made.where("id in (1, 3)"), made, k=2, most_query_rows=1).collect())
    assert got == [(1, 2), (1, 6), (3, 1), (3, 2)] or got == [(1, 2), (1, 6), (3, 2), (3, 1)]
