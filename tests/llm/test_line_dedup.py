"""Frequencies are relative to the site; small cases, nulls, and the SQL on the testdata."""

from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from resonant.llm import chat_format, line_dedup, topk_search
from resonant.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA

SHAPE = "doc_id long, source string, text string"


def texts(df):
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in df.collect()}


def test_ratio_is_per_site(spark):
    rows = [(i, "a", f"menu\nbody {i}\n menu ") for i in range(10)] + [(100 + i, "b", "menu\nx" if i == 0 else f"t{i}") for i in range(40)]
    got = texts(line_dedup.result(spark.createDataFrame(rows, SHAPE)))
    assert got[3] == ("body 3", 3, 2)
    assert got[100] == ("menu\nx", 2, 0)


def test_ratio_must_be_exceeded_and_pages_count_once(spark):
    rows = [(i, "a", f"l\nl\nl\nq{i}" if i < 5 else f"p{i}") for i in range(10)]
    at = lambda ratio: texts(line_dedup.apply_to(spark.createDataFrame(rows, SHAPE), ratio=ratio))[0][0]
    assert at(0.5) == "l\nl\nl\nq0" and at(0.49) == "q0"


def test_copies_of_a_page_are_one_page(spark):
    rows = [(i, "a", "one\ntwo") for i in range(50)] + [(100 + i, "a", f"menu\nown {i}") for i in range(4)]
    got = texts(line_dedup.result(spark.createDataFrame(rows, SHAPE)))
    assert got[0] == ("one\ntwo", 2, 0) and got[100] == ("own 0", 2, 1)


def test_join_gives_the_same_above_the_broadcast_bound(spark):
    rows = [(i, ["a", "b", None][i % 3], f"menu {i % 3}\nbody {i}\nmenu {i % 3}" if i % 4 else None) for i in range(120)] + [(500 + i, f"h{i}", "menu 0\nx") for i in range(30)]
    df = spark.createDataFrame(rows, SHAPE).withColumn("own_lines", F.lit(1)).withColumn("Split_Lines", F.lit("s")).withColumn("hot", F.lit(2)).withColumn("host_key", F.create_map(F.lit(1), F.lit(2)))
    small, large = (line_dedup.apply_to(df, broadcast_lines=n) for n in (10**6, 0))
    assert small.columns == large.columns and set(df.columns) < set(small.columns)
    assert sorted(map(repr, small.collect())) == sorted(map(repr, large.collect()))
    assert texts(small)[1] == ("body 1", 3, 2) and texts(small)[500] == ("menu 0\nx", 2, 0)


def test_nulls_blank_lines_repeats_long_texts_and_clashes(spark):
    long = "\n".join(f"line {i}" for i in range(50_000))
    rows = [(1, None, "m\n\n  \nx"), (2, None, "m\ny"), (2, None, "m\ny"), (6, None, "m\nw"), (3, None, None), (4, "z", ""), (5, "z", long), (None, "z", "q")]
    df = spark.createDataFrame(rows, SHAPE).withColumn("line", F.lit(1)).withColumn("host", F.lit(2)).withColumn("pages", F.lit(3))
    got = texts(line_dedup.result(df))
    assert got[1] == ("\n  \nx", 4, 1) and got[2] == ("y", 2, 1) and got[3] == (None, 0, 0) and got[4] == ("", 1, 0) and got[5] == (long, 50_000, 0) and got[None][0] == "q"
    assert set(df.columns) < set(line_dedup.apply_to(df).columns)
    assert line_dedup.result(df.limit(0)).count() == 0


def test_queries_with_sql_match_it(spark):
    db = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    assert set(ORACLE_SQL.values()) == {chat_format.ORACLE_SQL, line_dedup.ORACLE_SQL, topk_search.ORACLE_SQL}
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, DATA)
        ran = db.execute(sql)
        names = [d[0] for d in ran.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(repr, ran.fetchall()))
