"""The stages against the operators' brute-force results, one after the other, and the result of run()."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from resonant.llm import stages
from resonant.llm.queries import QUERIES
from tests.conftest import DATA
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import check


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "decontamination", "best_fit_packing"]
    assert len(QUERIES) == 10 and sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 11))


def test_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(9001, "12345 67 !!", None, "src1", 11), (9002, None, None, "src1", None), (9003, "ЖЩЮЯ ДЛФ ЪЫЭ " * 30, None, "src1", 9)], docs.schema)
    seen = docs.unionByName(extra)
    columns = docs.columns
    short = spark.createDataFrame([(9004, "Zq.", None, "src1", 3), (9005, "Ö", "de", "src2", 1)], docs.schema)
    kept = stages.identify_language(spark, seen.unionByName(short), DATA)
    assert {9004, 9005} < {r.doc_id for r in kept.collect()}
    kept = stages.identify_language(spark, seen, DATA)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and ids == {r.doc_id for r in docs.collect()}
    lines = stages.drop_boilerplate_lines(spark, kept, DATA)
    assert lines.columns == columns and {r.doc_id for r in lines.collect()} == ids
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    one = stages.one_of_each_group(spark, lines, DATA)
    assert one.columns == columns
    assert {r.doc_id for r in one.collect()} == {c for _, _, c in brute(rows)}
    clean = stages.remove_benchmark(spark, one, DATA)
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} < {r.doc_id for r in one.collect()}
    packed = stages.pack_sequences(spark, clean, DATA).collect()
    check(packed, [(r.doc_id, r.text) for r in clean.collect()], 2048)


def test_run_gives_the_same_pieces(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert rows and {r.doc_id for r in rows} < {r.doc_id for r in docs.collect()}


def test_empty_corpus(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


def test_one_row_of_each_group_stays(spark):
    a, b, c = ("".join(f"{w}{i} " for i in range(40)) for w in "abc")
    rows = [(1, a), (1, a), (2, a), (None, a), (2, b), (None, c), (None, c), (4, None), (4, None), (None, " ")]
    docs = spark.createDataFrame([(i, t, None, "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = stages.one_of_each_group(spark, docs, DATA)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (None, c), (4, None), (4, None), (None, " ")], key=repr) and kept.columns == docs.columns


def test_without_languages_documents_with_letters_stay(spark):
    rows = [(1, "Some words", None, "s", 10), (2, "12 34 !", None, "s", 7), (3, None, None, "s", None), (4, "7 Ж", None, "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in stages.identify_language(spark, docs, DATA).collect()) == [1, 4]


def test_clashing_names_odd_rows_and_long_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    long = " ".join(f"wort{i} und" for i in range(60_000))
    odd = spark.createDataFrame([(7001, long, "de", "src1", None), (7001, long, "de", None, None), (None, "Und so weiter.", None, None, 1), (7002, "", None, "src1", 0)], docs.schema)
    names = ("lid_lang", "row_key", "split_lines", "own_lines", "component_id", "key", "grp", "__text")
    rows = docs.unionByName(odd).unionByName(docs.limit(3)).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    now = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, DATA)
        assert now.columns == rows.columns, name
        assert {tuple(r[n] for n in names) for r in now.collect()} == {tuple(range(len(names)))}
    kept = Counter(r.doc_id for r in now.collect())
    assert kept[7001] == 1 and kept[7002] == 0 and kept[None] == 1 and max(kept.values()) == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, now, DATA).collect()
    check(packed, [(r.doc_id, r.text) for r in now.collect()], 2048)
