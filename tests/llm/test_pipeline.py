"""The pipeline against its stages' rules on a small table, and the registration of the queries."""

import os

import __spark_entry__ as entry_points
import corpus_pipeline
from tidemark.llm import quality_rules, queries

ITEM = "we ask which of the seven rivers of the plain runs north in spring"


def rows():
    base = "Notes on {n}: the harvest of year {n} was taken in by {m} people before the rains of month {k} came down the hill."
    out = [(i, base.format(n=i * 7919, m=i * 31 + 5, k=i * i + 3) + f" Field {i * 17} lay {i * 3} days.", f"s{i % 4}") for i in range(40)]
    out += [(100, out[0][1], "s0"), (101, out[1][1], "s1"), (102, "too short", "s1"), (103, None, "s2"), (104, "!! ".join("AB" * 40), "s2")]
    out += [(105, f"Some words before. {ITEM.upper()} and a few words after it, as leaked texts have.", "s3")]
    out += [(106, "Write to ann@mail.example.org or call +1 (706) 555-3138 to hear more about the harvest of this year.", None)]
    return out


def test_stages(spark, make_docs, tmp_path):
    make_docs(rows()).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = {r.doc_id: r for r in docs.collect()}
    clean = set(range(40))
    assert set(left["quality_rules"]) == clean | {100, 101, 105, 106}
    assert set(left["near_duplicates"]) == clean | {105, 106}
    assert set(left["decontamination"]) == clean | {106}
    text = left["personal_data"][106].text
    assert text == "Write to <EMAIL> or call <PHONE> to hear more about the harvest of this year."
    assert left["personal_data"][106].n_chars == len(text)
    assert set(left["mixing"]) == clean | {106}
    got = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {d: r.taken for d, r in left["mixing"].items()}


def test_registered():
    names = entry_points.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert set(queries.SQL) <= set(entry_points.oracle_sql())


def test_rules_stage_is_native(spark, make_docs):
    plan = quality_rules.passing(make_docs(rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert os.path.exists(corpus_pipeline.__file__)


def words_of(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def test_rows_without_an_id_are_compared(spark, make_docs):
    """Copies without an id are found among themselves, and link what lies on both sides of them."""
    a, b = words_of("a", 100), words_of("b", 60)
    chain = [" ".join(f"c{i}" for i in range(at, at + 100)) for at in (0, 8, 16)]  # only neighbours reach 0.8
    rows = [(None, a), (None, a + " end"), (None, a), (None, b), (1, chain[0]), (None, chain[1]), (2, chain[2])]
    left = corpus_pipeline.near_duplicates(spark, make_docs(rows), "").collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == [1]
    texts = [r.text for r in left if r.doc_id is None]
    assert len(texts) == 3 and {b, chain[1]} < set(texts) and {a, a + " end"} & set(texts)


def test_texts_of_one_id_are_documents_of_their_own(spark, make_docs):
    """Of two rows of one id, the one that is no copy of another document stays, whichever comes first."""
    x, y = words_of("x", 50), words_of("y", 50)
    for rows in ([(5, x), (5, y), (1, x)], [(5, y), (1, x), (5, x), (5, y)]):
        left = corpus_pipeline.near_duplicates(spark, make_docs(rows), "").collect()
        assert sorted((r.doc_id, r.text) for r in left) == [(1, x), (5, y)]
    near = [(7, x), (7, x + " more"), (9, x + " and more")]
    (one,) = corpus_pipeline.near_duplicates(spark, make_docs(near), "").collect()
    (again,) = corpus_pipeline.near_duplicates(spark, make_docs(near[::-1]), "").collect()
    assert one.doc_id == 7 and one.text == again.text


def test_a_leaked_text_takes_no_other_row_of_its_id_along(spark, make_docs, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, f"before {ITEM} after"), (None, "clean and without an id"), (3, f"{ITEM} again"), (3, "clean with the same id"), (4, None)]
    left = corpus_pipeline.benchmarks(spark, make_docs(rows), str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=repr) == sorted([rows[1], rows[3], rows[4]], key=repr)


def test_the_mix_holds_the_texts(spark, make_docs):
    rows = [(i, f"text {i} " + "word " * (i % 9), f"s{i % 3}") for i in range(60)] + [(None, "no id", None), (7, "twice", "s0"), (7, "twice", "s0")]
    mixed = corpus_pipeline.mixture(spark, make_docs(rows).select("doc_id", "text", "lang", "source", "n_chars"), "")
    assert {"text", "lang", "n_chars", "repeats", "taken"} <= set(mixed.columns)
    got = mixed.collect()
    assert sorted(((r.doc_id, r.text, r.source) for r in got), key=repr) == sorted(rows, key=repr)
    assert all(r.size == len(r.text.split()) and r.n_chars == len(r.text) and r.taken == r.repeats * r.size for r in got)
    assert {r.repeats for r in got} >= {0, 2}
