"""The pipeline's stages one after the other against plain versions of them."""

import corpus_pipeline
import __spark_entry__ as entry
from tests.llm import brute
from tests.llm.test_operators import plain_dedup
from tideloom.llm import quality
from tideloom.llm.common import keep
from tideloom.llm.queries import WEIGHTS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_equal_plain_versions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rules = quality.learn(quality.training_rows(docs, spark.read.parquet(f"{data}/labels.parquet")))
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near duplicates", "benchmark decontamination", "mixing"]
    before = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = keep(stage(spark, docs, data), "test")
        assert df.columns == COLUMNS
        got = {r["doc_id"]: r["text"] for r in df.collect()}
        rows = {r[0]: r[1] for r in before}
        if name == "quality rules":
            failed = {i for i, t in rows.items() if (c := brute.quality_counts(t))[0] < 50 or 100 * c[4] > 50 * c[0]}
            judged = {r["doc_id"] for r in quality.judge(docs, rules).filter("quality.rule is not null").collect()}
            want = {i: t for i, t in rows.items() if i not in failed | judged}
        elif name == "line dedup":
            want = {i: t for i, n, t in plain_dedup(list(rows.items())) if not n or t.strip(" \t\n\x0b\f\r")}
        elif name == "near duplicates":
            ids = sorted(rows)
            want = {ids[min(c)]: rows[ids[min(c)]] for c in brute.classes([rows[i] for i in ids])}
        else:
            found = brute.contamination(list(rows.values()), benchmark)
            want = {i: t for (i, t), f in zip(rows.items(), found) if not f[1]}
        assert got == want
        assert all(r["n_chars"] == len(r["text"]) for r in df.collect() if r["text"] != {x[0]: x[1] for x in before}[r["doc_id"]])
        docs, before = df, [tuple(r) for r in df.select(*COLUMNS).collect()]
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, data).toPandas()
    sizes = {}
    for _, text, _, source, _ in before:
        sizes[source] = sizes.get(source, 0) + len(brute.WORD.findall(text))
    total = sum(sizes.values())
    # a source may have but a few documents left here
    assert abs(mix["taken"].sum() - total) <= 0.01 * total and (mix["taken"] == mix["size"] * mix["repeats"]).all()
    assert set(WEIGHTS) == {5.0, 2.0, 1.0} and (mix["repeats"] >= 1).all()


def test_stages_take_odd_and_empty_tables(spark, data, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            got = keep(stage(spark, docs, data), "test")
            if name != "mixing":
                assert got.columns == docs.columns
            assert got.count() <= docs.count()
    first = corpus_pipeline.near_duplicates(spark, odd, data)
    assert first.filter("doc_id = 4").count() == 2  # the repeated row once, the other text


def test_run(spark, data):
    rows = entry.queries()["pipeline"](spark, data)
    assert rows.count() > 0 and {"doc_id", "text", "taken"} <= set(rows.columns)


def test_queries_equal_their_sql(spark, data):
    import checking

    con = checking.oracle_connection(data)
    for name, sql in entry.oracle_sql().items():
        if name.startswith("op"):
            df = entry.queries()[name](spark, data)
            want = checking.oracle_rows(con, sql)
            assert checking.spark_rows(df) == want
            assert checking.spark_kinds(df) == checking.oracle_kinds(con, sql)
