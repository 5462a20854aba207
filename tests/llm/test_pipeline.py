import random

from plain import components, words

import corpus_pipeline
from granary.llm import language, mixing, queries

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_their_decisions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), f"test-{name}")
        assert docs.columns == columns
        seen.append((name, before, docs))
    by = {n: ([tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()]) for n, a, b in seen}
    before, after = by["near_dedup"]
    groups = components(before, 5, 80)
    assert sorted(r[0] for r in after) == sorted(d for d, (_, c) in groups.items() if d == c)
    before, after = by["language_id"]
    assert set(after) <= set(before) and len(after) >= 0.98 * len(before)
    norm = lambda t: " ".join("".join(ch.lower() if ch.isalnum() else " " for ch in t).split())
    items = [norm(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before, after = by["decontamination"]
    leaks = {r for r in before if any(i in norm(r[1]) for i in items)}
    assert leaks and set(after) == set(before) - leaks
    before, after = by["mixing"]
    assert set(after) <= set(before)
    manifest = corpus_pipeline.shard(spark, docs, SMALL).collect()
    assert sorted(r["doc_id"] for r in manifest) == sorted(r[0] for r in after)
    again = corpus_pipeline.run(spark, SMALL).collect()  # run() gives what the stages one by one give
    assert again and sorted(map(tuple, again)) == sorted(map(tuple, manifest))


def test_odd_rows_pass_the_stages(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, words(rng, 40), "en" if i % 2 else "de", f"s{i % 2}", 1) for i in range(30)] + [(None, words(rng, 30), None, None, None), (40, None, None, None, None), (41, "", "en", "s0", 0), (42, words(rng, 3000), "de", "s1", 3)]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    once = corpus_pipeline.near_dedup(spark, df, str(tmp_path))
    assert once.where("doc_id = 3").count() == 1 and once.where("doc_id is null").count() == 1
    df.limit(0).write.parquet(str(tmp_path / "e" / "documents.parquet"))
    for t in ("benchmark", "labels"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).write.parquet(str(tmp_path / "e" / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).count() == 0


def test_columns_with_clashing_names_and_repeated_rows(spark, tmp_path):
    """Extra columns named as a stage's own pass through; of rows alike the mixture takes what it takes of their sum."""
    rng = random.Random(5)
    rows = [(i % 25, words(rng, 30), "en", f"s{i % 3}", 1, 7, 8, 9, "x") for i in range(50)] + [(99, "same words here", "en", "s0", 1, 7, 8, 9, "x")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, a long, b int, n long, _row string")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    mixed = corpus_pipeline.mix(spark, df, str(tmp_path))
    per_row = mixing.mix_documents(df, queries.quality(spark.read.parquet(str(tmp_path / "labels.parquet"))))
    assert mixed.columns == df.columns and mixed.count() == per_row.agg({"copies": "sum"}).first()[0]
    got, want = {}, {}
    for r in mixed.collect():
        assert (r["a"], r["b"], r["n"], r["_row"]) == (7, 8, 9, "x")
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    for r in per_row.where("copies > 0").collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["copies"]
    assert got == want
    once = corpus_pipeline.near_dedup(spark, df, str(tmp_path))
    assert once.columns == df.columns and once.where("doc_id = 99").count() == 1
    assert corpus_pipeline.decontaminate(spark, df, str(tmp_path)).count() == len(rows)


def test_contracts_of_the_queries(spark):
    want = {
        "op2": {"doc_id", "held_out", "lang_pred", "score"}, "op3": {"page_id", "url", "text", "n_chars"}, "op4": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
        "op5": {"doc_id", "n_shingles", "component_id", "kept"}, "op6": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}, "op7": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        "op8": {"query_id", "rank", "vec_id", "score"}, "op9": {"doc_id", "size", "source_size", "target", "taken"}, "op10": {"doc_id", "n_words", "n_removed", "kept_sha256"}, "op1": {"doc_id", "item_id"},
    }
    names = queries.queries()
    assert {n.split("_")[0] for n in names} == set(want)
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name, f in names.items():
        df = f(spark, SMALL)
        assert want[name.split("_")[0]] <= set(df.columns)
        if name.split("_")[0] in ("op2", "op4", "op5", "op6", "op7", "op9", "op10"):
            assert df.count() == n
    assert language.held_out() is not None


def test_queries_against_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SMALL)
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall())
