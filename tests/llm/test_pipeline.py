from collections import Counter

import corpus_pipeline as cp
from loomstat.llm import ngram_join, token_output


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    columns, stages = docs.columns, dict(cp.STAGES)
    assert [*stages] == ["quality", "ngram_join", "decontaminate", "mixing", "tokens"]

    more = sf.replace("0.001", "0.01")  # here are too few labels to learn from
    good = stages["quality"](spark, spark.read.parquet(f"{more}/documents.parquet"), more)
    assert good.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{more}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert sum(labels.get(d) == 1 for d in kept) >= 0.97 * sum(q == 1 for q in labels.values())
    assert sum(labels.get(d) == 0 for d in kept) <= 0.3 * sum(q == 0 for q in labels.values())

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    classes = Counter(c if c is not None else d for d, c, _ in ngram_join.brute_force(rows))
    unique = stages["ngram_join"](spark, docs, sf)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(classes)

    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = stages["decontaminate"](spark, docs, sf)
    assert {r.doc_id for r in clean.collect()} == {d for d, t in rows if not any(i in t for i in items)}

    from loomstat.llm import mixing

    mixed = Counter(r.doc_id for r in stages["mixing"](spark, docs, sf).collect())
    assert mixed == +Counter({d: k // n if n else 1 for d, n, _, _, k in mixing.brute_force([(r.doc_id, r.text, r.source) for r in docs.collect()])})
    assert max(mixed.values()) <= 3

    assert [tuple(r) for r in stages["tokens"](spark, docs, sf).orderBy("doc_id").collect()] == token_output.brute_force(rows)


def test_nulls_repeats_and_other_columns(spark, sf):
    near = " ".join(str(i) for i in range(100))
    rows = [(1, near, "a", 1), (1, near, "a", 2), (2, near + " x", "a", 3), (None, near, "a", 4), (None, None, None, 5), (3, "", "b", 6), (3, "", "b", 6), (4, "other words of a text", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, keep int").withColumn("lang", __import__("pyspark").sql.functions.lit("en"))
    stages = dict(cp.STAGES)
    out = stages["ngram_join"](spark, docs, sf)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == {None: 2, 3: 2, 4: 1}
    for name in ("ngram_join", "decontaminate", "mixing"):
        assert stages[name](spark, docs.limit(0), sf).count() == 0
    mixed = Counter(r.doc_id for r in stages["mixing"](spark, docs, sf).collect())
    assert mixed[3] == 2


def test_run(spark, sf):
    out = cp.run(spark, sf)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    got = out.orderBy("start").collect()
    assert got and [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
