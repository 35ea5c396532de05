import random

import numpy as np
import pyarrow as pa

from loomstat.llm import decontaminate as op


def test_finds_the_items_that_documents_hold_and_no_others(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in op.contaminated(docs, bench).collect()}
    items = bench.collect()
    assert got == {(d.doc_id, i.item_id) for d in docs.collect() for i in items if i.text in d.text}
    assert got


def test_paraphrases_and_answers(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(25)) + f"? {word()} {word()} {word()}") for i in range(20)]
    fill = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i, text in items:
        w = text.split()
        changed = [x if k % 6 or k > 22 else word() for k, x in enumerate(w)]
        rows.append((i, f"{fill(60)} {' '.join(changed).upper()} {fill(200)}"))
        rows.append((100 + i, f"{fill(60)} {' '.join(w[:-3])} {fill(60)}"))  # without the answer
        rows.append((200 + i, " ".join(rnd.sample(w, len(w)))))  # other order
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in op.contaminated(docs, bench).collect()} == {(i, i) for i, _ in items}


def test_common_subsequence():
    def brute(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 30)), rng.integers(0, 5, rng.integers(1, 90))
        assert op.common(a, b) == brute(a, b)


def test_nulls_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (3, "short item")], "item_id long, text string")
    held = "x y one two three four five six seven eight nine ten z"
    docs = spark.createDataFrame([(1, None, "a"), (None, held, "b"), (2, held, "c"), (2, held, "c"), (3, "", "d"), (4, "w " * 90000 + held, "e"), (5, "short item", "f")], "doc_id long, text string, hits string")  # a column of that name is replaced
    got = sorted(((r.doc_id, r.item_id) for r in op.contaminated(docs, bench).collect()), key=str)
    assert got == [(2, 1), (2, 1), (4, 1), (5, 3), (None, 1)]
    assert sorted(((r.doc_id, r.item_id) for r in op.contaminated(docs, bench, short=False).collect()), key=str) == [(2, 1), (2, 1), (4, 1), (None, 1)]
    assert op.contaminated(docs.limit(0), bench).count() == 0
    assert op.contaminated(docs, bench.limit(0)).count() == 0
    assert op.answer_of("What is it? The answer is four.") == " The answer is four."
    assert op.answer_of("First one. Then two.") == "Then two."


def test_items_beside_repeated_words_do_not_depend_on_the_cosine(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(8 + i % 20))) for i in range(60)]
    rows = [(i, f"{(items[(i + 7) % 60][1].split()[0] + ' ') * 70}{text} {(items[(i + 9) % 60][1].split()[0] + ' ') * 70}") for i, text in items]
    edited = [(100 + i, " ".join(x if k != len(text.split()) // 2 else "zzz" for k, x in enumerate(f"{text}".split()))) for i, text in items]
    rows += [(i, f"{(items[(i + 3) % 60][1].split()[1] + ' ') * 70}{text} {(items[(i + 4) % 60][1].split()[1] + ' ') * 70}") for i, text in edited]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for cosine in (op.COSINE, 2.0):  # none reaches 2
        got = {(r.doc_id, r.item_id) for r in op.contaminated(docs, bench, cosine=cosine, answer=0.0).collect()}
        assert got == {(i, i) for i in range(60)} | {(100 + i, i) for i in range(60)}


def test_short_items_are_found_word_for_word(spark):
    items = [(1, "Capital of France? Paris"), (2, "Capital of France? Rome"), (3, "capital  of FRANCE, paris"), (4, "Two words"), (5, "?!"), (6, "one two three four five six seven eight nine")]
    docs = [(1, "the capital of France: Paris."), (2, "capital of France"), (3, "two\nwords capital of france rome"), (4, "two"), (5, "words two"), (6, None), (7, "a one two three four five six seven eight nine b")]
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in op.contaminated(docs, bench, short=True).collect())
    assert got == [(1, 1), (1, 3), (3, 2), (3, 4), (7, 6)]
    only = op.contaminated(docs, bench.where("item_id < 5"), short=True).collect()
    assert sorted((r.doc_id, r.item_id) for r in only) == [(1, 1), (1, 3), (3, 2), (3, 4)]


def test_registered_query_finds_short_items(spark, sf, tmp_path):
    from loomstat.llm import queries

    spark.createDataFrame([(1, "x capital of France Paris y")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, "Capital of France? Paris")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r.doc_id, r.item_id) for r in queries.op6_decontaminate(spark, str(tmp_path)).collect()] == [(1, 9)]


def topics(rnd, n=40, size=12):
    """Topics of synonyms: each of its things has three words, used alike."""
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    return [[[word() for _ in range(3)] for _ in range(size)] for _ in range(n)]


def test_synonyms_are_retrieved_where_their_words_are_not(spark):
    rnd = random.Random(11)
    all_topics = topics(rnd, 20, 60)
    say = lambda topic, n: [rnd.choice(rnd.choice(topic)) for _ in range(n)]
    corpus = [(k, " ".join(say(rnd.choice(all_topics), 64))) for k in range(4000)]
    items, said = [], []
    for k in range(60):
        # Two words of three in another one's place, so that no run of words is left, and the answer as it was.
        picks = [(rnd.choice(all_topics[k % 20]), rnd.randrange(3)) for _ in range(24)]
        items.append((k, " ".join(t[j] for t, j in picks) + "? Final answer"))
        said.append((10_000 + k, " ".join(t[(j + n % 3) % 3] for n, (t, j) in enumerate(picks)) + "? Final answer"))
    docs = spark.createDataFrame(corpus + said, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in op.contaminated(docs, bench, lcs=0.35).collect()}
    want = {(10_000 + k, k) for k in range(60)}
    assert len(got & want) >= 40 and {d for d, _ in got} <= {d for d, _ in want}
    assert len({(r.doc_id, r.item_id) for r in op.contaminated(docs, bench, lcs=0.35, cosine=2.0).collect()} & want) < 5  # by runs of words alone
    # Their words alone, weighed by inverse document frequency, are far below the threshold.
    df = np.zeros(op.COLUMNS)
    cols = lambda text: np.unique(next(op._words(pa.array([text]), 1 << 30))[1] % np.uint64(op.COLUMNS)).astype(int)
    for _, t in corpus:
        df[cols(t)] += 1
    idf = np.log((len(corpus) + 1) / (df + 1)) + 0.1
    cosine = lambda a, b: sum(idf[c] ** 2 for c in {*a} & {*b}) / (sum(idf[c] ** 2 for c in a) * sum(idf[c] ** 2 for c in b)) ** 0.5
    assert np.mean([cosine(cols(items[k][1]), cols(said[k][1])) for k in range(60)]) < op.COSINE


def test_svd_is_near_the_exact_one(spark):
    rnd = random.Random(3)
    all_topics = topics(rnd, 10)
    rows = [(k, " ".join(rnd.choice(rnd.choice(all_topics[k % 10])) for _ in range(40))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    latent = op.fit(docs)
    assert latent.project.shape[1] <= op.RANK < 60
    full = np.zeros((0, op.COLUMNS))
    for _, words, ptr in op._words(pa.array([t for _, t in rows]), 1 << 30):
        of_word, row_of, _ = op._blocks(ptr)
        block, column = op._present(words, of_word)
        x = np.zeros((len(row_of), op.COLUMNS))
        x[block, column] = 1
        total, df = len(row_of), x.sum(0)
        x[:-1] += x[1:] * (row_of[1:] == row_of[:-1])[:, None]
        full = np.concatenate([full, x])
    full *= np.log((total + 1) / (df + 1)) + 0.1
    _, d, vt = np.linalg.svd(full, full_matrices=False)
    # The ten topics: the span of the first ten singular vectors, and the sizes along them.
    q = np.linalg.qr(latent.project[:, :10].astype(float) / (np.log((total + 1) / (df + 1)) + 0.1)[:, None])[0]
    assert np.linalg.norm(vt[:9] @ q, axis=1).min() > 0.8
    z = latent.project[:, :10].astype(float)
    unit = np.linalg.norm((full / (np.log((total + 1) / (df + 1)) + 0.1)) @ z, axis=0)
    assert np.allclose(unit, 1, atol=0.02)


def test_a_benchmark_of_many_parts(spark, monkeypatch):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(4 + i % 20))) for i in range(90)]
    rows = [(i, f"{word()} {items[i][1]} {word()} {items[(i + 1) % 90][1]}") for i in range(90)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((r.doc_id, r.item_id) for r in op.contaminated(docs, bench).collect())
    assert {(i, i) for i in range(90)} <= {*want}
    monkeypatch.setattr(op, "PART_BYTES", 2000)
    monkeypatch.setattr(op, "ITEMS", 7)
    assert len([*op.parts_of(bench)]) > 3
    assert sorted((r.doc_id, r.item_id) for r in op.contaminated(docs, bench).collect()) == want


def test_columns_of_blocks_equal_unique():
    import numpy as np

    from loomstat.llm import decontaminate as D

    rng = np.random.default_rng(3)
    for first, step in ((0, 1), (5, 1), (1 << 40, 1), (7, 1 << 13)):  # the last does not fit into 32 bits
        of_word = first + step * np.sort(rng.integers(0, 60, 3000))
        words = rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, 3000).astype(np.uint64)
        words[::3] = words[0]
        key = np.unique(of_word * D.COLUMNS + (words % np.uint64(D.COLUMNS)).astype(np.int64))
        block, column = D._present(words, of_word)
        assert (block == key // D.COLUMNS).all() and (column == key % D.COLUMNS).all()
    assert not len(D._present(words[:0], of_word[:0])[0])
