import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstat.llm import textcore as tc
from loomstat.llm import token_output as op
from loomstat.llm.shared import fresh_path

ODD = ["", None, " ", "a  b\n\n c\t\td ", "it's we'll I'VE don't", "x_y __ _1_ 12ab 3.14 ², ½ Ⅷ", "<|endoftext|> hi<|endoftext|>", "naïve Ünïcode ñandú été ß", "日本語 テキスト", "é ​ \xa0 \x1c\x85 end", "\r\n\x0b\x0c", "🙂🙂 👩‍👩‍👧", "«quoted» — “so” …", "  lead", "trail  ", "one ", " \n x", "a\n \nb", "a \tb", "a\n b", "a\n\n b\n", "it 's 'S n't", "a" * 5000, "!!!???  ###"]


def test_matches_the_library(spark):
    rnd = random.Random(2)
    rows = list(enumerate(ODD)) + [(100 + i, "".join(rnd.choice("abc ABÉñ'12_.,\n\t-  st") for _ in range(rnd.randint(0, 400)))) for i in range(200)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert [tuple(r) for r in op.round_trip(df).orderBy("doc_id").collect()] == op.brute_force(rows)


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert [tuple(r) for r in op.round_trip(df).orderBy("doc_id").collect()] == op.brute_force([(r.doc_id, r.text) for r in df.collect()])


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_words_give_what_the_whole_text_gives(text):
    with open(op.default_path(), encoding="utf-8") as f:
        e = op.encoder(f.read())
    texts = [text, text + " a", "", None, f"a {text}\n{text}"]
    ids, off = e(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [e.whole(t or "").tolist() for t in texts]


def test_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(None, "b"), (1, "x"), (1, "x"), (1, "y"), (None, None)], "doc_id long, text string")
    got = op.round_trip(df).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 1, 1]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(5)]
    assert op.round_trip(df.limit(0)).count() == 0


def test_files_have_bloom_filters_and_prune(spark):
    import pyarrow.orc as orc
    from pathlib import Path

    path = fresh_path(spark, "tokens")
    op.write_tokens(spark.range(3000).selectExpr("id AS doc_id", "'a b c' AS text"), path)
    back = op.read_tokens(spark, path)
    assert back.where("doc_id = 77").count() == 1
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)" in spark.read.orc(path).where("doc_id = 77")._jdf.queryExecution().executedPlan().toString()
    for p in Path(path.removeprefix("file:")).glob("*.orc"):
        assert orc.ORCFile(p).schema.names == ["doc_id", "part", "start_in_part", "n_tokens", "ids"]


def test_a_worker_holds_a_table_for_what_it_has_seen(monkeypatch):
    monkeypatch.setattr(op, "TABLE", 16)
    with open(op.default_path(), encoding="utf-8") as f:
        e = op.Encoder(f.read())
    texts = [" ".join(f"w{k}x{j}" for j in range(300)) for k in range(8)] * 2
    ids, off = e(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == [e.whole(t).tolist() for t in texts]
    assert e.count == 8 * 299 and 8 * e.count <= 3 * len(e.keys) < 16 * e.count and (e.keys != 0).sum() == e.count


def test_powers_take_what_a_chunk_needs():
    tc._pow.clear()
    assert len(tc.powers(tc.BASES[0], 10)[0]) == tc.CHUNK + 1
    p, q = tc.powers(tc.BASES[0], tc.CHUNK + 2)
    assert len(p) == len(q) >= tc.CHUNK + 2 and all(int(p[i]) * int(q[i]) % 2**64 == 1 for i in (0, 1, tc.CHUNK + 1))
