import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barloom.llm import bpe_count, pieces, token_store

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
VOCABULARY = Tokenizer.from_file(WORDS)

ODD = [
    "", " ", "  ", "\n", " \n ", "a  b", " a", "a ", "▁", "▁▁x ▁", "<s> </s> <unk> <0x0A>", "\t\r\x0b", "é é ́x", "ﬁ Ａ 漢字 🙂🙂",
    "a\n\n\nb \n c", "x" * 3000, "Ωσς ΣΑΣ İstanbul ǅ ß ÅÅ", "it's we'll 'S x'd", "1234 5.6", "<|endoftext|> a<|startoftext|>b", "ab≠ c≮", "    \x85 \x1c",
    "Word, word. WORD!! (word) wörd... Ñandú?", "\x00 a", "don't-stop #tag$$$ %%%",
]
TEXTS = st.text(alphabet=st.sampled_from(list("aeiostrnhAB  \n▁é.,'!1<>|ßΣ🙂́\t")) | st.characters(codec="utf-8"), max_size=60)


def encode(text):
    return VOCABULARY.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tables():
    return bpe_count.MergeCounter(MODEL), pieces.ChunkTable(MODEL), token_store.WordTable(WORDS)


def agrees(tables, text):
    counter, chunks, words = tables
    ids = LIBRARY.encode(text)
    assert counter.count(text) == len(ids)
    assert pieces.encode_ids(chunks, text) == ids
    assert "".join(r[2] for r in chunks.rows(text))[1:] == LIBRARY.decode(ids)
    assert np.frombuffer(words.payload(text, b""), dtype="<u2").tolist() == encode(text)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_agree_with_the_libraries(tables, text):
    agrees(tables, text)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_any_text_agrees_with_the_libraries(tables, text):
    agrees(tables, text)


def test_tables_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe_count.MergeCounter, "limit", 5)
    counter = bpe_count.MergeCounter(MODEL)
    for turn in range(3):
        for i in range(40):
            assert counter.count(f"word{i} the") == len(LIBRARY.encode(f"word{i} the"))
    assert len(counter) <= 5 and len(counter.older) <= 5


def frame(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(-200, 200), t, 1, "x") for t in ODD] + [(500, None, 1, ""), (None, "no id", 1, ""), (None, None, 1, "")]
    rows += [rows[3], rows[3], (501, "long words " * 20_000, 1, "")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, key string")


def test_token_counts(spark):
    rows, df = frame(spark)
    got = sorted(map(str, (tuple(r) for r in bpe_count.token_counts(df, MODEL, limit=50).collect())))
    expect = [(i, len((t or "").encode()), n := len(LIBRARY.encode(t or "")), n > 50) for i, t, *_ in rows]
    assert got == sorted(map(str, expect))
    assert bpe_count.token_counts(df.limit(0), MODEL).count() == 0


def test_piece_digests_and_ids(spark):
    rows, df = frame(spark)

    def digest(x):
        return hashlib.sha256(x.encode()).hexdigest()

    expect = []
    for i, text, *_ in rows:
        ids = LIBRARY.encode(text or "")
        expect.append(str((i, len(ids), digest(",".join(map(str, ids))), digest(LIBRARY.decode(ids)))))
    assert sorted(map(str, (tuple(r) for r in pieces.digests(df, MODEL).collect()))) == sorted(expect)
    some = pieces.encoded(df.filter("doc_id = 500 or doc_id = 501"), MODEL).collect()
    assert {r.doc_id: r.ids for r in some} == {500: [], 501: LIBRARY.encode("long words " * 20_000)}
    assert pieces.digests(df.limit(0), MODEL).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).permutation(np.arange(-n, 2 * n, 3))[:n]
    table = token_store.PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))


def test_store_round_trip(spark, tmp_path):
    rows, df = frame(spark)
    store = token_store.write_store(df, str(tmp_path / "store"), WORDS, end_id=1, shards=5)
    got = store.lookup(df, "doc_id", ids=True).collect()
    keyed = [(i, [*encode(t or ""), 1]) for i, t, *_ in rows]
    assert sorted(map(str, ((r.doc_id, r.ids) for r in got))) == sorted(map(str, keyed))
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    # Documents follow each other in ascending key order without gaps, those without a key first.
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))


def test_store_lacks_foreign_keys_and_can_be_empty(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(0, 400, 2)], "doc_id long, text string")
    store = token_store.write_store(df, str(tmp_path / "even"), WORDS, shards=3)
    wanted = spark.range(-5, 405).withColumnRenamed("id", "doc_id")
    assert sorted(r.doc_id for r in store.lookup(wanted, "doc_id").collect()) == list(range(0, 400, 2))
    empty = token_store.write_store(df.limit(0), str(tmp_path / "none"), WORDS)
    assert empty.lookup(wanted, "doc_id").count() == 0


def test_one_key_over_several_shards(spark, tmp_path):
    rows = [(7, f"text {i}") for i in range(60)] + [(1, "first"), (9, "last")]
    store = token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "hot"), WORDS, shards=6)
    assert len(store.routes(7)) > 1
    got = store.lookup(spark.createDataFrame([(7,), (1,)], "doc_id long"), "doc_id", ids=True).collect()
    assert sorted(r.ids for r in got) == sorted([*encode(t), 1] for i, t in rows if i != 9)
