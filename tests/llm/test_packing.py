import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barloom.llm import packing

WORDS = public_tokenizers.path("word_bpe_49k.json")
VOCABULARY = Tokenizer.from_file(WORDS)


def plain_fill(demand, limits):
    """The dot-product rule, item by item."""
    left, out, room, at, count = list(range(len(demand))), {}, list(limits), 0, 0
    left = [i for i in left if all(d <= m for d, m in zip(demand[i], limits))]
    weight = [sum(demand[i][d] / limits[d] for i in left) / len(left) for d in range(len(limits))] if left else []
    while left:
        fits = [i for i in left if all(d <= r for d, r in zip(demand[i], room))]
        if not fits:
            room, at, count = list(limits), at + 1, 0
            continue
        score = lambda i: sum(w * x / m * r / m for w, x, m, r in zip(weight, demand[i], limits, room))
        best = max(fits, key=lambda i: (round(score(i), 12), [-x for x in demand[i]]))
        out[best] = (at, count)
        room, count = [r - d for r, d in zip(room, demand[best])], count + 1
        left.remove(best)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_fill_follows_the_dot_product_rule(seed):
    rng = random.Random(seed)
    demand = np.array([(rng.randrange(0, 60), 1, rng.randrange(0, 25)) for _ in range(80)] + [(200, 1, 0), (5, 1, 90)])
    limits = (100, 5, 40)
    sequence, place = packing.fill(demand, limits)
    expect = plain_fill(demand.tolist(), limits)
    assert sequence[-2:].tolist() == [-1, -1]
    totals = {}
    for i, s in enumerate(sequence[:-2]):
        totals.setdefault(int(s), []).append(tuple(demand[i].tolist()))
    plain = {}
    for i, (s, _) in expect.items():
        plain.setdefault(s, []).append(tuple(demand[i].tolist()))
    assert {s: sorted(v) for s, v in totals.items()} == {s: sorted(v) for s, v in plain.items()}
    assert all((np.sum(v, axis=0) <= limits).all() for v in totals.values())
    assert all(sorted(place[sequence == s]) == list(range((sequence == s).sum())) for s in totals)


def test_fill_of_nothing():
    assert packing.fill(np.empty((0, 3), dtype=np.int64), (4, 4, 4))[0].tolist() == []


def layout(rows, limit):
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in at.values():
        ends = [o + n for o, n in sorted(spans)]
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= limit
    return [sum(n for _, n in spans) for spans in at.values()]


def test_documents_are_cut_and_every_id_placed_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_GROUP", 15)
    rng = random.Random(1)
    texts = ["", None, "Hello, World!", " \n", "x" * 3000, "<|endoftext|> a", "Σας 漢字"]
    texts += [" ".join(rng.choices(["the", "Straße", "don't", "1234", "é"], k=rng.randrange(0, 90))) for _ in range(40)]
    rows = [(i, t, 5, 6) for i, t in enumerate(texts)] + [(3, texts[9], 0, 0), (3, texts[9], 0, 0), (None, "no id", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long, offset long")
    got = packing.pack_documents(docs, WORDS, 2, packing.Limits(64, 6, 64)).collect()
    expect = []
    for i, text, *_ in rows:
        ids = VOCABULARY.encode(text or "", add_special_tokens=False).ids + [2]
        for at in range(0, len(ids), 64):
            part = ids[at : at + 64]
            expect.append((i, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()), len(ids)))
    seen = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got]
    assert sorted(seen, key=lambda r: (r[0] or -1, *r[1:])) == sorted(expect, key=lambda r: (r[0] or -1, *r[1:]))
    layout(got, 64)
    assert max(sum(1 for r in got if r.sequence_id == s) for s in {r.sequence_id for r in got}) <= 6
    assert packing.pack_documents(docs.limit(0), WORDS).collect() == []


def test_padding_of_a_table_is_small(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = packing.pack_documents(docs, WORDS).collect()
    used = layout(got, 4096)
    padded = sum(0 if n & (n - 1) == 0 else 4096 - n for n in used)
    assert padded < 0.01 * 4096 * len(used)


def test_examples_over_a_limit_and_clashing_names(spark):
    rows = [(1, 50, 10, "a", 9), (2, 500, 1, "b", 9), (3, 5, 99, "c", 9), (4, None, None, "d", 9), (5, -3, 0, "e", 9)]
    frame = spark.createDataFrame(rows, "id long, tokens long, loss long, t string, sequence_id long")
    got = {r.id: r for r in packing.pack(frame, "tokens", "loss", packing.Limits(100, 2, 40)).collect()}
    assert got[2].sequence_id is None and got[3].offset is None and got[1].t == "a"
    assert None not in (got[1].sequence_id, got[4].sequence_id, got[5].sequence_id)
    assert len({got[i].sequence_id for i in (1, 4, 5)}) == 2


def test_instruction_examples_keep_the_loss_limit(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    examples = packing.instruction_examples(turns, WORDS)
    sizes = {r.conv_id: (r.tokens, r.loss) for r in examples.collect()}
    expect = {}
    for r in turns.collect():
        n = len(VOCABULARY.encode(r.text, add_special_tokens=False).ids) + 1
        t, lost = expect.get(r.conv_id, (0, 0))
        expect[r.conv_id] = (t + n, lost + (n if r.role == "assistant" else 0))
    assert sizes == expect
    top = packing.Limits(4096, 3, max(v[1] for v in sizes.values()) + 50)
    packed = packing.pack(examples, "tokens", "loss", top).collect()
    for s in {r.sequence_id for r in packed} - {None}:
        own = [r for r in packed if r.sequence_id == s]
        assert len(own) <= 3 and sum(r.loss for r in own) <= top.loss and sum(r.tokens for r in own) <= 4096
