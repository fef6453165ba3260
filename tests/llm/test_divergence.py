import random
import re
from collections import Counter

import pytest

from barloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, tile long, p long"


def slow(rows, min_docs, prior, top):
    rows = [((r[1] or ""), (r[2] or ""), (r[3] or "")) for r in rows]
    docs, counts = Counter(), Counter()
    for text, lang, source in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        docs.update({(lang, t) for t in found})
        counts.update((lang, source, t) for t in found)
    out = set()
    for lang in {r[1] for r in rows}:
        kept = sorted(t for (own, t), n in docs.items() if own == lang and n >= min_docs)
        sources = sorted({r[2] for r in rows if r[1] == lang})

        def freq(of):
            total = sum(of(t) for t in kept)
            return {t: 1 + (10**9 * (of(t) + prior)) // (total + prior * len(kept)) for t in kept}

        whole = freq(lambda t: sum(counts[lang, s, t] for s in sources))
        p = {s: freq(lambda t, s=s: counts[lang, s, t]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - whole[t], t) for t in kept if counts[lang, s, t] and p[s][t] > whole[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found[:limit])}
    return out


def found(spark, rows, **options):
    got = [tuple(r) for r in divergence.divergence(spark.createDataFrame(rows, SCHEMA), **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed, size, sources):
    rng = random.Random(seed)
    words = ["Straße", "ÉTÉ", "été", "don't", "a1b", "漢字", "x", "Y", "the", "THE", "\x7f", "foo_bar", "🙂", "z" * 50, "\x00k"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 30))) for _ in range(size // 3)] + ["", None, " \n"]
    return [
        (i, rng.choice(texts), rng.choice(["en", "de", None, ""]), rng.choice(sources), "t", 1, 2, 3) for i in range(size)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_count(spark, seed):
    rows = corpus(seed, 200, ["a", "B", "ä", "", None, "s4"])
    assert found(spark, rows, min_docs=4, prior=5, top=3) == slow(rows, 4, 5, 3)


def test_many_sources_fall_into_blocks_and_many_terms_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES_PER_BLOCK", 3)
    monkeypatch.setattr(divergence, "TERMS_PER_TILE", 2)
    rows = corpus(3, 240, [f"s{i}" for i in range(10)])
    assert found(spark, rows, min_docs=3, prior=2, top=50) == slow(rows, 3, 2, 50)


def test_copies_weigh_as_often_as_they_occur_and_partial_tables_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(divergence, "ENTRIES", 3)
    rows = corpus(4, 60, ["a", "b"]) + [(i, "the same text the", "en", "a" if i % 5 else "b", "", 0, 0, 0) for i in range(300)]
    assert found(spark, rows, min_docs=30, prior=5, top=50) == slow(rows, 30, 5, 50)


def test_groups_without_terms_and_empty_tables(spark):
    rows = [(1, "one two", "en", "a", "", 0, 0, 0), (2, None, "en", "b", "", 0, 0, 0), (2, None, "en", "b", "", 0, 0, 0)]
    assert found(spark, rows) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert found(spark, rows, min_docs=1) == slow(rows, 1, 5, 50)
    assert found(spark, []) == set()


def test_long_texts(spark):
    rows = [(i, "Wort und " * 200_000 + str(i), "de", f"s{i}", "", 0, 0, 0) for i in range(3)]
    assert found(spark, rows, min_docs=3) == slow(rows, 3, 5, 50)
