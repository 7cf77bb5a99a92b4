"""Decontamination of repetitive texts: bounded seeds, the same coverage; short items as whole sequences."""
import time

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_llm import brute_tiling


def test_a_million_equal_words():
    from ledgerscope.llm import op10_decontaminate as o
    index = o.Index([(1, "word " * 400), (2, "other " * 30 + "word " * 20), (3, "a b c d e f g")], 5)
    began = time.time()
    found = o.leaks(pa.array(["word " * 1_000_000, "other " * 40, None, "a b c d e f g " * 100_000 + "word " * 100]), index, 0.5)
    assert [(d, i, c) for d, i, c, _ in sorted(found)] == [(0, 0, 400), (1, 1, 30), (3, 2, 7)]
    assert time.time() - began < 120


@pytest.mark.parametrize("pair,group", [(0, 1), (3, 10), (40, 60)])
def test_bounded_seeds_give_the_same_coverage(monkeypatch, pair, group):
    from ledgerscope.llm import op10_decontaminate as o
    rng = np.random.default_rng(11)
    cases = []
    for k in range(60):
        items = [" ".join(f"w{x}" for x in rng.integers(0, 2 + k % 6, int(rng.integers(3, 40)))) for _ in range(4)]
        texts = [" ".join(f"w{x}" for x in rng.integers(0, 2 + k % 6, int(rng.integers(0, 90)))) for _ in range(5)] + [items[0] + " zz " + items[1]]
        cases.append((o.Index(list(enumerate(items)), 3), pa.array(texts)))
    whole = [sorted(o.leaks(texts, index, 0.01)) for index, texts in cases]
    monkeypatch.setattr(o, "PAIR_SEEDS", pair)
    monkeypatch.setattr(o, "GROUP_SEEDS", group)
    for (index, texts), want in zip(cases, whole):
        got = sorted(o.leaks(texts, index, 0.01))
        assert [(d, i) for d, i, *_ in got] == [(d, i) for d, i, *_ in want]
        # equally long matches may be tiled in another order, which can change the rest a little
        assert all(abs(a[2] - b[2]) <= 4 for a, b in zip(got, want))
    assert sum(x[2] for w in whole for x in w) > 1000


def test_exact_copies_of_repetitive_items_are_covered_whole(monkeypatch):
    from ledgerscope.llm import op10_decontaminate as o
    monkeypatch.setattr(o, "PAIR_SEEDS", 0)
    for words in ("a b c a b c a b c a b d", "x x x x x x x x x", "p q r s t u v w"):
        index = o.Index([(1, words)], 3)
        assert [(d, c) for d, _, c, _ in o.leaks(pa.array(["no " + words + " more", words * 2]), index, 0.9)][0] == (0, len(words.split()))
        assert brute_tiling(words.split(), words.split(), 3) == len(words.split())


def test_runs_by_column_are_the_maximal_matches():
    from ledgerscope.llm import op10_decontaminate as o
    rng = np.random.default_rng(12)
    for _ in range(100):
        text, item = rng.integers(0, 3, 40), rng.integers(1, 3, 15)
        want = set()
        for t in range(40):
            for i in range(15):
                n = 0
                while t + n < 40 and i + n < 15 and text[t + n] == item[i + n]:
                    n += 1
                if n >= 3 and not (t and i and text[t - 1] == item[i - 1]):
                    want.add((n, t, i))
        got = set(o.runs_by_column(text, item, 3))
        assert got <= want and {(n, i) for n, _, i in got} == {(n, i) for n, _, i in want}


def test_short_items_as_whole_sequences(spark):
    from ledgerscope.llm import op10_decontaminate as o
    bench = spark.createDataFrame([(1, "Too short"), (2, None), (3, "..."), (4, "one two three four five six")], "item_id long, text string")
    texts = ["it is too short, really", "too", "short too", "too short", None, "one two three four five six"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda **kw: sorted((r["doc_id"], r["item_id"]) for r in o.contaminated(df, bench, **kw).collect())
    assert found() == [(5, 4)]
    assert found(short_items=True) == [(0, 1), (3, 1), (5, 4)]
    assert sorted(r["doc_id"] for r in o.without_leaks(df, bench, short_items=True).collect()) == [1, 2, 4]
