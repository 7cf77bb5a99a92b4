"""Disclosure control by the production rule on a planted corpus, at N documents and at 10 N."""
import random

import pytest

from tests.llm.test_llm import SF, docs  # noqa: F401


def _planted(n):
    """Texts with 20 people of five documents each and 20 rare mail domains of five addresses each; every one has a term of its own in
    all its documents.  All texts hold common words and a rare word that has nothing to do with anybody."""
    draw, common, made, planted = random.Random(1), [f"common{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)], [], []
    letters = "bcdfghklmnprstvz"
    odd = lambda: "".join(draw.choice(letters) + draw.choice("aeiou") for _ in range(6))
    names = [odd() for _ in range(40)]
    for k, name in enumerate(names):
        for j in range(5):
            address = f"person{k}@mail.example.com" if k < 20 else f"writer{k}x{j}@firm{k}.example.com"
            made.append((address, name))
            planted.append(name)
    rare = [odd() for _ in range(n // 2)]  # each in some two documents
    texts = []
    for k in range(n):
        address, name = made[k] if k < len(made) else ("", "")
        texts.append((k, " ".join([*(draw.choice(common) for _ in range(40)), name, draw.choice(rare), address, *(draw.choice(common) for _ in range(10))])))
    return texts, {(k, name) for k, (_, name) in enumerate(made)}


@pytest.mark.parametrize("n", [2000, 20_000])
def test_planted_terms_are_found_and_rare_words_stay(spark, n):
    from ledgerscope.llm import op3_pii as o
    texts, planted = _planted(n)
    found = o.find_personal_data(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), rule=o.PRODUCTION).collect()
    marked = {(r["doc_id"], texts[r["doc_id"]][1][t["start"]:t["end"]]): t["action"] for r in found for t in r["terms"]}
    hit = planted & marked.keys()
    print(f"N = {n}: precision {len(hit) / len(marked):.3f}, recall {len(hit) / len(planted):.3f}")
    assert len(hit) / len(planted) == 1.0 and all(marked[x] == 1 for x in hit)
    assert len(hit) / len(marked) >= 0.95


def test_one_and_two_coincidences_never_remove(spark):
    from ledgerscope.llm import op3_pii as o
    texts = ["zebra one@a.example.com"] + ["heron two@b.example.com"] * 2 + ["the"] * 997
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(texts[r["doc_id"]][t["start"]:t["end"]], t["action"]) for t in r["terms"]] for r in o.find_personal_data(df, rule=o.PRODUCTION).collect()}
    assert got[0] == [] and got[1] == got[2] == [("heron", 0)]


def test_an_entity_of_many_documents_names_nobody(spark):
    from ledgerscope.llm import op3_pii as o
    texts = ["zebra all@a.example.com"] * 5 + ["all@a.example.com"] * 20 + ["the"] * 75
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert not any(r["terms"] for r in o.find_personal_data(df, rule=o.PRODUCTION).collect())


def test_actions_of_the_query(spark):
    from ledgerscope.llm import op3_pii as o
    for r in o.op3_pii(spark, SF).collect():
        terms = [s.split(":")[1:] for s in r["spans"].split(",") if s.startswith("term:")]
        assert [a.split(":")[1:] for a in r["actions"].split(",") if a] == terms
        assert all(a.split(":")[0] in o.ACTIONS for a in r["actions"].split(",") if a)


def test_rewritten_rows_keep_their_columns(spark):
    from ledgerscope.llm import op3_pii as o
    rows = [(1, "k0", None, 3, [1]), (2, "me@mail.example.com and more", "x", 4, None), (None, "", None, 0, []), (3, "plain é", "y", 7, [2])]
    df = spark.createDataFrame(rows, "uid long, text string, k0 string, n_chars long, base array<int>")
    out = {r["uid"]: tuple(r) for r in o.sanitise(df, rule=o.PRODUCTION).collect()}
    assert o.sanitise(df).schema == df.schema
    assert out == {1: rows[0], None: rows[2], 3: rows[3], 2: (2, "<EMAIL> and more", "x", 16, None)}
