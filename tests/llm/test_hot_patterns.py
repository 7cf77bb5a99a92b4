"""URL lists: one pattern with many entries and captures, by brute force."""
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import op2_url_filter as o

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def hot(spark):
    """Half the times fall into one minute, some of them together; entries also long before and after all captures."""
    rng = random.Random(2)
    moments = [START + timedelta(seconds=rng.randrange(60)) for _ in range(30)]
    time = lambda: rng.choice(moments) if rng.random() < .5 else START + timedelta(seconds=rng.randrange(4 * 86_400))
    entries = [("host", "a.example.com", rng.random() < .5, time(), n) for n in range(300)]
    entries += [("host", "a.example.com", True, START - timedelta(days=40), 300), ("host", "a.example.com", False, START + timedelta(days=40), 301)]
    entries += [("domain", "other.org", True, time(), n) for n in range(302, 330)]   # nobody asks for this one
    captures = [(n, f"http://a.example.com/{n % 50}", time()) for n in range(500)] + [(500, "http://a.example.com/", START - timedelta(days=41))]
    e = spark.createDataFrame(entries, "kind string, pattern string, blocked boolean, at timestamp, entry_id long")
    c = spark.createDataFrame(captures, "id long, url string, at timestamp")
    return entries, captures, e, c


@pytest.mark.parametrize("slice_rows", [1, 7, 100, 20_000])
def test_one_pattern_by_brute_force(hot, slice_rows):
    entries, captures, e, c = hot
    want = {}
    for n, _, at in captures:
        before = [(t, k, blocked) for kind, p, blocked, t, k in entries if p == "a.example.com" and t <= at]
        want[n] = (max(before)[2], max(before)[0]) if before else (False, None)
    found = o.judge(c, e, slice_rows=slice_rows).select("id", "blocked", F.col("valid_from")).collect()
    assert len(found) == len(captures)
    assert {r["id"]: (r["blocked"], r["valid_from"]) for r in found} == want


def test_no_comparison_of_captures_with_entries(hot):
    """No join has the pattern alone as its key, and nothing is broadcast by a hint."""
    _, _, e, c = hot
    plan = o.judge(c, e)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower() and "cross" not in plan.lower()
    joins = [x for x in plan.splitlines() if "Join " in x and "pattern" in x]
    assert joins and all("slice" in x for x in joins)
