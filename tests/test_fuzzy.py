"""Matches on pages with few texts and with many, together."""

import difflib
import random

from pyspark.sql import functions as F

from spanforge.operators import fuzzy


def test_small_and_crowded_pages_match_alike(spark, monkeypatch):
    rnd = random.Random(31)
    words = ["".join(rnd.choice("abcdeé日") for _ in range(rnd.choice([3, 12, 12, 40]))) for _ in range(25)]
    worse = lambda t: t[: len(t) // 2] + "#" + t[len(t) // 2 + 1 :]
    blocks = [(p, k, rnd.choice(words) + rnd.choice(["", "", "x", words[0]])) for p, n in ((1, 6), (2, 30), (3, 5)) for k in range(n)] + [(3, 9, None), (4, 0, ""), (None, 0, "abc")]
    entities = [(p, k, rnd.choice([worse, str, lambda t: t[1:3]])(t)) for p, k, t in blocks if t] + [(1, 90, ""), (3, 91, None), (5, 0, "alone"), (None, 7, "abc")]
    want = []
    for p, k, t in entities:
        for pos, b in sorted((pos, b) for q, pos, b in blocks if q == p and p is not None and b):
            if t and (t in b or difflib.SequenceMatcher(None, t, b).ratio() > 0.85):
                want.append((p, k, pos, "text_match" if t in b else "fuzzy_match"))
                break
    e = spark.createDataFrame(entities, "page int, entity_id int, text string")
    b = spark.createDataFrame(blocks, "page int, pos int, text string").withColumns({c: F.lit(100) for c in ("left", "top", "width", "height")})
    for few in (20, 0, 1000):
        monkeypatch.setattr(fuzzy, "FEW", few)
        rows = fuzzy.match_entities(e, b, page=["page"])
        assert sorted((r.page, r.entity_id, r.pos, r.source) for r in rows.collect()) == sorted(want)
        # On small pages no character is a row.
        assert few < 1000 or "SortMergeJoin" not in rows._jdf.queryExecution().optimizedPlan().toString() and "_name" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_bounds_leave_all_that_are_alike():
    rnd = random.Random(32)
    for _ in range(3000):
        a = "".join(rnd.choice("abcd日") for _ in range(rnd.randint(0, 30)))
        b = "".join(c for c in a if rnd.random() < 0.85)
        m = difflib.SequenceMatcher(None, a, b)
        assert fuzzy.may_be(a, b, 0.85) or m.ratio() <= 0.85
        assert not fuzzy.may_be(a, b, 0.85) or not a + b or m.quick_ratio() > 0.85
