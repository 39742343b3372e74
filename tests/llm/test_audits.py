"""Quality scores, periodic runs and source divergence against plain versions, with the odd rows a table may hold."""

import collections
import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanforge.llm import divergence, periodic, quality, words
from spanforge.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
LONG = "the entionth of ouery " * 3000
ODD = [(1, "Hello, world's end!\n\n tabs\t 123 é日本😀", "en", "a"), (2, None, "en", "a"), (3, "", "en", "b"), (4, LONG, "en", "b"), (4, LONG, "en", "b"), (None, "it's It's ßs ßs  ", None, None), (5, "a" * 3000, "", "c"), (6, " \n \t ", "de", "a"), (7, "Äb cd " * 9, "de", None), (8, "äb CD", "de", "b"), (9, "Cd äb äb", "de", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return rows.withColumns({c: F.lit("clash") for c in ("term", "item", "value", "rank", "part", "docs", "total", "kept", "salt", "block", "n", "runs", "collapsed", "start", "score", "label", "pick", "size")})


def plain_runs(w, least_words=6, least_times=4):
    out = set()
    for q in range(1, len(w) // least_times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least_words, least_times * q) and not any(all(w[k] == w[k + d] for k in range(i, j + q - d)) for d in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out)


def test_runs_are_all_runs():
    rnd = random.Random(3)
    for _ in range(6000):
        letters = rnd.choice([1, 2, 2, 3, 4])
        some = lambda most: [rnd.randrange(letters) for _ in range(rnd.randint(0, most))]  # noqa: B023, E731
        block = some(5)
        w = rnd.choice([some(40), some(5) + block * rnd.randint(1, 8) + some(5) + block[:2] * rnd.randint(1, 6)])
        assert periodic.runs(w) == plain_runs(w)
        assert periodic.runs(w, 1, 3) == plain_runs(w, 1, 3)


def test_runs_take_linear_time():
    fib, more = [0], [0, 1]
    while len(more) < 60_000:
        fib, more = more, more + fib
    shapes = {"one": lambda n: [1] * n, "fib": lambda n: more[:n], "nested": lambda n: ((([0, 1] * 20 + [2]) * 30 + [3]) * 60)[:n], "steps": lambda n: sum(([0] * k + [1] for k in range(400)), [])[:n]}
    for name, make in shapes.items():
        took = []
        for n in (15_000, 60_000):
            began = time.process_time()
            periodic.runs(make(n))
            took.append(time.process_time() - began)
        assert took[1] < 8 * took[0] + 0.2, name


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = plain_runs(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(((-size, s, q) for s, size, q in found), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    head = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *head, digest("".join(f"{s},{size},{q}\n" for s, size, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op12_is_the_plain_version(spark, odd, tmp_path):
    short = odd.withColumn("text", F.substring("text", 1, 4000))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 6000")
    rows = short.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    path = str(tmp_path / "sf")
    rows.write.parquet(f"{path}/documents.parquet")
    order = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = QUERIES["op12_periodic_runs"](spark, path).select(*order).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain_row(r.doc_id, r.text)) for r in rows.collect())
    assert any(r.n_runs for r in got) and any(zlib.crc32(str(r.doc_id).encode()) % 10 == 0 and r.n_runs for r in got)


def test_runs_of_odd_rows(odd):
    rows = periodic.find_runs(odd, keep=["doc_id", "text", "runs", "start"], runs_col="found", out_col="left")
    assert rows.columns == ["doc_id", "text", "runs", "start", "found", "left"]
    got = {r.doc_id: r for r in rows.collect()}
    assert [tuple(x) for x in got[4].found] == [(0, 12_000, 4)] and got[4].left == "the entionth of ouery"
    assert got[2].found == [] and got[2].left == "" and got[6].left == ""
    assert rows.count() == len(ODD) and periodic.find_runs(odd.limit(0), keep=["doc_id"]).count() == 0


def plain_audit(rows, least=3, top=200):
    texts = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = []
    for lang in {x[0] for x in texts}:
        own = [x for x in texts if x[0] == lang]
        seen = collections.Counter(t for x in own for t in set(x[2]))
        kept = {t for t, n in seen.items() if n >= least}
        counts = {s: collections.Counter() for _, s, _ in own}
        for _, s, ts in own:
            counts[s].update(t for t in ts if t in kept)
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept))  # noqa: B023, E731
        apart = lambda p, q: (p - q) ** 2 // q
        whole = sum(counts.values(), collections.Counter())
        for s, c in counts.items():
            parts = {"pair": [(o, sum(apart(share(c, t), share(d, t)) for t in kept)) for o, d in counts.items() if o != s]}
            parts["term"] = [(t, apart(share(c, t), share(whole, t))) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def told(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_is_the_plain_version(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source")
    some = [tuple(r) for r in docs.collect()]
    assert told(divergence.audit(docs)) == plain_audit(some)
    # Many tiles of few terms, and a short list.
    assert told(divergence.audit(docs, cells=500, top=3)) == plain_audit(some, top=3)
    assert told(divergence.audit(odd)) == plain_audit(ODD)
    assert divergence.audit(odd.limit(0)).count() == 0


def test_shares_are_exact():
    rnd = random.Random(5)
    totals = [rnd.randrange(1, 1 << 47) for _ in range(2000)]
    counts = [rnd.randrange(0, t) for t in totals]
    assert divergence.shares(np.array(counts), np.array(totals)).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(counts, totals)]


def test_op13_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    cursor = con.execute(divergence.OP13_SQL)
    assert [c[0] for c in cursor.description] == ["lang", "source", "part", "item", "value", "rank"]
    assert told(QUERIES["op13_source_divergence"](spark, DATA)) == sorted(cursor.fetchall())


def test_quality_of_held_out_documents(spark):
    data = "/root/testdata/sf0.01"
    rows = QUERIES["op11_quality"](spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0) and row.predicted == (row.score >= 0.3)
    kept = [r for r in rows if r.held_out]
    good, bad = ([r.score for r in kept if r.quality == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.98
    assert sum(r.predicted == r.quality for r in kept) / len(kept) > 0.95


def plain_score(model, text):
    w, sums, n = text.split(), np.zeros(2), 0
    for k, x in enumerate(w):
        buckets, _ = quality.features(pa.array([x.encode()]))
        if k and w[k - 1] == x:
            buckets = [*buckets, quality.AGAIN]
        sums += model.logits[buckets].sum(0)
        n += len(buckets)
    a, b = sums / max(1, n) + model.bias
    return 1 / (1 + np.exp(a - b))


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, None), (4, 0), (4, 1), (7, 0), (None, 1), (99, 1), (8, 5)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    rows = quality.score(odd, model, keep=["doc_id", "text", "score"], out_col="own").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert 0 <= r.own <= 1 and r.own == pytest.approx(plain_score(model, r.text or ""), rel=1e-9)
    assert len({r.own for r in rows if not (r.text or "").strip()}) == 1
    assert quality.train(odd, labels.limit(0)) is None
    assert {r.score for r in quality.score(odd, None, keep=["doc_id"]).collect()} == {0.5}
    assert quality.score(odd.limit(0), model, keep=["doc_id"]).count() == 0


def test_features_are_those_of_each_word():
    found = pa.array([b"ab", "é日😀x".encode(), b"a" * 50, b"#"])
    buckets, of = quality.features(found)
    for k in range(len(found)):
        assert sorted(buckets[of == k]) == sorted(quality.features(found.slice(k, 1))[0])
    # A word, and its n-grams of 3 and 4 characters between its ends.
    assert [int((of == k).sum()) for k in range(4)] == [1 + 2 + 1, 1 + 4 + 3, 1 + 50 + 49, 1 + 1 + 0]
    body, offsets = words.buffers(pa.array(["x  y", None, "", "y y\tx"]))
    distinct, places, text = quality.words_of(body, offsets)
    assert [distinct[p].as_py() for p in places] == [b"x", b"y", b"y", b"y", b"x"] and text.tolist() == [0, 0, 3, 3, 3]
    assert quality.repeated(places, text, 4).tolist() == [0, 0, 0, 1]
