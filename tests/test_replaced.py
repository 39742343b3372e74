"""Values put into texts as arrays of bytes."""

import random

import numpy as np

from spanforge.operators import dictionary as L


def test_values_are_put_in():
    rnd = random.Random(41)
    for _ in range(300):
        texts = [rnd.randbytes(rnd.choice([0, 1, 5, 30])) for _ in range(rnd.randint(0, 5))]
        values = [rnd.randbytes(rnd.randint(0, 4)) for _ in range(3)]
        ends, offsets = np.cumsum([0, *map(len, values)]), np.cumsum([0, *map(len, texts)])
        ranges, want = [], []
        for t, text in enumerate(texts):
            at, out = 0, b""
            while at < len(text) and rnd.random() < 0.7:
                a = rnd.randint(at, len(text) - 1)
                b = rnd.randint(a + 1, len(text))
                v = rnd.randrange(3)
                ranges.append((t, offsets[t] + a, offsets[t] + b, ends[v], len(values[v])))
                out, at = out + text[at:a] + values[v], b
            want.append(out + text[at:])
        text, start, end, at, size = np.array(ranges, np.int64).reshape(-1, 5).T
        body = np.frombuffer(b"".join(texts), np.uint8)
        out, to = L.put_in(body, offsets, text, start, end, np.frombuffer(b"".join(values), np.uint8), at, size)
        assert [out[a:b].tobytes() for a, b in zip(to, to[1:])] == want


def test_replaced_where_it_is_scanned(spark):
    """No spans and no folds over them in the plan; nulls, empty texts and terms without a value as before."""
    df = spark.createDataFrame([(1, "ab é日 abc"), (2, ""), (3, None), (4, "none")], "id int, text string")
    terms = spark.createDataFrame([("ab", "<1>"), ("abc", None), ("é日", "")], "term string, value string")
    done = L.replace_dictionary(df, terms, id_col="id")
    assert "lambda" not in done._jdf.queryExecution().analyzed().toString()
    assert sorted((r.id, r.redacted_text, r.redacted_count) for r in done.collect()) == [(1, "<1>  ", 3), (2, "", 0), (3, None, 0), (4, "none", 0)]
    joined = L.replace_dictionary(df, terms, id_col="id", most=0).collect()
    assert sorted(map(tuple, joined)) == sorted(map(tuple, done.collect()))
