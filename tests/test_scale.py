"""Dictionaries, archives, pages and boxes at scale against plain versions."""

import collections
import difflib
import itertools
import random
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanforge.operators import detect as D
from spanforge.operators import dictionary as L
from spanforge.operators import catalog, fuzzy, paging, reports, runs, spatial
from spanforge.plans import checks_scale
from spanforge.sources import archive, docx
from spanforge.streaming import live

TERMS = {"ORG": ["aa", "aab", "é日", "日", "b", "ab", "a" * 70 + "b", "aa"], "PER": ["aa", "ba", "😀a", "a" * 65]}
TEXTS = ["aaaa", "", None, "aabaab é日日 😀aab", "a" * 200 + "b" + "a" * 70, "nothing", "日é日b"]


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(1)
    more = ["".join(rnd.choice("aab é日😀") for _ in range(rnd.randint(0, 900))) for _ in range(40)]
    return spark.createDataFrame(list(enumerate(TEXTS + more)), "id long, text string")


@pytest.fixture(scope="module")
def terms(spark):
    rows = [(k, t, n) for n, (k, t) in enumerate((k, t) for k, ts in TERMS.items() for t in ts)]
    return spark.createDataFrame([*rows, ("ORG", None, 99), ("ORG", "", 99)], "type string, term string, pos int")


def plain(text, words):
    return sorted((i, i + len(w), n) for n, w in words for i in range(len(text or "")) if (text or "").startswith(w, i))


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_dictionary_is_find_terms(texts, terms, most):
    fields = lambda s: (s.start, s.end, s.type, s.text, s.coref_id)
    got = {r.id: [fields(s) for s in r.spans] for r in L.find_dictionary(texts, terms, id_col="id", pos_col="pos", most=most).collect()}
    want = {r.id: [fields(s) for s in r.spans] for r in D.find_terms(texts, TERMS).collect()}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert all([s[0] for s in v] == sorted(s[0] for s in v) for v in got.values())


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_dictionary_finds_overlaps(texts, terms, most):
    unique = [(n, w) for n, w in enumerate(dict.fromkeys(w for ws in TERMS.values() for w in ws))]
    table = texts.sparkSession.createDataFrame([("X", w, n) for n, w in unique], "type string, term string, pos int")
    for r in L.hits(texts, table, id_col="id", pos_col="pos", most=most).collect():
        assert [(h.start, h.end, h.pos) for h in r.hits] == plain(r.text, unique)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_dictionary_replaces_the_longest(texts, most):
    mapping = {"aa": "1", "aab": "22", "ab": "3", "é日": "", "日": "日日", "a" * 70 + "b": "long"}
    table = texts.sparkSession.createDataFrame(list(mapping.items()), "term string, value string")
    rows = L.replace_dictionary(texts, table, id_col="id", most=most).collect()
    for r in rows:
        out, n, i = "", 0, 0
        while r.text and i < len(r.text):
            best = max((w for w in mapping if r.text.startswith(w, i)), key=len, default=None)
            out, n, i = out + (r.text[i] if best is None else mapping[best]), n + (best is not None), i + len(best or "x")
        assert (r.redacted_text or "") == out and r.redacted_count == n
    assert L.replace_dictionary(texts, table.limit(0), id_col="id", most=most).where("redacted_count > 0").count() == 0


def test_dictionary_plan_does_not_grow(texts):
    size = lambda n: len(L.find_dictionary(texts, texts.sparkSession.range(n).select(F.lit("X").alias("type"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("term")), id_col="id")._jdf.queryExecution().analyzed().toString())
    assert abs(size(10) - size(50_000)) < 200


def test_automaton_with_deep_states(monkeypatch):
    monkeypatch.setattr(L, "DENSE", 3)
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))).encode() for _ in range(60)})
    body = "".join(rnd.choice("abc") for _ in range(5000)).encode()
    text, end, term = L.Automaton(pa.array(words)).scan(np.frombuffer(body, np.uint8), np.array([0, 700, 700, 5000]))
    want = sorted((k, i + len(w), n) for k, (a, b) in enumerate([(0, 700), (700, 700), (700, 5000)]) for n, w in enumerate(words) for i in range(a, b) if body.startswith(w, i, b))
    assert sorted(zip(text.tolist(), end.tolist(), term.tolist())) == want


def test_archive_opens_elsewhere(spark, tmp_path):
    rows = [("a.txt", b"x" * 100_000), ("é/日.txt", b""), ("none", None), *((f"{k}.bin", random.Random(k).randbytes(k * 37)) for k in range(300))]
    path = f"{tmp_path}/all.zip"
    df = spark.createDataFrame(rows, "zip_name string, content binary").repartition(7)
    assert archive.write_archive(df, path) == len(rows)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == {n: c or b"" for n, c in rows}
    back = archive.read_archive(spark, f"file://{path}").collect()
    assert {r.zip_name: bytes(r.content) for r in back} == {n: c or b"" for n, c in rows}
    assert archive.write_archive(df.limit(0), path) == 0 and zipfile.ZipFile(path).namelist() == []
    with pytest.raises(ValueError):
        archive.write_archive(df, "hdfs://host/all.zip")


def test_archive_beyond_four_gigabytes(spark, tmp_path):
    import zlib

    path, at, content = f"{tmp_path}/far.zip", 5 << 30, b"far away " * 50
    packed = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    packed = packed.compress(content) + packed.flush()
    head = (b"far", zlib.crc32(content), len(packed), len(content))
    with open(path, "wb") as f:
        f.seek(at)
        f.write(archive.local_header(*head) + packed)
        size = f.write(archive.central_header(*head, at))
        f.write(archive.end_record(1, size, f.tell() - size))
    with zipfile.ZipFile(path) as z:
        assert z.read("far") == content
    assert [bytes(r.content) for r in archive.read_archive(spark, path).collect()] == [content]


def test_ranks_and_pages(spark):
    rnd = random.Random(4)
    rows = [(k, rnd.choice([None, 1, 1, 1, 2, 3]), rnd.choice("ab")) for k in range(1000)]
    df = spark.createDataFrame(rows, "id int, g int, s string").repartition(5)
    want = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[2], r[0]))
    made = paging.ranked(df, F.desc_nulls_first("g"), "s", "id", partitions=7)
    assert made.total == 1000 and len(made.counts) <= 7
    assert [(r.rank, *r[:3]) for r in sorted(made.numbered().collect(), key=lambda r: r.rank)] == [(k, *r) for k, r in enumerate(want, 1)]
    for number, size in ((1, 10), (31, 32), (32, 32), (4, 300), (9, 300), (1, 0)):
        asked = want if size == 0 else want[(number - 1) * size : number * size]
        assert [tuple(r) for r in made.page(number, size).collect()] == asked
    bounds = sorted(made.pages(300, ["id"]).collect())
    assert [(b.page, b.n, b.first.id, b["last"].id) for b in bounds] == [(k + 1, len(p), p[0][0], p[-1][0]) for k, p in enumerate([want[i : i + 300] for i in range(0, 1000, 300)])]
    assert paging.ranked(df.limit(0), "id").page(3, 5).count() == 0
    # A page's filter reaches the files.
    assert "PushedFilters: [Or(" in made.page(5, 60)._jdf.queryExecution().toString() or "GreaterThanOrEqual(_place" in made.page(5, 60)._jdf.queryExecution().toString()


def test_reading_on(spark):
    rows = sorted((k % 17, k) for k in range(300))
    df = spark.createDataFrame(rows, "t int, id int").repartition(4)
    for down in (False, True):
        want, last, got = sorted(rows, reverse=down), None, []
        while part := [tuple(r) for r in paging.after(df, ["t", "id"], last, 70, descending=down).collect()]:
            got, last = got + part, part[-1]
        assert got == want


def _iou(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return 0.0 if w <= 0 or h <= 0 or union <= 0 else w * h / union


@pytest.fixture(scope="module")
def crowd(spark):
    rnd = random.Random(6)
    size = lambda: rnd.choice([0.0, 0.01, 0.1, 0.1, 1.0, 1.0, 3.0, 30.0]) * rnd.choice([1, 1.3])
    rows = [(k, rnd.randint(1, 2), rnd.uniform(-5, 5), rnd.uniform(-5, 5), size(), size()) for k in range(500)]
    rows += [(500, 1, 0.0, 0.0, 1.0, 1.0), (501, 1, 1.0, 0.0, 1.0, 1.0), (502, 1, 0.0, 0.0, 1.0, 1.0)]
    odd = [(600, None, 0.0, 0.0, 1.0, 1.0), (601, 1, None, 0.0, 1.0, 1.0), (602, 1, float("nan"), 0.0, 1.0, 1.0), (603, 1, 0.0, 0.0, -1.0, 1.0)]
    return rows, spark.createDataFrame(rows + odd, "id int, page int, x double, y double, width double, height double")


@pytest.mark.parametrize("few", [32, 10_000])
@pytest.mark.parametrize("least", [0.0, 0.05, 0.5])
def test_meeting_boxes(crowd, least, few, monkeypatch):
    rows, df = crowd
    monkeypatch.setattr(spatial, "FEW", few)
    got = sorted((r.a.id, r.b.id) for r in spatial.meeting(df, df, page=["page"], least=least).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and _iou(a[2:], b[2:]) > least)
    far = df.where("id % 3 = 0")
    left = sorted(r.id for r in spatial.without_meeting(df, far, page=["page"], least=least).collect())
    met = {a[0] for a in rows for b in rows if b[0] % 3 == 0 and a[1] == b[1] and _iou(a[2:], b[2:]) > least}
    assert left == sorted({*(r[0] for r in rows), 600, 601, 602, 603} - met)


def test_first_kept_is_a_walk(crowd):
    rows, df = crowd
    kept = []
    for r in sorted(rows):
        if not any(k[1] == r[1] and _iou(k[2:], r[2:]) >= 0.02 for k in kept):
            kept.append(r)
    got = sorted(r.id for r in spatial.first_kept(df, page=["page"], order=["id"], least=0.02).collect())
    assert got == [r[0] for r in kept] + [600, 601, 602, 603]
    assert spatial.first_kept(df.limit(0), page=["page"], order=["id"], least=0.02).count() == 0


def test_named_characters_meet():
    rnd = random.Random(7)
    for _ in range(4000):
        a = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 30)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            b[rnd.randrange(len(b))] = rnd.choice(["", "a", "x", "bc"])
        b = "".join(b)
        if b and difflib.SequenceMatcher(None, a, b).ratio() > 0.85:
            assert set(fuzzy.named(a, 0.85)) & set(fuzzy.named(b, 0.85)), (a, b)


def test_common_subsequences():
    rnd = random.Random(14)
    for _ in range(500):
        a, b = ("".join(rnd.choice("abc日") for _ in range(rnd.randint(0, 20))) for _ in range(2))
        row = [0] * (len(a) + 1)
        for c in b:
            row = [0, *itertools.accumulate(range(len(a)), lambda left, k: max(left, row[k + 1], row[k] + (a[k] == c)), initial=0)][1:]  # noqa: B023
        assert fuzzy.common(a, b) == row[-1]
        assert difflib.SequenceMatcher(None, a, b).ratio() * (len(a) + len(b)) <= 2 * fuzzy.common(a, b) + 1e-9 or not a + b


def test_fuzzy_matches_are_the_plain_ones(spark):
    entities, blocks = checks_scale.misread(spark, "/root/testdata/sf0.001")
    pages = collections.defaultdict(list)
    for b in blocks.collect():
        pages[b.conv_id].append((b.pos, b.text))
    want, pairs = [], 0
    for e in entities.collect():
        for pos, text in sorted(pages[e.conv_id]):
            pairs += 1
            if e.text and (e.text in text or difflib.SequenceMatcher(None, e.text, text).ratio() > 0.85):
                want.append((e.conv_id, e.entity_id, pos, "text_match" if e.text in text else "fuzzy_match"))
                break
    got = checks_scale.fuzzy_matches(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.conv_id, r.entity_id, r.pos, r.source) for r in got) == sorted(want) and want
    # On one page with all turns few pairs are left to align.
    one = [df.withColumn("page", F.lit(1)).withColumn(k, F.monotonically_increasing_id()) for df, k in ((entities, "entity_id"), (blocks, "pos"))]
    n = blocks.count()
    assert fuzzy.candidates(*one, page=["page"]).count() < 0.25 * n * n
    near = sorted((r.entity_id, r.pos) for r in fuzzy.alike(*one, page=["page"]).collect())
    texts = [[(r[k], r.text) for r in df.collect()] for df, k in zip(one, ("entity_id", "pos"))]
    assert near == sorted((e, b) for e, x in texts[0] for b, y in texts[1] if difflib.SequenceMatcher(None, x, y).ratio() > 0.85 and x and y)


def test_drafts_after_silence(spark, tmp_path):
    """Rows of three keys in files whose times overlap, against gaps worked out over all of them."""
    rnd = random.Random(8)
    rows = [(k, rnd.choice("abc"), i * 400 + rnd.randint(0, 900), f"d{k}") for i, k in enumerate(range(300))]
    schema = "place long, who string, ms long, draft string"
    for n in range(5):
        spark.createDataFrame(rows[n * 60 : n * 60 + 60], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").select("place", "who", F.timestamp_millis("ms").alias("ts"), "draft")
    with live.with_timers(spark):
        saved = live.saved_after_silence(stream, key="who", time="ts", place="place", draft="draft", silence="900 milliseconds", late="5 seconds")
        got = sorted(r.place for r in live.run_to_table(saved, f"file://{tmp_path}/out").collect())
        kept = spark.read.format("statestore").option("stateVarName", "waiting").load(f"file://{tmp_path}/out/progress").select("list_element.*").collect()
    mark, want = max(r[2] for r in rows) - 5_000, []
    for who in "abc":
        own = sorted((ms, place) for place, w, ms, _ in rows if w == who)
        want += [place for (ms, place), after in zip(own, [*own[1:], None]) if ms + 900 <= mark and (after is None or after[0] - ms >= 900)]
    assert got == sorted(want) and len(want) > 20
    # Nothing that is settled stays in the state.
    assert sorted(r.place for r in kept) == sorted(place for place, _, ms, _ in rows if ms + 900 > mark)


def test_counts_follow_each_batch(spark, tmp_path):
    rnd, state, steps = random.Random(9), {}, []
    for k in range(400):
        item, new = rnd.randrange(40), rnd.choice(["queued", "running", "done"])
        steps.append((k, item % 4, state.get(item), new))
        state[item] = new
    schema = "k int, job int, old string, new string"
    for n in range(4):
        spark.createDataFrame(steps[n * 100 : n * 100 + 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        got = live.run_upserted(live.live_counts(stream, job="job", old="old", new="new"), f"file://{tmp_path}/out", ["job", "status"]).where("n <> 0").collect()
        now = {}
        for _, job, old, new in steps[: n * 100 + 100]:
            now[job, new] = now.get((job, new), 0) + 1
            if old:
                now[job, old] -= 1
        assert {(r.job, r.status): r.n for r in got} == {k: v for k, v in now.items() if v}


def test_runs_are_rewritten_by_majority(spark):
    rnd = random.Random(10)
    mapping = {"ab": "1", "abc": "22", "cab": "", "bb": "bb!", "a" * 9: "long"}
    paragraphs = [[("".join(rnd.choice("abc") for _ in range(rnd.choice([0, 1, 1, 2, 3, 9, 70])))) for _ in range(rnd.randint(1, 12))] for _ in range(60)] + [["a" * 200, "aab", None, "b"], [None]]
    rows = [(p, k, t) for p, texts in enumerate(paragraphs) for k, t in enumerate(texts)] + [(None, 0, "xab"), (None, 1, "c")]
    df = spark.createDataFrame(rows, "p int, run int, text string")
    table = spark.createDataFrame(list(mapping.items()), "term string, value string")
    got = collections.defaultdict(list)
    for r in runs.rewrite_runs(df.where("p is not null"), table, paragraph=["p"]).orderBy("p", "run").collect():
        got[r.p].append(r)
    for p, texts in enumerate(paragraphs):
        want, n = docx.rewrite_runs([t or "" for t in texts], mapping)
        assert [r.redacted_text or "" for r in got[p]] == want and sum(r.redacted_count for r in got[p]) == n
    assert runs.rewrite_runs(df, table, paragraph=["p"]).count() == len(rows)


def test_names_in_natural_order(spark):
    names = ["b 10", "b 9", "B 9a", "a2", "a 002", "a 10", "é1", "e 2", "", None, "x 99999999999999999999", "x 100000000000000000000", "乙", "甲"]
    rows = [(k, n, "p" if k % 2 else "") for k, n in enumerate(names)]
    got = [r.name for r in catalog.recognition_order(spark.createDataFrame(rows, "id int, name string, regex_pattern string")).collect()]
    assert got[: len(names) // 2] == [n for n in got if rows[names.index(n)][2]]
    order = [r.name for r in catalog.recognition_order(spark.createDataFrame([(k, n, None) for k, n in enumerate(names) if n], "id int, name string, regex_pattern string")).collect()]
    at = order.index
    assert at("a 002") < at("a 10") and at("b 9") < at("B 9a") < at("b 10") and at("x 99999999999999999999") < at("x 100000000000000000000") and at("a2") < at("b 9") < at("e 2") and at("甲") < at("乙")


def test_reports_of_rows_and_of_tables(spark):
    rnd = random.Random(13)
    rows = [(k, k % 5, [(rnd.choice("AB"), rnd.choice("xy"), rnd.choice([0.9, 0.6, 0.1]), rnd.choice([True, False, None])) for _ in range(rnd.randint(0, 6))]) for k in range(40)]
    df = spark.createDataFrame(rows + [(99, 1, None)], "doc int, redacted_count int, spans array<struct<type:string,source:string,confidence:double,selected:boolean>>")
    columns = ["doc", "total", "selected_total", "coverage", "coverage_rate"]
    own = {r.doc: r for r in reports.quality_of_rows(df).collect()}
    apart = {r.doc: r for r in reports.quality_report(df.select("doc", F.inline("spans")), df.select("doc", "redacted_count"), doc="doc").collect()}
    assert own.keys() == apart.keys()
    for k, r in own.items():
        assert [r[c] for c in columns] == [apart[k][c] for c in columns]
        assert all(r[c] == (apart[k][c] or {}) for c in ("by_type", "by_source", "by_confidence"))
