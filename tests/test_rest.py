import io
import zipfile

import pytest
from pyspark.sql import functions as F

from spanforge.functions import boxes as B
from spanforge.operators import boxes as O
from spanforge.operators import catalog as C
from spanforge.operators import history as H
from spanforge.operators import jobs as J
from spanforge.operators import reports as R
from spanforge.operators import state as S
from spanforge.sources import docx, files, sinks
from spanforge.streaming import machines as M

BOX = "struct<x:double,y:double,width:double,height:double>"


def test_iou_thresholds(spark):
    df = spark.createDataFrame([([(0.0, 0.0, 1.0, 1.0)], [(0.0, 0.0, 1.0, 0.5), (5.0, 5.0, 1.0, 1.0), (5.0, 5.0, 1.0, 0.9)])], f"a array<{BOX}>, b array<{BOX}>")
    assert len(df.select(O.merge_in_order(F.col("a"), F.col("b")).alias("m")).first().m) == 2
    rows = [(1, 1, 0.0, 0.0, 1.0, 1.0, "ocr_has"), (1, 1, 0.0, 0.0, 1.0, 0.3, "has_image"), (1, 1, 0.0, 0.0, 1.0, 0.4, "has_image"), (1, 1, 3.0, 3.0, 1.0, 1.0, "manual"), (1, 1, 3.0, 3.0, 1.0, 0.9, "manual"), (1, 1, 0.0, 0.0, 1.0, 0.9, "manual")]
    kept = O.dual_dedup(spark.createDataFrame(rows, "doc int, page int, x double, y double, width double, height double, source string"), page=["doc", "page"]).collect()
    assert sorted((r.source, r.height) for r in kept) == [("has_image", 0.3), ("manual", 0.9), ("ocr_has", 1.0)]


def test_boxes(spark):
    one = spark.createDataFrame([(0.999, -0.1, 0.0001, 0.5)], "x double, y double, width double, height double")
    px = one.select(*[v.alias(k) for k, v in B.to_pixels({s: F.col(s) for s in B.SIDES}, F.lit(100), F.lit(100)).items()]).first()
    assert tuple(px) == (99, 0, 1, 50)
    poly = spark.createDataFrame([([[1.9, 2.0], [5.5, 2.0], [5.5, 7.7], [1.9, 7.7]],)], "p array<array<double>>")
    assert tuple(poly.select(*B.polygon_box(F.col("p")).values()).first()) == (1, 2, 4, 5)
    assert O.class_indices(None) is None and O.class_indices([]) == [] and O.class_indices(["paper", "x"]) == [20]
    assert O.chosen_types([], [], ["a"], ["d"]) == ["d"] and O.chosen_types(["x"], None, ["a"], ["d"]) == ["a"] and O.chosen_types([], ["a"], ["a"], ["d"]) == []
    assert O.cells_of("<table><tr><td>a<td colspan=2>b &amp; c</tr><tr><td></td></tr></table>", 0, 0, 90, 20) == [("a", 0, 0, 30, 10), ("b & c", 30, 0, 60, 10)]
    assert O.cells_of("no table", 0, 0, 1, 1) == []
    blocks = spark.createDataFrame([(1, 0, "other text", 0, 0, 10, 10), (1, 1, "Jon Smith Ltd", 5, 5, 10, 10)], "page int, pos int, text string, left int, top int, width int, height int")
    asked = spark.createDataFrame([(1, 7, "John Smith Ltd")], "page int, entity_id int, text string")
    assert O.fuzzy_blocks(asked, blocks, page=["page"]).first().left == 5
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.0, 1.0), (1, 2, 9.0, 9.0, 1.0, 1.0)], "page int, box_id int, x double, y double, width double, height double")
    better = spark.createDataFrame([(1, 0.1, 0.1, 1.0, 1.0)], "page int, x double, y double, width double, height double")
    assert sorted((r.box_id, r.x) for r in O.refine(boxes, better, page=["page"]).collect()) == [(1, 0.1), (2, 9.0)]
    seal = spark.range(1).select(O.is_seal(F.lit("Seal"), F.lit(None)).alias("a"), O.is_seal(F.lit(None), F.lit("x[公章]")).alias("b"), O.is_seal(F.lit("t"), F.lit("t")).alias("c")).first()
    assert tuple(seal) == (True, True, False)


def test_report_coverage_may_exceed_all(spark):
    spans = spark.createDataFrame([(1, "A", "regex", 0.8), (1, "B", "has", 0.5)], "doc int, type string, source string, confidence double")
    made = R.quality_report(spans, spark.createDataFrame([(1, 3), (2, 0)], "doc int, redacted_count int"), doc="doc").orderBy("doc").collect()
    assert made[0].coverage_rate == 150.0 and made[0].by_confidence == {"high": 1, "medium": 1} and made[1].total == 0 and made[1].coverage == 0.0


def test_files(spark):
    names = ["a.b.PDF", "x.md", "noext", ".hidden", "d/e.JPEG", "z.exe"]
    assert [r.t for r in spark.createDataFrame([(n,) for n in names], "n string").select(files.file_type(F.col("n")).alias("t")).collect()] == ["pdf", "txt", None, None, "image", None]
    data = [("text é".encode(), "text é"), ("中文".encode("gbk"), "中文"), (b"\xff\xfe\xfd\x80", b"\xff\xfe\xfd\x80".decode("latin-1")), (None, None)]
    got = {r.k: r.text for r in files.decoded(spark.createDataFrame([(k, bytearray(c) if c is not None else None) for k, (c, _) in enumerate(data)], "k int, content binary")).collect()}
    assert got == {k: t for k, (_, t) in enumerate(data)}
    pages = spark.createDataFrame([(["x" * 99],), (["x" * 100],)], "pages array<string>")
    assert [r.file_type for r in files.classified_pdf(pages).collect()] == ["pdf_scanned", "pdf"]
    from spanforge.functions import text as X

    got = spark.range(1).select(X.html_text(F.lit("<style a>x{}</style> <p>a&amp;b</p>\n<SCRIPT>1</SCRIPT> c ")).alias("h"), X.rtf_text(F.lit(r"{\rtf1 \b Hello\b0  world}")).alias("r")).first()
    assert got.h == "a&amp;b c" and got.r == "Hello world"
    up = spark.createDataFrame([("a.pdf", bytearray(b"%PDF-1"), None, None, None), ("b.png", bytearray(b"%PDF-1"), None, None, None), ("c.txt", bytearray(b"hi"), "batch", None, None), ("../d\x01.txt", bytearray(b"hi"), None, " g 1", "x"), ("e.txt", bytearray(b"hi"), None, "g-1", None)], "filename string, content binary, upload_source string, batch_group_id string, job_id string")
    got = {r.filename: r for r in files.registered(up).collect()}
    assert got["a.pdf"].error is None and got["b.png"].error and got["c.txt"].error and got["../d\x01.txt"].original_filename == "d.txt" and got["e.txt"].upload_source == "batch"
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, t int")
    new = files.upserted(table, spark.createDataFrame([(1, "c", 2)], "id int, v string, t int"), "id", "t")
    assert {(r.id, r.v) for r in new.collect()} == {(1, "c"), (2, "b")}
    assert {(r.id, r.v) for r in files.patched(table, spark.createDataFrame([(2, "z")], "id int, v string"), "id").collect()} == {(1, "a"), (2, "z")}


def word_file(*runs):
    body = "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs)
    xml = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p>{body}</w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>bob</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def test_word_files(spark):
    data = word_file("I am b", "ob the", " great")
    assert docx.text_of(data) == "I am bob the great\nc1 | bob"
    new, n = docx.rewrite(data, {"bob": "X", "bo": "Y"})
    assert n == 2 and docx.text_of(new) == "I am X the great\nc1 | X"
    assert docx.rewrite_runs(["ab", "cd"], {"bcd": "Z"}) == (["a", "Z"], 1)
    rows = spark.createDataFrame([(bytearray(data), {"bob": "X"}), (bytearray(b"no"), {})], "content binary, entity_map map<string,string>")
    assert [r.redacted_count for r in sinks.docx_outputs(rows).collect()] == [2, None]
    assert [r.pages for r in files.parse_with(rows, docx.parser).collect()][0] == ["I am bob the great\nc1 | bob"]


def test_sinks(spark, tmp_path):
    base = C.preset(spark)
    path = str(tmp_path / "catalog")
    assert sinks.load_catalog(spark, path, C.SCHEMA, base).count() == 52
    sinks.save_catalog(base.limit(3), path)
    assert sinks.load_catalog(spark, path, C.SCHEMA, base).count() == 3
    key = F.lit(b"0123456789abcdef")
    row = spark.range(1).select(sinks.encrypted(F.lit("text"), key).alias("e")).select(sinks.decrypted(F.col("e"), key).cast("string").alias("d"), sinks.decrypted(F.concat("e", F.lit(b"x")), key).alias("bad")).first()
    assert tuple(row) == ("text", None)
    lines = sinks.audit_rows(spark.range(2), F.lit("delete"), F.lit("file"), F.col("id").cast("string"), F.lit("u"), F.lit(None).cast("string"))
    sinks.write_audit(lines, str(tmp_path / "audit"))
    sinks.write_audit(lines, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).where("action = 'delete'").count() == 4
    out = io.BytesIO()
    assert sinks.write_zip([("a", b"1"), ("b", b"2")], out) == 2 and zipfile.ZipFile(out).namelist() == ["a", "b"]


def test_catalogs(spark):
    base = C.preset(spark)
    assert C.listed(base, enabled_only=True).count() == 49 and C.regex_types(base).count() == 17
    with pytest.raises(ValueError):
        C.deleted(base, "PERSON", ["PERSON"])
    assert not C.toggled(base, "PERSON").where("id = 'PERSON'").first().enabled
    made = C.created(base, {"category": "quasi"})
    assert made.where("id like 'custom_%'").first().order == 200
    configs = spark.createDataFrame([("{}",), ('{"wizard_furthest_step": "3.7", "image_redaction_strength": 0}',), ('{"wizard_furthest_step": true}',), ('{"wizard_furthest_step": 9, "replacement_mode": "mask", "entity_type_ids": ["A"]}',)], "c string")
    own = C.redaction_config(F.col("c"))
    got = configs.select(C.wizard_step(F.col("c")).alias("w"), own["replacement_mode"].alias("m"), own["image_redaction_strength"].alias("s"), F.size(own["entity_type_ids"]).alias("n")).collect()
    assert [tuple(r) for r in got] == [(None, "structured", 25, 0), (3, "structured", 25, 0), (None, "structured", 25, 0), (None, "mask", 25, 1)]
    assert H.last_page(9, 25, 10) == 3 and H.last_page(1, 0, 10) == 1


@pytest.mark.parametrize("entity, current, target, want", [("job", "draft", "queued", "ok"), ("job", "completed", "completed", "idempotent"), ("job", "cancelled", "queued", "illegal"), ("job", "running", "completed", "ok"), ("item", "pending", "completed", "illegal"), ("item", "ner", "failed", "ok"), ("item", "failed", "pending", "ok"), ("item", "completed", "pending", "illegal")])
def test_transitions(spark, entity, current, target, want):
    assert spark.range(1).select(J.transition(entity, F.lit(current), F.lit(target)).alias("t")).first().t == want


def test_tri_state(spark):
    rows = spark.createDataFrame([(True, None), (False, "completed"), (False, "pending"), (False, None)], "o boolean, s string")
    assert [r.t for r in rows.select(H.redaction_state(F.col("o"), F.col("s")).alias("t")).collect()] == ["redacted", "awaiting_review", "unredacted", "unredacted"]


def calls(spark, times, **more):
    names = list(more)
    return spark.createDataFrame([(k, "a", float(t), *(more[n][k] for n in names)) for k, t in enumerate(times)], ", ".join(["id long, key string, t double", *(f"{n} {'boolean' if isinstance(more[n][0], bool) else 'string'}" for n in names)]))


def answers(df, machine, inputs, out):
    return [r[2] for r in S.fold(df, machine, key="key", time="t", id_col="id", inputs=inputs, out=out).orderBy("id").collect()]


def test_machines(spark):
    assert answers(calls(spark, [0, 1, 2, 60.5]), S.sliding_limit(2, 60), [], "allowed boolean") == [True, True, False, True]
    assert answers(calls(spark, [0, 10, 3600, 3700], r=["a", "b", "c", "d"]), S.first_result(3600), ["r"], "r2 string") == ["a", "a", "c", "c"]
    assert answers(calls(spark, [0, 1, 2, 11.5, 12], s=[False, False, True, True, False]), S.lockout(2, 10), ["s"], "o string") == ["failed", "failed", "locked", "ok", "failed"]
    assert answers(calls(spark, [0, 1, 2, 31.5, 32], s=[False, False, True, True, True]), S.breaker(2, 30), ["s"], "o string") == ["closed", "closed", "open", "half_open", "closed"]
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "completed"), (1, 4, "b")], "k int, n int, status string")
    assert [r.n for r in S.changed(S.until_done(log, key="k", order=["n"]), key="k", order=["n"], columns=["status"]).orderBy("n").collect()] == [1, 3]


def test_streams(spark, tmp_path):
    rows = [(k, "a", float(t)) for k, t in enumerate([0, 1, 2, 60.5])]
    spark.createDataFrame(rows, "id long, key string, t double").write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema("id long, key string, t double").parquet(str(tmp_path / "calls"))
    got = M.drain(M.limited(stream, key="key", time="t", id_col="id", most=2, window=60), "limited").orderBy("id").collect()
    assert [r.allowed for r in got] == [True, True, False, True]
    spark.createDataFrame([(1, 1, "queued"), (1, 2, "queued"), (1, 3, "completed"), (1, 4, "queued")], "k long, n int, status string").coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("k long, n int, status string").parquet(str(tmp_path / "log"))
    assert M.drain(M.changes(stream, key="k", columns=["status"], order="n"), "changes").count() == 2
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events*.parquet")
    assert M.drain(M.tumbling(events, time="ts", size="1 hour", late="10 minutes", by=["event_type"]), "windows").count() > 0
    assert M.drain(M.sessions(events, time="ts", gap="10 minutes", late="10 minutes", by=["user_id"]), "sessions").count() > 0
    assert M.drain(M.first_of_key(events, key="user_id", time="ts"), "firsts").count() > 0


@pytest.mark.parametrize("block_rows", [1, 3, 1 << 16])
def test_long_lists_are_numbered_in_blocks(spark, block_rows):
    groups = ["a", "a", None, None, None, "b", "a", "a", "a", "a", "a", "c", None, "c"]
    rows = [(w, pos, g) for w in ("x", None) for pos, g in zip([None, *range(-4, 9)], groups)]
    table = spark.createDataFrame(rows, "w string, pos long, name string").repartition(3)
    want = [1, 1, 2, 2, 2, 3, 4, 4, 4, 4, 4, 5, 6, 7]
    got = H.runs(table, group=F.col("name"), within=("w",), block_rows=block_rows)
    assert got.columns == ["w", "pos", "name", "run"]
    for w in ("x", None):
        found = sorted((r.pos is not None, r.pos or 0, r.run) for r in got.where(F.col("w").eqNullSafe(w)).collect())
        assert [f[-1] for f in found] == want
    one = table.where("w = 'x'").drop("w")
    assert sorted(r.run for r in H.runs(one, group=F.col("name"), block_rows=block_rows).collect()) == want
    assert H.runs(one.limit(0), group=F.col("name"), block_rows=block_rows).count() == 0
    named = sorted((r.pos is not None, r.pos or 0, r.zip_name) for r in H.zip_names(one, block_rows=block_rows).where("name = 'a'").collect())
    assert [n[-1] for n in named] == ["a", "1_a", "2_a", "3_a", "4_a", "5_a", "6_a"]
    assert H.zip_names(one, block_rows=block_rows).count() == len(groups)
