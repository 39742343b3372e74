"""Walks and pairs of boxes on pages whose boxes hang together."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from spanforge.operators import boxes as O
from spanforge.operators import spatial

ITEM = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"


def by_sql(name, path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet/*.parquet'")
    return con.execute(entry.oracle_sql()[name]).fetchall()


def test_a_box_dropped_drops_none(spark, tmp_path):
    """Of 0, 4 and 8 hundredths the last meets the middle one alone, which is gone; names that are equal are walked by their sides."""
    rows = [(1, 0, 0, 1, 9.0, 1.0), (1, 4, 0, 1, 9.0, 1.0), (1, 8, 0, 1, 9.0, 1.0), (2, 5, 5, 1, 9.0, 1.0), (2, 5, 5, 1, 8.0, 1.0), (2, 5, 5, 2, 8.0, 1.0)]
    spark.createDataFrame(rows, ITEM).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in entry.queries()["merge_sequential"](spark, str(tmp_path)).collect())
    assert got == sorted(by_sql("merge_sequential", tmp_path)) == [(1, 1, 2), (2, 1, 1), (2, 2, 1)]


def _iou(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return 0.0 if w <= 0 or h <= 0 or union <= 0 else w * h / union


@pytest.fixture(scope="module")
def crowd(spark):
    """Boxes of like sizes close together, wide ones among them, over many tiles."""
    rnd = random.Random(21)
    rows = [(k, rnd.randint(1, 2), rnd.uniform(-4, 4), rnd.uniform(-4, 4), rnd.choice([0.3, 0.5, 0.5, 20.0]), rnd.choice([0.3, 0.4])) for k in range(1500)]
    return rows, spark.createDataFrame(rows, "id int, page int, x double, y double, width double, height double")


def test_tiles_give_what_a_page_gives(crowd, monkeypatch):
    rows, df = crowd
    monkeypatch.setattr(spatial, "LIKED", 30)
    own, _ = spatial._on_pages(df, ["page"])
    dealt = spatial.Tiles.of(own, ["page"], 0.1)
    assert len(dealt.size) == 2 and dealt.home(own).select("page", *spatial.TILE).distinct().count() > 60
    got = sorted((r.a.id, r.b.id) for r in spatial.in_order(df, page=["page"], order=["id"], least=0.1).collect())
    assert got == [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and _iou(a[2:], b[2:]) > 0.1]
    kept = []
    for r in rows:
        if not any(k[1] == r[1] and _iou(k[2:], r[2:]) >= 0.3 for k in kept):
            kept.append(r)
    assert sorted(r.id for r in spatial.first_kept(df, page=["page"], order=["id"], least=0.3).collect()) == [r[0] for r in kept]
    far = df.where("id % 3 = 0")
    met = {a[0] for a in rows for b in rows if b[0] % 3 == 0 and a[1] == b[1] and _iou(a[2:], b[2:]) > 0.3}
    assert sorted(r.id for r in spatial.without_meeting(df, far, page=["page"], least=0.3).collect()) == sorted({r[0] for r in rows} - met)


def test_boxes_too_close_for_tiles(crowd, monkeypatch):
    _, df = crowd
    ids = lambda: sorted(r.id for r in spatial.first_kept(df, page=["page"], order=["id"], least=0.3).collect())
    tiled = ids()
    monkeypatch.setattr(spatial, "MOST", 3)
    assert spatial.Tiles.of(spatial._on_pages(df, ["page"])[0], ["page"], 0.3) is None and ids() == tiled


@pytest.mark.parametrize("copies", [1, 40])
def test_other_sources_on_a_crowded_page(spark, copies):
    """Of other sources a box goes by what is kept and by earlier ones of its kind, equal ones too; crowded pages as small ones."""
    rnd = random.Random(22)
    box = lambda: (rnd.uniform(0, 2), rnd.uniform(0, 2), 0.5, rnd.choice([0.4, 0.5]))
    pages = [[(*box(), rnd.choice(["ocr_has", "has_image", "hand", None])) for _ in range(8)] for _ in range(60)]
    pages = [p + [q for q in p if q[4] == "hand"] for p in pages]
    # Pages as one, far from each other, are crowded.
    rows = [(n % copies if copies > 1 else n, n * 100.0 * (copies > 1), *b) for n, p in enumerate(pages) for b in p]
    rows = [(page if copies == 1 else 0, x + far, y, w, h, s) for page, far, x, y, w, h, s in rows]
    df = spark.createDataFrame(rows, "page int, x double, y double, width double, height double, source string")
    got = sorted((r.page, r.x, r.y, str(r.source)) for r in O.dual_dedup(df, page=["page"]).collect())
    want, on_page = [], {}
    for r in rows:
        on_page.setdefault(r[0], []).append(r)
    for all_ in on_page.values():
        kept = [r for r in all_ if r[5] == "ocr_has"]
        kept += [r for r in all_ if r[5] == "has_image" and not any(_iou(k[1:5], r[1:5]) > 0.3 for k in kept)]
        for r in sorted((r for r in all_ if r[5] in ("hand", None)), key=lambda r: (r[1:5], r[5] or "")):
            if not any(_iou(k[1:5], r[1:5]) > 0.3 for k in kept):
                kept.append(r)
        want += [(r[0], r[1], r[2], str(r[5])) for r in kept]
    assert got == sorted(want)
