"""Operator 13, source divergence audit: how the words of a language's sources differ, by exact integers in dense tiles.

Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased.  A language keeps the terms that ``LEAST_DOCS`` of
its documents have; a group (language, source) gives each kept term a smoothed share p in billionths, and two shares p and q are
(p - q)^2 / q apart, rounded down.  For each group the other sources come in the order of their distance summed over all kept
terms (part ``pair``), and the terms that it has more of than its language, the first ``TOP`` of them (part ``term``).

Batches of texts count their own terms before anything is shuffled, and terms are summed by (language, term, source) before they
meet by (language, term), so a frequent term or a large source is no one task's.  The kept terms of a language fall into blocks
by a hash, as many as keep groups x terms under ``CELLS``; a block is one dense int64 tile, a row per group, whose rows are held
against all others by broadcasting, one row at a time.  Tiles give partial pair matrices, which are summed, and a heap of terms for each group, which
are merged in two steps.  What stays in one task: a tile (at least all groups of a language by one term) and the pairs of a group,
which are rows of the result.

All arithmetic is exact: int64 holds every step while a language has fewer than 2^47 term occurrences (a share is divided in two
steps, and a sum of distances is under 4 * 10^18 + what rounding adds); beyond that the tile is an error.

Null texts, languages and sources count as empty strings; an empty table gives no rows; equal rows count as often as they come;
other columns are not read.
"""

from __future__ import annotations

import heapq
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import store
from spanforge.llm import words as W
from spanforge.llm.memory import lean

LEAST_DOCS, TOP = 3, 200
#: Numbers in a tile, bytes of text that are counted together, and parts that heaps are merged in first.
CELLS, STEP_BYTES, PARTS = 1 << 20, 8 << 20, 64
MOST = 1 << 47
COUNTS = "lang string, source string, term string, n long, docs long"
ROWS = "lang string, source string, part string, item string, value long"


def terms_of(body: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, for each occurrence its place among them, and its text)."""
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = letter[body]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(body)]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    kept = lower[body[inside]]
    text = np.searchsorted(offsets, starts, "right") - 1
    before = np.cumsum(inside) - 1
    found, places = W.distinct(kept, before[starts])
    return found, places.astype(np.int64), text


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, offsets = W.buffers(batch.column(2))
        langs, sources = (batch.column(k).dictionary_encode() for k in (0, 1))
        group = langs.indices.to_numpy().astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy()
        for a, b in W.steps(offsets, STEP_BYTES):
            terms, places, text = terms_of(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if not len(places):
                continue
            # A term of a document, then of a group.
            of_text, n = np.unique(text * len(terms) + places, return_counts=True)
            own, place = np.unique(group[a:b], return_inverse=True)
            key, inverse = np.unique(place[of_text // len(terms)] * len(terms) + of_text % len(terms), return_inverse=True)
            docs = np.bincount(inverse, minlength=len(key))
            n = np.bincount(inverse, weights=n, minlength=len(key)).astype(np.int64)
            of = own[key // len(terms)]
            width = max(1, len(sources.dictionary))
            parts = [langs.dictionary.take(pa.array(of // width)), sources.dictionary.take(pa.array(of % width)), terms.take(pa.array(key % len(terms))).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*parts, pa.array(n), pa.array(docs.astype(np.int64))], ["lang", "source", "term", "n", "docs"])


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / total), in two steps of long division that stay in int64."""
    more = (counts + 1) * 32_000
    return 1 + more // totals * 31_250 + more % totals * 31_250 // totals


def _tile(top: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        lang = key[0].as_py()
        order = pc.sort_indices(right.column("source"))
        sources, totals = right.column("source").take(order), right.column("total").take(order).to_numpy()
        kept = right.column("kept")[0].as_py() if right.num_rows else 0
        if totals.sum() + kept >= MOST:
            raise ValueError(f"language {lang!r} has too many terms for exact numbers")
        left = left.take(pc.sort_indices(left.column("term")))
        terms, lists = left.column("term").to_pylist(), left.column("groups").combine_chunks()
        counts = np.zeros((len(sources), len(terms)), np.int64)
        if len(terms):
            flat = lists.flatten()
            row = pc.index_in(flat.field("source"), value_set=sources.combine_chunks()).to_numpy()
            counts[row, np.repeat(np.arange(len(terms)), lists.value_lengths().to_numpy())] = flat.field("n").to_numpy()
        share = shares(counts, np.maximum(totals + kept, 1)[:, None])
        whole = shares(counts.sum(0), np.int64(max(1, totals.sum() + kept)))
        out = {k: [] for k in ("source", "part", "item", "value")}
        names = sources.to_pylist()
        for k, name in enumerate(names):
            apart = share[k] - share
            value = (apart * apart // share).sum(1).tolist()
            more = np.flatnonzero((counts[k] > 0) & (share[k] > whole))
            over = share[k, more] - whole[more]
            gain = over * over // whole[more]
            heap = [(more[i], gain[i]) for i in np.lexsort((more, -gain))[:top]]
            others = [j for j in range(len(names)) if j != k]
            out["source"] += [name] * (len(others) + len(heap))
            out["part"] += ["pair"] * len(others) + ["term"] * len(heap)
            out["item"] += [names[j] for j in others] + [terms[t] for t, _ in heap]
            out["value"] += [value[j] for j in others] + [int(v) for _, v in heap]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.table([pa.array([lang] * len(out["item"]), pa.string()), *(pa.array(v, kind) for v, kind in zip(out.values(), kinds))], ["lang", *out])

    return run


def _heap(top: int):
    def run(table: pa.Table) -> pa.Table:
        items, values = table.column("item").to_pylist(), table.column("value").to_pylist()
        best = heapq.nsmallest(top, zip(map(operator.neg, values), items))
        head = [table.column(c).slice(0, 1).to_pylist() * len(best) for c in ("lang", "source", "part")]
        return pa.table([*(pa.array(h, pa.string()) for h in head), pa.array([i for _, i in best], pa.string()), pa.array([-v for v, _ in best], pa.int64()), pa.array(range(1, len(best) + 1), pa.int32())], ["lang", "source", "part", "item", "value", "rank"])

    return run


def audit(docs: DataFrame, *, least_docs: int = LEAST_DOCS, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: for each group the other sources of its language and its own terms."""
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = rows.mapInArrow(lean(_count), COUNTS).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("groups")).where(F.col("docs") >= least_docs).drop("docs")
    kept = store.written(kept, "kept-terms")

    own = kept.select("lang", F.inline("groups")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"))
    groups = store.written(groups, "groups")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("n")).join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)).cast("long"))
    sizes = sizes.select("lang", "kept", F.greatest(F.lit(1), F.ceil(F.col("kept") * F.col("n") / cells)).cast("long").alias("blocks"))
    sizes = store.written(sizes, "languages")

    # A language may hold most terms, so its size is sent to parts of them.
    salted = sizes.drop("kept").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    salt = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")
    left = kept.withColumn("salt", salt).join(salted, ["lang", "salt"]).select("lang", F.pmod(F.xxhash64(F.lit("block"), "term"), "blocks").alias("block"), "term", "groups")
    right = groups.join(sizes, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "total", "kept")
    tiles = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(_tile(top), ROWS)
    tiles = store.written(tiles, "tiles")

    from pyspark.sql import Window

    pairs = tiles.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    ranked = f"{ROWS}, rank int"
    heaps = tiles.where("part = 'term'").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(PARTS)))
    terms = heaps.groupBy("lang", "source", "salt").applyInArrow(_heap(top), ranked).groupBy("lang", "source").applyInArrow(_heap(top), ranked)
    return pairs.unionByName(terms)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT n.lang, n.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (n.total + v.v) AS p
      FROM n JOIN kept ON n.lang = kept.lang JOIN v ON v.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = kept.term),
m AS (SELECT lang, sum(total) AS total FROM n GROUP BY lang),
l AS (SELECT p.lang, p.term, 1 + (1000000000::HUGEINT * (sum(p.n)::HUGEINT + 1)) // (m.total::HUGEINT + v.v) AS q FROM p JOIN m ON m.lang = p.lang JOIN v ON v.lang = p.lang GROUP BY p.lang, p.term, m.total, v.v),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p.p - l.q) * (p.p - l.q) // l.q)::BIGINT FROM p JOIN l ON p.lang = l.lang AND p.term = l.term WHERE p.n > 0 AND p.p > l.q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r) WHERE part = 'pair' OR rank <= 200
"""
