"""The pipeline's stages, each and in a row, against plain versions of them on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from spanforge.llm import bpe, decontam, secrets
from test_llm import _bucket, _grams, _least_edits, _plain_margins, _sets_of, _windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _fold(text):
    return decontam.fold(np.array([ord(c) for c in text], np.uint32), np.array([0, len(text)]))[0].tolist()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """(folder, rows, items): real texts of each language, near copies, benchmark passages, secrets, junk and odd rows."""
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 60 and 600").orderBy("doc_id").collect()
    rnd, rows, by_lang = random.Random(11), [], {}
    for r in base:
        if by_lang.setdefault(r.lang, 0) < 14:
            by_lang[r.lang] += 1
            rows.append((r.doc_id, r.text, r.lang, r.source, len(r.text)))
    words = " ".join(t for _, t, *_ in rows).split()
    items = [(k, " ".join(rnd.choice(words) for _ in range(15))) for k in range(4)]
    more = []
    for k, (_, text, lang, *_) in enumerate(rows[:8]):
        more.append((10_000 + k, text + " einer the la", lang))  # near copies
        more.append((10_100 + k, text, lang))  # exact ones
    more += [(10_200 + k, rows[20 + k][1] + " " + item.replace("e", "3", 1) + " " + rows[21][1][:50], rows[20 + k][2]) for k, (_, item) in enumerate(items)]
    more += [(10_300, rows[30][1] + ' password = "abcd1234efgh" ' + "deadbeef" * 5 + " Zm9vYmFyQkFaMTIzNDU2Nzg5MGFi end", None)]
    more += [(10_400, "12345 67890 " * 20, None), (10_401, None, None), (10_402, "", "en"), (10_403, "x9" * 200, None)]
    rows += [(k, t, lang, "made", len(t or "")) for k, t, lang in more]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def plain_language(rows):
    known = [(t, lang) for _, t, lang, *_ in rows if t is not None and lang is not None]
    margins = _plain_margins(known, [t or "" for _, t, *_ in rows], lambda t: {_bucket(g) for g in _grams(t)})[1].max(1)
    return [r for r, m in zip(rows, margins) if r[1] and any(c.isalpha() for c in r[1]) and (m + 1) / 2 >= 0.46]


def plain_near_dedup(rows):
    held = [_sets_of(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    root = lambda k: k if group[k] == k else root(group[k])
    for b in range(len(rows)):
        for a in range(b):
            if (not held[a] and not held[b]) or (held[a] and held[b] and len(held[a] & held[b]) >= 0.8 * len(held[a] | held[b])):
                group[root(a)] = root(b)
    least: dict = {}
    for k, r in enumerate(rows):
        least[root(k)] = min(least.get(root(k), r), r, key=lambda r: r[0])
    return sorted(least.values())


def plain_decontaminate(rows, items):
    budgets = [decontam.plan(len(_fold(t)), decontam.RATE)[1] for _, t in items]
    dirty = lambda text: any(_least_edits(_fold(t), _fold(text)) <= b for (_, t), b in zip(items, budgets))
    return [r for r in rows if not dirty(r[1])]


def plain_secrets(rows):
    out = []
    for key, text, lang, source, _ in rows:
        spans = [(m.start(), m.end()) for kind, p, g, least in secrets.BASE for m in re.finditer(p, text) if len(m[g]) >= least]
        gone = np.zeros(len(text) + 1, int)
        for a, b in spans + [(a, b) for a, _, b in _windows(text)]:
            gone[a] += 1
            gone[b] -= 1
        covered = np.cumsum(gone)[:-1] > 0
        made = re.sub("\0+", "[SECRET]", "".join("\0" if c else ch for c, ch in zip(covered, text)))
        out.append((key, made, lang, source, len(made)))
    return out


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_language_stage(spark, corpus):
    folder, rows, _ = corpus
    docs = spark.createDataFrame(rows, SCHEMA)
    made = stage("language")(spark, docs, folder)
    want = plain_language(rows)
    assert ids(made) == sorted(r[0] for r in want) and made.columns == docs.columns
    assert {10_400, 10_401, 10_402}.isdisjoint(ids(made)) and made.where("lang is null").count() == 0


def test_near_dedup_stage(spark, corpus):
    folder, rows, _ = corpus
    made = stage("near_dedup")(spark, spark.createDataFrame(rows, SCHEMA), folder)
    assert ids(made) == [r[0] for r in plain_near_dedup(rows)]
    assert not {*range(10_100, 10_108)} & {*ids(made)} and len({*range(10_000, 10_008)} & {*ids(made)}) < 8


def test_decontaminate_stage(spark, corpus):
    folder, rows, items = corpus
    rows = [r for r in rows if r[1] is not None]
    made = stage("decontaminate")(spark, spark.createDataFrame(rows, SCHEMA), folder)
    want = plain_decontaminate(rows, items)
    assert ids(made) == sorted(r[0] for r in want) and len(rows) - len(want) == 4


def test_secrets_stage(spark, corpus):
    folder, rows, _ = corpus
    rows = [r for r in rows if r[1] is not None]
    made = sorted(tuple(r) for r in stage("secrets")(spark, spark.createDataFrame(rows, SCHEMA), folder).collect())
    assert made == sorted(plain_secrets(rows)) and sum("[SECRET]" in r[1] for r in made) >= 1


def test_stages_in_a_row(spark, corpus):
    """``run`` over the folder against the plain stages one after another, then tiktoken."""
    folder, rows, items = corpus
    left = plain_secrets(plain_decontaminate(plain_near_dedup(plain_language(rows)), items))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(bpe.read_ranks(RANKS)), special_tokens={})
    want = sorted((k, tuple(encoding.encode_ordinary(t))) for k, t, *_ in left)
    got = sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == want and 20 < len(want) < len(rows)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_tables(spark, corpus, name):
    """Empty tables, rows of nulls, repeated rows, and columns that clash with a stage's own names."""
    folder, rows, _ = corpus
    docs = spark.createDataFrame(rows, SCHEMA)
    assert stage(name)(spark, docs.limit(0), folder).count() == 0
    nothing = spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)
    assert stage(name)(spark, docs.unionByName(docs).unionByName(nothing), folder).count() > 0
    clash = docs.withColumns({c: F.lit("mine") for c in ("lang_pred", "score", "lang_score", "_key", "_id", "dedup_text", "text_key", "root", "kept", "secret_spans", "spans", "block", "word", "keep")})
    made = stage(name)(spark, clash, folder)
    if name != "tokens":
        assert made.columns == clash.columns and {r.score for r in made.collect()} == {"mine"}
    else:
        first = made.where("doc_id = 10300").first()
        assert first.n_tokens == len(first.ids) and hashlib.sha256(np.array(first.ids, "<u4").tobytes()).hexdigest() == first.ids_sha256
