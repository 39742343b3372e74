"""Entities matched to the text blocks of their page, in part or almost: no entity is compared with all blocks.

Two texts whose ratio of matching characters is over t share more than t/2 of all their characters, counted with repetitions, and
the shorter has t/(2-t) of the longer's length at least.  So texts meet by length classes and by the rarest of their counted
characters (a character and the how-manyth it is): a text of n characters names n - n t/(2-t) + 1 of them, and any two texts that
are alike name one in common.  The shared characters are then counted, the longest common subsequence bounds what can match in order, and only pairs that still
can be over t are aligned.

Pages with few texts are gathered instead, a row a page, and each entity looks at the blocks in their order and stops at the first that
matches; only pages with more than ``FEW`` texts, as counted, are looked up by characters.
"""

from __future__ import annotations

import difflib
import functools
import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import boxes as B
from spanforge.sources import shared

LEAST = 0.85
#: Entities and blocks together that a page may have to be gathered.
FEW = 128


def named(text: str, least: float) -> list[str]:
    """The counted characters that a text is looked up by; high counts are rare, so they come first."""
    n = len(text)
    counted = sorted((-k, c) for c, many in Counter(text).items() for k in range(many))
    return [f"{c}{-k}" for k, c in counted[: n - math.ceil(n * least / (2 - least) - 1e-9) + 1]]


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, whose places in ``a`` are bits of one number: no alignment matches more."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    whole = free = (1 << len(a)) - 1
    for c in b:
        met = free & places.get(c, 0)
        free = (free + met | free - met) & whole
    return len(a) - free.bit_count()


counted = functools.lru_cache(maxsize=1 << 12)(Counter)


def may_be(a: str, b: str, least: float) -> bool:
    """Whether the lengths, the counted characters and the longest common subsequence leave a ratio over ``least``; the cheapest first,
    and all before a matcher is made, which takes longer than these."""
    n = len(a) + len(b)
    if least <= 0 or not n:
        return True
    return 2 * min(len(a), len(b)) / n > least and 2 * (counted(a) & counted(b)).total() / n > least and 2 * common(a, b) > least * n


def _names(least: float):
    @F.pandas_udf("array<string>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([named(t or "", least) for t in texts])

    return of


def ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """Ratio of matching blocks of characters; null where a bound shows that it is not over ``least``: the lengths, the counted
    characters, the longest common subsequence."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            p, q = p or "", q or ""
            out.append(difflib.SequenceMatcher(None, p, q).ratio() if may_be(p, q, least) else None)
        return pd.Series(out, dtype="float64")

    return of(a, b)


def length_class(text: Column, least: float) -> Column:
    """Texts that are alike are in one class or in neighbouring ones."""
    return F.floor(F.log(F.length(text).cast("double")) / math.log((2 - least) / least)).cast("int")


def candidates(entities: DataFrame, blocks: DataFrame, *, page: list[str], least: float = LEAST) -> DataFrame:
    """(page, entity_id, pos) of all pairs that may be over ``least``, each once."""
    some = lambda df: df.where(F.length("text") > 0)
    around = F.array(*[length_class(F.col("text"), least) + k for k in (-1, 0, 1)])
    asked = some(entities).select(*page, "entity_id", F.length("text").alias("_n"), F.explode(around).alias("_size"), _names(least)("text").alias("_names"))
    there = some(blocks).select(*page, "pos", F.length("text").alias("_m"), length_class(F.col("text"), least).alias("_size"), _names(least)("text").alias("_names"))
    key = [*page, "_size", "_name"]
    pairs = asked.withColumn("_name", F.explode("_names")).drop("_names").join(there.withColumn("_name", F.explode("_names")).drop("_names"), key)
    long_enough = 2 * F.least("_n", "_m") > least * (F.col("_n") + F.col("_m"))
    return pairs.where(long_enough).select(*page, "entity_id", "pos").distinct()


def alike(entities: DataFrame, blocks: DataFrame, *, page: list[str], least: float = LEAST) -> DataFrame:
    """(page, entity_id, pos, ratio) of the pairs whose ratio is over ``least``; ``entity_id`` and ``pos`` are unique on a page."""
    pairs = candidates(entities, blocks, page=page, least=least)
    texts = pairs.join(entities.select(*page, "entity_id", F.col("text").alias("_entity")), [*page, "entity_id"]).join(blocks.select(*page, "pos", F.col("text").alias("_block")), [*page, "pos"])
    return texts.select(*page, "entity_id", "pos", ratio(F.col("_entity"), F.col("_block"), least).alias("ratio")).where(F.col("ratio") > least)


def first_matches(asked: list[str], there: list[str | None], least: float) -> list[int]:
    """For each text the place of the first of ``there`` that holds it, or is almost it, twice, and one more if it is almost it; -1 without."""
    found: dict[str, int] = {"": -1}
    matchers: dict[int, difflib.SequenceMatcher] = {}
    for text in asked:
        if text in found:
            continue
        found[text] = -1
        for k, block in enumerate(there):
            if not block:
                continue
            if text in block:
                found[text] = 2 * k
                break
            if not may_be(text, block, least):
                continue
            # What a matcher knows of its second text stays.
            m = matchers.get(k) or matchers.setdefault(k, difflib.SequenceMatcher(None, "", block))
            m.set_seq1(text)
            if m.ratio() > least:
                found[text] = 2 * k + 1
                break
    return [found[t] for t in asked]


def _gathered(entities: DataFrame, blocks: DataFrame, page: list[str], least: float) -> DataFrame:
    """Page, entity_id, text, pos, source and the block of each match, for pages with few texts."""

    @F.pandas_udf("array<int>")
    def of(asked: pd.Series, there: pd.Series) -> pd.Series:
        return pd.Series([first_matches(list(a), list(b), least) for a, b in zip(asked, there)], dtype=object)

    own = entities.where(F.length("text") > 0).groupBy(*page).agg(F.collect_list(F.struct("entity_id", "text")).alias("_asked"))
    block = F.struct("pos", "text", "left", "top", "width", "height")
    both = own.join(blocks.where(F.length("text") > 0).groupBy(*page).agg(F.array_sort(F.collect_list(block)).alias("_there")), page)
    found = both.withColumn("_found", of(F.transform("_asked", lambda x: x["text"]), F.transform("_there", lambda x: x["text"])))
    rows = found.select(*page, "_asked", "_there", F.posexplode_outer("_found").alias("_k", "_m")).where(F.col("_m") >= 0)
    rows = rows.select(*page, F.get("_asked", F.col("_k")).alias("_e"), F.get("_there", F.floor(F.col("_m") / 2).cast("int")).alias("_b"), F.when(F.col("_m") % 2 == 0, "text_match").otherwise("fuzzy_match").alias("source"))
    return rows.select(*page, "_e.entity_id", "_b.pos", "source", "_e.text", F.col("_b.text").alias("_block"), "_b.left", "_b.top", "_b.width", "_b.height")


def _looked_up(entities: DataFrame, blocks: DataFrame, page: list[str], least: float) -> DataFrame:
    """The same for pages with any number of texts."""
    # Texts that are there several times on a page are compared once, by their first entity and block; rows are moved by these, not by text.
    asked = entities.where(F.length("text") > 0).groupBy(*page, "text").agg(F.min("entity_id").alias("entity_id"))
    there = blocks.groupBy(*page, "text").agg(F.min("pos").alias("pos"))
    inside = asked.join(there.select(*page, "pos", F.col("text").alias("_block")), page).where(F.contains("_block", F.col("text")))
    found = inside.select(*page, "entity_id", "pos", F.lit("text_match").alias("source"))
    almost = alike(asked, there, page=page, least=least).select(*page, "entity_id", "pos", F.lit("fuzzy_match").alias("source"))
    first = found.unionByName(almost).groupBy(*page, "entity_id").agg(F.min(F.struct("pos", F.when(F.col("source") == "text_match", 0).otherwise(1).alias("kind"), "source")).alias("_m"))
    of_text = asked.join(first, [*page, "entity_id"]).select(*page, "text", "_m")
    rows = entities.select(*page, "entity_id", "text").join(of_text, [*page, "text"]).select(*page, "entity_id", F.col("_m.pos").alias("pos"), F.col("_m.source").alias("source"), "text")
    return rows.join(blocks.select(*page, "pos", F.col("text").alias("_block"), "left", "top", "width", "height"), [*page, "pos"])


def match_entities(entities: DataFrame, blocks: DataFrame, *, page: list[str], least: float = LEAST) -> DataFrame:
    """For each entity (entity_id, text) the first block (pos, text, left, top, width, height) of its page that contains its text
    (``text_match``, confidence 1) or is almost it (``fuzzy_match``, 0.9).  A contained text gets its part of the block's width,
    unless the block is long, a list or much wider than it; entities without a match have no row."""
    # Both come by page alone; few pages have many texts.
    counts = entities.select(*page).unionByName(blocks.select(*page)).groupBy(*page).agg(F.count("*").alias("_n")).where(F.col("_n") > FEW)
    crowded = shared.written(counts.drop("_n"), shared.fresh_path(entities.sparkSession, "crowded"))
    if crowded.isEmpty():
        rows = _gathered(entities, blocks, page, least)
    else:
        some = lambda df, how: df.join(crowded, page, how)
        rows = _gathered(some(entities, "left_anti"), some(blocks, "left_anti"), page, least).unionByName(_looked_up(some(entities, "left_semi"), some(blocks, "left_semi"), page, least))
    start, size, n = F.instr("_block", F.col("text")) - 1, F.length("text"), F.length("_block")
    parts = F.size(F.regexp_extract_all("_block", F.lit(r"[,;，；、|]"), F.lit(0)))
    whole = (F.col("source") == "fuzzy_match") | (n > 100) | (size / n < 0.1) | (parts >= 2) | F.col("_block").rlike(r"  |\t")
    part = B.sub_box(F.col("left"), F.col("width"), F.col("_block"), start, size)
    side = {c: F.when(whole, F.col(c)).otherwise(part[c]) for c in ("left", "width")}
    return rows.withColumns(side).withColumn("confidence", F.when(F.col("source") == "text_match", 1.0).otherwise(0.9)).drop("_block")
