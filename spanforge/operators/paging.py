"""Ranks of ordered tables of any size, and their pages.

Rows are dealt by ranges of their order, sorted in each range and written once with the range's number and their place in it.
Counts by range, summed up before each range, give every row's rank without one task that sees all rows.  A page is a stretch of
places in one range, or in few: reading it is a filter on two stored columns, which the files' statistics answer, so page 10,000
costs what page 1 does.  ``after`` reads on from a known last row instead (keyset paging).

The order must tell rows apart, or equal rows come in any order; nulls come where the given order puts them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.sources import shared

#: The bits of a row's place in its range, as ``monotonically_increasing_id`` gives them.
PLACE_BITS = 33


@dataclass
class Ranked:
    """A table in order: ``rows`` with its range (``_part``) and place there (``_place``), and how many rows each range has."""

    rows: DataFrame
    columns: list[str]
    counts: list[int]

    @property
    def total(self) -> int:
        return sum(self.counts)

    def numbered(self, rank_col: str = "rank") -> DataFrame:
        """All rows with their rank, from 1."""
        before = [sum(self.counts[:k]) for k in range(len(self.counts))]
        # As many rows as there are ranges.
        parts = self.rows.sparkSession.createDataFrame(list(enumerate(before)), "_part int, _before long")
        return self.rows.join(F.broadcast(parts), "_part").select(*self.columns, (F.col("_before") + F.col("_place") + 1).alias(rank_col))

    def between(self, first: int, last: int) -> DataFrame:
        """The rows of ranks ``first`` to ``last`` (from 1), in order; only their ranges are read."""
        wanted, before = F.lit(False), 0
        for part, n in enumerate(self.counts):
            a, b = max(first - before, 1), min(last - before, n)
            if a <= b:
                wanted = wanted | ((F.col("_part") == part) & F.col("_place").between(a - 1, b - 1))
            before += n
        return self.rows.where(wanted).orderBy("_part", "_place").select(*self.columns)

    def page(self, number: int, size: int) -> DataFrame:
        """The rows of a page (from 1); size 0 is all."""
        return self.between(1, self.total) if size == 0 else self.between((max(number, 1) - 1) * size + 1, max(number, 1) * size)

    def pages(self, size: int, key_cols: list[str]) -> DataFrame:
        """A row per page: its number (``page``), rows (``n``) and the keys of its first and last row (``first``, ``last``)."""
        key, page = F.struct(*key_cols), F.floor((F.col("_rank") - 1) / size) + 1
        rows = self.numbered("_rank").groupBy(page.cast("long").alias("page"))
        return rows.agg(F.count("*").alias("n"), F.min_by(key, "_rank").alias("first"), F.max_by(key, "_rank").alias("last"))


def ranked(df: DataFrame, *order: Column | str, partitions: int | None = None) -> Ranked:
    """``df`` in an order, written to the shared folder."""
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("_id", place)
    dealt = dealt.select(*df.columns, F.shiftright("_id", PLACE_BITS).cast("int").alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("_place"))
    rows = shared.written(dealt, shared.fresh_path(spark, "ranked"))
    found = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    return Ranked(rows, df.columns, [found.get(k, 0) for k in range(max(found, default=-1) + 1)])


def after(df: DataFrame, order: list[str], last: tuple | None, size: int, *, descending: bool = False) -> DataFrame:
    """The next ``size`` rows behind the row whose ``order`` columns are ``last`` (none: the first ones); no column is null."""
    sort = [F.desc(c) if descending else F.asc(c) for c in order]
    if last is not None:
        behind = F.lit(False)
        for c, value in reversed(list(zip(order, last))):
            more = F.col(c) < F.lit(value) if descending else F.col(c) > F.lit(value)
            behind = more | ((F.col(c) == F.lit(value)) & behind)
        # The first column alone is what a scan can skip by.
        first = F.col(order[0]) <= F.lit(last[0]) if descending else F.col(order[0]) >= F.lit(last[0])
        df = df.where(first & behind)
    return df.orderBy(*sort).limit(size)


def clamped_page(number: Column, total: Column, size: Column) -> Column:
    """The page asked for, or the last there is, or the first."""
    pages = F.ceil(total / F.greatest(size, F.lit(1)))
    return F.greatest(F.lit(1), F.least(number, pages)).cast("long")
