"""Operator 11, quality classifier: learned vectors of words and character n-grams, averaged per document, with a softmax on top.

Words stand between white space.  A word's features are itself and its n-grams of ``MIN_N`` to ``MAX_N`` characters, with ``<`` and
``>`` as its ends; each falls into one of ``BUCKETS`` by a hash and has a vector of ``WIDTH`` numbers there.  Of word pairs only
those of equal words count, which share a bucket.  A document is the mean
of its features' vectors; a softmax layer gives its labels' probabilities.  Vectors and layer are trained together by stochastic
gradient descent in numpy, a document at a time.

Training uses at most ``SAMPLE_DOCS`` labelled documents, those of the smallest hashes of the id, of at most ``LONGEST`` bytes each
and ``SAMPLE_BYTES`` of text together; only the buckets and counts of their whole texts come to the driver.  Scoring needs the product of the vectors and the layer alone, two numbers a
bucket, so that a word that occurs often in a batch is worked out once and a text is a sum over its words.  Every text is scored
whole, with the same model for all, and alike in any batch.

Null texts and texts without words have no features, and the layer's constants decide.  Without anything to learn from all score
0.5.  Labels that are null or not 0 or 1 are not learned from; a document whose id has several labels is learned with each.  Rows with equal or null ids keep
their own scores; a null id is not held out and not learned from; columns other than the kept ones and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.llm import store
from spanforge.llm import words as W
from spanforge.llm.memory import lean

MIN_N, MAX_N, BITS, WIDTH = 3, 4, 17, 16
BUCKETS = 1 << BITS
#: The bucket of a word that repeats the one before it, whichever that is.
AGAIN = BUCKETS
SAMPLE_DOCS, SAMPLE_BYTES, LONGEST = 4096, 16 << 20, 1 << 20
#: Documents that training looks at, the same ones again where there are fewer.
STEPS, RATE, SEED = 20_480, 0.5, 11
STEP_BYTES = 4 << 20
AT_LEAST = 0.3


def _buckets(code: np.ndarray, salt: int) -> np.ndarray:
    mixed = (code ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)


def features(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, words they are of) of the features of distinct words."""
    n = len(found)
    body, offsets = W.buffers(found)
    points = np.frombuffer(body.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    at = np.append(0, np.cumsum((body & 0xC0) != 0x80))[offsets]
    # Words with their ends.
    size = np.diff(at) + 2
    first = np.append(0, np.cumsum(size))
    marked = np.full(first[-1], ord("<"), np.uint64)
    word = np.repeat(np.arange(n), size)
    place = np.arange(len(marked)) - first[word]
    inside = (place > 0) & (place < size[word] - 1)
    marked[inside] = points
    marked[first[1:] - 1] = ord(">")
    power = np.cumprod(np.append(np.uint64(1), np.full(max(0, int(size.max(initial=0)) - 1), 0x100000001B3, np.uint64)))
    buckets, words = [_buckets(np.add.reduceat(marked * power[place], first[:-1]) if n else np.zeros(0, np.uint64), 1)], [np.arange(n)]
    code = np.zeros(len(marked), np.uint64)
    for k in range(MAX_N):
        end = max(0, len(marked) - k)
        code = code[:end] * np.uint64(0x100000001B3) + marked[k:]
        if k + 1 >= MIN_N:
            own = word[:end] == word[k:]
            buckets.append(_buckets(code[own], k + 2))
            words.append(word[:end][own])
    return np.concatenate(buckets), np.concatenate(words)


def words_of(body: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, for each word of the texts its place among them, and its text)."""
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    inside = ~space[body]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(body)]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    found, places = W.distinct(body[inside], (np.cumsum(inside) - 1)[starts])
    return found, places.astype(np.int64), np.searchsorted(offsets, starts, "right") - 1


def repeated(places: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """How many words of each of ``n`` texts repeat the word before."""
    again = (places[1:] == places[:-1]) & (text[1:] == text[:-1])
    return np.bincount(text[1:][again], minlength=n)


@dataclass
class Model:
    """What each bucket adds to the labels' logits, and their constants."""

    logits: np.ndarray
    bias: np.ndarray

    def scores(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        found, places, text = words_of(body, offsets)
        buckets, of = features(found)
        count = np.bincount(of, minlength=len(found))
        again = repeated(places, text, n)
        total = np.maximum(np.bincount(text, weights=count[places], minlength=n) + again, 1)
        of_words = [np.bincount(of, weights=column[buckets], minlength=len(found)) for column in self.logits.T]
        sums = [(np.bincount(text, weights=w[places], minlength=n) + again * column[AGAIN]) / total + b for w, column, b in zip(of_words, self.logits.T, self.bias)]
        return 1 / (1 + np.exp(np.clip(sums[0] - sums[1], -700, 700)))


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], *, steps: int = STEPS, rate: float = RATE, width: int = WIDTH) -> Model:
    """Stochastic gradient descent over (buckets, counts, label); the rate falls to nothing along a line."""
    chance = np.random.default_rng(SEED)
    vectors = chance.uniform(-1 / width, 1 / width, (BUCKETS + 1, width)).astype(np.float32)
    layer, bias = np.zeros((width, 2), np.float32), np.zeros(2, np.float32)
    epochs, done = -(-steps // len(docs)), 0
    for _ in range(epochs):
        for k in chance.permutation(len(docs)):
            buckets, counts, label = docs[k]
            share = counts.astype(np.float32) / max(1, counts.sum())
            own = vectors[buckets]
            mean = share @ own
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            gap = p / p.sum()
            gap[label] -= 1
            gap *= rate * (1 - done / (epochs * len(docs)))
            vectors[buckets] = own - share[:, None] * (layer @ gap)
            layer -= np.outer(mean, gap)
            bias -= gap
            done += 1
    return Model(vectors.astype(np.float64) @ layer.astype(np.float64), bias.astype(np.float64))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, offsets = W.buffers(batch.column(2))
        rows = []
        for a, b in zip(offsets[:-1], offsets[1:]):
            found, places, text = words_of(body[a:b], np.array([0, b - a]))
            buckets, of = features(found)
            counts = np.bincount(buckets, weights=np.bincount(places, minlength=len(found))[of], minlength=BUCKETS + 1)
            counts[AGAIN] = repeated(places, text, 1)[0]
            own = np.flatnonzero(counts)
            rows.append((int(b - a), own.astype("<u4").tobytes(), counts[own].astype("<u4").tobytes()))
        sizes, buckets, counts = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(buckets, pa.binary()), pa.array(counts, pa.binary())], ["pick", "label", "size", "buckets", "counts"])


def train(df: DataFrame, labels: DataFrame, *, label_col: str = "quality", most: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Learns from the rows (doc_id, text) that ``labels`` (doc_id, a column of 0 and 1) marks."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    pick = F.xxhash64(F.lit("quality"), "doc_id")
    n = known.count()
    part = min(1.0, 1.5 * most / max(1, n))
    asked = known.where(F.pmod(pick, F.lit(1 << 30)) < part * (1 << 30)).withColumn("pick", pick).orderBy("pick", "label").limit(most)
    # At most ``most`` rows of three numbers.
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") <= LONGEST)
    rows = rows.join(F.broadcast(asked), "doc_id").select("pick", "label", "text")
    bags = store.written(rows.mapInArrow(lean(_bags), "pick long, label int, size long, buckets binary, counts binary"), "bags")
    order = ["pick", "label", "size", "buckets", "counts"]
    total, taken = 0, 0
    for row in bags.select("pick", "label", "size").orderBy("pick", "label", "size").limit(most).collect():
        total += row["size"]
        if total > most_bytes:
            break
        taken += 1
    docs = [(np.frombuffer(b, "<u4").astype(np.int64), np.frombuffer(c, "<u4"), label) for b, c, label in zip(*(bags.orderBy(*order).limit(taken).toArrow().column(k).to_pylist() for k in ("buckets", "counts", "label")))]
    return fit(docs) if docs else None


def _score(sent, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = W.buffers(batch.column(len(names) - 1))
            scores = [np.zeros(0)]
            for a, b in W.steps(offsets, STEP_BYTES):
                scores.append(sent.value.scores(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) if sent.value else np.full(b - a, 0.5))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names) - 1)), pa.array(np.concatenate(scores))], names)

    return run


def score(df: DataFrame, model: Model | None, *, keep: list[str], text_col: str = "text", out_col: str = "score") -> DataFrame:
    """The columns ``keep`` with the probability of label 1."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out_col, T.DoubleType())])
    rows = df.select(*keep)
    text = F.col(text_col).cast("string").alias(store.free_name(rows, "_text"))
    return df.select(*keep, text).mapInArrow(lean(_score(sent, [*keep, out_col])), schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    scored = score(docs.withColumn("held_out", held_out(F.col("doc_id"))), model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= AT_LEAST).cast("int"))
