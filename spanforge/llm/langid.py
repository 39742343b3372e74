"""Operator 6, language identification: string kernels, Nyström landmarks, kernel ridge regression.

Two texts are as similar as their sets of character n-grams (lengths 1 to ``MAX_N`` blended, presence only) overlap:
|A ∩ B| / sqrt(|A| |B|).  N-grams are of folded letters, anything else is a space, and fall into ``BUCKETS`` by a hash.  A text
is described by its kernel values with ``LANDMARKS`` training texts, whitened by the landmarks' own kernel matrix (Nyström);
one ridge regression per language separates it from the rest.  Both steps are one matrix, so a batch of texts is scored by two
matrix products.

Training uses at most ``PER_LANG`` texts a language (``per_lang``), picked by a hash of the id, whose features alone come to the
driver: a fixed number of bytes per text.  Every text is scored whole, with the same model for all.

Null texts and texts without letters give ``und`` and score 0; so does every text if there is nothing to learn from.  Languages
that are null are not learned from; with a single language there is nothing to tell apart and every text with letters is of it;
every language has a landmark, however many there are; rows with equal or null ids keep their own predictions; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import store
from spanforge.llm import words as W
from spanforge.llm.memory import lean
from spanforge.llm.chars import folded, points

MAX_N, BUCKETS = 3, 1 << 14
PER_LANG, LANDMARKS, RIDGE = 400, 96, 1e-3
STEP_BYTES, STEP_ROWS = 1 << 20, 256
UNKNOWN = "und"
#: Score under which a text is of no learned language (a margin of -0.08).  Of 3,358 held-out documents at sf0.1 11 lie under
#: -0.1 (4 to 154 characters) and 14 under -0.06; probed texts of other languages, numbers, hexadecimal and base64 junk lie at 0.45 or less.
LEAST = 0.46


def presence(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x buckets: whether an n-gram is there, whether the text has letters)."""
    n = len(offsets) - 1
    cp, at = points(body, offsets)
    letter = W.classes()[cp] == W.LETTER
    cp = np.where(letter, folded()[cp], 32).astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    flags = np.zeros(n * BUCKETS, bool)
    code, end = np.zeros(len(cp), np.uint32), len(cp)
    for k in range(MAX_N):
        end = len(cp) - k
        if end <= 0:
            break
        code = code[:end] * np.uint32(0x01000193) + cp[k:] * np.uint32(0x9E3779B1) + np.uint32(k + 1)
        inside = row[:end] == row[k:]
        mixed = (code ^ code >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        flags[(row[:end] * BUCKETS + (mixed >> np.uint32(32 - 14)))[inside]] = True
    has = np.zeros(n, bool)
    has[row[letter]] = True
    return flags.reshape(n, BUCKETS), has


def batches_of(column: pa.Array):
    """(presence, has letters) of steps of the column, in order."""
    body, offsets = W.buffers(column)
    for a, b in W.steps(offsets, STEP_BYTES):
        for k in range(a, b, STEP_ROWS):
            end = min(k + STEP_ROWS, b)
            yield presence(body[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k])


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # landmarks x buckets, each row divided by the root of its size
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def margins(self, flags: np.ndarray) -> np.ndarray:
        size = np.sqrt(np.maximum(flags.sum(1), 1))
        return (flags.astype(np.float32) @ self.landmarks.T / size[:, None]).astype(np.float64) @ self.weights + self.bias


def fit(flags: np.ndarray, langs: list[str], *, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """One-versus-rest ridge regression on Nyström features; rows count so that languages weigh the same."""
    names = sorted(set(langs))
    label = np.array([names.index(x) for x in langs])
    unit = flags / np.sqrt(np.maximum(flags.sum(1, keepdims=True), 1))
    turn = np.zeros(len(label), np.int64)
    for k in range(len(names)):
        turn[label == k] = np.arange((label == k).sum())
    chosen = np.lexsort((label, turn))[: max(landmarks, len(names))]  # a text of each language in turn, of each one at least
    marks = unit[chosen]
    value, vector = np.linalg.eigh(marks @ marks.T)
    good = value > 1e-6 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])
    z = unit @ marks.T @ whiten
    weight = 1 / np.bincount(label)[label]
    weight = weight / weight.sum()
    target = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    mean, aim = weight @ z, weight @ target
    centred = (z - mean) * weight[:, None]
    beta = np.linalg.solve(centred.T @ (z - mean) + ridge * np.eye(z.shape[1]), centred.T @ (target - aim))
    return Model(names, marks.astype(np.float32), whiten @ beta, aim - mean @ beta)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [np.packbits(f, axis=1) for f, _ in batches_of(batch.column(2))]
        rows = [r.tobytes() for b in bits for r in b]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["pick", "lang", "bits"])


def train(df: DataFrame, usable: Column, *, per_lang: int = PER_LANG) -> Model | None:
    """Learns from the rows (doc_id, text, lang) for which ``usable`` holds."""
    rows = df.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    part = F.lit(0.0)
    for lang, n in counts.items():
        part = F.when(F.col("lang") == lang, min(1.0, 1.5 * per_lang / n)).otherwise(part)
    pick = F.xxhash64(F.lit("language"), F.col("doc_id"))
    picked = rows.where(F.pmod(pick, F.lit(1 << 20)) < part * (1 << 20)).select(pick.alias("pick"), "lang", "text")
    taken = picked.mapInArrow(lean(_features), "pick long, lang string, bits binary").orderBy("pick", "lang", "bits").limit(2 * per_lang * len(counts)).toArrow()
    left, keep = dict.fromkeys(counts, per_lang), []
    langs = taken.column("lang").to_pylist()
    for k, lang in enumerate(langs):
        if left[lang]:
            left[lang] -= 1
            keep.append(k)
    bits = taken.column("bits").to_pylist()
    flags = np.unpackbits(np.frombuffer(b"".join(bits[k] for k in keep), np.uint8).reshape(len(keep), -1), axis=1).astype(np.float32)
    return fit(flags, [langs[k] for k in keep])


def _predict(model, place: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs: list[str] = []
            scores = [np.zeros(0)]
            for flags, has in batches_of(batch.column(place)):
                if model.value is None:
                    langs += [UNKNOWN] * len(has)
                    scores.append(np.zeros(len(has)))
                    continue
                margin = model.value.margins(flags)
                langs += [model.value.langs[k] if ok else UNKNOWN for k, ok in zip(margin.argmax(1), has)]
                scores.append(np.where(has, np.clip((margin.max(1) + 1) / 2, 0, 1), 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names) - 2)), pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names)

    return run


def predict(df: DataFrame, model: Model | None, *, keep: list[str], lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """The columns ``keep`` with the language and score of the column ``text``."""
    from pyspark.sql import types as T

    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    # A text that is kept is sent once.
    rows = df.select(*keep) if "text" in keep else df.select(*keep, F.col("text").cast("string").alias(store.free_name(df, "_text")))
    return rows.mapInArrow(lean(_predict(sent, keep.index("text") if "text" in keep else len(keep), [*keep, lang_col, score_col])), schema)


def learned(df: DataFrame, model: Model | None, least: float = LEAST) -> DataFrame:
    """The rows of a learned language: known, and scored ``least`` or more.  A null ``lang`` is filled in; all else stays."""
    lang, score = store.free_name(df, "lang_pred"), store.free_name(df, "lang_score")
    found = predict(df, model, keep=df.columns, lang_col=lang, score_col=score).where((F.col(lang) != UNKNOWN) & (F.col(score) >= least))
    return found.withColumn("lang", F.coalesce("lang", lang)).select(*df.columns)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    marked = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(marked, model, keep=["doc_id", "held_out"])
