"""Operator 9, token-id output: Arrow files of fixed-size lists, read without copying.

Documents are dealt by ranges of ``doc_id`` and sorted; each task encodes its texts, appends the end id and writes one file of
the random-access Arrow format.  A row is a sequence of ``seq_len`` ids (16 bits where the vocabulary allows) with a mask that
is false on the padding of a file's last sequence; every batch but the last has ``BATCH`` rows, so sequence i of a file is row
i % BATCH of batch i // BATCH, mapped and not copied.  An index table names each document's file and its place in it; files in
order of their first document are the corpus, so a window over the files gives the place in the whole.

Texts of a batch are cut into pre-tokens and each distinct one is encoded once, which gives the ids of the whole texts as the
pre-tokens are independent.  Strings of special tokens in a text are those tokens, as the library has it by default; with
``special_as_text`` they are ordinary text.

Null texts count as empty and give the end id alone; null ids come first, equal ids are ordered by text; an empty table gives
no files; other columns are not read.
"""

from __future__ import annotations

import functools
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm import store
from spanforge.llm import words as W

SEQ_LEN, BATCH = 2048, 64
BLOCK_BYTES = 8 << 20
VOCABULARY_BYTES = 64 << 20
#: Words whose ids a worker keeps from block to block.
KNOWN = 1 << 17
#: Words that are encoded as one text.
TOGETHER, TEXTS = 256, 32
INDEX = "file string, doc_id long, start long, n_tokens long"


@functools.lru_cache(2)
def _tokenizer(data: str, special_as_text: bool = False):
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(data)
    made.encode_special_tokens = special_as_text
    return made


def specials(tokenizer) -> list[bytes]:
    """Strings that the tokenizer takes out of a text before all else, longest first; none if they are text."""
    added = [] if tokenizer.encode_special_tokens else tokenizer.get_added_tokens_decoder().values()
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
        raise ValueError("special tokens that take their neighbours with them are not supported")
    return sorted((t.content.encode() for t in added), key=len, reverse=True)


def found_in(body: np.ndarray, offsets: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the strings in the texts, leftmost first, apart, none across two texts."""
    if not strings:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pattern = re.compile(b"|".join(map(re.escape, strings)))
    data, starts, ends = memoryview(np.ascontiguousarray(body)), [], []
    if any(s in bytes(data) for s in strings):
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            for m in pattern.finditer(data, a, b):
                starts.append(m.start())
                ends.append(m.end())
    return np.array(starts, np.int64), np.array(ends, np.int64)


class Encoder:
    """Encodes columns of texts; each distinct pre-token of a block once, and frequent ones once for many blocks."""

    def __init__(self, tokenizer):
        self.tokenizer, self.specials = tokenizer, specials(tokenizer)
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.large_list(pa.uint32()))

    def _plain(self, words: pa.Array) -> pa.Array | None:
        """Ids of words that all are a space and Latin letters: joined, they part again at the spaces."""
        parts = [words.slice(k, TOGETHER).to_pylist() for k in range(0, len(words), TOGETHER)]
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(parts), TEXTS):  # an encoding holds much more than its ids
            some = parts[k : k + TEXTS]
            for part, e in zip(some, self.tokenizer.encode_batch(["".join(p) for p in some], add_special_tokens=False)):
                size = np.bincount(e.word_ids, minlength=len(part))
                if len(size) != len(part):
                    return None
                ids.append(np.array(e.ids, np.uint32))
                sizes.append(size)
        return pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate(sizes)))), pa.array(np.concatenate(ids)))

    def _each(self, words: pa.Array) -> pa.Array:
        return pa.array([e.ids for e in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)], pa.large_list(pa.uint32()))

    def _new(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        plain = pc.match_substring_regex(words, "^ [A-Za-zÀ-ÖØ-öø-ÿ]+$")
        joined, other = words.filter(plain), words.filter(pc.invert(plain))
        ids = self._plain(joined)
        return pa.concat_arrays([joined, other]), pa.concat_arrays([self._each(joined) if ids is None else ids, self._each(other)])

    def blocks(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, end, ids, where each text's ids end) of blocks of the column."""
        body, offsets = W.buffers(column)
        for a, b in W.steps(offsets, BLOCK_BYTES):
            inner, at = body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            first, end = found_in(inner, at, self.specials)
            starts = W.cuts(inner, np.unique(np.concatenate([at, first, end])))
            # A special string is one piece, and what stands before and after it is cut as if it ended or began a text.
            within = np.searchsorted(end, starts, "right")
            starts = starts[~((within < len(first)) & (starts > np.append(first, len(inner))[within]))] if len(first) else starts
            found, places = W.distinct(inner, starts, pa.string())
            if not len(found):
                yield a, b, np.zeros(0, np.uint32), np.zeros(b - a, np.int64)
                continue
            fresh, ids = self._new(found.filter(pc.invert(pc.is_in(found, self.words))))
            words, lists = pa.concat_arrays([self.words, fresh]), pa.concat_arrays([self.ids, ids])
            taken = lists.take(pc.index_in(found, words).take(pa.array(places)))
            yield a, b, taken.values.to_numpy(), taken.offsets.to_numpy()[np.searchsorted(starts, at[1:])]
            if len(self.words) < KNOWN:
                # The most frequent of the block; the first blocks of a task decide what is kept.
                often = np.sort(np.argsort(-np.bincount(places), kind="stable")[: KNOWN // 2])
                own = found.take(pa.array(often))
                own = own.filter(pc.invert(pc.is_in(own, self.words)))
                self.words, self.ids = pa.concat_arrays([self.words, own]), pa.concat_arrays([self.ids, lists.take(pc.index_in(own, words))])


class _Sequences:
    """Rows of ids, written as they fill up."""

    def __init__(self, stream, seq_len: int, pad: int, kind: pa.DataType):
        self.seq_len, self.pad, self.kind = seq_len, pad, kind
        self.schema = pa.schema([("ids", pa.list_(kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))], {"seq_len": str(seq_len), "batch": str(BATCH)})
        self.out, self.rest, self.size = pa.ipc.new_file(stream, self.schema), [], 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.size += len(ids)
        if self.size >= self.seq_len * BATCH:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate([np.zeros(0, np.uint32), *self.rest])
        per = self.seq_len * BATCH
        end = len(ids) if last else len(ids) // per * per
        for k in range(0, end, per):
            part = ids[k : min(k + per, end)]
            n = -(-len(part) // self.seq_len) * self.seq_len
            full = np.full(n, self.pad, self.kind.to_pandas_dtype())
            full[: len(part)] = part
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (full, np.arange(n) < len(part))]
            self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.rest, self.size = [ids[end:]], len(ids) - end
        if last:
            self.out.close()


def _writer(folder: str, vocabulary, special_as_text: bool, end_id: int, seq_len: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store.filesystem(folder)
        encoder = Encoder(_tokenizer(vocabulary.value, special_as_text))
        name, at, stream, out = f"{uuid.uuid4().hex}.arrow", 0, None, None
        for batch in batches:
            for a, b, ids, ends in encoder.blocks(batch.column(1)):
                if stream is None:
                    system.create_dir(path, recursive=True)
                    stream = system.open_output_stream(f"{path}/{name}", compression=None)
                    out = _Sequences(stream, seq_len, end_id, pa.uint32() if wide else pa.uint16())
                whole = np.insert(ids, ends, end_id)
                out.add(whole)
                sizes = np.diff(ends, prepend=0) + 1
                starts = at + np.cumsum(sizes) - sizes
                at += len(whole)
                yield pa.RecordBatch.from_arrays([pa.array([name] * (b - a)), batch.column(0).slice(a, b - a), pa.array(starts), pa.array(sizes)], ["file", "doc_id", "start", "n_tokens"])
        if out is not None:
            out.flush(True)
            stream.close()

    return run


def write(df: DataFrame, folder: str, vocabulary_file: str, *, end_id: int = 2, seq_len: int = SEQ_LEN, special_as_text: bool = False) -> DataFrame:
    """Writes the files to ``folder`` and gives the index table: file, doc_id, start in the file, n_tokens."""
    with open(vocabulary_file, encoding="utf-8") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary_file} isn't a vocabulary")
    spark = df.sparkSession
    wide = _tokenizer(data).get_vocab_size() > 1 << 16 or end_id >= 1 << 16
    ordered = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_writer(f"{folder}/ids", spark.sparkContext.broadcast(data), special_as_text, end_id, seq_len, wide), INDEX).write.option("compression", "zstd").parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = store.filesystem(folder)
        name, source, at, k, ids, local = None, None, 0, 0, np.zeros(0, np.uint16), hasattr(system, "normalize_path") and system.type_name == "local"
        for batch in batches:
            sums = []
            for file, start, n in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "n_tokens"))):
                if file != name:
                    name, at, k = file, 0, 0
                    source = pa.ipc.open_file(pa.memory_map(f"{path}/{file}") if local else system.open_input_file(f"{path}/{file}"))
                    ids = source.get_batch(0).column(0).values.to_numpy()
                crc = 0
                while n:
                    while start >= at + len(ids):
                        at, k = at + len(ids), k + 1
                        ids = source.get_batch(k).column(0).values.to_numpy()
                    part = ids[start - at : start - at + n]
                    crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                    start, n = start + len(part), n - len(part)
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file", "doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], ["file", "doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """Per document, from its file: its place in the corpus and the checksum of its ids.  A task for each file: the index rows
    are few bytes but stand for much to read."""
    count = max(1, index.select("file").distinct().count())
    files = index.groupBy("file").agg(F.min(F.struct("doc_id")).alias("first"), F.sum("n_tokens").alias("total"))
    before = Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    found = index.repartition(count, "file").sortWithinPartitions("file", "start").mapInArrow(_reader(f"{folder}/ids"), f"{INDEX}, ids_crc32 long")
    return found.join(bases, "file").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = store.fresh_path(spark, "tokens")
    index = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_back(index, folder)
