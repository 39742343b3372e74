"""Operator 1, byte-level BPE: a global distinct-word shuffle encodes each pre-token once.

``encode`` cuts every text into pre-tokens, explodes each block of documents into its distinct pre-tokens (a word that a
block holds a million times is one row), brings equal words of all blocks together by a shuffle and a sort, encodes a word
when it first comes by, sends the ids back to the blocks and puts them in order by the positions each block kept.  Decoding
looks the ids up in the token-byte table.

A row of the shuffle is a (block, word) pair, so the most frequent word has as many rows as there are blocks and no key
holds a large part.  A task holds one block (``block_bytes`` of text, or one longer text) or one word at a time.  The two
sides of the last step cut the same scan; both carry a fingerprint of the block's words, and a mismatch (from an input whose
rows change between reads) fails the job instead of giving wrong ids.

Null texts count as empty and give no ids; equal or null ``doc_id`` values keep their own rows; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import words as W
from spanforge.llm.memory import lean, release

BLOCK_BYTES = 16 << 20
#: A key is (partition, block in it, place in the block).
PART_BITS, COUNT_BITS, PLACE_BITS = 22, 14, 27
#: Words whose ids are packed together before they go back to their blocks.
PACK = 1 << 18
#: Largest rank file that is sent to the executors.
RANK_FILE_BYTES = 64 << 20
KINDS = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(RANK_FILE_BYTES + 1)
    if len(data) > RANK_FILE_BYTES:
        raise ValueError(f"{path} has more than {RANK_FILE_BYTES} bytes; it isn't a vocabulary")
    return data


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def token_table(ranks: dict[bytes, int]) -> pa.Array:
    """The bytes of each id."""
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.large_binary())


def _merger(data: bytes):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=parse_ranks(data), special_tokens={})


def _blocks(batches: Iterator[pa.RecordBatch], most: int):
    """(block id, ids of its documents, offsets of its texts, distinct pre-tokens, for each pre-token its place among them, cuts)."""
    part = TaskContext.get().partitionId()
    count = 0
    for batch in batches:
        body, offsets = W.buffers(batch.column(1))
        for a, b in W.steps(offsets, most):
            inner, at = body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts = W.cuts(inner, at)
            yield _block(part, count, len(starts)), batch.column(0).slice(a, b - a), at, *W.distinct(inner, starts), starts
            count += 1


def _block(part: int, count: int, words: int) -> int:
    if part >> PART_BITS or count >> COUNT_BITS or words >> PLACE_BITS:
        raise OverflowError("more partitions, blocks in a partition or words in a text than a key can tell apart")
    return part << COUNT_BITS | count


def _mark(word: bytes, place: int) -> int:
    return zlib.crc32(word, place & 0xFFFFFFFF)


def _explode(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, found, _, _ in _blocks(batches, most):
            for k in range(0, len(found), 50_000):
                part = found.slice(k, 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(part)) | block << PLACE_BITS), part], ["key", "word"])

    return run


def _positions(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, at, found, places, starts in _blocks(batches, most):
            upto = np.searchsorted(starts, at).astype(np.int64)
            # Frequent words get small codes; low and high bytes compress better apart.
            order = np.argsort(-np.bincount(places, minlength=len(found)), kind="stable").astype(np.int32)
            code = np.empty(len(order), np.uint32)
            code[order] = np.arange(len(order), dtype=np.uint32)
            code = code[places]
            packed = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in (code.astype(np.uint8), (code >> 8).astype(np.uint16), (code >> 24).astype(np.uint8), order)]
            row = {"block": [block], "n": [len(code)], "words": [len(found)], "mark": [sum(map(_mark, found.to_pylist(), range(len(found))))], "upto": [upto[1:]], "doc_ids": [ids], "low": packed[:1], "mid": packed[1:2], "high": packed[2:3], "order": packed[3:]}
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.list_(pa.int64())) if k == "doc_ids" else pa.array(v) for k, v in row.items()], list(row))

    return run


POSITIONS = "block long, n long, words long, mark long, upto array<long>, doc_ids array<long>, low binary, mid binary, high binary, order binary"


def _packed(keys: list[int], marks: list[int], sizes: list[int], ids: list[int]) -> pa.RecordBatch:
    """The ids of words, together for each block: their places and sizes, then all ids."""
    key, mark, size = np.array(keys, np.int64), np.array(marks, np.int64), np.array(sizes, np.int64)
    order = np.argsort(key, kind="stable")
    lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(size))), pa.array(np.array(ids, np.uint32))).take(pa.array(order))
    key, mark, size = key[order], mark[order], size[order]
    block = key >> PLACE_BITS
    edge = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    ends, at, flat = np.append(edge[1:], len(key)), lists.offsets.to_numpy(), lists.values.to_numpy()
    squeeze = lambda x: pa.compress(x.tobytes(), "zstd", asbytes=True)
    rows = [(int(block[a]), int(z - a), int(at[z] - at[a]), int(mark[a:z].sum()), squeeze(np.diff(key[a:z] & (1 << PLACE_BITS) - 1, prepend=0).astype(np.uint32)), squeeze(size[a:z].astype(np.uint32)), squeeze(flat[at[a] : at[z]])) for a, z in zip(edge, ends)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["block", "n", "n_ids", "mark", "places", "sizes", "ids"])


PACKED = "block long, n long, n_ids long, mark long, places binary, sizes binary, ids binary"


def _encode(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _merger(ranks.value)
        last, own = None, []
        keys, marks, sizes, ids = [], [], [], []
        for batch in batches:
            for key, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word != last:
                    last, own = word, merger._encode_single_piece(word)
                keys.append(key)
                marks.append(_mark(word, key & (1 << PLACE_BITS) - 1))
                sizes.append(len(own))
                ids += own
            if len(keys) >= PACK:
                yield _packed(keys, marks, sizes, ids)
                keys, marks, sizes, ids = [], [], [], []
        if keys:
            yield _packed(keys, marks, sizes, ids)

    return run


def _reassemble(ranks, outputs: Sequence[str]):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", *outputs]
        if left.num_rows != 1:
            raise ValueError("a block came without its positions: the input changed between two reads")
        row = {k: left.column(k)[0] for k in left.column_names}
        n, count = row["n"].as_py(), row["words"].as_py()
        unpack = lambda data, kind, size: np.frombuffer(pa.decompress(data, int(size) * kind().itemsize, "zstd", asbytes=True), kind) if size else np.zeros(0, kind)
        parts = right.to_pylist()
        at = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unpack(p["places"], np.uint32, p["n"]), dtype=np.int64) for p in parts)])
        if len(at) != count or sum(p["mark"] for p in parts) != row["mark"].as_py():
            raise ValueError("a block came with other words: the input changed between two reads")
        sizes = np.concatenate([np.zeros(0, np.int64), *(unpack(p["sizes"], np.uint32, p["n"]) for p in parts)])
        flat = np.concatenate([np.zeros(0, np.uint32), *(unpack(p["ids"], np.uint32, p["n_ids"]) for p in parts)])
        lists = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int64()), pa.array(flat))
        where = np.empty(count, np.int64)
        where[at] = np.arange(count)
        code = unpack(row["low"].as_py(), np.uint8, n).astype(np.uint32) | unpack(row["mid"].as_py(), np.uint16, n).astype(np.uint32) << 8 | unpack(row["high"].as_py(), np.uint8, n).astype(np.uint32) << 24
        places = where[unpack(row["order"].as_py(), np.int32, count)][code]
        upto = np.append(0, row["upto"].values.to_numpy() if len(row["upto"].values) else np.zeros(0, np.int64))
        tokens = token_table(parse_ranks(ranks.value))
        docs = row["doc_ids"].values
        found: dict[str, list] = {k: [] for k in outputs}
        for a, b in W.steps(upto, 1 << 20):
            taken = lists.take(pa.array(places[upto[a] : upto[b]]))
            ends = taken.offsets.to_numpy()[upto[a : b + 1] - upto[a]]
            ids = taken.values.to_numpy()
            if {"decoded", "decoded_sha256"} & {*outputs}:
                body, byte_at = W.buffers(tokens.take(pa.array(ids)))
                body, byte_at = memoryview(body.tobytes()), byte_at[ends]
            for k in range(b - a):
                own = ids[ends[k] : ends[k + 1]]
                for name in outputs:
                    if name == "n_tokens":
                        found[name].append(len(own))
                    elif name == "ids":
                        found[name].append(own.astype(np.int32))
                    elif name == "ids_sha256":
                        found[name].append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                    elif name == "decoded":
                        found[name].append(bytes(body[byte_at[k] : byte_at[k + 1]]))
                    else:
                        found[name].append(hashlib.sha256(body[byte_at[k] : byte_at[k + 1]]).hexdigest())
        del code, places, lists, where, flat, at, sizes
        release()
        kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.binary()}
        return pa.table([docs, *(pa.array(found[k], kinds.get(k, pa.string())) for k in outputs)], names)

    return run


def encode(df: DataFrame, rank_file: str, *, id_col: str = "doc_id", text_col: str = "text", outputs: Sequence[str] = ("n_tokens", "ids"), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ``doc_id`` and the named outputs (see ``KINDS``)."""
    if unknown := {*outputs} - {*KINDS}:
        raise ValueError(f"unknown outputs: {sorted(unknown)}")
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(rank_file))
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = texts.mapInArrow(lean(_explode(block_bytes)), "key long, word binary")
    ids = words.repartition("word").sortWithinPartitions("word").mapInArrow(lean(_encode(ranks)), PACKED)
    positions = texts.mapInArrow(lean(_positions(block_bytes)), POSITIONS)
    schema = ", ".join(["doc_id long", *(f"{k} {KINDS[k]}" for k in outputs)])
    return positions.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_reassemble(ranks, outputs), schema)


def decode(df: DataFrame, rank_file: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes of the ids in ``ids_col``; ids without an entry in the table are an error, null ids give null."""
    tokens = df.sparkSession.sparkContext.broadcast(read_ranks(rank_file))
    schema = df.schema.jsonValue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(parse_ranks(tokens.value)).to_numpy(zero_copy_only=False)
        for batch in batches:
            found = [None if ids is None else b"".join(table[ids]) for ids in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, out_col])

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType.fromJson(schema).add(out_col, "binary"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
