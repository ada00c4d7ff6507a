"""Token-id files: one zstandard dictionary, each document compressed alone, an offset index.

A file set is a folder with three Parquet tables, so that any store Spark writes to can hold it and
its commit protocol makes the files whole after lost executors:

* ``blocks``: (shard, block, first_id, last_id, dict_hash, width, doc_ids, starts, sizes, offsets, payload).
  ``payload`` holds the documents' frames one after the other; ``offsets`` has one place more than
  there are documents; ``starts`` are the ids before each document in its shard. Shards ascend by
  doc_id, and so do the blocks of a shard. ``width`` is the bytes of an id, little-endian.
* ``shards``: (shard, base), the ids before the shard.
* ``dictionary``: (dict_hash, dictionary).
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.llm._shared import map_batches, materialize, pa_schema, read_table, scratch, with_default_columns

#: The dictionary is trained on at most SAMPLES pieces of SAMPLE_BYTES, cut anywhere in documents.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 4096, 1 << 16
#: A block ends after so many documents or bytes of frames.
BLOCK_DOCS, BLOCK_BYTES = 512, 1 << 20
#: Encodings of space-free strings that a worker keeps, and the characters of these strings.
MEMO, MEMO_LETTERS = 700_000, 1 << 26
#: An encoding's place in the pool is kept with its size in the lower bits (a string of 2**31 ids would be over 2 GB of text).
SIZE_BITS = 31
BLOCKS = "shard int, block int, first_id bigint, last_id bigint, dict_hash string, width int, doc_ids array<bigint>, starts array<bigint>, sizes array<bigint>, offsets array<int>, payload binary"


class WordMemo:
    """Encodes texts by the space-free strings in them, for tokenizers that split at white space and
    drop it, and whose normalizers work character by character or on white space only (composition
    never crosses a space). Arrow splits texts and numbers their strings; each new string goes through the library
    once, and texts are put together from the known strings' ids by numpy.

    A space is put between a Latin letter or digit and a mark of CUT, since a piece ends there anyway: what is left
    is mostly words. New words of letters go through the library together, joined by spaces, normalized by it
    (ASCII: lower-cased) and then by its model alone: each is one piece, and an id with the end-of-word suffix closes
    a piece. If the pieces do not add up, and for strings that are no words, the whole tokenizer is used.
    Texts that hold the content of an added token (in any case) are split at spaces alone, so that the library sees such marks whole.
    """

    CUT = "([0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])([,.!*&$#%|])"

    def __init__(self, path: str, suffix: str = "</w>"):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.model = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.model.normalizer = normalizers.Sequence([])
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.marks = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.known: dict[str, int] = {}  # place in the pool << SIZE_BITS | ids
        self.pool, self.used, self.letters = np.empty(1 << 16, "<u4"), 0, 0

    def keep(self, strings: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(len(self.pool) + len(ids), "<u4")])
        self.pool[self.used : self.used + len(ids)] = ids
        starts = np.append(0, ends[:-1])
        self.known.update(zip(strings, ((self.used + starts) << SIZE_BITS | (ends - starts)).tolist(), strict=True))
        self.used += len(ids)
        self.letters += sum(map(len, strings))

    def learn(self, new: list[str]) -> None:
        plain, accented, alone = [], [], []
        for w in new:
            (alone if not w.isalpha() else plain if w.isascii() else accented).append(w)
        normal = [w.lower() for w in plain]
        if accented:
            some = self.tokenizer.normalizer.normalize_str(" ".join(accented)).split(" ")
            if len(some) == len(accented):
                for w, n in zip(accented, some, strict=True):
                    if n.isalpha():
                        plain.append(w), normal.append(n)
                    else:
                        alone.append(w)
            else:
                alone += accented
        for i in range(0, len(plain), 1024):
            some = plain[i : i + 1024]
            ids = np.array(self.model.encode_batch_fast([" ".join(normal[i : i + 1024])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                self.keep(some, ids, ends)
            else:
                alone += some
        for i in range(0, len(alone), 1024):
            some = alone[i : i + 1024]
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self.keep(some, np.array([x for ids in lists for x in ids], "<u4"), np.cumsum([len(ids) for ids in lists]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's end."""
        spaced = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "\n", " ")
        cut = pc.replace_substring_regex(spaced, self.CUT, r"\1 \2")
        if self.marks:
            marked = pc.match_substring_regex(spaced, self.marks, ignore_case=True)
            cut = pc.if_else(marked, spaced, cut) if pc.any(marked).as_py() else cut
        parts = pc.split_pattern(cut, " ")
        strings = parts.flatten().dictionary_encode()
        unique = strings.dictionary.to_pylist()
        new = [w for w in unique if w not in self.known]
        if self.known and (len(self.known) + len(new) > MEMO or self.letters + sum(map(len, new)) > MEMO_LETTERS):
            self.known.clear()
            self.used, self.letters, new = 0, 0, unique
        self.learn(new)
        code = np.fromiter(map(self.known.__getitem__, unique), np.int64, len(unique))[np.asarray(strings.indices)]
        start, size = code >> SIZE_BITS, code & (1 << SIZE_BITS) - 1
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(start - (ends - size), size) + np.arange(total)]
        return ids, np.append(0, ends)[np.cumsum(parts.value_lengths().to_numpy())]


@lru_cache(1)
def word_memo(path: str) -> WordMemo:
    """One for all tasks of a worker, so that a word is learnt once by a worker while it stays in memory."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordMemo(path)


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, crc, z): ids with ``end_id`` appended, compressed.

    A null text is empty; repeated rows stay; an empty table gives none; other columns are ignored.
    """

    dtype = f"<u{id_width(path)}"

    def make():
        memo, pack = word_memo(path), zstandard.ZstdCompressor(level=1)

        def step(c: dict) -> dict:
            ids, ends = memo.encode(c["text"])
            every = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
            wide, narrow = every.tobytes(), every.astype(dtype).tobytes()
            width, crc, z, s = len(narrow) // max(1, len(every)), [], [], 0
            for e in ends.tolist():
                crc.append(zlib.crc32(memoryview(wide)[4 * s : 4 * e]))
                z.append(pack.compress(memoryview(narrow)[width * s : width * e]))
                s = e
            return {"doc_id": c["doc_id"], "crc": crc, "z": z}

        return step

    return map_batches(with_default_columns(docs, doc_id="bigint", text="string"), make, "doc_id bigint, crc bigint, z binary", 8 << 20)


def id_width(path: str) -> int:
    """Bytes of an id in files: 2 if the vocabulary's ids fit, else 4."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(path).get_vocab().values()) < 1 << 16 else 4


def train_dictionary(tokens: DataFrame) -> bytes:
    """From pieces of the SAMPLES documents smallest by hash; empty if there is too little to learn from."""

    def make():
        unpack = zstandard.ZstdDecompressor()

        def step(c: dict) -> dict:
            out = []
            for z, crc in zip(c["z"].to_pylist(), c["crc"].to_pylist(), strict=True):
                data = unpack.decompress(z)
                at = crc % max(1, len(data) - SAMPLE_BYTES) & ~3
                out.append(data[at : at + SAMPLE_BYTES])
            return {"crc": c["crc"], "piece": out}

        return step

    order = F.xxhash64("doc_id", "crc")
    last = tokens.select(order.alias("h")).orderBy("h").limit(SAMPLES).agg(F.max("h")).first()[0]
    chosen = tokens.where(order <= F.lit(last)).select("crc", "z") if last is not None else tokens.select("crc", "z").limit(0)
    pieces = [bytes(r.piece) for r in map_batches(chosen, make, "crc bigint, piece binary").distinct().orderBy("crc", "piece").limit(SAMPLES).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_token_files(tokens: DataFrame, path: str, width: int) -> None:
    """Write ``tokenize``'s rows (a written table) in ascending doc_id order; nulls first, ties by the ids' crc."""
    spark = tokens.sparkSession
    dictionary = train_dictionary(tokens)
    digest = hashlib.sha256(dictionary).hexdigest()
    target = pa_schema(spark, BLOCKS)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        shard, block, start, held = TaskContext.get().partitionId(), 0, 0, []

        def flush() -> pa.RecordBatch:
            ids, starts, sizes, frames = zip(*held, strict=True)
            row = [shard, block, ids[0], ids[-1], digest, width, list(ids), list(starts), list(sizes), [0, *np.cumsum([len(f) for f in frames]).tolist()], b"".join(frames)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, target, strict=True)], schema=target)

        size = 0
        for batch in batches:
            for doc_id, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = unpack.decompress(z)
                frame = pack.compress(data)
                held.append((doc_id, start, len(data) // width, frame))
                start, size = start + len(data) // width, size + len(frame)
                if len(held) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield flush()
                    block, size = block + 1, 0
        if held:
            yield flush()

    ordered = tokens.repartitionByRange("doc_id", "crc").sortWithinPartitions("doc_id", "crc").select("doc_id", "z")
    ordered.mapInArrow(blocks, BLOCKS).write.parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").select("shard", F.expr("aggregate(sizes, 0L, (a, x) -> a + x)").alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/shards")
    spark.createDataFrame([(digest, bytearray(dictionary))], "dict_hash string, dictionary binary").write.parquet(f"{path}/dictionary")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(row.dictionary)).hexdigest() != row.dict_hash:
        raise ValueError("the dictionary does not match its hash")
    return row.dict_hash, bytes(row.dictionary)


def read_token_files(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids: binary of little-endian uint32). With ``doc_id``, only that
    document's frames are read: blocks are skipped by their id ranges, other frames by the offsets."""
    digest, dictionary = _dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    if doc_id is not None:
        blocks = blocks.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    rows = blocks.join(spark.read.parquet(f"{path}/shards"), "shard")

    def make():
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

        def step(c: dict) -> dict:
            out: dict = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
            for i in range(len(c["payload"])):
                if c["dict_hash"][i].as_py() != digest:
                    raise ValueError("a block was written with another dictionary")
                payload, at, base, starts = (c[k][i].as_py() for k in ("payload", "offsets", "base", "starts"))
                dtype = "<u2" if c["width"][i].as_py() == 2 else "<u4"
                for j, d in enumerate(c["doc_ids"][i].as_py()):
                    if doc_id is None or d == doc_id:
                        ids = np.frombuffer(unpack.decompress(payload[at[j] : at[j + 1]]), dtype).astype("<u4")
                        for k, v in (("doc_id", d), ("start", base + starts[j]), ("n_tokens", len(ids)), ("ids", ids.tobytes())):
                            out[k].append(v)
            return out

        return step

    return map_batches(rows, make, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, tokenizer = scratch(spark, "token-files"), public_tokenizers.path("word_bpe_49k.json")
    tokens = materialize(tokenize(read_table(spark, sf_dir, "documents"), tokenizer, 1), "tokens")
    write_token_files(tokens, path, id_width(tokenizer))
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
