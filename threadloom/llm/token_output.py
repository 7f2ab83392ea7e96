"""Operator 5: texts as token ids in Simple-8b files.

Texts are dealt by ranges of doc_id and sorted, so that the files, in their order, hold the ids in ascending doc_id
order. Each row of a file is a segment: some whole documents, their numbers of ids, and the ids of all of them packed by
`simple8b` with the word at which each block begins. Segments are carried in Parquet, so that Spark's commit protocol
writes them to any store, and a lost executor's files are written again by another.

Cases: a null or empty text holds the end id alone; a null doc_id sorts first; rows that repeat a doc_id follow each
other in the order of their texts' hashes, each with ids of its own; columns other than doc_id and text are not read;
an empty table makes no segment. A text of any length is encoded whole.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from operator import itemgetter
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm import simple8b
from threadloom.llm.common import RELEASE, partitions, small_batches, stored

#: Ids of a segment at least, but for the last of a file.
SEGMENT_IDS = 1 << 18
#: Distinct words whose ids a worker keeps.
CACHE_WORDS = 800_000
SEGMENT_SCHEMA = "part int, segment int, before bigint, doc_ids array<bigint>, n_tokens array<int>, n_ids bigint, block_offsets array<bigint>, words binary"
DOCUMENT_SCHEMA = "doc_id bigint, part int, in_part bigint, n_tokens bigint, ids_crc32 bigint"

_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Control characters that Python splits at and the tokenizer doesn't, and what may begin a special token.
_UNSURE = re.compile("[\x1c-\x1f]|<\\|")


# What a tokenizer file must say, to the letter, for a text's ids to be its words' ids end to end.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUTS = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BY_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def words_stand_alone(parts: dict) -> bool:
    """Whether a tokenizer file lower-cases texts, cuts them at white space and marks, and merges bytes within each piece.

    Any other normaliser, pre-tokenizer or kind of model makes it another tokenizer, for which whole texts go through the library.
    """
    model = {k: v for k, v in parts["model"].items() if k in _MODEL}
    marked = all(t["content"].startswith("<|") for t in parts.get("added_tokens") or ())
    return marked and parts.get("normalizer") == _NORMALIZER and parts.get("pre_tokenizer") == {"type": "Sequence", "pretokenizers": [_CUTS, _BY_BYTES]} and model == _MODEL


class Encoder(dict):
    """Words between white space, to their ids as little-endian unsigned 32-bit integers.

    Where the tokenizer's file says that it works on each such word by itself, a text's ids are its words' ids end to end;
    words of plain letters go straight to the tokenizer's model, any other through the whole tokenizer. With any other
    tokenizer file each text goes through the library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.plain = words_stand_alone(json.load(f))
        self.model = self.tokenizer.model
        self.known_marks: dict[str, bytes] = {}
        letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in letters})

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            # words met early are the frequent ones
            for late in list(self)[CACHE_WORDS // 2 :]:
                del self[late]
        letters = word.rstrip(".,;:!?")
        if letters and (letters.isalpha() if letters.isascii() else _PLAIN.fullmatch(letters)):
            lower = letters.lower()
            out = self.get(lower)
            if out is None:
                ids = [t.id for t in self.model.tokenize(lower if lower.isascii() else lower.translate(self.bytes))]
                out = pack(f"<{len(ids)}I", *ids)
            if letters != word:
                out += self._marks(word[len(letters) :])
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            out = pack(f"<{len(ids)}I", *ids)
        self[word] = out
        return out

    def _marks(self, marks: str) -> bytes:
        if marks not in self.known_marks:
            self.known_marks[marks] = pack(f"<{len(ids)}I", *ids) if (ids := [t.id for t in self.model.tokenize(marks)]) else b""
        return self.known_marks[marks]

    def ids(self, text: str) -> bytes:
        if self.plain and not _UNSURE.search(text):
            found = text.split()
            # the quickest way to look up many words in a row
            return b"".join(itemgetter(*found)(self)) if len(found) > 1 else self[found[0]] if found else b""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}
RELEASE.append(_encoders.clear)


def encoder(path: str) -> Encoder:
    """One for each worker process and tokenizer."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_segments(docs: DataFrame, tokenizer: str, end_id: int | None = 1) -> DataFrame:
    """The documents' segments, ascending by doc_id over the partitions. end_id closes each document; None adds nothing."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        segment = before = held = 0
        doc_ids: list = []
        ids: list[bytes] = []

        def closed() -> pa.RecordBatch:
            sizes = [len(x) // 4 for x in ids]
            whole = np.frombuffer(b"".join(ids), "<u4")
            packed, offsets = simple8b.encode(whole)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([before], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([len(whole)], pa.int64()), pa.array([offsets.tolist()], pa.list_(pa.int64())), pa.array([packed.astype("<u8").tobytes()], pa.binary())],
                ["part", "segment", "before", "doc_ids", "n_tokens", "n_ids", "block_offsets", "words"],
            )

        for batch in batches:
            numbers = batch.column(0)
            for i, text in enumerate(batch.column(1)):
                doc_ids.append(numbers[i].as_py())
                ids.append(known.ids(text.as_py() or "") + end)
                held += len(ids[-1]) // 4
                if held >= SEGMENT_IDS:
                    yield closed()
                    segment, before, held, doc_ids, ids = segment + 1, before + held, 0, [], []
        if doc_ids:
            yield closed()

    tie = F.xxhash64("text")
    rows = small_batches(docs).select(F.col("doc_id").cast("bigint"), F.col("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    return rows.mapInArrow(encode, SEGMENT_SCHEMA)


def write_token_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = 1) -> None:
    """Writes the documents' segments at path."""
    token_segments(docs, tokenizer, end_id).write.parquet(path)


def read_token_ids(segments: DataFrame) -> DataFrame:
    """A row per document, with its ids decoded: doc_id, part, in_part (ids before it in its part), n_tokens, ids_crc32."""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = simple8b.decode(np.frombuffer(row["words"], "<u8"), np.array(row["block_offsets"]), row["n_ids"]).astype("<u4")
                ends = np.cumsum(row["n_tokens"], dtype=np.int64)
                starts = ends - row["n_tokens"]
                view = memoryview(ids.tobytes())
                sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array(starts + row["before"]), pa.array(row["n_tokens"], pa.int64()), pa.array(sums, pa.int64())],
                    ["doc_id", "part", "in_part", "n_tokens", "ids_crc32"],
                )

    return segments.mapInArrow(decode, DOCUMENT_SCHEMA)


def token_output(docs: DataFrame, tokenizer: str, end_id: int | None = 1) -> DataFrame:
    """Writes the documents in the shared folder and reads the files back: doc_id, start, n_tokens, ids_crc32.

    One row a partition tells where each part begins; those rows are as few as the partitions, are summed in one task
    and are broadcast.
    """
    files = stored(token_segments(docs, tokenizer, end_id), "tokens")
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    return read_token_ids(files).join(F.broadcast(starts), "part").select("doc_id", (F.col("part_start") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")
