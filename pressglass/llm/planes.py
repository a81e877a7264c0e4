"""Token ids in binary files: fixed-size blocks of ids, transposed into planes, each plane compressed by itself.

A file (little-endian): MAGIC, kind (1 byte: 0 byte planes, 1 bit planes); the blocks' planes one behind the other;
the index, zstd-compressed: for each block its ids, its offset and its planes' lengths; for each document its id and
its ids; then the index's offset, its length, the number of blocks and of documents (4 longs) and MAGIC.
The high planes of ids below 65,536 are all zero and cost next to nothing, and neighbouring ids share planes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressglass.llm.common import bounded_batches, shared_folder, stored
from pressglass.llm.pretokens import WordIds, split_words

MAGIC = b"IDPLANE1"
BLOCK = 1 << 16
KINDS = {"bytes": 0, "bits": 1}
NO_ID = -(1 << 63)


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """uint32 ids -> 4 byte planes or 32 bit planes, the lowest first."""
    ids = np.ascontiguousarray(ids, "<u4")
    if kind == "bytes":
        return [x.tobytes() for x in ids.view(np.uint8).reshape(-1, 4).T]
    return [np.packbits((ids >> np.uint32(k)) & np.uint32(1) > 0).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    if kind == "bytes":
        return np.stack([np.frombuffer(x, np.uint8) for x in planes], axis=1).copy().view("<u4").reshape(n)
    ids = np.zeros(n, np.uint32)
    for k, x in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(np.uint32) << np.uint32(k)
    return ids


class PlaneWriter:
    """Appends documents' ids to a file; a block never waits for more than BLOCK ids."""

    def __init__(self, out, kind: str = "bytes", block: int = BLOCK, level: int = 3):
        self.out, self.kind, self.block = out, kind, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.waiting, self.n_waiting, self.blocks, self.docs, self.sizes, self.n = [], 0, [], [], [], 0
        out.write(MAGIC + bytes([KINDS[kind]]))
        self.at = len(MAGIC) + 1

    def add(self, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.array([NO_ID if d is None else d for d in doc_ids], "<i8"))
        self.sizes.append(sizes.astype("<i8"))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n += len(ids)
        if self.n_waiting >= self.block:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // self.block * self.block
            for i in range(0, whole, self.block):
                self._put(ids[i : i + self.block])
            self.waiting, self.n_waiting = [ids[whole:].copy()], len(ids) - whole

    def _put(self, ids: np.ndarray) -> None:
        planes = [self.pack(x) for x in to_planes(ids, self.kind)]
        self.blocks.append([len(ids), self.at, *map(len, planes)])
        for x in planes:
            self.out.write(x)
        self.at += sum(map(len, planes))

    def close(self) -> None:
        if self.n_waiting:
            self._put(np.concatenate(self.waiting))
        docs = np.concatenate(self.docs) if self.docs else np.zeros(0, "<i8")
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, "<i8")
        index = self.pack(np.array(self.blocks, "<i8").tobytes() + docs.tobytes() + sizes.tobytes())
        self.out.write(index + struct.pack("<4q", self.at, len(index), len(self.blocks), len(docs)) + MAGIC)


class PlaneReader:
    """Random access by block: id i of the file is in block i // BLOCK."""

    def __init__(self, file, size: int):
        self.file = file
        tail = self._read(size - 32 - len(MAGIC), 32 + len(MAGIC))
        if tail[32:] != MAGIC or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not an id-plane file")
        self.kind = {v: k for k, v in KINDS.items()}[self._read(len(MAGIC), 1)[0]]
        at, length, n_blocks, n_docs = struct.unpack("<4q", tail[:32])
        numbers = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._read(at, length)), "<i8")
        wide = 2 + (4 if self.kind == "bytes" else 32)
        self.blocks = numbers[: n_blocks * wide].reshape(n_blocks, wide)
        self.doc_ids = numbers[n_blocks * wide : n_blocks * wide + n_docs]
        self.sizes = numbers[n_blocks * wide + n_docs :]

    def _read(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def block(self, i: int) -> np.ndarray:
        n, at, *lengths = self.blocks[i].tolist()
        data, planes, unpack = self._read(at, sum(lengths)), [], zstandard.ZstdDecompressor().decompress
        for length in lengths:
            planes.append(unpack(data[:length]))
            data = data[length:]
        return from_planes(planes, n, self.kind)

    def documents(self) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Each document's place in the file and its ids, in pieces of a block at most; one block is held at a time."""
        i, ids, used = -1, np.zeros(0, np.uint32), 0
        for doc, left in enumerate(self.sizes.tolist()):
            pieces = []
            while left:
                if used == len(ids):
                    i += 1
                    ids, used = self.block(i), 0
                pieces.append(ids[used : used + left])
                used += len(pieces[-1])
                left -= len(pieces[-1])
            yield doc, pieces


def word_encoder(tokenizer_path: str):
    """A function from pre-tokens to their ids by the tokenizers library's model; the tokenizer must be byte-level BPE."""
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(tokenizer_path)
    split = tokenizer.pre_tokenizer
    if tokenizer.normalizer is not None or not isinstance(split, pre_tokenizers.ByteLevel) or split.add_prefix_space:
        raise ValueError("a byte-level tokenizer without normalisation or prefix is needed")
    # The library's spelling of bytes: visible Latin-1 characters stand for themselves, the others count up from 256.
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spelt = {b: b for b in own} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}
    tokenize = tokenizer.model.tokenize
    return lambda words: [tuple([t.id for t in tokenize(w.decode("latin-1").translate(spelt))]) for w in words]


@cache
def added_encoder(tokenizer_path: str, special_as_text: bool):
    """The spellings of the tokenizer's added tokens that are looked for in texts, and a function from a text to its ids by the library's encode()."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    tokenizer.encode_special_tokens = special_as_text
    spelt = [t.content for t in tokenizer.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
    return spelt, lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, kind: str = "bytes", id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = True) -> DataFrame:
    """Encodes texts with the tokenizers library and writes one file for each range of ids, in ascending order of ids.

    With special_as_text the spellings of special tokens (<|endoftext|>) are encoded like other text (the library's
    encode_special_tokens = True); without, they get their own ids, as by the library's default.
    Returns one row per file, itself stored in the shared folder: file_no, path, n_docs, n_ids.  Files left by lost
    or repeated task attempts are in no row.  Null texts count as empty and give end_id alone; rows without an id
    come first; repeated rows are each written; an empty table gives no file; ids that
    aren't integers raise.
    """
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"the files hold integer ids, and {id_col} isn't one")
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).repartitionByRange("id").sortWithinPartitions("id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _MEMOS:
            _MEMOS[tokenizer_path] = WordIds(word_encoder(tokenizer_path), 500_000)
        memo, writer, n_docs = _MEMOS[tokenizer_path], None, 0
        spelt, encode = added_encoder(tokenizer_path, special_as_text)
        number = TaskContext.get().partitionId()
        where, base = pyarrow.fs.FileSystem.from_uri(folder)
        path = f"{base}/ids-{number:06d}-{uuid.uuid4().hex}.planes"
        for batch in batches:
            if writer is None:
                where.create_dir(base, recursive=True)
                writer = PlaneWriter(where.open_output_stream(path), kind)
            texts = batch.column("text").to_pylist()
            # Texts with added tokens are rare; the library encodes them whole, and they are empty for the words' memo.
            whole = {i: encode(t) for i, t in enumerate(texts) if any(x in t for x in spelt)}
            words, rows = split_words(["" if i in whole else t for i, t in enumerate(texts)] if whole else texts)
            ids, ends = memo.ids(words)
            ends = ends[rows]
            more = [[*whole.get(i, ()), end_id] for i in range(len(texts))]
            n_more = np.fromiter(map(len, more), np.int64, len(more))
            ids = np.insert(ids, np.repeat(ends[1:], n_more), np.array(list(chain.from_iterable(more)), np.uint32))
            writer.add(batch.column("id").to_pylist(), np.diff(ends) + n_more, ids)
            n_docs += batch.num_rows
        if writer:
            writer.close()
            writer.out.close()
            yield pa.RecordBatch.from_pydict({"file_no": [number], "path": [path], "n_docs": [n_docs], "n_ids": [writer.n]})

    return stored(ordered.mapInArrow(each, "file_no long, path string, n_docs long, n_ids long"), "id-files")


_MEMOS: dict[str, WordIds] = {}


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """Reads the files of write_ids(): doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only the list of files, one row for each write task, comes to the driver, for the number of ids before each.
    """
    spark = files.sparkSession
    rows, before = [], 0
    for r in files.orderBy("file_no").collect():
        rows.append((r.path, before))
        before += r.n_ids
    listed = spark.createDataFrame(rows, "path string, before long").repartition(max(1, len(rows)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with where.open_input_file(path) as file:
                    reader = PlaneReader(file, file.size())
                    sizes, crcs = reader.sizes, []
                    for _, pieces in reader.documents():
                        crc = 0
                        for x in pieces:
                            crc = zlib.crc32(x, crc)
                        crcs.append(crc)
                ids = pa.array(reader.doc_ids, mask=reader.doc_ids == NO_ID)
                starts = before + np.cumsum(sizes) - sizes
                table = pa.table([ids, pa.array(starts, pa.int64()), pa.array(sizes), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield from table.to_batches(max_chunksize=10_000)

    return listed.mapInArrow(each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, kind: str = "bytes", special_as_text: bool = True) -> DataFrame:
    """One row per row of docs, from the files that write_ids() has written: doc_id, start, n_tokens, ids_crc32 (see there)."""
    folder = shared_folder(docs.sparkSession, "id-planes")
    return read_ids(write_ids(docs, tokenizer_path, end_id, folder, kind, special_as_text=special_as_text), folder)
