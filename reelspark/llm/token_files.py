"""Token ids in flat binary files, written and read as a Spark data source.

Texts are cut where every pre-tokenizer of the byte-level kind splits, such as between a character and the white space after
it; such a chunk's ids do not depend on what stands around it, and chunks repeat, so a chunk is encoded by the tokenizer
once for many texts. Documents are dealt and sorted by ranges of their ids; a task writes one shard: a file of unsigned
little-endian ids, a file of 64-bit offsets of its documents into it, and a file of their ids. The commit on the driver gets a few
numbers for each shard, sums them to each shard's first token and document, and writes the manifest. Readers map the
files into memory where the file system is local, and else read ranges.
"""

from __future__ import annotations

import json
import mmap
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from reelspark.llm.shared import small_batches
from reelspark.llm.shingles import chunks, mixed

#: Bytes of text encoded at once; a longer text is cut where chunks are cut.
PIECE_BYTES = 1 << 19
#: Bytes of a chunk that is kept, one less for its length, and ids that it may have.
KEY_BYTES, KEY_IDS = 24, 10
#: Kept chunks: two places for each in a table of so many bits. A worker's table takes some 65 MB.
TABLE_BITS = 20
#: Documents of a read partition.
SLICE_DOCS = 1 << 16
MANIFEST = "manifest.json"
ENCODED = "doc_id bigint, n_tokens bigint, ids binary"


@lru_cache(maxsize=4)
def _tokenizer(path: str, special_as_text: bool):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = special_as_text
    return found


def _class(*ranges: range) -> np.ndarray:
    out = np.zeros(256, bool)
    for r in ranges:
        out[list(r)] = True
    return out


_SPACE, _PRINT = _class(range(32, 33), range(9, 11), range(13, 14)), _class(range(33, 127))
_LETTER, _PUNCT = _class(range(65, 91), range(97, 123)), _class(range(33, 48), range(58, 65), range(91, 97), range(123, 127))
_HIGH, _LOW = np.uint64(64 - TABLE_BITS), np.uint64((1 << TABLE_BITS) - 1)
_MASKS = np.array([[255] * k + [0] * (KEY_BYTES - k) for k in range(KEY_BYTES)], np.uint8)


def chunk_starts(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8: whether a chunk begins there, wherever texts begin.

    Chunks begin at white space (space, 09, 0A, 0D) after anything that no version of Unicode counts as white space, and
    at ASCII punctuation after an ASCII letter. Byte-level pre-tokenizers split at these places whatever stands around them.
    """
    out = np.zeros(len(data), bool)
    before, here = data[:-1], data[1:]
    space = _SPACE[here]
    out[1:] = (space & _PRINT[before]) | (_LETTER[before] & _PUNCT[here])
    at = np.flatnonzero(space & (before >= 0x80)) + 1
    if len(at):
        c, b, a = data[at - 1], data[at - 2], data[np.maximum(at - 3, 0)]
        odd = ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xEF) & (b == 0xBB) & (c == 0xBF))
        odd |= (a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))
        odd |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8F) | ((c >= 0xA8) & (c <= 0xAF)))) | ((b == 0x81) & (c >= 0x9F) & (c <= 0xA4)))
        out[at] = ~odd
    return out


class Encoder:
    """Ids of whole texts by a tokenizer file whose pre-tokenizer splits at chunk_starts()."""

    def __init__(self, path: str, special_as_text: bool):
        self.tokenizer = _tokenizer(path, special_as_text)
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Strings that the tokenizer looks for across chunks; texts that hold one are encoded whole.
        self.whole = [t.content for t in added if not (special_as_text and t.special)]
        self.keys = [np.zeros(1 << TABLE_BITS, np.uint64) for _ in range(KEY_BYTES // 8)]
        self.sizes = np.zeros(1 << TABLE_BITS, np.uint8)
        self.ids = np.zeros((1 << TABLE_BITS, KEY_IDS), np.uint32)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for a in range(0, len(texts), 4096) for e in self.tokenizer.encode_batch_fast(texts[a : a + 4096], add_special_tokens=False)]

    def _find(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Places of keys in the table, -1 where it has them not."""
        out = (hashes >> _HIGH).astype(np.int64)
        bad = np.flatnonzero(~self._at(out, keys))
        second = (hashes[bad] & _LOW).astype(np.int64)
        out[bad] = np.where(self._at(second, keys[bad]), second, -1)
        return out

    def _at(self, slots: np.ndarray, keys: np.ndarray) -> np.ndarray:
        held = self.keys[0].take(slots) == keys[:, 0]
        for k in range(1, len(self.keys)):
            held &= self.keys[k].take(slots) == keys[:, k]
        return held

    def _learn(self, keys: np.ndarray, hashes: np.ndarray, ids: list[list[int]]) -> None:
        """Keeps chunks at the second place where only that is free, else at the first, whatever stood there."""
        size = np.array([len(x) for x in ids], np.int64)
        rows = np.zeros((len(ids), KEY_IDS), np.uint32)
        fits = size <= KEY_IDS
        rows[(np.arange(KEY_IDS) < size[:, None]) & fits[:, None]] = [i for x in ids if len(x) <= KEY_IDS for i in x]
        first, second = (hashes >> _HIGH).astype(np.int64), (hashes & _LOW).astype(np.int64)
        slot = np.where((self.sizes[first] > 0) & (self.sizes[second] == 0), second, first)
        # Of chunks that come to one place the last stays.
        _, at = np.unique(slot[fits][::-1], return_index=True)
        at = np.flatnonzero(fits)[::-1][at]
        for k, column in enumerate(self.keys):
            column[slot[at]] = keys[at, k]
        self.sizes[slot[at]], self.ids[slot[at]] = size[at], rows[at]

    def _piece(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each part) of parts that lie one after the other in data."""
        begins = chunk_starts(data)
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(begins)
        sizes = np.diff(np.append(starts, len(data)))
        padded = np.append(data, np.zeros(KEY_BYTES, np.uint8))
        small = sizes < KEY_BYTES
        keys = np.zeros((len(starts), KEY_BYTES), np.uint8)
        keys[small] = np.lib.stride_tricks.sliding_window_view(padded, KEY_BYTES)[starts[small]] & _MASKS[sizes[small]]
        keys[:, -1] = np.where(small, sizes, 0)
        keys = keys.view(np.uint64)
        hashes = mixed(keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ mixed(keys[:, 1] + np.uint64(1)) ^ mixed(mixed(keys[:, 2] ^ np.uint64(0x94D049BB133111EB))))
        place = self._find(keys, hashes)
        place[~small] = -1
        known: dict[bytes, list[int]] = {}
        lacking = np.flatnonzero(place < 0)
        if len(lacking):
            text = data.tobytes()
            first: dict[bytes, int] = {}
            for i in lacking.tolist():
                first.setdefault(text[starts[i] : starts[i] + sizes[i]], i)
            known = dict(zip(first, self._library([c.decode() for c in first]), strict=True))
            fits = [(i, ids) for (c, i), ids in zip(first.items(), known.values(), strict=True) if small[i]]
            at = np.array([i for i, _ in fits], np.int64)
            self._learn(keys[at], hashes[at], [ids for _, ids in fits])
            # What was learnt may stand where others stood before.
            place[(place >= 0) & ~self._at(np.maximum(place, 0), keys)] = -1
            place[lacking] = np.where(small[lacking], self._find(keys[lacking], hashes[lacking]), -1)
        lengths = np.where(place < 0, 0, self.sizes[place]).astype(np.int64)
        apart: dict[int, list[int]] = {}
        if len(lacking):
            said = {i: text[starts[i] : starts[i] + sizes[i]] for i in np.flatnonzero(place < 0).tolist()}
            # Those that others have just taken the place of.
            gone = list(set(said.values()) - known.keys())
            known |= zip(gone, self._library([c.decode() for c in gone]), strict=True)
            apart = {i: known[c] for i, c in said.items()}
        for i, x in apart.items():
            lengths[i] = len(x)
        ends = np.cumsum(lengths)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
        kept = np.flatnonzero(place >= 0)
        n = lengths[kept]
        flat = self.ids[place[kept]][np.arange(KEY_IDS) < n[:, None]]
        out[np.repeat(ends[kept] - n - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(len(flat))] = flat
        for i, x in apart.items():
            out[ends[i] - len(x) : ends[i]] = x
        upto = np.append(0, ends)[np.searchsorted(starts, bounds)]
        return out, np.diff(upto)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, none of them null."""
        rows = texts.to_pylist() if self.whole else []
        apart = [i for i, t in enumerate(rows) if any(w in t for w in self.whole)]
        out: list = [[] for _ in range(len(texts))]
        for row, data, offsets in chunks(texts):
            bounds, owner = [0], []
            for i, stop in enumerate(offsets[1:].tolist()):
                while stop - bounds[-1] > PIECE_BYTES:
                    # The first cut after a piece's bytes; a text without any goes whole.
                    begin = bounds[-1] + PIECE_BYTES
                    cut = next((begin + int(c.argmax()) for begin in range(begin, stop, PIECE_BYTES) if (c := chunk_starts(data[begin - 3 : min(begin + PIECE_BYTES, stop)])[3:]).any()), stop)
                    bounds.append(cut)
                    owner.append(i)
                    if cut == stop:
                        break
                else:
                    bounds.append(stop)
                    owner.append(i)
            a = 0
            at = np.array(bounds)
            while a < len(owner):
                b = max(a + 1, int(np.searchsorted(at, at[a] + PIECE_BYTES, "right")) - 1)
                ids, n = self._piece(data[at[a] : at[b]], at[a : b + 1] - at[a])
                for i, x in zip(owner[a:b], np.split(ids, np.cumsum(n)[:-1]), strict=True):
                    out[row + i].append(x)
                a = b
        joined = [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.uint32) for x in out]
        for i, ids in zip(apart, self._library([rows[i] for i in apart]), strict=True):
            joined[i] = np.array(ids, np.uint32)
        return joined


@lru_cache(maxsize=1)
def _encoder(path: str, special_as_text: bool) -> Encoder:
    """A worker's encoder, which keeps its chunks from task to task."""
    return Encoder(path, special_as_text)


def _encode(path: str, special_as_text: bool, end: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encoder = _encoder(path, special_as_text)
    tail = b"" if end is None else np.array([end], "<u4").tobytes()
    for batch in batches:
        ids = [x.astype("<u4").tobytes() + tail for x in encoder.encode(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])


def encode(docs: DataFrame, tokenizer: str, end: int | None = None, special_as_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids: little-endian unsigned 32-bit) of every whole text, in ascending order of doc_id (nulls first).

    tokenizer is a file of the tokenizers library that every executor has. end is appended to each document. Strings of
    special tokens in texts are ordinary text, or with special_as_text=False the special ids. Null texts are empty; rows
    of one id are in the order of their texts' hashes, and each is a document. Other columns are not carried.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Equal rows differ by their places, so that many of them are dealt over many ranges.
    rows = rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash", "place")
    return rows.select("doc_id", "text").mapInArrow(partial(_encode, tokenizer, special_as_text, end), ENCODED)


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and its path there."""
    path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path)


def _bytes(path: str, name: str, start: int, stop: int) -> np.ndarray | memoryview:
    """Bytes of a file: mapped into memory where it is local, else one ranged read."""
    if start == stop:
        return memoryview(b"")
    fs, at = _place(path)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(f"{at}/{name}", "rb") as f:
            return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))[start:stop]
    with fs.open_input_file(f"{at}/{name}") as f:
        return memoryview(f.read_at(stop - start, start))


@dataclass
class Shard(WriterCommitMessage):
    """What a task has written; base_doc and base_token are set by the commit."""

    pid: int
    name: str
    docs: int
    tokens: int
    null_ids: int
    base_doc: int = 0
    base_token: int = 0


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, width: int, overwrite: bool):
        self.path, self.width, self.overwrite = path, width, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        pid = TaskContext.get().partitionId()
        shard = Shard(pid, f"{pid:05d}-{uuid.uuid4().hex}", 0, 0, 0)
        fs, at = _place(self.path)
        fs.create_dir(at, recursive=True)
        names = [f"{at}/{shard.name}.{kind}" for kind in ("tokens", "offsets", "ids")]
        kind = np.dtype(f"<u{self.width}")
        try:
            with fs.open_output_stream(names[0]) as tokens, fs.open_output_stream(names[1]) as offsets, fs.open_output_stream(names[2]) as keys:
                offsets.write(np.zeros(1, "<i8").tobytes())
                for batch in iterator:
                    ids, docs = batch.column("ids").to_pylist(), batch.column("doc_id")
                    for one in ids:
                        wide = np.frombuffer(one, "<u4")
                        if self.width < 4 and len(wide) and int(wide.max()) >> (8 * self.width):
                            raise ValueError(f"token id {int(wide.max())} does not fit into {self.width} bytes")
                        tokens.write(wide.astype(kind).tobytes())
                    sizes = np.array([len(x) // 4 for x in ids], "<i8")
                    offsets.write((shard.tokens + np.cumsum(sizes)).astype("<i8").tobytes())
                    keys.write(np.asarray(docs.fill_null(0).to_numpy(zero_copy_only=False), "<i8").tobytes())
                    shard.docs, shard.tokens, shard.null_ids = shard.docs + len(ids), shard.tokens + int(sizes.sum()), shard.null_ids + docs.null_count
        except BaseException:
            self._remove(fs, names)
            raise
        return shard

    @staticmethod
    def _remove(fs: pafs.FileSystem, names: list[str]) -> None:
        for info in fs.get_file_info(names):
            if info.type != pafs.FileType.NotFound:
                fs.delete_file(info.path)

    def commit(self, messages: list[Shard | None]) -> None:
        """Numbers the shards, writes the manifest, and removes files that it does not name: of lost attempts and of a table before."""
        fs, at = _place(self.path)
        shards = sorted((m for m in messages if m is not None and m.docs), key=lambda m: m.pid)
        docs = tokens = 0
        for m in shards:
            m.base_doc, m.base_token = docs, tokens
            docs, tokens = docs + m.docs, tokens + m.tokens
        told = {"format": 1, "width": self.width, "docs": docs, "tokens": tokens, "shards": [{k: v for k, v in vars(m).items() if k != "pid"} for m in shards]}
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/.{MANIFEST}") as f:
            f.write(json.dumps(told).encode())
        fs.move(f"{at}/.{MANIFEST}", f"{at}/{MANIFEST}")
        named = {m.name for m in shards}
        for info in fs.get_file_info(pafs.FileSelector(at)):
            if info.extension in ("tokens", "offsets", "ids") and info.base_name.rsplit(".", 1)[0] not in named:
                fs.delete_file(info.path)

    def abort(self, messages: list[Shard | None]) -> None:
        fs, at = _place(self.path)
        self._remove(fs, [f"{at}/{m.name}.{kind}" for m in messages if m is not None for kind in ("tokens", "offsets", "ids")])


@dataclass
class Slice(InputPartition):
    """Consecutive documents of a shard."""

    name: str
    first: int
    stop: int
    docs: int
    null_ids: int
    base_token: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, content: str):
        self.path, self.content = path, content
        fs, at = _place(path)
        with fs.open_input_file(f"{at}/{MANIFEST}") as f:
            told = json.loads(f.read())
        self.width, self.shards = told["width"], told["shards"]

    def partitions(self) -> list[Slice]:
        return [
            Slice(s["name"], a, min(a + SLICE_DOCS, s["docs"]), s["docs"], s["null_ids"], s["base_token"])
            for s in self.shards for a in range(0, s["docs"], SLICE_DOCS)
        ] or [Slice("", 0, 0, 0, 0, 0)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        p = partition
        if p.first == p.stop:
            return
        at = np.frombuffer(_bytes(self.path, f"{p.name}.offsets", p.first * 8, (p.stop + 1) * 8), "<i8")
        keys = np.frombuffer(_bytes(self.path, f"{p.name}.ids", p.first * 8, p.stop * 8), "<i8")
        kind = np.dtype(f"<u{self.width}")
        # A few megabytes of ids in a batch, one document at least.
        a, n = 0, p.stop - p.first
        while a < n:
            b = max(a + 1, int(np.searchsorted(at, at[a] + (1 << 20), "right")) - 1)
            ids = np.frombuffer(_bytes(self.path, f"{p.name}.tokens", int(at[a]) * self.width, int(at[b]) * self.width), kind).astype("<u4")
            cut = [ids[x - at[a] : y - at[a]] for x, y in zip(at[a:b], at[a + 1 : b + 1], strict=True)]
            if self.content == "crc32":
                last = pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64())
            else:
                last = pa.ListArray.from_arrays(pa.array((at[a : b + 1] - at[a]).astype(np.int32)), pa.array(ids.astype(np.int64)))
            null = np.arange(p.first + a, p.first + b) < p.null_ids
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[a:b].astype(np.int64), mask=null), pa.array(at[a:b].astype(np.int64) + p.base_token), pa.array(np.diff(at[a : b + 1]).astype(np.int64)), last],
                ["doc_id", "start", "n_tokens", "ids_crc32" if self.content == "crc32" else "ids"],
            )
            a = b


class TokenFiles(DataSource):
    """spark.read.format("token_files").load(folder): (doc_id, start, n_tokens, ids), start counting the ids of all documents before.

    Option content: "ids", or "crc32" for ids_crc32 (of the ids as little-endian unsigned 32-bit) instead of ids.
    Written from (doc_id, ids: little-endian unsigned 32-bit), with option width: bytes of an id in the files, 2 or 4.
    The folder is one that driver and executors share. Only mode overwrite: a table replaces the one before when it commits.
    """

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "doc_id bigint, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if self.options.get("content") == "crc32" else "ids array<bigint>")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("content", "ids"))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if not overwrite:
            raise ValueError("token files are written with mode overwrite")
        return _Writer(self.options["path"], int(self.options.get("width", 4)), overwrite)


def write(encoded: DataFrame, path: str, vocabulary: int) -> None:
    """Writes what encode() gives, in its order, in as few bytes an id as the vocabulary allows (2 or 4)."""
    encoded.sparkSession.dataSource.register(TokenFiles)
    encoded.select("doc_id", "ids").write.format("token_files").mode("overwrite").option("width", 2 if vocabulary <= 1 << 16 else 4).save(path)


def read(spark: SparkSession, path: str, content: str = "ids") -> DataFrame:
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").option("content", content).load(path)


def vocabulary(tokenizer: str) -> int:
    """One more than the greatest id of a tokenizer file, special ids among them."""
    return max(_tokenizer(tokenizer, True).get_vocab(with_added_tokens=True).values()) + 1
