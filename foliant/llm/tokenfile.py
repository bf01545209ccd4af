"""Token ids of documents in binary files: patched frame-of-reference blocks.

A file is written by one task and holds the documents of one range of keys, in order:

    blocks    smallest value (u32), bits per value (u8), exceptions (u16), then 512 values minus the smallest, packed at that width,
              then the places (u16) and values minus the smallest (u32) of the exceptions
    trailer   starts of the blocks, lengths of the documents as blocks of the same kind with their starts, keys as an Arrow table
    end       lengths of the parts of the trailer and number of ids and documents (JSON), its length (u32), magic

The width of a block holds all but the largest values, by ``SHARE``; the others are the exceptions. Unused places of the last block repeat
its smallest value. With the starts any block can be read alone.
"""

from __future__ import annotations

import io
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import as_bytes, lists, pieces, plain_words, written

MAGIC = b"PFOR0001"
BLOCK = 512
SHARE = 0.9
HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("patches", "<u2")])
#: Blocks handled at a time when writing and reading.
AT_ONCE = 512


def packed(values: np.ndarray) -> list[bytes]:
    """Blocks of unsigned 32-bit values."""
    n = len(values)
    rows = -(-n // BLOCK)
    grid = np.zeros(rows * BLOCK, np.uint32)
    grid[:n] = values
    if n % BLOCK:
        grid[n:] = values[(rows - 1) * BLOCK:].min()
    grid = grid.reshape(rows, BLOCK)
    least = grid.min(1)
    over = grid - least[:, None]
    at = int(np.ceil(SHARE * BLOCK)) - 1
    typical = np.partition(over, at, axis=1)[:, at]
    width = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(np.uint8)
    odd = (over.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    head = np.zeros(rows, HEAD)
    head["least"], head["width"], head["patches"] = least, width, odd.sum(1)
    row, column = np.nonzero(odd)
    places, values, heads = column.astype("<u2").tobytes(), over[row, column].astype("<u4").tobytes(), head.tobytes()
    first = np.concatenate(([0], np.cumsum(head["patches"], dtype=np.int64))).tolist()
    out: list[bytes] = [b""] * rows
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        kind, size = (">u2", 16) if w <= 16 else (">u4", 32)
        bits = np.unpackbits(over[own].astype(kind).view(np.uint8).reshape(len(own), BLOCK, size // 8), axis=2)[:, :, size - w:]
        body, step = np.packbits(bits.reshape(len(own), -1), axis=1).tobytes(), BLOCK * w // 8
        for k, i in enumerate(own.tolist()):
            a, b = first[i], first[i + 1]
            out[i] = heads[HEAD.itemsize * i:HEAD.itemsize * (i + 1)] + body[step * k:step * (k + 1)] + places[2 * a:2 * b] + values[4 * a:4 * b]
    return out


def unpacked(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Values of the blocks that start at ``starts`` in ``data``."""
    raw = np.frombuffer(data, np.uint8)
    head = raw[starts[:, None] + np.arange(HEAD.itemsize)].copy().view(HEAD)[:, 0] if len(starts) else np.zeros(0, HEAD)
    out = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(head["width"]):
        own = np.flatnonzero(head["width"] == w)
        body = raw[starts[own][:, None] + HEAD.itemsize + np.arange(BLOCK * int(w) // 8)]
        bits = np.unpackbits(body, axis=1).reshape(len(own), BLOCK, int(w))
        values = np.zeros((len(own), BLOCK), np.uint32)
        for b in range(int(w)):
            values |= bits[:, :, b].astype(np.uint32) << np.uint32(int(w) - 1 - b)
        out[own] = values
    for i in np.flatnonzero(head["patches"]):
        n = int(head["patches"][i])
        first = int(starts[i]) + HEAD.itemsize + BLOCK * int(head["width"][i]) // 8
        places = np.frombuffer(data, "<u2", n, first)
        out[i, places] = np.frombuffer(data, "<u4", n, first + 2 * n)
    return (out + head["least"][:, None]).ravel()


#: Punctuation after a word, up to white space: the tokenizer starts anew there. Only after a letter of ASCII or Latin-1, or a digit.
TAIL = re.compile(rb"([!-/:-@\[-`{-~])(?:(?<=[a-z0-9][!-/:-@\[-`{-~])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][!-/:-@\[-`{-~]))([!-/:-@\[-`{-~]*)(?=\s|\Z)")
LETTERS_ONLY = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
MOST_WORDS = 500_000


class Encoder(dict):
    """Packed ids of words by a tokenizer that lowers case, drops white space and never joins across it.

    A word that was met before is looked up; the punctuation that ends it is looked up apart. New words go to the tokenizer many at a time. Texts that may
    hold a special token are encoded whole, since those can span words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.pieces = self.model.model.tokenize
        size = self.model.get_vocab_size()
        self.ends = np.array([(self.model.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self)
        if len(self) + len(new) > MOST_WORDS:
            self.clear()
            new = words
        # a word of ASCII letters is one piece, in the characters of the vocabulary
        plain = [w for w in new if w.isalpha()]
        for w in plain:
            self[w] = array("I", [t.id for t in self.pieces(w.decode())]).tobytes()
        # words of letters alone are one piece each, so the ends of pieces tell them apart in one long text
        letters = [w for w in new if not w.isalpha() and LETTERS_ONLY.fullmatch(w)]
        for first in range(0, len(letters), 5_000):
            part = letters[first:first + 5_000]
            ids = np.array(self.model.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part):
                raise ValueError("the tokenizer joins or splits words of letters")
            raw, at = ids.tobytes(), 0
            for w, stop in zip(part, (4 * stops).tolist()):
                self[w] = raw[at:stop]
                at = stop
        rest = list(new.difference(self))
        for w, e in zip(rest, self.model.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)):
            self[w] = np.array(e.ids, np.uint32).tobytes()

    def ids(self, texts: list[bytes], end: int) -> Iterator[np.ndarray]:
        """Ids of each text, closed by ``end``."""
        cut = [None if b"<|" in t else plain_words(TAIL.sub(rb" \1\2", t.lower())) for t in texts]
        self.learn(set().union(*(words for words in cut if words is not None)))
        last = np.array([end], np.uint32).tobytes()
        for text, words in zip(texts, cut):
            if words is None:
                found = self.model.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
                yield np.array([*found, end], np.uint32)
            else:
                yield np.frombuffer(b"".join((*map(self.__getitem__, words), last)), np.uint32)


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(path)


class Writer:
    """One file: ids go out as blocks while documents come in."""

    def __init__(self, out):
        self.out, self.at, self.starts, self.waiting, self.held = out, 0, [], [], 0
        self.lengths: list[int] = []
        self.keys: list[pa.Array] = []

    def add(self, ids: np.ndarray) -> None:
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= AT_ONCE * BLOCK:
            self.flush()

    def flush(self, all_of_it: bool = False) -> None:
        ids = np.concatenate([np.empty(0, np.uint32), *self.waiting])
        ready = len(ids) if all_of_it else len(ids) // BLOCK * BLOCK
        for block in packed(ids[:ready]) if ready else []:
            self.starts.append(self.at)
            self.at += len(block)
            self.out.write(block)
        self.waiting, self.held = [ids[ready:]], len(ids) - ready

    def close(self) -> dict:
        self.flush(True)
        lengths = packed(np.array(self.lengths, np.uint32)) if self.lengths else []
        starts = np.cumsum([0, *map(len, lengths)])[:-1]
        sink = io.BytesIO()
        keys = pa.table({"key": pa.chunked_array(self.keys)})
        with pa.ipc.new_stream(sink, keys.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(keys)
        parts = [np.array(self.starts, "<u8").tobytes(), b"".join(lengths), starts.astype("<u8").tobytes(), sink.getvalue()]
        end = json.dumps({"blocks": self.at, "parts": [len(p) for p in parts], "ids": int(sum(self.lengths)), "docs": len(self.lengths)}).encode()
        for part in (*parts, end, len(end).to_bytes(4, "little"), MAGIC):
            self.out.write(part)
        return {"ids": int(sum(self.lengths)), "docs": len(self.lengths), "bytes": self.at + sum(map(len, parts)) + len(end) + 12}


class Reader:
    """One file: its documents in order, or any stretch of its ids by the starts of its blocks."""

    def __init__(self, source, size: int):
        self.source = source
        tail = self.part(size - 12, 12)
        if tail[4:] != MAGIC:
            raise ValueError("not a file of token ids")
        n = int.from_bytes(tail[:4], "little")
        self.about = json.loads(self.part(size - 12 - n, n))
        sizes = self.about["parts"]
        first = size - 12 - n - sum(sizes)
        a, b, c, d = (self.part(first + sum(sizes[:i]), sizes[i]) for i in range(4))
        self.starts = np.concatenate((np.frombuffer(a, "<u8").astype(np.int64), [self.about["blocks"]]))
        self.lengths = unpacked(b, np.frombuffer(c, "<u8").astype(np.int64))[:self.about["docs"]].astype(np.int64)
        self.keys = pa.ipc.open_stream(d).read_all().column("key")

    def part(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.empty(0, np.uint32)
        first, last = start // BLOCK, -(-stop // BLOCK)
        data = self.part(int(self.starts[first]), int(self.starts[last] - self.starts[first]))
        return unpacked(data, self.starts[first:last] - self.starts[first])[start - first * BLOCK:stop - first * BLOCK]

    def documents(self) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """Stretches of documents: first and last number, and the ids of each. A stretch has about ``AT_ONCE`` blocks, or one long document."""
        ends, first = np.cumsum(self.lengths), 0
        while first < len(ends):
            base = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, base + AT_ONCE * BLOCK, "right")))
            ids = self.ids(base, int(ends[last - 1]))
            yield first, last, np.split(ids, (ends[first:last - 1] - base).astype(np.int64))
            first = last


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_tokens(docs: DataFrame, tokenizer: str, end: int = 1, key: str = "doc_id", text: str = "text", file_bytes: int = 32_000_000,
                 folder: str | None = None, keep_words: bool = True) -> DataFrame:
    """Encode all texts, in ascending order of ``key``, into files below ``folder`` (default: the shared one). Returns the table of files:
    ``part, file, docs, ids, bytes``, parts in the order of keys.

    ``end`` closes each document. A null or empty text is that id alone. Null keys come first; repeated keys are in the order of a hash of their text.
    A file holds about ``file_bytes`` of text; a task holds a few blocks and one text at a time. A task that runs again writes the same
    file and puts it in place only when it is whole. Workers keep the words they met for their next task, unless ``keep_words`` is false: then that memory is
    free for other steps. An empty table gives no file. Other columns are not read.
    """
    folder = folder or f"{shared_folder(docs.sparkSession)}/foliant/{uuid.uuid4().hex}/tokens"
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    files = max(1, -(-size // file_bytes))
    given = docs.select(F.col(key).alias("key"), as_bytes(text).alias("content"), F.xxhash64(text).alias("hash"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name, writer, sink, encoder = f"{folder}/part-{part:06d}.pfor", None, None, None
        store, path = opened(name)
        for batch, texts in pieces(batches, "content"):
            if writer is None:
                store.create_dir(os.path.dirname(path), recursive=True)
                sink = store.open_output_stream(f"{path}.{attempt}")
                writer, encoder = Writer(sink), encoder_of(tokenizer)
            for ids in encoder.ids(texts, end):
                writer.add(ids)
            writer.keys.append(batch.column("key"))
        if writer is not None:
            about = writer.close()
            sink.close()
            store.move(f"{path}.{attempt}", path)
            if not keep_words:
                encoder.clear()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "docs": [about["docs"]], "ids": [about["ids"]], "bytes": [about["bytes"]]})

    return written(given.repartitionByRange(files, "key", "hash").sortWithinPartitions("key", "hash").select("key", "content")
                   .mapInArrow(write, "part long, file string, docs long, ids long, bytes long"), "files")


def read_tokens(files: DataFrame, kind: str = "bigint", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Documents of the files: ``key, start, n_tokens, ids_crc32`` and, if asked for, ``ids``; ``start`` counts the ids of all documents before.

    ``kind`` is the type of the key. The checksum is that of the ids as little-endian unsigned 32-bit integers.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    placed = files.select("part", "file", before.alias("before"))

    names = ["key", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                store, path = opened(name)
                with store.open_input_file(path) as source:
                    reader = Reader(source, source.size())
                    for first, last, ids in reader.documents():
                        many = reader.lengths[first:last]
                        starts = start + np.cumsum(many) - many
                        columns = [reader.keys.slice(first, last - first).combine_chunks(), pa.array(starts), pa.array(many),
                                   pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                        if with_ids:
                            columns.append(lists(np.concatenate(ids).astype(np.int32), many))
                        yield pa.RecordBatch.from_arrays(columns, names=names)
                        start += int(many.sum())

    return (placed.repartition(max(1, files.count()), "part").mapInArrow(read, f"key {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
            .withColumnRenamed("key", key))
