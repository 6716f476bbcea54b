"""Operator 2, token ids in seekable files of independent zstandard frames.

A file is a run of frames, each a complete zstandard frame with a content checksum, then a seek table and a footer:

    frame ...            the ids of DOCS_PER_FRAME or fewer documents, little-endian, WIDTH bytes each
    seek table           one zstandard skippable frame: for each frame ROW, then for each document (doc_id, n_ids) as DOC
    footer               FOOT: frames, documents, bytes of the table, width, CRC-32 of the table, magic

A reader takes the footer and the table from the file's end and decompresses only the frames that hold the documents
asked for. Every frame's ROW has the CRC-32 of its raw ids, which is checked after decompression.

Files come in ascending order of doc_id (null first), so that a document's start is the ids of the files before, of the
frames before and of the documents before it. Each task writes one file under a name of its own and reports it in its
result; a repeated task writes another file and the first is never listed, so lost executors do no harm.

Defined cases: a null text has the end id only; rows with equal doc_id are ordered by text and keep an entry each; a null
doc_id is stored as the smallest long and given back as null; an empty table gives no file and an empty result; a text of any
length is encoded whole, in memory of its own size; other columns are left out.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

END_ID = 1
DOCS_PER_FRAME = 256
IDS_PER_FRAME = 1 << 20
MEMO = 200_000
MAGIC = 0x5A53_4551
SKIPPABLE = 0x184D2A5E
HEAD = struct.Struct("<II")
ROW = struct.Struct("<QQQIIQ")  # place, compressed bytes, raw bytes, CRC-32, documents, first id in the file
DOC = struct.Struct("<qQ")
FOOT = struct.Struct("<IQQIII")
NO_ID = -(1 << 63)
SUMMARY = "path string, part int, n_docs long, n_ids long"


def open_store(path: str):
    """The file system of a path of any scheme that pyarrow knows, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


class FileWriter:
    """Writes one file; documents must come in order."""

    def __init__(self, sink, width: int):
        self.sink, self.dtype, self.width = sink, f"<u{width}", width
        self.packer = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)
        self.rows, self.docs, self.parts, self.held, self.ids, self.place, self.pending = [], [], [], 0, 0, 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((NO_ID if doc_id is None else doc_id, len(ids)))
        self.parts.append(ids)
        self.pending += 1
        self.held += len(ids)
        if self.pending >= DOCS_PER_FRAME or self.held >= IDS_PER_FRAME:
            self._frame()

    def _frame(self) -> None:
        if not self.pending:
            return
        raw = np.concatenate(self.parts).astype(self.dtype).tobytes()
        packed = self.packer.compress(raw)
        self.rows.append(ROW.pack(self.place, len(packed), len(raw), zlib.crc32(raw), self.pending, self.ids))
        self.sink.write(packed)
        self.place += len(packed)
        self.ids += self.held
        self.parts, self.held, self.pending = [], 0, 0

    def close(self) -> None:
        self._frame()
        docs = np.array(self.docs, "<i8").reshape(-1, 2).tobytes()
        table = b"".join(self.rows) + docs
        self.sink.write(HEAD.pack(SKIPPABLE, len(table) + FOOT.size) + table)
        self.sink.write(FOOT.pack(len(self.rows), len(self.docs), len(table), self.width, zlib.crc32(table), MAGIC))


class FileReader:
    """Random access to one file: reads the table once, and then only frames that are asked for."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - FOOT.size)
        frames, docs, length, self.width, crc, magic = FOOT.unpack(source.read(FOOT.size))
        if magic != MAGIC:
            raise ValueError("no seek table at the file's end")
        source.seek(size - FOOT.size - length)
        table = source.read(length)
        if zlib.crc32(table) != crc:
            raise ValueError("the seek table's checksum differs")
        self.frames = [ROW.unpack_from(table, i * ROW.size) for i in range(frames)]
        entries = np.frombuffer(table, "<i8", docs * 2, frames * ROW.size).reshape(-1, 2)
        self.doc_ids, self.sizes = entries[:, 0], entries[:, 1]
        self.frame_docs = np.concatenate([[0], np.cumsum([f[4] for f in self.frames], dtype=np.int64)])
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> np.ndarray:
        place, packed, raw, crc, _, _ = self.frames[k]
        self.source.seek(place)
        data = self.unpacker.decompress(self.source.read(packed), max_output_size=raw)
        if zlib.crc32(data) != crc:
            raise ValueError(f"frame {k}: the checksum differs")
        return np.frombuffer(data, f"<u{self.width}")

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id in the file, ids) of all documents, or of those wanted; only their frames are read."""
        for k, f in enumerate(self.frames):
            lo, hi = self.frame_docs[k], self.frame_docs[k + 1]
            own = self.doc_ids[lo:hi]
            if wanted is not None and not wanted.intersection(own.tolist()):
                continue
            ids, at = self.frame(k), 0
            for d, n in zip(own.tolist(), self.sizes[lo:hi].tolist()):
                if wanted is None or d in wanted:
                    yield None if d == NO_ID else d, f[5] + at, ids[at : at + n]
                at += n


def _kinds() -> np.ndarray:
    k = np.zeros(256, np.uint8)
    k[33:127] = 2
    k[65:91] = k[97:123] = 1
    k[39] = 0
    return k


#: 1: ASCII letters, 2: other ASCII, 0: the apostrophe and parts of other characters. No pre-token holds a 1 beside a 2.
KINDS = _kinds()
LATIN_END, DOTTED_I = "\u0250", "\u0130"


#: The normaliser and the pre-tokenizer whose pieces are independent; fixed values of the tokenizer's file format.
NORMAL = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_words(tokenizer) -> bool:
    """Whether a tokenizer has that normaliser and pre-tokenizer."""
    made = json.loads(tokenizer.to_str())
    normal, split = made.get("normalizer") or {}, (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    patterns = [(x.get("pattern") or {}).get("Regex") for x in split]
    kinds = [x.get("type") for x in normal.get("normalizers", [])]
    return kinds == NORMAL and patterns == [SPLIT, None] and [x.get("type") for x in split] == ["Split", "ByteLevel"] and not made.get("post_processor")


class WordEncoder:
    """Encodes texts piece by piece and remembers pieces.

    White space and a border of an ASCII letter and another ASCII character (but an apostrophe) end a pre-token, and the
    normaliser looks at no context across them, so that a text's ids are those of its pieces. Words of plain Latin
    letters are one pre-token and go to the tokenizer's model directly; all others through the whole tokenizer. That holds
    for the normaliser and the pre-tokenizer named in NORMAL and SPLIT alone, which is checked: texts go whole through others.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.by_words = self.tokenizer.model, splits_words(self.tokenizer)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.old: dict[int, np.ndarray] = {}
        self.young: dict[int, np.ndarray] = {}
        letters = (chr(c) for c in range(ord("A"), ord(LATIN_END)) if chr(c).isalpha())
        self.spelt = {ord(c): ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0] for c in letters}

    @property
    def width(self) -> int:
        return 2 if max(self.tokenizer.get_vocab_size(), END_ID + 1) <= 1 << 16 else 4

    def _new(self, words: list[str]) -> list[np.ndarray]:
        out, rest = [None] * len(words), []
        for i, w in enumerate(words):
            if w.isalpha() and max(w) < LATIN_END and DOTTED_I not in w:
                w = w.lower()
                out[i] = np.array([t.id for t in self.model.tokenize(w if w.isascii() else w.translate(self.spelt))], np.uint32)
            else:
                rest.append(i)
        for i, x in zip(rest, self.tokenizer.encode_batch([words[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(x.ids, np.uint32)
        return out

    def _pieces(self, keys: list[int], word) -> list[np.ndarray]:
        found = [self.young.get(k) for k in keys]
        new = []
        for i, x in enumerate(found):
            if x is None:
                x = self.old.get(keys[i])
                if x is None:
                    new.append(i)
                else:
                    found[i] = self.young[keys[i]] = x
        for i, x in zip(new, self._new([word(i) for i in new])):
            found[i] = self.young[keys[i]] = x
        if len(self.young) > MEMO:
            self.old, self.young = self.young, {}
        return found

    def encode(self, buf: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a run, each with END_ID, and where each text's ids begin."""
        if not self.by_words or any(x in buf for x in self.special):  # a special token's string is found before words are, and with its case
            texts = [buf[at[i] : at[i + 1] - 1].decode("utf-8", "surrogatepass") for i in range(len(at) - 1)]
            found = [np.array([*x.ids, END_ID], np.uint32) for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])
        s, e, h, cut = common.word_rows(buf, at, kinds=KINDS)
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        pieces = self._pieces(keys, lambda i: buf[s[first[i]] : e[first[i]]].decode("utf-8", "surrogatepass"))
        pieces.append(np.array([END_ID], np.uint32))
        size = np.array([len(p) for p in pieces], np.int64)
        begin = np.cumsum(size) - size
        flat = np.concatenate(pieces)
        # after each text's words comes the end, as one more word
        order = np.insert(which, cut[1:], len(keys))
        n = size[order]
        to = np.cumsum(n)
        ids = flat[np.repeat(begin[order] - (to - n), n) + np.arange(to[-1] if len(to) else 0)]
        ends = to[cut[1:] + np.arange(len(cut) - 1)]
        return ids, np.concatenate([[0], ends])


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One for each worker, so that tasks share what it remembers."""
    return _encoders.setdefault(path, None) or _encoders.__setitem__(path, WordEncoder(path)) or _encoders[path]


def write(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Writes docs in ascending doc_id order; a row of SUMMARY for each file."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = encoder_of(tokenizer), TaskContext.get().partitionId()
        path, out, sink = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex}.zsq", None, None
        total = count = 0
        for batch in rows:
            doc_ids = batch.column(0).to_pylist()
            for lo, hi, buf, at in common.batches(batch.column(1)):
                ids, cut = encoder.encode(buf, at)
                if out is None:
                    store, place = open_store(path)
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    sink = store.open_output_stream(place)
                    out = FileWriter(sink, encoder.width)
                for i in range(hi - lo):
                    out.add(doc_ids[lo + i], ids[cut[i] : cut[i + 1]])
                count, total = count + hi - lo, total + len(ids)
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "part": pa.array([part], pa.int32()), "n_docs": [count], "n_ids": [total]})

    ordered = docs.select("doc_id", "text").repartitionByRange(common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, SUMMARY)


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in files (SUMMARY rows), read through the seek tables."""
    starts = files.withColumn("start", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids"))  # a row for each file

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = open_store(path)
                with store.open_input_file(place) as source:
                    found = [(d, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, at, ids in FileReader(source).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = starts.select("path", "start").repartition(common.partitions(files.sparkSession), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_seekable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    scratch = common.Scratch(spark, "ids")
    docs = common.table(spark, sf_dir, "documents")
    return read(scratch.keep(write(spark, docs, scratch.path("files"), public_tokenizers.path("word_bpe_49k.json")), "written"))
