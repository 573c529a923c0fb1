"""Token ids in fixed-width bit-packed files with block offsets.

A file holds one shard of documents in ascending id order:

    "RMTB", then the blocks: each packs up to `block` ids at `bits` bits,
    most significant bit first, padded to a whole byte
    block table: int64 byte offset of each block
    document table: int64 document id and int64 first id's place, for each document
    footer: 8 int64 (version, bits, block, ids, blocks, documents, table's place, end mark)

All integers are little-endian.  An id's block and bit follow from its place,
so any run of ids is read with one seek and unpacked in numpy.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import Scratch, read_table

MAGIC, VERSION, END_MARK = b"RMTB", 1, 0x444E45
BLOCK = 1 << 14


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold every id below the vocabulary's size."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at a fixed width, most significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    raw = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(raw, axis=1)[:, 32 - bits :].ravel()).tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


class TokenWriter:
    """Writes one file front to back, holding a block of ids and the tables."""

    def __init__(self, sink, bits: int, block: int = BLOCK):
        self.sink, self.bits, self.block = sink, bits, block
        self.rest = np.zeros(0, np.uint32)
        self.place = self.sink.write(MAGIC) or len(MAGIC)
        self.blocks: list[int] = []
        self.doc_ids: list[int] = []
        self.starts: list[int] = []
        self.n_ids = 0

    def add(self, doc_ids: list[int], lengths: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.starts += (self.n_ids + np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)).tolist() if len(lengths) else []
        self.n_ids += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // self.block * self.block
        for at in range(0, whole, self.block):
            self._write(self.rest[at : at + self.block])
        self.rest = self.rest[whole:]

    def _write(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.blocks.append(self.place)
        self.sink.write(data)
        self.place += len(data)

    def close(self) -> None:
        if len(self.rest):
            self._write(self.rest)
        table = np.array(self.blocks, "<i8").tobytes() + np.array(self.doc_ids, "<i8").tobytes() + np.array(self.starts, "<i8").tobytes()
        self.sink.write(table)
        self.sink.write(np.array([VERSION, self.bits, self.block, self.n_ids, len(self.blocks), len(self.doc_ids), self.place, END_MARK], "<i8").tobytes())
        self.sink.close()


class TokenReader:
    """Random access to a token file by place or document."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        version, self.bits, self.block, self.n_ids, n_blocks, n_docs, at, mark = np.frombuffer(source.read_at(64, size - 64), "<i8").tolist()
        if version != VERSION or mark != END_MARK or source.read_at(4, 0) != MAGIC:
            raise ValueError("not a whole token file")
        table = np.frombuffer(source.read_at(size - 64 - at, at), "<i8")
        self.blocks = np.append(table[:n_blocks], at)
        self.doc_ids, self.starts = table[n_blocks : n_blocks + n_docs], np.append(table[n_blocks + n_docs :], self.n_ids)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file; reads only the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self.source.read_at(int(self.blocks[last + 1] - self.blocks[first]), int(self.blocks[first]))
        out, at = [], 0
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            size = int(self.blocks[b + 1] - self.blocks[b])
            out.append(unpack(data[at : at + size], self.bits, n))
            at += size
        return np.concatenate(out)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


#: How a tokenizer must clean and cut texts for `PieceEncoder` to cut them itself.
CLEANED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SPACE = re.compile("[ \t\n\v\f\r]+")
#: Characters outside Latin, and the one of them whose lower case is two characters.
_ODD = re.compile("[^\0-\x7f¡-ſ]|İ")
#: CUT as it is for Latin; what comes most is tried first.
_PIECES = re.compile("[a-zªµºÀ-ÖØ-öø-ſ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼-¾]|[^ \t\n\v\f\r0-9a-zª²³µ¹º¼-¾À-ÖØ-öø-ſ]+")


class _Places(dict):
    """Numbers texts in the order they come; `fresh` lists those new since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, text: str) -> int:
        self[text] = n = len(self)
        self.fresh.append(text)
        return n


class PieceEncoder:
    """Encodes texts as the tokenizers library does, each different piece of text once.

    For a tokenizer that cuts texts as CUT says, Latin text is cut here and the
    library encodes pieces it hasn't seen, many in a row, told apart by tokens
    that end a piece; words with other characters or special tokens go to the
    library as they are.  Other tokenizers get whole texts.
    """

    #: A worker forgets all pieces beyond these bounds, about 100 MB.
    MOST_KNOWN, MOST_CHARACTERS = 600_000, 16_000_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        cutters = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        ending = config["model"].get("end_of_word_suffix")
        self.cuts = bool(ending) and (config.get("normalizer") or {}).get("normalizers") == CLEANED and cutters[0].get("pattern") == {"Regex": CUT} and len(cutters) == 2 and config.get("post_processor") is None
        self.special = [t["content"] for t in config.get("added_tokens") or []]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if self.cuts:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(ending)]] = True
            # for pieces that are clean and cut already
            self.of_pieces = Tokenizer.from_str(json.dumps(config | {"normalizer": None, "pre_tokenizer": config["pre_tokenizer"] | {"pretokenizers": [{"type": "WhitespaceSplit"}, cutters[1]]}}))
        self._forget()

    def _forget(self) -> None:
        self.places, self.characters = _Places(), 0
        self.known, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _library(self, tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.array([len(x) for x in found], np.int64)
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(n.sum())), n

    def _plain(self, text: str) -> bool:
        return (text.isascii() or not _ODD.search(text)) and not any(s in text for s in self.special)

    def _pieces(self, text: str) -> list[str]:
        """The text's pieces; a word for the library has a blank before it."""
        if self._plain(text):
            return _PIECES.findall(text.lower())
        out: list[str] = []
        for word in _SPACE.split(text):
            if self._plain(word):
                out += _PIECES.findall(word.lower())
            else:
                out.append(" " + word)
        return out

    def _learn(self, new: list[str]) -> None:
        plain, odd = [p for p in new if p[0] != " "], [p[1:] for p in new if p[0] == " "]
        ids, _ = self._library(self.of_pieces, [" ".join(plain[k : k + 2000]) for k in range(0, len(plain), 2000)])
        ends = np.diff(np.concatenate([[-1], np.flatnonzero(self.ends[ids])]))
        if len(ends) != len(plain) or ends.sum() != len(ids):  # a piece that the library cuts again
            ids, ends = self._library(self.tokenizer, plain)
        odd_ids, odd_n = self._library(self.tokenizer, odd)
        is_odd, n = np.array([p[0] == " " for p in new]), np.empty(len(new), np.int64)
        n[is_odd], n[~is_odd] = odd_n, ends
        own, mine = np.empty(int(n.sum()), np.uint32), np.repeat(is_odd, n)
        own[mine], own[~mine] = odd_ids, ids
        self.known = np.concatenate([self.known, own])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n)])
        self.characters += sum(map(len, new))

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text with end_id after it, and the texts' lengths."""
        if self.cuts:
            if len(self.places) > self.MOST_KNOWN or self.characters > self.MOST_CHARACTERS:
                self._forget()
            pieces = [self._pieces(t) for t in texts]
            count = np.array([len(p) for p in pieces], np.int64)
            at = np.fromiter(map(self.places.__getitem__, itertools.chain.from_iterable(pieces)), np.int64, int(count.sum()))
            if self.places.fresh:
                self._learn(self.places.fresh)
                self.places.fresh = []
            n = self.first[at + 1] - self.first[at]
            total = np.concatenate([[0], np.cumsum(n)])
            ids = self.known[np.arange(total[-1]) + np.repeat(self.first[at] - total[:-1], n)]
            lengths = np.diff(total[np.concatenate([[0], np.cumsum(count)])])
        else:
            ids, lengths = self._library(self.tokenizer, texts)
        out = np.full(len(ids) + len(texts), end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), lengths)] = ids
        return out, lengths + 1


def local_path(uri: str):
    """pyarrow's file system and path for a shared folder's address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


@functools.cache
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _write_files(folder: str, tokenizer_path: str, bits: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        context = TaskContext.get()
        fs, base = local_path(folder)
        writer, done = None, f"{base}/shard-{context.partitionId():06d}.tok"
        # a lost or repeated attempt leaves its own file; the finished one takes the name
        making = f"{done}.{context.taskAttemptId()}"
        first = None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(ids):
                end, size = at, 0
                while end < len(ids) and (end == at or size < 1 << 20):
                    size += len(texts[end].as_py() or "")
                    end += 1
                tokens, lengths = encoder.encode([t or "" for t in texts.slice(at, end - at).to_pylist()], end_id)
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    writer = TokenWriter(fs.open_output_stream(making), bits)
                # a null id is written as the least one, which sorts first as nulls do
                own = [-(1 << 63) if x is None else x for x in ids.slice(at, end - at).to_pylist()]
                first = own[0] if first is None else first
                writer.add(own, lengths, tokens)
                at = end
        if writer is not None:
            writer.close()
            if fs.get_file_info(done).is_file:  # an earlier attempt's file, which holds the same
                fs.delete_file(making)
            else:
                fs.move(making, done)
            yield pa.RecordBatch.from_pydict({"shard": [context.partitionId()], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.n_ids]}, schema=_SHARDS)

    return run


_SHARDS = pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, vocabulary: int, end_id: int, n_shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Write all of docs as token files under folder, ascending by id, and a manifest; return the manifest's shards.

    A null or empty text is its end id alone; rows that repeat an id follow one
    another, in the order of their texts' hashes; null ids come first.  An empty table writes a manifest without
    shards.  Other columns are not read.
    """
    spark = docs.sparkSession
    n = n_shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = bits_for(max(vocabulary, end_id + 1))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    made = rows.mapInArrow(_write_files(folder, tokenizer_path, bits, end_id), "shard int, n_docs long, n_ids long").collect()  # a row for each shard
    shards, start = [], 0
    for r in sorted(made):
        shards.append({"file": f"shard-{r.shard:06d}.tok", "start": start, "n_docs": r.n_docs, "n_ids": r.n_ids})
        start += r.n_ids
    fs, base = local_path(folder)
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"version": VERSION, "bits": bits, "block": BLOCK, "end_id": end_id, "n_ids": start, "shards": shards}).encode())
    return shards


def _read_files(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = local_path(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = TokenReader(fs.open_input_file(f"{base}/{name}"))
                k, n = 0, len(reader.doc_ids)
                while k < n:  # about a million ids at a time, or one document
                    end = max(k + 1, int(np.searchsorted(reader.starts, reader.starts[k] + (1 << 20))) - 1)
                    end = min(end, n)
                    some = reader.ids(int(reader.starts[k]), int(reader.starts[end])).astype("<u4")
                    edge = reader.starts[k : end + 1] - reader.starts[k]
                    view = memoryview(some).cast("B")
                    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                    own = reader.doc_ids[k:end]
                    yield pa.RecordBatch.from_arrays([pa.array(own, mask=own == -(1 << 63)), pa.array(start + reader.starts[k:end]), pa.array(np.diff(edge)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    k = end

    return run


def read_token_files(spark: SparkSession, folder: str, shards: list[dict]) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) of all documents, from the files."""
    files = spark.createDataFrame([(s["file"], s["start"]) for s in shards], "file string, start long")
    return files.repartition(max(1, len(shards)), "start").mapInArrow(_read_files(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, scratch: Scratch | None = None, vocabulary: int = 49_408, end_id: int = 2, tokenizer_path: str | None = None) -> DataFrame:
    """Write docs as token files in the shared folder and read them back as one row for each document."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    scratch = scratch or Scratch(docs.sparkSession, "tokens")
    shards = write_token_files(docs, f"{scratch.path}/tokens", tokenizer_path, vocabulary, end_id)
    return read_token_files(docs.sparkSession, f"{scratch.path}/tokens", shards)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` through bit-packed token files."""
    return encode_documents(read_table(spark, sf_dir, "documents"))
