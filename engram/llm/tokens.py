"""Token ids of whole texts, in Simple-8b files in ascending order of id, and the reader of these files."""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import simple8b
from ._base import tidy, work_path, written
from ._files import Replaced, opened
from ._text import _NOT_SPACE, byte_view, chunks, spread, words_of

MAGIC = b"ENGTOK01"
#: Blocks decoded at once by the reader.
READ_BLOCKS = 256
#: Distinct words, and pieces of words, whose ids a worker keeps.
MOST_KNOWN = 600_000
#: Bytes of text coded at once: the more, the fewer different words there are to look up.
CODE_BYTES = 6 << 20

#: Words made of these only are cut into runs of letters, single digits and runs of punctuation, as the
#: tokenizer's own pattern does; any other word, and one with an apostrophe or with <|, goes to the tokenizer whole.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\\[-`{-~]+")
_PIECE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")
#: Words that a tokenizer is tried on, with all kinds of white space between them, before it is used word by word.
_PROBE = ["The", "the", "cat's", "don't", "3.14", "1234567890", "a-b_c", "!!", "...", "(x)", "É", "naïve", "ÿß", "中文字", "Ωμέγα", "🙂", "<|x|>", "x<y>z", "e.g.,", "“q”", "I", "HELLO", "world", "'s", "a" * 70]


class WordEncoder:
    """Ids of single words from a tokenizer that drops white space, remembered piece by piece.

    No token of such a tokenizer spans white space, so a text's ids are its words' ids in a row; a corpus has far fewer
    different words than words. Its model alone codes the pieces of plain words: their case and
    composition are already normal, so normaliser and pattern would leave them as they are.
    """

    _made: dict[str, "WordEncoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.pieces_only = Tokenizer.from_file(path)
        self.pieces_only.normalizer = None
        self.pieces_only.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.pieces: dict[str, bytes] = {}
        probe = "".join(f"{a}{s}" for a, s in zip(_PROBE, " \t\n\x0b\f\r" * len(_PROBE)))
        if b"".join(self.ids(probe.split())) != array("I", self.whole.encode(probe, add_special_tokens=False).ids).tobytes():
            raise ValueError(f"{path}: a text's ids are not its words' ids in a row")

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def ids(self, words: list[str]) -> list[bytes]:
        known, pieces = self.known, self.pieces
        for kept in (known, pieces):
            if len(kept) > MOST_KNOWN:
                kept.clear()
        out = [known.get(w) for w in words]
        new = [k for k, x in enumerate(out) if x is None]
        cut: dict[int, list[str]] = {}
        fresh, odd = set(), set()
        for k in new:
            w = words[k]
            if _PLAIN.fullmatch(w) and "<|" not in w:
                cut[k] = _PIECE.findall(w.lower())
                fresh.update(cut[k])
            else:
                odd.add(w)
        for code, todo, to in ((self.pieces_only, fresh.difference(pieces), pieces), (self.whole, odd, known)):
            todo = list(todo)
            for i in range(0, len(todo), 4096):
                part = todo[i : i + 4096]
                for w, e in zip(part, code.encode_batch_fast(part, add_special_tokens=False)):
                    to[w] = array("I", e.ids).tobytes()
        for k in new:
            w = words[k]
            if k in cut:
                known[w] = b"".join([pieces[p] for p in cut[k]])
            out[k] = known[w]
        return out


def encode_texts(column: pa.Array, path: str, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, ids of each row) for runs of rows; end_id closes each row."""
    encoder = WordEncoder.of(path)
    raw, off = byte_view(column)
    for i, j in chunks(off, CODE_BYTES):
        w = words_of(raw[off[i] : off[j]], off[i : j + 1] - off[i], hashed=False)
        length = w.end - w.start
        packed = w.raw[np.frombuffer(w.raw.tobytes().translate(_NOT_SPACE), bool)]
        offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())])
        coded = pc.dictionary_encode(words)
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        ids = encoder.ids(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table = np.frombuffer(b"".join(ids), np.uint32)
        first = np.cumsum(size) - size
        at = coded.indices.to_numpy()
        n = size[at]
        # ids of each word, and one more place after each document's last
        per_doc = np.add.reduceat(np.append(n, 0), np.minimum(w.first[:-1], len(n))) * (w.count > 0) if len(w.first) > 1 else np.zeros(0, np.int64)
        per_doc = per_doc + 1
        out = np.full(int(per_doc.sum()), end_id, np.uint32)
        to = np.cumsum(n) - n + w.doc
        inner = spread(n)
        out[np.repeat(to, n) + inner] = table[np.repeat(first[at], n) + inner]
        yield i, j, out, per_doc


def _writer(folder: str, tokenizer: str, end_id: int):
    """One file for each partition; a file holds ids, then a footer: block offsets, document ids and sizes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}.tok"
        out, left = None, np.zeros(0, np.uint32)
        block_words, doc_ids, doc_sizes, total = [np.zeros(1, np.int64)], [], [], 0

        def put(values: np.ndarray) -> None:
            words, offsets = simple8b.encode(values)
            out.write(words.astype("<u8").tobytes())
            block_words.append(offsets[1:] + block_words[-1][-1])

        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                out = Replaced(path)
                out.write(MAGIC)
            doc_ids.append(batch.column(0))
            for _, _, ids, sizes in encode_texts(batch.column(1), tokenizer, end_id):
                doc_sizes.append(sizes)
                total += len(ids)
                left = np.concatenate([left, ids])
                whole = len(left) // simple8b.BLOCK * simple8b.BLOCK
                if whole >= 64 * simple8b.BLOCK:
                    put(left[:whole])
                    left = left[whole:]
        if out is None:
            return
        if len(left):
            put(left)
        ids = pa.concat_arrays([c.cast(pa.int64()) for c in doc_ids])
        known = np.array(ids.is_valid())
        offsets = np.concatenate(block_words)
        start = out.size
        for a, kind in ((offsets, "<i8"), (ids.fill_null(0).to_numpy(), "<i8"), (known, "u1"), (np.concatenate(doc_sizes), "<i8")):
            out.write(np.ascontiguousarray(a).astype(kind).tobytes())
        out.write(struct.pack("<QQQQ", start, len(offsets) - 1, len(known), total) + MAGIC)
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([path]), pa.array([len(known)], pa.int64()), pa.array([total], pa.int64()), pa.array([out.size], pa.int64())], ["part", "path", "n_docs", "n_ids", "n_bytes"])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1) -> DataFrame:
    """Write docs in ascending order of id and return the table of files (part, path, n_docs, n_ids, n_bytes).

    The rows are range-partitioned by id and sorted by (id, text); a range is one file, so files in order of part are
    the corpus in order. Null ids come first and stay null; repeated ids are separate documents; a null text is
    the end id alone. Every text is coded whole, a run of rows at a time.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ranged = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return written(ranged.mapInArrow(_writer(folder, tokenizer, end_id), "part long, path string, n_docs long, n_ids long, n_bytes long"), "token-files")


class TokenFile:
    """Random access to one file: documents' sizes from the footer, ids of any run of blocks."""

    def __init__(self, path: str):
        system, where = opened(path)
        self.file = system.open_input_file(where)
        size = self.file.size()
        tail = self.file.read_at(40, size - 40)
        if tail[32:] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        start, self.n_blocks, n_docs, self.n_ids = struct.unpack("<QQQQ", tail[:32])
        raw = self.file.read_at(size - 40 - start, start)
        self.offsets = np.frombuffer(raw, "<i8", self.n_blocks + 1)
        at = 8 * (self.n_blocks + 1)
        ids = np.frombuffer(raw, "<i8", n_docs, at)
        known = np.frombuffer(raw, "u1", n_docs, at + 8 * n_docs).astype(bool)
        self.sizes = np.frombuffer(raw, "<i8", n_docs, at + 9 * n_docs)
        self.ids = pa.array(ids, mask=~known)

    def blocks(self, a: int, b: int) -> np.ndarray:
        words = np.frombuffer(self.file.read_at(int(8 * (self.offsets[b] - self.offsets[a])), int(8 + 8 * self.offsets[a])), "<u8")
        n = min(self.n_ids, b * simple8b.BLOCK) - a * simple8b.BLOCK
        return simple8b.decode(words, self.offsets[a : b + 1] - self.offsets[a], n).astype(np.uint32)

    def documents(self) -> Iterator[np.ndarray]:
        """Each document's ids, with no more than some blocks and one document in memory."""
        block, have = 0, np.zeros(0, np.uint32)
        at = 0
        for n in self.sizes:
            if at + n > len(have):
                parts = [have[at:]]
                got = len(parts[0])
                while got < n:
                    parts.append(self.blocks(block, min(self.n_blocks, block + READ_BLOCKS)))
                    block = min(self.n_blocks, block + READ_BLOCKS)
                    got += len(parts[-1])
                have, at = np.concatenate(parts), 0
            yield have[at : at + n]
            at += n


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
            f = TokenFile(path)
            crc = np.fromiter((zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in f.documents()), np.int64, len(f.sizes))
            start = before + np.cumsum(f.sizes) - f.sizes
            for i in range(0, len(crc), 8192):
                s = slice(i, i + 8192)
                yield pa.RecordBatch.from_arrays([f.ids[s], pa.array(start[s]), pa.array(f.sizes[s]), pa.array(crc[s])], ["id", "start", "n_tokens", "crc"])


def read_tokens(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    start is the number of ids before the document in the whole corpus: a sum over the table of files, one row a
    file, plus the place within the file.
    """
    before = files.select("part", "path", (F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_ids")).alias("before"))
    # a number of partitions is named: their rows are few bytes, and adaptive execution would give all files to one task
    rows = before.repartition(max(1, min(files.count(), 20_000)), "part").mapInArrow(_reader, "id long, start long, n_tokens long, crc long")
    return rows.select(F.col("id").alias(id_col), "start", "n_tokens", F.col("crc").alias("ids_crc32"))


def token_output(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write docs' ids to a folder (a new one in the shared folder if none is named) and read them back."""
    spark: SparkSession = docs.sparkSession
    return read_tokens(write_tokens(docs, folder or work_path(spark, "tokens"), tokenizer, id_col, text_col, end_id), id_col)
