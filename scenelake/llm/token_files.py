"""Token-id files: concatenated ids of documents with Elias-Fano coded document boundaries.

A file holds the documents of one stretch of ascending ids. Its parts, each aligned to 8 bytes:

    header   8 little-endian 64-bit numbers: magic, documents, ids, bytes an id, low bits, bytes of low, bytes of high, null ids
    doc ids  one 64-bit number a document (null ids come first, with value 0)
    low      the low bits of the boundaries, packed
    high     the high bits in unary: bit (high + i) is set for boundary i
    ones     a running count of ones for every 512 bits of `high`, 32 bits each: the select directory
    ids      16 or 32 bits each

The n + 1 boundaries take about 2 + log2(ids / documents) bits each; `EliasFano.select` reads any of them without
unpacking the rest.
"""


import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scenelake.scale import attach, new_table_path, settle

from .catalog import mapped, query, table, tidied, utf8

MAGIC, FILE_IDS, STRIDE = 0x544F4B_454631, 2 << 20, 512
SLICE, BLOCK = 4 << 20, 100                      # bytes of text whose words are numbered together, words learnt at once
END_ID = 2
_KEPT: dict[str, "WordTokens"] = {}
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint32)


class EliasFano:
    """A monotone sequence of boundaries, packed."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, bits: int, n: int):
        self.low, self.high, self.ones, self.bits, self.n = low, high, ones, bits, n

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        v, n = np.asarray(values, np.int64), len(values)
        bits = max(0, int(v[-1] // n).bit_length() - 1) if n else 0
        low = np.packbits((v[:, None] >> np.arange(bits) & 1).astype(np.uint8).ravel(), bitorder="little")
        flags = np.zeros((int(v[-1] >> bits) + n if n else 0), np.uint8)
        flags[(v >> bits) + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little")
        return cls(low, high, cls.directory(high), bits, n)

    @staticmethod
    def directory(high: np.ndarray) -> np.ndarray:
        """Ones before each stretch of 512 bits."""
        counts = np.add.reduceat(_ONES[high], np.arange(0, len(high), STRIDE // 8)) if len(high) else np.zeros(0, np.uint32)
        return np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32)

    def select(self, i) -> np.ndarray:
        """The boundaries of the given numbers."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        block = np.searchsorted(self.ones, i, side="right") - 1
        out = np.empty(len(i), np.int64)
        for b in np.unique(block):
            at = block == b
            ones = np.flatnonzero(np.unpackbits(self.high[b * STRIDE // 8:(b + 1) * STRIDE // 8], bitorder="little"))
            out[at] = (b * STRIDE + ones[i[at] - self.ones[b]] - i[at]) << self.bits
        where = i[:, None] * self.bits + np.arange(self.bits)
        low = self.low[where >> 3] >> (where & 7).astype(np.uint8) & 1
        return out | (low.astype(np.int64) << np.arange(self.bits)).sum(1)


def _aligned(part: bytes) -> bytes:
    return part + bytes(-len(part) % 8)


def encode_file(doc_ids: list, ids: list[bytes], wide: bool) -> bytes:
    """One file from ids given as little-endian 32-bit numbers."""
    stops = np.cumsum([0, *(len(x) // 4 for x in ids)])
    ef, flat = EliasFano.of(stops), np.frombuffer(b"".join(ids), "<u4")
    nulls = sum(x is None for x in doc_ids)
    head = np.array([MAGIC, len(ids), stops[-1], 4 if wide else 2, ef.bits, len(ef.low), len(ef.high), nulls], "<i8")
    parts = [head, np.array([x or 0 for x in doc_ids], "<i8"), ef.low, ef.high, ef.ones.astype("<u4"), flat if wide else flat.astype("<u2")]
    return b"".join(_aligned(p.tobytes()) for p in parts)


class TokenFile:
    """Reads a file: `ids(i)` gives the ids of document i of the file."""

    def __init__(self, data):
        head = np.frombuffer(data, "<i8", 8)
        if head[0] != MAGIC:
            raise ValueError("not a token-id file")
        self.n, self.total, width, bits, low, high, self.nulls = (int(x) for x in head[1:])
        at = 64

        def part(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes + -out.nbytes % 8
            return out
        self.doc_ids = part("<i8", self.n)
        lo, hi = part("u1", low), part("u1", high)
        self.bounds = EliasFano(lo, hi, part("<u4", -(-high // (STRIDE // 8)) + 1), bits, self.n + 1)
        self.flat = part(f"<u{width}", self.total)

    def ids(self, i: int) -> np.ndarray:
        lo, hi = self.bounds.select([i, i + 1])
        return self.flat[lo:hi]


_SIMPLE = re.compile("[!-~ß-öø-ɏ]+")             # signs and letters that the tokenizer's normal form leaves alone
_LETTERS = re.compile("[a-zß-öø-ɏ]+")
_ENDING = re.compile(rb"([a-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]+)")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ɏ]+|[0-9]|[^\\sa-z0-9ß-öø-ɏ]+")   # its borders within these


class WordTokens:
    """Ids of whole texts by way of their words.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words one after another,
    and a word that comes up again is looked up. Arrow splits texts and numbers the distinct words of many, each of which is
    looked up once; their ids are then laid out by these numbers. New words are encoded many at a time and told apart by how many pieces each
    has at the tokenizer's own borders; words of ASCII letters are one piece that its normal form leaves alone, and go to its model
    as they are. A word with anything but ASCII signs and letters up to U+024F is encoded by itself,
    and so is a text with a special token in it.
    Words kept are two generations of about `keep`: when the present one is full it becomes the older one, from which
    words in use are taken over, and what wasn't used again is forgotten with the next change.
    """

    def __init__(self, path: str, keep: int = 225_000):
        from tokenizers import Tokenizer, pre_tokenizers
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok, self.keep, self.known = Tokenizer.from_file(path), keep, {}
        self.pieces = Tokenizer(self.tok.model)
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.older: dict[bytes, bytes] = {}
        vocab = self.tok.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]

    @classmethod
    def of(cls, path: str) -> "WordTokens":
        """One for all tasks of a worker."""
        if path not in _KEPT:
            _KEPT.clear()
            _KEPT[path] = cls(path)
        return _KEPT[path]

    def _pack(self, ids) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return self._pack(self.tok.encode(text, add_special_tokens=False).ids)

    def _unknown(self, words: set[bytes]) -> set[bytes]:
        """Those of `words` that must be learnt; what only the older generation knows goes on into the present one."""
        new = words.difference(self.known)
        back = new.intersection(self.older)
        self.known.update(zip(back, map(self.older.__getitem__, back)))
        return new - back

    def _learn(self, words: list[bytes]) -> None:
        """New words. One of letters with signs behind it is known by its letters and its signs, which others share."""
        known, need, parts = self.known, set(), []
        for w in words:
            m = None if w.isalpha() else _ENDING.fullmatch(w)
            if m and (m[1].isalpha() or _LETTERS.fullmatch(m[1].decode(errors="replace"))):
                parts.append((w, m[1], m[2]))
                need.add(m[1])
                need.add(m[2])
            else:
                need.add(w)
        need = self._unknown(need)
        plain, rest = [w for w in need if w.isalpha()], [w for w in need if not w.isalpha()]     # ASCII letters only, as these are bytes
        for lo in range(0, len(plain), BLOCK):
            some = plain[lo:lo + BLOCK]
            self._learn_block(self.pieces, some, b" ".join(some).decode(), np.ones(len(some), np.int64))
        for lo in range(0, len(rest), BLOCK):
            some, text, pieces = [], [], []
            for w in rest[lo:lo + BLOCK]:
                s, n = w.decode(errors="replace"), 1
                if not _LETTERS.fullmatch(s):
                    low = s if s.isascii() else s.lower()
                    if not _SIMPLE.fullmatch(low):
                        known[w] = self.whole(s)
                        continue
                    n = len(_SPLIT.findall(low))
                some.append(w)
                text.append(s)
                pieces.append(n)
            self._learn_block(self.tok, some, " ".join(text), np.array(pieces, np.int64))
        for w, letters, signs in parts:
            known[w] = known[letters] + known[signs]

    def _learn_block(self, tok, words: list[bytes], text: str, pieces: np.ndarray) -> None:
        """`text` is the words with spaces between, each of which has so many pieces."""
        if not words:
            return
        ids, last = np.asarray(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4"), np.cumsum(pieces)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == last[-1] and ends[-1] == len(ids):
            stops, flat = (4 * ends[last - 1]).tolist(), ids.tobytes()
            self.known.update(zip(words, map(flat.__getitem__, map(slice, [0, *stops], stops))))
        else:
            self.known.update((w, self.whole(w.decode(errors="replace"))) for w in words)

    def encode(self, texts: list[bytes] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        if len(self.known) > self.keep:
            self.older, self.known = self.known, {}
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        rows = texts.cast(pa.string(), safe=False)         # bytes as they are: case and white space are ASCII's
        marked = {i: t for i in np.flatnonzero(pc.match_substring(rows, "<|")).tolist() if any(s in (t := texts[i].as_py()) for s in self.special)}
        if marked:
            rows = pc.if_else(pa.array(np.isin(np.arange(len(rows)), list(marked))), "", rows)
        split = pc.ascii_split_whitespace(pc.ascii_lower(rows))
        coded = split.flatten().dictionary_encode()
        words = _pieces(coded.dictionary.cast(pa.binary()))
        self.known[b""] = b""                              # before leading and after trailing white space
        self._learn(list(self._unknown(set(words))))
        laid = pa.array(list(map(self.known.__getitem__, words)), pa.large_binary()).take(coded.indices)
        word_at = split.offsets.to_numpy()
        out = _pieces(laid, word_at - word_at[0])
        for i, t in marked.items():
            out[i] = self.whole(t.decode(errors="replace"))
        return out


def _pieces(values: pa.Array, at: np.ndarray | None = None) -> list[bytes]:
    """The values of a binary array, or their runs between places `at`."""
    _, offsets, data = values.buffers()
    stops = np.frombuffer(offsets, "<i8" if pa.types.is_large_binary(values.type) else "<i4")[values.offset:values.offset + len(values) + 1] if offsets else np.zeros(1, "<i8")
    stops = (stops if at is None else stops[at]).tolist()
    data = memoryview(data or b"")
    return [bytes(data[lo:hi]) for lo, hi in zip(stops, stops[1:])]


def _slices(texts: pa.Array, size: int = SLICE) -> list[tuple[int, int]]:
    """Consecutive rows of about `size` bytes, at least one each."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    if not len(ends):
        return []
    cuts = np.unique(np.searchsorted(ends, np.arange(size, int(ends[-1]) + size, size)) + 1)
    stops = [0, *(int(c) for c in cuts if c < len(ends)), len(ends)]
    return list(zip(stops, stops[1:]))


def _writer(folder: str, tokenizer: str, end_id: int, file_ids: int):
    def run(batches):
        from pyarrow import fs as pafs
        from pyspark import TaskContext
        enc, (fs, root), wide = WordTokens.of(tokenizer), pafs.FileSystem.from_uri(folder), False
        wide = enc.tok.get_vocab_size() > 65_536 or end_id > 65_535
        task, seq = TaskContext.get(), 0
        end, doc_ids, ids, held = np.array([end_id], "<u4").tobytes(), [], [], 0

        def flush():
            """A file appears under its name when it is whole; another attempt of the task writes the same bytes."""
            nonlocal doc_ids, ids, held, seq
            name = f"ids-{task.partitionId():06d}-{seq:05d}.bin"
            draft = f"{root}/_draft-{name}-{task.taskAttemptId()}"
            with fs.open_output_stream(draft) as f:
                f.write(encode_file(doc_ids, ids, wide))
            fs.move(draft, f"{root}/{name}")
            out = pa.RecordBatch.from_pydict({"file": [name], "part": [task.partitionId()], "seq": [seq], "docs": [len(ids)], "ids": [held]},
                                             schema=pa.schema([("file", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))
            doc_ids, ids, held, seq = [], [], 0, seq + 1
            return out
        for b in batches:
            keys, texts = b.column("doc_id").to_pylist(), b.column("__utf8")
            for lo, hi in _slices(texts):
                for k, x in zip(keys[lo:hi], enc.encode(texts.slice(lo, hi - lo))):
                    doc_ids.append(k)
                    ids.append(x + end)
                    held += len(x) // 4 + 1
                    if held >= file_ids:
                        yield flush()
        if ids:
            yield flush()
    return run


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID, file_ids: int = FILE_IDS) -> tuple[str, DataFrame]:
    """Writes the ids of all texts in ascending order of doc_id; returns the folder and its manifest (file, part, seq, docs,
    ids, start: ids in files before this one).

    Null texts are empty: they hold the end id only. Null ids come first. Rows that share an id are ordered by a hash of
    their text; rows that agree in both are equal. Files have about `file_ids` ids; a longer document has its own file. An
    empty table gives no file. `tokenizer` is a path that every executor can read.
    """
    folder = folder or new_table_path(docs.sparkSession, "token-files")
    path = docs.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(docs.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    tie = F.xxhash64("__utf8")
    rows = docs.select("doc_id", utf8().alias("__utf8")).repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    files = settle(rows.mapInArrow(tidied(_writer(folder, tokenizer, end_id, file_ids)), "file string, part long, seq long, docs long, ids long"), "manifest")
    ahead = F.sum("ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    return folder, files.withColumn("start", F.coalesce(ahead, F.lit(0)))


def _reader():
    def step(batch):
        out = []
        for name, data in zip(batch.column("file").to_pylist(), batch.column("content")):
            f = TokenFile(data.as_buffer())
            stops = f.bounds.select(np.arange(f.n + 1)).tolist()
            for i, (key, lo, hi) in enumerate(zip(f.doc_ids.tolist(), stops, stops[1:])):
                out.append((name, None if i < f.nulls else key, lo, hi - lo, f.flat[lo:hi].astype("<u4").tobytes()))
        return [list(c) for c in zip(*out)] if out else [[]] * 5
    return step


def read_token_files(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian 32-bit numbers) from the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.bin").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    docs = mapped(named, _reader, "file string, doc_id long, at long, n_tokens long, ids binary")
    return attach(docs, manifest.select("file", F.col("start").alias("__start")), ["file"]).select("doc_id", (F.col("__start") + F.col("at")).alias("start"), "n_tokens", "ids")


def token_index(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes token files and reads them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder, manifest = write_token_files(docs, tokenizer)
    if not manifest.head(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def public_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_token_files")
def op3_token_files(spark, sf_dir):
    return token_index(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizer())
