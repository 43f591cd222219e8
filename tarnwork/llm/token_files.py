"""Documents as token ids in compressed binary files.

A file holds the ids of a run of documents in order of their id: a head (MAGIC, size of the vocabulary), blocks of the
range coder (number of ids, bytes of code, checksum, code), then the index of its documents (id, number of ids) and its
place. The runs of the files follow each other, so a document's start over all files is known from the files' totals,
one number per file.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat, rangecoder
from .common import open_at, partitions, scratch, text_of, written

MAGIC = b"TOKIDS1\n"
#: Words that a task remembers; they are cut at white space, over which neither merges nor normal forms reach.
REMEMBERED = 400_000
#: New words that the library gets as one text, and the word put behind those that are not of letters only.
TOGETHER, MARK = 200, "\x01"


class Numbers(dict):
    """Numbers words as they come; new ones are also listed in `fresh`."""

    def __init__(self):
        self.fresh = []

    def __missing__(self, word):
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


#: Kinds of normal forms and of cuts over which white space stands fast: no word meets another.
FORMS, CUTS = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Replace", "Sequence"}, {"Split", "ByteLevel", "Sequence"}


def independent(spec: dict) -> bool:
    """Whether a tokenizer of this description never joins what ASCII white space parts, whatever the text."""
    import regex

    def flat_(part, inner):
        return [] if part is None else [part, *[y for x in part.get(inner, []) for y in flat_(x, inner)]]

    forms, cuts = flat_(spec.get("normalizer"), "normalizers"), flat_(spec.get("pre_tokenizer"), "pretokenizers")
    if {x["type"] for x in forms} - FORMS or {x["type"] for x in cuts} - CUTS:
        return False
    if any(x["type"] == "Replace" and (x["pattern"].get("Regex") != r"\s+" or x["content"] != " ") for x in forms):
        return False
    if any(x["type"] == "ByteLevel" and (x["add_prefix_space"] or x["use_regex"]) for x in cuts):
        return False
    split = [x for x in cuts if x["type"] == "Split"]
    # only what the pattern finds is kept, and nothing that it finds holds a blank
    keeps = [x for x in split if x["behavior"] == "Removed" and x["invert"] and not any(regex.search(x["pattern"]["Regex"], f"{a}{b}{c}").end() > len(a) for a in ("a", "1", ".", "'s", "é") for b in " \t\n\r\x0b\x0c" for c in ("a", "1", ".", "'s", "é"))]
    return bool(keeps)


class WordCache:
    """Ids of texts by a tokenizer that never joins over ASCII white space; every distinct word is encoded once."""

    def __init__(self, tokenizer: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(tokenizer)
        sample = "Ab 's\tc1\n'\x0b\x0c\rx  ,yz ́e"
        same = self.lib.encode(sample, add_special_tokens=False).ids == [i for w in sample.split() for i in self.lib.encode(w, add_special_tokens=False).ids]
        if not same or not independent(json.loads(self.lib.to_str())):
            raise ValueError(f"{tokenizer}: words of this tokenizer are not independent")
        self.vocab = self.lib.get_vocab_size()
        mark = self.lib.encode(MARK, add_special_tokens=False).ids
        self.mark, self.last = np.zeros(self.vocab, bool), np.zeros(self.vocab, bool)
        self.mark[mark] = len(mark) == 1
        suffix, known = json.loads(self.lib.to_str())["model"].get("end_of_word_suffix"), self.lib.get_vocab()
        if suffix and sum(len(w) == len(suffix) + 1 and w.endswith(suffix) for w in known) >= 256:  # any last byte of a part has its id
            self.last[[i for w, i in known.items() if w.endswith(suffix)]] = True
        self.forget()

    def forget(self):
        self.known, self.ids, self.start, self.count = Numbers(), np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _of_words(self, words: list):
        """(ids, number of ids of each word). Words cost the library less as one text than one by one.

        Where a word ends there: letters only are one part of a text at least, so that as many ids that end a part as words are one for
        each; behind other words stands the mark. Where the numbers differ, each word is encoded by itself.
        """
        plain = np.fromiter(map(str.isalpha, words), bool, len(words))
        at, ids, lens = [], [], []
        for mine, between, ends in ((np.flatnonzero(plain), " ", self.last), (np.flatnonzero(~plain), f" {MARK} ", self.mark)):
            parts = [mine[k : k + TOGETHER] for k in range(0, len(mine), TOGETHER)]
            texts = [between.join([*(words[i] for i in part.tolist()), ""]) for part in parts]
            for part, x in zip(parts, self.lib.encode_batch_fast(texts, add_special_tokens=False) if ends.any() else [None] * len(parts)):
                every = np.array(x.ids if x else [], np.uint16)
                cut = np.flatnonzero(ends[every])
                if len(cut) != len(part):
                    got = [y.ids for y in self.lib.encode_batch_fast([words[i] for i in part.tolist()], add_special_tokens=False)]
                    lens.append(np.array([len(y) for y in got], np.int64))
                    every = np.array([i for y in got for i in y], np.uint16)
                elif ends is self.mark:
                    lens.append(np.diff(cut, prepend=-1) - 1)
                    every = every[~ends[every]]
                else:
                    lens.append(np.diff(cut, prepend=-1))
                at.append(part), ids.append(every)
        at, ids, lens = (np.concatenate(x) for x in (at, ids, lens))
        back = np.argsort(at)
        start = np.cumsum(lens) - lens
        return ids[flat.ragged(start[back], lens[back])], lens[back]

    def encode(self, data, offs, end_id: int):
        """(ids, number of ids of each text), each text with the end id."""
        if len(self.known) > REMEMBERED:
            self.forget()
        raw, words, sizes = data.tobytes(), [], []
        for a, e in zip(offs[:-1].tolist(), offs[1:].tolist()):
            own = raw[a:e].split()  # bytes split at ASCII white space only
            sizes.append(len(own))
            words += own
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.fresh:
            fresh, self.known.fresh = self.known.fresh, []
            ids, lens = self._of_words([w.decode() for w in fresh])
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(lens) - lens])
            self.count = np.concatenate([self.count, lens])
            self.ids = np.concatenate([self.ids, ids])
        sizes = np.array(sizes, np.int64)
        lens = self.count[index]
        body = self.ids[flat.ragged(self.start[index], lens)]
        total = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=total[1:])
        ends = np.cumsum(sizes)
        n = total[ends] - total[ends - sizes] + 1
        out = np.full(len(body) + len(n), end_id, np.uint16)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(n) - 1] = False
        out[inner] = body
        return out, n


class Writer:
    """Writes groups of blocks as they fill; close() adds the index."""

    def __init__(self, out, vocab: int):
        self.out, self.vocab, self.held, self.n, self.at = out, vocab, [], 0, 12
        self.docs, self.counts, self.total = [], [], 0
        out.write(MAGIC + struct.pack("<I", vocab))

    def add(self, doc_ids: list, ids, counts):
        self.docs += doc_ids
        self.counts.append(np.asarray(counts, np.int64))
        self.held.append(ids)
        self.n += len(ids)
        self.total += len(ids)
        group = rangecoder.BLOCK * rangecoder.LANES
        if self.n >= group:
            every = np.concatenate(self.held)
            for k in range(0, len(every) - group + 1, group):
                self._put(every[k : k + group])
            self.held = [every[len(every) // group * group :].copy()]
            self.n = len(self.held[0])

    def _put(self, ids):
        for n, crc, code in rangecoder.encode(ids, self.vocab):
            self.at += self.out.write(struct.pack("<III", n, len(code), crc) + code)

    def close(self):
        if self.n:
            self._put(np.concatenate(self.held))
        self.out.write(struct.pack("<III", 0, 0, 0))
        null = np.array([d is None for d in self.docs], np.uint8)
        keys = np.array([d or 0 for d in self.docs], "<i8")
        counts = np.concatenate([np.zeros(0, np.int64), *self.counts]).astype("<i8")
        index = zlib.compress(null.tobytes() + keys.tobytes() + counts.tobytes(), 6)
        self.out.write(index + struct.pack("<QIQ", len(self.docs), zlib.crc32(index), len(index)))
        self.out.close()


def read_file(src, size: int):
    """(doc ids, numbers of ids, iterator over arrays of ids) of a file of `size` bytes."""
    src.seek(size - 20)
    n, crc, length = struct.unpack("<QIQ", src.read(20))
    src.seek(size - 20 - length)
    index = src.read(length)
    if zlib.crc32(index) != crc:
        raise ValueError("the index differs from its checksum")
    index = zlib.decompress(index)
    null = np.frombuffer(index, np.uint8, n)
    keys, counts = np.frombuffer(index, "<i8", n, n), np.frombuffer(index, "<i8", n, 9 * n)
    src.seek(0)
    head = src.read(12)
    if head[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    vocab = struct.unpack("<I", head[8:])[0]

    def groups():
        blocks = []
        while True:
            m, length, crc = struct.unpack("<III", src.read(12))
            if m:
                blocks.append((m, crc, src.read(length)))
            if blocks and (not m or len(blocks) == rangecoder.LANES):
                yield rangecoder.decode(blocks, vocab)
                blocks = []
            if not m:
                return

    return [None if z else k for z, k in zip(null.tolist(), keys.tolist())], counts, groups()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files; returns the manifest: path, bytes, docs, tokens, start (ids of all files before).

    Ids of the whole text by the tokenizers library without special tokens, then end_id; a null text counts as empty
    and has the end id only. Documents are in ascending order of id (a whole number), null ids last; documents that share an
    id are in order of a hash of their text. An empty table gives no file. Other columns are ignored. A task that runs
    twice leaves a second file; only those of the manifest count.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), "tie"]
    rows = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")

    @flat.trimmed
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        path, writer, cache, size = f"{folder}/{uuid.uuid4().hex}.ids", None, None, 0
        for b in batches:
            if b.num_rows and writer is None:
                cache = WordCache(tokenizer)
                writer = Writer(open_at(path, "wb"), cache.vocab)
            data, offs = flat.buffers(b.column(1))
            for a, e in flat.pieces(offs):
                ids, n = cache.encode(data[offs[a] : offs[e]], offs[a : e + 1] - offs[a], end_id)
                writer.add(b.column(0).slice(a, e - a).to_pylist(), ids, n)
        if writer is not None:
            writer.close()
            with open_at(path, "rb") as f:
                size = f.seek(0, 2) or f.tell()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [path], "bytes": [size], "docs": [len(writer.docs)], "tokens": [writer.total]})

    spark.range(0).write.parquet(f"{folder}/empty")  # makes the folder wherever it is
    files = written(rows.mapInArrow(run, "part long, path string, bytes long, docs long, tokens long"), "token-files").orderBy("part").collect()
    start, out = 0, []  # one row per file, as many as partitions
    for f in files:
        out.append((f["path"], f["bytes"], f["docs"], f["tokens"], start))
        start += f["tokens"]
    return spark.createDataFrame(out, "path string, bytes long, docs long, tokens long, start long")


def read_tokens(manifest: DataFrame, keep: bool = True) -> DataFrame:
    """The documents of the files: doc_id, start, n_tokens, ids_crc32 and, with `keep`, ids."""

    @flat.trimmed
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, size, total, start in zip(*(b.column(c).to_pylist() for c in ("path", "bytes", "tokens", "start"))):
                with open_at(path, "rb") as src:
                    docs, counts, groups = read_file(src, size)
                    if counts.sum() != total:
                        raise ValueError(f"{path}: the index differs from the manifest")
                    starts = start + np.cumsum(counts) - counts
                    have, k, rows = np.zeros(0, np.uint16), 0, []
                    for part in groups:
                        have = np.concatenate([have, part])
                        ends = np.cumsum(counts[k:])
                        full = int(np.searchsorted(ends, len(have), "right"))
                        raw, at = memoryview(have.astype("<u4")).cast("B"), 0
                        for j in range(k, k + full):
                            n = int(counts[j])
                            rows.append((docs[j], int(starts[j]), n, zlib.crc32(raw[4 * at : 4 * (at + n)]), *([have[at : at + n].astype(np.int32)] if keep else [])))
                            at += n
                        have, k = have[at:], k + full
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows = []
                    if k != len(docs) or len(have):
                        raise ValueError(f"{path}: ids do not add up to its documents")

    import pyarrow as pa

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if keep else [])]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep else "")
    files = manifest.count()
    return manifest.repartition(max(1, files)).mapInArrow(run, out)


def token_folder(spark) -> str:
    return scratch(spark, "tokens")
