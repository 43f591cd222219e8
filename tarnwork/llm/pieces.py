"""SentencePiece BPE by vectorised merge rounds.

Words (a run of spaces and what follows it) never share a piece, so a batch is cut into words and each distinct word is
encoded once; a word is cut further between characters that no piece holds side by side. The symbols of all new words lie in one
flat array. A round takes the minimum rank per word (segmented) and merges all pairs of that rank at once, of all words, from
the left and without overlap; then the array is compacted, until no word has a pair left. The library merges one pair at
a time, so a word's merges of a round end behind the first one whose new neighbours form a pair of the same or a lower
rank: that pair comes first there. Ids equal the library's for words of any length.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat

MARK = "▁"
TOKEN = re.compile(r" *[^ \n]+|\n| +")
#: Distinct words that a task remembers.
REMEMBERED = 400_000
#: Characters that normal forms change: a model that changes any is refused.
CHANGED = "ﬁ①Ａ　ｶﾞΩé e\u0301\xa0\u200b\t\r½"
NONE = np.int64(2**62)


class Pieces:
    """A model's pieces and the pairs that merge into them."""

    def __init__(self, model: str):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.size = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        normal = {t: i for i, t in enumerate(text) if not special[i]}
        # what the method stands on; a model for which it fails needs another way
        if any(sp.is_unused(i) for i in range(n)) or any(c not in normal for t in normal for c in t) or any(re.search(f"[^{MARK}]{MARK}|\n", t) for t in normal):
            raise ValueError(f"{model}: words of this model are not independent")
        if not sp.encode(" ") or sp.encode("a b", out_type=str)[0][0] != MARK or sp.encode("a  ") == sp.encode("a"):
            raise ValueError(f"{model}: expected a dummy prefix and kept white space")
        if sp.decode(sp.encode(CHANGED)) != CHANGED:
            raise ValueError(f"{model}: expected a model that leaves characters as they are")
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.chars = np.full(0x110000, -1, np.int64)
        for t, i in normal.items():
            if len(t) == 1:
                self.chars[ord(t)] = i
        lost = np.flatnonzero(self.chars < 0)
        self.chars[lost] = n + lost  # unknown characters are symbols that no pair has
        ranks = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal.values()}, reverse=True))}
        pairs, beside = {}, set()
        for t, m in normal.items():
            for k in range(1, len(t)):
                a, b = normal.get(t[:k]), normal.get(t[k:])
                beside.add(normal[t[k - 1]] * n + normal[t[k]])
                if a is not None and b is not None:
                    pairs[a * n + b] = (ranks[sp.get_score(m)], m)
        self._table(pairs)
        self.beside = np.array(sorted(beside) + [2**62], np.int64)
        raw = [b"" if sp.is_control(i) else bytes([int(text[i][3:5], 16)]) if sp.is_byte(i) else sp.decode([i]).encode() if sp.is_unknown(i) else text[i].replace(MARK, " ").encode() for i in range(n)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(r) for r in raw])
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.silent = np.array([sp.is_control(i) for i in range(n)])
        self.spaced = np.array([not special[i] and text[i][0] == MARK for i in range(n)])

    def _table(self, pairs: dict):
        """Open addressing: the pair, its rank and what it merges into."""
        keys = np.array(list(pairs), np.int64)
        values = np.array(list(pairs.values()), np.int64)
        self.shift = np.uint64(64 - max(4, int(len(keys) * 4).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.rank, self.into = np.full(size, -1, np.int64), np.full(size, NONE, np.int64), np.zeros(size, np.int64)
        slot = self._slot(keys)
        for k, s, (r, m) in zip(keys.tolist(), slot.tolist(), values.tolist()):
            while self.keys[s] >= 0:
                s = (s + 1) & (size - 1)
            self.keys[s], self.rank[s], self.into[s] = k, r, m

    def _slot(self, keys):
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * flat.BASE) >> self.shift).astype(np.int64)

    def lookup(self, left, right):
        """Rank (NONE if they don't merge) and result of pairs of symbols."""
        key = left * self.size + right
        slot = self._slot(key)
        there = self.keys[slot]
        rank, into = self.rank[slot], self.into[slot]
        miss = np.flatnonzero((there != key) & (there >= 0))
        gone = (there != key) | (left >= self.size) | (right >= self.size)
        while len(miss):
            slot[miss] = (slot[miss] + 1) & (len(self.keys) - 1)
            there = self.keys[slot[miss]]
            hit = there == key[miss]
            at = miss[hit]
            rank[at], into[at], gone[at] = self.rank[slot[at]], self.into[slot[at]], (left[at] >= self.size) | (right[at] >= self.size)
            miss = miss[~hit & (there >= 0)]
        rank[gone] = NONE
        return rank, into

    def parts(self, sym, lens):
        """(lens of the parts of words between which no piece can lie, number of parts of each word)."""
        ends = np.cumsum(lens) - 1
        code = sym[:-1] * self.size + sym[1:]
        cut = np.ones(len(sym), bool)
        cut[:-1] = self.beside[np.searchsorted(self.beside, code)] != code
        cut[:-1] |= (sym[:-1] >= self.size) | (sym[1:] >= self.size)
        cut[ends] = True
        at = np.flatnonzero(cut)
        upto = np.searchsorted(at, ends, "right")
        return np.diff(at, prepend=-1), np.diff(upto, prepend=0)

    def merged(self, sym, lens):
        """Merge rounds over the words of `lens` symbols in sym -> (symbols, lens) in the same order."""
        if not len(sym):
            return sym, lens
        lens, n_parts = self.parts(sym, lens)
        words = np.arange(len(lens))
        done_w, done_len, done_sym = [], [], []
        starts = np.cumsum(lens) - lens
        rank, into = np.full(len(sym), NONE, np.int64), np.zeros(len(sym), np.int64)
        rank[:-1], into[:-1] = self.lookup(sym[:-1], sym[1:])
        rank[starts + lens - 1] = NONE
        while len(words):
            low = np.minimum.reduceat(rank, starts)
            live = low < NONE
            if not live.all():
                out = np.repeat(~live, lens)
                done_w.append(words[~live]), done_len.append(lens[~live]), done_sym.append(sym[out])
                if not live.any():
                    break
                sym, rank, into = sym[~out], rank[~out], into[~out]
                words, lens, low = words[live], lens[live], low[live]
                starts = np.cumsum(lens) - lens
            of = np.repeat(np.arange(len(lens)), lens)
            at = np.flatnonzero(rank == low[of])
            # of pairs that overlap, every other one from the left
            near = at[1:] == at[:-1] + 1
            if near.any():
                k = np.arange(len(at))
                begin = np.concatenate([[0], np.where(near, 0, k[1:])])
                at = at[(k - np.maximum.accumulate(begin)) % 2 == 0]
            word = of[at]
            if len(at) > len(lens):  # some words have several
                several = np.flatnonzero(np.bincount(word, minlength=len(lens))[word] > 1)
                ok = np.ones(len(at), bool)
                ok[several] = self._first(sym, into, at[several], word[several], starts, lens, low)
                at, word = at[ok], word[ok]
            sym[at] = into[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, rank, into = sym[keep], rank[keep], into[keep]
            lens = lens - np.bincount(word, minlength=len(lens))
            starts = np.cumsum(lens) - lens
            at -= np.arange(len(at))
            rank[at] = NONE
            q = np.concatenate([at[at < (starts + lens - 1)[word]], at[at > starts[word]] - 1])
            rank[q], into[q] = self.lookup(sym[q], sym[q + 1])
        w, n, s = np.concatenate(done_w), np.concatenate(done_len), np.concatenate(done_sym)
        order = np.argsort(w)
        s, n = s[flat.ragged((np.cumsum(n) - n)[order], n[order])], n[order]
        return s, np.add.reduceat(n, np.cumsum(n_parts) - n_parts)

    def _first(self, sym, into, at, word, starts, lens, low):
        """Which of the merges at `at` the library makes before any pair that they form anew."""
        left, right = at > starts[word], at + 2 < (starts + lens)[word]
        # the symbol to the left may be one that the merge before has made
        before = sym[np.maximum(at - 1, 0)]
        joined = np.zeros(len(at), bool)
        joined[1:] = (at[1:] == at[:-1] + 2) & (word[1:] == word[:-1])
        before[1:] = np.where(joined[1:], into[at[:-1]], before[1:])
        least = np.full(len(at), NONE)
        least[left] = self.lookup(before[left], into[at[left]])[0]
        least[right] = np.minimum(least[right], self.lookup(into[at[right]], sym[at[right] + 2])[0])
        stop = least <= low[word]
        seen = np.cumsum(stop) - stop
        first = np.ones(len(at), bool)
        first[1:] = word[1:] != word[:-1]
        return seen == np.maximum.accumulate(np.where(first, seen, 0))

    def encode_words(self, words: list[str]):
        """(ids, number of ids of each word)."""
        text = "".join(words).replace(" ", MARK)
        sym = self.chars[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        lens = np.array([len(w) for w in words], np.int64)
        sym, lens = self.merged(sym, lens)
        odd = np.flatnonzero(sym >= self.size)
        if not len(odd):
            return sym, lens
        # an unknown character becomes the bytes of its UTF-8 form
        spelt = [list(chr(c - self.size).encode()) for c in sym[odd].tolist()]
        size = np.ones(len(sym), np.int64)
        size[odd] = [len(x) for x in spelt]
        owner = np.repeat(np.arange(len(lens)), lens)
        out = np.repeat(sym, size)
        at = np.cumsum(size) - size
        out[flat.ragged(at[odd], size[odd])] = self.byte[[b for x in spelt for b in x]]
        return out, np.bincount(owner, weights=size, minlength=len(lens)).astype(np.int64)


class Encoder:
    """Encodes texts; remembers the words it has met, up to REMEMBERED."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.forget()

    def forget(self):
        self.known, self.ids, self.start, self.count = {}, np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]):
        """(ids with begin and end ids, number of ids of each text)."""
        p = self.pieces
        if len(self.known) > REMEMBERED:
            self.forget()
        known, fresh, index, sizes = self.known, [], [], []
        for t in texts:
            tokens = TOKEN.findall(" " + t.replace(MARK, " ")) if t else []
            sizes.append(len(tokens))
            for w in tokens:
                k = known.get(w)
                if k is None:
                    k = known[w] = len(known)
                    fresh.append(w)
                index.append(k)
        if fresh:
            ids, lens = p.encode_words(fresh)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(lens) - lens])
            self.count = np.concatenate([self.count, lens])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        index, sizes = np.array(index, np.int64), np.array(sizes, np.int64)
        lens = self.count[index]
        body = self.ids[flat.ragged(self.start[index], lens)]
        total = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=total[1:])
        ends = np.cumsum(sizes)
        n = total[ends] - total[ends - sizes]
        out = np.empty(len(body) + 2 * len(n), np.uint32)
        first = np.cumsum(n + 2) - (n + 2)
        inner = np.ones(len(out), bool)
        inner[first] = inner[first + n + 1] = False
        out[inner], out[first], out[first + n + 1] = body, p.bos, p.eos
        return out, n + 2

    def decode(self, ids, lens) -> list[str]:
        """The text of each run of ids."""
        p = self.pieces
        n = p.raw_len[ids]
        data = p.raw[flat.ragged(p.raw_at[ids], n)].tobytes()
        cut = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(n, out=cut[1:])
        ends = np.cumsum(lens)
        out = []
        for a, e in zip((ends - lens).tolist(), ends.tolist()):
            first = a
            while first < e and p.silent[ids[first]]:
                first += 1
            skip = int(first < e and p.spaced[ids[first]])
            try:
                out.append(data[cut[a] + skip : cut[e]].decode())
            except UnicodeDecodeError:  # ids that spell no text: the library marks each such byte
                out.append(p.lib.decode(ids[a:e].tolist()))
        return out


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, with `keep`, ids and decoded.

    ids: begin id, the pieces of the whole text, end id; a null text counts as empty and has the two ids only. Null ids and
    repeated rows each get their row; an empty table gives an empty result; other columns are ignored. A text of any length is
    encoded whole, by its distinct words. Every executor must see the file `model`.
    """

    @flat.trimmed
    def run(batches):
        import hashlib

        import pyarrow as pa

        encoder = Encoder(Pieces(model))
        for b in batches:
            key, data, offs = b.column(0), *flat.buffers(b.column(1))
            for a, e in flat.pieces(offs, 1_000_000):
                raw = data[offs[a] : offs[e]].tobytes()
                o = (offs[a : e + 1] - offs[a]).tolist()
                ids, n = encoder.encode([raw[s:t].decode() for s, t in zip(o, o[1:])])
                decoded = encoder.decode(ids, n)
                ends = np.cumsum(n)
                view = memoryview(ids.astype("<u4")).cast("B")
                sums = [hashlib.sha256(view[4 * s : 4 * t]).hexdigest() for s, t in zip((ends - n).tolist(), ends.tolist())]
                cols = [key.slice(a, e - a), pa.array(n), pa.array(sums), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded])]
                if keep:
                    cols += [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep else [])]
    out = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, out)
