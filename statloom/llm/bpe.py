"""Byte-level BPE in numpy: batched merge rounds over many words at once.

All words that a batch has not met before lie in one flat symbol array. Each round finds the rank of every adjacent pair by
binary search over the sorted pair keys, takes each word's lowest rank, joins that pair wherever the word has it, and drops
words that have no pair left. Words met before come from a bounded table of their ids.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

from statloom.llm.shingles import mix, place_weights

#: A random number for each byte, from which words are hashed.
BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
#: Unicode White_Space, as the pre-tokenizer's \\s has it.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Letters that an apostrophe takes with it.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")
#: Longer pre-tokens are merged one by one with a heap, in n log n steps.
LONG_WORD = 1024
#: Words after which the table of known words is emptied; text, in characters, that is worked on at once.
TABLE_WORDS, SLICE_CHARS = 1_000_000, 1_000_000


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point: OTHER, LETTER (L*), NUMBER (N*) or SPACE."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[SPACES] = SPACE
    return table


def pretoken_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which code points start a pre-token; ``first`` marks the first one of each text.

    A run of letters, of numbers or of other signs takes one blank before it. The last character of a run of spaces stands apart
    where a word follows. An apostrophe that no blank precedes takes an ending of SHORT_ENDINGS or LONG_ENDINGS with it.
    """
    kind = char_classes()[cp]
    n = len(cp)
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    before = np.zeros(n, bool)  # a space whose next character is of the same text and no space
    before[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start |= before
    joins = before[:-1] & (cp[:-1] == 0x20)
    start[1:][joins] = False
    quote = np.flatnonzero((cp == 0x27) & start)
    if len(quote):
        ends = np.r_[first, True, True, True]
        wide = np.r_[cp, 0, 0, 0]
        one = ~ends[quote + 1] & np.isin(wide[quote + 1], [ord(c) for c in SHORT_ENDINGS])
        two = ~one & ~ends[quote + 1] & ~ends[quote + 2] & np.isin(wide[quote + 1] * 256 + wide[quote + 2], [ord(a) * 256 + ord(b) for a, b in LONG_ENDINGS])
        two &= (wide[quote + 1] < 128) & (wide[quote + 2] < 128)
        start[quote[one] + 1] = False
        start[quote[two] + 1] = False
        after = np.r_[quote[one] + 2, quote[two] + 3]
        after = after[after < n]
        start[after] |= ~(before[after - 1] & (cp[after - 1] == 0x20))
    return start


def byte_letters() -> dict[str, int]:
    """The letter by which a vocabulary file writes each byte: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


def equal_runs(a: np.ndarray, a_at: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    """Whether each run of bytes of ``a``, given by its start and length, equals its run of ``b``."""
    same = a_len == b_len
    some = np.flatnonzero(same & (a_len > 0))
    if len(some):
        n = a_len[some]
        first = np.cumsum(n) - n
        step = np.arange(first[-1] + n[-1]) - np.repeat(first, n)
        same[some] = np.logical_and.reduceat(a[np.repeat(a_at[some], n) + step] == b[np.repeat(b_at[some], n) + step], first)
    return same


class Bpe:
    """A tokenizer file's encoder and decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = special
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.size = max([*vocab.values(), *special.values()]) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.joined = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.byte_id = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        self.pieces = [b""] * self.size
        for token, i in vocab.items():
            self.pieces[i] = bytes(letters[c] for c in token)
        for token, i in special.items():
            self.pieces[i] = token.encode()
        self.piece_len = np.array([len(p) for p in self.pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        self.weight = np.zeros(0, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of known words, ascending; then where their ids are
        self.known_at, self.known_len, self.known_ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.word_at, self.word_len, self.word_bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)  # and their bytes

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, len(joined) where there is none."""
        key = a * np.int64(self.size) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.joined))

    def _merge_long(self, word: np.ndarray) -> np.ndarray:
        """One word's ids: pairs joined by rank, then from the left, through a heap over a linked list."""
        ids, n, none = word.tolist(), len(word), len(self.joined)
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(int(r), i) for i, r in enumerate(self._rank(word[:-1], word[1:])) if r < none]
        heapq.heapify(heap)
        pair = lambda i, j: self.rank_of.get(ids[i] * self.size + ids[j], none)
        while heap:
            r, i = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] < 0 or j < 0 or pair(i, j) != r:
                continue
            ids[i], ids[j], nxt[i] = int(self.joined[r]), -1, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for a, b in ((prv[i], i), (i, nxt[i])):
                if a >= 0 and b >= 0 and (s := pair(a, b)) < none:
                    heapq.heappush(heap, (s, a))
        return np.array([x for x in ids if x >= 0], np.int32)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words, one after the other, and how many each word has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        count = size.copy()
        long = np.flatnonzero(size > LONG_WORD)
        at = np.cumsum(size) - size
        done_sym, done_word = [], []
        for w in long:
            ids = self._merge_long(sym[at[w] : at[w] + size[w]])
            count[w] = len(ids)
            done_sym.append(ids)
            done_word.append(np.full(len(ids), w))
        word = np.repeat(np.arange(len(words)), size)
        if len(long):
            short = ~np.isin(word, long)
            sym, word = sym[short], word[short]
        none = len(self.joined)
        rank = np.full(len(sym), none, np.int32)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self._rank(sym[inside], sym[inside + 1])
        while len(sym):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.r_[start, len(sym)]))
            live = low < none
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                sym, word, rank, low = sym[live], word[live], rank[live], low[live]
            hit = np.flatnonzero(rank == low)
            if not len(hit):
                break
            fresh = np.r_[True, np.diff(hit) != 1]
            if not fresh.all():  # aaa: from the left, every second one
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            sym[hit] = self.joined[low[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            now = np.cumsum(keep)[hit] - 1  # where the joined symbols are after the others have gone
            sym, word, rank = sym[keep], word[keep], rank[keep]
            touched = np.r_[now, now[now > 0] - 1]
            pair = touched[touched + 1 < len(sym)]
            rank[touched] = none
            pair = pair[word[pair] == word[pair + 1]]
            rank[pair] = self._rank(sym[pair], sym[pair + 1])
        if not done_sym:
            return np.zeros(0, np.int32), count
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of a few texts without special tokens."""
        chars = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = "".join(texts)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        if not len(cp):
            return np.zeros(0, np.int32), chars
        begin = np.cumsum(chars) - chars
        first = np.zeros(len(cp), bool)
        first[begin[chars > 0]] = True
        at = np.flatnonzero(pretoken_starts(cp, first))
        owner = np.searchsorted(at, np.r_[begin, len(cp)])  # words before each text
        raw = np.frombuffer(whole.encode(), np.uint8)
        if len(raw) != len(cp):
            size = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
            at = (np.cumsum(size) - size)[at]
        length = np.diff(np.r_[at, len(raw)])
        top = int(length.max())
        if top > len(self.weight):
            self.weight = place_weights(max(64, top))
        hashes = mix(np.add.reduceat(BYTE_HASH[raw] * self.weight[np.arange(len(raw)) - np.repeat(at, length)], at) + length.astype(np.uint64))
        unique, some, which = np.unique(hashes, return_index=True, return_inverse=True)
        #: Words that are long, or share a hash with another word, are encoded apart from the table.
        apart = (length > LONG_WORD) | ~equal_runs(raw, at, length, raw, at[some][which], length[some][which])
        if len(self.known) + len(unique) > TABLE_WORDS:
            self._forget()
        place = np.searchsorted(self.known, unique)
        there = np.zeros(len(unique), bool)
        if len(self.known):
            there = self.known[np.minimum(place, len(self.known) - 1)] == unique
            hit, word = np.flatnonzero(there), place[there]
            other = hit[~equal_runs(raw, at[some[hit]], length[some[hit]], self.word_bytes, self.word_at[word], self.word_len[word])]
            apart |= np.isin(which, other)
        new = np.flatnonzero(~there & ~apart[some])
        buffer = raw.tobytes()
        if len(new):
            a, n = at[some[new]], length[some[new]]
            words = [buffer[i:j] for i, j in zip(a.tolist(), (a + n).tolist())]
            ids, count = self.merge_words(words)
            for name, value in (("known_at", np.cumsum(count) - count + len(self.known_ids)), ("known_len", count), ("word_at", np.cumsum(n) - n + len(self.word_bytes)), ("word_len", n), ("known", unique[new])):
                setattr(self, name, np.insert(getattr(self, name), place[new], value))
            self.known_ids = np.concatenate([self.known_ids, ids])
            self.word_bytes = np.concatenate([self.word_bytes, np.frombuffer(b"".join(words), np.uint8)])
            place = np.searchsorted(self.known, unique)
        alone = np.flatnonzero(apart)
        pool, begin, n = self.known_ids, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        usual = np.flatnonzero(~apart)
        begin[usual], n[usual] = self.known_at[place[which[usual]]], self.known_len[place[which[usual]]]
        if len(alone):
            ids, count = self.merge_words([buffer[i:j] for i, j in zip(at[alone].tolist(), (at[alone] + length[alone]).tolist())])
            begin[alone], n[alone] = np.cumsum(count) - count + len(pool), count
            pool = np.concatenate([pool, ids])
        total = np.r_[0, np.cumsum(n)]
        return pool[np.repeat(begin - total[:-1], n) + np.arange(total[-1])], np.diff(total[owner])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts, one after the other, and how many each text has."""
        parts, owner = texts, None
        if self.special_split is not None and any(s in t for t in texts for s in self.special):
            split = [self.special_split.split(t) for t in texts]
            parts, owner = [p for s in split for p in s], np.repeat(np.arange(len(texts)), [len(s) for s in split])
        out, lengths, i = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while i < len(parts):
            if owner is not None and parts[i] in self.special:
                out.append(np.array([self.special[parts[i]]], np.int32))
                lengths.append(np.ones(1, np.int64))
                i += 1
                continue
            j, chars = i, 0
            while j < len(parts) and (j == i or chars + len(parts[j]) <= SLICE_CHARS) and (owner is None or parts[j] not in self.special):
                chars += len(parts[j])
                j += 1
            ids, n = self._slice(parts[i:j])
            out.append(ids)
            lengths.append(n)
            i = j
        n = np.concatenate(lengths)
        return np.concatenate(out), n if owner is None else np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        n = self.piece_len[ids]
        total = np.cumsum(n)
        if not len(ids):
            return b""
        return self.piece_bytes[np.repeat(self.piece_at[ids] - (total - n), n) + np.arange(total[-1])].tobytes()


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    """The tokenizer of a file, read once in each Python process."""
    return Bpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
