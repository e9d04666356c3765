"""Byte-level BPE ids by the tokenizers library, with a bounded cache of words kept by each Python worker.

Byte-level BPE never merges across its pre-tokens, so a text's ids are those of its pre-tokens in a row. Most words of a corpus recur: each
worker keeps the ids of those it has met and asks the library's model only for new ones, pre-token by pre-token. The split into pre-tokens is
made here; each character that occurs is held once against the library's own split, and words with one that the two class differently are
encoded whole by the library, as are texts whose spaces do not part the pre-tokens (two spaces in a row) and texts with a special token's
string.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tarnflow.llm.common import held, uncollected

#: Entries of a worker's cache of words; over that it starts afresh. What is met for the first time stays outside.
CACHE_WORDS = 1_000_000
#: Entries of a worker's cache of two generations, without one round's new ones.
RECENT_WORDS = 800_000
#: Characters of the texts, one text at least, whose words are looked up in one round.
ROUND_CHARS = 4_000_000
#: Characters of one call of the library for whole texts.
CALL_CHARS = 200_000
_FIXED = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Where the split at single spaces doesn't hold: runs of spaces, separators that Python counts as white space and Unicode doesn't, and the
#: character that marks a text's first word here.
_WHOLE = ("  ", "\0", "\x1c", "\x1d", "\x1e", "\x1f")
#: Marks that are a pre-token of their own where a chunk ends with them, after an ASCII letter or digit.
_MARKS = ".,;:!?"
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True


def _byte_letters() -> np.ndarray:
    """The letters that stand for bytes in a byte-level vocabulary, as 16-bit code points; \\0 stays, as it parts the words here."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = np.arange(256, dtype="<u2")
    rest = np.setdiff1d(letters, own)
    letters[rest] = 256 + np.arange(len(rest))
    letters[0] = 0
    return letters


_LETTERS = _byte_letters()


def words_of(path: str) -> "Words":
    """This worker's encoder for the file."""
    return held(("words", path), lambda: Words(path))


class Met:
    """A bounded cache that takes in what is met for the second time: words that occur once never crowd it."""

    def __init__(self, most: int = CACHE_WORDS):
        self.most, self.kept, self.met = most, {}, bytearray(1 << 22)

    def learn(self, found: dict) -> None:
        if len(self.kept) > self.most:
            self.kept.clear()
            self.met = bytearray(len(self.met))
        met, mask, kept = self.met, len(self.met) - 1, self.kept
        for c, value in found.items():
            at = hash(c) & mask
            if met[at]:
                kept[c] = value
            else:
                met[at] = 1


class Recent:
    """A bounded cache of two generations: when the young one is full it becomes the old one, and what isn't asked for again until the next
    change is forgotten."""

    def __init__(self, most: int = RECENT_WORDS):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys) -> set:
        """Those of keys that aren't known. The others are in the young generation until the next call."""
        if 2 * len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = {k for k in keys if k not in young}
        again = [k for k in new if k in old]
        young.update(zip(again, map(old.__getitem__, again)))  # noqa: B905
        return new.difference(again) if again else new

    def values(self, keys: list) -> list:
        """What is known of each of keys, None for the others. All known ones are in the young generation until the next call."""
        if 2 * len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = list(map(young.get, keys))
        for i in [i for i, v in enumerate(out) if v is None]:
            if (v := old.get(keys[i])) is not None:
                young[keys[i]] = out[i] = v
        return out


def _parted(chunks: pa.LargeStringArray) -> tuple[pa.LargeStringArray, pa.LargeStringArray]:
    """(chunks without their last marks, these marks; empty where there are none, or none that are a
    pre-token of their own)."""
    data, ends = np.frombuffer(chunks.buffers()[2] or b"", np.uint8), np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
    size = pc.binary_length(pc.ascii_rtrim(chunks, _MARKS)).to_numpy()
    cut = ends[:-1] + size
    apart = (cut < ends[1:]) & (size > 0)
    apart[apart] = _ALNUM[data[cut[apart] - 1]]
    cut = np.where(apart, cut, ends[1:])
    edges = np.zeros(len(data) + 1, np.int8)
    edges[cut[apart]], edges[ends[1:][apart]] = 1, -1
    inside = np.cumsum(edges[:-1], dtype=np.int8).view(bool)

    def part(mask: np.ndarray, lengths: np.ndarray) -> pa.LargeStringArray:
        return pa.LargeStringArray.from_buffers(len(chunks), pa.py_buffer(np.append(0, np.cumsum(lengths))), pa.py_buffer(data[mask]))

    return part(~inside, cut - ends[:-1]), part(inside, ends[1:] - cut)


class Words:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.apart = [*_WHOLE, *[t.content for t in self.tokenizer.get_added_tokens_decoder().values()]]
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.words = Recent()
        #: Characters held against the library's split, and those of them that it classes differently.
        self.seen, self.odd = {chr(c) for c in range(128)}, set()

    def _whole(self, texts: list[str]) -> list[bytes]:
        out, run, size = [], [], 0
        for k, text in enumerate(texts):
            run.append(text)
            size += len(text)
            if size >= CALL_CHARS or k == len(texts) - 1:
                out += [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(run, add_special_tokens=False)]
                run, size = [], 0
        return out

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of pre-tokens, by the library's model."""
        if not pieces:
            return []
        tokenize, flat, ends = self.model.tokenize, [], [0]
        joined = _LETTERS[np.frombuffer("\0".join(pieces).encode(), np.uint8)].tobytes().decode("utf-16-le")
        for piece in joined.split("\0"):
            flat += [t.id for t in tokenize(piece)]
            ends.append(len(flat))
        raw, step = np.array(flat, self.dtype).tobytes(), self.dtype.itemsize
        return [raw[step * b : step * e] for b, e in zip(ends[:-1], ends[1:], strict=True)]

    def _odd_in(self, chunks: set[str]) -> list[str]:
        """The chunks with a character that the library's split classes differently than _FIXED."""
        for c in set("".join(chunks)).difference(self.seen):
            mine = "a" if c.isalpha() else "1" if c.isdecimal() else "?" if c.isalnum() else " " if c.isspace() else "-"
            alike = [x for x in "a1-" if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(x + c + x)) == 1]
            if (alike or [" "]) != [mine]:
                self.odd.add(c)
            self.seen.add(c)
        return [c for c in chunks if not self.odd.isdisjoint(c)] if self.odd else []

    def _learn(self, chunks: set[str]) -> None:
        """Take in chunks: what stands between two spaces, with the first of them; after the mark \\0, a text's first, or a pre-token without a
        space."""
        known = self.words.young
        odd = self._odd_in(chunks)
        known.update(zip(odd, self._whole([c[1:] if c[:1] == "\0" else " " + c for c in odd]), strict=True))
        sound = chunks.difference(odd) if odd else chunks
        plain = [c for c in sound if c.isalpha()]
        known.update(zip(plain, self._pieces([" " + c for c in plain]), strict=True))
        rest = {c: _FIXED.findall(c[1:] if c[:1] == "\0" else " " + c) for c in sound.difference(plain)}
        # Pieces that are a space and a word are known under that word, others under the mark and themselves.
        keys = {p: p[1:] if p[0] == " " else "\0" + p for p in set().union(*rest.values())}
        new = [p for p, k in keys.items() if k not in known]
        known.update(zip([keys[p] for p in new], self._pieces(new), strict=True))
        ids = {p: known[k] for p, k in keys.items()}
        for c, pieces in rest.items():
            known[c] = b"".join([ids[p] for p in pieces])

    @uncollected()
    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, equal to the library's."""
        whole = [k for k, t in enumerate(texts) if any([s in t for s in self.apart])]
        out: list = [None] * len(texts)
        for k, ids in zip(whole, self._whole([texts[k] for k in whole]), strict=True):
            out[k] = ids
        waiting: list[int] = []
        size = 0

        def settle() -> None:
            chunks = pc.split_pattern(pa.array([texts[k][1:] if texts[k][0] == " " else "\0" + texts[k] for k in waiting], pa.large_string()), " ")
            coded = chunks.flatten().dictionary_encode()
            stems, marks = (x.dictionary_encode() for x in _parted(coded.dictionary))
            keys = stems.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times as fast as to_pylist()
            n, keys = len(keys), keys + ["\0" + m for m in marks.dictionary.to_pylist() if m]
            found = self.words.values(keys)
            if new := [i for i, v in enumerate(found) if v is None]:
                self._learn({keys[i] for i in new})
                for i in new:
                    found[i] = self.words.young[keys[i]]
            after = iter(found[n:])
            first = pa.array(found[:n], pa.large_binary()).take(stems.indices)
            last = pa.array([next(after) if m else b"" for m in marks.dictionary.to_pylist()], pa.large_binary()).take(marks.indices)
            ids = pc.binary_join_element_wise(first, last, pa.scalar(b"", pa.large_binary())).take(coded.indices)
            ends = np.frombuffer(ids.buffers()[1], np.int64)[chunks.offsets.to_numpy()].tolist()
            raw = memoryview(ids.buffers()[2] or b"")
            for k, b, e in zip(waiting, ends[:-1], ends[1:], strict=True):
                out[k] = raw[b:e]
            waiting.clear()

        for k, text in enumerate(texts):
            if not text:
                out[k] = b""
            elif out[k] is None:
                waiting.append(k)
                size += len(text)
                if size >= ROUND_CHARS:
                    settle()
                    size = 0
        if waiting:
            settle()
        return [np.frombuffer(b, self.dtype) for b in out]
