"""SentencePiece models on the tokenizers library: normaliser, metaspace marker, unigram scores or BPE merges, and byte fallback, rebuilt from
the model's protobuf; texts encoded and decoded in multithreaded batches, and parity with the sentencepiece library verified."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnflow.llm.common import crc, ship
from tarnflow.llm.tokens import Met

SPACE = "▁"
CALL_CHARS = 400_000
SCHEMA = "doc_id long, n_pieces long, ids_crc32 long, n_unknown long, n_bytes_fallback long, decoded_ok boolean, parity boolean"
# Kinds of a piece and of a model in the protobuf.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def parse(path: str):
    from sentencepiece import sentencepiece_model_pb2 as protobuf

    model = protobuf.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


def merges_of(pieces: list[tuple[str, float]]) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, in the order in which the model merges: best score of the result first, then the earlier left part."""
    scores = dict(pieces)
    found = []
    for piece, score in pieces:
        for k in range(1, len(piece)):
            left, right = piece[:k], piece[k:]
            if left in scores and right in scores:
                found.append((-score, k, left, right))
    found.sort(key=lambda m: m[:2])
    return [(left, right) for _, _, left, right in found]


def splits_at_spaces(pieces: list[str]) -> bool:
    """Whether no piece holds a space marker behind another character: then no merge crosses the place before a run of markers."""
    return not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)


def rebuilt(path: str):
    """A tokenizers.Tokenizer with the ids of the model at path."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    proto = parse(path)
    kind, norm = proto.trainer_spec.model_type, proto.normalizer_spec
    unknown = next(k for k, p in enumerate(proto.pieces) if p.type == UNKNOWN)
    fallback = proto.trainer_spec.byte_fallback
    names = [p.piece for p in proto.pieces]
    if kind == UNIGRAM:
        model = models.Unigram([(p.piece, p.score) for p in proto.pieces], unknown, fallback)
    elif kind == BPE:
        plain = [(p.piece, p.score) for p in proto.pieces if p.type in (NORMAL, USER_DEFINED)]
        model = models.BPE({n: k for k, n in enumerate(names)}, merges_of(plain), unk_token=names[unknown], fuse_unk=True, byte_fallback=fallback)
    else:
        raise ValueError(f"model type {kind}")
    tokenizer = Tokenizer(model)
    steps = [normalizers.Precompiled(norm.precompiled_charsmap)] if norm.precompiled_charsmap else []
    if norm.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if norm.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if norm.escape_whitespaces:
        steps.append(normalizers.Replace(" ", SPACE))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if kind == BPE and norm.escape_whitespaces and splits_at_spaces(names):
        # The same ids as over the whole text, but words come from the cache.
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")
    ends = [decoders.Strip(" ", 1, 0)] if norm.add_dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
    return tokenizer


_open: dict[str, "Codec"] = {}


def codec(path: str) -> "Codec":
    if path not in _open:
        _open[path] = Codec(path)
    return _open[path]


class Codec:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        from sentencepiece import SentencePieceProcessor

        self.tokenizer, self.checker, proto = rebuilt(path), SentencePieceProcessor(model_file=path), parse(path)
        kinds = np.array([p.type for p in proto.pieces])
        self.unknown, self.byte = kinds == UNKNOWN, kinds == BYTE
        # The normaliser changes nothing: the decoded text must be the text.
        self.lossless = proto.trainer_spec.byte_fallback and not proto.normalizer_spec.precompiled_charsmap and not proto.normalizer_spec.remove_extra_whitespaces

        self.starts = np.array([p.piece.startswith(SPACE) for p in proto.pieces])
        self.by_words = self.lossless and self.tokenizer.pre_tokenizer is not None and proto.normalizer_spec.add_dummy_prefix
        if self.by_words:
            self.bare = rebuilt(path)
            self.bare.normalizer = None
        self.words = Met()

    def _fresh(self, words: list[str]) -> tuple[dict[str, bytes], set[str]]:
        """Ids of words, each with its only marker before it, by few calls: a piece with a marker begins the next word. And those that don't decode."""
        found, wrong = {}, set()
        parts = [words[k : k + 250] for k in range(0, len(words), 250)]
        encoded = self.bare.encode_batch_fast([SPACE + SPACE.join(p) for p in parts], add_special_tokens=False)  # the library's threads share the parts
        every = [e.ids for e in encoded]
        for part, ids, back in zip(parts, every, self.decode(every), strict=True):
            ids = np.array(ids, "<u4")
            cuts = np.flatnonzero(self.starts[ids])
            if len(cuts) != len(part):
                raise ValueError("a word holds another marker")
            raw, ends = ids.tobytes(), [*(cuts[1:] * 4).tolist(), ids.nbytes]
            each = [raw[b:e] for b, e in zip((cuts * 4).tolist(), ends, strict=True)]
            found.update(zip(part, each, strict=True))
            if back != " ".join(part):
                single = self.decode([np.frombuffer(e, "<u4").tolist() for e in each])
                wrong.update(w for w, d in zip(part, single, strict=True) if d != w)
        return found, wrong

    def coded(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """The ids of each text as little-endian unsigned 32-bit integers, and whether decoding gives the text back (its markers as spaces):
        by the backend word by word, or whole where words aren't parted by single spaces, and whole by the sentencepiece library."""
        out: list = [None] * len(texts)
        split, new, kept = {}, set(), self.words.kept
        for k, text in enumerate(texts if self.by_words else []):
            if text and SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
                words = text.split(" ")
                got = list(map(kept.get, words))
                if None in got:
                    new.update([w for w, g in zip(words, got, strict=True) if g is None])
                split[k] = words, got
        found, wrong = self._fresh(list(new))
        for k, (words, got) in split.items():
            raw = b"".join([found[w] if g is None else g for w, g in zip(words, got, strict=True)] if None in got else got)
            back = self.checker.decode(np.frombuffer(raw, "<i4"), num_threads=1)
            out[k] = raw, back == texts[k] and wrong.isdisjoint(words)
        for w in wrong:
            del found[w]  # what is kept decodes
        self.words.learn(found)
        rest = [k for k, o in enumerate(out) if o is None]
        ids = self.encode([texts[k] for k in rest])
        for k, i, back in zip(rest, ids, self.decode(ids), strict=True):
            whole = texts[k].replace(SPACE, " ") if self.lossless else self.checker.decode(i)
            out[k] = np.array(i, "<u4").tobytes(), back == whole
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def _runner(path: str, threads: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end = size = at
                size = 0
                while end < len(texts) and (size < CALL_CHARS or end == at):
                    size += len(texts[end])
                    end += 1
                part = texts[at:end]
                rows = []
                theirs = own.checker.encode(part, num_threads=threads, return_type="numpy")
                for key, (mine, ok), other in zip(keys[at:end], own.coded(part), theirs, strict=True):
                    raw = np.frombuffer(mine, "<i4")
                    rows.append((key, len(raw), crc(mine), int(own.unknown[raw].sum()), int(own.byte[raw].sum()), ok, np.array_equal(raw, other)))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
                at = end

    return run


def encoded(docs: DataFrame, path: str, threads: int = 2) -> DataFrame:
    """For each row of docs: n_pieces, ids_crc32 (ids as little-endian unsigned 32-bit), n_unknown, n_bytes_fallback, decoded_ok (decoding gives
    the text back, by the backend and by the library, or what the library gives where its normaliser changes texts) and parity (the ids are the sentencepiece library's).

    A null text counts as an empty one: no ids. Control pieces' strings in a text are ordinary text. Repeated rows give repeated results.
    Columns but doc_id and text aren't looked at.
    """
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_runner(path, threads), SCHEMA)
