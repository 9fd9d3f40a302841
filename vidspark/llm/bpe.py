"""Byte-pair encoding and decoding with forced-boundary splitting.

A table of the 65,536 byte pairs marks those that stand next to each other inside some vocabulary token. Where a pair never
does, no token can cross, so a text may be cut there and the pieces encoded independently. The tokenizer's own pattern
also looks across pieces, so only cuts before an ASCII space count: there the pattern always starts a new match once the
pair is forced (the space belongs to what follows, or the run of white space before it ends the piece, which the pattern
treats like the end of the text). Pieces repeat a lot; a worker encodes a distinct one once while it remembers it.

Decoding looks up each id's bytes and joins them by document; malformed UTF-8 becomes U+FFFD as in the library.

Defined results: a null text is encoded as an empty one, without ids; repeated rows give repeated rows; extra columns pass, but
for those called like a result; texts of any length are encoded whole; an empty table gives no row.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.llm.common import documents, text_slices

TOKENIZER = "byte_bpe_50k.json"
#: Distinct pieces of a generation that a worker remembers, and the longest that is remembered; they bound memory, not results.
REMEMBERED, LONGEST = 150_000, 64
#: Pieces encoded in one call of the library.
TOGETHER = 1024


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_of_char() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the
    others follow from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Bytes of every id, and which byte pairs occur inside tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        table = byte_of_char()
        tokens = {i: bytes(table[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        tokens |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.size = max(tokens) + 1
        self.bytes = [tokens.get(i, b"") for i in range(self.size)]
        self.inside = np.zeros((256, 256), bool)
        for token in self.bytes:
            codes = np.frombuffer(token, np.uint8)
            self.inside[codes[:-1], codes[1:]] = True
        self.lengths = np.array([len(t) for t in self.bytes], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def cuts(self, data: bytes) -> np.ndarray:
        """Where pieces start, without 0."""
        codes = np.frombuffer(data, np.uint8)
        return np.flatnonzero(~self.inside[:, 0x20][codes[:-1]] & (codes[1:] == 0x20)) + 1

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of ids; unknown ids give nothing."""
        ids = ids[ids < self.size].astype(np.int64)
        joined = self.flat[gathered(self.starts[ids], self.lengths[ids])].tobytes()
        return joined.decode("utf-8", "replace").encode()


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of all ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


#: Byte patterns of characters whose class is the same in every version of Unicode: ASCII, and U+00C0 to U+024F without the
#: two signs among them, which are all letters. Pieces of other characters are left to the library.
_LETTER = rb"(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF]|[\xC4-\xC8][\x80-\xBF]|\xC9[\x80-\x8F])"
_SIGN = rb"[!-/:-@\[-`{-~]"
#: Single line breaks that something plain follows belong to them too.
_PLAIN = _LETTER + rb"|[0-9]|" + _SIGN
PLAIN = re.compile(rb" ?(?:" + _PLAIN + rb")(?:" + _PLAIN + rb"|\n(?=[!-~\xC3-\xC9]))*")
#: What the tokenizer's own pattern finds in such a piece, one match after the other.
MATCHES = re.compile(rb"'(?:s|t|re|ve|m|ll|d)| ?" + _LETTER + rb"+| ?[0-9]+| ?" + _SIGN + rb"+|\n")


#: A piece that is a single match.
SINGLE = re.compile(rb" ?(?:" + _LETTER + rb"+|[0-9]+|" + _SIGN + rb"+)")


class _Known:
    """Distinct pieces and their ids, one piece after the other."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.ids, self.starts, self.lengths = array("I"), array("q"), array("q")

    def add(self, pieces: list[bytes], ids: list) -> None:
        self.place.update(zip(pieces, range(len(self.starts), len(self.starts) + len(pieces))))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts.frombytes((np.cumsum(lengths) - lengths + len(self.ids)).tobytes())
        self.lengths.frombytes(lengths.tobytes())
        self.ids.extend(chain.from_iterable(ids))


class Encoder:
    """Encodes texts piece by piece.

    Pieces of plain characters are split as the tokenizer's pattern does and merged by rank; the others go to the library.
    Two generations of distinct pieces are remembered: a full one becomes the old one, and what is met again moves on.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tiktoken import _tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = vocabulary = Vocabulary(path)
        added = {t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {token: i for i, token in enumerate(vocabulary.bytes) if token and token not in added}
        self.merged = _tiktoken.CoreBPE(ranks, {}, r"\s+|\S+").encode_single_piece if mergeable(path) else None
        self.special = [t for t in added if PLAIN.fullmatch(t)]
        # tokens that merging by rank does not lead to: the merger would return them at once
        whole = [t for t in ranks if (m := MATCHES.match(t)) and m.end() == len(t)]
        self.unreached = {}
        for k in range(0, len(whole), 1000):
            coded = self.tokenizer.encode_batch_fast([t.decode() for t in whole[k:k + 1000]], add_special_tokens=False)
            self.unreached |= {t: c.ids for t, c in zip(whole[k:k + 1000], coded) if len(c.ids) > 1}
        self.new, self.old = _Known(), _Known()

    def _learn(self, pieces: list[bytes]) -> None:
        if self.merged is None:
            single, rest = [], pieces
        else:
            marks = list(map(SINGLE.fullmatch, pieces))
            single = [p for p, m in zip(pieces, marks) if m]
            rest = [p for p, m in zip(pieces, marks) if not m]
        self.new.add(single, [self.unreached.get(p) or self.merged(p) for p in single] if self.unreached
                     else list(map(self.merged, single)))
        several, coded, other = [], [], []
        for piece in rest:
            if self.merged is None or not PLAIN.fullmatch(piece) or any([t in piece for t in self.special]):
                other.append(piece)
                continue
            ids = []
            for part in MATCHES.findall(piece):
                ids += self.unreached.get(part) or self.merged(part)
            several.append(piece)
            coded.append(ids)
        self.new.add(several, coded)
        for k in range(0, len(other), TOGETHER):
            part = other[k:k + TOGETHER]
            self.new.add(part, [c.ids for c in self.tokenizer.encode_batch_fast([p.decode() for p in part],
                                                                                 add_special_tokens=False)])

    def _places(self, pieces: list[bytes]) -> np.ndarray:
        """Where each of the distinct pieces stands among the remembered ones; unknown ones are encoded first."""
        place, old = self.new.place, self.old
        unknown = [p for p in pieces if p not in place]
        if old.place and unknown:
            met = [p for p in unknown if p in old.place]
            unknown = [p for p in unknown if p not in old.place]
            at = [old.place[p] for p in met]
            self.new.add(met, [old.ids[old.starts[k]:old.starts[k] + old.lengths[k]] for k in at])
        self._learn(unknown)
        return np.fromiter(map(place.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        if len(self.new.place) > REMEMBERED or len(self.new.ids) > 16 * REMEMBERED:
            self.new, self.old = _Known(), self.new
        data = b"".join(texts)
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        if not data:
            return [np.empty(0, np.uint32) for _ in texts]
        starts = np.zeros(len(data) + 1, bool)
        starts[self.vocabulary.cuts(data)] = True
        starts[bounds] = True  # a text begins a piece whatever stands before it
        edges = np.flatnonzero(starts)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)),
                                                                          pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        at = self._places(distinct)[pieces.indices.to_numpy()]
        lengths = np.frombuffer(self.new.lengths, np.int64)[at]
        flat = np.frombuffer(self.new.ids, np.uint32)[gathered(np.frombuffer(self.new.starts, np.int64)[at], lengths)] \
            if len(self.new.ids) else np.empty(0, np.uint32)
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(edges, bounds)]
        for piece in distinct:
            if len(piece) > LONGEST:
                del self.new.place[piece]
        return [flat[a:b] for a, b in zip(ends, ends[1:])]


def mergeable(path: str) -> bool:
    """Whether the tokenizer is plain byte-level merging in the order of ids, with the pattern that MATCHES has."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    tokens = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [model["vocab"][t] for t in tokens]
    return (spec["normalizer"] is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
            and before.get("use_regex", True) and not model.get("dropout") and not model.get("ignore_merges")
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and all(a < b for a, b in zip(ids, ids[1:])))


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker. This module travels by value and is made anew for each task, so what outlives a
    task is kept in a module of its own name."""
    kept = sys.modules.setdefault("_vidspark_encoders", types.ModuleType("_vidspark_encoders"))
    if path not in vars(kept):
        setattr(kept, path, Encoder(path))
    return getattr(kept, path)


def _encoding(path: str, others: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]):
        encoder = worker_encoder(path)
        for batch, texts in text_slices(batches, text):
            ids = encoder.encode([t or b"" for t in texts])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others),
                                              pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())],
                                             names=[*others, "ids"])
    return run


def _decoding(path: str, kept: list[str], ids: str):
    def run(batches: Iterator[pa.RecordBatch]):
        vocabulary = worker_encoder(path).vocabulary
        for batch, packed in text_slices(batches, ids):
            texts = [None if p is None else vocabulary.decode(np.frombuffer(p, "<u4")).decode() for p in packed]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())],
                                             names=[*kept, "decoded"])
    return run


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """docs with the text replaced by ``ids``: little-endian unsigned 32-bit integers as binary."""
    others = [c for c in docs.columns if c not in (text, "ids")]
    out = docs.select(*others, F.lit(None).cast("binary").alias("ids")).schema
    return docs.select(*others, text).mapInArrow(_encoding(path or tokenizer_path(), others, text), out)


def decode(coded: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """Adds ``decoded``, the text of the ids; null ids give null."""
    kept = [c for c in coded.columns if c != "decoded"]
    out = coded.select(*kept, F.lit(None).cast("string").alias("decoded")).schema
    return coded.select(*kept).mapInArrow(_decoding(path or tokenizer_path(), kept, ids), out)


def round_trip(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """decode(encode(docs)) in one pass, so that a task needs one Python worker."""
    path = path or tokenizer_path()
    others = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    there, back = _encoding(path, others, text), _decoding(path, [*others, "ids"], "ids")
    out = docs.select(*others, F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("string").alias("decoded")).schema
    return docs.select(*others, text).mapInArrow(lambda batches: back(there(batches)), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(round_trip(documents(spark, sf_dir)))


def digests(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
