"""Removal of repeated byte strings by difference-cover suffix sorting, spread over blocks.

A byte goes if it is covered by a string of LENGTH bytes that also starts in a document with a smaller id.

1. Narrowing, without loss. Each window of LENGTH bytes names the leftmost of its GRAM-byte strings with the least hash as
   its anchor; equal windows have equal anchors at the same place. Anchors are exchanged by hash; those of one document
   alone are dropped. A task first merges what it has itself, so an anchor costs one entry in each task. Shared ones go
   to their documents packed by part, a row for each task and part. Six bytes of a hash are sent; two hashes that agree in
   them cost a context that nothing equals, and no result.
2. Contexts. Around every shared anchor a document sends the bytes of the windows that name it, to the block of the anchor.
   Equal contexts in a task are sent once, for the smallest id; the others are repeats already.
3. Suffix sorting. In a block equal contexts become one class with its smallest id. Anchors with several classes are
   suffix-sorted by difference cover: the triples (of 8-byte words) at two of three places are sorted and named, the names
   are sorted again in triples until all differ, the remaining suffixes are sorted by one byte and the rank
   after it and merged, and adjacent suffixes are compared over LENGTH bytes. The smallest id of each run of equal prefixes
   decides which windows are repeats. The windows of an anchor whose classes are too large for one sort are dealt to
   parts by a hash of their bytes, and equal ones found by sorting a part; they stay in the task that has the anchor.
4. The removed ranges are joined up for each text, and back to the texts by id. The texts cross the network once: step 2 and
   this step read the same exchange, so what they take from it has the same columns and filters.

Every exchange grows linearly with the text. Sorting all suffixes in one global recursion would move each of
them several times; here only what repeats is sorted.

Defined results: a null text is an empty one; texts under LENGTH bytes lose nothing; a null id counts as larger than any
other; rows with one id never take anything from each other; repeated rows give repeated rows; other columns pass through
``deduplicated`` and are ignored by the digests; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidspark.llm.common import documents, shuffle_partitions, text_slices

LENGTH, GRAM = 50, 20
#: Bytes of text worked on at once, anchors or contexts a task holds, bytes of a sorted block: memory only.
PIECE, HELD, BLOCK = 1 << 20, 600_000, 1 << 19
#: What a suffix sort takes; an anchor whose classes have more bytes has its windows sorted by themselves, PART at a time,
#: with the same result.
LARGEST, PART = (1 << 21) - 1, 1 << 18
NO_ID = (1 << 63) - 1
_MASK = np.uint64((1 << 21) - 1)


# --- difference-cover suffix sorting ----------------------------------------------------------------------------------

def _names(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Ranks from 1 of all places, equal where all keys are."""
    changed = np.zeros(len(order), bool)
    for key in keys:
        k = key[order]
        changed[1:] |= k[1:] != k[:-1]
    names = np.empty(len(order), np.uint64)
    names[order] = np.cumsum(changed).astype(np.uint64) + np.uint64(1)
    return names


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of a text of bytes under 255, in order; a suffix comes before what it starts."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tobytes()), np.int64)
    if n >= 1 << 21:
        raise ValueError("a sort takes under 2^21 bytes")
    padded = np.concatenate((text + np.uint8(1), np.zeros(32, np.uint8)))  # nothing is as small as the end
    words = np.zeros(n + 24, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k:k + n + 24]
    places = np.arange(n)
    sampled = places[places % 3 != 0]
    # sort sampled triples
    keys = [words[sampled], words[sampled + 8], words[sampled + 16]]
    names, covered = _names(np.lexsort(keys[::-1]), keys), 24
    rank = np.zeros(n + 3, np.uint64)
    rank[sampled] = names
    # recurse on names: in each round a name stands for three of the round before
    while int(names.max()) < len(sampled):
        after = [np.where(sampled + k * covered < n, rank[np.minimum(sampled + k * covered, n)], np.uint64(0))
                 for k in (1, 2)]
        key = (names << np.uint64(42)) | (after[0] << np.uint64(21)) | after[1]
        names = _names(np.argsort(key, kind="stable"), [key])
        rank[sampled] = names
        covered *= 3
    # merge remaining suffixes
    cover = np.empty(len(sampled), np.int64)
    cover[names.astype(np.int64) - 1] = sampled
    rest = places[places % 3 == 0]
    wide = padded.astype(np.uint64)
    one = lambda i: (wide[i] << np.uint64(24)) | rank[i + 1]
    two = lambda i: (wide[i] << np.uint64(32)) | (wide[i + 1] << np.uint64(24)) | rank[i + 2]
    rest = rest[np.argsort(one(rest), kind="stable")]
    first, second = cover[cover % 3 == 1], cover[cover % 3 == 2]
    at = np.arange(len(rest)) + np.searchsorted(one(first), one(rest)) + np.searchsorted(two(second), two(rest))
    out = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[at] = False
    out[at], out[free] = rest, cover
    return out


def equal_prefixes(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The given starts in suffix order, and the number of the run of equal prefixes each belongs to."""
    order = suffix_order(text)
    wanted = np.zeros(len(text), bool)
    wanted[starts] = True
    order = order[wanted[order]]
    differs = np.zeros(len(order), bool)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    words = np.zeros(len(text) + 1, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k:k + len(text) + 1]
    for k in [*range(0, length - 8, 8), length - 8]:
        w = words[order + k]
        differs[1:] |= w[1:] != w[:-1]
    return order, np.cumsum(differs)


# --- anchors ----------------------------------------------------------------------------------------------------------

class Anchors:
    """Anchors of texts by rolling hashes; one per task."""

    def __init__(self):
        rng = np.random.default_rng(20)
        self.table = rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.size = 0

    def _powers(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, 2 * PIECE)
            base = 0x9E3779B97F4A7C15
            for name, b in (("power", base), ("inverse", pow(base, -1, 1 << 64))):
                steps = np.full(self.size, np.uint64(b))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def find(self, texts: list[bytes]) -> Iterator[tuple]:
        """Groups of texts: (text numbers, first window, last window, hash) of each anchor, places within the text."""
        numbers, bases, pieces, size = [], [], [], 0
        for k, text in enumerate(texts):
            for base in range(0, max(1, len(text) - LENGTH + 1), PIECE):
                piece = text[base:base + PIECE + LENGTH - 1]
                if len(piece) < LENGTH:
                    continue
                numbers.append(k)
                bases.append(base)
                pieces.append(piece)
                size += len(piece)
                if size >= PIECE // 2:
                    yield self._group(numbers, bases, pieces)
                    numbers, bases, pieces, size = [], [], [], 0
        if pieces:
            yield self._group(numbers, bases, pieces)

    def _group(self, numbers: list[int], bases: list[int], pieces: list[bytes]) -> tuple:
        codes = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(codes)
        self._powers(n)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.table[codes] * self.power[:n])))
        hashes = (total[GRAM:] - total[:-GRAM]) * self.inverse[:n - GRAM + 1]
        hashes ^= hashes >> np.uint64(31)
        hashes *= np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(32)
        low = (hashes & ~_MASK) | np.arange(len(hashes), dtype=np.uint64)
        for step in (1, 2, 4, 8):
            low = np.minimum(low[:-step], low[step:])
        least = (np.minimum(low[:-15], low[15:]) & _MASK).astype(np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        inside = np.ones(n - LENGTH + 1, bool)
        for end in ends[:-1]:
            inside[end - LENGTH + 1:end] = False
        windows = np.flatnonzero(inside)
        named = least[windows]
        first = np.flatnonzero(np.concatenate(([True], (named[1:] != named[:-1]) | (np.diff(windows) != 1))))
        last = np.concatenate((first[1:] - 1, [len(windows) - 1]))
        text = np.searchsorted(ends, windows[first], "right")
        shift = np.asarray(bases)[text] - (ends - lengths)[text]
        return (np.asarray(numbers)[text], windows[first] + shift, windows[last] + shift, hashes[named[first]])


assert LENGTH - GRAM == 30  # the minimum above is over 31 strings


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else \
        np.zeros(0, np.int64)


#: Bytes of a hash that are sent, and what they keep of it.
SENT = 6
_KEPT = np.uint64((1 << 8 * SENT) - 1)


def _packed(ids: np.ndarray, hashes: np.ndarray, bucket: np.ndarray) -> list[tuple]:
    """A row for each bucket: its ids once each, by their steps, how many hashes each has, and the hashes in this order."""
    import zstandard
    packer = zstandard.ZstdCompressor(level=1)
    order = np.lexsort((ids, bucket))
    ids, hashes, bucket = ids[order], hashes[order], bucket[order]
    edges = [*_runs(bucket).tolist(), len(ids)]
    out = []
    for a, b in zip(edges, edges[1:]):
        at = _runs(ids[a:b])
        steps = np.diff(ids[a:b][at], prepend=np.int64(0)).astype("<i8")  # wraps around, and back when summed
        sent = np.ascontiguousarray(hashes[a:b], "<u8").view(np.uint8).reshape(-1, 8)[:, :SENT]
        out.append((int(bucket[a]), packer.compress(steps.tobytes()),
                    packer.compress(np.diff(np.append(at, b - a)).astype("<u4").tobytes()), sent.tobytes()))
    return out


def _unpacked(ids: bytes, counts: bytes, hashes: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The id and what was sent of the hash of each entry."""
    import zstandard
    unpacker = zstandard.ZstdDecompressor()
    sent = np.frombuffer(hashes, np.uint8).reshape(-1, SENT)
    whole = np.zeros((len(sent), 8), np.uint8)
    whole[:, :SENT] = sent
    known = np.cumsum(np.frombuffer(unpacker.decompress(ids), "<i8"))
    return np.repeat(known, np.frombuffer(unpacker.decompress(counts), "<u4")), whole.view("<u8").ravel()


#: The part of a document, from its id, modulo their number: ids with a common divisor don't all fall into a few.
_PART = "id ^ shiftright(id, 7) ^ shiftright(id, 17)"


def _parts(ids: np.ndarray, buckets: int) -> np.ndarray:
    return np.mod(ids ^ (ids >> 7) ^ (ids >> 17), buckets)


_ANCHOR_ROWS = "bucket int, known boolean, ids binary, counts binary, hashes binary"


def _anchor_entries(id_at: int, text: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]):
        anchors, held_ids, held_hashes, held = Anchors(), [], [], 0

        def rows(ids: np.ndarray, hashes: np.ndarray, bucket: np.ndarray, known: bool):
            return [(b, known, *packed) for b, *packed in _packed(ids, hashes, bucket)]

        def flush():
            ids, hashes = np.concatenate(held_ids), np.concatenate(held_hashes)
            order = np.lexsort((ids, hashes))
            ids, hashes = ids[order], hashes[order]
            new = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (ids[1:] != ids[:-1])))
            ids, hashes = ids[new], hashes[new]
            at = _runs(hashes)
            several = np.repeat(np.diff(np.append(at, len(hashes))) > 1, np.diff(np.append(at, len(hashes))))
            # shared within the task: every document knows it; one entry tells the others. Two entries with different ids
            # do so even if a copy of one id is elsewhere.
            asks = np.zeros(len(hashes), bool)
            asks[at] = True
            asks[1:] |= several[1:] & asks[:-1]
            bucket = ((hashes >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            out = rows(ids[asks], hashes[asks], bucket[asks], False)
            out += rows(ids[several], hashes[several], np.mod(ids[several], buckets), True)
            held_ids.clear()
            held_hashes.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()))],
                names=["bucket", "known", "ids", "counts", "hashes"])

        for batch, texts in text_slices(batches, text):
            ids = _ids(batch.column(id_at))
            for number, _, _, hashes in anchors.find([t or b"" for t in texts]):
                held_ids.append(ids[number])
                held_hashes.append(hashes)
                held += len(hashes)
            if held > HELD:
                yield flush()
                held = 0
        if held:
            yield flush()
    return run


_HIT_ROWS = "part int, ids binary, counts binary, hashes binary"
_HIT_TYPES = [pa.int32(), *[pa.binary()] * 3]


def _shared_anchors(buckets: int):
    """Rows of one partition, so all entries of its anchors, to those in several documents, packed by the part of the document:
    at most a row for each part and 64 rows read, whatever the number of documents."""
    def hits(ids: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        rows = _packed(ids, hashes, _parts(ids, buckets))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _HIT_TYPES)],
                                          names=[x.split()[0] for x in _HIT_ROWS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]):
        parts: dict[bool, list] = {False: [], True: []}
        for batch in batches:
            for known, *packed in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                parts[known].append(_unpacked(*packed))
                if known and len(parts[True]) >= 64:
                    yield hits(*map(np.concatenate, zip(*parts[True])))
                    parts[True].clear()
        if parts[True]:
            yield hits(*map(np.concatenate, zip(*parts[True])))
        if parts[False]:
            ids, hashes = map(np.concatenate, zip(*parts.pop(False)))
            order = np.argsort(hashes, kind="stable")
            ids, hashes = ids[order], hashes[order]
            at = _runs(hashes)
            sizes = np.diff(np.append(at, len(ids)))
            several = np.repeat(np.minimum.reduceat(ids, at) < np.maximum.reduceat(ids, at), sizes)
            if several.any():
                yield hits(ids[several], hashes[several])
    return run


# --- contexts and blocks ----------------------------------------------------------------------------------------------

_CONTEXT_ROWS = "bucket int, sizes binary, packed binary, spans binary"
_CONTEXT_TYPES = [pa.int32(), *[pa.binary()] * 3]


def _text_key(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


class _Hits:
    """Shared anchors of the documents of one part."""

    def __init__(self, found: list[tuple]):
        ids, hashes = map(np.concatenate, zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        order = np.lexsort((hashes, ids))
        ids, hashes = ids[order], hashes[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])
        self.ids, self.hashes = ids[new], hashes[new]

    def of(self, ids: np.ndarray) -> list[np.ndarray]:
        edges = (np.searchsorted(self.ids, ids, side).tolist() for side in ("left", "right"))
        return [self.hashes[a:b] for a, b in zip(*edges)]


def _contexts(text: str, buckets: int):
    """From the rows of one part, with id, text, ids, counts and hashes, packed anchors before documents."""
    def run(batches: Iterator[pa.RecordBatch]):
        import zstandard
        packer = zstandard.ZstdCompressor(level=1)
        anchors = Anchors()
        held: dict[bytes, list] = {}
        size = 0

        def flush():
            by_bucket: dict[int, list] = {}
            spans: dict[int, list] = {}
            for context, (tag, uses) in held.items():
                least = min(u[0] for u in uses)
                kept = [u for u in uses if u[0] == least]
                by_bucket.setdefault(tag % buckets, []).append((context, tag, kept))
                for u in uses:
                    if u[0] != least:
                        spans.setdefault(u[0] % buckets, []).append((u[0], u[1], u[2], u[2] + len(context)))
            held.clear()
            for bucket, found in by_bucket.items():
                # documents once each; uses follow the contexts' order
                documents = {d: k for k, d in enumerate({u[:2]: None for x in found for u in x[2]})}
                parts = [np.array(list(documents), "<i8"), np.array([documents[u[:2]] for x in found for u in x[2]], "<u4"),
                         np.array([u[2] for x in found for u in x[2]], "<u4"), np.array([len(x[2]) for x in found], "<u4"),
                         np.array([x[1] for x in found], "<u4"), np.array([len(x[0]) for x in found], "<u4")]
                packed = b"".join([*(x.tobytes() for x in parts), *(x[0] for x in found)])
                yield (bucket, np.array([len(documents), len(parts[1]), len(found)], "<i8").tobytes(),
                       packer.compress(packed), None)
            for bucket, rows in spans.items():
                yield (bucket, None, None, packer.compress(np.array(rows, "<i8").tobytes()))

        def batch_of_rows(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _CONTEXT_TYPES)],
                                              names=[x.split()[0] for x in _CONTEXT_ROWS.split(", ")])

        packed: list[tuple] = []

        def rows_of_documents():
            for batch in batches:
                document = batch.column("id").is_valid()
                anchors_of = batch.filter(pc.invert(document))
                packed.extend(_unpacked(*x) for x in zip(*(anchors_of.column(c).to_pylist() for c in ("ids", "counts", "hashes"))))
                yield batch.filter(document)

        known_hits = None
        for batch, texts in text_slices(rows_of_documents(), text):
            if known_hits is None:  # anchors come first
                known_hits = _Hits(packed)
                packed.clear()
            ids = _ids(batch.column("id"))
            hits = known_hits.of(ids)
            some = [k for k, h in enumerate(hits) if len(h)]
            if not some:
                continue
            shared = [hits[k] for k in some]
            picked = [texts[k] or b"" for k in some]
            keys = [_text_key(t) for t in picked]
            for number, first, last, hashes in anchors.find(picked):
                edges = [*_runs(number).tolist(), len(number)]
                for a, b in zip(edges, edges[1:]):
                    k = int(number[a])
                    own = hashes[a:b]
                    at = np.searchsorted(shared[k], own & _KEPT)
                    good = np.flatnonzero(shared[k][np.minimum(at, len(shared[k]) - 1)] == own & _KEPT)
                    data, doc, key = picked[k], int(ids[some[k]]), keys[k]
                    for s, e, tag in zip(first[a:b][good].tolist(), last[a:b][good].tolist(),
                                         (own[good] >> np.uint64(32)).tolist()):
                        context = data[s:e + LENGTH]
                        known = held.get(context)
                        if known is None:
                            held[context] = (tag, [(doc, key, s)])
                            size += 1
                        else:
                            known[1].append((doc, key, s))
                            size += 1
            if size > HELD // 2:
                yield batch_of_rows(list(flush()))
                size = 0
        if size:
            yield batch_of_rows(list(flush()))
    return run


_BLOCK_ROWS = "bucket int, spans binary"
_DOCUMENT_ROWS = "id long, spans array<struct<text: bigint, spans: binary>>"


def _by_document(batches: Iterator[pa.RecordBatch]):
    """All packed ranges of some documents to a row for each id, with the ranges of its texts, joined up."""
    import zstandard
    unpacker = zstandard.ZstdDecompressor()
    found = [np.frombuffer(unpacker.decompress(x), "<i8").reshape(-1, 4) for batch in batches for x in batch.column(1).to_pylist()]
    if not found:
        return
    spans = np.concatenate(found)
    spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
    kind = pa.list_(pa.struct([("text", pa.int64()), ("spans", pa.binary())]))
    ids, rows, size = [], [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, kind)], names=["id", "spans"])

    texts = np.append(np.flatnonzero(np.concatenate(([True], (spans[1:, :2] != spans[:-1, :2]).any(1)))), len(spans))
    for a, b in zip(texts.tolist(), texts[1:].tolist()):
        one = {"text": int(spans[a, 1]), "spans": _joined_up(spans[a:b, 2:]).tobytes()}
        if ids and ids[-1] == spans[a, 0]:
            rows[-1].append(one)
        else:
            if size > HELD:
                yield out()
                ids, rows, size = [], [], 0
            ids.append(int(spans[a, 0]))
            rows.append([one])
        size += b - a
    yield out()


def _blocks(buckets: int):
    """All contexts of some anchors to removed ranges, packed by the bucket of the document: at most a row for each bucket
    and HELD ranges, whatever the number of documents."""
    return lambda batches: _block_ranges(batches, buckets)


def _block_ranges(batches: Iterator[pa.RecordBatch], buckets: int):
    import zstandard
    unpacker, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    numbers: dict[bytes, int] = {}
    tags, uses, ready = [], [], []

    def given(spans: np.ndarray):
        """Rows of (id, text, start, end), dealt to buckets by id."""
        of = spans[:, 0] % buckets
        order = np.argsort(of, kind="stable")
        edges = np.append(_runs(of[order]), len(order)).tolist()
        return pa.RecordBatch.from_arrays([
            pa.array(of[order][edges[:-1]], pa.int32()),
            pa.array([packer.compress(np.ascontiguousarray(spans[order[a:b]], "<i8").tobytes())
                      for a, b in zip(edges, edges[1:])], pa.binary())], names=["bucket", "spans"])

    for batch in batches:
        for sizes, packed, spans in zip(*(batch.column(k).to_pylist() for k in range(1, 4))):
            if spans is not None:
                ready.append(np.frombuffer(unpacker.decompress(spans), "<i8").reshape(-1, 4))
                if sum(map(len, ready)) > HELD:
                    yield given(np.concatenate(ready))
                    ready.clear()
                continue
            n_documents, n_uses, n_contexts = np.frombuffer(sizes, "<i8").tolist()
            data, at = unpacker.decompress(packed), 16 * n_documents
            named = np.frombuffer(data, "<i8", 2 * n_documents).reshape(-1, 2)
            arrays = []
            for n in (n_uses, n_uses, n_contexts, n_contexts, n_contexts):
                arrays.append(np.frombuffer(data, "<u4", n, at).astype(np.int64))
                at += 4 * n
            of, starts, counts, own_tags, sizes_ = arrays
            ends = (np.cumsum(sizes_) + at).tolist()
            placed = []
            for tag, a, b in zip(own_tags.tolist(), [at, *ends], ends):
                k = numbers.setdefault(data[a:b], len(numbers))
                if k == len(tags):
                    tags.append(tag)
                placed.append(k)
            uses.append(np.stack([np.repeat(np.asarray(placed, np.int64), counts), named[of, 0], named[of, 1], starts], 1))
    if uses:
        contexts, use = list(numbers), np.concatenate(uses)
        numbers.clear()
        uses.clear()
        lengths = np.fromiter(map(len, contexts), np.int64, len(contexts))
        least = np.full(len(contexts), NO_ID, np.int64)
        np.minimum.at(least, use[:, 0], use[:, 1])
        later = use[:, 1] > least[use[:, 0]]
        full = use[later]
        ready.append(np.stack([full[:, 1], full[:, 2], full[:, 3], full[:, 3] + lengths[full[:, 0]]], 1))
        use = use[~later]
        use = use[np.argsort(use[:, 0], kind="stable")]
        use_at = np.searchsorted(use[:, 0], np.arange(len(contexts) + 1))
        tag = np.asarray(tags, np.int64)
        order = np.argsort(tag, kind="stable")
        at = _runs(tag[order])
        sizes = np.diff(np.append(at, len(order)))
        block, block_size = [], 0
        for a, n in zip(at[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            members = order[a:a + n]
            size = int(lengths[members].sum())
            if size > LARGEST:
                ready += _by_window(members, contexts, least, use, use_at)
                continue
            if block and block_size + size > LARGEST:
                ready += _sorted_block(np.concatenate(block), contexts, least, use, use_at)
                block, block_size = [], 0
            block.append(members)
            block_size += size
            if block_size >= BLOCK:
                ready += _sorted_block(np.concatenate(block), contexts, least, use, use_at)
                block, block_size = [], 0
        if block:
            ready += _sorted_block(np.concatenate(block), contexts, least, use, use_at)
    if ready:
        spans = np.concatenate(ready)
        if len(spans):
            yield given(spans)


def _laid_out(members: np.ndarray, contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts as one text, and of each window in it: its start, the number of its context, its place there."""
    text = np.frombuffer(b"".join([contexts[m] for m in members.tolist()]), np.uint8)
    lengths = np.fromiter((len(contexts[m]) for m in members.tolist()), np.int64, len(members))
    counts = lengths - LENGTH + 1
    owner = np.repeat(np.arange(len(members)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, (np.cumsum(lengths) - lengths)[owner] + place, owner, place


def _repeats(repeated: np.ndarray, owner: np.ndarray, place: np.ndarray, members: np.ndarray, use: np.ndarray,
             use_at: np.ndarray) -> list[np.ndarray]:
    """Removed ranges from the windows that are repeats, joined up within a context."""
    hit = np.flatnonzero(repeated)
    if not len(hit):
        return []
    new = np.concatenate(([True], (np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]])))
    first = hit[new]
    last = hit[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(hit) - 1]))]
    out = []
    for m, a, b in zip(members[owner[first]].tolist(), place[first].tolist(), place[last].tolist()):
        u = use[use_at[m]:use_at[m + 1]]
        out.append(np.stack([u[:, 1], u[:, 2], u[:, 3] + a, u[:, 3] + b + LENGTH], 1))
    return out


def _sorted_block(members: np.ndarray, contexts: list[bytes], least: np.ndarray, use: np.ndarray,
                  use_at: np.ndarray) -> list[np.ndarray]:
    """Removed ranges from comparing windows of different classes in suffix order."""
    text, starts, owner, place = _laid_out(members, contexts)
    order, run = equal_prefixes(text, starts)
    of_start = np.empty(len(text), np.int64)
    of_start[starts] = np.arange(len(starts))
    window = of_start[order]
    ids = least[members][owner[window]]
    repeated = np.zeros(len(starts), bool)
    repeated[window] = ids > np.minimum.reduceat(ids, _runs(run))[run]
    return _repeats(repeated, owner, place, members, use, use_at)


def _by_window(members: np.ndarray, contexts: list[bytes], least: np.ndarray, use: np.ndarray,
               use_at: np.ndarray) -> list[np.ndarray]:
    """The same for classes of any size: equal windows fall into one part and meet there in the order of their bytes."""
    text, starts, owner, place = _laid_out(members, contexts)
    ids = least[members]
    width = -(-LENGTH // 8)
    odd = np.random.default_rng(50).integers(1, 1 << 63, width, np.uint64) * np.uint64(2) + np.uint64(1)

    def words(at: np.ndarray) -> np.ndarray:
        strings = np.zeros((len(at), 8 * width), np.uint8)
        strings[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[at]
        return strings.view(np.uint64)

    parts = -(-len(starts) // PART)
    part = np.empty(len(starts), np.uint32)
    for k in range(0, len(starts), PART):
        part[k:k + PART] = (((words(starts[k:k + PART]) * odd).sum(axis=1) >> np.uint64(32)) % np.uint64(parts)).astype(np.uint32)
    repeated = np.zeros(len(starts), bool)
    for p in range(parts):
        window = np.flatnonzero(part == p)
        if not len(window):
            continue
        own = words(starts[window])
        order = np.lexsort(own.T)
        differs = np.concatenate(([False], (own[order[1:]] != own[order[:-1]]).any(axis=1)))
        window, run = window[order], np.cumsum(differs)
        of = ids[owner[window]]
        repeated[window] = of > np.minimum.reduceat(of, _runs(run))[run]
    return _repeats(repeated, owner, place, members, use, use_at)


# --- the operator -----------------------------------------------------------------------------------------------------

def _with_spans(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, list[str]]:
    """The columns of docs under new names, which are given too, besides others and ``spans``, an array of (text key, byte
    ranges). Rows without an id are no documents: they stay to be left out by ``_documents``."""
    buckets = shuffle_partitions(docs.sparkSession)
    names = [f"c{k}" for k in range(len(docs.columns))]
    body = names[docs.columns.index(text)]
    rows = docs.select("*", F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))).toDF(*names, "id")
    entries = rows.select("id", F.col(body).alias("text")).mapInArrow(_anchor_entries(0, "text", buckets), _ANCHOR_ROWS)
    hits = entries.repartition(buckets, "bucket").mapInArrow(_shared_anchors(buckets), _HIT_ROWS)
    # documents and their shared anchors meet in one exchange. A filter or fewer columns after it would move before it and
    # make another exchange of the texts, so both readers take all of it.
    part = F.expr(f"cast(pmod({_PART}, {buckets}L) as int)")
    dealt = rows.withColumn("part", part).unionByName(hits, allowMissingColumns=True).repartitionById(buckets, "part")
    contexts = dealt.sortWithinPartitions(F.col("id").isNotNull()).mapInArrow(_contexts(body, buckets), _CONTEXT_ROWS)
    blocks = contexts.repartition(buckets, "bucket").mapInArrow(_blocks(buckets), _BLOCK_ROWS)
    ranges = blocks.repartition(buckets, "bucket").mapInArrow(_by_document, _DOCUMENT_ROWS)
    return dealt.join(ranges.withColumn("part", part).repartitionById(buckets, "part"), ["part", "id"], "left"), names


def _documents(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The documents among the rows of ``_with_spans``: the columns of these names, then spans."""
    for batch in batches:
        yield batch.filter(batch.column("id").is_valid()).select([*names, "spans"])


def _joined_up(ranges: np.ndarray) -> np.ndarray:
    """Ranges in order of their starts, as disjoint ones that don't touch."""
    ends = np.maximum.accumulate(ranges[:, 1])
    new = np.concatenate(([True], ranges[1:, 0] > ends[:-1]))
    return np.stack([ranges[new, 0], ends[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(ranges) - 1]))]], 1)


def removed_ranges(text: bytes, spans: list | None) -> np.ndarray:
    """Ranges [start, end) to remove, disjoint and in order, from the spans of all texts with this id."""
    key = _text_key(text) if spans else 0
    own = [np.frombuffer(s["spans"], "<i8").reshape(-1, 2) for s in spans or () if s["text"] == key]
    if not own:
        return np.zeros((0, 2), np.int64)
    found = np.concatenate(own)
    return _joined_up(found[np.argsort(found[:, 0], kind="stable")])


def without(text: bytes, ranges: np.ndarray) -> bytes:
    edges = [0, *ranges.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    rows, names = _with_spans(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, texts in text_slices(_documents(batches, names), names[1]):
            out = []
            for data, spans in zip(texts, batch.column(2).to_pylist()):
                data = data or b""
                ranges = removed_ranges(data, spans)
                kept = without(data, ranges)
                out.append((len(data), len(data) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in zip(*out))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without repeated strings, same columns; a character that is cut goes as a whole, and so does a text of which
    nothing but white space is left."""
    rows, names = _with_spans(docs, doc_id, text)
    columns = docs.columns
    body = names[columns.index(text)]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, texts in text_slices(_documents(batches, names), body):
            out, keep = [], []
            for data, spans in zip(texts, batch.column(len(columns)).to_pylist()):
                ranges = removed_ranges(data or b"", spans)
                kept = data if data is None or not len(ranges) else b"".join(
                    p.decode("utf-8", "ignore").encode() for p in _pieces(data, ranges))
                out.append(None if kept is None else kept.decode())
                keep.append(not len(ranges) or bool(kept.strip()))
            arrays = list(batch.columns[:len(columns)])
            arrays[columns.index(text)] = pa.array(out, arrays[columns.index(text)].type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(keep))

    return rows.mapInArrow(run, docs.schema)


def _pieces(text: bytes, ranges: np.ndarray) -> list[bytes]:
    edges = [0, *ranges.ravel().tolist(), len(text)]
    return [text[a:b] for a, b in zip(edges[::2], edges[1::2])]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
