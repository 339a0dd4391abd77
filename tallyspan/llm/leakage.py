"""Evaluation passages that stand, wholly or partly, in corpus texts.

Windows of a passage, about as long as the part of it that counts, and windows
of the corpus are embedded by CGK random walks, which turn word edits into few
differing places; bit-sampling LSH over several walks finds window pairs that
agree in all sampled places; each pair is then verified by exact edit
alignment.  The held-out passages are a stated query set: they are indexed in
blocks of bounded size and sent to the tasks, the corpus is only read, so the
job has no shuffle and no group can grow hot.

Before the embedding, windows are screened by a bound that no match fails: a
stretch of the length that counts has at most an eighth of its words altered,
put in or left out, each of which spoils two word pairs; windows with more pairs
that are none of the passages' are not embedded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyspan.llm.words import hashed_words, plain_bytes, text_slices

#: Bytes of the index that is sent to the tasks at a time, and what a word of a
#: passage takes of it: nine keys with their item and place, its hash and pair.
BLOCK_BYTES = 64_000_000
_WORD_BYTES = 160
SHARE = 0.4
PER_EDIT = 7  # matches that each edit needs: one word in eight altered
WALKS = 3
DRAWS = 3
SAMPLES = 7
_SIZES = (4, 6, 8, 12, 16, 24, 32, 48, 64)
_PAIR = np.uint64(0x9FB21C651E98DF25)
_BLOOM_BITS = 22  # at most; 64 bits a pair where that is less
_TOGETHER = 5


def needed(n_words: int) -> int:
    """Words of a passage that must be held: two fifths, rounded up."""
    return -(-2 * n_words // 5)


def window_size(n_words: int) -> int:
    """Window for a passage: at most half of the stretch that counts.

    Where all edits of a stretch stand together, one of the parts beside them
    then holds a whole window.
    """
    half = max(1, -(-needed(n_words) // 2))
    fit = [s for s in _SIZES if s <= half]
    return fit[-1] if fit else half


def spoiled_pairs(size: int) -> int:
    """Word pairs that the edits of a window may spoil: its share, rounded up."""
    return 2 * -(-size // (PER_EDIT + 1))


def pairs_of(words: np.ndarray) -> np.ndarray:
    """Hash of each word with the next one."""
    with np.errstate(over="ignore"):
        return (words[:-1] * _PAIR) ^ (words[1:] + (words[:-1] << np.uint64(7)))


def walk_keys(words: np.ndarray, at: np.ndarray, size: int, seed: int) -> list[np.ndarray]:
    """LSH keys of the windows that start ``at``, DRAWS of one random walk.

    The walk reads the word under its pointer and moves on or stays by a random
    bit of (step, word); each key hashes the words read at its sampled steps.
    """
    rng = np.random.default_rng([seed, size])
    draws = [set(rng.choice(2 * size, size=min(SAMPLES, 2 * size), replace=False).tolist()) for _ in range(DRAWS)]
    factors = rng.integers(1, 2**63, size=2 * size, dtype=np.uint64) | np.uint64(1)
    starts = rng.integers(1, 2**63, size=DRAWS, dtype=np.uint64)
    pointer = np.array(at, dtype=np.int64)
    end = pointer + size
    keys = [np.full(len(at), start, dtype=np.uint64) for start in starts]
    with np.errstate(over="ignore"):
        for step in range(max(map(max, draws)) + 1):
            seen = words[pointer]
            seen[pointer == end] = 0
            for key, steps in zip(keys, draws, strict=True):
                if step in steps:
                    key ^= seen
                    key *= _PAIR
                    key ^= key >> np.uint64(29)
            pointer += ((seen * factors[step]) >> np.uint64(63)).astype(np.int64)
            # Past its end a window reads blanks, which never move the pointer.
    return keys


@dataclass
class Index:
    """A block of passages: words, their pairs, and LSH tables by window size."""

    ids: np.ndarray
    words: np.ndarray
    bounds: np.ndarray
    sizes: dict[int, "SizeIndex"]


@dataclass
class SizeIndex:
    bloom: np.ndarray
    bits: int
    pairs: np.ndarray
    least: int
    keys: np.ndarray
    item: np.ndarray
    place: np.ndarray


def build_index(ids: list[int], passages: list[str]) -> Index:
    words, bounds = hashed_words([plain_bytes(p) for p in passages])
    by_size: dict[int, list[int]] = {}
    for i, n in enumerate(np.diff(bounds)):
        if n:
            by_size.setdefault(window_size(int(n)), []).append(i)
    sizes = {}
    for size, members in by_size.items():
        pairs = [pairs_of(words[bounds[i] : bounds[i + 1]]) for i in members]
        at = [np.arange(bounds[i], max(bounds[i] + 1, bounds[i + 1] - size + 1)) for i in members]
        item = np.repeat(members, [len(a) for a in at])
        flat = np.concatenate(at)
        keys = np.concatenate([k for w in range(WALKS) for k in walk_keys(_padded(words, size), flat, size, w)])
        order = np.argsort(keys, kind="stable")
        unique = np.unique(np.concatenate(pairs))
        bits = min(_BLOOM_BITS, max(10, (64 * len(unique)).bit_length()))
        bloom = np.zeros(1 << bits, dtype=bool)
        bloom[(unique >> np.uint64(64 - bits)).astype(np.int64)] = True
        least = max(1, size - 1 - spoiled_pairs(size))
        repeats = WALKS * DRAWS
        place = (flat - bounds[item]).astype(np.int32)
        sizes[size] = SizeIndex(bloom, bits, unique, least, keys[order], np.tile(item.astype(np.int32), repeats)[order], np.tile(place, repeats)[order])
    return Index(np.array(ids, dtype=np.int64), words, bounds, sizes)


def _padded(words: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate([words, np.zeros(size + 1, dtype=np.uint64)])


def candidates(index: Index, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, diagonal) of window pairs that share an LSH key.

    The diagonal is the place in ``words`` that the passage's first word would
    have.
    """
    found = []
    pairs = pairs_of(words) if len(words) > 1 else np.zeros(0, dtype=np.uint64)
    for size, part in index.sizes.items():
        if size == 1:
            at = np.flatnonzero(np.isin(words, index.words))
        else:
            maybe = np.flatnonzero(part.bloom[(pairs >> np.uint64(64 - part.bits)).astype(np.int64)])
            hit = np.zeros(len(pairs) + 1, dtype=np.int32)
            hit[maybe[np.isin(pairs[maybe], part.pairs)] + 1] = 1
            run = np.cumsum(hit, out=hit)
            if len(run) <= size - 1:
                continue
            at = np.flatnonzero(run[size - 1 :] - run[: -(size - 1)] >= part.least)
        if not len(at):
            continue
        text = np.searchsorted(bounds, at, side="right") - 1
        keep = at + size <= bounds[text + 1]
        at, text = at[keep], text[keep]
        padded = _padded(words, size)
        for walk in range(WALKS):
            for keys in walk_keys(padded, at, size, walk):
                low, high = np.searchsorted(part.keys, keys, "left"), np.searchsorted(part.keys, keys, "right")
                n = high - low
                which = np.repeat(np.arange(len(at)), n)
                entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                found.append(np.stack([text[which], part.item[entry], at[which] - part.place[entry]], axis=1))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[:, 0], rows[:, 1], rows[:, 2]


def _aligned(index: Index, words: np.ndarray, bounds: np.ndarray, text: np.ndarray, item: np.ndarray, diagonal: np.ndarray, band: int) -> np.ndarray:
    """equal[c, place, shift]: the passage's word stands at that place of the
    text, shifted by up to ``band`` words from the diagonal."""
    width = int(np.diff(index.bounds)[item].max())
    place = np.arange(width)
    own = index.bounds[item][:, None] + place
    inside = own < index.bounds[item + 1][:, None]
    passage = index.words[np.minimum(own, len(index.words) - 1)]
    spot = diagonal[:, None, None] + place[None, :, None] + np.arange(-band, band + 1)[None, None, :]
    valid = (spot >= bounds[text][:, None, None]) & (spot < bounds[text + 1][:, None, None]) & inside[:, :, None]
    there = words[np.clip(spot, 0, len(words) - 1)]
    return (there == passage[:, :, None]) & valid


def _band(n_words: np.ndarray) -> int:
    """How far the words of a match may stand from its diagonal: by as many
    words as a whole passage may have put in or left out."""
    return max(6, int(n_words.max()) // PER_EDIT + _TOGETHER // 2)


def verify(equal: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Whether some stretch holds enough of the passage within the edits allowed.

    Edit alignment over a band: best[e, shift] is the most words held by a
    stretch that ends at this place with e edits.  A stretch counts if it holds
    two fifths of the passage and seven words or more for each edit.
    """
    count, width, band = equal.shape
    most = max(1, int(n_words.max()) // PER_EDIT)
    least = np.array([needed(int(n)) for n in n_words])
    limit = np.maximum(least[:, None], PER_EDIT * np.arange(most + 1)[None, :])[:, :, None]
    low = -(10**6)
    best = np.full((count, most + 1, band), low, dtype=np.int32)
    best[:, 0, :] = 0
    found = np.zeros(count, dtype=bool)
    for place in range(width):
        step = np.where(equal[:, place, None, :], best + 1, low)
        step[:, 1:, :] = np.maximum(step[:, 1:, :], best[:, :-1, :])  # altered
        step[:, 1:, :-1] = np.maximum(step[:, 1:, :-1], best[:, :-1, 1:])  # left out
        step[:, 0, :] = np.maximum(step[:, 0, :], 0)
        for e in range(most):  # put in
            step[:, e + 1, 1:] = np.maximum(step[:, e + 1, 1:], step[:, e, :-1])
        best = step
        found |= (best >= limit).any(axis=(1, 2))
    return found


def matches(index: Index, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Unique (text, item) pairs that hold, among the candidates."""
    text, item, diagonal = candidates(index, words, bounds)
    found: list[np.ndarray] = []
    # Five neighbouring diagonals of a pair are one candidate; the band covers them.
    near_by = np.unique(np.stack([text, item, diagonal // _TOGETHER], axis=1), axis=0)
    text, item, diagonal = near_by[:, 0], near_by[:, 1], near_by[:, 2] * _TOGETHER + _TOGETHER // 2
    n_words = np.diff(index.bounds)
    for at in range(0, len(text), 256):
        t, i, d = text[at : at + 256], item[at : at + 256], diagonal[at : at + 256]
        band = _band(n_words[i])
        near = _aligned(index, words, bounds, t, i, d, band).any(axis=2).cumsum(axis=1)
        # A bound that no match fails: a stretch that just holds enough words spans
        # no more words of the passage than these and the edits allowed with them.
        least = np.array([needed(int(n)) for n in n_words[i]])
        lead = np.concatenate([np.zeros((len(t), 1), dtype=near.dtype), near], axis=1)
        ends = np.minimum(np.arange(lead.shape[1])[None, :] + (least + least // PER_EDIT)[:, None], lead.shape[1] - 1)
        likely = (np.take_along_axis(lead, ends, axis=1) - lead).max(axis=1) >= least
        t, i, d = t[likely], i[likely], d[likely]
        for part in range(0, len(t), 32):
            chosen = slice(part, part + 32)
            good = verify(_aligned(index, words, bounds, t[chosen], i[chosen], d[chosen], _band(n_words[i[chosen]])), n_words[i[chosen]])
            found.append(np.stack([t[chosen][good], i[chosen][good]], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)


def _blocks(items: DataFrame) -> Iterator[Index]:
    ids: list[int] = []
    passages: list[str] = []
    size = 0
    for row in items.toLocalIterator():
        ids.append(row[0])
        passages.append(row[1])
        size += len(row[1].split()) * _WORD_BYTES
        if size >= BLOCK_BYTES:
            yield build_index(ids, passages)
            ids, passages, size = [], [], 0
    if ids:
        yield build_index(ids, passages)


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): every document with the items that it holds.

    ``documents`` has doc_id and text, ``items`` item_id and passage; further
    columns are ignored.  Case, accents, character width, invisible characters,
    punctuation, markup and line breaks do not matter.  Null or blank texts and
    passages match nothing; repeated documents or items are reported each; an
    empty table gives an empty result.
    """
    source = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    queries = items.where("passage is not null").select(F.col("item_id").cast("long").alias("item_id"), "passage")
    schema = "doc_id long, item_id long"
    result = None
    for index in _blocks(queries):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                for low, high in text_slices(texts):
                    words, bounds = hashed_words([plain_bytes(t) for t in texts[low:high]])
                    pairs = matches(block, words, bounds)
                    yield pa.record_batch([ids.take(pa.array(pairs[:, 0] + low)), pa.array(block.ids[pairs[:, 1]])], names=["doc_id", "item_id"])

        part = source.mapInArrow(run, schema)
        result = part if result is None else result.unionByName(part)
    return result if result is not None else documents.sparkSession.createDataFrame([], schema)
