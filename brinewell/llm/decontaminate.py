"""Benchmark decontamination by a distributed positional inverted index over the training documents.

The index is made once, of all words of all documents, and stored. It is
partitioned by document, as search engines shard theirs: a row is a shard of
some thousand documents with its sorted terms and, for each term, the list of
its positions in the shard, so building and reading it needs no shuffle of
words. Documents lie GAP positions apart, so nothing matches across them.

A window (phrase) of a benchmark item is looked up from its rarest term by the
corpus' document frequencies: that term's positions, less its offset, are the
candidate starts, which are intersected with the offset-adjusted lists of the
other terms from rare to common. Windows with a term that a shard lacks are
passed over there.

Benchmark items are taken in blocks of at most BLOCK_WORDS words, which bounds
what is sent to the executors; each block reads the stored index, not the
documents. Terms are 64-bit hashes of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewell.llm.text import word_hashes
from brinewell.plans.lineage import cut

WINDOW = 10
#: Words of benchmark text that one pass over the index takes.
BLOCK_WORDS = 1_000_000
#: Words of a shard, about; a longer document is a shard of its own.
SHARD_WORDS = 1 << 17
#: Free positions between the documents of a shard; windows and slop may not exceed it.
GAP = 256
#: Candidate starts of one shard that are held at a time, about; all are tried.
CANDIDATES = 500_000
#: Rarest terms of a window that make a proximity match, and words within which they lie, in production.
NEAR_TERMS = 4
SLOP = 12

#: Bytes that are no part of a word, once A-Z is lower-cased, become spaces.
_BLANK = bytes(32 if b < 0x30 or 0x3A <= b < 0x61 or 0x7B <= b < 0x80 else b for b in range(256))

#: Of each document its row, id, words and first position; of each term its hash, documents, occurrences and positions, one list after the other.
_LISTS = ("rows", "ids", "known", "n_words", "bases", "terms", "documents", "counts", "positions")
_TYPES = dict(zip(_LISTS, (np.int64, np.int64, np.bool_, np.int64, np.int64, np.uint64, np.int32, np.int32, np.int32)))
INDEX = ", ".join(f"{c} binary" for c in _LISTS)
_INDEX = pa.schema([(c, pa.binary()) for c in _LISTS])
_MATCHES = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))])
MATCHES = "row long, id long, n_words long, hits array<int>, items array<string>, near_items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_BLANK).split()


class Windows:
    """The distinct windows of a block of items, as arrays; terms are places in ``vocabulary``, sorted hashes."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        hashes = word_hashes([w for _, words in items for w in words])
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        found: dict[tuple[int, ...], set[str]] = {}
        first = 0
        for item, words in items:
            own = ids[first : first + len(words)].tolist()
            first += len(words)
            k = min(size, len(own))
            for at in range(len(own) - k + 1 if k else 0):
                found.setdefault(tuple(own[at : at + k]), set()).add(item)
        self.items = [sorted(x) for x in found.values()]
        self.length = np.array([len(x) for x in found], np.int64)
        self.terms = np.full((len(found), size), -1, np.int32)
        for i, x in enumerate(found):
            self.terms[i, : len(x)] = x

    def rank(self, frequency: np.ndarray) -> None:
        """Order each window's offsets from its rarest term on, and list the windows by that term."""
        cost = np.where(self.terms >= 0, frequency[self.terms], np.iinfo(np.int64).max)
        self.order = np.argsort(cost, axis=1, kind="stable").astype(np.int16)
        self.ranked = np.take_along_axis(self.terms, self.order, 1)
        self.by_anchor = np.argsort(self.ranked[:, 0], kind="stable")
        self.first = np.searchsorted(self.ranked[self.by_anchor, 0], np.arange(len(self.vocabulary) + 1))

    def rank_near(self) -> None:
        """After ``rank``: the distinct sets of rarest terms, listed by the rarest one, and the items of each."""
        rare = self.ranked[:, :NEAR_TERMS]
        self.rare, of = np.unique(np.where(rare < 0, rare[:, :1], rare), axis=0, return_inverse=True)
        items: list[set[str]] = [set() for _ in self.rare]
        for own, k in zip(self.items, of.ravel().tolist(), strict=True):
            items[k].update(own)
        self.rare_items = [sorted(x) for x in items]
        self.rare_first = np.searchsorted(self.rare[:, 0], np.arange(len(self.vocabulary) + 1))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    block, size = [], 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).where(F.col(item_col).isNotNull()).toLocalIterator():
        words = words_of(text)
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((item, words))
        size += len(words)
    if block:
        yield block


def _invert(docs: list[tuple[int, int | None, list[bytes]]]) -> list[bytes]:
    """One shard of the index."""
    n_words = np.array([len(w) for *_, w in docs], np.int64)
    bases = np.cumsum(n_words + GAP) - n_words - GAP
    hashes = word_hashes([w for *_, words in docs for w in words])
    places = np.repeat(bases - np.cumsum(n_words) + n_words, n_words) + np.arange(len(hashes))
    order = np.argsort(hashes, kind="stable")
    positions = places[order]
    terms, first, counts = np.unique(hashes[order], return_index=True, return_counts=True)
    doc = np.searchsorted(bases, positions, "right") - 1
    fresh = np.ones(len(doc), np.int64)
    fresh[1:] = doc[1:] != doc[:-1]
    fresh[first] = 1
    documents = np.add.reduceat(fresh, first) if len(first) else fresh
    lists = ([r for r, *_ in docs], [i or 0 for _, i, _ in docs], [i is not None for _, i, _ in docs], n_words, bases, terms, documents, counts, positions)
    return [np.asarray(x).astype(t).tobytes() for x, t in zip(lists, _TYPES.values(), strict=True)]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held, size = [], 0
        for k in range(batch.num_rows):
            words = words_of(batch.column(2)[k].as_py())
            held.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), words))
            size += len(words) + GAP
            if size > SHARD_WORDS or k == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in _invert(held)], schema=_INDEX)
                held, size = [], 0


def _lists(batch: pa.RecordBatch, k: int) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(batch.column(c)[k].as_buffer(), _TYPES[c]) for c in batch.schema.names}


def _frequencies(vocabulary):
    """``(term, n)`` of the terms that are asked for: documents of a shard that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary.value
        sums = np.zeros(len(own), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                shard = _lists(batch, k)
                at = np.minimum(np.searchsorted(own, shard["terms"]), len(own) - 1)
                met = own[at] == shard["terms"]
                sums[at[met]] += shard["documents"][met]
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["term", "n"])

    return run


class _Shard:
    """One shard's posting lists as far as they hold terms of ``windows``."""

    def __init__(self, windows: Windows, lists: dict[str, np.ndarray]):
        self.docs = lists
        at = np.minimum(np.searchsorted(windows.vocabulary, lists["terms"]), len(windows.vocabulary) - 1)
        self.own = np.flatnonzero(windows.vocabulary[at] == lists["terms"])
        self.terms = at[self.own]
        ends = np.cumsum(lists["counts"].astype(np.int64))
        self.count = lists["counts"][self.own].astype(np.int64)
        self.start = ends[self.own] - self.count
        self.slot = np.full(len(windows.vocabulary), -1, np.int64)
        self.slot[self.terms] = np.arange(len(self.terms))
        # The lists of these terms as one sorted list of numbers, so that many lists are searched at once.
        self.stride = int(lists["bases"][-1] + lists["n_words"][-1]) + 2 * GAP
        self.first = np.cumsum(self.count) - self.count
        self.positions = lists["positions"][self._ranges(self.start, self.count)].astype(np.int64)
        self.keys = np.append(np.repeat(np.arange(len(self.terms)), self.count) * self.stride + self.positions, np.iinfo(np.int64).max)

    @staticmethod
    def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))

    def drawn(self, slots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For lists, in parts of about CANDIDATES positions: the place in ``slots`` and the position of each."""
        count = self.count[slots]
        part = np.cumsum(count) // CANDIDATES
        for k in np.unique(part):
            a, b = np.searchsorted(part, k, "left"), np.searchsorted(part, k, "right")
            yield np.repeat(np.arange(a, b), count[a:b]), self.positions[self._ranges(self.first[slots[a:b]], count[a:b])]

    def within(self, slots: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each list has a position from ``low`` (not negative) to below ``high``."""
        return self.keys[np.searchsorted(self.keys, slots * self.stride + low)] < slots * self.stride + high

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.docs["bases"], positions, "right") - 1

    def phrases(self, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Starts and windows of all exact matches."""
        runs = w.first[self.terms + 1] - w.first[self.terms]
        windows = w.by_anchor[self._ranges(w.first[self.terms], runs)]
        slots = np.where(w.ranked[windows] >= 0, self.slot[w.ranked[windows]], np.iinfo(np.int64).max)
        windows, slots = windows[(slots >= 0).all(1)], slots[(slots >= 0).all(1)]
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for of, position in self.drawn(slots[:, 0]):
            begin = position - w.order[windows[of], 0]
            of, begin = of[begin >= 0], begin[begin >= 0]
            for k in range(1, slots.shape[1]):
                if not len(of):
                    break
                over = w.length[windows[of]] <= k
                at = begin + w.order[windows[of], k]
                keep = over | self.within(np.where(over, 0, slots[of, k]), at, at + 1)
                of, begin = of[keep], begin[keep]
            out.append((begin, windows[of]))
        begin, window = (np.concatenate(x) for x in zip(*out, strict=True))
        return begin, window

    def near(self, w: Windows, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and sets of rarest terms (rows of ``w.rare``) that all occur within ``slop`` words of it, in any order."""
        runs = w.rare_first[self.terms + 1] - w.rare_first[self.terms]
        own = self._ranges(w.rare_first[self.terms], runs)
        slots = self.slot[w.rare[own]]
        own, slots = own[(slots >= 0).all(1)], slots[(slots >= 0).all(1)]
        n = len(self.docs["bases"])
        found = [np.empty(0, np.int64)]
        for of, p in self.drawn(slots[:, 0]):
            for k in range(1, slots.shape[1]):  # each other term on either side of the rarest one
                keep = self.within(slots[of, k], np.maximum(p - slop + 1, 0), p + slop)
                of, p = of[keep], p[keep]
            for back in range(slop):  # then all terms in one stretch that holds it
                if not len(of):
                    break
                low = np.maximum(p - back, 0)
                ok = np.ones(len(of), bool)
                for k in range(1, slots.shape[1]):
                    ok &= self.within(slots[of, k], low, low + slop)
                pair = of * n + self.document(p)
                found.append(np.unique(pair[ok]))
                rest = ~np.isin(pair, found[-1])
                of, p = of[rest], p[rest]
        pairs = np.unique(np.concatenate(found))
        return pairs % n, own[pairs // n]


def _grouped(docs: np.ndarray, values: np.ndarray, names: list[list[str]], n: int) -> list[list[str]]:
    """For each document the sorted names of its values."""
    out: list[set[str]] = [set() for _ in range(n)]
    for d, v in zip(docs.tolist(), values.tolist(), strict=True):
        out[d].update(names[v])
    return [sorted(x) for x in out]


def _match(windows, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = windows.value
        for batch in batches:
            for k in range(batch.num_rows):
                lists = _lists(batch, k)
                shard, n, bases = _Shard(w, lists), len(lists["rows"]), lists["bases"]
                begin, window = shard.phrases(w)
                hit = np.zeros(shard.stride + 1, np.int32)
                np.add.at(hit, begin, 1)
                np.add.at(hit, begin + w.length[window], -1)
                places = np.flatnonzero(np.cumsum(hit))
                doc = shard.document(places)
                hits = np.split((places - bases[doc]).astype(np.int32), np.searchsorted(doc, np.arange(1, n)))
                pairs = np.unique(np.stack([shard.document(begin), window]), axis=1)
                items = _grouped(pairs[0], pairs[1], w.items, n)
                near = _grouped(*shard.near(w, slop), w.rare_items, n) if slop else [[]] * n
                cols = [pa.array(lists["rows"]), pa.array(lists["ids"], mask=~lists["known"]), pa.array(lists["n_words"])]
                cols += [pa.array(hits, pa.list_(pa.int32())), *(pa.array(x, pa.list_(pa.string())) for x in (items, near))]
                yield pa.RecordBatch.from_arrays(cols, schema=_MATCHES)

    return run


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """``(id, n_words, hits, items, near_items)``, one row per row of ``docs``.

    ``hits``: positions of words inside an occurrence of any window, i.e.
    ``window`` consecutive words of an item (all its words if it has fewer).
    ``items``: sorted ids, as strings, of items with an occurring window.
    ``near_items``: with ``slop`` over 0, items with a window whose rarest
    NEAR_TERMS terms occur within ``slop`` words in any order; rare is what few
    documents have, of equal terms the first in the window.

    Words are runs of 0-9, A-Z (lower-cased), a-z and non-ASCII characters.
    Null texts have no words; items with a null id or without words are no
    items; items that share an id count as one; an empty benchmark hits
    nothing. Repeated rows and ids each give their row; other columns, of
    whatever name, are not read. An empty table gives no rows.
    """
    if max(window, slop) > GAP:
        raise ValueError(f"window and slop may not exceed {GAP}")
    spark = docs.sparkSession
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    index = cut(source.mapInArrow(_index, INDEX), "index")
    out = None
    several = False
    blocks = _blocks(benchmark, item_col, item_text_col)
    for block in chain([next(blocks, [])], blocks):
        w = Windows(block, window)
        if not len(w.vocabulary):
            w.vocabulary = np.zeros(1, np.uint64)
        counted = index.select("terms", "documents").mapInArrow(_frequencies(spark.sparkContext.broadcast(w.vocabulary)), "term long, n long")
        frequency = np.zeros(len(w.vocabulary), np.int64)
        for term, n in counted.groupBy("term").agg(F.sum("n")).collect():  # a row for each test term at most
            frequency[term] = n
        w.rank(frequency)
        if slop:
            w.rank_near()
        found = index.mapInArrow(_match(spark.sparkContext.broadcast(w), slop), MATCHES)
        some = (F.size("hits") > 0) | (F.size("near_items") > 0)
        out, several = (found, False) if out is None else (out.union(found.where(some)), True)
    if several:
        merge = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "items", "near_items")]
        out = out.groupBy("row").agg(F.first("id").alias("id"), F.max("n_words").alias("n_words"), *merge)
    return out.drop("row")
