"""Benchmark decontamination: rare seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, A-Z lower-cased. A copy of an item scores at least a threshold's share of a perfect copy in local
alignment, so it has at least that share of the item's words, within a passage whose length follows from the threshold too. Seeds
are the item's rarest words by a count over all documents, as many as it takes for every copy to hold several of them. A place where that many
seeds of an item come together is a candidate, and the passage around it is aligned with the item. So no copy that
reaches the threshold is missed, whichever words were edited: seeds of several words in a row would miss copies with an edit in each of them.

Documents are scanned twice, to count and to find; nothing is shuffled but counts and findings, so hot sources and groups of
copies change nothing. Items are sent to all tasks in blocks of bounded size.

Null and empty texts and items match nothing. An item of fewer than `SHORT` words (a parameter) matches as a whole only, with all its words in a row. Rows with
equal doc_id are one document in the result of `contaminated`, and the best of them counts; a null doc_id is left out of it, a null item_id isn't.
`decontaminated` looks at each row by itself, whatever its doc_id. Equal items are reported each. Empty input gives an
empty result; other columns are ignored, and kept by `decontaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import table
from quillon.llm.textkernel import buffers, ragged, releasing, slices, word_hashes

SHORT = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of a perfect copy's score from which a passage counts as a copy.
THRESHOLD = 0.5
#: Bytes of items (8 for each word) that are sent to the tasks at once; more are taken in blocks, each with its own scans.
ITEM_BYTES = 64 << 20
#: Words of texts whose seeds are looked up at once, and words of passages that are aligned at once.
SEGMENT, CELLS = 1 << 16, 1 << 15
#: Bytes of text that a task works on at once.
TEXT_BYTES = 1 << 20


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        value, _, _, begins = word_hashes(*buffers(batch.column("text")), letters_only=True)
        parts = [value[a:b] for a, b in zip(begins[:-1], begins[1:], strict=True)]
        yield pa.record_batch([batch.column("item_id").cast(pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["item_id", "n", "words"])


@dataclass
class Index:
    """Items of one block, and which of them have which seeds."""

    ids: list[int | None]
    words: list[np.ndarray]
    share: np.ndarray  # of each item: of a perfect copy's score, what a copy has at least
    need: np.ndarray  # seeds that every copy holds
    window: np.ndarray  # words over which a copy may reach
    seeds: np.ndarray  # sorted
    first: np.ndarray  # of each seed: where its items begin in owners, and their end
    owners: np.ndarray


def index(ids: list[int | None], words: list[np.ndarray], known: np.ndarray, counts: np.ndarray, threshold: float, short: int = SHORT) -> Index:
    """known, counts: words in order, and how often each occurs in all documents; others don't."""
    seeds, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    sizes = np.array([len(w) for w in words], np.int64)
    share = np.where(sizes < short, 1.0, threshold)
    least = np.maximum(1, np.ceil(sizes * share - 1e-9).astype(np.int64))  # words that a copy has at least: each earns MATCH at most
    need = np.maximum(1, least // 3)
    window = sizes + (MATCH * sizes * (1 - share) / -GAP).astype(np.int64)  # the words put in cost as much as it may lose
    for i, item in enumerate(words):
        at = np.minimum(np.searchsorted(known, item), max(0, len(known) - 1))
        often = np.where(known[at] == item, counts[at], 0) if len(known) else np.zeros(len(item), np.int64)
        mine = np.unique(item[np.lexsort((np.arange(len(item)), item, often))[: len(item) - least[i] + need[i]]])
        seeds.append(mine)
        owners.append(np.full(len(mine), i, np.int32))
    seed, owner = np.concatenate(seeds), np.concatenate(owners)
    order = np.argsort(seed, kind="stable")
    distinct, first = np.unique(seed[order], return_index=True)
    return Index(ids, words, share, need, window, distinct, np.r_[first, len(seed)], owner[order])


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and where in the passage it ends (exclusive)."""
    best, end = 0, 0
    steps = np.arange(len(passage) + 1) * GAP
    above = np.zeros(len(passage) + 1, np.int64)
    for word in item:
        here = np.zeros_like(above)
        here[1:] = np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(here, 0, out=here)
        above = np.maximum.accumulate(here - steps) + steps  # gaps along the passage
        at = int(above.argmax())
        if above[at] > best:
            best, end = int(above[at]), at
    return best, end


def best_scores(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Best local alignment scores of (item, passage) pairs, many at once: shorter ones are filled up with words that match nothing."""
    out = np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda k: len(pairs[k][1]))
    at = 0
    while at < len(order):
        some = [order[at]]
        while at + len(some) < len(order) and (len(some) + 1) * len(pairs[order[at + len(some)]][1]) <= CELLS:
            some.append(order[at + len(some)])
        at += len(some)
        width, length = len(pairs[some[-1]][1]), max(len(pairs[k][0]) for k in some)
        item, passage = np.zeros((length, len(some), 1), np.uint64), np.ones((len(some), width), np.uint64)
        for k, pair in enumerate(some):
            item[: len(pairs[pair][0]), k, 0], passage[k, : len(pairs[pair][1])] = pairs[pair]
        steps = np.arange(width + 1, dtype=np.int32) * GAP
        above, best = np.zeros((len(some), width + 1), np.int32), np.zeros(len(some), np.int32)
        for word in item:
            here = np.zeros_like(above)
            np.maximum(above[:, :-1] + np.where(passage == word, np.int32(MATCH), np.int32(MISMATCH)), above[:, 1:] + GAP, out=here[:, 1:])
            np.maximum(here, 0, out=here)
            here -= steps
            above = np.maximum.accumulate(here, axis=1) + steps
            np.maximum(best, above.max(1), out=best)
        out[some] = best
    return out


def candidates(value: np.ndarray, begins: np.ndarray, items: Index) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Passages (from, to) in which items may have a copy, by (row, item). value: the words of all rows; begins: where rows begin."""
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    if not len(items.seeds) or not len(value):
        return found
    reach = int(items.window.max())
    for a in range(0, len(value), SEGMENT):
        part = value[a : a + SEGMENT + reach]
        at = np.minimum(np.searchsorted(items.seeds, part), len(items.seeds) - 1)
        hit = np.flatnonzero(items.seeds[at] == part)
        first = items.first[at[hit]]
        n = items.first[at[hit] + 1] - first
        owner, place = items.owners[ragged(first, n)], np.repeat(hit + a, n)
        row = np.searchsorted(begins, place, "right") - 1
        order = np.argsort(owner, kind="stable")  # places stay in order
        owner, place, row = owner[order], place[order], row[order]
        last = np.arange(len(owner)) + items.need[owner] - 1
        some = np.flatnonzero(last < len(owner))
        last = last[some]
        near = (owner[some] == owner[last]) & (row[some] == row[last]) & (place[last] - place[some] < items.window[owner[some]])
        for r, i, low, high in zip(row[some][near].tolist(), owner[some][near].tolist(), place[some][near].tolist(), place[last][near].tolist(), strict=True):
            w = int(items.window[i])
            low, high = max(int(begins[r]), high - w + 1), min(int(begins[r + 1]), low + w)
            mine = found.setdefault((r, i), [])
            if mine and low <= mine[-1][1]:
                mine[-1] = min(mine[-1][0], low), max(mine[-1][1], high)
            else:
                mine.append((low, high))
    return found


def copies(texts: pa.Array, items: Index) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, end) of the best copy of each item in each row."""
    value, _, _, begins = word_hashes(*buffers(texts), letters_only=True)
    places = [(row, i, a, b) for (row, i), passages in candidates(value, begins, items).items() for a, b in passages]
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    for (row, i, a, b), score in zip(places, best_scores([(items.words[i], value[a:b]) for _, i, a, b in places]).tolist(), strict=True):
        if score >= items.share[i] * MATCH * len(items.words[i]) - 1e-9:
            found[row, i] = max(found.get((row, i), (0, 0, 0)), (score, a, b))
    for (row, i), (score, a, b) in found.items():
        item = items.words[i]
        _, end = align(item, value[a:b])
        _, length = align(item[::-1], value[a : a + end][::-1])
        yield row, i, score / (MATCH * len(item)), a + end - length - int(begins[row]), a + end - int(begins[row])


def _count(shared):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        total = np.zeros(len(words), np.int64)
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                value, *_ = word_hashes(*buffers(part.column("text")), letters_only=True)
                at = np.minimum(np.searchsorted(words, value), len(words) - 1)
                total += np.bincount(at[words[at] == value], minlength=len(words))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(words[some].view(np.int64)), pa.array(total[some])], names=["word", "n"])

    return run


def _indexes(docs: DataFrame, items: DataFrame, threshold: float, short: int) -> Iterator[Index]:
    """The items of one block after the other. docs: (text)."""
    spark = docs.sparkSession
    words = table(items.select("item_id", "text").mapInArrow(_item_words, "item_id bigint, n bigint, words binary").where(F.col("n") > 0), "items")
    blocks = -(-8 * (words.agg(F.sum("n")).first()[0] or 0) // ITEM_BYTES)
    for b in range(blocks):
        rows = words.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == b).select("item_id", "words").toArrow()
        ids, sequences = rows.column("item_id").to_pylist(), [np.frombuffer(w, np.uint64) for w in rows.column("words").to_pylist()]
        if ids:
            distinct = spark.sparkContext.broadcast(np.unique(np.concatenate(sequences)))
            counts = docs.select("text").mapInArrow(_count(distinct), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
            known, n = counts.column("word").to_numpy().view(np.uint64), counts.column("n").to_numpy()
            order = np.argsort(known)
            yield index(ids, sequences, known[order], n[order], threshold, short)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, short: int = SHORT) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word) of every document that holds a copy of an item; one row per pair."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())])
    names = "doc_id bigint, item_id bigint, score double, start_word bigint, end_word bigint"

    def finder(shared):
        @releasing
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for part in slices(batch, "text", TEXT_BYTES):
                    doc_ids = part.column("doc_id")
                    out = [(doc_ids[r].as_py(), block.ids[i], *where) for r, i, *where in copies(part.column("text"), block)]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)

        return run

    found = spark.createDataFrame([], names)
    for block in _indexes(docs, items, threshold, short):
        found = found.union(docs.mapInArrow(finder(spark.sparkContext.broadcast(block)), names))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "start_word", "end_word")).alias("b"))
    return best.select("doc_id", "item_id", "b.score", "b.start_word", "b.end_word")


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, short: int = SHORT) -> DataFrame:
    """The rows of docs that hold no copy of an item."""

    def keeper(shared):
        @releasing
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", TEXT_BYTES):
                    keep = np.ones(part.num_rows, bool)
                    keep[[r for r, *_ in copies(part.column("text"), shared.value)]] = False
                    yield part.filter(pa.array(keep))

        return run

    left = docs
    for block in _indexes(docs, items, threshold, short):
        left = left.mapInArrow(keeper(docs.sparkSession.sparkContext.broadcast(block)), docs.schema)
    return left
