"""Toxicity by nearest labelled examples.

A bounded sample of labelled documents is the example set. All their terms are its vocabulary; a term weighs its inverse frequency in
all documents, and a term whose presence among the examples goes with the label (chi-squared) weighs `1 / FAINT` times as much as others,
so that likeness is first of all likeness in what the label is about. The nearest examples of a document are found exactly, by cosine over all
terms: the inverted index is cut into blocks of examples with the greatest weight of each term in each block, and blocks are scored in
order of the bound this gives until no other can hold a nearer one. Votes weigh with similarity, and a monotone fit makes them
probabilities. It is made on the examples themselves: each by votes of those outside its fold, with term weights that are learnt outside it.
The nearest examples are returned as evidence.

Only texts are inputs of a score. A null or empty text, or one without a term of the examples, has no neighbour and gets what
such examples get; terms that no example has play no part in a document's norm. Repeated rows get equal scores; equal texts are one example, ties
between examples go to the earlier one. Where there are no labelled documents every score is 0. Other columns are kept by `scored`. A document with
several labels is toxic if any says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from quillon.llm.shared import table
from quillon.llm.textkernel import buffers, ragged, releasing, slices, word_hashes

#: The bounds of what is fitted: labelled examples, and distinct terms of all of them, counted for each. Examples are taken in pseudo-random order.
EXAMPLES, POSTINGS = 4000, 2_000_000
#: A term goes with the label if it is in that many examples, and its chi-squared is this much above twice the logarithm of the number of terms, of which the best would come near that by chance.
LEAST_EXAMPLES, ASSOCIATED = 3, 4.0
#: Weight of the other terms.
FAINT = 0.01
NEIGHBOURS, BLOCK = 15, 16
#: Terms of more than one in so many examples are dealt with as a matrix, for so many documents together.
FREQUENT, TOGETHER = 16, 32
#: Cells (a term's postings in a block) that are dealt with together, unless one document has more; blocks that are scored first.
CELLS, FIRST = 1 << 19, 16
#: Directions along which examples are put in order of likeness.
DIRECTIONS = 8
#: Bytes of text that a task works on at once.
TEXT_BYTES = 1 << 20
#: Weight of the prior among the votes.
PRIOR = 0.5
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows that labels are not learnt from: CRC-32 of the id's text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            value, _, _, begins = word_hashes(*buffers(part.column("text")), letters_only=True)
            bags = [np.unique(value[a:b], return_counts=True) for a, b in zip(begins[:-1], begins[1:], strict=True)]
            yield pa.record_batch([part.column("doc_id").cast(pa.int64()), part.column("toxic").cast(pa.int32()), pa.array([len(t) for t, _ in bags], pa.int64()), pa.array([t.tobytes() for t, _ in bags], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in bags], pa.binary())], names=["doc_id", "toxic", "n", "terms", "counts"])


@dataclass
class Examples:
    """Labelled examples as rows of a matrix of terms, by term: the postings of term t are first[t] to first[t + 1].

    This is what tasks get, in a few bytes for each posting; they make their models of it, once for each worker.
    """

    ids: np.ndarray
    labels: np.ndarray
    terms: np.ndarray  # sorted hashes
    idf: np.ndarray
    first: np.ndarray
    row: np.ndarray
    count: np.ndarray
    fold: np.ndarray  # equal texts are in one fold

    @classmethod
    def of(cls, bags: list[tuple[int, int, np.ndarray, np.ndarray]], frequency: dict[int, int], documents: int) -> Examples:
        """bags: (doc_id, label, terms, counts); frequency: documents that have a term."""
        every = np.concatenate([b[2] for b in bags] or [np.zeros(0, np.uint64)])
        count = np.concatenate([b[3] for b in bags] or [np.zeros(0, np.int32)])
        row = np.repeat(np.arange(len(bags)), [len(b[2]) for b in bags])
        terms, term = np.unique(every, return_inverse=True)
        have = np.array([frequency.get(t, 0) for t in terms.tolist()], float)
        idf = np.log((1 + documents) / (1 + have)) + 1
        order = np.argsort(term, kind="stable")
        term, row, count = term[order], row[order], count[order]
        first = np.searchsorted(term, np.arange(len(terms) + 1))
        fold = [int.from_bytes(hashlib.blake2b(b[2].tobytes() + b[3].tobytes(), digest_size=2).digest(), "big") % FOLDS for b in bags]
        narrow = lambda x: x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8)
        return cls(np.array([b[0] for b in bags], np.int64), np.array([b[1] for b in bags], np.int64), terms, idf, first, narrow(row), narrow(count), np.array(fold, np.int64))

    def term(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.terms)), np.diff(self.first))

    def bags(self, places: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, counts) of the examples at these places, which ascend."""
        mine = np.flatnonzero(np.isin(self.row, places))
        row, term, count = self.row[mine], self.term()[mine], self.count[mine].astype(np.int64)
        order = np.lexsort((term, row))
        cut = np.searchsorted(row[order], places)
        return [(term[some], count[some]) for some in np.split(order, cut[1:])]

    def model(self, but: int | None = None) -> Model:
        """The model of all examples, or of those outside a fold; the last one is kept."""
        kept = self.__dict__.get("kept")
        if kept is None or kept[0] != but:
            kept = self.__dict__["kept"] = but, Model(self, np.ones(len(self.labels), bool) if but is None else self.fold != but)
        return kept[1]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "kept"}

    def strength(self, rows: np.ndarray) -> np.ndarray:
        """Of each term 1 if it goes with the label among these examples, else FAINT."""
        mine = rows[self.row]
        term, row = self.term()[mine], self.row[mine]
        n, yes = int(rows.sum()), int(self.labels[rows].sum())
        have = np.bincount(term, minlength=len(self.terms)).astype(float)
        both = np.bincount(term, self.labels[row].astype(float), len(self.terms))
        spread = have * (n - have) * yes * (n - yes)
        chi = np.divide(n * (both * n - have * yes) ** 2, spread, out=np.zeros_like(have), where=spread > 0)
        known = max(1, int((have > 0).sum()))
        return np.where((chi >= ASSOCIATED + 2 * np.log(known)) & (have >= LEAST_EXAMPLES), 1.0, FAINT)


def nearest_of(who: np.ndarray, how: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The NEIGHBOURS greatest; ties go to the earlier one."""
    if len(how) > NEIGHBOURS:
        enough = how >= np.partition(how, -NEIGHBOURS)[-NEIGHBOURS] - 1e-11
        who, how = who[enough], how[enough]
    best = np.lexsort((who, -how.round(12)))[:NEIGHBOURS]
    return who[best], how[best]


def vote(how: np.ndarray, labels: np.ndarray, prior: float) -> float:
    return float((how @ labels + PRIOR * prior) / (how.sum() + PRIOR)) if len(how) else prior


def halved(points: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """rows in an order in which near ones of points come together: cut in half where they spread most, again and again, down to blocks."""
    if len(rows) <= BLOCK:
        yield rows
        return
    mine = points[rows]
    rows = rows[np.argsort(mine[:, mine.var(axis=0).argmax()], kind="stable")]
    half = (len(rows) // 2 + BLOCK - 1) // BLOCK * BLOCK
    yield from halved(points, rows[:half])
    yield from halved(points, rows[half:])


def likeness_order(term: np.ndarray, row: np.ndarray, post: np.ndarray, n: int) -> np.ndarray:
    """Rows (0 to n - 1) such that blocks hold alike ones, judged by the main directions of their frequent terms."""
    have = np.bincount(term) if len(term) else np.zeros(0, np.int64)
    column = np.cumsum(have * FREQUENT > n) - 1
    frequent = (have * FREQUENT > n)[term] if len(term) else np.zeros(0, bool)
    if not frequent.any():
        return np.arange(n)
    matrix = np.zeros((n, int(column[-1]) + 1))
    matrix[row[frequent], column[term[frequent]]] = post[frequent]
    _, vectors = np.linalg.eigh(matrix.T @ matrix)
    return np.concatenate(list(halved(matrix @ vectors[:, -DIRECTIONS:], np.arange(n))))


class Model:
    """Block-max index of examples. Blocks hold examples that are alike, so that few of them can hold the nearest ones of a document."""

    def __init__(self, examples: Examples, rows: np.ndarray):
        """rows: which examples are indexed; term strengths are learnt from these alone."""
        self.ids, self.labels, self.terms = examples.ids[rows], examples.labels[rows], examples.terms
        mine = rows[examples.row]
        self.weight = examples.idf * examples.strength(rows)
        self.prior = float(self.labels.mean()) if len(self.labels) else 0.0
        term, row = examples.term()[mine], (np.cumsum(rows) - 1)[examples.row[mine]].astype(np.int32)
        raw = (1 + np.log(examples.count[mine].astype(float))) * self.weight[term]
        norm = np.sqrt(np.bincount(row, raw**2, len(self.labels)))
        post = raw / norm[row]
        self.back = likeness_order(term, row, post, len(self.labels))  # the example at each place of the index
        place = np.empty(len(self.back), np.int32)
        place[self.back] = np.arange(len(self.back))
        sort = np.lexsort((place[row], term))
        term, self.row, self.post = term[sort], place[row[sort]], post[sort]
        # cells: the postings of one term in one block
        self.starts = np.arange(0, len(self.labels), BLOCK)
        cell = term * max(1, len(self.starts)) + self.row // BLOCK
        at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        self.cell_first = np.r_[at, len(cell)].astype(np.int32)
        self.cell_block = (self.row[at] // BLOCK).astype(np.int32)
        self.cell_most = np.maximum.reduceat(self.post, at) if len(at) else np.zeros(0)
        self.term_cells = np.searchsorted(term[at], np.arange(len(self.terms) + 1))
        self.dense: tuple[np.ndarray, np.ndarray] | None = None
        #: Blocks that were scored, of all that there were.
        self.scored, self.blocks = 0, 0

    def vector(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        weight = (1 + np.log(count)) * self.weight[term]
        return weight / np.sqrt((weight**2).sum())

    def _frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """(column of each term or -1, matrix of these columns and examples) of terms that more than one in FREQUENT examples has: their part is a matrix product."""
        if self.dense is None:
            begin = self.cell_first[self.term_cells]
            chosen = np.flatnonzero(np.diff(begin) * FREQUENT > len(self.labels))
            column = np.full(len(self.terms), -1)
            column[chosen] = np.arange(len(chosen))
            matrix = np.zeros((len(chosen), len(self.labels)))
            n = begin[chosen + 1] - begin[chosen]
            post = ragged(begin[chosen], n)
            matrix[np.repeat(np.arange(len(chosen)), n), self.row[post]] = self.post[post]
            self.dense = column, matrix
        return self.dense

    def nearest(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(examples, similarities) of the nearest ones of each bag (terms, counts), exactly."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        some, cells = [], 0
        for bag in bags:
            n = int((self.term_cells[bag[0] + 1] - self.term_cells[bag[0]]).sum())
            if some and (len(some) == TOGETHER or cells + n > CELLS):
                out += self._nearest(some)
                some, cells = [], 0
            some.append(bag)
            cells += n
        return out + self._nearest(some) if some else out

    def _nearest(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        n, blocks = len(self.labels), len(self.starts)
        if not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(bags)
        column, matrix = self._frequent()
        term = np.concatenate([t for t, _ in bags])
        weight = np.concatenate([self.vector(t, c) if len(t) else np.zeros(0) for t, c in bags])
        doc = np.repeat(np.arange(len(bags)), [len(t) for t, _ in bags])
        there = column[term] >= 0
        frequent = np.zeros((len(bags), len(matrix)))
        frequent[doc[there], column[term[there]]] = weight[there]
        near = frequent @ matrix  # what frequent terms add to the similarity of each example
        doc, term, weight = doc[~there], term[~there], weight[~there]
        cells = self.term_cells[term + 1] - self.term_cells[term]
        cell, weight = ragged(self.term_cells[term], cells), np.repeat(weight, cells)
        block = np.repeat(doc * blocks, cells) + self.cell_block[cell]
        bound = np.maximum.reduceat(near, self.starts, axis=1)
        bound += np.bincount(block, weight * self.cell_most[cell], bound.size).reshape(bound.shape)
        place = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
        width = np.diff(np.r_[self.starts, n])
        scored, least, at, step = np.zeros(bound.shape, bool), np.zeros(len(bags)), 0, FIRST
        known = np.zeros_like(near)  # similarities in blocks that were scored
        while True:
            chosen = (place >= at) & (place < at + step) & (bound > np.maximum(least - 1e-12, 0)[:, None])
            if not chosen.any():
                break
            scored |= chosen
            some = np.flatnonzero(chosen.ravel()[block])
            begin = self.cell_first[cell[some]]
            size = self.cell_first[cell[some] + 1] - begin
            post = ragged(begin, size)
            where = np.repeat(block[some] // blocks * n, size) + self.row[post]
            near += np.bincount(where, np.repeat(weight[some], size) * self.post[post], near.size).reshape(near.shape)
            np.copyto(known, near, where=np.repeat(chosen, width, axis=1))
            for i, row in enumerate(known):
                some = row[row > 0]
                least[i] = np.partition(some, -NEIGHBOURS)[-NEIGHBOURS] if len(some) >= NEIGHBOURS else 0.0
            at, step = at + step, step * 4
        self.scored += int(scored.sum())
        self.blocks += scored.size
        out = []
        for row, enough in zip(known, least, strict=True):
            found = np.flatnonzero((row > 0) & (row >= enough - 1e-11))
            out.append(nearest_of(self.back[found], row[found]))
        return out

    def votes(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
        return [vote(how, self.labels[who], self.prior) for who, how in self.nearest(bags)]


def calibrated(votes: float, steps: tuple[np.ndarray, np.ndarray]) -> float:
    """Mostly the fitted probability; a little of the votes keeps their order where the fit is flat."""
    return float(np.clip(0.98 * np.interp(votes, *steps) + 0.02 * votes, 0, 1))


def _monotone(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the least-squares non-decreasing fit of y over x (pooling of adjacent violators)."""
    pools: list[list[float]] = []  # sum of y, rows, sum of x
    for v, rows in ((v, x == v) for v in np.unique(x)):
        pools.append([float(y[rows].sum()), float(rows.sum()), float(v * rows.sum())])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


def _known(terms: np.ndarray, value: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, count) of the known terms of all rows, and where those of each row begin."""
    at = np.minimum(np.searchsorted(terms, value), max(0, len(terms) - 1))
    hit = np.flatnonzero(terms[at] == value) if len(terms) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(begins) - 1), np.diff(begins))[hit]
    key, count = np.unique(row * max(1, len(terms)) + at[hit], return_counts=True)
    row, term = np.divmod(key, max(1, len(terms)))
    return term, count, np.searchsorted(row, np.arange(len(begins)))


def _frequencies(shared):
    """(term, rows that have it), and the number of rows under no term."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        total, rows = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for part in slices(batch, "text", TEXT_BYTES):
                value, _, _, begins = word_hashes(*buffers(part.column("text")), letters_only=True)
                total += np.bincount(_known(terms, value, begins)[0], minlength=len(terms))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array([None, *terms[some].view(np.int64).tolist()], pa.int64()), pa.array([rows, *total[some].tolist()], pa.int64())], names=["term", "n"])

    return run


def _votes(shared):
    """(place, votes) of the examples of a fold, by those outside it."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = shared.value
        for fold in (f for batch in batches for f in batch.column("id").to_pylist()):
            places = np.flatnonzero(examples.fold == fold)
            if len(places):
                votes = examples.model(fold).votes(examples.bags(places))
                yield pa.record_batch([pa.array(places, pa.int64()), pa.array(votes, pa.float64())], names=["place", "votes"])

    return run


def _score_all(shared, steps: tuple[np.ndarray, np.ndarray], names: list[str]):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, done = shared.value.model(), {}
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                value, _, _, begins = word_hashes(*buffers(part.column("text")), letters_only=True)
                term, count, cut = _known(model.terms, value, begins)
                bags = [(term[a:b], count[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                keys = [hashlib.blake2b(t.tobytes() + c.tobytes(), digest_size=16).digest() for t, c in bags]
                if len(done) > 5_000:
                    done.clear()
                new = {k: bag for k, bag in zip(keys, bags, strict=True) if k not in done}
                for k, (who, how) in zip(new, model.nearest(list(new.values())), strict=True):
                    done[k] = calibrated(vote(how, model.labels[who], model.prior), steps), model.ids[who[:3]].tolist(), how[:3].tolist()
                score, who, how = zip(*map(done.__getitem__, keys), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64()), pa.array(who, pa.list_(pa.int64())), pa.array(how, pa.list_(pa.float64()))], names=names)

    return run


@dataclass
class Trained:
    """Examples, in the memory of tasks, and the monotone map from votes to scores."""

    examples: Broadcast
    steps: tuple[np.ndarray, np.ndarray]


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, postings: int = POSTINGS) -> Trained:
    """Fits the model on labelled documents that aren't held out: as many as both bounds allow, taken in pseudo-random order of ids. Term frequencies are of all docs."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(table(some, "examples")), "doc_id")
    bags = table(texts.select("doc_id", "toxic", "text").mapInArrow(_bags, "doc_id bigint, toxic int, n bigint, terms binary, counts binary"), "bags")
    # at most `examples` documents, though a document may have several rows
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "terms", "counts").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = bags.distinct().withColumn("upto", upto).where(F.col("upto") <= postings)
    found, seen = [], set()
    for r in sorted(rows.collect(), key=lambda r: (r["doc_id"], bytes(r["terms"]), bytes(r["counts"]))):
        bag = (bytes(r["terms"]), bytes(r["counts"]), r["toxic"])
        if bag not in seen:
            seen.add(bag)
            found.append((r["doc_id"], r["toxic"], np.frombuffer(bag[0], np.uint64), np.frombuffer(bag[1], np.int32)))
    terms = np.unique(np.concatenate([f[2] for f in found] or [np.zeros(0, np.uint64)]))
    frequency, documents = {}, 0
    if len(terms):
        counts = docs.select("text").mapInArrow(_frequencies(spark.sparkContext.broadcast(terms)), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        known = dict(zip(counts.column("term").to_pylist(), counts.column("n").to_pylist(), strict=True))
        documents = known.pop(None, 0)
        frequency = {t % 2**64: n for t, n in known.items()}
    of = Examples.of(found, frequency, documents)
    shared = spark.sparkContext.broadcast(of)
    prior = float(of.labels.mean()) if found else 0.0
    votes = np.full(len(found), prior)
    if found:
        for r in spark.range(0, FOLDS, 1, FOLDS).mapInArrow(_votes(shared), "place bigint, votes double").collect():
            votes[r["place"]] = r["votes"]
    return Trained(shared, _monotone(votes.round(12), of.labels.astype(float)) if found else (np.zeros(1), np.zeros(1)))


def scored(docs: DataFrame, trained: Trained, out: tuple[str, str, str] = ("toxicity", "evidence", "evidence_similarity")) -> DataFrame:
    """docs with the score, and the ids and similarities of the three nearest examples; columns of these names are replaced."""
    docs = docs.drop(*out)
    kinds = (DoubleType(), ArrayType(LongType()), ArrayType(DoubleType()))
    schema = StructType([*docs.schema.fields, *(StructField(n, k) for n, k in zip(out, kinds, strict=True))])
    return docs.mapInArrow(_score_all(trained.examples, trained.steps, [*docs.columns, *out]), schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of every row."""
    got = scored(docs.select("doc_id", "text"), train(docs, labels))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "evidence", "evidence_similarity")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic."""
    own = ("__toxicity", "__evidence", "__similarity")
    return scored(docs, train(docs, labels), own).where("__toxicity < 0.5").select(*docs.columns)
