"""Token counts under a unigram vocabulary, by dynamic programming over a trie of all distinct pre-tokens.

A pre-token is a run of anything but ASCII white space, with the vocabulary's word mark before it. Its best segmentation has the
highest sum of piece scores; the count is that segmentation's number of pieces. The best score of a prefix depends on the prefix alone. So
the distinct pre-tokens of the corpus are counted, dealt out in ranges and walked in sorted order, which visits the nodes of their
trie depth first: every prefix is scored once in its range, however many pre-tokens, documents and tasks share it.

Documents then add up the counts of their pre-tokens, found by 64-bit hashes. The most frequent ones, up to `KNOWN`, are sent to all tasks; what
is left of each document is joined with the other counts by shuffling, and consists of rare pre-tokens only, so no key is hot.

A null or empty text counts 0. Repeated rows count alike, and rows without a doc_id too. A character without a piece counts as its UTF-8 bytes.
Other columns are ignored; empty input gives empty output.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import partitions, table
from quillon.llm.textkernel import buffers, releasing, slices, word_hashes

MARK = "▁"
#: Pre-tokens whose counts are sent to all tasks (10 bytes each), those of one range of the trie, and those a task gathers before it sends them.
KNOWN, RANGE, GATHERED = 2_000_000, 1_000_000, 300_000
#: Score of each byte of a character that has no piece.
BYTE_SCORE = -20.0


def zipf_scores(path: str) -> dict[str, float]:
    """Scores of a SentencePiece vocabulary as log-probabilities by Zipf's law on its order, which is all that a merge-ranked vocabulary tells."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r) - total for r, p in enumerate(pieces, 1)}


class Walk:
    """Token counts of pre-tokens that come in sorted order: what is known of the last one's prefixes is kept for the next."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.best, self.pieces, self.last = array("d", [0.0]), array("l", [0]), ""

    def count(self, word: str) -> int:
        scores, longest, best, pieces, last = self.scores, self.longest, self.best, self.pieces, self.last
        text = MARK + word
        shared = 0
        for x, y in zip(text, last):
            if x != y:
                break
            shared += 1
        del best[shared + 1 :], pieces[shared + 1 :]
        for end in range(shared + 1, len(text) + 1):
            size = len(text[end - 1].encode())
            top, count = best[end - 1] + BYTE_SCORE * size, pieces[end - 1] + size
            for begin in range(max(0, end - longest), end):
                score = scores.get(text[begin:end])
                if score is not None and best[begin] + score > top:
                    top, count = best[begin] + score, pieces[begin] + 1
            best.append(top)
            pieces.append(count)
        self.last = text
        return pieces[-1]


@releasing
def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): pre-tokens and how often a part of the task's texts has them."""
    found: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
        found.clear()
        return batch

    for batch in batches:
        for part in slices(batch, "text"):
            for text in part.column("text").cast(pa.binary()).to_pylist():
                if text:
                    found.update(text.split())  # bytes are split at ASCII white space
            if len(found) > GATHERED:
                yield out()
    yield out()


def _walk(shared):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(shared.value)
        for batch in batches:
            words = batch.column("word")
            tokens = [walk.count(w) for w in words.to_pylist()]
            yield pa.record_batch([pa.array(word_hashes(*buffers(words), fold=False)[0].view(np.int64)), batch.column("n"), pa.array(tokens, pa.int64())], names=["hash", "n", "tokens"])

    return run


def _add(shared):
    """(doc_id, n_words, known, rare): tokens of the pre-tokens that all tasks know, and the hashes of the others."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, tokens = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                value, _, _, begins = word_hashes(*buffers(part.column("text")), fold=False)
                at = np.minimum(np.searchsorted(hashes, value), max(0, len(hashes) - 1))
                known = hashes[at] == value if len(hashes) else np.zeros(len(value), bool)
                total = np.r_[0, np.cumsum(np.where(known, tokens[at], 0) if len(hashes) else np.zeros(len(value), np.int64))]
                rare = np.r_[0, np.cumsum(~known)]
                lists = pa.ListArray.from_arrays(pa.array(rare[begins], pa.int32()), pa.array(value[~known].view(np.int64)))
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(begins), pa.int64()), pa.array(np.diff(total[begins]), pa.int64()), lists], names=["doc_id", "n_words", "known", "rare"])

    return run


def count_tokens(docs: DataFrame, scores: dict[str, float]) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    words = table(docs.select("text").mapInArrow(_distinct, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    ranges = max(partitions(spark), words.count() // RANGE)
    ordered = words.repartitionByRange(ranges, "word").sortWithinPartitions("word")
    counts = table(ordered.mapInArrow(_walk(spark.sparkContext.broadcast(scores)), "hash bigint, n bigint, tokens bigint"), "token_counts")

    # how often a pre-token must occur, at least, for those that occur so often to be KNOWN at most
    level = F.floor(F.log2("n")).cast("int").alias("level")
    room, least = KNOWN, 0
    for r in counts.groupBy(level).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect():
        room -= r["words"]
        if room < 0:
            least = 2 ** (r["level"] + 1)
            break
    few = counts.where(F.col("n") >= least).select("hash", "tokens").toArrow()
    hashes, first = np.unique(few.column("hash").to_numpy().view(np.uint64), return_index=True)
    shared = spark.sparkContext.broadcast((hashes, few.column("tokens").to_numpy()[first].astype(np.int32)))

    rows = docs.mapInArrow(_add(shared), "doc_id bigint, n_words bigint, known bigint, rare array<bigint>")
    rows = table(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    others = counts.where(F.col("n") < least).groupBy("hash").agg(F.min("tokens").alias("tokens"))
    rest = rows.select("row", F.explode("rare").alias("hash")).join(others, "hash").groupBy("row").agg(F.sum("tokens").alias("others"))
    return rows.join(rest, "row", "left").select("doc_id", "n_words", (F.col("known") + F.coalesce("others", F.lit(0))).alias("n_tokens"))
