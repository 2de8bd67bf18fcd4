"""Token ids in ORC: written in doc_id order, with what readers need to prune and to read stripes in parallel.

Integer columns of ORC are run-length encoded; every stripe has a row index (least and greatest doc_id of each stride)
and a Bloom filter on doc_id. Long documents are cut into pieces of `PIECE` ids, so no row is unbounded. Each row has
the offset of its first id within its file; the offsets of files come from a small table of their totals.

A null text is empty and has only the end id. Rows with equal doc_id keep all their rows, in the order of their texts'
hashes; a null doc_id comes first. Empty input writes no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.shared import maybe_broadcast, partitions, scratch, table
from quillon.llm.textkernel import BLOCK, KEPT, SPACES, buffers, ragged, releasing, slices, word_hashes

PIECE = 1 << 16
#: Rows of a row-index stride; words that a Python worker remembers (about 40 bytes each); bytes of text in one file.
STRIDE, REMEMBERED, FILE_BYTES = 1000, 1_000_000, 256 << 20
#: Words that the library encodes at once.
AT_ONCE = 1000
#: Documents of several pieces up to which their table is broadcast; a larger one is joined by shuffling.
BROADCAST_LONG = 1_000_000
U = np.uint64
#: Marks the hash of a word that has a blank before it.
BLANK = U(0x5851F42D4C957F2D)
#: Marks that are left out of words; bytes of a word's length, eight at most; first bytes of what may be white space beyond ASCII's.
MARKS = b".,;:!?"
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
RARE = np.isin(np.arange(256), [0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3])


def _longer(x: np.ndarray, least: int) -> np.ndarray:
    """x with room for that many values, and for as many again."""
    out = np.empty(2 * least, x.dtype)
    out[: len(x)] = x
    return out


def checks(padded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each word a number made of its length, its first and last eight bytes and, if it has over 16, the sum of its bytes. padded: eight bytes follow the last word."""
    n = end - start
    out = n.astype(U)
    if len(out):
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        mask = MASKS[np.minimum(n, 8)]
        sums = np.zeros(len(n), U)
        long_ = np.flatnonzero(n > 16)
        if len(long_):
            sums[long_] = np.add.reduceat(padded, np.column_stack([start[long_], end[long_]]).ravel(), dtype=np.int64)[::2]
        with np.errstate(over="ignore"):
            for part in (eight[start] & mask, eight[np.maximum(end - 8, start)] & mask, sums):
                out = out * U(0x9E3779B97F4A7C15) + part
    return out


class Encoder:
    """Ids of texts: the library's ids of their words, one after the other.

    A unit is a run of anything but ASCII white space, with the blank before it, if there is one. Pre-tokens don't reach over units:
    white space belongs to a pre-token of something else only as the one blank before it. The rest of a white space run is its own
    pre-tokens: at a text's end one, elsewhere one for the last character, unless that is such a blank, and one for those before it.
    A mark of `MARKS` that ends a run after an ASCII letter or digit is a pre-token of its own, and not part of the unit.
    So a word is encoded by the library once for each worker and found by its 64-bit hash from then on, if its length, its first and last eight bytes and, of longer ones, the sum of all agree as well; texts aren't cut into
    Python strings. Texts with a unit that begins or ends with other white space or has a special token in it, or with a word that shares the hash of another one, are encoded whole.
    special: special tokens in a text are such, as the library has it; otherwise they are text like any other.
    """

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        self.whole = any(c.isspace() for t in self.special for c in t)  # then units don't keep them together
        self.newline = self.ids("\n")
        if len(self.newline) != 1:
            raise ValueError("the tokenizer has no id for a line's end")
        # with GPT-2's pre-tokens a unit's first id shows a blank before it, and a mark after a letter stands alone
        made = json.loads(self.tokenizer.to_str())
        first = made["pre_tokenizer"] or {}
        self.plain = first.get("type") == "ByteLevel" and bool(first.get("use_regex", True)) and not first.get("add_prefix_space") and made["normalizer"] is None
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        # ids of single characters
        one = {k: self.ids(chr(k)) for k in (*SPACES, *MARKS)}
        self.single, self.bytes = np.zeros(256, bool), np.zeros(256, np.int32)
        for k, got in one.items():
            if len(got) == 1:
                self.single[k], self.bytes[k] = True, got[0]
        self.marks = None
        if self.plain and self.single[list(MARKS)].all() and not any(chr(k) in t for k in MARKS for t in self.special):
            self.marks = np.zeros(256, bool)
            self.marks[list(MARKS)] = True
        self.clear()

    def clear(self) -> None:
        """Forgets all words: hashes, their checks, where their ids begin and how many they are (-1: not a unit), whether they came again; and the table that finds them, by a hash's last bits and the places behind."""
        self.known = 0
        self.hash, self.check, self.at, self.n, self.again = np.zeros(1, U), np.zeros(1, U), np.zeros(1, np.int64), np.zeros(1, np.int32), np.zeros(1, bool)
        self.slot = np.full(1 << 12, -1, np.int32)
        self.gaps: dict[tuple[bytes, bool], tuple[int, int]] = {}
        self.flat, self.used = self.bytes.copy(), len(self.bytes)  # ids of single characters come first

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _keep(self, ids: np.ndarray) -> int:
        """Adds ids; where they begin."""
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.flat):
            self.flat = _longer(self.flat, self.used)
        self.flat[at : self.used] = ids
        return at

    def _gap(self, gap: bytes, one: bool) -> tuple[int, int]:
        """(where its ids begin, how many they are) of white space that is one pre-token, or whose last character is another."""
        got = self.gaps.get((gap, one))
        if got is None:
            if len(self.gaps) > 10_000:
                self.gaps.clear()
            text = gap.decode()
            ids = self.ids(text) if one or len(text) == 1 else np.concatenate([self.ids(text[:-1]), self.ids(text[-1])])
            got = self._keep(ids), len(ids)
            if len(gap) <= 100:
                self.gaps[gap, one] = got
        return got

    def _odd(self, padded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether words begin or end with white space, or have a special token in them."""
        odd = np.zeros(len(start), bool)
        last, third = padded[end - 1], padded[np.maximum(end - 3, start)]
        # what may be white space beyond ASCII's, by its bytes
        some = RARE[padded[start]] | (last < 0x20) | ((last >= 0x80) & (RARE[third] | RARE[padded[np.maximum(end - 2, start)]]))
        text = padded[ragged(start, end - start)].tobytes()
        if any(t.encode() in text for t in self.special):
            some[:] = True
        for k in np.flatnonzero(some).tolist():
            word = padded[start[k] : end[k]].tobytes().decode()
            odd[k] = word[0].isspace() or word[-1].isspace() or any(t in word for t in self.special)
        return odd

    def _learn(self, value: np.ndarray, check: np.ndarray, padded: np.ndarray, start: np.ndarray, end: np.ndarray, blank: np.ndarray) -> None:
        """Adds words that are not known yet. Those with a blank before them are encoded as one text, in which blanks tell them apart; others as lines."""
        odd, at, n = self._odd(padded, start, end), np.zeros(len(value), np.int64), np.full(len(value), -1, np.int32)
        joined = blank if self.plain else np.zeros(len(blank), bool)
        for run, by_blank in ((np.flatnonzero(joined & ~odd), True), (np.flatnonzero(~joined & ~odd), False)):
            for k in range(0, len(run), AT_ONCE):
                some = run[k : k + AT_ONCE]
                begin, size = start[some] - blank[some], end[some] - start[some] + blank[some]
                if by_blank:
                    got = self.ids(padded[ragged(begin, size)].tobytes().decode())
                    cuts = np.append(np.flatnonzero(self.opens[got]), len(got))
                    first, many = cuts[:-1], np.diff(cuts)
                else:
                    text = padded[ragged(begin, size + 1)]
                    text[np.cumsum(size + 1) - 1] = 10
                    got = self.ids(text.tobytes().decode() + ".")[:-1]
                    ends = np.flatnonzero(got == self.newline[0])
                    first, many = np.append(0, ends[:-1] + 1)[: len(ends)], np.diff(ends, prepend=-1) - 1
                if len(first) != len(some) or first[0]:
                    raise ValueError("the tokenizer doesn't keep words apart")
                at[some], n[some] = self._keep(got) + first, many
        old, self.known = self.known, self.known + len(value)
        for name, new in (("hash", value), ("check", check), ("at", at), ("n", n), ("again", False)):
            if self.known > len(getattr(self, name)):
                setattr(self, name, _longer(getattr(self, name), self.known))
            getattr(self, name)[old : self.known] = new
        if self.known > 0.6 * len(self.slot):
            self.slot, old = np.full(1 << int(self.known / 0.3).bit_length(), -1, np.int32), 0
        self._place(old)

    def _place(self, first: int) -> None:
        """Enters the words from that one on into the table."""
        entry, last = np.arange(first, self.known, dtype=np.int32), len(self.slot) - 1
        at = (self.hash[first : self.known] & U(last)).astype(np.int64)
        while len(entry):
            free = self.slot[at] < 0
            self.slot[at[free]] = entry[free]
            left = self.slot[at] != entry
            entry, at = entry[left], (at[left] + 1) & last

    def _forget(self) -> None:
        """Keeps words that came again since the last time, up to half of the room."""
        keep = np.flatnonzero(self.again[: self.known])[: REMEMBERED // 2]
        kept = self.hash[keep], self.check[keep], self.n[keep]
        n = np.maximum(kept[2], 0)
        ids = self.flat[ragged(self.at[keep], n)]
        self.clear()
        self.known, (self.hash, self.check, self.n) = len(keep), (np.append(x, x.dtype.type(0)) for x in kept)
        self.at, self.again = np.append(self._keep(ids) + np.cumsum(n) - n, 0), np.zeros(len(keep) + 1, bool)
        self.slot = np.full(max(1 << 12, 1 << int(self.known / 0.3).bit_length()), -1, np.int32)
        self._place(0)

    def _find(self, value: np.ndarray) -> np.ndarray:
        """Of each hash the word's number, or -1."""
        last = len(self.slot) - 1
        at = (value & U(last)).astype(np.int64)
        found = self.slot[at]
        left = np.flatnonzero((self.hash[found] != value) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & last
            now = self.slot[at[left]]
            found[left] = now
            left = left[(self.hash[now] != value[left]) & (now >= 0)]
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each one's begin in them, with their number at the end)."""
        if self.known > REMEMBERED or self.used > 16 * REMEMBERED:
            self._forget()
        if self.whole:
            parts = [self.ids(t or "") for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, np.int32), *parts]), np.r_[0, np.cumsum([len(p) for p in parts], dtype=np.int64)]
        data, rows = buffers(texts)
        padded = np.append(data, np.zeros(8, np.uint8))
        value, start, end, begins = word_hashes(data, rows, fold=False, trailing=self.marks)
        check = checks(padded, start, end)
        # marks after words: whatever follows a word in its text is one, or white space
        trail = np.zeros(len(start), bool)
        if self.marks is not None:
            border = np.zeros(len(padded), bool)
            border[rows] = True
            trail = self.marks[padded[end]] & ~border[end]
        stop = end + trail
        # white space before each word, and after the last one of each text
        filled = np.flatnonzero(begins[:-1] < begins[1:])
        before = np.append(0, stop[:-1])[: len(stop)]
        before[begins[filled]] = rows[filled]
        blank = (start > before) & (padded[start - 1] == 0x20)
        gap = start - blank - before
        lead = (gap == 1) & self.single[padded[start - blank - 1]]
        tail = rows[:-1].copy()
        tail[filled] = stop[begins[filled + 1] - 1]

        value = value ^ np.where(blank, BLANK, U(0))
        place = self._find(value)
        missing = np.flatnonzero(place < 0)
        self.again[place[place >= 0]] = True
        if len(missing):
            new, one = np.unique(value[missing], return_index=True)
            one = missing[one]  # one of its places
            self._learn(new, check[one], padded, start[one], end[one], blank[one])
            place[missing] = self._find(value[missing])
        at, n = self.at[place], self.n[place]
        bad = np.flatnonzero((self.check[place] != check) | (n < 0))
        odd = np.zeros(len(rows) - 1, bool)
        odd[np.searchsorted(begins, bad, "right") - 1] = True
        if len(bad):
            here = ~np.repeat(odd, np.diff(begins))
            n, lead, trail = n * here, lead & here, trail & here

        # a word's ids with those of the character before and the mark after it; longer white space comes between
        at, n, item = at - lead, n + lead + trail, np.arange(len(start))
        gaps = [(k, int(before[k]), int(before[k] + gap[k]), bool(blank[k])) for k in np.flatnonzero((gap > 0) & ~lead).tolist()] if (gap > lead).any() else []
        gaps += [(int(begins[r + 1]), int(tail[r]), int(rows[r + 1]), True) for r in np.flatnonzero(tail < rows[1:]).tolist()]
        if gaps:
            gaps.sort(key=lambda g: g[:2])
            of_row = np.searchsorted(rows, [a for _, a, _, _ in gaps], "right") - 1
            gaps, of_row = [g for g, r in zip(gaps, of_row.tolist(), strict=True) if not odd[r]], of_row[~odd[of_row]]
        if gaps:
            found = [self._gap(padded[a:b].tobytes(), one) for _, a, b, one in gaps]
            where = np.array([k for k, *_ in gaps])
            item += np.cumsum(np.bincount(where, minlength=len(start) + 1))[: len(start)]
            at, n = np.insert(at, where, [f for f, _ in found]), np.insert(n, where, [k for _, k in found])
            begins = begins + np.append(0, np.cumsum(np.bincount(of_row, minlength=len(rows) - 1)))
        ends = np.cumsum(n)
        source = ragged(at, n)
        before, after = np.flatnonzero(lead), np.flatnonzero(trail)
        source[ends[item[before]] - n[item[before]]] = padded[start[before] - blank[before] - 1]
        source[ends[item[after]] - 1] = padded[end[after]]
        ids, total = self.flat[source], np.append(0, ends)[begins]
        if odd.any():
            parts = np.split(ids, total[1:-1])
            for r in np.flatnonzero(odd).tolist():
                parts[r] = self.ids(texts[r].as_py())
            ids, total = np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
        return ids, total


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which Spark uses for many tasks."""
    return Encoder(path)


KEPT["token_files"] = encoder.cache_clear


def _encode(path: str, end: int):
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("offset", pa.int64()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, offset, number = encoder(path), 0, 0
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                ids, begins = coder.encode(part.column("text"))
                ids = np.insert(ids, begins[1:], end)  # the end id after each document
                begins = begins + np.arange(len(begins))
                pieces = np.maximum(1, -(-np.diff(begins) // PIECE))
                row = np.repeat(np.arange(len(pieces)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                cuts = np.r_[begins[row] + piece * PIECE, begins[-1]]
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))
                columns = (row + number, piece, cuts[:-1] + offset, np.diff(cuts))
                yield pa.record_batch([part.column("doc_id").take(pa.array(row)), *(pa.array(c, t) for c, t in zip(columns, schema.types[1:5], strict=True)), lists], schema=schema)
                offset, number = offset + len(ids), number + len(pieces)

    return releasing(run, keeps="token_files")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = 2) -> None:
    """Writes the ids of docs (doc_id, text) as ORC files, in ascending doc_id order over files and rows."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    files = max(partitions(spark), (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // FILE_BYTES)
    ordered = docs.repartitionByRange(files, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = ordered.mapInArrow(_encode(tokenizer, end), "doc_id bigint, row bigint, piece int, offset bigint, n int, ids array<int>")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(STRIDE), "compression": "snappy"}
    rows.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, piece, ids, offset, row, file) of the files at path; doc_ids are looked up by row index and Bloom filter."""
    rows = spark.read.schema("doc_id bigint, row bigint, piece int, offset bigint, n int, ids array<int>").orc(path)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    return rows.withColumn("file", F.col("_metadata.file_name"))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("ids")
        raw, cut = np.asarray(column.values, dtype="<u4").tobytes(), (np.asarray(column.offsets) * 4).tolist()
        crc = [zlib.crc32(raw[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.record_batch([*batch.drop_columns(["ids"]).columns, pa.array(crc, pa.int64())], names=["doc_id", "file", "offset", "n_tokens", "ids_crc32"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CRC of the pieces of long documents, one after the other."""
    for batch in batches:
        crc = []
        for pieces in batch.column("parts").to_pylist():
            value = 0
            for p in sorted(pieces, key=lambda p: p["piece"]):
                value = zlib.crc32(np.array(p["ids"], "<u4"), value)
            crc.append(value)
        yield pa.record_batch([*batch.drop_columns(["parts"]).columns, pa.array(crc, pa.int64())], names=["doc_id", "file", "offset", "n_tokens", "ids_crc32"])


def documents_read_back(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    rows = read_tokens(spark, path)
    ends = rows.groupBy("file").agg(F.max(F.struct("offset", "n")).alias("last"))
    ends = table(ends.select("file", (F.col("last.offset") + F.col("last.n")).alias("total")), "file_totals")
    # files are named by the number of their range, so they are in order of ids
    before = Window.orderBy(F.regexp_extract("file", r"^part-(\d+)", 1).cast("long"), "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))

    long_ = table(rows.where("piece > 0").select("file", "row").distinct(), "long")
    few = maybe_broadcast(long_, BROADCAST_LONG)
    single = rows.join(few, ["file", "row"], "left_anti").select("doc_id", "file", "offset", "n", "ids")
    single = single.mapInArrow(_crc, "doc_id bigint, file string, offset bigint, n_tokens int, ids_crc32 bigint").withColumn("n_tokens", F.col("n_tokens").cast("bigint"))
    several = rows.join(few, ["file", "row"], "left_semi").groupBy("file", "row", "doc_id").agg(F.min("offset").alias("offset"), F.sum("n").alias("n_tokens"), F.collect_list(F.struct("piece", "ids")).alias("parts"))
    several = several.select("doc_id", "file", "offset", "n_tokens", "parts").mapInArrow(_whole, "doc_id bigint, file string, offset bigint, n_tokens bigint, ids_crc32 bigint")
    both = single.unionByName(several)
    return both.join(F.broadcast(bases), "file").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def encoded(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """Writes docs and reads them back."""
    path = scratch(docs.sparkSession, "tokens.orc")
    write_tokens(docs, path, tokenizer, end)
    return documents_read_back(docs.sparkSession, path)
