"""Records of large CSV files, read by as many tasks as the files have splits.

A newline ends a record unless it is in a quoted cell, which depends on everything before it in the file. So lines are read in splits, and for each line
two regular expressions tell whether a quoted cell is open behind it: if none was open before it, and if one was. One pass takes these two bits (no text) through
each split, once for either state at its beginning; composing the splits of a file in order gives the state that each really begins with. Then lines are joined to records in each
split on its own. A record that crosses splits is cut into pieces, which are put together by a shuffle of nothing but them.

Where no cell of any file holds a newline, Spark's own reader splits the files just as well and is used instead; so it is with files of one split, and with those whose
lines end in a carriage return alone, which aren't split.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.scratch import table

_BODY = r'[^"]*+(?:""[^"]*+)*+'
_REST = rf'(?:(?:"{_BODY}"[^,]*+|[^",][^,]*+)?+,)*+"{_BODY}\z'
#: Whether a quoted cell is open behind a line before which none, or one, was open. A quote within an unquoted cell is a character like others, and so is
#: what follows a closing quote up to the next comma. No quantifier gives back what it has taken, so both take time in proportion to the line.
OPENS, STAYS = rf"\A{_REST}", rf'\A{_BODY}(?:\z|"[^,]*+,{_REST})'
#: Splits that begin within a cell (or end lines unlike most) up to which their table is broadcast; more are joined by a shuffle.
BROADCAST = 200_000

_SPLIT = "file bigint, block bigint, end0 boolean, end1 boolean, joins0 boolean, joins1 boolean, closes boolean, first_cr boolean, last_cr boolean, first_lone boolean, lone boolean, blank boolean, with_cr bigint, without_cr bigint"
_KNOWN = "file bigint, block bigint, inside boolean, owner bigint, crosses boolean, crlf boolean, special boolean, unsplit boolean"
_RECORD = "record string, file bigint, block bigint, owner bigint, piece int"
WHOLE, REST, BEGINNING, HEADER = range(4)


def split_bytes(spark: SparkSession, lengths: int, files: int) -> int:
    """The size of a split, as Spark plans scans."""
    conf = lambda k: spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(k))
    cost = conf("spark.sql.files.openCostInBytes")
    return min(conf("spark.sql.files.maxPartitionBytes"), max(cost, (lengths + files * cost) // spark.sparkContext.defaultParallelism))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, id, bits, value): lines in splits; file is a hash of the name. Bits: a cell is open behind it (1: from the outside, 2: from within), a carriage return
    at its end (4) or elsewhere (8), nothing but blanks (16)."""
    text = spark.read.option("lineSep", "\n").text(path)
    v = F.col("value")
    tests = [v.contains('"') & v.rlike(OPENS), ~v.contains('"') | v.rlike(STAYS), v.endswith("\r"), v.rlike(r"\r(?!\z)"), v.rlike(r"\A[\x00-\x20]++\z") & (v != "\r")]
    bits = sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0)).cast("tinyint")
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), bits.alias("bits"), "value")


def through(bits: np.ndarray, start: bool) -> np.ndarray:
    """State behind each line, from the state before the first."""
    opens, stays = bits & 1, bits >> 1 & 1
    turns = np.cumsum((opens == 1) & (stays == 0))
    fixed = np.maximum.accumulate(np.where(opens == stays, np.arange(len(bits)), -1))  # the last line that leads to one state from either
    after = np.where(fixed >= 0, opens[fixed] ^ (turns - turns[fixed]) & 1, (turns + start) & 1)
    return after.astype(bool)


def _runs(b: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], slice]]:
    """Rows of a batch that are of one split."""
    file, block = (b.column(c).to_numpy() for c in ("file", "block"))
    cuts = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(file)]
    for a, z in zip(cuts, cuts[1:], strict=False):
        if z > a:
            yield (int(file[a]), int(block[a])), slice(a, z)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split: what it does to either state, and which lines it has."""
    key, row = None, {}
    types = {"bigint": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, types[t]) for n, t in (c.split() for c in _SPLIT.split(", "))])
    for b in batches:
        every = b.column("bits").to_numpy()
        for k, at in _runs(b):
            bits = every[at].astype(np.int64)
            if k != key:
                if key is not None:
                    yield pa.RecordBatch.from_pylist([row], schema)
                key, row = k, dict.fromkeys(schema.names, False) | {"file": k[0], "block": k[1], "end1": True, "first_cr": bool(bits[0] & 4), "first_lone": bool(bits[0] & 8), "with_cr": 0, "without_cr": 0}
            for s in "01":
                after = through(bits, row[f"end{s}"])
                row[f"joins{s}"] |= row[f"end{s}"] or bool(after[:-1].any())
                row[f"end{s}"] = bool(after[-1])
            row["closes"] |= not after.all()
            row["last_cr"], row["lone"], row["blank"] = bool(bits[-1] & 4), row["lone"] or bool((bits & 8).any()), row["blank"] or bool((bits & 16).any())
            row["with_cr"] += int((bits & 4 > 0).sum())
            row["without_cr"] += int((bits & 4 == 0).sum())
    if key is not None:
        yield pa.RecordBatch.from_pylist([row], schema)


def _composed(splits: pd.DataFrame) -> pd.DataFrame:
    """What each split of a file begins with, from the effect that those before it have; owner: the split that the record begins in which is open then.

    special: Spark's reader of single lines would read other records; unsplit: the file's lines may end in carriage returns.
    """
    splits = splits.sort_values("block")
    inside, owners, crosses, special = [], [], [], []
    state, owner = False, 0
    for s in splits.itertuples():
        after = bool(s.end1 if state else s.end0)
        inside.append(state)
        owners.append(owner)
        crosses.append(state or after)
        special.append(bool(after or s.lone or s.blank or (s.joins1 if state else s.joins0)))
        if after and (not state or s.closes):
            owner = s.block
        state = after
    crlf = bool(splits.first_cr.iloc[0])
    plain, cr = int(splits.without_cr.sum()), int(splits.with_cr.sum())
    uniform = cr == 0 or crlf and (plain == 0 or plain == 1 and not splits.last_cr.iloc[-1])
    return pd.DataFrame({"file": splits.file, "block": splits.block, "inside": inside, "owner": owners, "crosses": crosses, "crlf": crlf, "special": np.array(special) | (not uniform), "unsplit": bool(splits.first_lone.iloc[0])})


@dataclass
class Layout:
    """What is known of the splits. special: cells hold newlines, or lines end in more than one way; unsplit: some files can't be split; crlf: how most lines end;
    odd: the splits that begin or end within a record, or whose lines end otherwise."""

    special: bool
    unsplit: bool
    crlf: bool
    odd: DataFrame
    n_odd: int


def layout(rows: DataFrame) -> Layout:
    splits = rows.select("file", "block", "bits").mapInArrow(_summaries, _SPLIT)
    known = table(splits.groupBy("file").applyInPandas(_composed, _KNOWN), "csv_splits")
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    sums = known.agg(any_("special"), any_("unsplit"), (F.count_if("crlf") * 2 > F.count(F.lit(1))).alias("crlf")).first()
    odd = known.where(F.col("crosses") | (F.col("crlf") != F.lit(sums["crlf"]))).select("file", "block", "inside", "owner", "crosses", "crlf")
    return Layout(sums["special"], sums["unsplit"], sums["crlf"], odd, odd.count() if sums["special"] else 0)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in file order as records: whole ones, the rest of one from a split before, the beginning of one that goes on. A file's first record is its header
    and left out, or marked where it goes on."""
    schema = pa.schema([("record", pa.string()), ("file", pa.int64()), ("block", pa.int64()), ("owner", pa.int64()), ("piece", pa.int32())])
    key, owner, crlf, state, piece, first = None, 0, False, False, WHOLE, False
    open_: list[str] = []
    out: list[tuple] = []

    def close(complete: bool) -> None:
        """Ends the record, or the piece of one, that the lines gathered make."""
        nonlocal first
        if not open_:
            return
        kind = REST if piece == REST else WHOLE if complete else HEADER if first else BEGINNING
        if not (first and kind == WHOLE):
            out.append(("\n".join(open_), *key, owner if kind == REST else key[1], kind))
        first = False
        open_.clear()

    def told() -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()

    for b in batches:
        bits, inside, owners, ends = (b.column(c).to_numpy(zero_copy_only=False) for c in ("bits", "inside", "owner", "crlf"))
        for k, at in _runs(b):
            if k != key:
                close(False)
                key, owner, crlf, state, first = k, int(owners[at.start]), bool(ends[at.start]), bool(inside[at.start]), k[1] == 0
                piece = REST if state else WHOLE
            after = through(bits[at].astype(np.int64), state)
            part = b.slice(at.start, at.stop - at.start)
            if not (open_ or state or first or after.any()):  # every line is a record
                text = part.column("value")
                text = pc.replace_substring_regex(text, pattern=r"\r\z", replacement="") if crlf else text
                yield pa.RecordBatch.from_arrays([text, part.column("file"), part.column("block"), part.column("block"), pa.array(np.zeros(len(text), np.int32))], schema=schema)
            else:
                for line, open_after in zip(part.column("value").to_pylist(), after.tolist(), strict=True):
                    open_.append(line.removesuffix("\r") if crlf else line)
                    if not open_after:
                        close(True)
                        piece = WHOLE
            state = bool(after[-1])
        yield from told()
    close(False)
    yield from told()


def _with_states(rows: DataFrame, known: Layout, only_crossing: bool) -> DataFrame:
    few = known.n_odd <= BROADCAST
    odd = known.odd.where("crosses") if only_crossing else known.odd
    joined = rows.join(F.broadcast(odd) if few else odd, ["file", "block"], "inner" if only_crossing else "left")
    if not few:  # lines have lost their order
        joined = joined.repartition("file", "block").sortWithinPartitions("file", "block", "id")
    default = {"inside": False, "owner": 0, "crlf": known.crlf}
    return joined.select("file", "block", "bits", "value", *(F.coalesce(c, F.lit(v)).alias(c) for c, v in default.items())).mapInArrow(_joined, _RECORD)


def records(rows: DataFrame, known: Layout) -> DataFrame:
    """(record): each record as one text, without headers and empty lines."""
    whole = _with_states(rows, known, False).where(F.col("piece") == WHOLE).select("record")
    pieces = table(_with_states(rows, known, True).where(F.col("piece") != WHOLE), "csv_pieces")  # one or two of each split
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("block", "record"))), lambda x: x["record"])
    across = pieces.groupBy("file", "owner").agg(F.max("piece").alias("most"), F.array_join(ordered, "\n").alias("record")).where(F.col("most") != HEADER).select("record")
    return whole.union(across).where("record <> ''")


def parsed(found: DataFrame, columns: list[str], corrupt: str | None = None) -> DataFrame:
    """The cells of each record, as texts; corrupt: also a column of that name that has the record where it doesn't match the header."""
    names = [f"c{i}" for i in range(len(columns))]
    options = {"escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "lineSep": "\n", "columnNameOfCorruptRecord": "corrupt"}
    cells = F.from_csv("record", ", ".join(f"{n} string" for n in [*names, *(["corrupt"] if corrupt else [])]), options)
    return found.select(cells.alias("cells")).select(*(F.col(f"cells.{n}").alias(c) for n, c in zip(names, columns, strict=True)), *([F.col("cells.corrupt").alias(corrupt)] if corrupt else []))
