"""Near duplicates: documents whose sets of word shingles have a Jaccard similarity of at least a threshold.

An exact grouped prefix join:

1. Shingle sets are hashed in Arrow batches. In a fixed share of the hash space shingles are counted; a document with more
   shingles that occur nowhere else than the threshold allows can't link and is left out from here on.
2. Shingles of what is left are ordered by how many different sets have them, rarest first. Linked sets share one within their prefixes.
   Sets of one size with identical prefixes are one group, whatever their number; equal sets are one member of it.
3. Pairs are first those that join most with least work: each member with the first of its group; and each group meets
   one leader group of each token of its prefix, and, if their sizes allow a link, its members are compared with the first of that. What is verified links; linked members form components.
4. Only members of different components remain. The members of a group that are in one component are a unit. Units that share a token of their
   prefix are compared in blocks of bounded size, and only blocks that can hold different components meet; sizes and counts of shingles in 64 slices of the hash
   space bound the possible overlap. Pairs of units that stay are verified by their first members, then those not yet joined are
   expanded to their members, which are bounded in the same way, and verified.

Components are then exact, without emitting all pairs within a group: members of one component are never compared with each other again.

Null and empty texts have no shingles and link with nothing. Rows that share a doc_id are one document, which links as any of them does; n_shingles is
of each row. Rows without a doc_id are documents of their own, and have a component only if it has an id. A component's id is its smallest
doc_id. Empty input gives empty output; other columns are ignored by `link` and kept by `keep_one`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quillon.functions.numbers import quoted
from quillon.llm.components import components
from quillon.llm.shared import free, maybe_broadcast, table
from quillon.llm.textkernel import releasing, shingle_sets, slices

#: Share of the hash space in which shingles are counted by step 1; more rejects more, and moves more.
SHARE = 0.3
#: Units or members in a block of step 4; slices of its bound.
BLOCK, SLICES = 1024, 64
#: Rows up to which a table of ids is broadcast; a larger one is joined by shuffling.
BROADCAST_IDS = 2_000_000

U = np.uint64


def needed(n: int | np.ndarray | Column, percent: int) -> int | np.ndarray | Column:
    """Least overlap of a set of n with any set that reaches the threshold."""
    if isinstance(n, Column):
        return F.floor((F.lit(percent) * n + 99) / 100)
    return (percent * n + 99) // 100


def _samples(words: int):
    """Of each row: its number of shingles, a 64-bit name of their set, and those in the counted share of the hash space."""
    limit = U(int(SHARE * 2.0**64))
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("mark", pa.int64()), ("sample", pa.list_(pa.int64()))])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, marks, kept = [], [], []
                for found in shingle_sets(part.column("text"), words):
                    n.append(len(found))
                    marks.append(xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63)
                    kept.append(found[: np.searchsorted(found, limit)].view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, kept)]), pa.int32()), pa.array(np.concatenate(kept), pa.int64()))
                yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(marks, pa.int64()), lists], schema=schema)

    return run


def _sets(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("hashes", pa.binary())])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [x.tobytes() for x in shingle_sets(part.column("text"), words)]
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array([len(x) // 8 for x in found], pa.int64()), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in found], pa.binary()), pa.array(found, pa.binary())], schema=schema)

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.frombuffer(x, np.int64) for x in batch.column("hashes").to_pylist()]
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        yield pa.record_batch([batch.column("node"), pa.ListArray.from_arrays(offsets, np.concatenate(found))], names=["node", "hashes"])


def _prefixes(percent: int):
    """Of each node: its shared shingles, those of its prefix and a name of them, and how many fall into each slice of the hash space."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("prefix", pa.list_(pa.int64())), ("key", pa.binary()), ("slices", pa.list_(pa.int32())), ("hashes", pa.binary())])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            shared, nodes, sizes = batch.column("shared"), batch.column("node").to_pylist(), batch.column("n").to_pylist()
            for i, (node, n) in enumerate(zip(nodes, sizes, strict=True)):
                pairs = shared[i].values
                count, value = (np.asarray(pairs.field(k)) for k in ("count", "hash"))
                keep = int(n - needed(n, percent) + 1 - (n - len(value)))
                if keep > 0:
                    first = value[np.lexsort((value, count))[:keep]]
                    per = np.bincount((value.view(U) >> U(58)).astype(np.int64), minlength=SLICES)
                    out.append((node, n, len(value), first, hashlib.blake2b(first.tobytes(), digest_size=16).digest(), per.astype(np.int32), np.sort(value).tobytes()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return run


def possible(n1: Column, m1: Column, n2: Column, m2: Column, percent: int) -> Column:
    """Whether sets of n1 and n2, of which m1 and m2 occur elsewhere, can reach the threshold."""
    most = F.least(m1, m2)
    return 100 * most >= percent * (n1 + n2 - most)


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold, by their whole sets."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            columns = [batch.column(k).to_pylist() for k in ("na", "nb", "ha", "hb")]
            for na, nb, ha, hb in zip(*columns, strict=True):
                both = len(np.intersect1d(np.frombuffer(ha, np.int64), np.frombuffer(hb, np.int64), assume_unique=True))
                yes.append(100 * both >= percent * (na + nb - both))
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ha", "hb").mapInArrow(run, "a bigint, b bigint")


def _block_pairs(percent: int):
    """Of rows that come together by (key, i, j): pairs of block i with block j, from different roots, that may link."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, key, found = [], None, set()

        def pairs() -> None:
            n, m, root, id_, block = (np.concatenate([p[k] for p in parts]) for k in ("n", "m", "root", "id", "block"))
            per = np.concatenate([p["slices"] for p in parts])
            for x in np.flatnonzero(block == key[1]):
                other = np.flatnonzero((block == key[2]) & (root != root[x]) & (id_ > id_[x] if key[1] == key[2] else True))
                most = np.minimum(m[x], m[other])
                other = other[100 * most >= percent * (n[x] + n[other] - most)]
                if len(other):
                    most = np.minimum(per[x], per[other]).sum(1)
                    other = other[100 * most >= percent * (n[x] + n[other] - most)]
                    found.update((min(id_[x], y), max(id_[x], y)) for y in id_[other].tolist())

        def out() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            found.clear()
            return batch

        for batch in batches:
            columns = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "i", "j", "n", "m", "root", "id", "block")}
            columns["slices"] = batch.column("slices").flatten().to_numpy(zero_copy_only=False).reshape(-1, SLICES)
            keys = np.stack([columns[k] for k in ("key", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if key is not None and tuple(keys[a]) != key:
                        pairs()
                        parts = []
                        if len(found) > 100_000:
                            yield out()
                    key = tuple(keys[a])
                    parts.append({k: v[a:b] for k, v in columns.items()})
        if parts:
            pairs()
        yield out()

    return run


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of ids that meet under a key, have different roots and may link. rows: (key, root, id, n, m, slices).

    The rows of a key are cut into blocks of about BLOCK. A root with that many is cut into blocks of its own, which don't meet each other; the other roots share blocks.
    """
    roots = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"))
    small = F.when(F.col("rows") < BLOCK, F.col("rows")).otherwise(0)
    keys = roots.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.sum(small).alias("mixed")).where("roots > 1")
    # of each root of a key: where its blocks begin, and how many they are; mixed blocks come first
    large = F.ceil(F.col("rows") / BLOCK)
    mixed = F.ceil(F.col("mixed") / BLOCK)
    big = roots.where(F.col("rows") >= BLOCK).select("key", "root", large.cast("int").alias("size"))
    lists = big.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("root", "size"))).alias("big"))
    # plans and leaders are written before they are joined, so that the rows of a hot key can be split in the join
    plan = keys.join(lists, "key", "left").select("key", mixed.cast("int").alias("mixed"), F.coalesce("big", F.array().cast("array<struct<root:bigint,size:int>>")).alias("big"))
    placed = rows.join(maybe_broadcast(table(plan, "blocks"), BROADCAST_IDS // 20), "key")
    spot = F.expr("get(filter(transform(big, (x, p) -> struct(x.root AS root, x.size AS size, mixed + aggregate(slice(big, 1, p), 0, (t, y) -> t + y.size) AS first)), x -> x.root = root), 0)")
    total = F.col("mixed") + F.aggregate("big", F.lit(0), lambda t, y: t + y["size"])
    placed = placed.withColumn("spot", spot).withColumn("total", total)
    own = F.col("spot").isNotNull()
    block = F.when(own, F.col("spot.first") + F.pmod(F.xxhash64("id"), F.col("spot.size"))).otherwise(F.pmod(F.xxhash64("root"), F.col("mixed"))).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("total") - 1), lambda k: ~own | (k < F.col("spot.first")) | (k >= F.col("spot.first") + F.col("spot.size")))
    sent = placed.withColumn("block", block).withColumn("other", F.explode(others))
    sent = sent.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "root", "id", "n", "m", "slices")
    sent = sent.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return sent.mapInArrow(_block_pairs(percent), "a bigint, b bigint").distinct()


def _roots(links: DataFrame, stars: DataFrame) -> DataFrame:
    """(node, root) of the components of links and of earlier stars."""
    return components(stars.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))


def _with_roots(df: DataFrame, stars: DataFrame) -> DataFrame:
    return df.join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _node_roots(able: DataFrame, percent: int) -> DataFrame:
    """(node, root) of linked nodes. able: (node, n, m, prefix, key, slices, hashes), written."""
    # the first member of a group, or unit, is the one that shares most: others are edits of it rather than of each other
    first = F.min(F.struct((-F.col("m")).alias("minus"), "node"))["node"]
    groups = able.groupBy("n", "key").agg(first.alias("group"), F.max("m").alias("most"))
    groups = table(groups, "groups")
    members = able.select("node", "n", "m", "key", "slices").join(groups, ["n", "key"]).select("node", "group", "n", "m", "most", "slices")
    members = table(members, "members")

    heads = members.where(F.col("node") == F.col("group")).select("group", "most").join(able.select(F.col("node").alias("group"), "n", "prefix"), "group")
    tokens = table(heads.select("group", "n", "most", F.explode("prefix").alias("token")), "tokens")
    leaders = tokens.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("most")).alias("own"), "group", "n", "most")).alias("l"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    pairs = tokens.join(table(leaders, "leaders"), "token").where((F.col("group") != F.col("l.group")) & possible(F.col("n"), F.col("most"), F.col("l.n"), F.col("l.most"), percent))
    pairs = pairs.select("group", F.col("l.group").alias("leader")).distinct().join(members.select("group", "node"), "group")
    pairs = pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    inner = members.where("node <> group").select(F.col("group").alias("a"), F.col("node").alias("b"))
    stars = components(_verified(pairs.union(inner), able, percent))

    # units are named by their first member
    rooted = table(_with_roots(members, stars), "rooted")
    bounds = F.array(*(F.max(F.col("slices")[k]) for k in range(SLICES)))
    units = rooted.groupBy("group", "root").agg(first.alias("id"), F.first("n").alias("n"), F.max("m").alias("m"), F.count(F.lit(1)).alias("size"), bounds.alias("slices"))
    units = table(units, "units")
    meeting = tokens.select("group", F.col("token").alias("key")).join(units.select("group", "root"), "group")
    open_ = meeting.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    rows = tokens.select("group", F.col("token").alias("key")).join(open_, "key", "left_semi").join(units, "group")
    rows = table(rows.select("key", "root", "id", "n", "m", "slices"), "unit_rows")
    pairs = table(_candidates(rows, percent), "unit_pairs")
    if pairs.isEmpty():
        return stars
    links = table(_verified(pairs, able, percent), "unit_links")
    if not links.isEmpty():
        stars = _roots(links, stars)

    # what the first members don't join is expanded to all members
    sized = units.select(F.col("id").alias("node"), "size")
    side = lambda k: _with_roots(sized, stars).select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"), F.col("root").alias(f"root_{k}"))
    apart = pairs.join(side("a"), "a").join(side("b"), "b").where("root_a <> root_b AND size_a * size_b > 1")
    apart = table(apart.select(F.monotonically_increasing_id().alias("key"), F.explode(F.array("a", "b")).alias("unit")), "open_pairs")
    if apart.isEmpty():
        return stars
    named = rooted.join(units.select("group", "root", F.col("id").alias("unit")), ["group", "root"])
    rows = table(apart.join(named, "unit").select("key", F.col("unit").alias("root"), F.col("node").alias("id"), "n", "m", "slices"), "member_rows")
    more = table(_candidates(rows, percent), "member_pairs")
    links = table(_verified(more, able, percent), "member_links")
    return stars if links.isEmpty() else _roots(links, stars)


def _linked(docs: DataFrame, percent: int, words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, component_id) of every row, (digest, root, component_id) of every set that may link, and (id) of documents of several rows."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sampled = table(docs.mapInArrow(_samples(words), "doc_id bigint, n bigint, mark bigint, sample array<bigint>"), "samples")
    counted = sampled.select("mark", F.explode("sample").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("rows"), F.min("mark").alias("mark"))
    own = table(counted.where("rows = 1").groupBy("mark").agg(F.count(F.lit(1)).alias("own")), "own")  # written, so that a hot mark's rows can be split in the join
    alive = (F.col("n") > 0) & (F.coalesce("own", F.lit(0)) <= F.col("n") - needed(F.col("n"), percent))
    sized = table(sampled.select("doc_id", "n", "mark").join(own, "mark", "left").select("doc_id", "n", alive.alias("alive")), "sizes")

    ids = table(sized.where("alive").select(F.col("doc_id").alias("id")).distinct(), "alive")
    few = maybe_broadcast(ids, BROADCAST_IDS)
    here = F.col("doc_id").eqNullSafe(F.col("id"))
    sets = table(docs.join(few, here, "left_semi").mapInArrow(_sets(words), "doc_id bigint, n bigint, digest binary, hashes binary"), "sets")
    some = sets.where("n > 0").select("digest", "n", "hashes").dropDuplicates(["digest"])
    nodes = table(some.withColumn("node", F.monotonically_increasing_id()), "nodes")

    each = nodes.select("node", "hashes").mapInArrow(_unpack, "node bigint, hashes array<bigint>").select("node", F.explode("hashes").alias("hash"))
    counts = table(each.groupBy("hash").agg(F.count(F.lit(1)).alias("count")).where("count > 1"), "counts")
    shared = each.join(counts, "hash").groupBy("node").agg(F.collect_list(F.struct("count", "hash")).alias("shared"))
    shared = shared.join(nodes.select("node", "n"), "node")
    able = table(shared.mapInArrow(_prefixes(percent), "node bigint, n bigint, m bigint, prefix array<bigint>, key binary, slices array<int>, hashes binary"), "prefixes")
    stars = _node_roots(able, percent)

    named = table(_with_roots(nodes.select("digest", "node"), stars).select("digest", "root"), "roots")
    linked = table(sets.select("doc_id", "n", "digest").join(named, "digest", "left"), "linked")
    # rows of one document join its components
    several = linked.where("doc_id is not null").groupBy("doc_id").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    more = linked.join(several, "doc_id").where("root > low").select(F.col("low").alias("a"), F.col("root").alias("b"))
    more = table(more.distinct(), "document_links")
    if not more.isEmpty():
        higher = components(more).select(F.col("node").alias("root"), F.col("root").alias("higher"))
        named = named.join(higher, "root", "left").select("digest", F.coalesce("higher", "root").alias("root"))
        linked = linked.join(higher, "root", "left").select("digest", "doc_id", "n", F.coalesce("higher", "root").alias("root"))
    least = table(linked.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")), "components")
    alive_rows = linked.join(least, "root", "left").select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    dead = sized.join(few, here, "left_anti").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    rows = alive_rows.union(dead)
    twice = table(sized.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).count().where("count > 1").select("id"), "repeated")
    if not twice.isEmpty():
        low = rows.join(maybe_broadcast(twice, BROADCAST_IDS), F.col("doc_id") == F.col("id"), "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.min("component_id").alias("low"))
        low = maybe_broadcast(table(low, "least_of_repeated"), BROADCAST_IDS)
        rows = rows.join(low, F.col("doc_id") == F.col("id"), "left").select("doc_id", "n", F.coalesce("low", "component_id").alias("component_id"))
    return rows, named.join(least, "root").select("digest", "root", "component_id"), twice


def link(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    rows, _, _ = _linked(docs, percent, words)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """One row of each document, and one document of each component: that of the smallest doc_id.

    Of rows with one doc_id that of the first text stays. Of linked rows without a doc_id one stays if no linked document has an id; those that link with nothing all stay.
    """
    rows, sets, twice = _linked(docs, percent, words)
    gone = table(rows.where("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    left = docs.join(maybe_broadcast(gone, BROADCAST_IDS), docs["doc_id"] == F.col("__gone"), "left_anti").where("doc_id is not null")
    if not twice.isEmpty():
        few = maybe_broadcast(twice.withColumnRenamed("id", "__twice"), BROADCAST_IDS)
        here = F.col("doc_id") == F.col("__twice")
        row = F.struct(*(quoted(c) for c in docs.columns))
        first = left.join(few, here, "left_semi").groupBy("doc_id").agg(F.min_by(row, F.coalesce("text", F.lit(""))).alias("__row"))
        left = left.join(few, here, "left_anti").union(first.select("__row.*"))
    unnamed = docs.where("doc_id is null")
    if unnamed.isEmpty():
        return left
    mark = free(docs, "_digest")
    names = [*docs.columns, mark]

    @releasing
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in shingle_sets(part.column("text"), words)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], names=names)

    marked = unnamed.mapInArrow(digests, StructType([*docs.schema.fields, StructField(mark, BinaryType())]))
    known = sets.select(F.col("digest").alias(mark), F.col("root").alias("__root"), F.col("component_id").alias("__component"))
    marked = marked.join(known, mark, "left")
    alone = marked.where("__root is null").select(*docs.columns)
    row = F.struct(*(quoted(c) for c in docs.columns))
    one = marked.where("__root is not null and __component is null").groupBy("__root").agg(F.min_by(row, "text").alias("__row"))
    return left.union(alone).union(one.select("__row.*"))
