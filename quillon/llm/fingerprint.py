"""Document fingerprints: a canonical exact digest of each text.

Canonical form: Unicode NFKC, full case folding, NFKC again (folding can undo it), and every run of Unicode white
space one blank, none at the ends. The fingerprint is the 128-bit xxHash of its UTF-8. Within buckets of equal
digests the canonical texts themselves are compared: the first of them (by byte order) has the plain digest, others,
which differ though their digests don't, get an ordinal. Two fingerprints are equal or not, so their likeness is 1 or 0.

A null text is taken as empty and has the digest of the empty text. Repeated rows have equal fingerprints. Other
columns are kept by `fingerprints`. Empty input gives empty output.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from math import inf

import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillon.llm.shared import free, maybe_broadcast, partitions, table
from quillon.llm.textkernel import releasing

#: Digests up to which a table of them is broadcast; a larger one is joined by shuffling.
BROADCAST_DIGESTS = 1_000_000
#: Bytes of text in a range of ids.
RANGE_BYTES = 256 << 20


def canonical(text: str | None) -> str:
    folded = " ".join((text or "").split())
    if not folded.isascii():
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", folded).casefold())
        return " ".join(folded.split())
    return folded.lower()


def digest(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text).encode())


def named(text: str | None, apart: dict[str, list[str]]) -> str:
    """The fingerprint, given the canonical texts that share a digest: the first has it plain, others with their number."""
    form = canonical(text)
    mark = xxhash.xxh3_128_hexdigest(form.encode())
    if not apart or mark not in apart:
        return mark
    forms = apart[mark]
    n = forms.index(form) if form in forms else len(forms)
    return f"{mark}.{n}" if n else mark


def _digests(text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [digest(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string())], names=names)

    return run


def _canonical_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        form = [canonical(t) for t in batch.column(0).to_pylist()]
        yield pa.record_batch([pa.array([xxhash.xxh3_128_hexdigest(f.encode()) for f in form], pa.string()), pa.array(form, pa.string())], names=["digest", "canonical"])


def clashes(texts: DataFrame, digests: DataFrame) -> DataFrame:
    """(digest, canonical, ordinal) of canonical texts that share their digest with a different one.

    texts: (text); digests: one row (digest) for each text. Only texts in buckets of two or more are compared; equal ones are
    merged before they are shuffled, so a bucket holds different texts only, however many copies there are.
    """
    many = table(digests.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("digest"), "buckets")

    forms = texts.select("text").mapInArrow(_canonical_forms, "digest string, canonical string")
    shared = forms.join(maybe_broadcast(many, BROADCAST_DIGESTS), "digest", "left_semi").distinct()
    counts = shared.groupBy("digest").agg(F.count(F.lit(1)).alias("forms"), F.collect_list("canonical").alias("all")).where("forms > 1")
    return counts.select("digest", F.posexplode(F.array_sort("all")).alias("ordinal", "canonical"))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each row's text; a column of that name is replaced, unless it is the text itself."""
    if out == text:
        raise ValueError("the fingerprint can't replace its text")
    df = df.drop(out)
    mark, form, nth = (free(df, n) for n in ("_digest", "_form", "_ordinal"))
    with_digest = df.mapInArrow(_digests(text, [*df.columns, mark]), StructType([*df.schema.fields, StructField(mark, StringType())]))
    apart = table(clashes(df.select(F.col(text).alias("text")), with_digest.select(F.col(mark).alias("digest"))), "clashes")
    if apart.isEmpty():
        return with_digest.withColumnRenamed(mark, out)
    apart = apart.select(F.col("digest").alias(mark), F.col("canonical").alias(form), F.col("ordinal").alias(nth))
    named = with_digest.withColumn(form, F.pandas_udf(lambda s: s.map(canonical), "string")(F.coalesce(F.col(text), F.lit("")))).join(apart, [mark, form], "left")
    return named.select(*df.columns, F.concat(mark, F.when(F.col(nth) > 0, F.concat(F.lit("."), F.col(nth))).otherwise("")).alias(out))


def edited_against_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of an edited form of it and of the next document, by ascending doc_id.

    The edited form ends with the beginning of the next document. Ids are cut into ranges; the first document of each
    range also goes to the range before it, so the next document is always at hand and texts are shuffled once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(2, partitions(spark), (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES)
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    # the range of an id is found by binary search; rows without an id are in the first one
    ranges = Bucketizer(splits=[-inf, *sorted(set(map(float, bounds or [0]))), inf], inputCol="id", outputCol="range", handleInvalid="keep")
    docs = ranges.transform(docs.withColumn("id", F.col("doc_id").cast("double"))).drop("id")
    part = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.col("range").cast("int"))
    # one row per range: its first id, and which range comes before it (the last one before the first)
    firsts = docs.groupBy(part.alias("part")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"))).alias("first"))
    firsts = sorted((r["first"]["known"], r["part"], r["first"]["id"]) for r in firsts.collect())
    order = [p for _, p, _ in sorted(firsts, key=lambda x: x[1])]
    before = {p: order[i - 1] for i, p in enumerate(order)}
    lead = spark.createDataFrame([(p, k, before[p]) for _, p, k in firsts], "lead_part int, lead_id bigint, before int")
    keyed = docs.withColumn("part", part)
    keyed = keyed.join(F.broadcast(lead), (F.col("part") == F.col("lead_part")) & F.col("doc_id").eqNullSafe(F.col("lead_id")), "left")
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("ahead"))
    ahead = F.struct(F.col("before").alias("part"), F.lit(1).alias("ahead"))
    sent = keyed.select("doc_id", "text", F.explode(F.when(F.col("before").isNotNull(), F.array(own, ahead)).otherwise(F.array(own))).alias("to"))
    sent = sent.select(F.col("to.part").alias("part"), F.col("to.ahead").alias("ahead"), "doc_id", "text", F.xxhash64("text").alias("tie"))
    sent = sent.repartition(n, "part").sortWithinPartitions("part", "ahead", "doc_id", "tie").select("part", "ahead", "doc_id", "text")

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("next_fingerprint", pa.string())])

    def compare(apart: dict[str, list[str]]) -> DataFrame:
        def row(doc_id: int | None, text: str, mark: str, follower: str, follower_mark: str) -> tuple:
            half = len(text) // 2
            edited = text[: len(text) - half] + follower[:half]
            return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), mark, named(edited, apart), follower_mark

        @releasing
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None  # the row whose next document is yet to come
            for batch in batches:
                out = []
                for part_, is_ahead, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    mark = named(text, apart)
                    if held is not None and held[0] == part_:
                        out.append(row(*held[1:], text, mark))
                    held = None if is_ahead else (part_, doc_id, text, mark)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)

        return table(sent.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"), "fingerprints")

    marked = compare({})
    apart = table(clashes(docs, marked.select(F.col("fingerprint").alias("digest"))), "clashes")
    if not apart.isEmpty():  # of 128-bit digests, so there are a few at most
        forms: dict[str, list[str]] = {}
        for r in apart.orderBy("digest", "ordinal").collect():
            forms.setdefault(r["digest"], []).append(r["canonical"])
        marked = compare(forms)
    like = lambda k: (F.col("fingerprint") == F.col(k)).cast("double")
    return marked.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"))
