"""What each of several filters does, alone, in every order and in fair shares.

Documents are marked once with the filters they fail. All else follows from the removals of the coalitions, which are the 2^n sets of filters:
a coalition removes a document that fails any of its filters. In an order of the filters each step removes what the coalition up to it removes more than the one before.
Fair shares (Shapley values) are the exact solution of a least squares problem: of all additive models of the coalitions' removals, weighted by the Shapley kernel, that
give all filters together what they remove together (efficiency), the one of least error. Its normal equations don't depend on the counts,
so they are solved once, in rationals, for each coalition as the right-hand side; a part's shares are the solution applied to its removals, in whole numbers.

Only (id, part, digest, mark) of a document is shuffled. Rows that are alike are added up before each shuffle; a group of copies or a part of any size
is a few rows from each task. Copies are found by the SHA-256 of the text. What comes after has 2^n rows for each part.

Null texts are empty, null parts the empty string. A text that a row of a smaller id has too is a copy; a row without an id is neither copy nor original,
and rows of the same id and text are no copies of each other. Labels: a row without any has none; of several for one id, any that is 1 counts. Empty tables have no parts and
give no rows. Other columns play no part.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import table, words

WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 50, 65, 5


def text_filters(text: Column, least_words: int = LEAST_WORDS, distinct_percent: int = DISTINCT_PERCENT, capitals_percent: int = CAPITALS_PERCENT) -> list[Column]:
    """Conditions under which a text fails: few words, repeated words, many capitals, signs of mark-up."""
    n = words(text)
    distinct = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < least_words, distinct * 100 < n * distinct_percent, capitals * 100 > F.length(text) * capitals_percent, text.rlike("[#$%&*|]")]


def _bits(conditions: list[Column]) -> Column:
    mask = F.lit(0)
    for i, failed in enumerate(conditions):
        mask = mask + F.when(failed, 1 << i).otherwise(0)
    return mask


def marked(docs: DataFrame, labels: DataFrame, part: str = "source", filters=text_filters) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part that fail just the filters in mask, and how many of them are labelled so. The last filter, after those
    of `filters`, is that of copies."""
    text = F.coalesce(F.col("text"), F.lit(""))
    conditions = filters(F.col("text"))
    texts = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = texts.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _bits(conditions).alias("mask"))
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(one("quality"), one("toxic"))
    rows = rows.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("quality", "toxic")})
    # alike in all but the id: how many rows, the least id, and how many rows have that
    alike = rows.groupBy("digest", "part", "mask", "quality", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"),
    )
    alike = table(alike, "alike_texts")  # read twice, and much less than the texts
    first = alike.groupBy("digest").agg(F.min("least").alias("first"), F.sum("n").alias("all"))
    alike = alike.join(first.where(F.col("all") > 1), "digest", "left")
    original = F.col("unnamed") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    copies = F.when(F.col("all").isNull(), 0).otherwise(F.col("n") - original).cast("long")
    both = F.array(F.struct(F.col("mask"), (F.col("n") - copies).alias("n")), F.struct((F.col("mask") + (1 << len(conditions))).alias("mask"), copies.alias("n")))
    split = alike.select("part", "quality", "toxic", F.inline(both)).where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def coalitions(marks: DataFrame, n: int) -> DataFrame:
    """(part, total, removed, good, toxic): the last three are arrays of what each coalition removes, by the number whose bits are its filters."""
    touched = [F.col("mask").bitwiseAND(F.lit(s)) != 0 for s in range(1 << n)]
    lost = lambda c: F.array(*(F.coalesce(F.sum(F.when(t, F.col(c))), F.lit(0)) for t in touched)).alias("removed" if c == "n" else c)
    return marks.groupBy("part").agg(F.sum("n").alias("total"), lost("n"), lost("good"), lost("toxic"))


def solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X of matrix X = right, exactly; the matrix has an inverse."""
    n, rows = len(matrix), [[*a, *b] for a, b in zip(matrix, right, strict=True)]
    for c in range(n):
        at = next(r for r in range(c, n) if rows[r][c])
        rows[c], rows[at] = rows[at], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c], strict=True)]
    return [row[n:] for row in rows]


def share_weights(n: int) -> list[list[Fraction]]:
    """For each filter the weights of the coalitions' removals whose sum is its fair share.

    Minimises the sum over coalitions S (neither none nor all) of k(S) (v(S) - sum of the shares in S)^2 where the shares add up to v(all). With a multiplier
    for that condition the equations are linear in the shares, and in v on the right.
    """
    every, each = (1 << n) - 1, range(n)
    kernel = {s: Fraction(n - 1, comb(n, size) * size * (n - size)) for s in range(1, every) if (size := s.bit_count())}
    matrix = [[sum((k for s, k in kernel.items() if s >> i & 1 and s >> j & 1), Fraction(0)) for j in each] + [Fraction(1)] for i in each]
    matrix.append([Fraction(1)] * n + [Fraction(0)])
    right = [[kernel[s] if s in kernel and s >> i & 1 else Fraction(0) for s in range(every + 1)] for i in each]
    right.append([Fraction(s == every) for s in range(every + 1)])
    return solved(matrix, right)[:n]


def audit(marks: DataFrame, names: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order of the filters and step in it.

    names: a letter for each filter, in order of the bits of mask. shapley is the fair share times the number of orders, a whole number.
    """
    n, every, orders = len(names), (1 << len(names)) - 1, factorial(len(names))
    shares = [[w * orders for w in weights] for weights in share_weights(n)]
    assert all(w.denominator == 1 for weights in shares for w in weights)
    removed = lambda s: F.element_at("removed", s + 1)
    shapley = F.array(*(sum((removed(F.lit(s)) * int(w) for s, w in enumerate(weights) if w), F.lit(0).cast("long")) for weights in shares))
    parts = coalitions(marks, n).withColumn("shares", shapley)
    steps = parts.select("*", F.explode(F.array(*(F.lit("".join(p)) for p in permutations(names)))).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    prefix = F.expr("substring(filter_order, 1, step - 1)")
    before = sum((F.when(F.instr(prefix, c) > 0, 1 << i).otherwise(0) for i, c in enumerate(names)), F.lit(0))
    steps = steps.withColumn("at", F.instr(F.lit(names), F.expr("substring(filter_order, step, 1)")) - 1).withColumn("before", before)
    steps = steps.withColumn("own", F.expr("shiftleft(1, at)")).withColumn("after", F.col("before") + F.col("own"))
    here = lambda c: (F.element_at(c, F.col("after") + 1) - F.element_at(c, F.col("before") + 1)).cast("long")
    return steps.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - removed(F.col("after"))).alias("kept"),
        here("removed").alias("removed"),
        (removed(F.col("own")) - here("removed")).alias("redundant"),
        (removed(F.lit(every)) - removed(F.lit(every) - F.col("own"))).alias("unique_fails"),
        here("good").alias("good_lost"),
        here("toxic").alias("toxic_lost"),
        F.element_at("shares", F.col("at") + 1).alias("shapley"),
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the four filters of texts and that of copies (E) in each source."""
    return audit(marked(docs, labels), "ABCDE")
