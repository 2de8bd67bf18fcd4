"""Personal data in texts: proposed by regular expressions, confirmed by checksums, scored by context.

Everything is one projection of built-in functions: no Python on the executors and no shuffle, so a hot source or a group of
copies changes nothing. The cost grows in proportion to the texts: patterns don't backtrack over what they have read, offsets are running
sums of the lengths of matches and of the texts between them, taken in blocks, and context is looked for in those texts.

A null or empty text has no spans. Other columns stay as they are, but one that has the name of the result is replaced;
repeated rows are scored one by one. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import free

SPAN = "array<struct<start:bigint,ord:int,stop:bigint,kind:string,score:double>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _octets(hit: Column) -> Column:
    return hit.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string is right (Luhn)."""

    def worth(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        double = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(double > 9, double - 9).otherwise(double))

    at = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(at, F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN's rearranged number leaves 1 when divided by 97."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    at = F.sequence(F.lit(1), F.length(turned))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, rest * 100 + (c - 55)).otherwise(rest * 10 + (c - 48)) % 97

    return F.aggregate(at, F.lit(0), step) == 1


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    gate: str  # a plain string without which the pattern can't match; "" if there is none
    needs: str  # else a cheaper pattern without which it can't match
    confirmed: Callable[[Column], Column]  # how many characters of a match, from its beginning, are a span; 0 if none
    base: float
    context: str  # words that, shortly before or after a match, raise its score


def _if(test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda hit: F.when(test(hit), F.length(hit)).otherwise(0)


def _iban(hit: Column) -> Column:
    """The whole match, or what is before its last blank: a word in capitals may follow the groups of four."""
    shorter = F.regexp_replace(hit, r"\x20[A-Z0-9]+$", "")
    code = lambda h: F.replace(h, F.lit(" "), F.lit(""))
    return F.when(mod97(code(hit)), F.length(hit)).when((shorter != hit) & mod97(code(shorter)), F.length(shorter)).otherwise(0)


# Possessive and anchored forms of the published patterns: the same leftmost matches without backtracking.
RULES = (
    Rule("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "", F.length, 0.8, "mail|contact|write|address"),
    Rule("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "", r"[0-9]\.[0-9]", _if(_octets), 0.6, "ip|host|server|address|login"),
    Rule("card", r"[0-9](?:[\x20-]?[0-9])++", "", r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", _if(lambda h: F.length(_digits(h)).between(12, 19) & luhn(_digits(h))), 0.7, "card|visa|pay|credit|account"),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", "", _if(lambda h: F.length(_digits(h)).between(9, 15)), 0.6, "phone|tel|call|mobile|fax"),
    Rule("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9_])", "", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", _iban, 0.9, "iban|bank|account|transfer"),
)
BASE = ("email", "ip", "card", "phone")
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.15
#: Matches whose offsets are added up at once.
BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _placed(hits: Column, gaps: Column) -> Column:
    """(start, hit, before, after) of matches, from the texts around them: running sums in blocks, so that no long array is copied for each match."""
    n = F.size(hits)
    left = F.zip_with(F.slice(gaps, F.lit(1), n), hits, lambda g, h: F.struct(g.alias("before"), h.alias("hit")))
    both = F.zip_with(left, F.slice(gaps, F.lit(2), n), lambda x, g: F.struct(x["before"].alias("before"), x["hit"].alias("hit"), g.alias("after")))
    row = "struct<start:bigint,hit:string,before:string,after:string>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        one = F.struct(start.alias("start"), x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct((start + F.length(x["hit"])).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def block(every: Column) -> Callable[[Column, Column], Column]:
        def add(acc: Column, k: Column) -> Column:
            inner = F.aggregate(F.slice(every, k * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["at"].alias("at"), F.array().cast(f"array<{row}>").alias("out")), step)
            return _let(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(acc["out"], F.array(i["out"])).alias("out")))

        return add

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{row}>>").alias("out"))
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
    return _let(both, lambda every: F.aggregate(blocks, zero, block(every), lambda acc: F.flatten(acc["out"])))


def _spans(rule: Rule, ord_: int, hits: Column, gaps: Column) -> Column:
    """Confirmed spans of one rule. Context is what lies between matches of the rule, up to CONTEXT_CHARS of it on each side."""

    def score(x: Column) -> Column:
        near = F.concat_ws(" ", F.right(x["before"], F.lit(CONTEXT_CHARS)), F.left(x["after"], F.lit(CONTEXT_CHARS)))
        return F.when(F.lower(near).rlike(rf"(?:^|[^a-z])(?:{rule.context})"), F.lit(rule.base + CONTEXT_BONUS)).otherwise(F.lit(rule.base))

    def span(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(ord_).alias("ord"), (x["start"] + rule.confirmed(x["hit"])).alias("stop"), F.lit(rule.kind).alias("kind"), score(x).alias("score"))

    found = F.filter(F.transform(_placed(hits, gaps), span), lambda s: s["stop"] > s["start"])
    return F.when(F.size(hits) > 0, found).otherwise(F.array().cast(SPAN))


def find_pii(df: DataFrame, text: str = "text", out: str = "pii", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds `out`: every confirmed span (start, ord, stop, kind, score), by start and then by the rules' order.

    split() and regexp_extract_all() find the same matches. Each is a column of its own, so that it is evaluated
    once, and texts are split only where there are matches.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")

    def hits(r: Rule) -> Column:
        got = F.regexp_extract_all(whole, F.lit(r.pattern), F.lit(0))
        return F.when(F.contains(whole, F.lit(r.gate)) if r.gate else whole.rlike(r.needs), got).otherwise(none)

    h = {r.kind: free(df, f"_{r.kind}_hits") for r in rules}
    g = {r.kind: free(df, f"_{r.kind}_gaps") for r in rules}
    cut = df.withColumns({h[r.kind]: hits(r) for r in rules})
    cut = cut.withColumns({g[r.kind]: F.when(F.size(h[r.kind]) > 0, F.split(whole, r.pattern, -1)).otherwise(none) for r in rules})
    found = F.concat(*(_spans(r, i, F.col(h[r.kind]), F.col(g[r.kind])) for i, r in enumerate(rules)))
    return cut.withColumn(out, F.array_sort(found)).drop(*h.values(), *g.values())


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(found: DataFrame, kinds: tuple[str, ...] = BASE) -> DataFrame:
    """One row per row of found: counts of the base kinds, the digest of their spans, and all spans."""
    only = lambda *k: F.filter("pii", lambda s: s["kind"].isin(*k))
    return found.select(
        "doc_id",
        *(F.size(only(k)).cast("long").alias(f"n_{k}") for k in kinds),
        F.sha2(listed(only(*kinds)), 256).alias("base_sha256"),
        listed(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )
