"""The filter audit against filtering in every order."""

import random
import re
from collections import defaultdict
from fractions import Fraction
from itertools import permutations
from math import factorial

import duckdb
import pyarrow as pa
import pytest

from quillon.llm import filter_audit
from quillon.llm.oracles import ORACLES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failed(rows):
    """(doc_id, part, letters of the filters that the text fails)."""
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, text, source, *_ in rows:
        text = text or ""
        words = WORD.findall(text)
        tests = (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), re.search("[#$%&*|]", text), i is not None and first[text] < i)
        out.append((i, source or "", "".join(c for c, t in zip("ABCDE", tests, strict=True) if t)))
    return out


def by_hand(rows, labels):
    good, toxic = ({i for i, *l in labels if l[n] == 1 and i is not None} for n in (0, 1))
    parts, out = defaultdict(list), []
    for i, part, letters in failed(rows):
        parts[part].append((i, letters))
    for part, docs in parts.items():
        steps, total = [], defaultdict(int)
        for order in permutations("ABCDE"):
            left = docs
            for n, c in enumerate(order, 1):
                gone, left = [d for d in left if c in d[1]], [d for d in left if c not in d[1]]
                total[c] += len(gone)
                steps.append([part, "".join(order), n, len(left), len(gone), sum(c in f for _, f in docs) - len(gone), sum(f == c for _, f in docs), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)])
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(2)
    words = ["word", "Word", "WORD", "other", "é", "日本", "𝒳", "#", "a|b", *(f"w{i}" for i in range(80))]
    texts = [None, "", " \t\r\n", "#", "x" * 200_000, "AB " * 30_000, *(" ".join(rng.choice(words[rng.choice((0, 9)) :]) for _ in range(rng.choice((3, 49, 50, 51, 90)))) for _ in range(60))]
    rows = [(rng.choice((i, i, i, rng.randrange(300), None)), rng.choice(texts[:40] if i % 3 else texts), rng.choice((None, "", "a", "a", "a", "b"))) for i in range(300)]
    rows += [rows[5]] * 4 + [(i, "the same text", "a") for i in range(400, 550)] + [(7, "seven's", "a"), (7, "seven's", "b"), (8, "seven's", "b")]
    labels = [(rng.randrange(300), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for _ in range(200)] + [(None, 1, 1)]
    return rows, labels


def frames(spark, rows, labels):
    docs = [(*r, "x", 1, 2) for r in rows]
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string, part string, quality int, n int").repartition(3), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_every_order(spark, tables):
    got = filter_audit.report(*frames(spark, *tables))
    assert [t for _, t in got.dtypes] == ["string", "string", "int"] + ["bigint"] * 7
    assert sorted(map(tuple, got.collect())) == by_hand(*tables)


def test_no_documents(spark, tables):
    assert filter_audit.report(*frames(spark, [], [])).count() == 0
    assert filter_audit.report(*frames(spark, tables[0][:3], [])).count() == 600 * len({r[2] or "" for r in tables[0][:3]})


def test_audit_in_sql(spark, tables):
    duck = duckdb.connect()
    rows, labels = tables
    duck.register("documents", pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string())))}))
    duck.register("labels", pa.table({n: pa.array([r[i] for r in labels], pa.int64()) for i, n in enumerate(("doc_id", "quality", "toxic"))}))
    got = filter_audit.report(*frames(spark, *tables))
    assert sorted(map(tuple, got.collect())) == sorted(duck.sql(ORACLES["op13_filter_audit"]).select(*got.columns).fetchall())


@pytest.mark.parametrize("n", [2, 3, 5])
def test_least_squares_gives_shapley_values(n):
    weights, rng = filter_audit.share_weights(n), random.Random(n)
    for _ in range(5):
        value = [0, *(rng.randrange(100) for _ in range((1 << n) - 1))]  # any game, also one that no filters make
        shares = [sum((w * v for w, v in zip(ws, value, strict=True)), Fraction(0)) for ws in weights]
        mean = [Fraction(0)] * n
        for order in permutations(range(n)):
            seen = 0
            for i in order:
                mean[i] += Fraction(value[seen | 1 << i] - value[seen], factorial(n))
                seen |= 1 << i
        assert shares == mean and sum(shares) == value[-1]


def test_text_is_read_once(spark, tables):
    """Texts are hashed before anything is shuffled, and read by one scan."""
    docs, labels = frames(spark, *tables)
    plan = filter_audit.marked(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan
