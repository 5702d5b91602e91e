"""The operators that have a SQL twin, on the given tables and on odd rows."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from tests.conftest import SF_DIR
from tests.oracle import compare, connect
from threadmine.llm import decontaminate, quality_rules
from threadmine.llm.queries import ORACLES, QUERIES

NO_PYTHON = ("Python", "Pandas", "Arrow", "MapInArrow")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF_DIR), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["op2_decontamination", "op3_quality_rules", "op10_sharding"])
def test_plan_is_native(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in NO_PYTHON) and "Cartesian" not in plan and "NestedLoop" not in plan


def counts(text: str | None) -> tuple:
    raw = text or ""
    words = [w.decode() for w in raw.encode().split()]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in raw.split("\n") if x.encode().split()]
    symbols = sum(c in "#*$%&|<>" for c in raw)
    n = len(words)
    return n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_counts_equal_brute_force(spark):
    rng = random.Random(9)
    parts = ["a", "b", "é", "𝄞", "#", "|", "\n", " ", "\t", "\x0b", "\x0c", "\r", "\xa0", "\x85", "\x1c"]
    texts = [None, "", " \n\t", "a b c a b c", "x y z x y", "# | $", *["".join(rng.choices(parts, k=rng.randint(1, 200))) for _ in range(200)]]
    texts += [" ".join(rng.choices("abc", k=3000)), "word " * 40_000, "one two\n" * 60]
    rows = [(i, t, None if i % 3 else "en", f"s{i % 2}", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, words int")
    got = {r.doc_id: r for r in quality_rules.apply_rules(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(t), repr(t)[:80]
        assert not (r.kept and r.base_failed)


def test_limits_follow_the_group(spark):
    """The same text is kept where it is usual and fails where it is not."""
    rng = random.Random(1)

    def text(symbols):
        words = [f"w{rng.randrange(10_000)}" for _ in range(100)]
        return " ".join(words[:100 - symbols] + [w + "|" for w in words[100 - symbols:]])

    rows = [(i, text(60 + i % 10), "en", "tables") for i in range(200)] + [(1000 + i, text(0), "en", "prose") for i in range(200)]
    rows += [(5000, text(65), "en", "tables"), (5001, text(65), "en", "prose"), (5002, text(0), "xx", "new")]
    got = {r.doc_id: r for r in quality_rules.apply_rules(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[5000].kept and not got[5001].kept and got[5001].failed == ["symbols"] and got[5002].kept
    assert all(r.kept for i, r in got.items() if i < 5000)


def test_rules_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality_rules.apply_rules(docs).count() == 0


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def test_containment_equals_brute_force(spark):
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randint(3, 60)))) for i in range(60)]
    items += [(60, None), (61, "too short"), (62, "q " * 50), (62, items[0][1])]
    docs = [(None, items[0][1]), (0, None), (0, ""), (1, items[1][1].upper()), (1, items[1][1])]
    for i in range(2, 150):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([10, 300, 6000]))]
        for _ in range(rng.randint(0, 3)):
            part = (items[rng.randrange(60)][1]).split()
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = part
        docs.append((i, " ".join(words)))
    got = {(r.doc_id, r.item_id): (r.n_item, r.n_shared) for r in decontaminate.contained_items(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in docs:
        for i, s in items:
            q = shingles(s)
            n = len(q & shingles(t))
            if d is not None and q and 100 * n >= 80 * len(q):
                want[d, i] = (len(q), n)
    assert got == want


def test_containment_on_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.contained_items(none, items).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontaminate.contained_items(docs, items.where("false")).count() == 0


@pytest.mark.parametrize("smallest", [1, 5, 10, 50, 500])
def test_load_keeps_the_miss_small(smallest):
    import math

    load = decontaminate.load_for(smallest, 80)
    shared = -(-smallest * 80 // 100)
    assert (1 - (1 - math.exp(-load)) / load) ** shared <= decontaminate.MISS or load <= 1 / 64


def test_miss_holds_for_items_of_one_shingle():
    import math

    for smallest in (1, 2, 3):
        load = decontaminate.load_for(smallest, 80)
        assert (1 - (1 - math.exp(-load)) / load) ** max(1, -(-smallest * 80 // 100)) <= decontaminate.MISS
    assert decontaminate.load_for(11, 80) >= 1 / 64
