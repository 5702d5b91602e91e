"""Mix overlapping sources to target weights by a min-cost flow.

Documents are summed by membership pattern (the set of sources a document belongs
to). A pattern offers its words once at no cost, a second time at a cost and a third
time at a higher one; the flow routes that capacity to the quotas of the sources at
the least cost. What a pattern gives is then taken from its documents in a seeded order.

The driver sees one row per pattern and source; a table with more than ``MAX_PATTERNS``
patterns is refused. Documents are never collected, and no pattern is sorted as a whole:
prefix sums run over ``CELLS`` hash cells, and only the cell in which a pattern's share
ends is put in order.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmine.llm.common import word_count
from threadmine.session import stage

MAX_PATTERNS = 100_000
CELLS = 4096
REPEATS = 3


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS) -> dict:
    """Words each source should give: shares by weight of all words, at most ``repeats`` times its size.

    Sources in code point order (null last) weigh 1, 2, 3, 1, ...; what a source cannot
    give is shared again among the others until no target is above its limit.
    """
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    limit = {s: repeats * sizes[s] for s in order}
    total, fixed, free = float(sum(sizes.values())), {}, list(order)
    while free:
        left, share = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / share > limit[s]]
        if not over:
            return fixed | {s: left * weight[s] / share for s in free}
        fixed |= {s: float(limit[s]) for s in over}
        free = [s for s in free if s not in fixed]
    return fixed


def min_cost_flow(capacity: list[int], members: list[list[int]], quota: list[int], repeats: int = REPEATS) -> list[dict]:
    """Words that each pattern sends to each source: {source: words} by pattern.

    Every repetition of a pattern costs more than the one before, alike for all
    patterns. So the cheapest augmenting path always starts at a pattern in the lowest
    repetition that still has one: the layers are opened in turn and each is filled by
    shortest augmenting paths, which may reroute what earlier paths sent.
    """
    sent: list[dict[int, int]] = [{} for _ in capacity]
    by_source: list[list[int]] = [[] for _ in quota]
    for p, sources in enumerate(members):
        for s in sources:
            by_source[s].append(p)
    left, spare = list(quota), [0] * len(capacity)

    def augment(start: int) -> bool:
        came: dict[tuple[str, int], tuple[str, int]] = {}
        queue, seen = deque([("p", start)]), {("p", start)}
        while queue:
            kind, i = node = queue.popleft()
            if kind == "s" and left[i] > 0:
                path = [node]
                while path[-1] in came:
                    path.append(came[path[-1]])
                path.reverse()
                amount = min(left[i], spare[start])
                for (ka, a), (_, b) in zip(path, path[1:]):
                    if ka == "s":  # taken back from pattern b, which gives it to the next source
                        amount = min(amount, sent[b][a])
                for (ka, a), (_, b) in zip(path, path[1:]):
                    if ka == "p":
                        sent[a][b] = sent[a].get(b, 0) + amount
                    else:
                        sent[b][a] -= amount
                left[i] -= amount
                spare[start] -= amount
                return True
            near = [("s", s) for s in members[i]] if kind == "p" else [("p", p) for p in by_source[i] if sent[p].get(i)]
            for other in near:
                if other not in seen:
                    seen.add(other)
                    came[other] = node
                    queue.append(other)
        return False

    for _ in range(repeats):
        for p, words in enumerate(capacity):
            spare[p] += words
        for p in range(len(capacity)):
            while spare[p] > 0 and augment(p):
                pass
    return sent


def _pattern(sources: Column) -> Column:
    """A text for a set of sources that keeps null apart from every name."""
    return F.to_json(F.struct(F.array_sort(F.array_distinct(sources)).alias("s")), {"ignoreNullFields": "false"})


def mix_sources(docs: DataFrame, sources: Column | None = None, seed: int = 11, whole: bool = False) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, with size, pattern, taken.

    ``sources`` is an array of the sources of a document (default: its ``source`` alone).
    ``taken`` counts the words the mix takes of the document, repetitions included. In
    every pattern the last document taken is cut where the pattern's share ends;
    ``whole`` instead takes that document if at least half of it is asked for.

    Null texts and texts without words have size 0 and are taken with 0 words. Null is a
    source like any other. An empty table gives an empty result. Repeated rows are
    documents of their own. Needs (doc_id, text, source), other columns only pass through.
    """
    sources = F.array(F.col("source").cast("string")) if sources is None else sources
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        word_count(F.col("text")).alias("size"),
        _pattern(sources).alias("pattern"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("place"),
        F.array_sort(F.array_distinct(sources)).alias("_sources"),
    ).withColumn("cell", F.pmod(F.col("place"), F.lit(CELLS)).cast("int"))
    cells = stage(
        rows.groupBy("pattern", "_sources", "cell").agg(F.sum("size").alias("words")), "mixture"
    )
    plan = plan_flow(cells)
    picked = plan.select(
        "pattern", "base", "rest", "source_size", "target",
    )
    share = Window.partitionBy("pattern").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (
        cells.withColumn("upto", F.sum("words").over(share))
        .join(F.broadcast(picked.select("pattern", "rest")), ["pattern"])
        .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
        .groupBy("pattern").agg(F.min("cell").alias("end_cell"),
                                F.min(F.col("upto") - F.col("words")).alias("before"))
    )
    # Both tables have one row per pattern, MAX_PATTERNS at most.
    picked = picked.join(F.broadcast(ends), ["pattern"], "left")
    marked = rows.drop("_sources").join(F.broadcast(picked), ["pattern"])
    last = marked.where(F.col("cell") == F.col("end_cell"))
    in_cell = Window.partitionBy("pattern", "cell").orderBy("place", F.col("row.doc_id"), "size")
    start = F.col("before") + F.coalesce(
        F.sum("size").over(in_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    asked = F.col("rest") - F.col("start")
    extra = (F.when(2 * asked >= F.col("size"), F.col("size")).otherwise(0) if whole
             else F.greatest(F.lit(0), F.least(F.col("size"), asked)))
    last = last.withColumn("start", start).withColumn("extra", extra).drop("start")
    others = marked.where((F.col("cell") != F.col("end_cell")) | F.col("end_cell").isNull()).withColumn(
        "extra", F.when(F.col("cell") < F.col("end_cell"), F.col("size")).otherwise(0))
    return others.unionByName(last).select(
        "row", "size", "pattern", "source_size", "target",
        (F.col("base") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
    )


def plan_flow(cells: DataFrame) -> DataFrame:
    """What each pattern gives: whole repetitions ``base`` and ``rest`` words, and (of a pattern
    with one source) that source's size and target."""
    spark = cells.sparkSession
    found = cells.groupBy("pattern", "_sources").agg(F.sum("words").cast("long").alias("words")) \
        .orderBy("pattern").limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; merge small sources first")
    sizes: dict[str | None, int] = {}
    for r in found:
        for s in r["_sources"]:
            sizes[s] = sizes.get(s, 0) + r.words
    goal = targets(_disjoint(found, sizes))
    names = list(goal)
    number = {s: i for i, s in enumerate(names)}
    sent = min_cost_flow([r.words for r in found], [[number[s] for s in r["_sources"]] for r in found],
                         [int(goal[s] + 0.5) for s in names])
    rows = []
    for r, flow in zip(found, sent):
        total, alone = sum(flow.values()), r["_sources"][0] if len(r["_sources"]) == 1 else None
        single = len(r["_sources"]) == 1
        rows.append((r.pattern, total // r.words if r.words else 0, total % r.words if r.words else 0,
                     sizes[alone] if single else None, goal[alone] if single else None))
    return spark.createDataFrame(rows, "pattern string, base long, rest long, source_size long, target double")


def _disjoint(found: list, sizes: dict) -> dict:
    """Sizes that share out the words of a pattern with several sources evenly, so that the targets add up to all words."""
    if all(len(r["_sources"]) == 1 for r in found):
        return sizes
    out = dict.fromkeys(sizes, 0)
    for r in found:
        n = len(r["_sources"])
        for i, s in enumerate(r["_sources"]):
            out[s] += r.words // n + (i < r.words % n)
    return out
