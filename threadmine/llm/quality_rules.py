"""Quality rules whose limits follow the data: quantile sketches per language and source.

A sketch is a histogram over buckets of bounded relative width (1/64): values below 128 have a bucket each,
larger ones share their seven leading bits. Sketches of parts merge by adding counts, in any order, so the
counts of all documents are gathered in one partial aggregation, and the sketches of a language or of the
whole table are sums of those of the sources. A group with fewer than ``MIN_ROWS`` documents uses the sketch
of its language, a language with fewer that of all documents.

A document fails a rule beyond the far fence of its group: the third quartile plus three times the
distance between the quartiles (for word length also below the first one), but at least a rule's least margin
away, so that a group without spread does not reject everything that differs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmine.llm.common import text_or_empty, words_of
from threadmine.session import stage

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_ROWS = 100
FENCE = 3
# Rule: (column, least margin, is there a lower fence). All values are integers.
RULES = {
    "symbols": ("symbol_rate", 50, False),  # per 1,000 words
    "lines": ("line_rate", 500, False),  # repeated lines per 1,000 lines with a word
    "repeats": ("repeat_rate", 400, False),  # repeated words per 1,000 words
    "length": ("word_length", 150, True),  # characters per 100 words
}


def repeat_words(frame: DataFrame) -> DataFrame:
    """Add n_repeat_words to a frame with ``words``: words in 3-word windows that occur twice or more.

    Windows are sorted as one number each, hash above position, so equal windows become
    neighbours and nothing but the row's own arrays is needed. Neighbours count as equal if their whole
    64-bit hashes are.
    """
    n, bits = F.size("words"), F.length(F.bin(F.size("words").cast("long")))
    hashes = frame.withColumn("_h", F.transform("words", lambda w: F.xxhash64(w))).withColumn("_bits", bits)
    windows = hashes.withColumn("_w", F.transform(
        F.slice("_h", F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get("_h", i + 1), F.get("_h", i + 2))))
    packed = windows.withColumn("_sorted", F.sort_array(F.transform("_w", lambda x, i: F.call_function(
        "shiftleft", x, F.col("_bits")).bitwiseOR(i.cast("long")))))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bits")) - 1)

    def window(x: Column) -> Column:
        return F.get("_w", place(x).cast("int"))

    def equal(x: Column, i: Column) -> Column:
        return F.coalesce(window(x) == window(F.get("_sorted", i)), F.lit(False))

    places = packed.withColumn("_places", F.sort_array(F.transform(
        F.filter("_sorted", lambda x, i: equal(x, i - 1) | equal(x, i + 1)), place)))
    covered = F.transform("_places", lambda p, i: F.least(
        F.lit(3).cast("long"), F.coalesce(F.get("_places", i + 1) - p, F.lit(3).cast("long"))))
    return places.withColumn(
        "n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda total, x: total + x)
    ).drop("_h", "_bits", "_w", "_sorted", "_places")


def base_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed)."""
    text = text_or_empty()
    length = F.char_length(text).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, BLANKS, "") != "")
    rows = docs.select(
        "doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.char_length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (length - F.char_length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        lines.alias("lines"), words_of(text).alias("words"),
    )
    return repeat_words(rows).select(
        "doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def with_rates(counts: DataFrame) -> DataFrame:
    """Add the integer value of each rule (0 where there is no word)."""
    def rate(times: int, part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.expr(f"{times} * {part} div {whole}")).otherwise(F.lit(0)).cast("long")

    return counts.withColumns({
        "symbol_rate": rate(1000, "n_symbols", "n_words"), "line_rate": rate(1000, "n_dup_lines", "n_lines"),
        "repeat_rate": rate(1000, "n_repeat_words", "n_words"), "word_length": rate(100, "word_chars", "n_words"),
    })


def bucket_of(value: Column) -> Column:
    """Bucket of a value that is not negative: its seven leading bits and how far they were shifted."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return shift * 128 + F.call_function("shiftright", value, shift)


def bucket_end(bucket: Column) -> Column:
    """The largest value of a bucket."""
    shift = (bucket / 128).cast("int")
    return F.call_function("shiftleft", (bucket % 128 + 1).cast("long"), shift) - 1


def sketches(rates: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): one mergeable histogram per group and rule, over all rows."""
    values = F.array(*[F.struct(F.lit(rule).alias("rule"), bucket_of(F.col(column)).alias("bucket"))
                       for rule, (column, _, _) in RULES.items()])
    return rates.select("lang", "source", F.explode(values).alias("v")).groupBy(
        "lang", "source", F.col("v.rule").alias("rule"), F.col("v.bucket").alias("bucket")
    ).agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """First and third quartile of the merged sketches of ``keys`` and rule, with the number of rows."""
    merged = sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rule")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = merged.withColumn("upto", upto).withColumn("rows", F.sum("n").over(group))

    def first_with(quarters: int) -> Column:
        return bucket_end(F.min(F.when(4 * F.col("upto") >= quarters * F.col("rows"), F.col("bucket"))))

    return marked.groupBy(*keys, "rule").agg(
        F.max("rows").alias("rows"), first_with(1).alias("q1"), first_with(3).alias("q3"))


def limits(sketch: DataFrame) -> DataFrame:
    """One row per language and source: the lower and upper limit of each rule."""
    levels = [quartiles(sketch, keys).select(
        *keys, "rule", *[F.col(c).alias(f"{c}_{i}") for c in ("rows", "q1", "q3")])
        for i, keys in enumerate((["lang", "source"], ["lang"], []))]
    one, two, three = levels
    two = two.withColumnRenamed("lang", "lang_2")
    joined = one.join(two, one["lang"].eqNullSafe(two["lang_2"]) & (one["rule"] == two["rule"]), "left").drop(
        two["rule"]).join(three, ["rule"])

    def chosen(c: str) -> Column:
        return F.when(F.col("rows_0") >= MIN_ROWS, F.col(f"{c}_0")).when(
            F.col("rows_1") >= MIN_ROWS, F.col(f"{c}_1")).otherwise(F.col(f"{c}_2"))

    margin = F.element_at(F.create_map(*[F.lit(x) for r, (_, m, _) in RULES.items() for x in (r, m)]), F.col("rule"))
    fenced = joined.select("lang", "source", "rule", chosen("q1").alias("q1"), chosen("q3").alias("q3")).withColumn(
        "far", F.greatest(FENCE * (F.col("q3") - F.col("q1")), margin))
    return fenced.groupBy("lang", "source").agg(*[
        F.max(F.when(F.col("rule") == rule, value)).alias(f"{rule}_{side}")
        for rule, (_, _, lower) in RULES.items()
        for side, value in (("most", F.col("q3") + F.col("far")), *([("least", F.col("q1") - F.col("far"))] if lower else []))
    ])


def apply_rules(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, failed (names of the rules failed) and kept, of every row of ``docs``.

    Limits are learned from the rows that pass the base rules. A null text counts as empty and fails
    them; null languages and sources are groups of their own; repeated rows count each; a group
    without any row that passes gets no limits and keeps nothing. An empty table gives an empty result.
    Needs (doc_id, text, lang, source); other columns are ignored.
    """
    rates = stage(with_rates(base_counts(docs)), "rates")
    bounds = limits(stage(sketches(rates.where(~F.col("base_failed"))), "sketches")).withColumnsRenamed(
        {"lang": "_lang", "source": "_source"})
    judged = rates.join(
        bounds, rates["lang"].eqNullSafe(bounds["_lang"]) & rates["source"].eqNullSafe(bounds["_source"]), "left")
    beyond = [
        F.when((F.col(column) > F.col(f"{rule}_most")) | (F.col(column) < F.col(f"{rule}_least") if lower else F.lit(False)),
               F.lit(rule))
        for rule, (column, _, lower) in RULES.items()
    ]
    return judged.withColumn("failed", F.array_compact(F.array(*beyond))).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("_lang", "_source")


def _level(keys: str) -> str:
    on = f"{keys}, " if keys else ""
    return f"""
    SELECT {on}rule, max(total) AS n_rows,
           (((q1b % 128) + 1) << (q1b // 128)) - 1 AS q1, (((q3b % 128) + 1) << (q3b // 128)) - 1 AS q3
    FROM (SELECT {on}rule, max(upto) AS total, min(bucket) FILTER (4 * upto >= total) AS q1b,
                 min(bucket) FILTER (4 * upto >= 3 * total) AS q3b
          FROM (SELECT {on}rule, bucket, sum(n) OVER (PARTITION BY {on}rule) AS total,
                       sum(n) OVER (PARTITION BY {on}rule ORDER BY bucket) AS upto
                FROM (SELECT {on}rule, bucket, count(*) AS n FROM buckets GROUP BY ALL))
          GROUP BY {on}rule) GROUP BY ALL"""


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)
), win AS (
  SELECT doc_id, pos, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w
  WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), twice AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, w3, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS c FROM win)
  WHERE w3 IS NOT NULL AND c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words FROM twice, range(3) r(k) GROUP BY doc_id
), wc AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY doc_id
), ln AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), base AS (
  SELECT doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN wc USING (doc_id) LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)
), rates AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
         coalesce(1000 * n_symbols // nullif(n_words, 0), 0) AS symbol_rate,
         coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS line_rate,
         coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS repeat_rate,
         coalesce(100 * word_chars // nullif(n_words, 0), 0) AS word_length
  FROM base
), buckets AS (
  SELECT lang, source, rule, greatest(length(bin(v)) - 7, 0) * 128 + (v >> greatest(length(bin(v)) - 7, 0)) AS bucket
  FROM (
    SELECT lang, source, unnest(['symbols', 'lines', 'repeats', 'length']) AS rule,
           unnest([symbol_rate, line_rate, repeat_rate, word_length])::BIGINT AS v
    FROM rates WHERE NOT base_failed)
), l0 AS ({_level("lang, source")}), l1 AS ({_level("lang")}), l2 AS ({_level("")}
), chosen AS (
  SELECT l0.lang, l0.source, l0.rule,
         CASE WHEN l0.n_rows >= {MIN_ROWS} THEN l0.q1 WHEN l1.n_rows >= {MIN_ROWS} THEN l1.q1 ELSE l2.q1 END AS q1,
         CASE WHEN l0.n_rows >= {MIN_ROWS} THEN l0.q3 WHEN l1.n_rows >= {MIN_ROWS} THEN l1.q3 ELSE l2.q3 END AS q3
  FROM l0 LEFT JOIN l1 ON l0.lang IS NOT DISTINCT FROM l1.lang AND l0.rule = l1.rule JOIN l2 ON l0.rule = l2.rule
), fenced AS (
  SELECT lang, source, rule, q1 - far AS least, q3 + far AS most FROM (
    SELECT *, greatest({FENCE} * (q3 - q1), CASE rule {" ".join(f"WHEN '{r}' THEN {m}" for r, (_, m, _) in RULES.items())} END) AS far
    FROM chosen)
), beyond AS (
  SELECT DISTINCT doc_id FROM rates r JOIN fenced f
    ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source
  WHERE CASE rule WHEN 'symbols' THEN symbol_rate > most WHEN 'lines' THEN line_rate > most
                  WHEN 'repeats' THEN repeat_rate > most ELSE word_length > most OR word_length < least END
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM beyond) AS kept
FROM rates
"""
