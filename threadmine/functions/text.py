"""Text functions: tokenising, cleaning, markers, response checks, context strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the sparse tokeniser.
STOP_WORDS = """
a an the and or but in on at to for of with by from as is was are were been be have has had do does did
will would could should may might must shall can need dare ought used it its this that these those i you he
she we they what which who whom their my your his her our not no nor so if then else when where why how all
each every both few more most other some such any only own same than too very just also now here there about
into through during before after above below between under again further once up down out off over am being
because until while
""".split()

# Words and signs that mark a response as naming products.
PRODUCT_MARKS = ["product", "brand", "$", "price", "buy", "purchase"]

# The frame around the retrieved texts and the sentence used when there are none.
CONTEXT_HEADER = "Here are some relevant Reddit discussions and recommendations:\n\n"
CONTEXT_FOOTER = (
    "\nPlease focus on answering the user's current question directly using this information. "
    "Prioritize addressing their specific query rather than summarizing previous exchanges."
)
NO_CONTEXT = "No relevant information found."

# Bodies of comments that were taken down.
REMOVED_BODIES = ["[removed]", "[deleted]"]

# (?U): character classes and \b follow Unicode, so "é" is a letter and not a boundary.
_SPARSE_TOKEN = r"(?U)\b[a-z0-9]+\b"
_WORD_TOKEN = r"(?U)\b\w+\b"


def tokenize_sparse(text: Column) -> Column:
    """Lower-case ASCII tokens of two or more characters that are not stop words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(_SPARSE_TOKEN), F.lit(0))
    return F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def tokenize_words(text: Column) -> Column:
    """Lower-case Unicode words, nothing removed; the tokeniser of the BM25 re-ranker."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD_TOKEN), F.lit(0))


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` would remove blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """One blank for each run of white space, none at the ends, null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Words between runs of white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def full_text(title: Column, content: Column) -> Column:
    """Title line, blank line, body: the text of a post that is split into chunks."""
    return F.concat(
        F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(content, F.lit(""))
    )


def year_month(year: Column, month: Column) -> Column:
    return F.format_string("%d-%02d", year, month)


def yyyymm(year: Column, month: Column) -> Column:
    return (year * 100 + month).cast("int")


def post_marker(year: Column, month: Column) -> Column:
    return F.format_string("[From %d-%02d] ", year, month)


def comment_marker(year: Column, month: Column) -> Column:
    return F.format_string("[Comment from %d-%02d] ", year, month)


def clip(text: Column, length: int) -> Column:
    """The first ``length`` characters, for the operators whose feature is a preview."""
    return F.substring(text, 1, length)


def clip_with_dots(text: Column, length: int = 300) -> Column:
    return F.when(F.length(text) > length, F.concat(clip(text, length), F.lit("..."))).otherwise(text)


def is_removed(body: Column) -> Column:
    return F.lower(body).isin(*REMOVED_BODIES)


def is_short(body: Column, minimum: int = 10) -> Column:
    """Empty, or fewer than ``minimum`` characters once stripped; null counts as empty."""
    return F.length(strip(F.coalesce(body, F.lit("")))) < minimum


def has_products(response: Column) -> Column:
    lowered = F.lower(response)
    found = F.lit(False)
    for mark in PRODUCT_MARKS:
        found = found | F.contains(lowered, F.lit(mark))
    return found


def capitalised_words(response: Column) -> Column:
    """Words of more than three characters that begin with a capital."""
    return F.size(
        F.filter(words(response), lambda w: (F.length(w) > 3) & F.rlike(w, F.lit(r"^\p{Lu}")))
    )


def word_count(response: Column) -> Column:
    return F.size(words(response))


def heuristic_score(products: Column, specifics: Column, length: Column) -> Column:
    """0.5, plus 0.15 for products, 0.15 for specifics, 0.1 above 50 words and 0.1 above 100."""
    def bonus(condition: Column, amount: float) -> Column:
        return F.when(condition, F.lit(amount)).otherwise(F.lit(0.0))

    total = (
        F.lit(0.5) + bonus(products, 0.15) + bonus(specifics, 0.15)
        + bonus(length > 50, 0.1) + bonus(length > 100, 0.1)
    )
    return F.least(F.lit(1.0), total)


def response_checks(response: Column) -> dict[str, Column]:
    """The checks that need no judge, as named columns."""
    text = F.coalesce(response, F.lit(""))
    products, specifics, length = has_products(text), capitalised_words(text) >= 2, word_count(text)
    return {
        "has_products": products,
        "has_specifics": specifics,
        "response_length": length,
        "heuristic_score": heuristic_score(products, specifics, length),
    }


def json_inner(text: Column) -> Column:
    """The text as it stands between the quotes of a JSON string (non-ASCII is kept as it is)."""
    quoted = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("t")))
    return F.regexp_extract(quoted, r'(?s)^\{"t":"(.*)"\}$', 1)


def context_string(texts: Column, top: int = 3) -> Column:
    """Header, one line for each of the first ``top`` texts, footer; a fixed sentence if there are none."""
    lines = F.transform(F.slice(texts, 1, top), lambda t: F.concat(F.lit("- "), json_inner(t), F.lit("\n")))
    filled = F.concat(F.lit(CONTEXT_HEADER), F.array_join(lines, ""), F.lit(CONTEXT_FOOTER))
    return F.when(F.coalesce(F.size(texts), F.lit(0)) > 0, filled).otherwise(F.lit(NO_CONTEXT))


def judge_documents(texts: Column, top: int = 3, length: int = 300) -> Column:
    """Numbered previews of the first ``top`` texts, separated by a blank line."""
    numbered = F.transform(
        F.slice(texts, 1, top),
        lambda t, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(": "), clip_with_dots(t, length)),
    )
    return F.array_join(numbered, "\n\n")


def cookie_value(cookies: Column, name: str = "session_id") -> Column:
    """Value of a cookie; pairs are split at ``; `` and at their first ``=``, the last one wins."""
    pairs = F.filter(F.split(cookies, "; "), lambda p: F.contains(p, F.lit("=")))
    wanted = F.filter(pairs, lambda p: F.substring_index(p, "=", 1) == name)
    return F.substr(F.get(F.reverse(wanted), F.lit(0)), F.lit(len(name) + 2))


def mapped_role(role: Column) -> Column:
    """Roles a model client knows; any other is treated as the user's."""
    return F.when(role.isin("system", "assistant", "user"), role).otherwise(F.lit("user"))
