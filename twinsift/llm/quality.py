"""Quality rules: counts of a text, and how far its histograms are from its language.

Two histograms describe a text: classes of its characters, and how often the
common words of the languages occur. The reference of a language is the mean
histogram of its longer texts that are near their medians, so that bad texts
do not move it. The fewer these are, the more fixed shares of prose count beside
it. The Jensen-Shannon distance decides, for texts long enough to tell.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import durable, text_of, word_list

# Frequent function words of English, French, German and Spanish.
COMMON_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "it", "for", "on", "with", "that",
    "le", "la", "les", "de", "et", "des", "un", "une", "du", "est", "que", "dans",
    "der", "die", "das", "und", "den", "ist", "zu", "von", "ein", "eine", "nicht", "mit",
    "el", "los", "las", "y", "en", "por", "se", "con", "para", "no", "al", "su",
]
# Classes of characters.
_SYMBOLS = "#*$%&|<>"
CHAR_CLASSES = {
    "lower": string.ascii_lowercase, "upper": string.ascii_uppercase, "digit": string.digits, "space": " \t\n\x0b\x0c\r",
    "symbol": _SYMBOLS, "mark": "".join(c for c in string.punctuation if c not in _SYMBOLS),
}
SMALL = 10_000              # languages whose references are broadcast


# Shares of letters and digits, space, symbols and marks in running
# prose, for languages whose own texts cannot tell.
PROSE = [0.815, 0.16, 0.0, 0.025]
_PROSE_PARTS = [["lower", "upper", "digit", "rest"], ["space"], ["symbol"], ["mark"]]


def _tripled(words: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more.

    Windows are sorted by their 64-bit hash with their position, so equal ones
    become neighbours; the positions found again are sorted and their ranges
    of three are united.
    """
    hashed = F.when(F.size(words) >= 3, F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(
            F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))))
    return hashed


def _covered(hashed: Column) -> Column:
    again = F.filter(hashed, lambda x, k: (
        x["h"] == F.get(hashed, k - 1)["h"]) | (x["h"] == F.get(hashed, k + 1)["h"]))
    return F.sort_array(F.transform(again, lambda x: x["i"]))


def _united(at: Column) -> Column:
    gaps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, g: total + g)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts and the two histograms to every row, in one pass over the texts."""
    text = text_of(text_col)
    step = docs.withColumn("_text", text).withColumn("_words", word_list(F.col("_text")))
    step = (
        step.withColumn("_hashed", _tripled(F.col("_words")))
        .withColumn("_common", F.filter("_words", lambda w: w.isin(COMMON_WORDS)))
        .withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("_chars", F.length("_text").cast("long"))
    )
    step = step.withColumn("_at", _covered(F.col("_hashed")))
    n = F.size("_words").cast("long")
    classes = [F.col("_chars") - F.length(F.translate("_text", chars, "")) for chars in CHAR_CLASSES.values()]
    words = F.transform(
        F.array(*[F.lit(w) for w in COMMON_WORDS]),
        lambda b: F.size(F.filter("_common", lambda w: w == b)).cast("long"))
    step = step.withColumn("n_words", n).withColumn("_classes", F.array(*classes)).withColumn(
        "_bins", F.when(F.size("_common") > 0, words).otherwise(F.array_repeat(F.lit(0).cast("long"), len(COMMON_WORDS))))
    of = lambda name: F.get("_classes", F.lit(list(CHAR_CLASSES).index(name)))
    return step.withColumn(
        "n_symbols", of("symbol"),
    ).withColumn(
        "word_chars", F.col("_chars") - of("space"),
    ).withColumn(
        "n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    ).withColumn(
        "n_repeat_words", F.coalesce(_united(F.col("_at")), F.lit(0)).cast("long"),
    ).drop("_text", "_words", "_hashed", "_common", "_lines", "_at")


def _shares(counts: Column, total: Column) -> Column:
    """Shares of the bins, and what is left over as the last bin."""
    whole = F.greatest(total, F.lit(1)).cast("double")
    rest = total - F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.transform(F.concat(counts, F.array(rest)), lambda x: x / whole)


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits, 0 to 1."""
    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2, F.lit(0.0)))


def _as_prose(p: Column) -> Column:
    """Class shares summed to the parts of ``PROSE``; other letters are what no class keeps."""
    names = [*CHAR_CLASSES, "rest"]
    return F.array(*[sum((F.get(p, F.lit(names.index(x))) for x in part), F.lit(0.0)) for part in _PROSE_PARTS])


def _prose_distance(p: Column) -> Column:
    return js_distance(_as_prose(p), F.array(*[F.lit(x) for x in PROSE]))


def _medians(facts: DataFrame) -> DataFrame:
    """(_lang, _mid_p, _mid_q): medians of the shares in thousandths, scaled to a sum of one.

    Counted by value: a language has a thousand rows per bin at most, and the
    median is the smallest value that half of the texts do not exceed.
    """
    first = len(CHAR_CLASSES) + 1
    values = facts.select("_lang", F.posexplode(F.transform(
        F.concat("_p", "_q"), lambda x: F.floor(x * 1000))).alias("_bin", "_v"))
    counts = values.groupBy("_lang", "_bin", "_v").agg(F.count("*").alias("_c"))
    bin_ = Window.partitionBy("_lang", "_bin")
    counts = counts.withColumns({"_upto": F.sum("_c").over(bin_.orderBy("_v")), "_all": F.sum("_c").over(bin_)})
    medians = counts.where("2 * _upto >= _all").groupBy("_lang", "_bin").agg((F.min("_v") / 1000.0).alias("_m"))
    listed = medians.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("_bin", "_m")))["_m"].alias("_ms"))

    def scaled(part: Column) -> Column:
        whole = F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
        return F.when(whole > 0, F.transform(part, lambda x: x / whole))

    return listed.select("_lang", scaled(F.slice("_ms", 1, first)).alias("_mid_p"),
                         scaled(F.slice("_ms", first + 1, len(COMMON_WORDS) + 1)).alias("_mid_q"))


def _by_language(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """Join one row per language, about a kilobyte each, to all texts of it.

    Up to ``SMALL`` languages are broadcast, so that a language with most of
    the rows is no task of its own; more of them are small beside the table.
    """
    table = durable(table)
    return rows.join(F.broadcast(table) if table.count() <= SMALL else table, "_lang", how)


def _references(facts: DataFrame, max_char: float, max_word: float) -> DataFrame:
    """(_lang, _texts, _ref_p, _ref_q): mean histograms of the texts near the medians of their language.

    Medians stay while fewer than half of the texts are bad. Where more are,
    with characters unlike prose, the language has no reference.
    """
    near = _by_language(facts, _medians(facts)).where(
        (js_distance(F.col("_p"), F.col("_mid_p")) <= max_char) & (js_distance(F.col("_q"), F.col("_mid_q")) <= max_word))
    sizes = {"_p": len(CHAR_CLASSES) + 1, "_q": len(COMMON_WORDS) + 1}
    means = near.groupBy("_lang").agg(F.count("*").alias("_texts"), *[
        F.avg(F.get(c, F.lit(i))).alias(f"{c}{i}") for c, n in sizes.items() for i in range(n)])
    return means.select("_lang", "_texts", *[
        F.array(*[F.col(f"{c}{i}") for i in range(n)]).alias(f"_ref{c}") for c, n in sizes.items()]).where(
        _prose_distance(F.col("_ref_p")) <= max_char)


def quality_rules(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", lang_col: str = "lang",
    min_words: int = 50, repeat_percent: int = 50, judge_words: int = 100, reference_texts: int = 20,
    max_char_distance: float = 0.30, max_word_distance: float = 0.55,
) -> DataFrame:
    """The ``keep`` columns of every row, counts, ``base_failed``, distances and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or over ``repeat_percent``
    percent of them in repeated 3-word windows. Texts of ``judge_words`` words
    and more that passed are compared with the reference of their language;
    shorter ones keep the base verdict. A reference made of n texts has the
    weight n / (n + ``reference_texts``): the distance of characters is its
    part of the distance from the reference, the rest that of letters and
    digits, space, symbols and marks from ``PROSE``; the distance of words is
    scaled by it. Where a majority is unlike prose the weight is 0. Distances
    of texts not judged are null.

    A null text counts as empty and fails. A null language is a language of
    its own. Repeated rows are judged alike, an empty table gives no rows.
    Columns not named in ``keep`` are left out, whatever their names.
    """
    measured = measure(docs.select(
        F.struct(*[F.col(c) for c in keep]).alias("_row"), F.col(text_col).alias("_in"),
        F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit("")).alias("_lang"),
    ), "_in").drop("_in")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    facts = durable(measured.withColumn("base_failed", failed).select(
        "*", _shares(F.col("_classes"), F.col("_chars")).alias("_p"),
        _shares(F.col("_bins"), F.col("n_words")).alias("_q"),
    ).drop("_classes", "_bins", "_chars"))
    judged = ~F.col("base_failed") & (F.col("n_words") >= judge_words)
    references = _references(facts.where(judged).select("_lang", "_p", "_q"), max_char_distance, max_word_distance)
    texts = F.coalesce("_texts", F.lit(0))
    weight = texts / (texts + reference_texts)
    known = F.col("_texts").isNotNull()
    compared = _by_language(facts, references, "left").withColumns({
        "char_distance": F.when(judged, F.when(known, weight * js_distance(F.col("_p"), F.col("_ref_p"))).otherwise(0.0)
                                + (1 - weight) * _prose_distance(F.col("_p"))),
        "word_distance": F.when(judged & known, weight * js_distance(F.col("_q"), F.col("_ref_q"))),
    })
    far = (F.col("char_distance") > max_char_distance) | (F.col("word_distance") > max_word_distance)
    return compared.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).select(
        "_row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "char_distance", "word_distance", "kept")
