"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's histograms of character classes and of its language's common words (all
other words are one more slot) are compared, by Jensen-Shannon distance (base 2, 0 to 1),
with references of its language: the same histograms summed over all of its documents that
the base rules pass, so neither stubs nor repetitive junk shape them. Documents too short for a
histogram to mean anything are guarded by ``min_chars`` and ``min_common``: no divergence
verdict is passed on them. A histogram of n words strays from its language by about
1 / sqrt(n), which is added to the least distance that counts as far. The base rules
(fewest words, share of repeated 8-word windows) hold beside it.

The thresholds were set on the 3,980 labelled documents of the sf0.1 table: of the 3,302 of
quality 1 that the base rules pass, at most one in a thousand lies beyond each.

One scan and no shuffle of texts: each row is measured where it stands, the references
(one row a language, at most ``len(COMMON_WORDS) + 1`` rows) are sums of the measures.

Edge cases: a null or empty text has no words and fails the base rule; a language that
is null or has no word list is compared by character classes with the reference of all
such documents and has no word verdict; a language none of whose documents pass the base
rules has no reference and no verdict; repeated rows are judged one by one; an empty table
gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .text import BLANK_WORD, blank_words, gram_hashes, text_of, word_hashes

# The most common function words of each language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "on", "with"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
}
WORDS_PER_LANG = 12
#: What may stand between a common word and the space after it.
STOPS = r'[.,;:!?"()\x09-\x0D]+ ?'
#: Lower-case letters and spaces, most of any text: taken out first, so that the other
#: classes are searched for in the little that is left.
COMMON_RUNS = "[a-z ]+"
# The other character classes.
CLASSES = {
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "breaks": r"[\x09-\x0D]+",
    "stops": r"[.,;:!?'\"()\-]+",
    "marks": r"[#*$%&|<>@^_=+~`/\\\[\]{}\x00-\x08\x0E-\x1F\x7F]+",
}
N_CLASSES = len(CLASSES) + 3  # and lower case, spaces, what is not ASCII


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    window: int = 8
    repeat_percent: int = 30
    min_chars: int = 200
    min_common: int = 100
    max_char_distance: float = 0.25
    max_word_distance: float = 0.1
    word_noise: float = 1.3  # added to it, over the root of the number of words


def _covered(starts: Column, length: int) -> Column:
    """Places covered by runs of ``length`` from the ascending ``starts``."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(
        starts,
        zero,
        lambda acc, p: F.struct(
            (p + F.lit(length)).alias("end"),
            (acc["total"] + F.lit(length) - F.greatest(acc["end"] - p, F.lit(0))).alias("total"),
        ),
        lambda acc: acc["total"],
    )


def repeated_words(grams: Column, window: int) -> Column:
    """Words in windows that occur twice or more: sort the window hashes, pair equal
    neighbours, and sum the union of their spans. O(n log n) a text."""
    at = F.transform(grams, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i")))
    both = F.array_sort(at)
    n = F.size(grams)
    pairs = F.zip_with(
        F.slice(both, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(both, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    starts = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    some = F.size(F.array_distinct(grams)) < n
    return F.when(some, _covered(starts, window)).otherwise(F.lit(0).cast("long"))


def _common_counts(lang: Column, low: Column, n_words: Column) -> Column:
    """How often each common word stands between spaces in the lower-cased and padded text, whose
    stops are spaces (of two that share a space, the first counts), and how many words are
    others. One byte search a word, and no array."""
    common = F.array_repeat(F.lit(0.0), WORDS_PER_LANG + 1)
    for known, words in COMMON_WORDS.items():
        spans = [
            (F.octet_length(low) - F.octet_length(F.replace(low, F.lit(f" {w} ")))) / (len(w) + 2)
            for w in words
        ]
        rest = F.greatest(n_words - sum(spans[1:], spans[0]), F.lit(0.0))
        common = F.when(lang == known, F.array(*spans, rest)).otherwise(common)
    return common


def measured(docs: DataFrame, keep: list[str], rules: Rules = Rules()) -> DataFrame:
    """``_row`` (the columns ``keep``), ``_known`` (the language, where listed), ``_chars`` and
    ``_common`` (histograms) and the measures of the base rules. No shuffle."""
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_")).alias("_row"),
        text_of("text").alias("_text"),
        F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(F.lit("")).alias("_known"),
    )
    t = F.col("_text")
    df = df.withColumn("_words", blank_words(t)).withColumn(
        "_lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(BLANK_WORD))
    )
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    low = F.regexp_replace(F.lower(t), STOPS, " ")
    df = df.withColumn("_low", F.when(F.col("_known") != "", F.concat(F.lit(" "), low, F.lit(" "))))
    df = df.withColumn("_rare", F.regexp_replace(t, COMMON_RUNS, ""))
    df = df.withColumn("_hashes", word_hashes(F.col("_words")))
    df = df.withColumn("_grams", gram_hashes(F.col("_hashes"), rules.window))
    size, rare = F.length(t), F.length("_rare")
    spaces = size - F.length(F.replace(t, F.lit(" ")))
    counts = [rare - F.length(F.regexp_replace("_rare", p, "")) for p in CLASSES.values()]
    known = sum(counts[1:], counts[0])
    return df.select(
        "_row",
        "_known",
        F.array(size - rare - spaces, spaces, *counts, rare - known).cast("array<double>").alias("_chars"),
        _common_counts(F.col("_known"), F.col("_low"), F.col("n_words")).alias("_common"),
        "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (rare - F.length(F.translate("_rare", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_grams"), rules.window).alias("n_repeat_words"),
    )


def _failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.repeat_percent)


def references(measures: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Histograms summed over every document of each language that the base rules pass:
    ``_known, _ref_chars, _ref_common``."""
    total = lambda c, n: F.array(*[F.sum(F.element_at(c, i + 1)) for i in range(n)])
    return measures.where(~_failed(rules)).groupBy("_known").agg(
        total("_chars", N_CLASSES).alias("_ref_chars"),
        total("_common", WORDS_PER_LANG + 1).alias("_ref_common"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms; null where either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    np, nq = total(p), total(q)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: F.struct((x / np).alias("x"), (y / nq).alias("y")))
    halves = F.transform(
        terms,
        lambda t: part(t["x"], (t["x"] + t["y"]) / 2) + part(t["y"], (t["x"] + t["y"]) / 2),
    )
    div = total(halves) / 2
    return F.when((np > 0) & (nq > 0), F.sqrt(F.greatest(div, F.lit(0.0))))


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "base_failed", "char_distance", "word_distance", "kept",
)


def _judged(docs: DataFrame, keep: list[str], rules: Rules) -> DataFrame:
    """``_row`` (the columns ``keep``) and the measures, which are taken once and written
    to the shared folder: the references need all of them before any verdict."""
    df = written(measured(docs, keep, rules), "quality")
    ref = F.broadcast(references(df, rules))  # a row a listed language, and one for the others
    failed = _failed(rules)
    far_chars = (F.col("_size") >= rules.min_chars) & (
        F.col("char_distance") > rules.max_char_distance
    )
    far_words = (F.col("n_words") >= rules.min_common) & (
        F.col("word_distance") > rules.max_word_distance + rules.word_noise / F.sqrt("n_words")
    )
    no = F.lit(False)
    return (
        df.join(ref, "_known", "left")
        .withColumn("_size", F.aggregate("_chars", F.lit(0.0), lambda a, x: a + x))
        .withColumn("char_distance", js_distance(F.col("_chars"), F.col("_ref_chars")))
        .withColumn("word_distance", js_distance(F.col("_common"), F.col("_ref_common")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~(failed | F.coalesce(far_chars, no) | F.coalesce(far_words, no)))
        .select("_row", *MEASURES)
    )


def judge(docs: DataFrame, keep: list[str] | None = None, rules: Rules = Rules()) -> DataFrame:
    """The columns ``keep`` (all, if None) of ``docs`` with the measures (``MEASURES``), which
    replace columns of the same names."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in MEASURES]
    out = _judged(docs, keep, rules)
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in keep], *MEASURES)


def filter_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that all rules keep, with the columns they came with."""
    out = _judged(docs, docs.columns, rules).where("kept")
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
