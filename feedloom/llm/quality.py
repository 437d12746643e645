"""Quality rules by distribution divergence (built-in expressions only).

Every document is measured (words, symbols, repeated lines, repeated five-word windows)
and its histograms of character classes and of common words are compared with those of
its language by Jensen-Shannon distance (base 2, the square root of the divergence). The language
references are sums over all documents. Short documents are not judged by a histogram
of few counts: below the minimum length a distance rejects nothing.

Null text counts as empty: no words, so it fails the base rule. A null language is a
language of its own. A document is judged by itself, so repeated rows get equal results,
and other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.binding import bind, computed_once
from feedloom.llm.common import WORD, key_text, staged, total
from feedloom.operators.joins import attach

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A common word has at most so many characters; the histogram has so many of them and a bin for the rest.
COMMON_LENGTH = 4
COMMON_WORDS = 24
#: Below so many characters or common-length words a histogram is not judged.
MIN_CHARS = 200
MIN_COMMON = 40
MAX_CHAR_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.80
#: Removed from the text one after the other; what is left is the last class.
CLASSES = (r"\p{Ll}+", r"[\x20\x09-\x0D]+", r"\p{Lu}+", r"\p{L}+", r"[.,;:!?'\x22()-]+", r"\p{Nd}+")

#: With the class of what is left; the place of white space among them.
N_CLASSES, SPACES = len(CLASSES) + 1, 1
#: All but the symbols; none of them is in a class above.
SYMBOLS = "[^#*$%&|<>]+"

_REF, _M = "__reference", "__measures"


def _class_counts(text: Column) -> Column:
    """Characters of each class, and at the end the symbols that the base counts.

    Each pattern sees only what the ones before have left.
    """

    def nested(k: int, before: Column, found: list[Column]) -> Column:
        if k == len(CLASSES):
            symbols = F.length(F.regexp_replace(before, SYMBOLS, ""))
            return F.array(*found, F.length(before).cast("long"), symbols.cast("long"))
        after = F.regexp_replace(before, CLASSES[k], "")
        return bind(after, lambda x: nested(k + 1, x, [*found, (F.length(before) - F.length(x)).cast("long")]))

    return nested(0, text, [])


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _short(words: Column) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) <= COMMON_LENGTH), F.lower)


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _covered(starts: Column) -> Column:
    """Words covered by windows that start at these ascending places."""
    return total(F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))).cast("long")))


def _repeated_words(words: Column) -> Column:
    """Words in windows found more than once. Windows are compared by 64-bit hash, sorted, so the cost is n log n."""

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))

        def repeated(h: Column) -> Column:
            placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def twice(p: Column) -> Column:
                same = F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]))
                return bind(F.sort_array(F.transform(same, lambda x: x["i"])), _covered)

            return bind(placed, twice)

        return bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(repeated(h)))

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(bind(words, of))


def _divergence(p: Column, q: Column) -> Column:
    """One bin's share of the Jensen-Shannon divergence."""

    def part(x: Column) -> Column:
        return F.when(x > 0, 0.5 * x * F.log2(2 * x / (p + q))).otherwise(F.lit(0.0))

    return part(p) + part(q)


def _char_distance(counts: Column, reference: Column) -> Column:
    n = total(counts)
    bins = F.zip_with(counts, reference, lambda c, q: F.when(n > 0, _divergence(c / n, q)).otherwise(F.lit(0.0)))
    return F.sqrt(F.greatest(total(bins, "double"), F.lit(0.0)))


def _word_distance(short: Column, words: Column, shares: Column, rest: Column) -> Column:
    """Bins that the document lacks add half of their reference share, so only its own bins are visited."""

    def of(bins: Column) -> Column:
        n = F.size(bins)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(bins, i) != F.get(bins, i - 1)))

        def summed(s: Column) -> Column:
            def one(i: Column, k: Column) -> Column:
                p = (F.coalesce(F.get(s, k + 1), n) - i) / n
                q = F.when(F.get(bins, i) == 0, rest).otherwise(F.get(shares, (F.get(bins, i) - 1).cast("int")))
                return _divergence(p, q) - 0.5 * q

            return F.lit(0.5) + total(F.transform(s, one), "double")

        return bind(starts, summed)

    bins = F.sort_array(F.transform(short, lambda w: F.array_position(words, w)))
    return F.when(F.size(short) == 0, F.lit(0.0)).otherwise(F.sqrt(F.greatest(bind(bins, of), F.lit(0.0))))


def references(docs: DataFrame) -> DataFrame:
    """One row per language: shares of the character classes, the common words and their shares."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(key_text(docs["lang"]).alias("lang_key"), text.alias("text"))
    # counts of one row become one array, so the text is reduced once
    counted = computed_once(rows, counts=_class_counts(F.col("text"))).select("lang_key", "counts")
    size = N_CLASSES
    chars = counted.groupBy("lang_key").agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(size)])
    together = F.greatest(sum((F.col(f"c{i}") for i in range(1, size)), F.col("c0")), F.lit(1))
    chars = chars.select("lang_key", F.array(*[F.col(f"c{i}") / together for i in range(size)]).alias("classes"))
    words = rows.select("lang_key", F.explode(_short(_words(F.col("text")))).alias("word")).groupBy("lang_key", "word").agg(F.count("*").alias("n"))
    words = staged(words, "common-words")
    sums = words.groupBy("lang_key").agg(F.sum("n").alias("all"))
    best = words.withColumn("place", F.row_number().over(Window.partitionBy("lang_key").orderBy(F.desc("n"), "word"))).filter(F.col("place") <= COMMON_WORDS)
    best = best.groupBy("lang_key").agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("top"))
    best = best.join(sums, "lang_key").select(
        "lang_key",
        F.col("top.word").alias("words"),
        F.transform("top", lambda x: x["n"] / F.col("all")).alias("shares"),
        ((F.col("all") - total(F.col("top.n"))) / F.col("all")).alias("rest"),
    )
    empty = F.array().cast("array<string>")
    return chars.join(best, "lang_key", "left").select(
        "lang_key",
        "classes",
        F.coalesce("words", empty).alias("words"),
        F.coalesce("shares", empty.cast("array<double>")).alias("shares"),
        F.coalesce("rest", F.lit(0.0)).alias("rest"),
    )


def judged(docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """The documents with a column ``__measures``: counts, distances, ``base_failed`` and ``kept``."""
    refs = staged(references(docs), "quality-references") if refs is None else refs
    keys = refs.select(F.col("lang_key").alias("__lang_key"), F.struct("classes", "words", "shares", "rest").alias(_REF))
    rows = docs.withColumn("__lang_key", key_text(docs["lang"]))
    rows = attach(rows, keys, "__lang_key", ("doc_id", "text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    ref = F.col(_REF)

    def measured(words: Column, counts: Column) -> Column:
        classes = F.slice(counts, 1, N_CLASSES)
        common = bind(_short(words), lambda s: F.struct(F.size(s).alias("n"), _word_distance(s, ref["words"], ref["shares"], ref["rest"]).alias("d")))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            (total(classes) - counts[SPACES]).alias("word_chars"),
            counts[N_CLASSES].alias("n_symbols"),
            _duplicate_lines(text).alias("n_dup_lines"),
            _repeated_words(words).alias("n_repeat_words"),
            _char_distance(classes, ref["classes"]).alias("char_distance"),
            common.alias("common"),
        )

    rows = computed_once(rows, __base=bind(_words(text), lambda w: bind(_class_counts(text), lambda c: measured(w, c))))
    base = F.col("__base")
    failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])
    strange = (F.length(text) >= MIN_CHARS) & (base["char_distance"] > MAX_CHAR_DISTANCE)
    foreign = (base["common"]["n"] >= MIN_COMMON) & (base["common"]["d"] > MAX_WORD_DISTANCE)
    measures = F.struct(
        *[base[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance")],
        base["common"]["d"].alias("word_distance"),
        failed.alias("base_failed"),
        (~failed & ~strange & ~foreign).alias("kept"),
    )
    return rows.select(*docs.columns, measures.alias(_M))


def report(docs: DataFrame) -> DataFrame:
    """One row per document with its measures and the verdict."""
    m = F.col(_M)
    return judged(docs.select("doc_id", "text", "lang")).select(
        "doc_id", *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    )


def kept(docs: DataFrame) -> DataFrame:
    """The documents that pass, unchanged."""
    return judged(docs).filter(F.col(_M)["kept"]).drop(_M)
