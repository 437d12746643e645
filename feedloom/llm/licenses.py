"""License scan by ordered signature rules (built-in expressions only).

Texts become lower-case words, each with a space of its own on both sides, so that a word
position is a count of spaces. Three phrases are counted everywhere. A text that holds a
prefilter word is then tried with the rules whose gate word it holds. A detection that lies
inside another one of the same or an earlier level is suppressed; the first of two equal ones stays.

Null text counts as empty: no words, no labels. A text is scanned whole and by itself, so
repeated rows get equal results, and other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.binding import bind, computed_once
from feedloom.llm import license_rules

#: What stands between words, once the text is in lower case.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrases that are always counted, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Every rule needs one of these.
PREFILTER = ("licen", " under ", " hereby ", " fee ", " redistribution ", " origin ", " unencumbered ", " domain ", " rights ", " spdx ", " software ", " agreement ", " redistributions ")

#: Marks of a match; neither is left in the words of a text.
_START, _END = "\x01", "\x02"
#: Detections that are folded at a time; an array is copied by each row that is added to it.
_FOLDED = 64

_SPAN = "array<struct<s:int,e:int>>"
_FOUND = "array<struct<label:string,weight:double,s:int,e:int>>"


def _spaced(text: Column) -> Column:
    words = F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), _BETWEEN, "  ")))
    return F.concat(F.lit(" "), words, F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _words_before(norm: Column, characters: Column) -> Column:
    return (_spaces(F.substring(norm, F.lit(1), characters)) / 2).cast("long")


def _phrase(norm: Column, phrase: str) -> Column:
    """How often the phrase stands there, and the words before its first and last place."""
    wide = f" {phrase.replace(' ', '  ')} "

    def found(n: Column) -> Column:
        last = F.length(norm) - F.instr(F.reverse(norm), F.lit(wide[::-1])) + 1 - len(wide)
        return F.struct(
            n.alias("n"),
            F.when(n > 0, _words_before(norm, F.instr(norm, F.lit(wide)) - 1)).alias("first"),
            F.when(n > 0, _words_before(norm, last)).alias("last"),
        )

    count = F.when(F.contains(norm, F.lit(wide)), (F.length(norm) - F.length(F.replace(norm, F.lit(wide), F.lit("")))) / len(wide)).otherwise(0)
    return bind(count.cast("long"), found)


def _places(norm: Column, pattern: Column) -> Column:
    """The words at which matches start and end: each match is marked in the text, and marked words are numbered.

    A match starts and ends with the space of a word of its own, so the marks move to that word.
    """
    marked = F.regexp_replace(norm, pattern, F.lit(f"{_START}$0{_END}"))
    # the marks go inside the spaces of the first and the last word
    marked = F.replace(F.replace(marked, F.lit(f"{_START} "), F.lit(f" {_START}")), F.lit(f" {_END}"), F.lit(f"{_END} "))

    def numbered(words: Column) -> Column:
        starts = F.array_compact(F.transform(words, lambda w, i: F.when(F.contains(w, F.lit(_START)), i)))
        ends = F.array_compact(F.transform(words, lambda w, i: F.when(F.contains(w, F.lit(_END)), i + 1)))
        return F.arrays_zip(starts.alias("s"), ends.alias("e"))

    return F.when(F.regexp_like(norm, pattern), bind(F.split(marked, "  "), numbered)).otherwise(F.array()).cast(_SPAN)


def _detected(norm: Column, rules: list[license_rules.Rule]) -> Column:
    """The detections that are not suppressed, in text order."""
    columns = {
        "rank": list(range(len(rules))),
        "level": [r.level for r in rules],
        "label": [r.label for r in rules],
        "gate": [f" {r.keyword} " for r in rules],
        "pattern": [license_rules.spaced(r.pattern) for r in rules],
        "weight": [r.weight for r in rules],
    }
    listed = F.arrays_zip(*[F.lit(v).alias(k) for k, v in columns.items()])
    listed = listed.cast("array<struct<rank:int,level:int,label:string,gate:string,pattern:string,weight:double>>")
    gated = F.filter(listed, lambda r: F.contains(norm, r["gate"]))

    def of(r: Column) -> Column:
        spans = _places(norm, r["pattern"])
        return F.transform(spans, lambda p: F.struct(p["s"].alias("s"), (-p["e"]).alias("back"), r["level"].alias("level"), r["rank"].alias("rank"), r["label"].alias("label"), r["weight"].alias("weight")))

    levels = sorted({r.level for r in rules})
    ends = [f"e{level}" for level in levels]

    def step(acc: Column, d: Column) -> Column:
        e = -d["back"]
        inside = F.lit(False)
        for level in levels:
            inside = inside | ((d["level"] >= level) & (acc[f"e{level}"] >= e))
        reach = [F.when(d["level"] == level, F.greatest(acc[f"e{level}"], e)).otherwise(acc[f"e{level}"]).alias(f"e{level}") for level in levels]
        one = F.array(F.struct(d["label"].alias("label"), d["weight"].alias("weight"), d["s"].alias("s"), e.alias("e")))
        return F.struct(*reach, F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    def fold(acc: Column, part: Column) -> Column:
        start = F.struct(*[acc[name].alias(name) for name in ends], F.array().cast(_FOUND).alias("out"))
        done = F.aggregate(part, start, step)
        return bind(done, lambda d: F.struct(*[d[name].alias(name) for name in ends], F.concat(acc["outs"], F.array(d["out"])).alias("outs")))

    def folded(ordered: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(ordered) / _FOLDED).cast("int") - 1), lambda k: F.slice(ordered, k * _FOLDED + 1, F.lit(_FOLDED)))
        none = F.struct(*[F.lit(-1).alias(name) for name in ends], F.array().cast(f"array<{_FOUND}>").alias("outs"))
        return F.when(F.size(ordered) == 0, F.array().cast(_FOUND)).otherwise(F.aggregate(parts, none, fold, lambda acc: F.flatten(acc["outs"])))

    return bind(F.sort_array(F.flatten(F.transform(gated, of))), folded)


def scanned(docs: DataFrame, rules: list[license_rules.Rule] | None = None) -> DataFrame:
    """``doc_id`` with ``norm`` (the words), ``phrases`` (one struct per phrase) and ``found`` (detections)."""
    rules = license_rules.rules() if rules is None else rules
    rows = computed_once(docs.select("doc_id", "text"), norm=_spaced(F.col("text"))).drop("text")
    norm = F.col("norm")
    some = F.lit(False)
    for word in PREFILTER:
        some = some | F.contains(norm, F.lit(word))
    found = F.when(some, _detected(norm, rules)).otherwise(F.array().cast(_FOUND))
    return computed_once(rows, phrases=F.array(*[_phrase(norm, p) for p, _ in PHRASES]), found=found)


def detections(docs: DataFrame) -> DataFrame:
    """One row per detection: ``doc_id``, ``label``, ``weight``, ``first_word``, ``n_words``."""
    rows = scanned(docs).select("doc_id", F.explode("found").alias("d"))
    return rows.select("doc_id", "d.label", "d.weight", F.col("d.s").cast("long").alias("first_word"), (F.col("d.e") - F.col("d.s")).cast("long").alias("n_words"))


def report(docs: DataFrame) -> DataFrame:
    norm, phrases = F.col("norm"), F.col("phrases")
    base = F.array_compact(F.array(*[F.when(phrases[k]["n"] > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))
    every = F.array_union(base, F.transform("found", lambda d: d["label"]))
    each = range(len(PHRASES))
    return scanned(docs).select(
        "doc_id",
        F.when(norm == "  ", F.lit(0)).otherwise(_spaces(norm) / 2).cast("long").alias("n_words"),
        sum((phrases[k]["n"] for k in each), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[phrases[k]["first"] for k in each]).alias("first_word"),
        F.greatest(*[phrases[k]["last"] for k in each]).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )
