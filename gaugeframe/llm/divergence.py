"""Quality rule: distribution divergence, in DataFrame functions only.

A document's histogram over character classes and its histogram over common words are held against references,
one for each language, by Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). The references
are the mean histograms of all documents of that language in the table itself. A document passes a test if it is
near enough to any language. Each test has a least length below which it doesn't speak: short texts are noise.

Defined cases: null and empty texts have no words, so they fail the base rule and aren't kept. Ties and repeated
rows are judged alike, row by row; long texts are judged whole. Where no row names a language of ``COMMON`` there is
no reference, and the base rule alone decides. Further columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.hashing import bound, run_hashes

from .common import SPACE, WORD, cut, words

# Common words of each language.
COMMON = {
    "de": ["auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "im", "in", "ist", "mit", "nicht", "sich", "und", "von", "zu"],
    "en": ["a", "and", "are", "as", "be", "for", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with", "you"],
    "es": ["al", "como", "con", "de", "del", "el", "en", "la", "las", "los", "no", "para", "por", "que", "se", "un", "una", "y"],
    "fr": ["au", "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pour", "que", "qui", "un", "une"],
}
#: Runs of characters of each class, as Java and RE2 both read them; what is left over is the last class.
CLASSES = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "space": r"\x20\x09-\x0D", "stop": r".,;:'\"()\-", "mark": r"!?#*$%&|<>@\[\]{}^_~=+/"}
VOCABULARY = sorted({w for ws in COMMON.values() for w in ws})
LONGEST = max(len(w.encode()) for w in VOCABULARY)
WINDOW = 8


def repeated_words(ws: Column, size: int = WINDOW) -> Column:
    """Words covered by windows of ``size`` words that occur twice or more in ``ws``, the first occurrence included.

    Windows are compared by a 64-bit hash. Only a text that has equal windows at all is looked at further: its
    (hash, place) pairs are sorted, those equal to a neighbour kept, and the words that these places cover counted.
    """
    return bound(run_hashes(ws, size), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h, size)))


def _covered(hashes: Column, size: int) -> Column:
    def places(pairs: Column) -> Column:
        same = lambda i, x: F.coalesce(F.get(pairs, i)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(pairs, lambda x, i: ((i > 0) & same(F.greatest(i - 1, F.lit(0)), x)) | same(i + 1, x)), lambda x: x["p"]))

    def cover(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(size)))
        return F.when(F.size(p) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(size), lambda acc, x: acc + x))

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return bound(pairs, lambda q: bound(places(q), cover))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts and the two histograms of every text; one pass, no shuffle."""
    out = docs.select("doc_id", "lang", F.coalesce(F.col("text"), F.lit("")).alias("text")).select("*", words(F.col("text")).alias("ws"))
    left, counts, size = F.col("text"), {}, F.length("text")
    for name, chars in CLASSES.items():  # each class is looked for in what the classes before it left
        out = out.withColumn(f"left_{name}", F.regexp_replace(left, f"[{chars}]+", ""))
        left, counts[name], size = F.col(f"left_{name}"), size - F.length(f"left_{name}"), F.length(f"left_{name}")
    known = F.filter("ws", lambda w: (F.octet_length(w) <= LONGEST) & F.lower(w).isin(VOCABULARY))
    listed = F.lower(F.concat(F.lit(" "), F.array_join(known, "  "), F.lit(" ")))  # " the  and ": each word has spaces of its own
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    out = out.select(
        "doc_id",
        "lang",
        F.size("ws").cast("long").alias("n_words"),
        (F.length("text") - counts["space"]).cast("long").alias("word_chars"),
        F.regexp_count("left_stop", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("ws")).cast("long").alias("n_repeat_words"),
        F.array(*counts.values(), size).alias("classes"),
        listed.alias("listed"),
    )
    left = lambda w: F.octet_length("listed") - F.octet_length(F.replace(F.col("listed"), F.lit(f" {w} "), F.lit("")))
    return out.withColumn("common", F.array(*[F.call_function("div", left(w), F.lit(len(w) + 2)).cast("int") for w in VOCABULARY])).drop("listed")


def references(stats: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Of each language in ``COMMON`` that has rows: its summed histograms. A few hundred numbers in all."""
    sums = [F.sum(F.col(k)[i]).alias(f"{k}_{i}") for k, n in (("classes", len(CLASSES) + 1), ("common", len(VOCABULARY))) for i in range(n)]
    rows = stats.where(F.col("lang").isin(list(COMMON))).groupBy("lang").agg(F.sum("n_words").alias("n"), *sums).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r["lang"]):
        own = [float(r[f"common_{VOCABULARY.index(w)}"]) for w in COMMON[r["lang"]]]
        out[r["lang"]] = [float(r[f"classes_{i}"]) for i in range(len(CLASSES) + 1)], [*own, r["n"] - sum(own)]
    return out


def distance(shares: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of an array of shares and fixed counts; null if the reference has no mass."""
    total = sum(reference)
    if not total:
        return F.lit(None).cast("double")

    def term(p: Column, q: Column) -> Column:
        part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
        return part(p) + part(q)

    parts = F.zip_with(shares, F.array(*[F.lit(x / total) for x in reference]), term)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def divergence_filter(docs: DataFrame, max_class: float = 0.26, max_word: float = 0.32, min_chars: int = 200, min_words: int = 50) -> DataFrame:
    """doc_id, the base counts, base_failed, both distances (null where a test doesn't speak), and kept."""
    stats = cut(features(docs))
    refs = references(stats)
    stats = stats.withColumn("chars", F.aggregate("classes", F.lit(0), lambda a, x: a + x))
    share = lambda n: lambda x: F.try_divide(x.cast("double"), n.cast("double"))
    stats = stats.withColumns({"p_class": F.transform("classes", share(F.col("chars"))), "p_word": F.transform("common", share(F.col("n_words")))})
    for lang in refs:
        own = F.array(*[F.col("p_word")[VOCABULARY.index(w)] for w in COMMON[lang]])
        stats = stats.withColumn(f"p_{lang}", F.array_append(own, 1.0 - F.aggregate(own, F.lit(0.0), lambda a, x: a + x)))

    def nearest(each: list[Column], speaks: Column) -> Column:
        return F.when(speaks, F.array_min(F.array(*each)) if each else F.lit(None)).cast("double")

    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        stats.withColumn("class_distance", nearest([distance(F.col("p_class"), r[0]) for r in refs.values()], F.col("chars") >= min_chars))
        .withColumn("word_distance", nearest([distance(F.col(f"p_{lang}"), r[1]) for lang, r in refs.items()], F.col("n_words") >= min_words))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.coalesce("class_distance", F.lit(0.0)) <= max_class) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
    )
