"""Answer normalisation, extraction and matching as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that refuse an answer, and characters that separate option letters.
REFUSALS = [
    "Sorry, I can't help with images of people yet.",
    "I can't process this file.",
    "I'm sorry, but without the image provided",
    "Cannot determine the answer",
]
FAILURE = "Failed to obtain answer via API"
SEPARATORS = ".()[],:;!*#{}"
# Prefixes taken off before a letter is looked for. Two of them are joined, as results depend on it.
PREFIXES = [
    "The best answer is",
    "The correct answer is",
    "The answer is",
    "The answer",
    "The best option isThe correct option is",
    "Best answer:Best option:",
]


def normal_index(c: Column) -> Column:
    """Trimmed; ``12.0`` is ``12``, ``12.00`` stays."""
    return F.regexp_replace(F.trim(c), r"^(-?\d+)\.0$", "$1")


def collapse(c: Column) -> Column:
    """Runs of whitespace as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    return F.array_remove(F.split(c, r"(?U)\s+"), "")


def infer_option(answer: Column, choices: list[str]) -> Column:
    """the one option letter that stands as a word among the last five words of the answer; ``Z`` for a refusal;
    null where neither can be said."""
    words = tokens(F.translate(answer, SEPARATORS, " " * len(SEPARATORS)))
    there = [F.array_contains(words, c).cast("int") for c in choices]
    count = sum(there[1:], there[0])
    late = [F.when(F.array_contains(words, c) & (F.array_position(words, c) - 1 > F.size(words) - 5), F.lit(c)) for c in choices]
    refused = F.lit(False)
    for phrase in REFUSALS:
        refused = refused | answer.contains(phrase)
    found = F.when(count == 1, F.coalesce(*late)).when((count == 0) & F.array_contains(words, "Z"), F.lit("Z"))
    return F.when(answer.contains(FAILURE), F.lit(None)).when(refused, F.lit("Z")).otherwise(found)


def infer_text(answer: Column, choices: dict[str, Column]) -> Column:
    """the one option whose text the answer contains, case aside; null if the answer is longer than twice all
    options, or if not exactly one is contained."""
    low = F.lower(answer)
    total = sum((F.length(v) for v in list(choices.values())[1:]), F.length(next(iter(choices.values()))))
    hits = [F.when(F.contains(low, F.lower(v)), F.lit(k)) for k, v in choices.items()]
    n = sum((h.isNotNull().cast("int") for h in hits[1:]), hits[0].isNotNull().cast("int"))
    return F.when((F.length(low) <= 2 * total) & (n == 1), F.coalesce(*hits))


def infer(answer: Column, choices: dict[str, Column]) -> Column:
    """by letter, else by text."""
    return F.coalesce(infer_option(answer, list(choices)), infer_text(answer, choices))


def option_letter(answer: Column) -> Column:
    """the first of A to E left after the prefixes; empty for a long answer without one."""
    s = F.trim(answer)
    for p in PREFIXES:
        s = F.replace(s, F.lit(p), F.lit(""))
    found = F.regexp_extract(s, "[ABCDE]", 0)
    inside = F.coalesce(*[F.when(F.contains(F.lit(f"({c.lower()})"), F.lower(s)), F.lit(c)) for c in "ABCDE"], F.lit(""))
    return F.when(found != "", found).when(F.size(tokens(s)) > 10, F.lit("")).otherwise(inside)


def yes_no(answer: Column) -> Column:
    """Yes or No where exactly one of the two is a word of the answer, else Unknown. Punctuation separates."""
    words = tokens(F.lower(F.regexp_replace(answer, r"[^\p{L}\p{N}']+", " ")))
    yes, no = F.array_contains(words, "yes"), F.array_contains(words, "no")
    return F.when(yes & ~no, F.lit("Yes")).when(no & ~yes, F.lit("No")).otherwise(F.lit("Unknown"))


def first_yes_no(answer: Column) -> Column:
    """F8: 1 if the first whole word of yes and no is yes, 0 if it is no, -1 if there is neither."""
    word = F.regexp_extract(F.lower(answer), r"\b(yes|no)\b", 1)
    return F.when(word == "yes", 1).when(word == "no", 0).otherwise(-1)


def anls_distance(truth: Column, prediction: Column) -> Column:
    """edit distance of the normalised texts over the length of the longer raw one."""
    longest = F.greatest(F.length(truth), F.length(prediction))
    return F.when(longest == 0, 0.0).otherwise(F.levenshtein(collapse(F.lower(truth)), collapse(F.lower(prediction))) / longest.cast("double"))


def number(c: Column) -> Column:
    """The number that a text is, percent as hundredths; null if it is none."""
    return F.when(c.endswith("%"), F.try_divide(F.rtrim(c, F.lit("%")).try_cast("double"), F.lit(100.0))).otherwise(c.try_cast("double"))


def relaxed_match(truth: Column, prediction: Column, tolerance: float = 0.05, strip_dots: bool = False) -> Column:
    """Numbers within the tolerance of a truth that isn't 0, else equal texts, case aside."""
    if strip_dots:
        truth, prediction = F.rtrim(truth, F.lit(".")), F.rtrim(prediction, F.lit("."))
    t, p = number(truth), number(prediction)
    close = F.abs(p - t) / F.abs(F.nullif(t, F.lit(0.0))) <= tolerance
    return F.when(p.isNotNull() & t.isNotNull() & (t != 0), close).otherwise(F.lower(prediction) == F.lower(truth))


def either_contains(answer: Column, truth: Column) -> Column:
    """one option text holds the other, case and final dots aside."""
    a, t = F.rtrim(F.lower(answer), F.lit(".")), F.rtrim(F.lower(truth), F.lit("."))
    return F.contains(a, t) | F.contains(t, a)


def after_thinking(answer: Column) -> Column:
    """what follows the last closing tag of a thought."""
    return F.trim(F.element_at(F.split(answer, "</think>"), -1))


def has_cjk(c: Column) -> Column:
    """F25"""
    return c.rlike("[一-鿿]")


def option_prompt(options: dict[str, Column]) -> Column:
    """a line for each option that isn't null."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}. "), v)) for k, v in options.items()]
    return F.concat(F.lit("Options:\n"), F.array_join(F.array_compact(F.array(*lines)), "\n"))


def fenced_json(c: Column) -> Column:
    """the body of the first fenced json block, else the text itself."""
    body = F.regexp_extract(c, r"(?s)```json\s*(.*?)\s*```", 1)
    return F.when(body != "", body).otherwise(c)


def clock_seconds(c: Column) -> Column:
    """F32: seconds of mm:ss or hh:mm:ss, with fractions; null for anything else."""
    p = F.transform(F.split(F.trim(c), ":"), lambda x: x.try_cast("double"))
    return F.when(F.size(p) == 3, p[0] * 3600 + F.get(p, F.lit(1)) * 60 + F.get(p, F.lit(2))).when(F.size(p) == 2, p[0] * 60 + F.get(p, F.lit(1)))


def contained_answer(prediction: Column, answers: Column, keep_case: bool = False, keep_space: bool = True) -> Column:
    """whether any of the answers stands in the prediction."""

    def clean(x: Column) -> Column:
        x = F.replace(F.trim(x), F.lit("\n"), F.lit(" "))
        x = x if keep_case else F.lower(x)
        return x if keep_space else F.replace(x, F.lit(" "), F.lit(""))

    p = clean(prediction)
    return F.exists(answers, lambda a: F.contains(p, clean(a)))


def true_false(prediction: Column) -> Column:
    """1 or 0 where exactly one of the words is contained, else null (unscored, but counted)."""
    t, f = F.contains(F.lower(prediction), F.lit("true")), F.contains(F.lower(prediction), F.lit("false"))
    return F.when(t & ~f, 1).when(f & ~t, 0)
