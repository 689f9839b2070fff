"""Rules that turn an answer into a verdict, as Column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeframe.functions import finals
from gaugeframe.functions import numeric as N
from gaugeframe.functions import pytext as P
from gaugeframe.functions import text as T

# Marks taken off both ends of a response, and characters that a simple match leaves out.
EDGES = [",", ".", "!", "?", ";", ":", "'"]
LOOSE = " -\n\t."


def _last_place(text: Column, what: Column) -> Column:
    """Where ``what`` is last found, from 1; 0 if it isn't."""
    back = F.call_function("position", F.reverse(what), F.reverse(text))
    return F.when(back == 0, 0).otherwise(F.length(text) - back - F.length(what) + 2)


def chosen_letter(response: Column, options: dict[str, Column]) -> Column:
    """the option that a response names: in brackets or before a dot, else as a word, else (for more than five words)
    by its text; of several the one named last. Null where nothing is found: a choice at random says nothing.

    Options that are null aren't there.
    """
    r = response
    for mark in EDGES:
        r = F.btrim(r, F.lit(mark))
    r = F.concat(F.lit(" "), r, F.lit(" "))
    low = F.lower(r)

    def pick(hit: dict[str, Column], place: dict[str, Column]) -> Column:
        each = F.array(*[F.struct(F.when(hit[k] & v.isNotNull(), place[k]).alias("at"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(options.items())])
        return F.array_max(F.filter(each, lambda x: x["at"].isNotNull()))["k"]

    def marked(k: str) -> Column:
        return F.contains(r, F.lit(f"({k})")) | F.contains(r, F.lit(f"{k}. "))

    last = {k: _last_place(r, F.lit(f"({k})")) for k in options}
    by_mark = pick({k: marked(k) for k in options}, last)
    by_word = pick({k: F.contains(r, F.lit(f" {k} ")) for k in options}, {k: _last_place(r, F.lit(f" {k} ")) for k in options})
    by_text = pick({k: F.contains(low, F.lower(v)) for k, v in options.items()}, {k: _last_place(low, F.lower(v)) for k, v in options.items()})
    return F.coalesce(by_mark, by_word, F.when(F.size(T.tokens(r)) > 5, by_text))


def infer_kind(answer: Column, kind: Column, options: dict[str, Column]) -> Column:
    """the order of a sorting question, else the option letter; failing that the option whose text is there."""
    order = finals.option_order(answer)
    return F.coalesce(F.when(kind == "sort", order).otherwise(T.infer_option(answer, list(options))), T.infer_text(answer, options))


def quoted(s: str) -> str:
    return f"\\Q{s}\\E"


def between(text: Column, start: str, end: str) -> Column:
    """What stands between two tags, trimmed; null if either is missing."""
    after = F.element_at(F.split(text, quoted(start), 3), 2)
    return F.when(F.contains(text, F.lit(start)) & F.contains(text, F.lit(end)), F.trim(F.element_at(F.split(after, quoted(end), 2), 1)))


def judge_verdict(reply: Column) -> Column:
    """(correct, reason) of a judge's reply; both null unless exactly one of yes and no stands between the tags."""
    said = F.lower(between(reply, "[Begin Correctness]", "[End Correctness]"))
    yes, no = F.contains(said, F.lit("yes")), F.contains(said, F.lit("no"))
    correct = F.when(yes & ~no, 1).when(no & ~yes, 0)
    return F.struct(correct.alias("correct"), F.when(correct.isNotNull(), between(reply, "[Begin Reason]", "[End Reason]")).alias("reason"))


def names_option(prediction: Column, answer: Column) -> Column:
    """the answer, or the answer and a dot, case aside."""
    p, a = F.lower(prediction), F.lower(answer)
    return (p == a) | F.startswith(p, F.concat(a, F.lit(".")))


def exact_match(response: Column, truth: Column) -> Column:
    """equal; where the truth is one letter, of a longer response the letter that it starts with counts."""
    letter = F.regexp_extract(response, r"^\(?([A-Za-z])", 1)
    single = truth.rlike(r"^\p{L}$") & (F.length(response) > 1) & (letter != "")
    return F.when(single, letter == truth).otherwise(response == truth)


def simple_match(response: Column, truth: Column) -> Column:
    """as ``exact_match``, without spaces, hyphens and dots, in lower case."""
    loose = lambda c: F.lower(F.translate(c, LOOSE, ""))
    return exact_match(loose(response), loose(truth))


def any_match(response: Column, truths: Column) -> Column:
    """any of several references, by ``simple_match``."""
    return F.exists(truths, lambda t: simple_match(response, t))


def positive_int_match(response: Column, truth: Column) -> Column:
    """1 for equal integers, else 0; -1 (not scored) where neither is positive."""
    whole = lambda c: F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("long"))
    r, t = whole(response), whole(truth)
    return F.when(r.isNull() | t.isNull(), 0).when((r <= 0) & (t <= 0), -1).otherwise((r == t).cast("int"))


def letter_rule(prediction: Column, answer: Column) -> Column:
    """1 or 0 for an equal text, a letter of A to D, or such a letter before a dot or bracket; null goes to the judge."""
    first = F.regexp_extract(prediction, r"^([ABCD])(?:$|[.)])", 1)
    return F.when(prediction == answer, 1).when(first != "", (first == F.substring(answer, 1, 1)).cast("int"))


def leading_yes_no(prediction: Column) -> Column:
    """yes or no where the answer starts with it, else null."""
    low = F.lower(prediction)
    return F.when(F.startswith(low, F.lit("yes")), "yes").when(F.startswith(low, F.lit("no")), "no")


def without_markup(text: Column) -> Column:
    """the tags of thoughts and answers gone, what they hold left."""
    return functools.reduce(lambda c, tag: F.replace(c, F.lit(tag), F.lit("")), ["<think>", "</think>", "<answer>", "</answer>"], text)


def counted_category(prompt: Column) -> Column:
    """what a counting prompt asks for; objects where it doesn't say."""
    found = F.regexp_extract(prompt, r"Count the number of (\S+) in the image", 1)
    return F.when(found == "", "objects").otherwise(F.replace(found, F.lit("_"), F.lit(" ")))


def clue_frames(spans: Column, frames: Column, fps: float) -> Column:
    """frame numbers spread over clue spans (start, end seconds) in proportion to their length, one at least each;
    all frames of the spans if no more are there."""
    at = F.transform(spans, lambda s: F.struct(F.bround(s["start"] * fps).cast("int").alias("a"), F.bround(s["end"] * fps).cast("int").alias("b")))

    def spread(places: Column) -> Column:
        total = F.aggregate(places, F.lit(0), lambda n, s: n + s["b"] - s["a"])
        every = F.flatten(F.transform(places, lambda s: F.when(s["b"] > s["a"], F.sequence(s["a"], s["b"] - 1)).otherwise(F.array().cast("array<int>"))))

        def some(s: Column) -> Column:
            n = F.greatest(F.lit(1), F.floor(frames * ((s["b"] - s["a"]) / total)).cast("int"))
            return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(s["a"] + (s["b"] - s["a"]) / n / 2 + (s["b"] - s["a"]) / n * i).cast("int"))

        return F.when(frames >= total, every).otherwise(F.flatten(F.transform(places, some)))

    return F.element_at(F.transform(F.array(at), spread), 1)


def match_scores(answers: Column, prediction: Column, method: str) -> Column:
    """how well a prediction meets each of several answers, by method: ``vqa_score`` (others that agree, a third
    each), ``anls`` (a distance), ``relaxed_accuracy``, ``relaxed_accuracy_chartqa``, ``accuracy``, or any other name for
    equality after normalisation."""
    said = F.trim(prediction)
    one = {
        "anls": lambda a: T.anls_distance(a, prediction),
        "relaxed_accuracy": lambda a: T.relaxed_match(a, said).cast("double"),
        "relaxed_accuracy_chartqa": lambda a: T.relaxed_match(a, said, strip_dots=True).cast("double"),
        "accuracy": lambda a: (F.lower(F.trim(a)) == F.lower(said)).cast("double"),
    }
    if method in one:
        return F.transform(answers, one[method])
    if method == "vqa_score":
        return P.column(lambda a, p: P.vqa_scores(list(a), p), "array<double>", answers, prediction)
    return P.column(lambda a, p: [float(P.plain_answer(x) == P.plain_answer(p)) for x in a], "array<double>", answers, prediction)


def reduced_hit(match: Column, family: str, threshold: float = 0.5) -> Column:
    """One score of the matches: the mean, for document families 1 minus the least distance (0 below the threshold),
    for chart and cover families the best."""
    if family in ("DocVQA", "InfoVQA"):
        near = 1 - F.array_min(match)
        return F.when(near < threshold, 0.0).otherwise(near)
    if family in ("ChartQA", "OCRVQA"):
        return F.array_max(match)
    return F.aggregate(match, F.lit(0.0), lambda a, x: a + x) / F.size(match)


def box_set_iou(truth: Column, found: Column) -> Column:
    """mean over the true boxes (x1, y1, x2, y2 arrays) of the best overlap with a found one; 0 for none found."""
    corners = lambda b: [F.get(b, F.lit(i)) for i in range(4)]
    best = F.transform(truth, lambda t: F.coalesce(F.array_max(F.transform(found, lambda f: N.box_iou(corners(t), corners(f)))), F.lit(0.0)))
    return F.try_divide(F.aggregate(best, F.lit(0.0), lambda a, x: a + x), F.size(truth))


def xml_point(text: Column) -> Column:
    """the numbers (x, y) of the one point tag of a text; null where there is none, several, or no two numbers."""
    found = F.regexp_extract_all(text, F.lit(r"<point>(.*?)</point>"))
    parts = F.transform(F.split(F.get(found, F.lit(0)), ","), lambda x: F.trim(x).try_cast("double"))
    fine = (F.size(found) == 1) & (F.size(parts) == 2) & ~F.exists(parts, lambda x: x.isNull())
    return F.when(fine, F.struct(parts[0].alias("x"), F.get(parts, F.lit(1)).alias("y")))


def point_closeness(response: Column, truth: Column) -> Column:
    """1 minus the distance of two tagged points in the unit square, at least 0; 0 for one that can't be read or lies
    outside."""
    a, b = xml_point(response), xml_point(truth)
    inside = lambda p: p["x"].between(0, 1) & p["y"].between(0, 1)
    distance = F.sqrt(F.pow(a["x"] - b["x"], F.lit(2)) + F.pow(a["y"] - b["y"], F.lit(2)))
    return F.when(F.coalesce(inside(a) & inside(b), F.lit(False)), F.greatest(F.lit(0.0), 1 - distance)).otherwise(0.0)


def point_in_boxes(response: Column, boxes: Column) -> Column:
    """the first box (x1, y1, x2, y2 arrays) that holds the tagged point, from 0; null if none does."""
    p = xml_point(response)
    hits = F.transform(boxes, lambda b: p["x"].between(b[0], F.get(b, F.lit(2))) & p["y"].between(F.get(b, F.lit(1)), F.get(b, F.lit(3))))
    at = F.array_position(hits, F.lit(True))
    return F.when(at > 0, (at - 1).cast("int"))


def keypoint_score(found: Column, truth: Column, decay: float = 10.0) -> Column:
    """the mean over keypoints (x, y arrays) of exp(-decay times the distance over the unit square's diagonal); 0
    where there are not as many."""
    apart = lambda a, b: F.sqrt(F.pow(a[0] - b[0], F.lit(2)) + F.pow(F.get(a, F.lit(1)) - F.get(b, F.lit(1)), F.lit(2)))
    each = F.zip_with(found, truth, lambda a, b: F.exp(F.lit(-decay) * apart(a, b) / F.sqrt(F.lit(2.0))))
    mean = F.try_divide(F.aggregate(each, F.lit(0.0), lambda n, x: n + x), F.size(truth))
    return F.when(F.size(found) == F.size(truth), F.coalesce(mean, F.lit(0.0))).otherwise(0.0)


def tracked_boxes_iou(found: Column, truth: Column) -> Column:
    """the mean overlap of boxes taken two by two; 0 where there are not as many."""
    corners = lambda b: [F.get(b, F.lit(i)) for i in range(4)]
    each = F.zip_with(found, truth, lambda a, b: N.box_iou(corners(a), corners(b)))
    mean = F.try_divide(F.aggregate(each, F.lit(0.0), lambda n, x: n + x), F.size(truth))
    return F.when(F.size(found) == F.size(truth), F.coalesce(mean, F.lit(0.0))).otherwise(0.0)
