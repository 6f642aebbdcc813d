"""Parsing of free-text answers as column expressions (X1-X7, X17): regular expressions in order of trust.

A rule of higher trust always beats one of lower trust, and within a rule the last place of the text wins. So a rule is
one greedy pattern, and an answer is the first rule that finds something. No Python runs on the rows.

A text that several rules read is bound once (``let``): rules that named its expression would each work it out anew.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.geometry import even_thresholds, relative_accuracy
from spindrift.functions.replies import LETTERS, NUMERICAL

# Phrases that announce a choice.
PHRASES = (
    "the answer is", "answer is", "the correct answer is", "correct answer is",
    "the best answer is", "best answer is", "the correct option is",
    "correct option is", "i choose", "i select", "my answer is", "答案是", "答案为",
)
# Marks that are stripped from an answer, one after the other.
MARKS = (",", ".", "!", "?", ";", ":", "'", '"', "。", "：")
# An announced final answer, in two languages; a number behind an option letter.
FINAL = r"(?iU)(?:the\s+)?(?:final\s+answer|answer|答案)\s*(?:is|=|是|为)?\s*[:：]?\s*([-+]?[0-9]+(?:\.[0-9]+)?|[A-Da-d])\b"
OPTION_NUMBER = r"(?U)^\s*[A-Da-d]\s*[.):：\-]?\s*([-+]?[0-9]+(?:\.[0-9]+)?)\b"
# Clock times and numbers in time spans.
CLOCK = r"[0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?|[0-9]{1,2}:[0-9]{2}(?:\.[0-9]+)?"
SECONDS = r"[0-9]+\.?[0-9]*"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body's expression over a value that is worked out once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _found(text: Column, pattern: str) -> Column:
    """The first group of a pattern; null where it is not there."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def without_thought(text: Column) -> Column:
    """A response without its thought (X1): what follows the last closing tag, or the text without closed thoughts."""

    def rest(t: Column) -> Column:
        return F.when(t.rlike("(?i)</think>"), _last(F.split(t, "(?i)</think>"))).otherwise(F.regexp_replace(t, "(?is)<think>.*?</think>", ""))

    return _strip(F.regexp_replace(let(_strip(F.coalesce(text, F.lit(""))), rest), "(?i)</?think>", ""))


def tagged(text: Column) -> Column:
    """What stands in the last answer tags, or else the text."""
    return _strip(let(text, lambda t: F.coalesce(_last(_all(t, r"(?is)<answer>\s*(.*?)\s*</answer>")), t)))


def final_answer(text: Column) -> Column:
    return tagged(without_thought(text))


def _announced(padded: Column, lowered: Column, one_of: str) -> Column:
    """The letter behind an announcing phrase: behind the last place of each phrase, the letter that comes up last."""

    def behind(phrase: str, backwards: Column) -> Column:
        def nearest(place: Column) -> Column:
            letters = F.array_distinct(F.transform(_all(F.right(padded, place - 1), rf"(?iU)\b({one_of})\b"), lambda x: F.upper(x)))
            return F.when(place > 0, F.struct((-place).alias("nearest"), _last(letters).alias("letter")))

        return let(F.position(F.lit(phrase[::-1]), backwards), nearest)

    tried = let(F.reverse(lowered), lambda backwards: F.array(*[behind(p, backwards) for p in PHRASES]))
    said = lowered.rlike("|".join(map(re.escape, PHRASES)))
    return F.when(said, F.array_max(F.filter(tried, lambda x: x["letter"].isNotNull()))["letter"])


def _letter(text: Column, labels: str) -> Column:
    """The option letter of a final answer; both marks and blanks around it are taken off."""
    one_of = "|".join(re.escape(c) for c in labels)

    def rules(core: Column, padded: Column) -> Column:
        last = lambda token: _found(padded, f"(?s)^.*{token}")
        letter = F.coalesce(
            F.when(F.upper(core).isin(*labels), F.upper(core)),
            _found(core, rf"^({one_of})(?!\p{{L}})"),
            _found(core, rf"(?<!\p{{L}})({one_of})$"),
            let(F.lower(padded), lambda lowered: _announced(padded, lowered, one_of)),
            last(rf"\(({one_of})\)"),
            last(rf"({one_of})\."),
            last(rf"({one_of}):"),
            last(rf"({one_of})\)"),
            last(rf"({one_of}) "),
            _last(F.array_distinct(_all(padded, rf"(?U)\b({one_of})\b"))),
            F.lit(""),
        )
        return F.when(core == "", "").otherwise(letter)

    bare = reduce(lambda t, mark: F.btrim(t, F.lit(mark)), MARKS, text)
    around = lambda t: F.struct(_strip(t).alias("core"), F.concat(F.lit(" "), t, F.lit(" ")).alias("padded"))
    return let(let(bare, around), lambda x: rules(x["core"], x["padded"]))


def choice_letter(response: Column, labels: str = LETTERS) -> Column:
    """The option letter that a response most plausibly gives (X2), or an empty string. Labels are capital letters."""
    return _letter(final_answer(response), labels)


def _folded(text: Column, label: Column | None = None) -> Column:
    """A final answer without its own label, surplus blanks and case."""
    if label is not None:
        text = F.regexp_replace(text, F.concat(F.lit(r"(?iU)^\s*\Q"), label, F.lit(r"\E\s*[.):：]\s*")), F.lit(""))
    return F.replace(F.lower(_strip(F.regexp_replace(text, r"(?U)\s+", " "))), F.lit("ß"), F.lit("ss"))


def true_letter(answer: Column, options: Column, labels: str = LETTERS) -> Column:
    """The label of the first option whose text is the answer, or the letter that the answer gives."""
    names = F.array(*[F.lit(c) for c in labels])
    listed = F.slice(F.coalesce(options, F.array().cast("array<string>")), 1, len(labels))
    labelled = F.transform(listed, lambda o, i: F.struct(F.get(names, i).alias("label"), final_answer(o).alias("text")))

    def find(final: Column) -> Column:
        def matching(wanted: Column) -> Column:
            same = F.filter(labelled, lambda o: (_folded(o["text"]) == wanted) | (_folded(o["text"], o["label"]) == wanted))
            return F.get(same, F.lit(0))["label"]

        return F.coalesce(let(_folded(final), matching), _letter(final, labels))

    return let(final_answer(answer), find)


def first_number(text: Column, commas: bool = False) -> Column:
    """The first number in the final answer (X4, X5); null without one."""
    pattern = r"([-+]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)" if commas else r"([-+]?[0-9]+(?:\.[0-9]+)?)"
    return F.replace(_found(final_answer(text), pattern), F.lit(","), F.lit("")).try_cast("double")


def cents(x: Column) -> Column:
    """A double at two places: its hundredfold, a double too, at the nearest integer, halves away from zero.

    ``round(x, 2)`` rounds the shortest decimal that names x instead, which makes 1.01 of 1.005 (100.49999999999999 cents).
    """
    whole = F.round(x * 100)
    return F.when(F.abs(whole) == F.lit(float("inf")), x).otherwise(whole / 100)


def same_to_cents(a: Column, b: Column) -> Column:
    """1 if the first numbers of two texts agree after rounding to two places."""
    same = lambda x: let(x, cents)
    return F.coalesce((same(first_number(a, True)) == same(first_number(b, True))).cast("double"), F.lit(0.0))


def _accuracy(predicted: Column, target: Column) -> Column:
    return F.coalesce(relative_accuracy(predicted, target, even_thresholds()), F.lit(0.0))


def spatial_score(kind: Column, predicted: Column, truth: Column) -> Column:
    """metric, answer and score of a spatial question (X5): by number or by letter, as its type says."""
    by_number = kind.isin(*NUMERICAL)

    def measured(x: Column, y: Column) -> Column:
        said = F.when(y.isNull(), "").otherwise(F.coalesce(x.cast("string"), F.lit("")))
        return F.struct(F.lit("MRA").alias("metric"), said.alias("answer"), _accuracy(x, y).alias("score"))

    def chosen(p: Column, t: Column) -> Column:
        return F.struct(F.lit("ACC").alias("metric"), p.alias("answer"), ((p != "") & (p == t)).cast("double").alias("score"))

    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    number = let(pair(first_number(predicted), tagged(truth).try_cast("double")), lambda v: measured(v["a"], v["b"]))
    letter = let(pair(choice_letter(predicted, "ABCD"), choice_letter(truth, "ABCD")), lambda v: chosen(v["a"], v["b"]))
    return F.when(by_number, number).otherwise(letter)


def _token(text: Column, announced: Column) -> Column:
    return F.coalesce(announced, F.regexp_replace(F.get(F.split(text, r"(?U)\s+"), F.lit(0)), "[.。,:：]+$", ""))


def _final(predicted: Column, body: Callable[[Column, Column], Column]) -> Column:
    """The body's expression over the final answer and what it announces."""
    parts = lambda t: F.struct(t.alias("text"), _found(t, FINAL).alias("announced"))
    return let(let(final_answer(predicted), parts), lambda x: body(x["text"], x["announced"]))


def loose_token(predicted: Column) -> Column:
    """The announced answer, or else the first word without its closing marks."""
    return _final(predicted, _token)


def loose_number(predicted: Column) -> Column:
    """A number from an announcement, behind an option letter, or anywhere; else the loose token."""

    def number(text: Column, announced: Column) -> Column:
        found = F.coalesce(_found(text, OPTION_NUMBER), _found(text, r"([-+]?[0-9]+(?:\.[0-9]+)?)"), _token(text, announced))
        return F.when(announced.rlike("[0-9]"), announced).otherwise(found)

    return _final(predicted, number)


def loose_score(kind: Column, predicted: Column, truth: Column) -> Column:
    """Score of a spatial question with the loose parsers (X6); a target of 0 scores 0."""
    by_number = reduce(lambda a, b: a | b, [kind.startswith(n) for n in NUMERICAL])
    number = _accuracy(loose_number(predicted).try_cast("double"), truth.try_cast("double"))
    same = F.lower(loose_token(predicted)) == F.lower(_strip(F.coalesce(truth, F.lit(""))))
    return F.when(by_number, number).otherwise(same.cast("double"))


def _spans(starts: Column, ends: Column) -> Column:
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.cast("double").alias("start"), b.cast("double").alias("end")))


def _in_pairs(values: Column) -> Column:
    """Values taken two by two; an odd last one is left out."""
    placed = F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    pick = lambda odd: F.transform(F.filter(placed, lambda x: x["i"] % 2 == odd), lambda x: x["v"])
    return F.filter(_spans(pick(0), pick(1)), lambda x: x["end"].isNotNull())


def time_spans(text: Column) -> Column:
    """Spans (start, end) in seconds (X7). Grammars in order: clock times, a - b, a to b, any two numbers."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    inside = let(lowered, lambda t: F.coalesce(_last(_all(t, r"(?d)<answer>\s*(.*?)\s*</answer>")), _last(F.split(t, "<answer>"))))
    seconds = lambda clock: F.aggregate(F.split(clock, ":"), F.lit(0.0), lambda s, part: s * 60 + part.cast("double"))

    def read(body: Column) -> Column:
        joined = lambda joint: _spans(*[_all(body, rf"(?U)({SECONDS}){joint}({SECONDS})", g) for g in (1, 2)])
        grammars = [
            _in_pairs(F.transform(_all(body, rf"(?U)\b({CLOCK})\b"), seconds)),
            joined(r"\s*-\s*"),
            joined(r"\s+to\s+"),
            _in_pairs(_all(body, r"(?U)\b([0-9]+\.[0-9]+|[0-9]+)\b")),
        ]
        some = lambda spans: let(spans, lambda x: F.when(F.size(x) > 0, x))
        return F.coalesce(*map(some, grammars), F.array().cast("array<struct<start:double,end:double>>"))

    return let(inside, read)


def predicted_span(text: Column, duration: Column) -> Column:
    """start and end of the first span in whole seconds, and whether there is one; else a span behind the end."""
    end = duration.cast("double")
    kept = lambda first: F.struct(
        F.coalesce(F.bround(first["start"], 0), end + 10).alias("start"), F.coalesce(F.bround(first["end"], 0), end + 20).alias("end"),
        first.isNotNull().alias("parsed"),
    )
    return let(F.get(time_spans(text), F.lit(0)), kept)


def listed_letters(question: Column) -> Column:
    """Option letters that a question lists, or A to D."""
    found = F.array_distinct(_all(F.coalesce(question, F.lit("")), r"(?:^|[\s,])([A-H])\s*[:).]"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(c) for c in "ABCD"]))


def indexed_letter(index: Column, text: Column, choices: Column) -> Column:
    """The letter of an option index, or, where the index is null, the letter that a text gives or begins with."""
    count = F.when(F.size(choices) > 0, F.least(F.size(choices), F.lit(len(LETTERS)))).otherwise(4)
    at = F.when((index >= 0) & (index < count), F.substr(F.lit(LETTERS), index.cast("int") + 1, F.lit(1))).otherwise("")
    return F.when(index.isNotNull(), at).otherwise(F.coalesce(F.nullif(choice_letter(text), F.lit("")), F.upper(F.substr(_strip(text), F.lit(1), F.lit(1)))))
