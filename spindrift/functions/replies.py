"""What a reply says once its thought, tags and fence are off, for answers that are JSON.

Free text is parsed by column expressions, see ``parsing``; boxes inside JSON are read by ``boxes``. Plain Python that
operators run on Arrow batches.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import cached_property

# Numbers, option letters, question types scored by number, and the marks around an answer.
NUMBER = r"[-+]?(?:\d+(?:\.\d+)?|\.\d+)"
LETTERS = "ABCDEFGH"
NUMERICAL = ("object_abs_distance", "object_counting", "object_size_estimation", "room_size_estimation")
TAGGED = re.compile(r"<answer>\s*(.*?)\s*</answer>", re.S | re.I)
FENCED = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.S | re.I)
OPENED = re.compile(r"(?:.*?</think>)?\s*<answer>", re.S | re.I)
CLOSED = re.compile(r"</answer>\s*\Z", re.I)


def number(value) -> float | None:
    """A finite float; booleans and other things are None."""
    try:
        x = math.nan if isinstance(value, bool) else float(value)
    except (TypeError, ValueError):
        x = math.nan
    return x if math.isfinite(x) else None


def decoded(text) -> object:
    """The value of a JSON text; None for any other."""
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def containers(text: str) -> Iterator:
    """Every JSON container of a text, those inside others too, in order."""
    read = json.JSONDecoder().raw_decode
    for m in re.finditer(r"[\[{]", text):
        try:
            yield read(text, m.start())[0]
        except ValueError:
            pass


def unfenced(text: str) -> str:
    m = FENCED.fullmatch(text.strip())
    return m[1] if m else text.strip()


class Reply:
    """A response or a ground truth; values that are no text count as their text, containers as themselves."""

    def __init__(self, said):
        self.said = said

    @cached_property
    def text(self) -> str:
        return str(self.said or "").strip()

    @cached_property
    def payload(self) -> str | None:
        """All between the tags of a reply that is one answer behind at most a thought; None for any other."""
        head, tail = OPENED.match(self.text), CLOSED.search(self.text)
        return self.text[head.end() : tail.start()].strip() or None if head and tail and head.end() <= tail.start() else None

    @cached_property
    def answer(self) -> str:
        """The last answer in tags, or all of the text."""
        return ([self.text] + [m[1] for m in TAGGED.finditer(self.text)])[-1].strip()

    @cached_property
    def spoken(self) -> Reply:
        """The reply without its thoughts, closed or not opened."""
        return Reply(re.split("(?i)</think>", re.sub(r"(?is)<think>.*?</think>", "", self.text))[-1])

    @cached_property
    def value(self):
        """The JSON value of the answer, or the first container in it."""
        if isinstance(self.said, (dict, list, tuple)):
            return self.said
        text = unfenced(self.answer)
        whole = decoded(text)
        return next(containers(text), None) if whole is None and text != "null" else whole


def balanced_object(text) -> dict | None:
    """A JSON object that is the whole text, or else its first balanced braces (X9), strings and all."""
    if not isinstance(text, str):
        return None
    if (found := decoded(text.strip())) is None and "{" in text:
        start, depth = text.index("{"), 0
        for m in re.compile("[{}]").finditer(text, start):
            depth += 1 if m[0] == "{" else -1
            if not depth:
                found = decoded(text[start : m.end()])
                break
    return found if isinstance(found, dict) else None
