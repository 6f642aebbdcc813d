"""Toxicity scores from a learned lexicon, misspellings included.

Method: words and word stems that mark toxic rows are learned from labelled rows. A trie of the learned words is
walked together with a Levenshtein automaton of each unknown word, which catches misspelled terms. Every hit is
weighed by what stands around it: a term inside quotation marks, or after a reporting verb, counts for little.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from spindrift.session import durable

WORD = re.compile(r"[^\W_]+")
#: Lengths of the stems that are learned beside whole words.
STEMS = (4, 5)
#: At most so many labelled rows are learned from: those of the smallest hash of their id.
TRAINING_ROWS = 20_000
#: Clean rows with rare words near a term that are believed beforehand, by the term's length; a short one has more neighbours.
CHANCE = {3: 1.6, 4: 0.4}
#: The bias is at most this, so that a text without a hit is not predicted toxic, however many labelled rows are.
NO_HIT = -1.2
#: Characters before a hit in which a reporting verb is looked for, and what a quoted hit is worth.
CONTEXT, QUOTED = 60, 0.1
# Quotation marks with the marks that they close, and reporting words.
OPENING, CLOSING = "\"“«„‘", {"\"": "\"", "”": "“„", "»": "«", "“": "„", "’": "‘"}
MARK = re.compile("[" + OPENING + "".join(CLOSING) + "]")
REPORTING = re.compile(r"\b(?:said|says|called|quoted|wrote|quote|term|word)\W{0,3}$", re.I)


def features(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    out = {w for w in words if len(w) >= 3}
    for n in STEMS:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


def quotations(text: str) -> list[tuple[int, int]]:
    """Outermost quotations (places of both marks), paired over the whole text.

    A mark that stands free on one side only can open or only close; one that closes nothing and does not open is
    passed over, and so are open ones that an outer mark closes over. A ’ between letters is an apostrophe.
    """
    spans: list[tuple[int, int]] = []
    opened: list[tuple[str, int]] = []
    for m in MARK.finditer(text):
        c, i = m[0], m.start()
        free_before = i == 0 or not (text[i - 1].isalnum() or text[i - 1] in ".,;:!?…)]")
        free_after = i + 1 == len(text) or not text[i + 1].isalnum()
        if c == "’" and not free_after:
            continue
        both = c in OPENING and c in CLOSING
        opens = both and free_before and not free_after
        partner = None
        if c in CLOSING and not opens:
            partner = next((k for k in range(len(opened) - 1, -1, -1) if opened[k][0] in CLOSING[c]), None)
        if partner is not None:
            start = opened[partner][1]
            del opened[partner:]
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, i))
        elif c in OPENING and not (both and free_after and not free_before):
            if c == '"':  # does not nest: an earlier one that nothing closed is a stray
                opened = [o for o in opened if o[0] != c]
            opened.append((c, i))
    return spans


class Trie:
    """A lexicon walked with the automaton that accepts all words within ``edits`` of a given one."""

    def __init__(self, words: list[str], edits: int = 1):
        self.edits, self.root = edits, {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        for w in words:
            half = (len(w) - 1) // 2
            self.heads.setdefault(len(w), set()).add(w[:half])
            self.tails.setdefault(len(w), set()).add(w[len(w) - half :])

    def possible(self, word: str) -> bool:
        """One edit leaves the first or the last half of a lexicon word alone; a cheap test before the walk."""
        if self.edits > 1:
            return True
        for n in (len(word) - 1, len(word), len(word) + 1):
            if n in self.heads:
                half = (n - 1) // 2
                if word[:half] in self.heads[n] or word[len(word) - half :] in self.tails[n]:
                    return True
        return False

    def near(self, word: str) -> list[str]:
        """Lexicon words within the edit bound, in order: the automaton's paths, errors tried only from an exact prefix."""
        if not self.possible(word):
            return []
        found: set[str] = set()
        self._walk(self.root, word, 0, self.edits, found)
        return sorted(found)

    def _walk(self, node: dict, word: str, i: int, left: int, found: set[str]) -> None:
        """From a node and a place in the word: follow the letters, and branch with one error less at every step."""
        size = len(word)
        while True:
            if "" in node and size - i <= left:
                found.add(node[""])
            if left:
                for c, child in node.items():
                    if c:
                        if i < size and (i + 1 == size or word[i + 1] in child or left > 1):  # replaced
                            self._walk(child, word, i + 1, left - 1, found)
                        if i == size or word[i] in child or left > 1:  # left out of the word
                            self._walk(child, word, i, left - 1, found)
                if i < size and (i + 1 == size or word[i + 1] in node or left > 1):  # added to the word
                    self._walk(node, word, i + 1, left - 1, found)
            if i == size or word[i] not in node:
                return
            node, i = node[word[i]], i + 1


class Scorer:
    """A learned model: weights of words and stems, of misspellings by term and by word, and the bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.words = {w: v for w, v in weights.items() if not w.endswith("*")}
        self.stems = {n: {w[:n]: v for w, v in weights.items() if w == w[:n] + "*"} for n in STEMS}
        self.trie = Trie(sorted(self.words))
        self.bias, self.seen = bias, {}
        self.rows = (0, 0)
        #: Misspellings of a term believed beforehand, at most one.
        self.believed: dict[str, float] = {}
        #: Toxic and clean rows of words near a term that only one row has, by term.
        self.rare: dict[str, tuple[int, int]] = {}
        #: Words near a term that clean rows use too often for a mark of toxic ones.
        self.ordinary: set[str] = set()
        self.weighed: set[str] = set()
        self.heavy: dict[str, float] = {}

    def misspelling(self, word: str) -> list[str]:
        """The terms that an unknown word may be a misspelling of."""
        if word not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[word] = self.trie.near(word)
        return self.seen[word]

    def misspelt(self, term: str) -> float:
        """Weight of an unknown word as a misspelling of a term.

        Misspellings are believed beforehand in proportion to the term's toxic rows. Clean rows with rare words near
        the term take that back: they tell how often a new word is one by accident.
        """
        (t, c), (toxic, clean) = self.rare.get(term, (0, 0)), self.rows
        return math.log((t + self.believed.get(term, 1.0)) / (toxic + 10)) - math.log((c + CHANCE.get(len(term), 0.1)) / (clean + 10))

    def learned(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for n, stems in self.stems.items():
            if len(word) > n:
                best = max(best, stems.get(word[:n], 0.0))
        return best

    def weight(self, word: str) -> float:
        best = self.learned(word)
        if not best and word not in self.ordinary:
            best = max((self.misspelt(term) for term in self.trie.near(word)), default=0.0)
        return best

    def context(self, text: str, start: int, quoted: list[tuple[int, int]]) -> float:
        if REPORTING.search(text[max(0, start - CONTEXT) : start]):
            return QUOTED
        k = bisect_left(quoted, (start,)) - 1
        return QUOTED if k >= 0 and start < quoted[k][1] else 1.0

    def hits(self, word_sets: list[set[str]]) -> list[set[str]]:
        """Words of each set that carry weight; a word is weighed once for many texts."""
        new = set().union(*word_sets) - self.weighed
        if len(self.weighed) + len(new) > WEIGHED:
            self.weighed, self.heavy = set(), {}
            new = set().union(*word_sets)
        self.heavy.update((w, v) for w in new if (v := self.weight(w)) > 0)
        self.weighed |= new
        heavy = self.heavy.keys()
        return [words & heavy for words in word_sets]

    def score_all(self, texts: list[str]) -> list[float]:
        """Scores of as many texts as fit well into memory at once."""
        lowered = [t.lower() for t in texts]
        found = self.hits([set(WORD.findall(t)) for t in lowered])
        return [self.score(t, h) for t, h in zip(lowered, found, strict=True)]

    def score(self, lowered: str, hits: set[str]) -> float:
        total = 0.0
        if hits:
            pattern = re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, sorted(hits, key=len, reverse=True))) + r")(?![^\W_])")
            quoted = quotations(lowered)
            values = [self.heavy[m[0]] * self.context(lowered, m.start(), quoted) for m in pattern.finditer(lowered)]
            values.sort(reverse=True)
            total = values[0] + sum(v / 2 ** min(k, 60) for k, v in enumerate(values[1:], 2))
        return 1 / (1 + math.exp(-min(30.0, self.bias + total)))


def is_held_out(key: Column) -> Column:
    """Rows that the labels are not learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def _count(batches: Iterator[pd.DataFrame], wanted: frozenset[str] | None) -> Iterator[pd.DataFrame]:
    toxic, clean = Counter(), Counter()
    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["toxic"], strict=True):
            found = features(text or "")
            (toxic if label else clean).update(found if wanted is None else found & wanted)
    rows = [(w, toxic[w], clean[w]) for w in toxic.keys() | clean.keys()]
    yield pd.DataFrame(rows, columns=["f", "t", "c"])


def learn(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Scorer:
    """Learn the lexicon from at most ``rows`` labelled rows that are not held out.

    The sample is bounded, so what reaches the driver is too: weights of features that one toxic row in a hundred
    has, of which there are at most a hundred times those of an average row; two counts a term; and the ordinary
    words of the sample that are one edit from a term. Without labelled rows, or without toxic ones, nothing is
    learned and every text scores the bias.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    sample = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = durable(sample)
    train = durable(documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic"))
    size = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    bias = min(NO_HIT, math.log((toxic + 1) / (clean + 9)) - 0.3)
    if not toxic:
        return Scorer({}, bias)
    least = max(3, math.ceil(0.01 * toxic))

    def counts(df: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
        parts = df.mapInPandas(lambda b: _count(b, wanted), "f string, t long, c long")
        return parts.groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))

    marks = counts(train.where("toxic = 1"), None).where(F.col("t") >= least)
    marks = {r["f"]: r["t"] for r in marks.collect()}
    against = {r["f"]: r["c"] for r in counts(train.where("toxic = 0"), frozenset(marks)).collect()}
    odds = {
        f: math.log((t + 0.1) / (toxic + 1)) - math.log((against.get(f, 0) + 0.5) / (clean + 1)) for f, t in marks.items()
    }
    model = Scorer({f: v for f, v in sorted(odds.items()) if v >= 3.0 and marks[f] >= 20 * against.get(f, 0)}, bias)
    model.rows = (toxic, clean)
    most = max((marks[w] for w in model.words), default=1)
    model.believed = {w: marks[w] / most for w in model.words}

    def fuzzy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, list[int]] = {}
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["toxic"], strict=True):
                for w in set(WORD.findall((text or "").lower())):
                    if w in found or (not model.learned(w) and model.misspelling(w)):
                        found.setdefault(w, [0, 0])[not label] += 1
        pairs = [(w, v, t, c) for w, (t, c) in found.items() for v in model.misspelling(w)]
        yield pd.DataFrame(pairs, columns=["w", "v", "t", "c"])

    sums = [F.sum("t").alias("t"), F.sum("c").alias("c")]
    pairs = durable(train.mapInPandas(fuzzy, "w string, v string, t long, c long").groupBy("w", "v").agg(*sums))
    once = F.col("t") + F.col("c") == 1
    model.rare = {r["v"]: (r["t"], r["c"]) for r in pairs.where(once).groupBy("v").agg(*sums).collect()}
    model.ordinary = {r["w"] for r in pairs.where(~once & (F.col("t") < 20 * F.col("c"))).select("w").distinct().collect()}
    model.seen.clear()
    return model


#: A text is predicted toxic from this score.
CUT = 0.3
#: Texts that are scored at once, and words whose weights are remembered meanwhile.
STEP, WEIGHED = 200, 50_000


def _scored(documents: DataFrame, model: Scorer, keep: list[str]) -> tuple[DataFrame, list[Column]]:
    """score beside the columns keep under other names, and those columns under their own.

    Arrow batches go through as they are, and only the texts of one step become Python strings at a time.
    """
    names = [f"k{i}" for i in range(len(keep))]
    source = names[keep.index("text")] if "text" in keep else "_text"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, values = batch.column(source), []
            for lo in range(0, len(texts), STEP):
                values += model.score_all([t or "" for t in texts.slice(lo, STEP).to_pylist()])
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(values, pa.float64())], names=[*names, "score"])

    own = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)]
    slim = documents.select(*own, *([] if "text" in keep else [F.col("text").alias("_text")]))
    schema = StructType([slim.schema[n] for n in names]).add("score", DoubleType())
    return slim.mapInArrow(score, schema), [F.col(n).alias(c) for c, n in zip(keep, names, strict=True)]


def score_toxicity(documents: DataFrame, model: Scorer, keep: list[str] | None = None) -> DataFrame:
    """Score every whole text: columns keep (default doc_id), score, predicted (1 from CUT).

    The heaviest hit counts in full, the next a quarter, and every further one half of the one before. Null and
    empty texts score the bias; texts are read whole, however long. Rows are scored one by one, so repeated rows
    agree, and an empty table gives none. Of several terms that a word may be a misspelling of, the heaviest weight
    counts, so that ties do not matter. Columns that are not kept may have any name.
    """
    scored, own = _scored(documents, model, keep or ["doc_id"])
    return scored.select(*own, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def civil_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns, whatever those are called.

    Null, empty and repeated rows are judged like any other and stay as often as they come, if they stay; an empty
    table gives no rows.
    """
    scored, own = _scored(documents, learn(documents, labels), documents.columns)
    return scored.where(F.col("score") < CUT).select(*own)
