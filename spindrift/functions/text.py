"""Text and path normalisation.

Functions named ``*_udf`` follow Python's Unicode and JSON rules where Spark has no equal; each works on Arrow
batches. The others are plain expressions.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import posixpath
import re
import unicodedata
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARKER = re.compile("<image>|<video>", re.IGNORECASE)
_REMOTE = r"^\s*[A-Za-z][A-Za-z0-9+.-]*://"


def fold_text(value) -> str:
    """NFKC, casefold, media markers to blanks, blanks collapsed."""
    folded = unicodedata.normalize("NFKC", "" if value is None else str(value)).casefold()
    return " ".join(_MARKER.sub(" ", folded).split())


def fold_path(path: str) -> str:
    """Lexical identity of a media path."""
    plain = posixpath.normpath(path).replace("\\", "/")
    return unicodedata.normalize("NFKC", plain).casefold()


def bind_path(value: str, root: str | None = None) -> str:
    """Strip, expand the home folder, bind to a root, and normalise (N3); blank and remote paths are errors."""
    raw = value.strip()
    if not raw:
        raise ValueError("a media path must not be blank")
    if re.match(_REMOTE, raw):
        raise ValueError(f"a media path must be local: {raw}")
    full = os.path.expanduser(raw)
    return posixpath.normpath(posixpath.join(root, full) if root and not full.startswith("/") else full)


def leakage_tokens(anchors: list[str]) -> list[str]:
    """Path, name and stem of every anchor."""
    found = set()
    for a in anchors:
        path = PurePosixPath(a)
        found.add("path:" + a)
        found.update(f"{kind}:{t}" for kind, part in (("name", path.name), ("stem", path.stem)) if (t := fold_text(part)))
    return sorted(found)


def canonical_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def identity_of(problem, problem_type, anchors: list[str]) -> str:
    """SHA-256 of what is asked and its media; the answer is left out (I4)."""
    payload = {"media": list(anchors), "problem": fold_text(problem), "problem_type": fold_text(problem_type)}
    return sha256(canonical_json(payload))


def has_content(value) -> bool:
    """Whether an answer holds any finite number, boolean or nonblank text, at any depth."""
    if isinstance(value, bool):
        return True
    if isinstance(value, str):
        return bool(value.strip())
    if isinstance(value, (int, float)):
        return math.isfinite(value)
    if isinstance(value, dict):
        value = list(value.values())
    return isinstance(value, (list, tuple)) and any(has_content(v) for v in value)


def series_udf(kind):
    """A function of columns from one of series. The UDF is made when it is called: modules travel inside plans, and a UDF that has run cannot."""

    def made(f):
        return lambda *columns: F.pandas_udf(f, kind)(*columns)

    return made


@series_udf(T.StringType())
def fold_text_udf(values: pd.Series) -> pd.Series:
    return values.map(fold_text)


@series_udf(T.ArrayType(T.StringType()))
def anchors_udf(paths: pd.Series) -> pd.Series:
    return paths.map(lambda ps: sorted({fold_path(p) for p in ps}) if ps is not None else [])


@series_udf(T.ArrayType(T.StringType()))
def leakage_tokens_udf(anchors: pd.Series) -> pd.Series:
    return anchors.map(lambda a: leakage_tokens(list(a)) if a is not None else [])


@series_udf(T.StringType())
def identity_udf(problem: pd.Series, problem_type: pd.Series, anchors: pd.Series) -> pd.Series:
    rows = zip(problem, problem_type, anchors, strict=True)
    return pd.Series([identity_of(p, t, list(a) if a is not None else []) for p, t, a in rows])


@series_udf(T.StringType())
def digest_udf(records: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text in canonical form."""
    return records.map(lambda r: sha256(canonical_json(json.loads(r))))


@series_udf(T.BooleanType())
def has_content_udf(answers: pd.Series) -> pd.Series:
    """N7 over answers given as JSON text; text that is no JSON counts as a string."""

    def judge(text) -> bool:
        if text is None:
            return False
        try:
            return has_content(json.loads(text))
        except ValueError:
            return has_content(text)

    return answers.map(judge)


def bind_path_udf(root: str | None = None):
    @F.pandas_udf(T.StringType())
    def bind(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: None if p is None else bind_path(p, root))

    return bind


def fold_ascii(text: Column) -> Column:
    """N1 as an expression, for text without characters that NFKC or casefold would change beyond lower case."""
    blank = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "<image>|<video>", " ")
    return F.trim(F.regexp_replace(blank, r"[ \t\n\r]+", " "))


def is_remote(path: Column) -> Column:
    """Whether a path names a scheme."""
    return path.rlike(_REMOTE)


def stable_rank(seed: int, namespace: Column | str, identity: Column) -> Column:
    """Hex SHA-256 of seed|namespace|identity: equal lengths sort like the integer."""
    namespace = F.lit(namespace) if isinstance(namespace, str) else namespace
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), namespace, identity), 256)


def media_paths(images: Column, videos: Column) -> Column:
    """Images, then videos, each path once."""
    none = F.array().cast("array<string>")
    both = F.concat(F.coalesce(images, none), F.coalesce(videos, none))
    return F.array_distinct(F.filter(F.transform(both, lambda p: F.trim(p)), lambda p: p != ""))


def message_content(messages: Column, role: str, last: bool = False) -> Column:
    """First or last non-null content of a role in an array of (role, content)."""
    own = F.filter(messages, lambda m: (F.lower(m["role"]) == role) & m["content"].isNotNull())
    return F.try_element_at(own, F.lit(-1 if last else 1))["content"]


def canonical_record(raw: Column, problem_type: str | None = None, source: str | None = None) -> Column:
    """The canonical fields of a VARIANT record by alias (N4), as a struct of strings and string arrays.

    Answers that are no text are given as JSON.
    """

    def text(*names: str) -> Column:
        return F.coalesce(*[F.try_variant_get(raw, f"$.{n}", "string") for n in names])

    def media(plural: str, *names: str) -> Column:
        many = F.try_variant_get(raw, f"$.{plural}", "array<string>")
        one = text(plural, *names)
        return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))

    messages = F.try_variant_get(raw, "$.messages", "array<struct<role:string,content:string>>")
    return F.struct(
        F.coalesce(text("problem", "question", "prompt"), message_content(messages, "user")).alias("problem"),
        F.coalesce(
            text("answer", "ground_truth", "oracle_label", "oracle_labels", "solution"), message_content(messages, "assistant", True)
        ).alias("answer"),
        media("images", "image", "image_path").alias("images"),
        media("videos", "video", "video_path").alias("videos"),
        F.coalesce(F.nullif(text("problem_type"), F.lit("")), F.lit(problem_type)).alias("problem_type"),
        F.coalesce(F.lit(source), text("source")).alias("source"),
    )


def record_errors(problem: Column, answer: Column, problem_type: Column, source: Column, images: Column, videos: Column, has_mask: Column | None = None) -> Column:
    """What is wrong with a canonical record, all of it."""
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    has_mask = F.lit(False) if has_mask is None else has_mask & (F.lower(F.trim(problem_type)) == "segmentation")
    say = lambda bad, text: F.when(bad, F.lit(text))
    bad_path = lambda c, test: F.exists(F.coalesce(c, F.array().cast("array<string>")), test)
    checks = [say(blank(c), f"{n} must be a nonempty string") for n, c in (("problem", problem), ("problem_type", problem_type), ("source", source))]
    checks.append(say(blank(answer) & ~has_mask, "answer must contain a nonempty oracle label"))
    for n, c in (("images", images), ("videos", videos)):
        checks.append(say(c.isNull(), f"{n} must be a list"))
        checks.append(say(bad_path(c, blank), f"{n} must contain nonempty local paths"))
        checks.append(say(bad_path(c, is_remote), f"{n} must be local paths"))
    checks.append(say((F.size(images) == 0) & (F.size(videos) == 0), "at least one image or video is required"))
    return F.array_compact(F.array(*checks))
