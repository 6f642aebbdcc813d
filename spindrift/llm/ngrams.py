"""Scores of texts under an interpolated n-gram model kept in Elias-Fano tries.

Method: the n-grams of two and three words are dealt by their first word over shards. A shard stores its part of the model
as a trie: for each level the nodes of a context follow one another, pointers to the children are monotone, and child
words are made monotone by adding the last value of the context before, so both are Elias-Fano coded. Smoothed
probabilities (absolute discounting; what is discounted goes to the shorter context, at last to add-one unigrams) are
quantised to 16 bits of their logarithm. The levels are written to a file that is memory-mapped. A child is found by a
successor search for its word relative to its context's first value.

Plan: texts are cut into blocks of at most BLOCK words, kept as a table of word numbers. A block asks for each different
n-gram once, so that a word or passage that stands everywhere costs a block one request; the answers return to the block,
which adds up its texts. A first pass counts the words; those with more tokens than an even shard, so fewer of them than
shards, have their followers dealt over several shards, and their numbers of followers are broadcast. So are the names of
at most SHORT common words, which requests then say in two bytes or less. The model and the vocabulary are never in
one place: all moves in packed requests by shard and block.

Words are named by 64-bit hashes; different words have different names but for chance.
"""

from __future__ import annotations

import hashlib
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.near_duplicates import mix
from spindrift.session import scratch_folder, shuffle_width

#: Words of a block, and common words that requests say by number.
BLOCK, SHORT = 2_000_000, 1 << 18
DISCOUNT = 0.75
_U = np.uint64


def _name(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


BEGIN, END = _name(b" begin"), _name(b" end")  # no word holds a blank


# Packed arrays


def pack(x: np.ndarray) -> bytes:
    """The bytes of an array, each place of the items for itself, run-length and Huffman coded."""
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 8, zlib.Z_RLE)
    return coder.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()) + coder.flush()


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zlib.decompress(data, -15), dtype=np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


def elias_fano(x: np.ndarray) -> bytes:
    """A sorted array of 64-bit numbers: low bits as they are, high parts in unary."""
    x = x.astype(_U)
    n, top = len(x), int(x[-1]) + 1 if len(x) else 1
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    bits = np.empty((n, low), dtype=np.uint8)
    for k in range(low):
        bits[:, k] = (x >> _U(k)) & _U(1)
    high = np.zeros(n + (top >> low) + 1, dtype=np.uint8)
    high[(x >> _U(low)).astype(np.int64) + np.arange(n)] = 1
    head = np.array([n, low, len(high)], dtype=np.int64).tobytes()
    return head + np.packbits(bits).tobytes() + np.packbits(high).tobytes()


def elias_fano_values(data: np.ndarray) -> np.ndarray:
    """The numbers of :func:`elias_fano`, from its bytes."""
    n, low, width = np.frombuffer(data[:24].tobytes(), dtype=np.int64).tolist()
    cut = 24 + -(-n * low // 8)
    high = np.flatnonzero(np.unpackbits(data[cut : cut - (-width // 8)], count=width)) - np.arange(n)
    out = high.astype(_U) << _U(low)
    bits = np.unpackbits(data[24:cut], count=n * low).reshape(n, low)
    for k in range(low):
        out |= bits[:, k].astype(_U) << _U(k)
    return out


def quantised(p: np.ndarray) -> np.ndarray:
    """16 bits of -log2 in steps of 1/1023; 0 says zero."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.clip(np.round(-np.log2(np.maximum(p, 1e-300)) * 1023), 0, 65534), 0).astype(np.uint16)


def beside(code: np.ndarray, fan: np.ndarray) -> list[bytes]:
    """Codes of consecutive groups: the largest code of each, and how far from it each of its codes is; zeros stay.

    Most of a context's words were seen once, so most codes are its largest.
    """
    heads = np.cumsum(fan, dtype=np.int64) - fan.astype(np.int64)
    most = np.maximum.reduceat(code, heads) if len(code) else code
    return [pack(most), pack(np.where(code > 0, 1 + np.repeat(most, fan) - code, 0).astype(np.uint16))]


def from_beside(most: bytes, away: bytes, fan: np.ndarray) -> np.ndarray:
    gap = unpack(away, np.uint16)
    return np.where(gap > 0, np.repeat(unpack(most, np.uint16), fan) + 1 - gap, 0).astype(np.uint16)


def unquantised(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, np.exp2((1 - code.astype(np.float64)) / 1023), 0.0)


# The trie of a shard


def write_trie(path: str, keys: list[np.ndarray], counts: list[np.ndarray], words: int, split: dict[int, tuple[int, int]], discount: float) -> list[tuple[int, int]]:
    """Write the trained n-grams of a shard to a file and return the offset and length of each part.

    ``keys[k]`` is sorted: context * words + word, where the context is the first word, then the place of the
    shorter n-gram. ``split`` has count and followers of first words that several shards share.
    """
    parts: list[bytes] = []
    contexts = np.unique(keys[0] // words)
    parts.append(elias_fano(contexts))
    above = keys[0] // words
    owner = np.searchsorted(contexts, above)
    for k, (key, count) in enumerate(zip(keys, counts, strict=True)):
        size = len(contexts)
        fans = np.bincount(owner, minlength=size)
        total, followers = np.bincount(owner, weights=count, minlength=size), fans.astype(np.float64)
        if k == 0:
            for at, word in enumerate(contexts.tolist()):
                if word in split:
                    total[at], followers[at] = split[word]
        word = key % words
        last = np.cumsum(fans) - 1  # place of each context's last child
        room = np.where(fans > 0, word[np.maximum(last, 0)] + 1, 0) if len(word) else fans
        base = np.cumsum(room) - room
        some = np.maximum(total, 1)
        parts.append(elias_fano(np.cumsum(fans)))
        parts.append(elias_fano(word + base[owner]))
        parts.append(quantised((count - discount) / some[owner]).tobytes())
        parts.append(quantised(np.where(fans > 0, discount * followers / some, 1.0)).tobytes())
        if k + 1 < len(keys):
            owner, contexts = keys[k + 1] // words, np.arange(len(key))
    places, at = [], 0
    with open(path, "wb") as out:
        for p in parts:
            out.write(p)
            places.append((at, len(p)))
            at += len(p)
    return places


class Trie:
    """Answers for n-grams from the memory-mapped levels of a shard."""

    def __init__(self, path: str, places: list[tuple[int, int]]):
        self.data, self.places = np.memmap(path, dtype=np.uint8, mode="r"), places

    def _part(self, k: int) -> np.ndarray:
        at, size = self.places[k]
        return self.data[at : at + size]

    def roots(self, word: np.ndarray) -> np.ndarray:
        """Nodes of first words; -1 for those not learned."""
        known = elias_fano_values(self._part(0)).astype(np.int64)
        at = np.searchsorted(known, word)
        hit = at < len(known)
        hit[hit] = known[at[hit]] == word[hit]
        return np.where(hit, at, -1)

    def children(self, level: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node and quantised probability of each word after its context's node; -1 and 0 where it was not learned."""
        ends = elias_fano_values(self._part(1 + 4 * level)).astype(np.int64)
        values = elias_fano_values(self._part(2 + 4 * level)).astype(np.int64)
        codes = np.frombuffer(self._part(3 + 4 * level).tobytes(), dtype=np.uint16)
        if not len(values):
            return np.full(len(word), -1), np.zeros(len(word), dtype=np.uint16)
        known = np.maximum(context, 0)
        first = np.where(known > 0, ends[known - 1], 0)
        base = np.where(first > 0, values[np.maximum(first, 1) - 1] + 1, 0)
        at = np.searchsorted(values, base + word)  # successor in the context's part of the level
        hit = (context >= 0) & (at < ends[known])
        hit &= values[np.where(hit, at, 0)] == base + word
        return np.where(hit, at, -1), np.where(hit, codes[np.where(hit, at, 0)], 0).astype(np.uint16)

    def shares(self, level: int, context: np.ndarray) -> np.ndarray:
        """Quantised probability that a context leaves to the shorter one: all, where it was not learned."""
        codes = np.frombuffer(self._part(4 + 4 * level).tobytes(), dtype=np.uint16)
        return np.where(context >= 0, codes[np.maximum(context, 0)] if len(codes) else 1, 1).astype(np.uint16)


# Blocks of texts


class Grams:
    """The different n-grams of a block, in order of their words' numbers, and where each token has them."""

    def __init__(self, tokens: np.ndarray, begin: int, order: int, words: int):
        pairs = np.flatnonzero(tokens != begin)
        key = tokens[pairs - 1].astype(np.int64) * words + tokens[pairs]
        keys, at = np.unique(key, return_inverse=True)
        self.at, self.keys, self.tokens = [np.full(len(tokens), -1)], [keys], [pairs]
        self.at[0][pairs] = at
        for _ in range(order - 2):
            longer = self.tokens[-1]
            longer = longer[self.at[-1][longer - 1] >= 0]  # the token before has an n-gram of its own
            keys, at = np.unique(self.at[-1][longer - 1] * words + tokens[longer], return_inverse=True)
            self.at.append(np.full(len(tokens), -1))
            self.at[-1][longer] = at
            self.keys.append(keys)
            self.tokens.append(longer)

    def shards(self, own: np.ndarray, ways: np.ndarray, shards: int) -> list[np.ndarray]:
        """The shard of each n-gram: that of its first word, or of several by the second word's where the first has more ways."""
        root, word = np.divmod(self.keys[0], len(own))
        out = [(own[root] + own[word] % ways[root]) % shards]
        for keys in self.keys[1:]:
            out.append(out[-1][keys // len(own)])
        return out


def _by(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each shard, in order."""
    order = np.argsort(shard, kind="stable")
    heads = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for lo, hi in zip(heads, [*heads[1:], len(order)], strict=False):
        yield int(shard[order[lo]]), order[lo:hi]


BLOCKS = "block long, names binary, dealt binary, tokens binary, learned binary, lengths binary"
MESSAGE = "block long, shard int, kind int, data binary"


def text_blocks(df: DataFrame, text: str, key: str, learn: Column, shards: int) -> DataFrame:
    """Cut texts into blocks: each text begins with BEGIN and stops with END.

    A block's words are numbered by shard, then by name. ``names`` has their names, ``dealt`` how many each shard has and
    then the numbers of BEGIN and END, ``tokens`` the texts as numbers, one after the other, and ``lengths`` their tokens.
    """
    kind = dict(df.dtypes)[key]
    slim = df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))

    def block(number: int, keys: list[pa.Array], texts: list[list[bytes]], learned: list[bool]) -> pa.RecordBatch:
        words = [w for t in texts for w in t]
        sizes = np.array([len(t) + 2 for t in texts])
        _, first, at = np.unique(np.fromiter(map(hash, words), np.int64, len(words)), return_index=True, return_inverse=True)
        names = np.array([_name(words[i]) for i in first] + [BEGIN, END], dtype=_U)
        shard = (mix(names) % _U(shards)).astype(np.int64)
        order = np.lexsort((names, shard))
        place = np.empty(len(names), dtype=np.uint32)
        place[order] = np.arange(len(names), dtype=np.uint32)
        ends = np.cumsum(sizes)
        tokens = np.full(ends[-1], len(names) - 1, dtype=np.int64)
        inner = np.ones(ends[-1], dtype=bool)
        inner[ends - 1] = inner[ends - sizes] = False
        tokens[ends - sizes], tokens[inner] = len(names) - 2, at
        dealt = np.append(np.bincount(shard, minlength=shards), place[-2:]).astype(np.uint32)
        values = [[number], [pack(names[order])], [pack(dealt)], [pack(place[tokens])], [pack(np.array(learned, dtype=np.uint8))], [pack(sizes.astype(np.uint32))]]
        kinds = [pa.int64(), *[pa.binary()] * 5]
        arrays = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
        whole = pa.concat_arrays(keys)
        arrays.append(pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole))
        return pa.RecordBatch.from_arrays(arrays, ["block", "names", "dealt", "tokens", "learned", "lengths", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        keys, texts, learned, size = [], [], [], 0
        for batch in batches:
            start = 0
            for i, value in enumerate(batch.column(1)):
                texts.append(value.as_buffer().to_pybytes().lower().split() if value.is_valid else [])
                learned.append(batch.column(2)[i].as_py())
                size += len(texts[-1]) + 2
                if size >= BLOCK:
                    yield block(number, [*keys, batch.column(0).slice(start, i + 1 - start)], texts, learned)
                    number, start, keys, texts, learned, size = number + 1, i + 1, [], [], [], 0
            if start < len(batch):
                keys.append(batch.column(0).slice(start))
        if texts:
            yield block(number, keys, texts, learned)

    return slim.mapInArrow(run, f"{BLOCKS}, keys array<{kind}>")


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "shard", "kind", "data"])


def _joined(parts: list[bytes]) -> bytes:
    """Several byte strings as one."""
    return np.array([len(parts), *map(len, parts)], dtype=np.int64).tobytes() + b"".join(parts)


def _split(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data[:8], dtype=np.int64)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(data[8 : 8 * (n + 1)], dtype=np.int64))
    return [data[a:b] for a, b in zip([8 * (n + 1), *ends[:-1]], ends, strict=True)]


class Opened:
    """A block's arrays: tokens, the shard of each word, text lengths, and for each token whether it is learned from."""

    def __init__(self, row: dict):
        self.tokens = unpack(row["tokens"], np.uint32)
        dealt = unpack(row["dealt"], np.uint32).astype(np.int64)
        self.own, (self.begin, self.end) = np.repeat(np.arange(len(dealt) - 2), dealt[:-2]), dealt[-2:].tolist()
        self.lengths = unpack(row["lengths"], np.uint32).astype(np.int64)
        self.texts_learned = unpack(row["learned"], np.uint8)
        self.learned = np.repeat(self.texts_learned, self.lengths)


def _each_block(blocks: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield run(row)

    return blocks.select(columns).mapInArrow(over, schema)


OPEN = ["block", "dealt", "tokens", "learned", "lengths"]
#: Kinds of messages.
COUNT, PAIRS, COMMON, TOTAL = range(4)


def word_counts(blocks: DataFrame, shards: int) -> DataFrame:
    """Messages: how often each word of a block was learned (COUNT), each shard's tokens and words (TOTAL), common words (COMMON)."""

    def ask(row: dict) -> pa.RecordBatch:
        block, names = Opened(row), unpack(row["names"], _U)
        count = np.bincount(block.tokens[block.learned > 0], minlength=len(names)).astype(np.uint32)
        count[block.begin] = 0
        return _messages([(row["block"], s, COUNT, _joined([pack(np.diff(names[at], prepend=_U(0))), pack(count[at])])) for s, at in _by(block.own)])

    def answer(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        parts = [_split(d.as_py()) for d in table["data"]]
        names = [np.cumsum(unpack(p[0], _U)) for p in parts]
        known, at = np.unique(np.concatenate(names), return_inverse=True)
        count = np.bincount(at, weights=np.concatenate([unpack(p[1], np.uint32) for p in parts]), minlength=len(known)).astype(np.int64)
        cuts = np.cumsum([len(n) for n in names])[:-1]
        out = [(b, shard, COUNT, pack(x)) for b, x in zip(table["block"].to_pylist(), np.split(count[at], cuts), strict=True)]
        most = np.argsort(-count, kind="stable")[: max(1, SHORT // shards)]
        out.append((-1, shard, TOTAL, np.array([count.sum(), (count > 0).sum()]).tobytes()))
        out.append((-1, shard, COMMON, known[most].tobytes() + count[most].tobytes()))
        return pa.Table.from_batches([_messages(out)])

    return _each_block(blocks, [*OPEN, "names"], ask, MESSAGE).groupBy("shard").applyInArrow(answer, MESSAGE)


def common_words(counts: DataFrame, shards: int) -> tuple[int, int, int, np.ndarray, dict[int, int]]:
    """Number of learned tokens and words; a count, the words that have more and their counts; common words, sorted.

    That count is an even shard of the tokens, or more if a shard could not name all such words; so those that have more
    are fewer than shards. There are SHORT common words, or one a shard.
    """
    tokens = words = most = 0
    for row in counts.where(F.col("kind") == TOTAL).select("data").toLocalIterator():
        n, v = np.frombuffer(row["data"], dtype=np.int64).tolist()
        tokens, words = tokens + n, words + v
    names, number = [], []
    for row in counts.where(F.col("kind") == COMMON).select("data").toLocalIterator():
        half = len(row["data"]) // 2
        names.append(np.frombuffer(row["data"][:half], dtype=_U))
        number.append(np.frombuffer(row["data"][half:], dtype=np.int64))
        if len(names[-1]) >= SHORT // shards:
            most = max(most, int(number[-1][-1]))
    names, number = np.concatenate([np.empty(0, _U), *names]), np.concatenate([np.empty(0, np.int64), *number])
    least = max(tokens // shards, most)
    hot = dict(zip(names[number > least].tolist(), number[number > least].tolist(), strict=True))
    if END in hot:
        hot[BEGIN] = hot.pop(END)  # as many texts begin as end; nothing follows an end
    return tokens, words, least, np.sort(names), hot


def _ways(count: np.ndarray, least: int, tokens: int, shards: int) -> np.ndarray:
    """Over how many shards the followers of words are dealt."""
    return np.where(count > least, 1 + count * shards // max(tokens, 1), 1)


def followers(blocks: DataFrame, hot: dict[int, int], shards: int) -> dict[int, int]:
    """How many different words follow each of a few words, counted in parts by the name of the follower."""
    if not hot:
        return {}

    def ask(row: dict) -> pa.RecordBatch:
        block, names = Opened(row), unpack(row["names"], _U)
        grams = Grams(np.where(block.learned > 0, block.tokens, block.begin), block.begin, 2, len(names))
        root, word = np.divmod(grams.keys[0], len(names))
        few = np.isin(names[root], np.array(list(hot), dtype=_U))
        root, word = root[few], word[few]
        out = []
        for s, at in _by(block.own[word]):
            out.append((row["block"], s, PAIRS, _joined([pack(names[root[at]]), pack(names[word[at]])])))
        return _messages(out)

    def answer(table: pa.Table) -> pa.Table:
        parts = [_split(d.as_py()) for d in table["data"]]
        roots, root = np.unique(np.concatenate([unpack(p[0], _U) for p in parts]), return_inverse=True)
        words, word = np.unique(np.concatenate([unpack(p[1], _U) for p in parts]), return_inverse=True)
        count = np.bincount(np.unique(root * len(words) + word) // len(words), minlength=len(roots))
        return pa.table({"name": pa.array(roots.view(np.int64)), "n": pa.array(count)})

    found = _each_block(blocks, [*OPEN, "names"], ask, MESSAGE).groupBy("shard").applyInArrow(answer, "name long, n long")
    return {r["name"] % 2**64: r["n"] for r in found.groupBy("name").agg(F.sum("n").alias("n")).collect()}


def _said(names: np.ndarray, common: np.ndarray) -> list[bytes]:
    """Sorted names in brief: numbers of common words, and the names of others."""
    at = np.searchsorted(common, names)
    known = at < len(common)
    known[known] = common[at[known]] == names[known]
    return [pack(np.diff(at[known], prepend=0).astype(np.uint32)), pack(np.diff(names[~known], prepend=_U(0)))]


def _understood(numbers: bytes, names: bytes, common: np.ndarray) -> np.ndarray:
    return np.sort(np.concatenate((common[np.cumsum(unpack(numbers, np.uint32))], np.cumsum(unpack(names, _U)))))


def answers(blocks: DataFrame, order: int, shards: int, split: dict[int, tuple[int, int]], ways: dict[int, int], common: np.ndarray, discount: float) -> DataFrame:
    """For each block and shard the quantised probabilities of the block's n-grams there (PAIRS).

    ``split`` has count and followers of each word whose followers are dealt over several shards, ``ways`` over how many.
    Only a shard's own words need to be told apart here, so requests say the upper 48 bits of their names.
    """
    split, common = {w >> 16: v for w, v in split.items()}, np.unique(common >> _U(16))
    hot = np.array(sorted(ways), dtype=_U)
    dealt = np.array([ways[w] for w in sorted(ways)], dtype=np.int64)

    def ask(row: dict) -> pa.RecordBatch:
        block, names = Opened(row), unpack(row["names"], _U)
        grams, brief = Grams(block.tokens, block.begin, order, len(names)), names >> _U(16)
        over = np.ones(len(names), dtype=np.int64)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, names), len(hot) - 1)
            over = np.where(hot[at] == names, dealt[at], 1)
        where = grams.shards(block.own, over, shards)
        counts = [np.bincount(a[t], weights=block.learned[t], minlength=len(k)).astype(np.uint32) for a, t, k in zip(grams.at, grams.tokens, grams.keys, strict=True)]
        longer = [dict(_by(w)) for w in where[1:]]
        out = []
        for s, at in _by(where[0]):
            root, word = np.divmod(grams.keys[0][at], len(names))
            roots, fan = np.unique(root, return_counts=True)
            levels, above = [(fan, word, counts[0][at])], at
            for k, places in enumerate(longer, 1):
                mine = places.get(s, np.empty(0, dtype=np.int64))
                context, word = np.divmod(grams.keys[k][mine], len(names))
                levels.append((np.bincount(np.searchsorted(above, context), minlength=len(above)), word, counts[k][mine]))
                above = mine
            local = np.unique(brief[np.unique(np.concatenate([roots, *[w for _, w, _ in levels]]))])
            said = lambda w: pack(np.searchsorted(local, brief[w]).astype(np.uint32))  # noqa: E731, B023
            parts = [*_said(local, common), said(roots)]
            for fan, word, count in levels:
                parts += [pack(fan.astype(np.uint32)), said(word), pack(count)]
            out.append((row["block"], s, PAIRS, _joined(parts)))
        return _messages(out)

    def answer(table: pa.Table) -> pa.Table:
        shard, parts = table["shard"][0].as_py(), [_split(d.as_py()) for d in table["data"]]
        names = [_understood(*p[:2], common) for p in parts]
        known = np.unique(np.concatenate(names))
        number = [np.searchsorted(known, n) for n in names]
        words = len(known)
        column = lambda k: [unpack(p[k], np.uint32) for p in parts]
        roots = [n[r] for n, r in zip(number, column(2), strict=True)]
        context = np.concatenate([np.repeat(r, f) for r, f in zip(roots, column(3), strict=True)])
        keys, counts, at, sizes = [], [], [], []
        for k in range(order - 1):
            said = column(4 + 3 * k)
            word = np.concatenate([n[w] for n, w in zip(number, said, strict=True)])
            sizes.append([len(w) for w in said])
            if k:
                context = np.repeat(at[-1], np.concatenate(column(3 + 3 * k)))
            key, place = np.unique(context * words + word, return_inverse=True)
            keys.append(key)
            at.append(place)
            counts.append(np.bincount(place, weights=np.concatenate(column(5 + 3 * k)), minlength=len(key)))
        with tempfile.TemporaryDirectory(prefix="trie-") as folder:
            learned, learned_counts, new = [], [], None
            for k, (key, count) in enumerate(zip(keys, counts, strict=True)):
                keep = count > 0
                kept = key[keep] if new is None else new[key[keep] // words] * words + key[keep] % words
                learned.append(kept)
                learned_counts.append(count[keep])
                new = np.cumsum(keep) - 1  # places among the learned ones
            shared = {int(np.searchsorted(known, _U(w))): v for w, v in split.items() if len(known) and known[min(np.searchsorted(known, _U(w)), words - 1)] == _U(w)}
            trie = Trie(path := f"{folder}/levels", write_trie(path, learned, learned_counts, words, shared, discount))
            first = np.concatenate(roots)
            node = trie.roots(keys[0] // words)
            asked = [np.split(trie.shares(0, trie.roots(first)), np.cumsum([len(r) for r in roots])[:-1])]
            for k, key in enumerate(keys):
                context = node if k == 0 else node[key // words]
                node, code = trie.children(k, context, key % words)
                cuts = np.cumsum(sizes[k])[:-1]
                codes = np.split(code[at[k]], cuts)
                if k == 0:
                    both = [beside(c, f) for c, f in zip(codes, column(3), strict=True)]
                    asked += [[b[0] for b in both], [b[1] for b in both]]
                else:
                    asked.append(codes)
                if k + 2 < order:
                    asked.append(np.split(trie.shares(k + 1, node)[at[k]], cuts))
            del trie
        as_bytes = lambda x: x if isinstance(x, bytes) else pack(x)
        out = [(b, shard, PAIRS, _joined([as_bytes(x) for x in rows])) for b, *rows in zip(table["block"].to_pylist(), *asked, strict=True)]
        return pa.Table.from_batches([_messages(out)])

    return _each_block(blocks, [*OPEN, "names"], ask, MESSAGE).groupBy("shard").applyInArrow(answer, MESSAGE)


def score_texts(df: DataFrame, learn: Column, text: str = "text", key: str = "doc_id", order: int = 3, discount: float = DISCOUNT) -> DataFrame:
    """Score each whole text by a model of the rows where ``learn`` holds: ``key``, ``learned``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` and ``score``.

    Tokens are the words that blanks divide, A-Z lower-cased, and one end. ``base_score`` is the log10 probability under
    add-one unigrams with one unknown word, ``score`` that under n-grams of up to ``order`` words (at least two), whose
    probabilities are rounded to 16 bits of their logarithm, so those of a context add up to one within a few parts in
    ten thousand. Null and empty texts have one token, their end. A null in ``learn`` means no. Rows are independent:
    repeated rows and equal or null keys give a row each; an empty table gives an empty result; a table without learned
    rows gives every token probability one, as add-one smoothing without words says. Other columns of df are left out.
    """
    spark = df.sparkSession
    shards = 2 * shuffle_width(spark)
    folder = scratch_folder(spark, "ngrams")
    text_blocks(df, text, key, learn, shards).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    word_counts(blocks, shards).write.option("compression", "zstd").parquet(f"{folder}/words")
    counts = spark.read.parquet(f"{folder}/words")
    tokens, words, least, common, hot = common_words(counts, shards)
    number = followers(blocks, hot, shards)
    split = {w: (n, number.get(w, 0)) for w, n in hot.items()}
    ways = {w: int(_ways(np.array(n), least, tokens, shards)) for w, n in hot.items()}
    said = answers(blocks, order, shards, split, ways, common, discount)
    kind = dict(blocks.dtypes)["keys"]
    empty = F.lit(None).cast("binary")
    own = blocks.select("block", F.lit(-1).alias("shard"), F.lit(TOTAL).alias("kind"), empty.alias("data"), *OPEN[1:], "keys")
    back = counts.where("block >= 0").unionByName(said)
    back = back.select("*", *[empty.alias(c) for c in OPEN[1:]], F.lit(None).cast(kind).alias("keys"))
    fields = ["learned", "n_tokens", "n_known", "base_score", "score"]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def finish(table: pa.Table) -> pa.Table:
        rows = table.select(["shard", "kind", "data", *OPEN[1:]]).to_pylist()
        row = next(r for r in rows if r["kind"] == TOTAL)
        block = Opened(row)
        token = block.tokens
        count = np.zeros(len(block.own), dtype=np.int64)
        given = {(r["kind"], r["shard"]): r["data"] for r in rows}
        for s, at in _by(block.own):
            count[at] = unpack(given[COUNT, s], np.int64)
        grams = Grams(token, block.begin, order, len(count))
        begun = np.where(np.arange(len(count)) == block.begin, count[block.end], count)
        where = grams.shards(block.own, _ways(begun, least, tokens, shards), shards)
        longer = [dict(_by(w)) for w in where[1:]]
        found = [np.zeros(len(k)) for k in grams.keys]
        left = [np.ones(len(k)) for k in grams.keys]
        for s, at in _by(where[0]):
            shares, most, away, *rest = _split(given[PAIRS, s])
            _, root, fan = np.unique(grams.keys[0][at] // len(count), return_inverse=True, return_counts=True)
            found[0][at] = unquantised(from_beside(most, away, fan))
            left[0][at] = unquantised(unpack(shares, np.uint16))[root]
            parts = [unquantised(unpack(d, np.uint16)) for d in rest]
            here = at
            for k, places in enumerate(longer, 1):
                share = parts[2 * k - 2][np.searchsorted(here, grams.keys[k][mine := places.get(s, np.empty(0, dtype=np.int64))] // len(count))]
                found[k][mine], left[k][mine], here = parts[2 * k - 1], share, mine
        unigram = (count + 1) / (tokens + words + 1)
        p = unigram[token]
        for at, hit, f, b in zip(grams.at, grams.tokens, found, left, strict=True):
            p[hit] = f[at[hit]] + b[at[hit]] * p[hit]
        said_so = token != block.begin
        starts = np.cumsum(block.lengths) - block.lengths
        summed = lambda x: np.add.reduceat(np.where(said_so, x, 0), starts)
        values = [
            block.texts_learned > 0,
            summed(np.ones(len(token), dtype=np.int64)),
            summed((count[token] > 0).astype(np.int64)),
            summed(np.log10(unigram)[token]),
            summed(np.log10(np.where(said_so, p, 1.0))),
        ]
        keys = table["keys"].combine_chunks().flatten()
        return pa.table({"key": keys, **{n: pa.array(v, k) for n, v, k in zip(fields, values, kinds, strict=True)}})

    schema = f"key {kind[6:-1]}, learned boolean, n_tokens long, n_known long, base_score double, score double"
    scored = own.unionByName(back).groupBy("block").applyInArrow(finish, schema)
    return scored.select(F.col("key").alias(key), "learned", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
