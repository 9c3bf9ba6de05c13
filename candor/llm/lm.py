"""Language-model scoring from an Elias-Fano n-gram trie.

The model is an n-gram model of words (order 3 unless told otherwise) with modified Kneser-Ney
discounts (at each order one each for counts of one, two, and more, from the counts of counts),
interpolated down to add-one unigrams. It is counted over all training documents and kept as a trie
of one level for each order, in the shared folder:

level 1: words as sorted hashes, cut by their leading bits into shards, so that a word's id is its
rank, with their counts;
level k: for each node of level k - 1 the words that follow it. Elias-Fano pointers bound each node's
range; word ids are made non-decreasing over a file by adding the last value of the range before, and
are an Elias-Fano sequence too. A node's number is its place in its level. Discounted log probabilities
and back-off weights are quantised to 256 values.

A look-up adds the range's base to the id and takes the successor, so words are searched relative to
their context, level by level. A level is cut into pieces of about SHARD_TOKENS training tokens: the
followers of a shard or piece of the level above, and where those were counted more often than that,
as with a frequent context, ranges of word ids of them. Executors map the files; neither the driver
nor a worker ever holds the model, and the driver keeps only totals.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.llm import eliasfano, sharedfiles
from candor.llm import textkernel as tk
from candor.llm.eliasfano import EliasFano
from candor.llm.scratch import Scratch
from candor.llm.workers import bound_batches, release, trimmed

U = np.uint64
ORDER = 3
#: The end of a text, a token and the context of its first word.
END = U(0x5EED0FE2D0FA11ED)
SHARD_TOKENS = 2_000_000
#: Tokens that a task combines before it hands their counts on.
BUFFER = 1_000_000
#: Bytes of text that are looked up together.
CHUNK = 1 << 22
#: Files of each kind that a worker holds open: mapped ones, and ones read into memory.
OPEN_MAPPED, OPEN_READ = 4096, 64


#: Of a parent: how often something follows it, and its followers by how often they do: once, twice, more.
_STATS = ("total", "once", "twice", "more")
_LIST = pa.list_(pa.int64())
_FILE = pa.schema([*((c, pa.int64()) for c in ("file", "n", "tokens")), ("of", _LIST), ("above", pa.int64()), ("at", _LIST), *((c, _LIST) for c in _STATS)])


def held_out(id_col: str, modulus: int = 7, remainder: int = 2) -> Column:
    """Whether a row is kept out of training; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus == remainder


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token, place of each text's end token): words, then END, text by text."""
    held, ends, n = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
    for lo, hi in tk.chunks(texts):  # small enough for the cache
        w = tk.Words(texts[lo:hi])
        out = np.empty(len(w.starts) + hi - lo, U)
        end = np.cumsum(w.counts() + 1) - 1
        out[end] = END
        place = np.ones(len(out), bool)
        place[end] = False
        out[place] = w.hashes()
        held.append(out)
        ends.append(end + n)
        n += len(out)
    return np.concatenate(held), np.concatenate(ends)


def _buffers(batches, column: int = 0):
    """Tokens of many whole texts at a time, up to about BUFFER."""
    held, n = [], 0
    for batch in batches:
        texts = tk.as_bytes(batch.column(column))
        for lo, hi in tk.chunks(texts, CHUNK):
            held.append(_tokens(texts[lo:hi])[0])
            n += len(held[-1])
            if n >= BUFFER:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def _count_words(batches):
    for tokens in _buffers(batches):
        h, c = np.unique(tokens, return_counts=True)
        for i in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000].view(np.int64)), pa.array(c[i : i + 100_000])], ["h", "c"])


class Shelf:
    """Opened files by level and number, or number; beyond its bound the one that was used longest ago is closed."""

    def __init__(self, root: str, load: Callable):
        self.load, self.most = load, OPEN_MAPPED if sharedfiles.mapped(root) else OPEN_READ
        self.held: dict = {}

    def __getitem__(self, s):
        found = self.held.pop(s, None) or self.load(s)
        self.held[s] = found  # dictionaries keep the order of insertion
        if len(self.held) > self.most:
            del self.held[next(iter(self.held))]
        return found


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, each element's number among them) of numbers from 0 on, as np.unique, but by sorting values with their places."""
    if (x[1:] >= x[:-1]).all():
        new = np.ones(len(x), bool)
        new[1:] = x[1:] != x[:-1]
        return x[new], np.cumsum(new) - 1
    kind, x, bits = x.dtype, x.astype(U, copy=False), len(x).bit_length()
    cut = max(0, int(x.max()).bit_length() + bits - 64)
    keyed = (x >> U(cut)) << U(bits) | np.arange(len(x), dtype=U)
    keyed.sort()
    place = (keyed & U((1 << bits) - 1)).astype(np.int64)
    value = x[place]
    if cut and (value[1:] < value[:-1]).any():  # values that differ in the bits cut off only
        value, at = np.unique(x, return_inverse=True)
        return value.astype(kind, copy=False), at
    new = np.ones(len(x), bool)
    new[1:] = value[1:] != value[:-1]
    at = np.empty(len(x), np.int64)
    at[place] = np.cumsum(new) - 1
    return value[new].astype(kind, copy=False), at


def _runs(numbers: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(number, its places) of a sorted array: only numbers that occur."""
    if len(numbers):
        edges = np.concatenate([[0], np.flatnonzero(np.diff(numbers)) + 1, [len(numbers)]])
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            yield int(numbers[i]), slice(int(i), int(j))


class Grams:
    """A piece of a level: pointers by parent, counted from the first one of the parents' file, and followers."""

    def __init__(self, root: str, level: int, piece: int):
        a = sharedfiles.read(root, f"grams-{level}-{piece}")
        part = lambda p: EliasFano({k: a[f"{p}_{k}"] for k in ("meta", "low", "high", "ones", "zeros")})
        self.pointers, self.followers = part("pointer"), part("follower")

    def places(self, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The place of each (parent, word), -1 where there is none; parents in order."""
        new = np.concatenate([[True], parents[1:] != parents[:-1]])
        first, end = (b.astype(np.int64) for b in self.pointers.ranges(parents[new]))
        return self.followers.find_after(words.astype(U), first, end, np.cumsum(new) - 1)


class Trie:
    """The files below a root. Nodes of a level are numbered through; ``first(k)`` holds each file's first number and their total."""

    def __init__(self, root: str):
        self.root = root
        self.arrays: dict[str, np.ndarray] = {}
        self.bits = int(math.log2(max(1, len(self.first(1)) - 1)))
        self.words = Shelf(root, lambda s: sharedfiles.read(root, f"words-{s}"))
        self.grams = Shelf(root, lambda at: Grams(root, *at))
        self.probs = Shelf(root, lambda at: sharedfiles.read(root, f"probs-{at[0]}-{at[1]}"))
        self.backs = Shelf(root, lambda at: sharedfiles.read(root, f"back-{at[0]}-{at[1]}"))

    def _array(self, name: str, part: str) -> np.ndarray:
        if name not in self.arrays:
            self.arrays[name] = sharedfiles.read(self.root, name)[part]
        return self.arrays[name]

    def first(self, level: int) -> np.ndarray:
        """The first node of each file of a level, and the number of nodes."""
        return self._array(f"first-{level}", "id")

    def cuts(self, level: int) -> np.ndarray:
        """The first piece of each file of the level above, and the number of pieces."""
        return self._array(f"cuts-{level}", "piece")

    def owner(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The file of each node."""
        return np.searchsorted(self.first(level), nodes, "right") - 1

    def look_up(self, sorted_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of distinct sorted hashes; -1 and 0 for unknown words."""
        ids, counts = np.full(len(sorted_hashes), -1, np.int64), np.zeros(len(sorted_hashes), np.int64)
        of = (sorted_hashes >> U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(sorted_hashes), np.int64)
        first = self.first(1)
        for s, part in _runs(of):
            if first[s] == first[s + 1]:
                continue
            known = self.words[s]
            at = np.searchsorted(known["h"], sorted_hashes[part])
            at[at == len(known["h"])] = 0
            hit = known["h"][at] == sorted_hashes[part]
            ids[part] = np.where(hit, at + first[s], -1)
            counts[part] = np.where(hit, known["c"][at], 0)
        return ids, counts

    def pieces(self, level: int, parents: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, parent counted from its file's first) of pairs of a node of the level above and a word."""
        s, cuts = self.owner(level - 1, parents), self.cuts(level)
        parts = cuts[s + 1] - cuts[s]
        vocabulary = int(self.first(1)[-1])
        return cuts[s] + words * parts // vocabulary, parents - self.first(level - 1)[s]

    def find(self, level: int, parents: np.ndarray, words: np.ndarray, weighed: bool) -> tuple[np.ndarray, np.ndarray]:
        """(node, discounted probability) of pairs; -1 and 0 where there is none. Probabilities only if weighed."""
        node, share = np.full(len(parents), -1, np.int64), np.zeros(len(parents))
        if not len(parents):
            return node, share
        piece, local = self.pieces(level, parents, words)
        order = np.argsort(piece, kind="stable")
        piece, local, words = piece[order], local[order], words[order]
        first = self.first(level)
        for p, part in _runs(piece):
            if first[p] == first[p + 1]:
                continue
            place = self.grams[level, p].places(local[part], words[part])
            seen = place >= 0
            to = order[part][seen]
            node[to] = place[seen] + first[p]
            if weighed:
                probs = self.probs[level, p]
                share[to] = probs["book"][probs["code"][place[seen]]]
        return node, share

    def back_off(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The weight that each distinct, sorted node of a level leaves to shorter contexts, 1 if nothing follows it."""
        out = np.ones(len(nodes))
        first, cuts = self.first(level + 1), self.cuts(level + 1)
        of = self.owner(level, nodes)
        for s, part in _runs(of):
            if first[cuts[s + 1]] > first[cuts[s]]:
                backs = self.backs[level, s]
                out[part] = backs["book"][backs["code"][nodes[part] - self.first(level)[s]]]
        return out


_tries: dict[str, Trie] = {}


def _trie(root: str) -> Trie:
    if root not in _tries:
        _tries.clear()
        _tries[root] = Trie(root)
    return _tries[root]


class Walk:
    """The n-grams of some tokens, as distinct (parent, word) pairs of each level and each token's pair.

    Tokens are whole texts, each ended by END. A text's first word has END as its context and no longer one.
    """

    def __init__(self, trie: Trie, tokens: np.ndarray):
        self.trie = trie
        self.hashes, self.word = _distinct(tokens)
        self.ids, self.counts = trie.look_up(self.hashes)
        self.starts = np.concatenate([[True], tokens[:-1] == END])
        (self.end,) = trie.look_up(np.array([END], U))[0]
        # each token's node of the level before: its number among the distinct ones, -1 where it has none
        self.own, self.nodes = self.word, self.ids

    def step(self, level: int) -> None:
        """Sets pair (each token's distinct pair, -1 if its context is unknown), parent and words of the pairs."""
        if level == 2:
            end = np.flatnonzero(self.hashes == END)
            before = np.concatenate([end, self.own[:-1]])
        else:
            before = np.concatenate([[-1], self.own[:-1]])
            before[self.starts] = -1
        known = before >= 0
        known[known] = self.nodes[before[known]] >= 0
        size = len(self.hashes)
        pairs, at = _distinct(before[known] * size + self.word[known])
        self.pair = np.full(len(self.word), -1, np.int64)
        self.pair[known] = at
        self.parent_at, self.word_at = pairs // size, pairs % size
        self.parents, self.words = self.nodes[self.parent_at], self.ids[self.word_at]

    def find(self, level: int, weighed: bool = False) -> np.ndarray:
        """Looks the pairs up, which become the nodes of the next step; returns their discounted probabilities."""
        node, share = np.full(len(self.parents), -1, np.int64), np.zeros(len(self.parents))
        told = np.flatnonzero(self.words >= 0)
        node[told], share[told] = self.trie.find(level, self.parents[told], self.words[told], weighed)
        self.own, self.nodes = self.pair, node
        return share


def keys_of(trie: Trie, level: int, parents: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, parent within its file and word as one number) of pairs that a level is to hold."""
    vocabulary = int(trie.first(1)[-1])
    piece, local = trie.pieces(level, parents, words)
    if len(local) and int(local.max()).bit_length() + vocabulary.bit_length() > 64:
        raise ValueError(f"contexts up to {int(local.max())} of a file and {vocabulary} words don't fit in 64 bits: lower SHARD_TOKENS")
    return piece, local.astype(U) << U(vocabulary.bit_length()) | words.astype(U)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys: differences, byte planes, compressed."""
    planes = np.diff(keys, prepend=U(0)).view(np.uint8).reshape(-1, 8).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, n * 8, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U).ravel(), dtype=U)


def _quantised(x: np.ndarray) -> dict[str, np.ndarray]:
    """Codes and 256 values of the powers of ten of x: exact for up to 256 values, else of means of bins between quantiles and even steps."""
    values = np.unique(x)
    if len(values) <= 256:
        book = np.concatenate([values, np.zeros(256 - len(values))])
        return {"code": np.searchsorted(values, x).astype(np.uint8), "book": 10.0**book}
    even = np.linspace(values[0], values[-1], 130)[1:-1]
    edges = np.unique(np.concatenate([np.quantile(x, np.arange(1, 128) / 128), even]))
    code = np.searchsorted(edges, x, "right")
    n = np.bincount(code, minlength=256)
    return {"code": code.astype(np.uint8), "book": 10.0 ** (np.bincount(code, x, 256) / np.maximum(n, 1))}


class Model:
    """What a scorer needs to know besides the files: where they are, totals, the order."""

    def __init__(self, root: str, words: int, tokens: int, order: int):
        self.root, self.words, self.tokens, self.order = root, words, tokens, order

    def log_probs(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(counts, add-one unigram, model) of each token, the latter two as log10, in texts joined by END."""
        trie = _trie(self.root)
        walk = Walk(trie, tokens)
        unigram = (walk.counts + 1) / (self.tokens + 1 * (self.words + 1))
        p = unigram[walk.word]
        for k in range(2, self.order + 1):
            walk.step(k)
            parents, pair = walk.parents, walk.pair
            each, at = _distinct(parents)
            back = trie.back_off(k - 1, each)[at]
            share = walk.find(k, weighed=True)
            told = pair >= 0
            p[told] = share[pair[told]] + back[pair[told]] * p[told]
        return walk.counts[walk.word], np.log10(unigram)[walk.word], np.log10(p)


def train(docs: DataFrame, text_col: str = "text", scratch: Scratch | None = None, order: int = ORDER) -> Model:
    """Counts docs and writes the trie; null text is empty.

    Counts and node numbers have 64 bits. A pair of a parent within its file and a word id has to fit
    in 64 bits, which is checked; with SHARD_TOKENS parents a file that allows for 2 ** 43 words.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = scratch or Scratch(spark, "lm")
    root = f"{scratch.root}/trie"
    texts = docs.select(F.col(text_col).alias("text"))
    words = texts.mapInArrow(trimmed(_count_words), "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))
    words = scratch.save(words, "words")
    tokens = words.agg(F.sum("c")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, tokens / SHARD_TOKENS))))
    shard = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("bigint")

    def write_words(table: pa.Table) -> pa.Table:
        s = table["file"][0].as_py()
        h, c = np.asarray(table["h"]).view(U), np.asarray(table["c"])
        rank = np.argsort(h)
        sharedfiles.write(root, f"words-{s}", {"h": h[rank], "c": c[rank].astype(np.int64)})
        return pa.table({"file": pa.array([s], pa.int64()), "n": pa.array([len(h)], pa.int64()), "tokens": pa.array([c.sum()], pa.int64())})

    width = _width(spark, 1 << bits)
    made = words.withColumn("file", shard).repartition(width, "file").groupBy("file").applyInArrow(write_words, "file bigint, n bigint, tokens bigint")
    total_words, pieces = _plan(scratch.save(made, "files"), root, 1, 1 << bits)
    scratch.drop(words)
    for k in range(2, order + 1):
        if total_words:
            pieces = _add_level(scratch, texts, root, k, pieces)
    return Model(root, total_words, tokens, order if total_words else 1)


def _width(spark, files: int) -> int:
    """Partitions for a number of files: one each, up to four for each core there is, 4,096 at least."""
    return max(1, min(files, max(4096, 4 * spark.sparkContext.defaultParallelism)))


def _plan(files: DataFrame, root: str, level: int, number: int) -> tuple[int, int]:
    """Numbers the nodes of a level's files (file, n, tokens) and cuts the level below into pieces; (nodes, pieces).

    One task writes both as arrays with a number for each of ``number`` files; the driver gets the totals.
    """

    def write(table: pa.Table) -> pa.Table:
        n, tokens = np.zeros(number, np.int64), np.zeros(number, np.int64)
        at = np.asarray(table["file"])
        n[at], tokens[at] = np.asarray(table["n"]), np.asarray(table["tokens"])
        first = np.concatenate([[0], np.cumsum(n)])
        piece = np.concatenate([[0], np.cumsum(np.maximum(1, tokens // SHARD_TOKENS))])
        sharedfiles.write(root, f"first-{level}", {"id": first})
        sharedfiles.write(root, f"cuts-{level + 1}", {"piece": piece})
        return pa.table({"nodes": pa.array(first[-1:]), "pieces": pa.array(piece[-1:])})

    row = files.select("file", "n", "tokens").groupBy(F.lit(1).alias("one")).applyInArrow(write, "nodes bigint, pieces bigint").first()
    if row is None:
        sharedfiles.write(root, f"first-{level}", {"id": np.zeros(number + 1, np.int64)})
    return (row["nodes"], row["pieces"]) if row else (0, 0)


def _stats(parent: np.ndarray, count: np.ndarray, parents: int) -> dict[str, np.ndarray]:
    """_STATS of parents by the counts of their followers."""
    of = [np.bincount(parent[chosen], minlength=parents) for chosen in (count == 1, count == 2, count >= 3)]
    return dict(zip(_STATS, [np.bincount(parent, count, parents).astype(np.int64), *of], strict=True))


def _add_level(scratch: Scratch, texts: DataFrame, root: str, k: int, pieces: int) -> int:
    """Counts the n-grams of order k and writes level k of the trie; returns the pieces of the level below."""
    spark = texts.sparkSession
    temporary = f"{root}/counts-{k}"

    def count(batches):
        trie = _trie(root)
        for tokens in _buffers(batches):
            walk = Walk(trie, tokens)
            for lower in range(2, k):
                walk.step(lower)
                walk.find(lower)
            walk.step(k)
            times = np.bincount(walk.pair[walk.pair >= 0], minlength=len(walk.parents))
            piece, key = keys_of(trie, k, walk.parents, walk.words)
            order = np.argsort(piece, kind="stable")
            piece, key, times = piece[order], key[order], times[order]
            for p, part in _runs(piece):
                inside = np.argsort(key[part], kind="stable")
                mine = times[part][inside]
                many = np.flatnonzero(mine >= 255)
                few = np.minimum(mine, 255).astype(np.uint8).tobytes()
                raw = [_pack(key[part][inside]), pa.compress(few, codec="zstd", asbytes=True), np.column_stack([many, mine[many]]).astype(np.int64).tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int64()), pa.array([part.stop - part.start], pa.int64()), *(pa.array([r], pa.binary()) for r in raw)],
                    ["file", "n", "keys", "few", "many"],
                )

    def write_grams(table: pa.Table) -> pa.Table:
        p = table["file"][0].as_py()
        trie = _trie(root)
        word_bits = int(trie.first(1)[-1]).bit_length()
        keys, counts = [], []
        for n, packed, few, many in zip(*(table[c].to_pylist() for c in ("n", "keys", "few", "many")), strict=True):
            keys.append(_unpack(packed, n))
            c = np.frombuffer(pa.decompress(few, n, codec="zstd", asbytes=True), np.uint8).astype(np.int64)
            more = np.frombuffer(many, np.int64).reshape(-1, 2)
            c[more[:, 0]] = more[:, 1]
            counts.append(c)
        key, count = np.concatenate(keys), np.concatenate(counts)
        del keys, counts
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, count = key[new], np.add.reduceat(count, new)
        cuts = trie.cuts(k)
        s = int(np.searchsorted(cuts, p, "right") - 1)
        parents = int(trie.first(k - 1)[s + 1] - trie.first(k - 1)[s])
        parent, word = (key >> U(word_bits)).astype(np.int64), key & U((1 << word_bits) - 1)
        start = np.searchsorted(parent, np.arange(parents + 1))
        # the last id of each parent before, summed over parents, is the base of a range
        filled = np.flatnonzero(np.diff(start))
        last = np.zeros(parents, U)
        last[filled] = word[start[filled + 1] - 1]
        base = np.concatenate([np.zeros(1, U), np.cumsum(last)])[:-1]
        arrays = {}
        for name, values in (("pointer", start.astype(U)), ("follower", word + base[parent])):
            arrays |= {f"{name}_{part}": a for part, a in eliasfano.build(values).items()}
        sharedfiles.write(root, f"grams-{k}-{p}", arrays)
        many = np.flatnonzero(count >= 255)
        sharedfiles.write(temporary, f"counts-{p}", {"few": np.minimum(count, 255).astype(np.uint8), "many": many, "times": count[many]})
        # of parents that have several pieces, what each piece knows has to be added
        some = filled if cuts[s + 1] - cuts[s] > 1 else np.zeros(0, np.int64)
        stats = _stats(parent, count, parents) if len(some) else dict.fromkeys(_STATS, some)
        release()
        of = np.bincount(np.minimum(count, 5), minlength=6)[1:5]
        row = {"file": p, "n": len(key), "tokens": int(count.sum()), "of": of.tolist(), "above": s, "at": some.tolist()}
        row |= {name: stats[name][some].tolist() for name in _STATS}
        return pa.Table.from_pylist([row], _FILE)

    def write_parents(table: pa.Table) -> pa.Table:
        s = table["above"][0].as_py()
        first = _trie(root).first(k - 1)
        at = np.asarray(table["at"])
        stats = {}
        for name in _STATS:
            stats[name] = np.zeros(int(first[s + 1] - first[s]), np.int64)
            stats[name][at] = np.asarray(table[name])
        sharedfiles.write(temporary, f"parents-{s}", stats)
        return pa.table({"above": pa.array([s], pa.int64())})

    found = texts.mapInArrow(trimmed(count), "file bigint, n bigint, keys binary, few binary, many binary")
    fields = ", ".join(f"{name} array<bigint>" for name in _STATS)
    made = found.repartition(_width(spark, pieces), "file").groupBy("file").applyInArrow(
        write_grams, f"file bigint, n bigint, tokens bigint, of array<bigint>, above bigint, at array<bigint>, {fields}"
    )
    made = scratch.save(made, "files")
    parts = made.filter("size(at) > 0").select("above", F.explode(F.arrays_zip("at", *_STATS)).alias("x")).select("above", "x.*")
    whole = parts.groupBy("above", "at").agg(*[F.sum(name).alias(name) for name in _STATS])
    whole.groupBy("above").applyInArrow(write_parents, "above bigint").count()
    _, below = _plan(made, root, k, pieces)
    n1, n2, n3, n4 = (float(x or 0) for x in made.agg(*[F.sum(F.get("of", F.lit(i))) for i in range(4)]).first())
    y = n1 / max(1.0, n1 + 2 * n2)
    bound = lambda c, d: float(np.clip(d, 0.05 * c, 0.99 * c))
    discounts = np.array([bound(1, 1 - 2 * y * n2 / max(1.0, n1)), bound(2, 2 - 3 * y * n3 / max(1.0, n2)), bound(3, 3 - 4 * y * n4 / max(1.0, n3))])

    def weigh(batches):
        trie = _trie(root)
        first, cuts = trie.first(k), trie.cuts(k)
        for batch in batches:
            for p, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = Grams(root, k, p).pointers
                start = start.get(np.arange(start.n)).astype(np.int64)
                parent = np.repeat(np.arange(len(start) - 1), np.diff(start))
                counts = sharedfiles.read(temporary, f"counts-{p}")
                count = counts["few"].astype(np.int64)
                count[counts["many"]] = counts["times"]
                split = cuts[s + 1] - cuts[s] > 1
                stats = sharedfiles.read(temporary, f"parents-{s}") if split else _stats(parent, count, len(start) - 1)
                share = (count - discounts[np.minimum(count, 3) - 1]) / stats["total"][parent]
                sharedfiles.write(root, f"probs-{k}-{p}", _quantised(np.log10(share)))
                if first[p] == first[cuts[s]]:  # the first piece of these parents that isn't empty
                    kept = discounts @ np.stack([stats[name] for name in _STATS[1:]])
                    back = np.where(stats["total"] > 0, kept / np.maximum(stats["total"], 1), 1.0)
                    sharedfiles.write(root, f"back-{k - 1}-{s}", _quantised(np.log10(back)))
            release()
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["file"])

    made.select("file", "above").repartition(_width(spark, pieces), "file").mapInArrow(trimmed(weigh), "file bigint").count()
    path = spark._jvm.org.apache.hadoop.fs.Path(temporary)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return below


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score for every row of docs.

    base_score sums the add-one unigram log10 of the tokens, score the model's. Null text is empty,
    its only token the end. Without training documents both scores are those of unknown words. Ids
    pass through, null and repeated ones too; an empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        for batch in batches:
            texts = tk.as_bytes(batch.column(1))
            for lo, hi in tk.chunks(texts, CHUNK):
                tokens, ends = _tokens(texts[lo:hi])
                counts, base, own = model.log_probs(tokens)
                starts = np.concatenate([[0], ends[:-1] + 1])
                sums = [np.add.reduceat(x, starts) for x in ((counts > 0).astype(np.int64), base, own)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array(ends - starts + 1), pa.array(sums[0]),
                        pa.array(np.full(hi - lo, model.tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2]),
                    ],
                    ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        trimmed(score), f"id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
    return out.withColumnRenamed("id", id_col)


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Scores every row of docs by the model of those whose id does not hold them out; adds held_out."""
    model = train(docs.filter(~held_out(id_col)), text_col, order=order)
    out = score_documents(docs, model, id_col, text_col)
    return out.withColumn("held_out", held_out(id_col)).select(id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
