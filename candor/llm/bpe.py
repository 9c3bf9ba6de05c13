"""BPE encoding and decoding with a contiguous array of part boundaries and adjacent ranks.

A word starts as one part for each byte. One list holds the parts' tokens, a second, as long, the
rank of the merge of each part with its right neighbour. The smallest rank is found by scanning the
list, the boundary between its two parts is deleted from both lists, and the ranks to its left and
right are looked up again. Over the few parts of a word the scan beats any queue; a word of more
than ``SHORT`` parts takes the same merges from a heap over a linked list, so time stays in
proportion to its length.

The tokenizer file's normaliser and word pattern are applied here too (NFC, white space to blanks,
lower case by character, then runs of letters, single numbers, runs of other signs); words of
characters on which the Unicode tables of this Python and of the file's own library may differ take
that library's normaliser and splitter, and the merges below in any case.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.workers import bound_batches, trimmed

SHORT = 64
#: Characters whose class, case and composition every Unicode version since 5 gives alike.
_SETTLED = (
    "\x00-\u0250\u0370-\u03ff\u0400-\u0482\u048a-\u0523\u1e00-\u1eff\u2010-\u2027\u2030-\u205e\u20ac"
    "\u2100-\u214e\u3001-\u3003\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
)
#: Words kept with their tokens in each of two generations, so memory is bounded and frequent words stay.
CACHE = 150_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in own}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return [out[b] for b in range(256)]


class Bpe:
    """A tokenizer read from a JSON file of vocabulary and merges with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.token = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        ids = self.vocab
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        chars = byte_characters()
        self.byte_id = [ids[c] for c in chars]
        self.last_id = [ids[c + self.suffix] for c in chars]
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.odd = re.compile(f"[^{_SETTLED}]")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.new: dict[str, tuple[str, str, int]] = {}
        self.old: dict[str, tuple[str, str, int]] = {}
        self._library = None

    def word_ids(self, word: str) -> list[int]:
        raw = word.encode()
        parts = [self.byte_id[b] for b in raw]
        parts[-1] = self.last_id[raw[-1]]
        return self._merge_short(parts) if len(parts) <= SHORT else self._merge_long(parts)

    def _merge_short(self, parts: list[int]) -> list[int]:
        get, none = self.merges.get, (1 << 60, -1)
        ranks = [get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best is none or best[0] == none[0]:
                break
            i = ranks.index(best)
            parts[i] = best[1]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def look(i: int) -> None:
            j = right[i]
            if j < n and (m := self.merges.get((parts[i], parts[j]))):
                heapq.heappush(heap, (m[0], i, parts[i], parts[j], m[1]))

        for i in range(n):
            look(i)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            if parts[i] != a or right[i] >= n or parts[j := right[i]] != b:
                continue
            parts[i], parts[j] = to, -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            look(i)
            if left[i] >= 0:
                look(left[i])
        return [p for p in parts if p >= 0]

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii():
            return self.words.findall(text.lower())
        if self.odd.search(text):
            return self._library_words(text)
        text = unicodedata.normalize("NFC", text)
        return self.words.findall(text.replace("Σ", "σ").lower())

    def _library_words(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        back = {c: b for b, c in enumerate(byte_characters())}
        pieces = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(back[c] for c in p).decode() for p, _ in pieces]

    def entry(self, word: str) -> tuple[str, str, int]:
        """(ids joined by blanks, tokens joined by blanks, number of tokens) of a word."""
        found = self.old.get(word)
        if found is None:
            ids = self.word_ids(word)
            found = (" ".join(map(str, ids)), " ".join([self.token[i] for i in ids]), len(ids))
        if len(word) <= SHORT:
            if len(self.new) >= CACHE:
                self.old, self.new = self.new, {}
            self.new[word] = found
        return found

    def encoded(self, text: str) -> tuple[str, str, int]:
        """(ids joined by blanks, decoded text, number of tokens) of a text."""
        rows: list[tuple[str, str, int]] = []
        parts = self.cut.split(text) if self.cut and "<|" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                rows.append((str(self.special[part]), part, 1))
            elif part:
                for w in self.split(part):
                    try:
                        rows.append(self.new[w])
                    except KeyError:
                        rows.append(self.entry(w))
        if not rows:
            return "", "", 0
        ids, tokens, counts = zip(*rows, strict=True)
        return " ".join(ids), " ".join(tokens), sum(counts)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encoded(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The ids' tokens joined by blanks, special ones too; ids outside the vocabulary are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(texts: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, so that what is held in Python stays small."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def encode_documents(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """A row for each row of docs: its id, n_tokens, ids_sha256, decoded_sha256, and with_ids its ids.

    ids_sha256 is over the decimal ids joined by one blank, decoded_sha256 over the decoded text.
    Null text is empty and has no tokens. Ids pass through, null and repeated ones too; an empty table
    gives an empty table; further columns are ignored. The file at path is read on the executors.
    """
    bound_batches(docs.sparkSession)
    path = path or default_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for lo, hi in _pieces(batch.column(1)):
                n, a, b, every = [], [], [], []
                for text in batch.column(1).slice(lo, hi - lo).to_pylist():
                    ids, decoded, count = bpe.encoded(text or "")
                    n.append(count)
                    a.append(sha(ids))
                    b.append(sha(decoded))
                    if with_ids:
                        every.append(np.fromstring(ids, np.int32, sep=" ") if ids else np.zeros(0, np.int32))
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in every])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(every))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(trimmed(encode), schema).withColumnRenamed("id", id_col)
