"""MinHash near-duplicate detection with ProbMinHash signatures.

A document is a weighted set of five-word shingles, its weights their counts. Every shingle runs a
Poisson process at the rate of its weight; each arrival falls into a slot drawn for it, and a slot
keeps the shingle that arrived first. Two documents agree in a slot with the probability Jaccard
similarity of their weights. A shingle stops as soon as its next arrival is later than all slots
need, so most run once or twice. All randomness is a hash of the shingle, so reruns agree.

A document with a repeated shingle has a second signature, of the same shingles with all weights 1,
which agrees with that of another document at their plain Jaccard similarity. Without a repeated
shingle the two are one. Signatures are cut into bands; documents that share a band of either are
candidates. A candidate pair is verified on the shingles themselves and linked when its probability Jaccard or its plain Jaccard
similarity is ``threshold`` or more. Classes are the connected components of the links.

Large groups are not expanded into pairs. Texts of the same shingles and counts are one
representative. In each band's bucket every representative is first compared with the bucket's
smallest id, then, where several components are left, with two more leaders. Documents that still
share a bucket but no component are compared in blocks of bounded size, first by the slots that
agree, where the chance to miss a pair at the threshold is under 1e-5, then by their shingles. Pairs
inside a component need no comparison, so no link that could join two classes is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candor.llm import lookups
from candor.llm import textkernel as tk
from candor.llm.components import connected_components
from candor.llm.scratch import Scratch
from candor.llm.workers import bound_batches, release, trimmed

U = np.uint64
ROWS, BANDS = 5, 25
SLOTS = ROWS * BANDS
#: After the smallest id, leaders of buckets that several components share: the ends of two orders.
LEADERS = (F.min, F.max)
#: Documents on each side of a blockwise comparison.
BLOCK = 256


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int) -> np.ndarray:
    """ProbMinHash: for each of ``docs`` documents the element that arrived first in each slot.

    doc, element, weight: one entry for each distinct element of a document. A document without
    elements keeps zeros.
    """
    first = np.full(docs * SLOTS, np.inf)
    winner = np.zeros(docs * SLOTS, U)
    time = np.zeros(len(doc))
    limit = np.full(docs, np.inf)
    active = np.arange(len(doc))
    step = 0
    while len(active):
        step += 1
        r = tk.mix(element[active] + U(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = doc[active] * SLOTS + ((r & U(0xFFFFF)) * U(SLOTS) >> U(20)).astype(np.int64)
        uniform = ((r >> U(20)).astype(np.float64) + 0.5) * 2.0**-44
        arrival = time[active] - np.log(uniform) / weight[active]
        time[active] = arrival
        live = arrival < limit[doc[active]]
        active, place, arrival = active[live], place[live], arrival[live]
        np.minimum.at(first, place, arrival)
        won = arrival == first[place]
        winner[place[won]] = element[active[won]]
        touched = np.unique(doc[active])
        limit[touched] = first.reshape(docs, SLOTS)[touched].max(1)
        active = active[arrival < limit[doc[active]]]
    return winner.reshape(docs, SLOTS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature; the band's number is part of it."""
    part = signature.reshape(len(signature), BANDS, ROWS)
    key = np.tile(np.arange(BANDS, dtype=U), (len(signature), 1))
    for j in range(ROWS):
        key = tk.mix(key * U(0xD6E8FEB86659FD93) + part[:, :, j])
    return key


def similarity(a: np.ndarray, ca: np.ndarray, b: np.ndarray, cb: np.ndarray) -> float:
    """The larger of plain and probability Jaccard of two weighted sets (sorted elements, weights)."""
    if not len(a) or not len(b):
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    plain = len(i) / (len(a) + len(b) - len(i))
    if ca.max() == 1 == cb.max():
        return plain
    x, y = ca[i].astype(np.float64), cb[j].astype(np.float64)
    only_a, only_b = ca.sum() - x.sum(), cb.sum() - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    at_least = np.searchsorted(x / y, x / y, "left")  # elements of a smaller ratio come before
    above = np.append(np.cumsum(x[::-1])[::-1], 0.0)[at_least]
    below = np.concatenate([[0.0], np.cumsum(y)])[at_least]
    return max(plain, float((1 / ((above + only_a) / x + (below + only_b) / y)).sum()))


def _kernels(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(ids, number of texts, doc, shingle, count) of some rows of (id, text) at a time."""
    texts = tk.as_bytes(batch.column(1))
    for lo, hi in tk.chunks(texts):
        words = tk.Words(texts[lo:hi])
        doc, shingle = tk.shingles(words, words.hashes())
        yield (batch.column(0).slice(lo, hi - lo), hi - lo, *tk.distinct(doc, shingle))


def _lists(values: np.ndarray, width: np.ndarray) -> pa.Array:
    """A list for each row of values, of as many of its first values as width says."""
    offsets = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values[np.arange(values.shape[1]) < width[:, None]].view(np.int64)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, n, doc, shingle, count in _kernels(batch):
            signature = signatures(doc, shingle, count.astype(np.float64), n)
            repeats = np.zeros(n, bool)
            repeats[doc[count > 1]] = True
            of = repeats[doc]
            plain = signature.copy()
            plain[repeats] = signatures((np.cumsum(repeats) - 1)[doc[of]], shingle[of], np.ones(of.sum()), int(repeats.sum()))
            keys = np.concatenate([band_keys(signature), band_keys(plain)], axis=1)
            short = [np.ascontiguousarray(tk.mix(x).astype(np.uint8)) for x in (signature, plain)]
            sums = []
            for salt in (0x1234567, 0x89ABCDEF):
                part = np.concatenate([[U(0)], np.cumsum(tk.mix(shingle + count.astype(U) * U(salt << 20 | 1)))])
                edge = np.searchsorted(doc, np.arange(n + 1))
                sums.append(part[edge[1:]] - part[edge[:-1]])
            filled = np.isin(np.arange(n), doc)
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(s.view(np.int64)) for s in sums), _lists(keys, filled * (1 + repeats) * BANDS), pa.array([a.tobytes() + b.tobytes() * bool(r) for a, b, r in zip(*short, repeats, strict=True)], pa.binary())],
                ["id", "d1", "d2", "bands", "sig"],
            )


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, n, doc, shingle, count in _kernels(batch):
            edge = np.searchsorted(doc, np.arange(n + 1))
            cut = list(zip(edge[:-1], edge[1:], strict=True))
            plain = [count[i:j].max(initial=1) == 1 for i, j in cut]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([shingle[i:j].tobytes() for i, j in cut], pa.binary()),
                    pa.array([None if p else count[i:j].astype(np.uint32).tobytes() for (i, j), p in zip(cut, plain, strict=True)], pa.binary()),
                ],
                ["id", "h", "c"],
            )


def _set_of(h: bytes, c: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    elements = np.frombuffer(h, U)
    return elements, np.ones(len(elements), np.uint32) if c is None else np.frombuffer(c, np.uint32)


def _verifier(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, *sets = (x.to_pylist() for x in batch.columns)
            good = [similarity(*_set_of(ha, ca), *_set_of(hb, cb)) >= threshold for ha, ca, hb, cb in zip(*sets, strict=True)]
            table = pa.table({"a": pa.array(a, batch.schema.field(0).type), "b": pa.array(b, batch.schema.field(1).type)})
            yield from table.filter(pa.array(good, pa.bool_())).to_batches()

    return verify


def _blockwise(placed: DataFrame, mixed: DataFrame, signed: DataFrame, sets: DataFrame, threshold: float, kind: str) -> DataFrame:
    """Links between documents that share a bucket but not yet a root, found without listing the pairs.

    Of two such documents at least one is outside the bucket's commonest root. Those outside, in
    blocks of about BLOCK, meet all members, in blocks too. A pair is looked at in the first band,
    and of that band in the smallest key, that it shares; where enough slots of either signature agree,
    it is verified on its shingles.
    """
    cells = mixed.select("key", F.col("top.root").alias("top"), F.ceil(F.col("n") / BLOCK).cast("int").alias("nj"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("ni"))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    rows = placed.join(cells, "key").withColumn("outside", F.col("root") != F.col("top"))
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "id", "root", "outside"]
    left = rows.filter("outside").select(*columns, F.lit(True).alias("left"), block("ni").alias("i"), steps("nj").alias("j"))
    right = rows.select(*columns, F.lit(False).alias("left"), steps("ni").alias("i"), block("nj").alias("j"))
    rows = left.unionByName(right)
    rows = rows.join(signed.select("id", "bands", "sig"), "id").join(sets, "id")
    enough = int(SLOTS * (threshold - 0.2))

    def compare(table: pa.Table) -> pa.Table:
        side = np.asarray(table["left"])
        key = np.int64(table["key"][0].as_py()).view(U)
        ids, roots = table["id"].to_pylist(), table["root"].to_pylist()
        outside = np.asarray(table["outside"])
        # a document without a repeated shingle has one signature for both
        sig = np.frombuffer(b"".join((x * 2)[: 2 * SLOTS] for x in table["sig"].to_pylist()), np.uint8).reshape(-1, 2, SLOTS)
        bands = np.stack([np.asarray((x * 2)[: 2 * BANDS], np.int64) for x in table["bands"].to_pylist()]).view(U).reshape(-1, 2, BANDS)
        at = int(np.flatnonzero(bands[0] == key)[0]) % BANDS
        h, c = table["h"], table["c"]
        set_of = lambda k: _set_of(h[k].as_py(), c[k].as_py())
        parent: dict = {}

        def top(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        right = np.flatnonzero(~side)
        a, b = [], []
        for k in np.flatnonzero(side):
            agree = (sig[right] == sig[k]).sum(2).max(1)
            near, agree = right[agree >= enough], agree[agree >= enough]
            same = bands[near][:, :, None, : at + 1] == bands[k][:, : at + 1]
            same[..., at] &= bands[k][:, at] < key
            first = ~same.any((1, 2, 3))
            near, agree = near[first], agree[first]
            mine = None
            for m in near[np.argsort(-agree, kind="stable")]:
                if (outside[m] and ids[m] > ids[k]) or top(roots[m]) == top(roots[k]):
                    continue
                mine = set_of(int(k)) if mine is None else mine
                if similarity(*mine, *set_of(int(m))) >= threshold:
                    parent[top(roots[k])] = top(roots[m])
                    a.append(ids[k])
                    b.append(ids[m])
        release()
        return pa.table({"a": pa.array(a, table["id"].type), "b": pa.array(b, table["id"].type)})

    return rows.groupBy("key", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, scratch: Scratch | None = None
) -> DataFrame:
    """(id_col, class_id, kept) for every row of docs: the smallest id of its class, and whether it is that id.

    Null text is empty. A text without words is a class of its own; one of fewer than five words is
    one shingle. Rows of one id are one document. Rows without id link with nothing: their class_id
    is null and they are kept. Words are lower-cased (A-Z) runs of anything but ASCII white space.
    An empty table gives an empty table; further columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = scratch or Scratch(spark, "minhash")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = rows.filter("id is not null")
    signed = scratch.save(
        named.mapInArrow(trimmed(_sign), f"id {kind}, d1 bigint, d2 bigint, bands array<bigint>, sig binary").filter("size(bands) > 0"), "signed"
    )
    found = scratch.save(signed.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "digests")
    copies = signed.select("id", "d1", "d2").join(found.filter("n > 1"), ["d1", "d2"]).filter("id <> rep")
    copies = scratch.save(copies.select(F.col("id").alias("a"), F.col("rep").alias("b")), "copies")
    # only representatives go into buckets
    single = signed.join(copies.select(F.col("a").alias("id")), "id", "left_anti")
    buckets = single.select("id", F.explode(F.array_distinct("bands")).alias("key"))
    shared = scratch.save(
        buckets.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi"), "shared"
    )
    members = scratch.save(buckets.join(shared, "key").select("key", "id", "lo", "hi"), "members")
    wanted = members.select("id").distinct()
    sets = scratch.save(
        named.join(wanted, "id", "left_semi").mapInArrow(trimmed(_shingle_rows), f"id {kind}, h binary, c binary"), "sets"
    )

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("h").alias("ha"), F.col("c").alias("ca"))
        right = sets.select(F.col("id").alias("b"), F.col("h").alias("hb"), F.col("c").alias("cb"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "ca", "hb", "cb")
        return scratch.save(both.mapInArrow(trimmed(_verifier(threshold)), f"a {kind}, b {kind}"), "links")

    pairs = scratch.save(members.filter("id <> lo").select(F.col("id").alias("a"), F.col("lo").alias("b")).distinct(), "pairs")
    links = copies.unionByName(verified(pairs))
    classes = connected_components(scratch, links)

    def still_mixed() -> tuple[DataFrame, DataFrame]:
        """Members with their roots, and the buckets of several roots with their sizes and commonest root."""
        root = classes.select(F.col("node").alias("id"), "root")
        placed = scratch.save(members.join(root, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), "placed")
        parts = placed.groupBy("key", "root").agg(F.count("*").alias("n"), *[f(order("id")).alias(f"l{i}") for i, f in enumerate(LEADERS)])
        whole = parts.groupBy("key").agg(
            F.count("*").alias("roots"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"),
            *[f(F.struct(f"l{i}", "root")).alias(f"l{i}") for i, f in enumerate(LEADERS)],
        )
        return placed, scratch.save(whole.filter("roots > 1"), "mixed")

    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    placed, mixed = still_mixed()
    if not mixed.isEmpty():
        lead = F.explode(F.array(*[F.struct(F.col(f"l{i}.l{i}.id").alias("id"), F.col(f"l{i}.root").alias("root")) for i in range(len(LEADERS))]))
        open_ = placed.join(mixed.select("key", lead.alias("lead")), "key").filter("root <> lead.root")
        more = open_.select(F.greatest("id", "lead.id").alias("a"), F.least("id", "lead.id").alias("b")).distinct()
        more = scratch.save(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
        links = links.unionByName(verified(more))
        classes = connected_components(scratch, links)
        placed, mixed = still_mixed()
    if not mixed.isEmpty():
        links = links.unionByName(scratch.save(_blockwise(placed, mixed, signed, sets, threshold, kind), "links"))
        classes = connected_components(scratch, links)
    root = classes.select(F.col("node").alias("id"), "root")
    return (
        docs.select(F.col(id_col).alias("id"))
        .join(root, "id", "left")
        .select(F.col("id").alias(id_col), F.coalesce("root", "id").alias("class_id"), F.coalesce(F.col("root").isNull(), F.lit(True)).alias("kept"))
    )


def kept_documents(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row of docs for each class of near-duplicates, that of its smallest id, with the columns of docs.

    A document is an id with a text: rows that share an id but hold other texts are documents of
    their own, and rows without id are told apart by their texts. Of equal ids with near-duplicate
    texts, and of rows of one document, one stays. Null text is empty; texts without words are no
    near-duplicates of each other. An empty table gives an empty table.
    """
    names = docs.columns
    fresh = [f"__c{i}" for i in range(len(names))]
    renamed = docs.toDF(*fresh)
    id_col, text_col = (F.col(fresh[names.index(n)]) for n in ("doc_id", "text"))
    scratch = Scratch(docs.sparkSession, "dedup")
    unique = docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty()
    if unique:  # the usual case: ids are keys
        rows = renamed.withColumn("__key", id_col)
    else:
        rows = renamed.withColumn("__key", _content_key(id_col, docs.schema["doc_id"].dataType, text_col))
    classes = near_duplicates(rows.select("__key", text_col.alias("__text")), "__key", "__text", threshold, scratch)
    gone = scratch.save(classes.filter("NOT kept").select(F.col("__key").alias("__gone")).distinct(), "gone")
    if lookups.weight(gone) <= lookups.BROADCAST_BYTES:
        gone = F.broadcast(gone)
    rows = rows.join(gone, F.col("__key") == F.col("__gone"), "left_anti")
    if not unique:
        whole = F.struct(*fresh)
        rows = rows.groupBy("__key").agg(F.min_by(whole, F.xxhash64(*fresh)).alias("__row")).select("__row.*")
    return rows.select(*[F.col(f).alias(n) for f, n in zip(fresh, names, strict=True)])


def _content_key(id_col: Column, kind: T.DataType, text_col: Column) -> Column:
    """A string for each id and text, in the order of the ids (numbers by value), null ids last."""
    if isinstance(kind, T.IntegralType):
        order = F.lpad((id_col.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    else:
        order = id_col.cast("string")
    text = F.md5(F.coalesce(text_col, F.lit("")))
    return F.when(id_col.isNull(), F.concat(F.lit("n"), text)).otherwise(F.concat(F.lit("i"), order, F.lit(":"), text))
