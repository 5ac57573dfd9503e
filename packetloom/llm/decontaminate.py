"""Benchmark decontamination by a prefix-filtered set join (operator 1).

A benchmark item is cut into windows of 13 consecutive words. Seen as a set of word shingles, a window is contained in
a document only if its rarest shingle is, so one shingle of each window (the prefix a containment of 1 makes necessary)
is enough to join on. Rarity is counted over the whole corpus in a first pass. In the second pass documents probe the
prefix index; a match fixes where the window would have to lie, its length and position must fit the document
(length and positional bounds), and what is left is verified word by word.

The index is broadcast in blocks whose bytes are measured and bounded; long items are cut into pieces that overlap by
twelve words, which have the same windows. More of a benchmark means more passes over the documents, not a larger
broadcast. Documents are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as tx
from .jobs import cut

WINDOW = 13
SHINGLE = 3
_BITS = 22

#: What the operator returns besides the id: counts, hit word ranges, items found.
SCHEMA = "n_words long, n_hit long, hit_spans array<struct<start:long,end:long>>, items array<string>"


@dataclass
class Index:
    """Windows of one block of items. Window w holds words `words[at[w] : at[w] + size[w]]`, and its owners are
    `owners[owner_at[w] : owner_at[w + 1]]`, numbers of items in `names`."""

    words: list[bytes]
    hashes: np.ndarray
    at: np.ndarray
    size: np.ndarray
    owners: np.ndarray
    owner_at: np.ndarray
    names: list[str]
    #: Per number of words of a shingle: sorted shingle hashes, where each one's windows begin, window and offset.
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] | None = None

    def shingles(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per shingle length: the window, offset and hash of every shingle of every window."""
        out = {}
        for q in sorted({min(SHINGLE, int(s)) for s in np.unique(self.size)}):
            rolled = tx.rolling(self.hashes, q)
            mine = np.flatnonzero(np.minimum(self.size, SHINGLE) == q)
            many = self.size[mine] - q + 1
            window = np.repeat(mine, many)
            offset = np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many)
            out[q] = window, offset, rolled[self.at[window] + offset]
        return out


def build(items: list[tuple[str, str]]) -> Index:
    """The distinct windows of (item id, text) pairs."""
    data, offsets = tx.buffers(pa.array([text for _, text in items], pa.large_string()))
    found = tx.Words(data, offsets, tx.ALNUM)
    hashes, words = found.hashes(), found.words(0, len(found.starts))
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    seen: dict[tuple[bytes, ...], int] = {}
    at, size, owners = [], [], []
    for (name, _), low, high in zip(items, found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
        n = min(WINDOW, high - low)
        for start in range(low, high - n + 1) if n else ():
            w = seen.setdefault(tuple(words[start : start + n]), len(seen))
            if w == len(at):
                at.append(start)
                size.append(n)
                owners.append(set())
            owners[w].add(number[name])
    counts = np.array([0, *map(len, owners)])
    return Index(words, hashes, np.array(at, np.int64), np.array(size, np.int64), np.array([o for s in owners for o in sorted(s)], np.int64), counts.cumsum(), names)


def with_prefixes(index: Index, counts: dict[int, int]) -> Index:
    """The index with each window's rarest shingle as its prefix; ties go to the smaller hash, then the first place."""
    index.prefix = {}
    for q, (window, offset, hashes) in index.shingles().items():
        often = np.array([counts.get(int(h), 0) for h in hashes.view(np.int64)], np.int64)
        order = np.lexsort((offset, hashes, often, window))
        first = order[np.flatnonzero(np.diff(window[order], prepend=-1))]
        first = first[np.argsort(hashes[first], kind="stable")]
        keys, begin = np.unique(hashes[first], return_index=True)
        index.prefix[q] = keys, np.append(begin, len(first)), window[first], offset[first]
    return index


def _probe(rolled: np.ndarray, keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of rolled whose hash is among the sorted keys, and which key each is."""
    near = np.flatnonzero(table[(rolled & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
    key = np.minimum(keys.searchsorted(rolled[near]), len(keys) - 1)
    same = keys[key] == rolled[near]
    return near[same], key[same]


def _table(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << _BITS, dtype=bool)
    table[(keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True
    return table


def _count(documents: DataFrame, keys: dict[int, np.ndarray]) -> DataFrame:
    """How often each of the given shingle hashes occurs in all documents: (hash, n), summed in each task first."""
    shared = documents.sparkSession.sparkContext.broadcast(keys)

    def run(batches):
        keys = shared.value
        tables = {q: _table(k) for q, k in keys.items()}
        sums = {q: np.zeros(len(k), np.int64) for q, k in keys.items()}
        for batch in batches:
            data, offsets = tx.buffers(batch.column(1))
            for low, high in tx.chunks(offsets):
                words = tx.Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], tx.ALNUM)
                hashes = words.hashes()
                for q in keys:
                    _, key = _probe(tx.rolling(hashes, q), keys[q], tables[q])
                    sums[q] += np.bincount(key, minlength=len(keys[q]))
        for q in keys:
            some = np.flatnonzero(sums[q])
            yield pa.record_batch({"hash": pa.array(keys[q][some].view(np.int64)), "n": pa.array(sums[q][some])})

    return documents.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _matches(words: tx.Words, hashes: np.ndarray, index: Index, tables: dict) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window within one text."""
    starts, windows = [], []
    for q, (keys, begin, window, offset) in index.prefix.items():
        at, key = _probe(tx.rolling(hashes, q), keys, tables[q])
        if not len(at):
            continue
        many = begin[key + 1] - begin[key]
        entry = np.repeat(begin[key], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at, w, k = np.repeat(at, many), window[entry], offset[entry]
        doc = np.searchsorted(words.bounds, at, side="right") - 1
        start = at - k
        fits = (start >= words.bounds[doc]) & (start + index.size[w] <= words.bounds[doc + 1])
        start, w = start[fits], w[fits]
        good = np.ones(len(start), dtype=bool)
        for j in range(int(index.size[w].max()) if len(w) else 0):
            inside = np.flatnonzero(good & (index.size[w] > j))
            good[inside] = hashes[start[inside] + j] == index.hashes[index.at[w[inside]] + j]
        starts.append(start[good])
        windows.append(w[good])
    if not any(map(len, starts)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, w = np.concatenate(starts), np.concatenate(windows)
    # Runs of windows that lie alike in item and text are compared once, by their bytes.
    order = np.lexsort((start, index.at[w] - start))
    start, w = start[order], w[order]
    end = start + index.size[w]
    fresh = np.append(True, (np.diff(index.at[w] - start) != 0) | (start[1:] > end[:-1])) if len(w) else np.zeros(0, bool)
    heads = np.flatnonzero(fresh)
    sound = np.ones(len(w), dtype=bool)
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(w)], strict=True):
        low, high, item = int(start[a]), int(end[b - 1]), int(index.at[w[a]])
        if words.words(low, high) != index.words[item : item + high - low]:
            for i in range(a, b):
                low, item, n = int(start[i]), int(index.at[w[i]]), int(index.size[w[i]])
                sound[i] = words.words(low, low + n) == index.words[item : item + n]
    return start[sound], w[sound]


def _find(documents: DataFrame, index: Index, only_hits: bool, carried: tuple[str, ...] = ()) -> DataFrame:
    """id, key and SCHEMA of every document, or of those with hits, and its columns named in carried. key tells apart rows that share an id."""
    shared = documents.sparkSession.sparkContext.broadcast(index)
    places = {c: documents.columns.index(c) for c in carried}
    empty = pa.array([], pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        index = shared.value
        tables = {q: _table(x[0]) for q, x in index.prefix.items()}
        for batch in batches:
            data, offsets = tx.buffers(batch.column(1))
            for low, high in tx.chunks(offsets):
                part = batch.slice(low, high - low)
                words = tx.Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], tx.ALNUM)
                start, w = _matches(words, words.hashes(), index, tables)
                yield result(part, words, start, w, index)

    def result(part, words, start, w, index):
        n = part.num_rows
        depth = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(depth, start, 1)
        np.add.at(depth, start + index.size[w], -1)
        hit = depth.cumsum()[:-1] > 0
        total = np.append(0, hit.cumsum())
        n_hit = total[words.bounds[1:]] - total[words.bounds[:-1]]
        spans, items = [[] for _ in range(n)], [[] for _ in range(n)]
        if len(start):
            ends_text = np.zeros(len(hit), dtype=bool)
            ends_text[words.bounds[1:][words.bounds[1:] > 0] - 1] = True
            begins = np.flatnonzero(hit & ~np.append(False, hit[:-1] & ~ends_text[:-1]))
            ends = np.flatnonzero(hit & (ends_text | ~np.append(hit[1:], False))) + 1
            doc = np.searchsorted(words.bounds, begins, side="right") - 1
            for d, a, b in zip(doc.tolist(), (begins - words.bounds[doc]).tolist(), (ends - words.bounds[doc]).tolist(), strict=True):
                spans[d].append({"start": a, "end": b})
            many = index.owner_at[w + 1] - index.owner_at[w]
            owner = index.owners[np.repeat(index.owner_at[w], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
            doc = np.repeat(np.searchsorted(words.bounds, start, side="right") - 1, many)
            for pair in np.unique(doc * len(index.names) + owner).tolist():
                items[pair // len(index.names)].append(index.names[pair % len(index.names)])
        out = pa.record_batch(
            {
                "id": part.column(0), "key": part.column(2), **{c: part.column(i) for c, i in places.items()}, "n_words": pa.array(np.diff(words.bounds).astype(np.int64)), "n_hit": pa.array(n_hit.astype(np.int64)),
                "hit_spans": pa.array(spans, pa.list_(empty.type)), "items": pa.array(items, pa.list_(pa.string())),
            }
        )
        return out.filter(pa.array(n_hit > 0)) if only_hits else out

    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in (documents.schema[c] for c in carried))
    return documents.mapInArrow(run, f"id {documents.schema[0].dataType.simpleString()}, key long{more}, {SCHEMA}")


def _pieces(items: DataFrame, most_bytes: int) -> DataFrame:
    """The items, with texts of more than about most_bytes cut at words into pieces that together have the same windows."""
    long = F.octet_length("text") > most_bytes
    cut = items.where(long).withColumn("w", F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
    size = F.greatest(F.lit(4 * WINDOW), F.floor(F.size("w") * (most_bytes / F.octet_length("text")))).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)), F.col("n") - (WINDOW - 1))
    cut = cut.withColumn("n", size).select("item", "w", "n", F.explode(starts).alias("at"))
    return items.where(~long).union(cut.select("item", F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("text")))


def _blocks(items: DataFrame, most_bytes: int) -> list[DataFrame]:
    """The items dealt into blocks of at most most_bytes of text (of pieces of an eighth), by buckets of a hash packed by size."""
    # pieces of an item that say the same have the same windows; once each is told apart, buckets can always be split
    pieces, n = cut(_pieces(items, max(most_bytes // 8, 1)).distinct()), 1
    while True:
        dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
        # at most n rows; a bucket that is too large is dealt anew unless it is a single piece, one endless word
        sizes = [tuple(r) for r in dealt.groupBy("bucket").agg(F.sum(F.octet_length("text")), F.count("*")).collect()]
        if all(b <= most_bytes and (n == 1 or 8 * b <= most_bytes) or many == 1 for _, b, many in sizes):
            break
        n = max(16 * n, 1 << (16 * sum(b for _, b, _ in sizes) // most_bytes).bit_length())
    block, held = {}, []
    for bucket, size, _ in sorted(sizes, key=lambda x: (-x[1], x[0])):
        k = next((k for k, h in enumerate(held) if h + size <= most_bytes), len(held))
        held[k:] = held[k:] or [0]
        held[k] += size
        block[bucket] = k
    return [dealt.where(F.col("bucket").isin([x for x, y in block.items() if y == k])).drop("bucket") for k in range(max(len(held), 1))]


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 4 << 20, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row (id_col, n_words, n_hit, hit_spans, items) for each row of documents; columns named in carry follow.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and of anything beyond ASCII. A word is hit if it lies
    in an occurrence of a window of some item; hit_spans are maximal ranges of hit words, items the sorted distinct ids
    (as strings) of items with occurring windows. An item of fewer than 13 words is one window; of none, no window.

    Null or empty texts have no words and no hits. Items with a null id are left out; items that share an id count as one.
    Rows of documents may repeat or share ids, and ids may be null: each row gets its own result. An empty benchmark
    hits nothing; no documents give no rows. Other columns are ignored. Texts of any length are read whole.
    block_bytes bounds the item texts of one broadcast block, whatever the items' sizes; only a single word may exceed it.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null").distinct()
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col, id_col).alias("key"), *[F.col(c).alias(f"_{c}") for c in carry if c != text_col])
    # the text goes to the workers once, whether it comes back or not
    names = {c: "text" if c == text_col else f"_{c}" for c in carry}
    parts = []
    slim = docs.select("id", "text", "key")
    for k, block in enumerate(_blocks(items, block_bytes)):
        index = build([tuple(r) for r in block.collect()])  # bounded by block_bytes
        keys = {q: np.unique(x[2]) for q, x in index.shingles().items()}
        counts = {r["hash"]: r["n"] for r in _count(slim, keys).collect()} if keys else {}  # no more than the block's shingles
        parts.append(_find(slim if k else docs, with_prefixes(index, counts), only_hits=k > 0, carried=() if k else tuple(names.values())))
    first, *rest = parts
    if rest:
        more = rest[0].withColumn("block", F.lit(1))
        for k, part in enumerate(rest[1:], 2):
            more = more.union(part.withColumn("block", F.lit(k)))
        # rows that repeat have the same hits, so that one of each is merged
        merged = more.dropDuplicates(["id", "key", "block"]).groupBy("id", "key").agg(F.array_distinct(F.flatten(F.collect_list("hit_spans"))).alias("s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("i"))
        merged = merged.withColumnsRenamed({"id": "id2", "key": "key2"})
        joined = first.join(merged, first.id.eqNullSafe(merged.id2) & (first.key == merged.key2), "left")
        none = F.array()
        spans = F.array_sort(F.concat("hit_spans", F.coalesce("s", none.cast("array<struct<start:bigint,end:bigint>>"))))
        joined = joined.withColumn("hit_spans", _merged(spans)).withColumn("items", F.array_sort(F.array_union("items", F.coalesce("i", none.cast("array<string>")))))
        first = joined.withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]))
    return first.select(F.col("id").alias(id_col), "n_words", "n_hit", "hit_spans", F.array_sort("items").alias("items"), *[F.col(x).alias(c) for c, x in names.items()])


def _merged(spans):
    """Sorted spans with overlapping and touching ones made one."""
    kind = "array<struct<start:bigint,end:bigint>>"

    def step(done, x):
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(-1)) >= x["start"])
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when(joins, grown).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, F.array().cast(kind), step)
