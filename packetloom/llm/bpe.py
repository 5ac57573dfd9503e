"""Byte-level BPE encoding and decoding (operator 8).

A pre-token's bytes are a doubly linked list of symbols; a priority queue holds the merges of neighbours by rank, then
place. An entry whose symbols have changed since it was queued is stale and skipped. Decoding concatenates the byte
strings of the vocabulary. Each distinct pre-token a task meets is merged once while it stays in a bounded table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from . import text as tx

#: The white space of the public byte-level pattern, and the pattern itself.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Marks that end a run of letters and are a pre-token of their own at a chunk's end.
_MARKS = frozenset(".,;:!?)]}\"")
#: A space in white space on both sides, or two spaces: there chunks between single spaces aren't independent.
_TWO_SPACES = re.compile(rf"  |[{SPACE}] [{SPACE}]")
#: Letters and numbers of a newer Unicode than the public tokenizer's, which it takes as unassigned.
NEWER = (
    (0x558, 0x558), (0x58b, 0x58c), (0x88f, 0x88f), (0xc5c, 0xc5c), (0xcdc, 0xcdc), (0x208f, 0x208f), (0x209d, 0x209f), (0xa7ce, 0xa7cf),
    (0xa7d2, 0xa7d2), (0xa7d4, 0xa7d4), (0xa7dd, 0xa7dd), (0xa7e2, 0xa7e2), (0xa7f1, 0xa7f1), (0xab6c, 0xab6d), (0x107bb, 0x107bf),
    (0x10940, 0x10959), (0x10ec5, 0x10ec7), (0x10ed9, 0x10eee), (0x11b0a, 0x11b0a), (0x11db0, 0x11ddb), (0x11de0, 0x11de9), (0x11df1, 0x11df1),
    (0x1246f, 0x1246f), (0x12475, 0x1247f), (0x12550, 0x12686), (0x16ea0, 0x16eb8), (0x16ebb, 0x16ed3), (0x16ff2, 0x16ff6), (0x187f8, 0x187ff),
    (0x18cd6, 0x18cda), (0x18d09, 0x18d20), (0x18d80, 0x18df2), (0x18e00, 0x19191), (0x191a0, 0x191d2), (0x1b123, 0x1b128), (0x1b168, 0x1b168),
    (0x1d6a6, 0x1d6a6), (0x1df1f, 0x1df24), (0x1df2b, 0x1df81), (0x1df90, 0x1df96), (0x1dfcd, 0x1dfff), (0x1e6c0, 0x1e6de), (0x1e6e0, 0x1e6e2),
    (0x1e6e4, 0x1e6e5), (0x1e6e7, 0x1e6ed), (0x1e6f0, 0x1e6f4), (0x1e6fe, 0x1e6ff), (0x2b73a, 0x2b73f), (0x2b81e, 0x2b81e), (0x2cea2, 0x2cead),
    (0x323b0, 0x33479), (0x3d000, 0x3fc3f),
)
_NEWER = re.compile("[" + "".join(f"{chr(a)}-{chr(z)}" for a, z in NEWER) + "]")
_UNASSIGNED = "\u0378"

_loaded: dict[bytes, ByteBpe] = {}


def loaded(source: bytes) -> ByteBpe:
    """The tokenizer of a file's bytes, kept while the worker lives."""
    key = hashlib.sha256(source).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBpe(source)
    return _loaded[key]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe(dict):
    """A byte-level BPE tokenizer read from tokenizers' JSON; as a dict, the ids of what it has met after single spaces."""

    def __init__(self, source: str | bytes, room: int = 1 << 17):
        super().__init__()
        spec = json.loads(source)
        model, self.room = spec["model"], room
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without normalizer, prefix space or ignored merges is read here")
        letters = byte_letters()
        self.vocabulary = {i: bytes(map(letters.__getitem__, t)) for t, i in model["vocab"].items()}
        ids = model["vocab"]
        self.first = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: By left id, the rank of each right id it merges with; and what each rank's merge makes.
        self.ranks: list[dict[int, int]] = [{}] * (max(ids.values()) + 1)
        for rank, (a, b) in reversed([*enumerate(pairs)]):
            self.ranks[ids[a]] = own = self.ranks[ids[a]] or {}
            own[ids[b]] = rank
        self.made = [ids[a + b] for a, b in pairs]
        self.special = {}
        for t in spec.get("added_tokens", ()):
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("added tokens that strip or need word ends are not read here")
            self.special[t["content"]] = t["id"]
            self.vocabulary[t["id"]] = t["content"].encode()
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        #: Pre-tokens met; of these and of the chunks, those of the time before the table last was full wait in old ones.
        self.words: dict[str, tuple[int, ...]] = {}
        self.old_words: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        """The ids of a space and the chunk after it."""
        ids = self.old.pop(chunk, None)
        if ids is None:
            if chunk.isalpha():
                ids = self.merge((" " + chunk).encode())
            elif chunk[-1:] in _MARKS and chunk[:-1].isalpha():
                ids = self[chunk[:-1]] + self.word(chunk[-1])
            else:
                ids = (*chain.from_iterable(map(self.word, self.pre_tokens(" " + chunk))),)
        if len(chunk) <= 32:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def word(self, pre: str) -> tuple[int, ...]:
        """The ids of a pre-token."""
        ids = self.words.get(pre)
        if ids is None:
            ids = self.old_words.pop(pre, None) or self.merge(pre.encode())
            if len(pre) <= 32:
                if len(self.words) >= self.room:
                    self.old_words, self.words = self.words, {}
                self.words[pre] = ids
        return ids

    def pre_tokens(self, text: str) -> list[str]:
        if _NEWER.search(text) is None:
            return self.pattern.findall(text)
        known = _NEWER.sub(_UNASSIGNED, text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(known)]

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The ids of one pre-token's bytes."""
        ranks, first = self.ranks, self.first
        symbols = [first[b] for b in data]
        n = len(symbols)
        shift = n.bit_length()
        mask = (1 << shift) - 1
        queue = []
        for i in range(n - 1):
            if (r := ranks[symbols[i]].get(symbols[i + 1])) is not None:
                queue.append(r << shift | i)
        if not queue:
            return tuple(symbols)
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        left, right = [*range(-1, n - 1)], [*range(1, n), -1]
        while queue:
            top = pop(queue)
            i, rank = top & mask, top >> shift
            j, a = right[i], symbols[i]
            if a < 0 or j < 0 or ranks[a].get(symbols[j]) != rank:
                continue  # stale
            symbols[i] = new = self.made[rank]
            symbols[j] = -1
            right[i] = after = right[j]
            own = ranks[new]
            if after >= 0:
                left[after] = i
                if (r := own.get(symbols[after])) is not None:
                    push(queue, r << shift | i)
            before = left[i]
            if before >= 0 and (r := ranks[symbols[before]].get(new)) is not None:
                push(queue, r << shift | before)
        return tuple([s for s in symbols if s >= 0])

    def encode(self, text: str) -> list[int]:
        """Ids of a text; strings of added tokens are those tokens."""
        if self.split is None or not any(s in text for s in self.special):
            return self.plain(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self.plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.plain(text[at:])

    def plain(self, text: str) -> list[int]:
        """Ids of a text without added tokens. Pre-tokens begin at a single space, so chunks between such are taken apart once."""
        if _TWO_SPACES.search(text):
            return [*chain.from_iterable(map(self.word, self.pre_tokens(text)))]
        first, *chunks = text.split(" ")
        return [*chain(chain.from_iterable(map(self.word, self.pre_tokens(first))), chain.from_iterable(map(self.__getitem__, chunks)))]

    def decode(self, ids) -> str:
        """The text of ids, added tokens included; bytes that are no UTF-8 become U+FFFD. Unknown ids give nothing."""
        try:
            return b"".join(map(self.vocabulary.__getitem__, ids)).decode("utf-8", "replace")
        except KeyError:
            return b"".join([self.vocabulary.get(i, b"") for i in ids]).decode("utf-8", "replace")


def _ids_column(lists: list[list[int]]) -> pa.Array:
    sizes = np.fromiter(map(len, lists), np.int32, len(lists))
    values = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
    return pa.ListArray.from_arrays(np.append(0, sizes.cumsum()).astype(np.int32), values)


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    with open(path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        tokenizer = loaded(shared.value)
        for batch in batches:
            _, offsets = tx.buffers(batch.column(1))
            for low, high in tx.chunks(offsets):
                lists = [tokenizer.encode(t) if t else [] for t in batch.column(1).slice(low, high - low).to_pylist()]
                out = {"id": batch.column(0).slice(low, high - low), "ids": _ids_column(lists)}
                if decoded:
                    out["decoded"] = pa.array([tokenizer.decode(x) for x in lists], pa.string())
                yield pa.record_batch(out)

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {source.schema[0].dataType.simpleString()}, ids array<int>" + ", decoded string" * decoded
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, ids) for each row of docs: the token ids of the whole text.

    Ids equal the tokenizers library's with add_special_tokens=False. Null and empty texts have no ids. Rows may repeat,
    ids of documents may be null or tied: each row is encoded by itself. No rows give no rows; other columns are ignored.
    The tokenizer file (read on the driver, up to a few MB) is broadcast; documents are neither shuffled nor kept.
    """
    return _run(docs, path, id_col, text_col, decoded=False)


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode(), and what its ids decode to, as (id_col, ids, decoded). Same cases; decoded is empty where ids are."""
    return _run(docs, path, id_col, text_col, decoded=True)


def decode(tokens: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row (id_col, decoded) for each row of tokens. Null or no ids decode to an empty text; null ids in a list to nothing."""
    with open(path, "rb") as f:
        shared = tokens.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        tokenizer = loaded(shared.value)
        for batch in batches:
            yield pa.record_batch({"id": batch.column(0), "decoded": pa.array([tokenizer.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())})

    source = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return source.mapInArrow(run, f"id {source.schema[0].dataType.simpleString()}, decoded string").withColumnRenamed("id", id_col)
