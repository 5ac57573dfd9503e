"""Token counts by the whole-token shortcut (operator 4).

A SentencePiece BPE model without pieces that hold a space mark after another character can't merge across the start
of a run of spaces, so a text's count is the sum over its pre-tokens (a run of spaces and what follows it). Offline,
before any text is seen, every vocabulary string that starts with one space mark is encoded alone: those that come back
as one token are whole-token strings. A pre-token among them counts 1 without further work; only the rest is merged (by
the library's encoder), once for each distinct pre-token a task meets while it stays in a table of bounded entries and
bytes. Long ones, as whole texts without spaces are, are merged where they occur and not held.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from . import text as tx

#: The mark that SentencePiece writes for a space.
MARK = "▁"
_RUNS = re.compile(" +[^ ]*")
#: Characters of the longest pre-token that a table holds.
LONGEST = 32


def whole_tokens(model: sentencepiece.SentencePieceProcessor) -> set[str]:
    """What may follow a space so that space and it are always exactly one token, proved by encoding each alone."""
    size = model.get_piece_size()
    odd = [i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)]
    skip = set(odd)
    pieces = [(i, model.id_to_piece(i)) for i in range(size) if i not in skip]
    if crossing := [p for _, p in pieces if MARK in p.lstrip(MARK)]:
        raise ValueError(f"pieces span words, so words can't be counted one by one: {crossing[:3]}")
    if model.encode("a  b", out_type=str)[0][:1] != MARK or "".join(model.encode(" a  b ", out_type=str)) != MARK + " a  b ".replace(" ", MARK):
        raise ValueError("the model must put a space mark first and keep all spaces")
    starts = [(i, p[1:]) for i, p in pieces if p[0] == MARK and p[1:] and MARK not in p[1:]]
    alone = model.encode([p for _, p in starts], num_threads=1)
    return {p for (i, p), ids in zip(starts, alone, strict=True) if ids == [i]}


class PreTokens(dict):
    """Tokens of each pre-token, without the first of its spaces. Holds the whole tokens for good and others while there is room."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor, whole: set[str], room: int):
        super().__init__(dict.fromkeys(whole, 1))
        self.model, self.whole, self.room = model, whole, room
        self.old: dict[str, int] = {}
        self.long: dict[str, int] = {}

    def __missing__(self, key: str) -> int:
        return self.long[key]

    def learn(self, found: set[str]) -> None:
        """Merge the pre-tokens that aren't held yet, all at once; the long ones are known until the next call."""
        self.long = self._merged([p for p in found if len(p) > LONGEST and p not in self])
        found = {p for p in found if len(p) <= LONGEST}
        if len(self) + len(found) > self.room + len(self.whole):
            self._renew({p: n for p, n in self.items() if p not in self.whole})
        new = found - self.keys()
        again = new & self.old.keys()
        self.update((p, self.old[p]) for p in again)
        self.update(self._merged([*(new - again)]))

    def _merged(self, new: list[str]) -> dict[str, int]:
        """Tokens of each of some pre-tokens."""
        # spaces at the end of a text, which the library takes only after something else
        out = {p: len(self.model.encode("a " + p)) - len(self.model.encode("a")) for p in new if not p.strip(" ")}
        new = [p for p in new if p not in out]
        out.update(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True))
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        parts = []
        for text in texts:
            if MARK in text:
                text = text.replace(MARK, " ")
            if "  " in text or text[:1] == " " or text[-1:] == " ":
                parts.append([x[1:] for x in _RUNS.findall(" " + text)])
            else:
                parts.append(text.split(" ") if text else [])
        self.learn(set().union(*parts))
        sums = [sum(map(self.__getitem__, p)) for p in parts]
        if len(self) > self.room + len(self.whole):  # one long text of many pre-tokens
            self._renew({})
        return sums

    def _renew(self, old: dict[str, int]) -> None:
        self.old = old
        self.clear()
        self.update(dict.fromkeys(self.whole, 1))


_loaded: dict[bytes, PreTokens] = {}


def loaded(proto: bytes, room: int) -> PreTokens:
    """The table of a model's bytes, kept while the worker lives."""
    key = hashlib.sha256(proto).digest()
    if key not in _loaded:
        _loaded.clear()
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        _loaded[key] = PreTokens(model, whole_tokens(model), room)
    return _loaded[key]


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", room: int = 1 << 18) -> DataFrame:
    """One row (id_col, n_bytes, n_tokens) for each row of docs: UTF-8 bytes and tokens of the whole text.

    Counts equal the library's, without begin, end or added special tokens; strings of control symbols are plain text.
    Null and empty texts have 0 of either. Rows may repeat, ids may be null or tied: each row is counted by itself. No
    rows give no rows; other columns are ignored. The model file (read on the driver, up to a few MB) is broadcast;
    room bounds the entries a task keeps, each of LONGEST characters at most. Documents are neither shuffled nor kept.
    """
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        table = loaded(shared.value, room)
        for batch in batches:
            _, offsets = tx.buffers(batch.column(1))
            for low, high in tx.chunks(offsets):
                texts = batch.column(1).slice(low, high - low).fill_null("").to_pylist()
                sizes = offsets[low + 1 : high + 1] - offsets[low:high]
                yield pa.record_batch({"id": batch.column(0).slice(low, high - low), "n_bytes": pa.array(sizes), "n_tokens": pa.array(table.counts(texts), pa.int64())})

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
