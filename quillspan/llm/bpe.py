"""Byte-level BPE encoding and decoding by a pair occurrence index.

The texts of a task are cut into words by the tokenizer's pattern. The distinct words of a block (a bounded number of
bytes of whole texts) are laid end to end as byte symbols. An index maps each pair's rank to the positions where the
pair stands. Active ranks are applied in ascending order, each to all its positions at once; the neighbours' new pairs
join the lists of their ranks, which are always later than the rank at work.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillspan.llm import bytekernel as bk
from quillspan.llm.shared import extended

NONE = np.int32(2**31 - 1)

# The word pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def printable_bytes() -> dict[str, int]:
    """The stand-in character of each byte in a byte-level vocabulary file: printable ones stand for themselves, the rest
    take code points from 256 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {chr(b if b in own else next(rest)): b for b in range(256)}


class Vocabulary:
    """Ids, merges and bytes of a byte-level BPE file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        stand_in, ids = printable_bytes(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        raw = [b""] * size
        for token, i in ids.items():
            raw[i] = bytes(stand_in[c] for c in token)
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int32)
        for c, b in stand_in.items():
            self.byte_ids[b] = ids[c]
        self.lengths = np.array([len(x) for x in raw], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        self.size = size
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.same = left == right
        keys = left * size + right
        # A repeated pair keeps its last rank, as when merges are read into a map.
        order = np.argsort(keys, kind="stable")
        last = np.append(keys[order][1:] != keys[order][:-1], True)
        keys, ranks = keys[order][last], order[last]
        # A table of short buckets finds a pair in a few vector steps.
        self.bits = int(max(4, np.ceil(np.log2(len(keys) * 4 + 1))))
        slot = self._slot(keys)
        by = np.argsort(slot, kind="stable")
        self.keys, self.ranks, slot = np.append(keys[by], -1), np.append(ranks[by], 0).astype(np.int32), slot[by]
        self.first = np.searchsorted(slot, np.arange(1 << self.bits)).astype(np.int32)
        self.deep = int(np.bincount(slot).max())
        split = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.special_pattern = regex.compile(f"({split})") if split else None
        self.words = regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(bk.BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it has none."""
        keys = left.astype(np.int64) * self.size + right
        at = self.first[self._slot(keys)]
        out = np.full(len(keys), NONE, np.int32)
        for k in range(self.deep):
            here = np.minimum(at + k, len(self.keys) - 1)
            hit = self.keys[here] == keys
            out[hit] = self.ranks[here[hit]]
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    made = Vocabulary(path)
    bk.gave_back()
    return made


def merge_words(voc: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words end to end, and the offset of each word's ids."""
    raw = np.frombuffer(b"".join(words), np.uint8)
    n = len(raw)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    if not n:
        return np.zeros(0, np.int32), bounds
    sym = voc.byte_ids[raw].astype(np.int32)
    # Position n is a wall that stands before and after every word.
    after = np.arange(1, n + 2, dtype=np.int32)
    before = np.arange(-1, n, dtype=np.int32)
    after[bounds[1:][lengths > 0] - 1] = n
    before[bounds[:-1][lengths > 0]] = n
    after[n] = before[n] = n
    sym = np.append(sym, np.int32(0))
    rank_at = np.full(n + 1, NONE, np.int32)
    inner = np.flatnonzero(after[:n] < n)
    rank_at[inner] = voc.rank(sym[inner], sym[after[inner]])

    lists: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def enlist(positions: np.ndarray) -> None:
        ranks = rank_at[positions]
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *cut.tolist(), len(ranks)]
        for a, b, r in zip(starts, starts[1:], ranks[np.array(starts[:-1])].tolist()):
            if r in lists:
                lists[r].append(positions[a:b])
            else:
                lists[r] = [positions[a:b]]
                heapq.heappush(active, r)

    some = np.flatnonzero(rank_at < NONE)
    if len(some):
        enlist(some)
    while active:
        r = heapq.heappop(active)
        parts = lists.pop(r)
        p = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        p = p[rank_at[p] == r]
        if not len(p):
            continue
        if voc.same[r] and len(p) > 1:
            # In a run such as aaaa, every other pair is merged, from the left.
            p = np.sort(p)
            fresh = np.append(True, after[p[:-1]] != p[1:])
            run = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            p = p[(np.arange(len(p)) - run) % 2 == 0]
        q = after[p]
        nxt = after[q]
        sym[p] = voc.merged[r]
        rank_at[q] = NONE
        sym[q] = -1
        after[p] = nxt
        before[nxt] = p
        before[n] = n
        prv = before[p]
        touched = np.concatenate([p[nxt < n], prv[prv < n]])
        rank_at[p] = NONE
        if not len(touched):
            continue
        if len(p) > 1:
            touched = np.unique(touched)
        rank_at[touched] = voc.rank(sym[touched], sym[after[touched]])
        touched = touched[rank_at[touched] < NONE]
        if len(touched):
            enlist(touched)
    alive = sym[:n] >= 0
    return sym[:n][alive], np.concatenate([[0], np.cumsum(alive)])[bounds]


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of ranges, end to end."""
    total = int(lengths.sum())
    shift = starts - np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.repeat(shift, lengths) + np.arange(total)


def encode_block(voc: Vocabulary, texts: list[str]) -> Iterator[np.ndarray]:
    """The ids of each text."""
    number: dict[str, int] = {}
    rows: list[np.ndarray] = []
    for text in texts:
        found: list[str] = []
        for k, piece in enumerate(voc.special_pattern.split(text) if voc.special_pattern else [text]):
            if k % 2:
                found.append("\0special" + piece)
            else:
                found += voc.words.findall(piece)
        rows.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found)))
    # A special token's stand-in can't be a word: the pattern never joins these characters.
    specials = {i: voc.special[w[8:]] for w, i in number.items() if w.startswith("\0special") and w[8:] in voc.special}
    ids, bounds = merge_words(voc, [b"" if i in specials else w.encode() for i, w in enumerate(number)])
    starts, lengths = bounds[:-1].copy(), np.diff(bounds)
    for i, token in specials.items():
        starts[i], lengths[i] = len(ids), 1
        ids = np.append(ids, np.int32(token))
    for row in rows:
        yield ids[gather_ranges(starts[row], lengths[row])] if len(row) else np.zeros(0, np.int32)


def decode_ids(voc: Vocabulary, ids: np.ndarray) -> str:
    """The text of ids; broken UTF-8 becomes U+FFFD."""
    return voc.flat[gather_ranges(voc.starts[ids], voc.lengths[ids])].tobytes().decode("utf-8", "replace")


def _text_blocks(batch: pa.RecordBatch, text_col: str, most: int) -> Iterator[tuple[int, list[str]]]:
    column = batch.column(text_col).fill_null("")
    sizes = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, column.slice(at, to - at).to_pylist()
        at = to


def encode(docs: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None, block_bytes: int = 4 << 20) -> DataFrame:
    """docs with a column of token ids, an array of int, for each whole text, and with decoded_col, if named, the text
    decoded from the ids in the same task (it may take text_col's place).

    Null and empty texts have no ids. Rows stay as they are, repeated ones too; columns named as the new ones are
    replaced. `vocab_path` must be readable where tasks run. Memory is bounded by block_bytes of texts (or one longer text).
    """
    new = [ids_col, *([decoded_col] if decoded_col else [])]
    rest = [c for c in docs.columns if c not in new]
    base = docs.select(*rest, *([text_col] if text_col in new else []))
    schema = extended(docs.select(*rest), f"{ids_col} array<int>" + f", {decoded_col} string" * bool(decoded_col))

    def run(batches):
        voc = vocabulary(vocab_path)
        for batch in batches:
            for at, texts in _text_blocks(batch, text_col, block_bytes):
                rows = list(encode_block(voc, texts))
                offs = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(rows).astype(np.int32)))
                part = batch.slice(at, len(texts)).select(list(range(len(rest))))
                back = [pa.array([decode_ids(voc, r) for r in rows], pa.string())] if decoded_col else []
                yield pa.RecordBatch.from_arrays([*part.columns, ids, *back], names=[*rest, *new])
            bk.gave_back()

    return base.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocab_path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """encoded with the text of its ids. Null ids are an empty text; unknown ids fail."""
    rest = [c for c in encoded.columns if c != text_col]
    base = encoded.select(*rest)
    schema = extended(base, f"{text_col} string")

    def run(batches):
        voc = vocabulary(vocab_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [decode_ids(voc, np.zeros(0, np.int64) if x is None else x) for x in _rows_of(part.column(ids_col))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*rest, text_col])

    return base.mapInArrow(run, schema)


def _rows_of(lists: pa.ListArray) -> Iterator[np.ndarray | None]:
    flat = lists.values.to_numpy(zero_copy_only=False)
    offs = lists.offsets.to_numpy()
    for i in range(len(lists)):
        yield flat[offs[i] : offs[i + 1]] if lists[i].is_valid else None


def round_trip_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 12 << 20) -> DataFrame:
    """Count and digest of each text's ids and the digest of what they decode to, without moving the ids out of the task.

    Returns (id_col, n_tokens, ids_sha256, decoded_sha256), a row for each row of docs; null is an empty text.
    """
    base = docs.select(id_col, text_col)
    id_type = base.schema[id_col].dataType.simpleString()

    def run(batches):
        voc = vocabulary(vocab_path)
        for batch in batches:
            for at, texts in _text_blocks(batch, text_col, block_bytes):
                n, a, b = [], [], []
                for ids in encode_block(voc, texts):
                    n.append(len(ids))
                    a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(decode_ids(voc, ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return base.mapInArrow(run, f"{id_col} {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
