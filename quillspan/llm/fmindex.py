"""Benchmark decontamination with an FM-index for each training shard.

A shard is a task's batch of documents. Their words become symbols of the test phrases' vocabulary; a run of words that
are all in it is indexed if it is as long as the shortest phrase, since no phrase reaches outside such a run. The index
is the Burrows-Wheeler transform of the runs with a wavelet tree (in matrix layout) for ranks and suffix positions
sampled at every eighth word. All phrases are searched backward at once; occurrences are located by stepping back to a
sampled position, and their words merged into removal spans.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import bytekernel as bk
from quillspan.llm.bpe import gather_ranges
from quillspan.llm.shared import extended, written

SAMPLE = 8
INDEX_SYMBOLS = 1 << 20  # an index is closed after the run in which it passes this size
PHRASE_BYTES = 16 << 20  # bytes of test texts in one broadcast block

_separators = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_inside = bk.class_table(_separators)
_inside[65:91] = True  # A-Z are lower-cased first
_values = bk.byte_values(0xF1F1)[bk.LOWER]


class FMIndex:
    """An index over symbols 1..size-1; 0 separates runs and is never searched or stepped over."""

    def __init__(self, text: np.ndarray, size: int):
        n = len(text)
        walls = text == 0
        rank = np.where(walls, np.cumsum(walls) - 1, text + int(walls.sum())).astype(np.int64)
        rank = np.unique(rank, return_inverse=True)[1]
        step = 1
        while True:
            following = np.zeros(n, np.int64)
            following[:-step] = rank[step:] + 1
            key = rank * (n + 1) + following
            order = np.argsort(key, kind="stable")
            fresh = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            step *= 2
            if fresh[-1] == n - 1 or step >= n:
                break
        bwt = text[order - 1]  # the text starts with a wall, so row 0's neighbour is never used
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        self.bwt, self.n = bwt, n
        self.bits = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        level = bwt
        for b in reversed(range(self.bits)):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        # Sampled: every eighth word of a run, its first included.
        begin = np.maximum.accumulate(np.where(walls, np.arange(n) + 1, 0))
        sampled = ((np.arange(n) - begin) % SAMPLE == 0) & ~walls
        self.sampled = sampled[order]
        self.sample_at = np.concatenate([[0], np.cumsum(self.sampled)]).astype(np.int32)
        self.samples = order[self.sampled]

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before its place, down the wavelet tree's levels."""
        low = np.zeros_like(at)
        for k, b in enumerate(reversed(range(self.bits))):
            bit = ((symbols >> b) & 1).astype(bool)
            at1, low1 = self.ones[k][at], self.ones[k][low]
            at = np.where(bit, self.zeros[k] + at1, at - at1)
            low = np.where(bit, self.zeros[k] + low1, low - low1)
        return at - low

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first row, end row) of the patterns that occur; rows of `patterns` are right-aligned."""
        live = np.arange(len(patterns))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        width = patterns.shape[1]
        for k in range(width):
            go = lengths[live] > k
            c = patterns[live[go], width - 1 - k]
            lo[go], hi[go] = self.starts[c] + self.rank(c, lo[go]), self.starts[c] + self.rank(c, hi[go])
            some = lo < hi
            live, lo, hi = live[some], lo[some], hi[some]
            if not len(live):
                break
        return live, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row, from the next sampled one before it."""
        out, steps = np.empty(len(rows), np.int64), 0
        left, row = np.arange(len(rows)), rows.copy()
        while len(left):
            hit = self.sampled[row]
            out[left[hit]] = self.samples[self.sample_at[row[hit]]] + steps
            left, row = left[~hit], row[~hit]
            c = self.bwt[row]
            row = self.starts[c] + self.rank(c, row)
            steps += 1
        return out


def _words(text: str) -> list[str]:
    low = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def phrases(items: list[tuple[str, str | None]], window: int) -> dict:
    """Arrays of the items' windows: vocabulary, right-aligned symbols, lengths, and the items of each window."""
    number: dict[str, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        words = [number.setdefault(w, len(number) + 1) for w in _words(text or "")]
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[i : i + window]), set()).add(item)
    raw = [w.encode() for w in number]
    ends = np.cumsum([len(w) for w in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    starts = ends - np.array([len(w) for w in raw], np.int64)
    hashes = bk.span_hashes(np.frombuffer(b"".join(raw), np.uint8), starts, ends, _values)
    patterns = np.zeros((len(found), window), np.int64)
    for i, w in enumerate(found):
        patterns[i, window - len(w) :] = w
    bits = max(8, int(len(number) * 16 - 1).bit_length()) if number else 8
    slots = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    by = np.argsort(slots, kind="stable")
    return {
        "bits": bits, "hashes": np.append(hashes[by], np.uint64(0)), "symbols": np.append(by + 1, 0),
        "first": np.searchsorted(slots[by], np.arange(1 << bits)).astype(np.int32), "deep": int(np.bincount(slots).max()) if number else 0,
        "patterns": patterns, "lengths": np.array([len(w) for w in found], np.int64), "items": [sorted(s) for s in found.values()], "size": len(number) + 1,
    }


def symbols_of(hashes: np.ndarray, p: dict) -> np.ndarray:
    """The symbol of each word hash, 0 for words outside the vocabulary."""
    at = p["first"][(hashes >> np.uint64(64 - p["bits"])).astype(np.int64)]
    out = np.zeros(len(hashes), np.int64)
    for k in range(p["deep"]):
        here = np.minimum(at + k, len(p["hashes"]) - 1)
        hit = np.flatnonzero(p["hashes"][here] == hashes)
        out[hit] = p["symbols"][here[hit]]
    return out


def _runs(symbols: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of symbols in one row with at least `least` words."""
    known = symbols > 0
    new_row = np.append(True, row[1:] != row[:-1])
    starts = np.flatnonzero(known & (new_row | ~np.append(False, known[:-1])))
    ends = np.flatnonzero(known & (np.append(new_row[1:], True) | ~np.append(known[1:], False))) + 1
    long = ends - starts >= least
    return starts[long], (ends - starts)[long]


def _occurrences(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, p: dict):
    """(word position, phrase) of all occurrences in the runs, an index at a time."""
    at = 0
    while at < len(starts):
        ends = np.cumsum(lengths[at:] + 1)
        to = at + max(1, int(np.searchsorted(ends, INDEX_SYMBOLS)) + 1)
        s, n = starts[at:to], lengths[at:to]
        # A wall, then the run; a last wall ends the text.
        words = gather_ranges(s - 1, n + 1)
        wall = np.cumsum(n + 1) - (n + 1)
        text = symbols[words]
        text[wall] = 0
        index = FMIndex(np.append(text, 0), p["size"])
        which, lo, hi = index.search(p["patterns"], p["lengths"])
        if len(which):
            where = index.locate(gather_ranges(lo, hi - lo))
            yield words[where], np.repeat(which, hi - lo)
        at = to


def _scan(column: pa.Array, blocks: list) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]], dict[int, list[tuple[int, int]]]]:
    """Word counts, hit words, items and removal spans (bytes) of a batch's texts."""
    n_rows = len(column)
    n_words, n_hit = np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
    items: dict[int, set[str]] = {}
    spans: dict[int, list[tuple[int, int]]] = {}
    kept = [[] for _ in blocks]
    for first, buf, offs in bk.blocks(column):
        starts, ends, row = bk.word_spans(buf, offs, _inside)
        hashes = bk.span_hashes(buf, starts, ends, _values)
        n_words[first : first + len(offs) - 1] = np.bincount(row, minlength=len(offs) - 1)
        for k, b in enumerate(blocks):
            p = b.value
            if len(p["lengths"]):
                s = symbols_of(hashes, p)
                at, n = _runs(s, row, int(p["lengths"].min()))
                i = gather_ranges(at, n)
                if len(i):
                    new = np.zeros(len(i), bool)
                    new[np.cumsum(n) - n] = True
                    kept[k].append((s[i], row[i] + first, starts[i] - offs[row[i]], ends[i] - offs[row[i]], new))
    hits = []
    for b, parts in zip(blocks, kept):
        if not parts:
            continue
        p = b.value
        # A word that ends a run is never followed by one of the same run: walls are put in by _occurrences.
        s, row, a, z, new = (np.concatenate(x) for x in zip(*parts))
        run_at = np.flatnonzero(new)
        cover = np.zeros(len(s) + 1, np.int64)
        named = set()
        for where, which in _occurrences(s, run_at, np.diff(np.append(run_at, len(s))), p):
            np.add.at(cover, where, 1)
            np.add.at(cover, where + p["lengths"][which], -1)
            pairs = np.unique(row[where] * len(p["lengths"]) + which)
            named.update(pairs.tolist())
        for x in named:
            items.setdefault(x // len(p["lengths"]), set()).update(p["items"][x % len(p["lengths"])])
        hit = np.cumsum(cover)[:-1] > 0
        hits.append((row[hit], a[hit], z[hit]))
    if hits:
        row, a, z = (np.concatenate(x) for x in zip(*hits))
        _, one = np.unique(row * (1 << 40) + a, return_index=True)
        row, a, z = row[one], a[one], z[one]
        np.add.at(n_hit, row, 1)
        for r, x, y in zip(row.tolist(), a.tolist(), z.tolist()):
            mine = spans.setdefault(r, [])
            # Words with nothing but separators between them are neighbours; hits on neighbours are one span.
            mine.append((x, y))
    return n_words, n_hit, items, spans


def _joined(raw: bytes, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans joined where only separators stand between them."""
    out: list[list[int]] = []
    for a, b in words:
        if out and not _inside[np.frombuffer(raw[out[-1][1] : a], np.uint8)].any():
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def phrase_parts(bench: DataFrame, item_col: str = "item_id", text_col: str = "text") -> list[DataFrame]:
    """The test items (item, text) in parts of about PHRASE_BYTES bytes of text at most, so that each can be broadcast."""
    rows = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // PHRASE_BYTES))
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows for k in range(n)]


HITS = "items array<string>, hits array<struct<start:int,end:int>>"
_pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _broadcast(part: DataFrame, window: int):
    """One part's windows on all executors."""
    return part.sparkSession.sparkContext.broadcast(phrases([(r["item"], r["text"]) for r in part.collect()], window))


def found_in(docs: DataFrame, part: DataFrame, window: int) -> DataFrame:
    """docs (with text as the last column) without the text, with items and hits, the byte ranges of the words inside one part's windows."""
    shared = _broadcast(part, window)
    rest = docs.columns[:-1]

    def run(batches):
        for batch in batches:
            _, _, items, spans = _scan(batch.column(len(rest)), [shared])
            named = pa.array([sorted(items.get(i, ())) for i in range(batch.num_rows)], pa.list_(pa.string()))
            hits = pa.array([[{"start": a, "end": b} for a, b in spans.get(i, ())] for i in range(batch.num_rows)], _pair)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], named, hits], names=[*rest, "items", "hits"])

    return docs.mapInArrow(run, extended(docs.select(*rest), HITS))


def _marked(texts: pa.Array, n_words: np.ndarray, items: list, hits: list, cut: bool) -> list[pa.Array]:
    """text, n_words, n_hit, items and removal_spans of a batch, from each row's items and the (start, end) of its hit words."""
    n_hit, joined, left = np.zeros(len(texts), np.int64), [], {}
    for i, found in enumerate(hits):
        words = sorted(set(found))
        n_hit[i] = len(words)
        spans = []
        if words:
            raw, at, pieces = texts[i].as_py().encode(), 0, []
            spans = _joined(raw, words)
            for a, b in spans:
                pieces.append(raw[at:a])
                at = b
            left[i] = b"".join([*pieces, raw[at:]]).decode()
        joined.append([{"start": a, "end": b} for a, b in spans])
    if cut and left:
        mask = np.zeros(len(texts), bool)
        mask[list(left)] = True
        texts = pa.compute.replace_with_mask(texts, pa.array(mask), pa.array(list(left.values()), texts.type))
    named = pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))
    return [texts, pa.array(n_words), pa.array(n_hit), named, pa.array(joined, _pair)]


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", window: int = 10, cut: bool = True) -> DataFrame:
    """docs with n_words, n_hit, items (ids of test items with an occurring window) and removal_spans (byte ranges); with
    `cut`, the spans are taken out of text_col.

    A window is `window` consecutive words of an item, or the whole item if it is shorter. Null texts have no words and
    stay null; items without words or text are in no document. Repeated items and rows change nothing. An empty bench
    hits nothing. Columns named as the new ones are replaced, all others are kept. Test items of more than PHRASE_BYTES
    are searched part by part: one part is broadcast at a time, its hits are written, and all hits are merged. Those of
    one part are found and cut by the same Python worker, to which each text goes once.
    """
    made = ["n_words", "n_hit", "items", "removal_spans"]
    rest = [c for c in docs.columns if c not in made]
    others = [c for c in rest if c != text_col]
    whole = F.struct(*others) if others else F.lit(None).cast("boolean")
    base = docs.select(whole.alias("others"), F.col(text_col).alias("text"))
    schema = extended(base, "n_words long, n_hit long, items array<string>, removal_spans array<struct<start:int,end:int>>")
    parts = phrase_parts(bench)
    if len(parts) == 1:
        shared = _broadcast(parts[0], window)

        def run(batches):
            for batch in batches:
                n_words, _, items, spans = _scan(batch.column(1), [shared])
                found = ([x.get(i, ()) for i in range(batch.num_rows)] for x in (items, spans))
                yield pa.RecordBatch.from_arrays([batch.column(0), *_marked(batch.column(1), n_words, *found, cut)], names=["others", "text", *made])

        done = base.mapInArrow(run, schema)
    else:
        base = written(base.withColumn("place", F.monotonically_increasing_id()), "texts")
        each = [written(found_in(base.select("place", "text"), part, window).where(F.size("hits") > 0), "hits") for part in parts]
        merged = reduce(DataFrame.unionByName, each).groupBy("place").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("hits")).alias("hits"))
        hit = base.join(merged, "place", "left").select("others", "text", "items", "hits")

        def run(batches):
            for batch in batches:
                texts, n_words = batch.column(1), np.zeros(batch.num_rows, np.int64)
                for first, buf, offs in bk.blocks(texts):
                    n_words[first : first + len(offs) - 1] = np.bincount(bk.word_spans(buf, offs, _inside)[2], minlength=len(offs) - 1)
                items = [x or () for x in batch.column(2).to_pylist()]
                hits = [[(x["start"], x["end"]) for x in row or ()] for row in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *_marked(texts, n_words, items, hits, cut)], names=["others", "text", *made])

        done = hit.mapInArrow(run, schema)
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col("others").getField(c).alias(c) for c in rest), *made)


def contamination_report(docs: DataFrame, bench: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document."""
    found = decontaminate(docs.select("doc_id", "text"), bench, window=window, cut=False)
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
