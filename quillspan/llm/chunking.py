"""Substring deduplication by windows at content-defined places with a gear rolling hash.

A text's bytes are hashed with a 16-bit gear hash, h = 2h + gear[byte], which depends on the last 16 bytes alone. Of any
WINDOW neighbouring places the one whose 16 bytes have the least hash is taken, so that whether a place is taken depends
on its near surroundings alone, and an insertion changes the places around it and no others. The `run` bytes from each
place on are compared by a 128-bit digest over the whole table. What is cut has stood as a whole, `run` bytes at least,
in one earlier place: short sequences that stand in many texts never add up to a passage. A passage of at least run +
WINDOW - 1 bytes that repeats has a window of its own wherever it stands, so none of them is missed. Windows are then
extended byte by byte to both sides as far as they agree with their earlier text, so a passage's edges go with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quillspan.llm import bytekernel as bk
from quillspan.llm.shared import extended, joined_spread, written

GEAR = (bk.byte_values(0x6EA2) >> np.uint64(40)).astype(np.uint16)
CUT_BITS = np.uint16(0x1F << 11)
SNAP = 24  # bytes within which a cut looks for white space
_digest_a, _digest_b = bk.byte_values(0xA11CE), bk.byte_values(0xB0B)
CHANCE = 8  # bytes at an edge that may agree by chance
WINDOW = 64  # places among which one is taken; a power of two
LOOK, OFTEN, SALTS = 0.02, 4096, 64  # share of rows looked at for frequent windows, at most so many of those, and parts that each is dealt into
_letter = [x >= 0x80 or chr(x).isalnum() for x in range(256)]
_white = ~bk.class_table(bytes([0x20, *range(0x09, 0x0E)]))


def gear_hashes(buf: np.ndarray) -> np.ndarray:
    """The gear hash behind each byte: the sum over the last 16 bytes of gear[byte] << age, by doubling the window."""
    h = GEAR[buf]
    for age in (1, 2, 4, 8):
        shifted = h[:-age] << np.uint16(age)
        h = h.copy()
        h[age:] += shifted
    return h


def chunk_bounds(buf: np.ndarray, offs: np.ndarray, least: int = 16, most: int = 256) -> np.ndarray:
    """Ascending chunk starts; rows' starts are among them and chunks cover all bytes."""
    if not len(buf):
        return np.zeros(0, np.int64)
    n = len(buf)
    starts = np.unique(offs[:-1])
    starts = starts[starts < n]
    where = np.flatnonzero((gear_hashes(buf) & CUT_BITS) == 0) + 1
    row_start = starts[np.searchsorted(starts, where - 1, "right") - 1]
    where = where[where - row_start >= 16]  # the hash must not reach into the row before
    white = np.append(np.flatnonzero(_white[buf]) + 1, n + SNAP + 1)
    snapped = white[np.searchsorted(white, where)]
    leads = np.append(np.flatnonzero((buf & 0xC0) != 0x80), n)
    where = np.unique(np.where(snapped - where <= SNAP, snapped, leads[np.searchsorted(leads, where)]))
    where = where[where < n]
    cuts = np.union1d(where, starts)
    at = np.searchsorted(cuts, where)
    far = where - cuts[np.maximum(at - 1, 0)] >= least
    cuts = np.union1d(where[far], starts)
    lengths = np.diff(np.append(cuts, n))
    extra = (lengths - 1) // most
    if extra.any():
        k = np.repeat(np.arange(len(cuts)), extra)
        nth = np.arange(len(k)) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        forced = leads[np.searchsorted(leads, cuts[k] + nth * most)]
        cuts = np.union1d(cuts, forced[forced < n])
    return cuts


def places(buf: np.ndarray, offs: np.ndarray, run: int) -> np.ndarray:
    """Ascending places of least gear hash: one at least among any WINDOW neighbours whose next `run` bytes lie in their row.

    Whether a place is taken depends on the bytes of those neighbours alone, so equal stretches have the same places.
    """
    n = len(buf)
    room = np.maximum(np.diff(offs) - run + 1, 0)
    if not room.any():
        return np.zeros(0, np.int64)
    key = np.full(n + WINDOW, np.iinfo(np.uint64).max, np.uint64)
    valid = np.repeat(offs[:-1], room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
    key[valid] = (gear_hashes(buf)[valid + 15].astype(np.uint64) << np.uint64(40)) | valid.astype(np.uint64)
    starts = np.cumsum(room) - room
    short = (room > 0) & (room < WINDOW)
    best = np.minimum.reduceat(key[valid], starts[room > 0])[short[room > 0]]
    for step in (1, 2, 4, 8, 16, 32):
        key[:-step] = np.minimum(key[:-step], key[step:])
    wide = np.maximum(room - WINDOW + 1, 0)
    whole = np.repeat(offs[:-1], wide) + np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
    return np.unique(np.concatenate([best, key[whole]]) & np.uint64((1 << 40) - 1)).astype(np.int64)


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 96) -> DataFrame:
    """(id, mark, at, da, db): places and digests of `run` bytes from there on; mark is a hash of the whole text."""
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))

    def digests(batches):
        for batch in batches:
            for first, buf, offs in bk.blocks(batch.column(2)):
                at = places(buf, offs, run)
                row = np.searchsorted(offs, at, "right") - 1
                da, db = (bk.span_hashes(buf, at, at + run, v).view(np.int64) for v in (_digest_a, _digest_b))
                # Where a short pattern repeats itself, one place in WINDOW and the last one are enough.
                new = np.ones(len(at), bool)
                new[1:] = (da[1:] != da[:-1]) | (row[1:] != row[:-1]) | (np.diff(at) >= WINDOW)
                nth = (at - at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]) // WINDOW
                last = np.append(new[1:], True)
                new[1:] |= nth[1:] != nth[:-1]
                new |= last
                at, row, da, db = at[new], row[new], da[new], db[new]
                rows = pa.array(row + first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *map(pa.array, ((at - offs[row]).astype(np.int32), da, db))], names=["id", "mark", "at", "da", "db"])

    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(digests, f"id {kind}, mark long, at int, da long, db long")


def frequent(docs: DataFrame, id_col: str, text_col: str, run: int) -> DataFrame:
    """(da, db) of windows that a part of the rows shows to be frequent, fewer than OFTEN; they only decide where rows are put."""
    seen = windows(docs.select(id_col, text_col).sample(False, LOOK, 11), id_col, text_col, run).groupBy("da", "db").agg(F.count("*").alias("n"))
    seen = written(seen.where("n > 3"), "frequent")
    total = seen.agg(F.sum("n")).first()[0] or 0  # one number
    return seen.where(F.col("n") * OFTEN > total).select("da", "db")


def repeated(pieces: DataFrame, often: DataFrame, run: int) -> DataFrame:
    """(id, mark, at, fid, fmark, fat): the windows that stand earlier, and their first occurrence; none overlaps its own.

    Rows of the windows in `often` (da, db; few enough to broadcast) are dealt into SALTS parts, whose first occurrences are
    then compared.
    """
    blank = often.sparkSession.range(1).select(*(F.lit(None).cast("long").alias(c) for c in ("da", "db")))
    marked = pieces.join(F.broadcast(often.unionByName(blank).withColumn("often", F.lit(True))), ["da", "db"], "left")
    marked = marked.withColumn("salt", F.when(F.col("often"), F.pmod(F.xxhash64("id", "mark", "at"), F.lit(SALTS))).otherwise(F.lit(0)))
    order = W.partitionBy("da", "db", "salt").orderBy("id", "mark", "at").rowsBetween(W.unboundedPreceding, W.currentRow)
    first = marked.withColumn("first", F.first(F.struct("id", "mark", "at")).over(order))
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))
    later = ~same | (F.col("at") - F.col("first.at") >= run)
    first = written(first.where(F.coalesce("often", F.lit(False)) | later).select("da", "db", "often", "id", "mark", "at", "first"), "repeated")
    whole = first.where("often").groupBy("da", "db").agg(F.min("first").alias("whole"))  # a row for each frequent window
    first = first.join(F.broadcast(whole), ["da", "db"], "left").withColumn("first", F.coalesce("whole", "first")).where(later)
    return first.select("id", "mark", "at", F.col("first.id").alias("fid"), F.col("first.mark").alias("fmark"), F.col("first.at").alias("fat")).distinct()


def segments(later: DataFrame, run: int) -> DataFrame:
    """(id, mark, fid, fmark, shift, start, end, n): windows of one text with one earlier text at one shift, where they touch, joined."""
    by = W.partitionBy("id", "mark", "fid", "fmark", "shift").orderBy("at")
    placed = later.withColumn("shift", F.col("at") - F.col("fat"))
    placed = placed.withColumn("new", F.coalesce(F.col("at") - F.lag("at").over(by) > run, F.lit(True)).cast("int"))
    placed = placed.withColumn("nth", F.sum("new").over(by))
    joined = placed.groupBy("id", "mark", "fid", "fmark", "shift", "nth").agg(F.min("at").alias("start"), (F.max("at") + run).alias("end"), F.count("*").alias("n"))
    return joined.drop("nth")


def extensions(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, start, end) behind and before the segments: the bytes by which they and their earlier text still agree.

    WINDOW bytes to each side are compared: if more agreed, another window would stand there. Only these bytes move.
    """
    # An edge is twice its place, and one more where the bytes behind it are compared. doc and fdoc are (id, mark).
    doc, fdoc = F.struct("id", "mark").alias("doc"), F.struct(F.col("fid").alias("id"), F.col("fmark").alias("mark")).alias("fdoc")
    left, right = (found.select(doc, fdoc, (F.col(c) * 2 + k).alias("edge"), ((F.col(c) - F.col("shift")) * 2 + k).alias("fedge")) for k, c in enumerate(("start", "end")))
    edges = left.unionByName(right)
    wanted = edges.select("doc", "edge").unionByName(edges.select(F.col("fdoc").alias("doc"), F.col("fedge").alias("edge")))
    wanted = wanted.groupBy("doc").agg(F.collect_set("edge").alias("edges"))
    base = docs.select(F.col(id_col).alias("id"), F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark")).alias("doc"), F.col(text_col).alias("text"))
    asked = base.join(wanted, "doc").select("id", F.col("doc.mark").alias("mark"), "text", "edges")
    kind = base.schema["id"].dataType.simpleString()

    def around(batches):
        for batch in batches:
            rows, at, near = [], [], []
            for i in range(batch.num_rows):
                raw = batch.column(2)[i].as_py().encode()
                for e in batch.column(3)[i].as_py():
                    place = e // 2
                    rows.append(i)
                    at.append(e)
                    near.append(raw[place : place + WINDOW] if e % 2 else raw[max(place - WINDOW, 0) : place][::-1])
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at, pa.int32()), pa.array(near, pa.binary())], names=["id", "mark", "edge", "near"])

    near = asked.mapInArrow(around, f"id {kind}, mark long, edge int, near binary").select(doc, "edge", "near").dropDuplicates(["doc", "edge"])
    near = written(near, "near")
    edges = written(edges.join(near.withColumnRenamed("near", "a"), ["doc", "edge"]), "edges")
    here = ["fdoc", "fedge"]
    first = near.select(F.col("doc").alias("fdoc"), F.col("edge").alias("fedge"), F.col("near").alias("b"))
    first = written(edges.groupBy(*here).agg(F.count("*").alias("n")).join(first, here), "first")
    total = edges.count()
    edges = joined_spread(edges, first, here, total)

    def agreed(batches):
        for batch in batches:
            size = np.array([common(a, b) for a, b in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist())], np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(size)], names=["id", "mark", "edge", "first", "fedge", "size"])

    # A first text's place stands as one number for its edge, to which the sizes' counts are joined.
    edges = edges.select("doc.id", "doc.mark", "edge", F.xxhash64("fdoc").alias("first"), "fedge", "a", "b")
    sized = written(edges.mapInArrow(agreed, f"id {kind}, mark long, edge int, first long, fedge int, size int"), "sized")
    # A word more than most later texts share with this edge has come to stand there by chance.
    votes = written(sized.groupBy("first", "fedge", "size").agg(F.count("*").alias("n")), "votes")
    most = votes.groupBy("first", "fedge").agg(F.max(F.struct(F.col("n").alias("votes"), "size")).alias("most"))
    votes = written(votes.join(most, ["first", "fedge"]), "votes").withColumn("votes", F.col("n"))
    sized = joined_spread(sized, votes, ["first", "fedge", "size"], total)
    chance = (F.col("votes") < F.col("most.votes")) & (F.col("size") - F.col("most.size")).between(1, CHANCE)
    sized = sized.withColumn("size", F.when(chance, F.col("most.size")).otherwise(F.col("size"))).where("size > 0")
    place = (F.col("edge") / 2).cast("int")
    behind = F.col("edge") % 2
    return sized.select("id", "mark", (place - F.col("size") * (1 - behind)).alias("start"), (place + F.col("size") * behind).alias("end"))


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return n if a[:n] == b[:n] else next(i for i in range(n) if a[i] != b[i])


def merged_runs(spans: list[tuple[int, int]], run: int) -> list[tuple[int, int]]:
    """Adjacent or overlapping (start, end) joined; those of at least `run` bytes."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= run]


def trimmed(raw: bytes, a: int, b: int) -> tuple[int, int]:
    """The span without what belongs to words outside it (their ends, marks and one white space), and in whole characters."""
    if 0 < a < b and not _white[raw[a - 1]] and not _white[raw[a]] and (_letter[raw[a - 1]] or not _letter[raw[a]]):
        a = next((x for x in range(a + 1, min(a + SNAP, b)) if _white[raw[x]]), a)
    if a < b < len(raw) and not _white[raw[b - 1]] and not _white[raw[b]] and (_letter[raw[b]] or not _letter[raw[b - 1]]):
        b = next((x for x in range(b - 1, max(b - SNAP, a), -1) if _white[raw[x - 1]]), b)
    while a < b and raw[a] & 0xC0 == 0x80:
        a += 1
    while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    if 0 < a < b < len(raw) and not _white[raw[a - 1]] and not _white[raw[b]]:
        if _white[raw[b - 1]]:
            b -= 1
        elif _white[raw[a]]:
            a += 1
    return a, b


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 96) -> DataFrame:
    """docs with repeated passages cut out of text_col, and n_repeated (windows seen before), removed_spans (byte ranges of
    the old text) and removed_bytes.

    The first occurrence, by id, text hash and place, stays whole (rows without an id come first). Rows that agree in id
    and text are one document: they are cut alike, each only against others. Null texts stay null, empty ones empty; an
    empty table stays empty. Columns named as the three new ones are replaced, all others are kept whatever their names.
    """
    made = ["n_repeated", "removed_spans", "removed_bytes"]
    rest = [c for c in docs.columns if c not in made]
    if run < 16:
        raise ValueError("run must be at least the 16 bytes of a gear hash")
    often = frequent(docs, id_col, text_col, run)
    later = segments(repeated(windows(docs, id_col, text_col, run), often, run), run)
    later = written(later, "segments")
    more = extensions(docs, later, id_col, text_col).withColumn("n", F.lit(0).cast("long"))
    spans = later.select("id", "mark", "start", "end", "n").unionByName(more)
    spans = spans.groupBy("id", "mark").agg(F.collect_set(F.struct(F.col("start").alias("at"), F.col("end").alias("to"))).alias("spans"), F.sum("n").cast("int").alias("n"))
    spans = spans.select(F.struct("id", "mark").alias("doc"), "spans", "n")
    # The other columns travel as one, so that none can clash.
    others = [c for c in rest if c != text_col]
    base = docs.select(F.struct(*others).alias("others"), F.col(text_col).alias("text"), F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark")).alias("doc"))
    found = base.join(spans, "doc", "left").select("others", "text", "spans", "n")
    schema = extended(base.select("others", "text"), "n_repeated int, removed_spans array<struct<start:int,end:int>>, removed_bytes long")
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches):
        for batch in batches:
            n, runs, gone, texts, whole = batch.column(3).fill_null(0), [], [], {}, batch.column(1)
            for i, s in enumerate(batch.column(2).to_pylist()):
                keep = merged_runs([(x["at"], x["to"]) for x in s or ()], run)
                if keep:
                    raw, at, left = whole[i].as_py().encode(), 0, []
                    keep = [trimmed(raw, a, b) for a, b in keep]
                    for a, b in keep:
                        left.append(raw[at:a])
                        at = b
                    texts[i] = b"".join([*left, raw[at:]]).decode()
                runs.append([{"start": a, "end": b} for a, b in keep])
                gone.append(sum(b - a for a, b in keep))
            if texts:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(texts)] = True
                whole = pa.compute.replace_with_mask(whole, pa.array(mask), pa.array(list(texts.values()), whole.type))
            yield pa.RecordBatch.from_arrays([batch.column(0), whole, n, pa.array(runs, pair), pa.array(gone, pa.int64())], names=["others", "text", *made])

    done = found.mapInArrow(cut, schema)
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col("others").getField(c).alias(c) for c in rest), *made)
