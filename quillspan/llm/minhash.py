"""Near-duplicate groups: universal hash minima, banding, signature check, full-set confirmation, components.

A document's set is its distinct word shingles. Documents with equal sets are one node. 128 universal hash minima in 32
bands of 4 put nodes into buckets: two sets of similarity 0.75 share no bucket with a probability of 5e-6. Buckets with
the same members are one.

Pairs of a bucket are never written out. In a round each bucket's members are compared with one leader, by signature,
then on the full sets, which joins most copies; the leader is then done. Rounds go on with what is left of the large
buckets that hold several components while a round halves it. What remains goes through tasks of two blocks of members
each, which count the common shingles of all pairs on the full sets by sparse products and return a spanning forest of
the components that are linked. So each pair that shares a bucket has been compared exactly, or was connected before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import bytekernel as bk
from quillspan.llm.components import connected_components
from quillspan.llm.shared import joined_spread, sieved, written

BANDS, WIDTH = 32, 4
HASHES = BANDS * WIDTH
WHITE_SPACE = bytes([0x20, *range(0x09, 0x0E)])
SLAB = 4096
BLOCK, BLOCK_SHINGLES = 512, 1 << 18  # members, and shingles of all of them, of a block at about most
SURE = 5.5  # standard deviations below the threshold at which a signature's estimate excludes a pair

_values = bk.byte_values(0x5EED)
_values = _values[bk.LOWER]  # A-Z hash as a-z
_word_table = bk.class_table(WHITE_SPACE)
_factors = bk.mix(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)
_a = (bk.mix(np.arange(1000, 1000 + HASHES, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_b = (bk.mix(np.arange(5000, 5000 + HASHES, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(column: pa.Array, k: int):
    """(row, sorted distinct shingle hashes) for each text, in order. Fewer words than k are one shingle; none, no shingle."""
    for first, buf, offs in bk.blocks(column):
        starts, ends, row = bk.word_spans(buf, offs, _word_table)
        words = bk.span_hashes(buf, starts, ends, _values)
        n_rows = len(offs) - 1
        bounds = np.searchsorted(row, np.arange(n_rows + 1))
        n = max(len(words) - k + 1, 0)
        sums = np.zeros(n, np.uint64)
        for j in range(k):
            sums += words[j : j + n] * _factors[j]
        sums = bk.mix(sums)
        for i in range(n_rows):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= k:
                yield first + i, np.unique(sums[a : b - k + 1])
            elif b > a:
                short = (words[a:b] * _factors[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield first + i, bk.mix(np.array([short], np.uint64))
            else:
                yield first + i, np.zeros(0, np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash a*x+b modulo 2**32 over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(out, (_a[:, None] * x[None, at : at + 2048] + _b[:, None]).min(axis=1), out=out)
    return out


def _ids(batch: pa.RecordBatch) -> pa.Array:
    return batch.column(0)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """(id, mark, n_shingles, two set fingerprints, bands, signature of 16 bits a hash) of each row; mark is a hash of the text; null and blank texts are empty sets."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))

    def run(batches):
        seeds = bk.mix(np.arange(9000, 9000 + BANDS, dtype=np.uint64))
        for batch in batches:
            n, fa, fb, bands, sigs = [], [], [], [], []
            for _, s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                fa.append(int(s.sum(dtype=np.uint64)) & bk.MASK64)
                fb.append(int(bk.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) & bk.MASK64)
                m = minima(s)
                wide = (m.astype(np.uint64).reshape(BANDS, WIDTH) + np.uint64(1)) * _factors[:WIDTH]
                bands.append(bk.mix(bk.mix(wide.sum(axis=1, dtype=np.uint64)) ^ seeds))
                sigs.append((m >> np.uint32(16)).astype("<u2").tobytes())
            if not n:
                continue
            flat = pa.array(np.concatenate(bands).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    _ids(batch),
                    batch.column(2),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(fa, np.uint64).view(np.int64)),
                    pa.array(np.array(fb, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), flat),
                    pa.array(sigs, pa.binary()),
                ],
                names=["id", "mark", "n_shingles", "fa", "fb", "bands", "sig"],
            )

    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {kind}, mark long, n_shingles long, fa long, fb long, bands array<long>, sig binary")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of (node, text): the sorted 64-bit hashes as bytes."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [s.astype("<u8").tobytes() for _, s in shingle_sets(part.column(1), k)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles binary")


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each set of a shares with each of b, by products of thin slabs of the two incidence matrices."""
    va, vb = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(va, vb)
    out = np.zeros((len(a), len(b)), np.float32)
    sides = []
    for values, sets in ((va, a), (vb, b)):
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(shared, values)
        hit = (at < len(shared)) & (shared[np.minimum(at, max(len(shared) - 1, 0))] == values) if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], owner[hit][order], len(sets)))
    for first in range(0, len(shared), SLAB):
        slabs = []
        for at, owner, n in sides:
            lo, hi = np.searchsorted(at, (first, first + SLAB))
            m = np.zeros((min(SLAB, len(shared) - first), n), np.float32)
            m[at[lo:hi] - first, owner[lo:hi]] = 1
            slabs.append(m)
        out += slabs[0].T @ slabs[1]
    return out


def _root(up: dict, x: int) -> int:
    while up.get(x, x) != x:
        up[x] = up.get(up[x], up[x])
        x = up[x]
    return x


def block_links(a: list[tuple], b: list[tuple] | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest, as component pairs, of all links between members (component, set) of two blocks; b is None for a block with itself."""
    same = b is None
    b = a if same else b
    if not a or not b:
        return []
    (ca, sa), (cb, sb) = ((np.array([x[0] for x in side], np.int64), [x[1] for x in side]) for side in (a, b))
    common = _common(sa, sb)
    union = np.array([len(x) for x in sa])[:, None] + np.array([len(x) for x in sb])[None, :] - common
    linked = (ca[:, None] != cb[None, :]) & (common > 0) & (100 * common >= percent * union)
    if same:
        linked = np.triu(linked, 1)
    i, j = np.nonzero(linked)
    up, out = {}, []
    for x, y in np.unique(np.stack([np.minimum(ca[i], cb[j]), np.maximum(ca[i], cb[j])], 1), axis=0).tolist():
        p, q = _root(up, x), _root(up, y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _linked_components(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): components linked by members (bucket, parts, node, component, shingles); buckets are cut into `parts` blocks."""
    block = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = members.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "component", "shingles")

    def run(table: pa.Table) -> pa.Table:
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        rows = [(c, np.frombuffer(s, "<u8"), o) for c, s, o in zip(*(table[c].to_pylist() for c in ("component", "shingles", "own")))]
        left = [r[:2] for r in rows if r[2] == lo]
        found = block_links(left, None if lo == hi else [r[:2] for r in rows if r[2] == hi], percent)
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.groupBy("bucket", "lo", "hi").applyInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets sa, sb have 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                keep.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _alike(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures ga, gb leave the similarity possible."""
    s = percent / 100
    least = HASHES * s - SURE * (HASHES * s * (1 - s)) ** 0.5

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, HASHES) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= least))

    return pairs.select("a", "b", "ga", "gb").mapInArrow(run, "a long, b long")


def _buckets(members: DataFrame, turn: int) -> DataFrame:
    """A row for each bucket of (bucket, node, component, n_shingles) that holds several components, of those with equal members one: n, parts, leader."""
    mark = F.xxhash64("node", F.lit(turn))
    found = members.groupBy("bucket").agg(
        F.count("*").alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1"), F.sum("n_shingles").alias("shingles"),
        F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(mark)).alias("y"), F.min_by(F.col("node"), mark).alias("leader"), F.min_by(F.col("component"), mark).alias("led_by"),
    ).where("c0 < c1")
    one = found.groupBy("n", "x", "y").agg(*(F.min(c).alias(c) for c in ("bucket", "leader", "led_by", "shingles")))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    return one.select("bucket", "n", parts.alias("parts"), "leader", "led_by")


def components_of_sets(groups: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(node, component) for the nodes of `groups` (node, first, n_shingles, bands, sig) that a link joins to another."""
    members = groups.select("node", F.explode("bands").alias("bucket"), F.col("node").alias("component"), "n_shingles")
    # Most rows are of buckets with one node, and most texts of nodes without a bucket: the sieves keep these out of shuffles.
    several = members.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    table = written(_buckets(sieved(members, ["bucket"], several), 0), "buckets")
    active = written(sieved(members, ["bucket"], table).join(table.drop("parts", "n"), "bucket").where("node <> leader"), "active")
    chosen = written(active.select("node").unionByName(table.select(F.col("leader").alias("node"))).distinct(), "chosen")
    marks = written(groups.select("node", "n_shingles", "sig").join(chosen, "node", "left_semi"), "marks")
    place = written(groups.select("node", "first").join(chosen, "node", "left_semi"), "place")
    texts = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark")).alias("first"), F.col(text_col).alias("text"))
    sets = written(full_sets(sieved(texts, ["first"], place).join(place, "first").dropDuplicates(["node"]), k), "sets")
    ma, mb = (marks.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sig").alias(f"g{x}")) for x in "ab")
    sa, sb = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")

    def confirmed(led: DataFrame) -> DataFrame:
        pairs = led.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
        sized = pairs.join(ma, "a").join(mb, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        # Written: else each task would hold two Python workers, one for the signatures and one for the sets.
        alike = written(_alike(sized, percent), "alike")
        return written(_confirmed(alike.join(sa, "a").join(sb, "b"), percent), "links")

    stars, turn, before = connected_components(confirmed(active)), 0, None
    rest = active.select("bucket", "node", "n_shingles")
    while True:
        named = rest.join(stars, "node", "left").withColumn("component", F.coalesce("component", "node"))
        turn += 1
        table = written(_buckets(named, turn), "buckets")
        size = table.agg(F.count("*").alias("buckets"), F.sum("n").alias("n"), F.max("parts").alias("parts")).first()
        if not size["buckets"]:
            return stars
        rest = written(named.join(table.drop("n"), "bucket"), "rest")
        if size["parts"] == 1 or (before is not None and 2 * size["n"] > before):
            break
        before = size["n"]
        more = confirmed(rest.where("component <> led_by"))
        stars = _merged(stars, _between(more, stars))
        rest = rest.where("node <> leader").select("bucket", "node", "n_shingles")
    open_members = rest.select("bucket", "parts", "node", "component").join(sieved(sets, ["node"], rest), "node")
    return _merged(stars, written(_linked_components(open_members, percent), "links"))


def _between(links: DataFrame, stars: DataFrame) -> DataFrame:
    """The components that links (a, b) join."""
    for side in ("a", "b"):
        links = links.join(stars.withColumnsRenamed({"node": side}), side, "left").withColumn(side, F.coalesce("component", side)).drop("component")
    return written(links.where("a <> b").distinct(), "between")


def _merged(stars: DataFrame, links: DataFrame) -> DataFrame:
    """stars (node, component) with the components joined that links (a, b) between components name."""
    if links.isEmpty():
        return stars
    larger = connected_components(links).select(F.col("node").alias("component"), F.col("component").alias("larger"))
    counts = larger.join(stars.groupBy("component").agg(F.count("*").alias("n")), "component", "left").fillna(1, "n")
    counts = written(counts, "merged")
    moved = joined_spread(stars, counts, ["component"], stars.count(), "left").select("node", F.coalesce("larger", "component").alias("component"))
    # Components of one node have no row in stars yet.
    single = counts.select(F.col("component").alias("node"), F.col("larger").alias("component")).join(stars.select("node"), "node", "left_anti")
    return written(moved.unionByName(single), "stars")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of docs.

    Two documents are linked if 100 * |A & B| >= percent * |A | B|. component_id is the smallest id reachable, kept says
    that the row's own text reaches no smaller one. Null and blank texts have no shingles and link nothing. Rows that
    repeat an id count as one document and link whatever their texts link, but each is kept by its own text, so that of
    like texts one stays; rows without an id are kept, in no component (null). An empty table stays empty; other columns
    are ignored, whatever their names.
    """
    out = near_rows(docs, id_col, text_col, k, percent)
    reused = out.groupBy("id").agg(F.min("least").alias("lo"), F.max("least").alias("hi")).where("lo < hi").select("id")
    reused = written(out.join(reused, "id").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct(), "reused")
    if reused.isEmpty():
        out = out.withColumn("component_id", F.col("least"))
    else:
        # Ids that stand for several texts link those texts' components.
        joined = connected_components(reused).withColumnsRenamed({"node": "least"})
        counts = written(out.groupBy("least").agg(F.count("*").alias("n")).join(joined, "least"), "reused")
        there = joined_spread(out.where("least is not null"), counts, ["least"], out.count(), "left")
        out = there.unionByName(out.where("least is null"), allowMissingColumns=True).withColumn("component_id", F.coalesce("component", "least"))
    kept = F.coalesce(F.col("id") == F.col("least"), F.lit(True))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """(id, n_shingles, least) for each row: least is the smallest id that the row's text reaches, its own where it has no words."""
    sigs = written(signatures(docs, id_col, text_col, k), "signatures")
    full = sigs.where("id is not null and n_shingles > 0")
    same = full.groupBy("fa", "fb").agg(
        F.min(F.struct("id", "mark")).alias("first"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig"),
    ).withColumn("node", F.monotonically_increasing_id())
    groups = written(same, "groups")
    stars = components_of_sets(groups, docs, id_col, text_col, k, percent)
    named = groups.select("node", "fa", "fb", "n", "first.id").join(stars, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named, "named")
    least = written(named.groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("n")), "least")
    sets = joined_spread(named.withColumnRenamed("n", "rows"), least, ["component"], named.count()).select("fa", "fb", "least", F.col("rows").alias("n"))
    sets = written(sets, "least-of-sets")
    out = joined_spread(full.select("id", "n_shingles", "fa", "fb"), sets, ["fa", "fb"], sigs.count()).select("id", "n_shingles", "least")
    blank = sigs.where("id is null or n_shingles = 0").select("id", "n_shingles", F.col("id").alias("least"))
    return written(out.unionByName(blank), "least-of-rows")
