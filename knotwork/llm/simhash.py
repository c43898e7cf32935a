"""SimHash near-dedup: fingerprints over word shingles, linked within a radius, grouped into components.

near_duplicates() links fingerprints within a radius of 0 to 2, near_copies() links texts whose shingle sets have a
Jaccard similarity of at least 0.8. A similarity of 0.8 means about 10 and up to 20 differing bits, for which no cut of 64
bits into blocks gives selective buckets; near_copies() therefore forms its blocks by min-hashes of the shingles, compares
the fingerprints inside them bit-sliced, and confirms what is close by the shingle sets themselves.

Candidates of near_duplicates(): two fingerprints that differ in at most `radius` of 64 bits agree in at least 2 of 4 blocks of 16 bits when
the radius is 2, so each distinct fingerprint goes to six buckets of 32 equal bits. A bucket with more than BUCKET_ROWS
distinct fingerprints is cut again by thirds of its remaining bits (one third must agree), and those once more, until at
most 14 bits are free: no comparison task ever sees more than 2**14 fingerprints, and nothing is dropped.

Comparison inside a bucket is bit-sliced: plane k holds bit k of 64 fingerprints per word. Carry-save counters of one,
two and (sticky) four add the differing planes for all fingerprints at once, and words in which every distance already
exceeds the radius are abandoned. A bucket yields a spanning forest of its links, never all pairs; a star contraction
over those joins them into components.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import map_batches, materialize, partitions, sent, without
from knotwork.operators.identity import representatives
from knotwork.sources.graph import rounds

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 2
#: Distinct fingerprints that a bucket may hold before it is cut again.
BUCKET_ROWS = 4096
#: Shingles whose bits are counted at a time.
SHINGLE_BATCH = 1 << 15
#: Groups up to this size are compared as one list of pairs for many groups at once.
SMALL_GROUP = 24


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of the text's word shingles, repeats included; 0 without words."""
    import numpy as np
    import xxhash

    # bytes.lower and bytes.split know ASCII only: A-Z, and the white space 9-13 and 32
    w = (text or "").encode().lower().split()
    n = len(w) - words + 1
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(b" ".join(w), seed)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLE_BATCH):
        part = w[at : at + SHINGLE_BATCH + words - 1]
        shingles = zip(*(part[k:] for k in range(words)), strict=False)
        hashes = np.array([digest(b" ".join(s), seed) for s in shingles], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id_col, fp): fp is the fingerprint as a signed long. Null texts count as empty: 0."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1)
            found = np.fromiter((fingerprint(texts[k].as_py(), words) for k in range(batch.num_rows)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, fp long")


def planes_of(values):
    """The 64 bit planes of an array of uint64, as an array (64, words); places beyond the values are zero."""
    import numpy as np

    n = len(values)
    padded = np.zeros((n + 63) // 64 * 64, np.uint64)
    padded[:n] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def close(planes, queries, radius: int):
    """A mask (queries, places): which stored values are within radius of each query."""
    import numpy as np

    words, q = planes.shape[1], len(queries)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    flips = np.unpackbits(np.ascontiguousarray(queries).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    active = np.arange(words)
    counters = [np.zeros((q, words), np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros((q, words), np.uint64)
    result = np.zeros((q, words), np.uint64)
    for k in range(64):
        carry = np.where(flips[:, k, None], ~planes[k, active][None, :], planes[k, active][None, :])
        for counter in counters:
            carried = counter & carry
            counter ^= carry
            carry = carried
        over |= carry
        if k % 8 == 7:
            alive = (_exceeds(counters, over, radius) != full).any(axis=0)
            if not alive.all():
                active, over, counters = active[alive], over[:, alive], [c[:, alive] for c in counters]
                if not len(active):
                    break
    if len(active):
        result[:, active] = ~_exceeds(counters, over, radius)
    return np.unpackbits(result.view(np.uint8), axis=1, bitorder="little").astype(bool)


def _exceeds(counters, over, radius: int):
    """Where the counters (lowest first) hold more than radius, or have overflowed."""
    more, equal = over, ~over
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            more = more | (equal & counters[k])
            equal = equal & ~counters[k]
    return more


def forest(values, radius: int):
    """Pairs (value, root): a spanning star for each component of two or more of the distinct values."""
    import numpy as np

    n = len(values)
    planes = planes_of(values)
    root = np.full(n, -1, np.int64)
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed] = seed
        frontier = np.array([seed])
        while len(frontier):
            reached = []
            for at in range(0, len(frontier), 64):
                mask = close(planes, values[frontier[at : at + 64]], radius)[:, :n].any(axis=0) & (root < 0)
                new = np.flatnonzero(mask)
                root[new] = seed
                reached.append(new)
            frontier = np.concatenate(reached)
    linked = np.flatnonzero(root != np.arange(n))
    return values[linked], values[root[linked]]


def small_links(values, starts, sizes, radius: int):
    """Links inside many small groups at once: the pairs' differences are bit-sliced against zero."""
    import numpy as np

    left, right = [], []
    for size in np.unique(sizes):
        i, j = np.triu_indices(size, 1)
        at = starts[sizes == size][:, None]
        left.append((at + i).ravel())
        right.append((at + j).ravel())
    left, right = np.concatenate(left), np.concatenate(right)
    linked = close(planes_of(values[left] ^ values[right]), np.zeros(1, np.uint64), radius)[0, : len(left)]
    parent: dict[int, int] = {}
    for a, b in zip(left[linked].tolist(), right[linked].tolist(), strict=True):
        while parent.get(a, a) != a:
            a = parent[a]
        while parent.get(b, b) != b:
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
    child = np.fromiter(parent.keys(), np.int64, len(parent))
    return values[child], values[np.fromiter(parent.values(), np.int64, len(parent))]


def _compare_groups(radius: int):
    """mapInArrow over rows (key, fp) sorted by key: yields links (a, b)."""

    def links(fps, key_starts, sizes):
        import numpy as np

        out, small = [], (sizes >= 2) & (sizes <= SMALL_GROUP)
        at = np.flatnonzero(small)
        for k in range(0, len(at), 2048):
            out.append(small_links(fps, key_starts[at[k : k + 2048]], sizes[at[k : k + 2048]], radius))
        for s, n in zip(key_starts[sizes > SMALL_GROUP], sizes[sizes > SMALL_GROUP], strict=True):
            out.append(forest(fps[s : s + n], radius))
        return out

    def run(batches):
        import numpy as np

        held_keys, held = [], []
        for batch in batches:
            keys, fps = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            held_keys, held = held_keys + keys, [*held, fps]
            # the last group may go on in the next batch
            last = next((k for k in range(len(held_keys) - 1, -1, -1) if held_keys[k] != held_keys[-1]), -1) + 1
            if last:
                every = np.concatenate(held)
                yield from _told(links, held_keys[:last], every[:last])
                held_keys, held = held_keys[last:], [every[last:]]
        if held_keys:
            yield from _told(links, held_keys, np.concatenate(held))

    def _told(links, keys, fps):
        import numpy as np
        import pyarrow as pa

        starts = np.array([0] + [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], np.int64)
        sizes = np.diff(np.append(starts, len(keys)))
        for a, b in links(fps, starts, sizes):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def _bits(low: int, width: int):
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))


def links(distinct: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links that join all fingerprints of `distinct` (fp) within the radius, as spanning forests of buckets.

    Blocks are cut for radius 2 and less: the same buckets hold all links of a smaller radius.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the bucket scheme covers a radius of 0 to 2")
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    first = [F.struct(F.lit(n).alias("cut"), F.concat_ws(".", F.lit(n), _bits(16 * i, 16), _bits(16 * j, 16)).alias("key")) for n, (i, j) in enumerate(pairs)]
    level = distinct.select("fp", F.explode(F.array(*first)).alias("c")).select("fp", "c.cut", "c.key")
    free = {n: [b for k in range(4) if k not in p for b in range(16 * k, 16 * k + 16)] for n, p in enumerate(pairs)}
    found = None
    depth = 0
    while True:
        counts = level.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        shared = materialize(level.join(counts, "key"), f"buckets-{depth}")
        last = max(map(len, free.values())) <= 14
        compare = shared if last else shared.filter(F.col("n") <= bucket_rows)
        dealt = compare.select("key", "fp").repartition(partitions(distinct.sparkSession), "key").sortWithinPartitions("key")
        here = dealt.mapInArrow(_compare_groups(radius), "a long, b long")
        found = here if found is None else found.unionByName(here)
        over = shared.filter(F.col("n") > bucket_rows)
        if last or over.isEmpty():
            return found.distinct()
        cuts, below = [], {}
        for n, bits in free.items():
            for third in range(3):
                own = bits[third::3]
                value = sum((_bits(b, 1) * (1 << k) for k, b in enumerate(own)), F.lit(0))
                cut = n * 3 + third
                below[cut] = [b for b in bits if b not in own]
                cuts.append(F.when(F.col("cut") == n, F.struct(F.lit(cut).alias("cut"), F.concat_ws("/", "key", F.lit(third), value).alias("key"))))
        level = over.select("fp", F.explode(F.filter(F.array(*cuts), lambda x: x.isNotNull())).alias("c")).select("fp", "c.cut", "c.key")
        free, depth = below, depth + 1


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for all ends of edges (a, b): root is the smallest id reachable, by the star contraction of identities."""
    return representatives(edges.select("a", "b")).withColumnsRenamed({"vid": "v", "rep": "root"})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id.

    A-Z are lower-cased; words are runs without space or the controls 9 to 13; texts with fewer words than a shingle hash
    as one sequence; null and empty texts have the fingerprint zero and link like any other. component_id is the smallest
    id reachable through links of at most radius differing bits, the row's own included. Rows with a null id take part,
    but null is never a component_id unless all ids of the component are null. Rows that repeat share their component;
    other columns are not read; an empty table gives an empty result.
    """
    with rounds() as keep:
        fps = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints", keep)
        distinct = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
        tree = materialize(components(links(distinct.select("fp"), radius, bucket_rows)), "tree")
        rooted = distinct.join(sent(tree), F.col("fp") == F.col("v"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        # only fingerprints of some component of two or more have another least id than their own
        least = materialize(distinct.join(sent(tree), F.col("fp") == F.col("v")).groupBy("root").agg(F.min("least").alias("component_id")), "least")
        named = rooted.join(sent(least), "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
        named = materialize(named, "named", keep)
    return fps.join(named, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- links by similarity ------------------------------------------------------------------------------------------------

COPY_WORDS, SIMILARITY = 5, 0.8
#: Blocks agree in BAND_ROWS min-hashes; a pair at similarity j misses all BANDS with a probability of (1 - j**BAND_ROWS)**BANDS:
#: 0.0018 at 0.8, 0.00014 at 0.85, 0.000003 at 0.9. This needs independent functions.
BANDS, BAND_ROWS = 12, 4
#: SimHashes of distinct shingles differ in 10 bits with a deviation of 3 at similarity 0.8: 2 to 9 in a million such pairs
#: are further apart than this, 120 in a million where the sets have 4 and 5 shingles.
COPY_RADIUS = 24
#: Distinct shingle sets compared in one task and the bytes of their shingles; a larger block is cut into tiles.
TILE_ROWS, TILE_BYTES = 4096, 32 << 20


@lru_cache(maxsize=1)
def band_seeds():
    """One seed for each min-hash function."""
    import numpy as np
    import xxhash

    return np.array([xxhash.xxh64_intdigest(k.to_bytes(8, "little"), SEED) for k in range(BANDS * BAND_ROWS)], np.uint64)


def band_keys(distinct) -> list[int]:
    """The keys of a set's bands: each min-hash function xors its own seed in and mixes all 64 bits (the finaliser of MurmurHash3)."""
    import numpy as np
    import xxhash

    seeds, half = band_seeds(), np.uint64(33)
    least = np.full(len(seeds), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(distinct), 1024):
        x = distinct[at : at + 1024, None] ^ seeds
        x ^= x >> half
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> half
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> half
        np.minimum(least, x.min(0), out=least)
    return [xxhash.xxh64_intdigest(bytes([k]) + least[k * BAND_ROWS : (k + 1) * BAND_ROWS].tobytes(), SEED) for k in range(BANDS)]


def sketch(text: str | None, words: int = COPY_WORDS):
    """(identity of the shingle set, SimHash of its members, band keys, sorted 32-bit shingle hashes) of a whole text.

    Texts with fewer words than a shingle have one shingle, the whole sequence; without words the set is empty.
    """
    import numpy as np
    import xxhash

    w = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if not w:
        return digest(b"", SEED), 0, [], np.zeros(0, np.uint32)
    shingles = zip(*(w[k:] for k in range(words)), strict=False) if len(w) >= words else [w]
    hashes = np.array([digest(b" ".join(s), SEED) for s in shingles], np.uint64)
    distinct = np.unique(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(distinct), SHINGLE_BATCH):
        counts += np.unpackbits(distinct[at : at + SHINGLE_BATCH].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    simhash = int.from_bytes(np.packbits(counts * 2 > len(distinct), bitorder="little").tobytes(), "little")
    return digest(distinct.tobytes(), SEED), simhash, band_keys(distinct), np.unique((distinct >> np.uint64(32)).astype(np.uint32))


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        signed = lambda v: np.array(v, np.uint64).view(np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = [sketch(x, words) for x in batch.column(1).slice(at, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 512), batch.column(2).slice(at, 512), pa.array(signed([f[0] for f in found])), pa.array(signed([f[1] for f in found])), pa.array([signed(f[2]) for f in found], pa.list_(pa.int64())), pa.array([f[3].tobytes() for f in found], pa.binary())],
                    names=["id", "sha", "s", "fp", "bands", "shingles"],
                )

    return map_batches(docs.select(id_col, text_col, text_digest(F.col(text_col))), run, f"id {kind}, sha binary, s long, fp long, bands array<long>, shingles binary")


def similar_forest(fps, sets, similarity: float, radius: int, left=None, known=None):
    """Index pairs (i, root): a spanning forest of the links between sets of at least the similarity.

    Members close by fingerprint are confirmed by their sets. With `left` (a mask) only links between its two sides and
    inside neither are asked for, as a tile pair needs them, and none between members whose `known` component is the same.
    A member is compared with those not yet in its component.
    """
    import numpy as np

    n, planes = len(fps), planes_of(fps)
    sizes = np.array([len(x) for x in sets])
    root = np.full(n, -1, np.int64)
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed], frontier = seed, [seed]
        while frontier:
            batch, frontier = frontier[:64], frontier[64:]
            masks = close(planes, fps[batch], radius)[:, :n]
            for i, mask in zip(batch, masks, strict=True):
                few, many = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
                mask = mask & (root < 0) & (few >= similarity * many)
                if left is not None:
                    mask &= (left != left[i]) & (known != known[i])
                for j in np.flatnonzero(mask).tolist():
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both >= similarity * (sizes[i] + sizes[j] - both):
                        root[j] = seed
                        frontier.append(j)
    linked = np.flatnonzero(root != np.arange(n))
    return linked, root[linked]


def _compare_blocks(similarity: float, radius: int, across: bool):
    """mapInArrow over rows (key, side, known, s, fp, shingles) sorted by key: yields links (a, b); across: only between sides."""

    def told(rows):
        import numpy as np
        import pyarrow as pa

        side, known = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.int64)
        if across and side.all() == side.any():
            return
        ids, fps = np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64).view(np.uint64)
        sets = [np.frombuffer(r[5], np.uint32) for r in rows]
        i, j = similar_forest(fps, sets, similarity, radius, *((side, known) if across else ()))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])

    def run(batches):
        held = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield from told(held) if len(held) > 1 else ()
                    held = []
                held.append(row)
        if len(held) > 1:
            yield from told(held)

    return run


def copy_links(sets: DataFrame, similarity: float = SIMILARITY, tile_rows: int = TILE_ROWS, radius: int = COPY_RADIUS) -> DataFrame:
    """(a, b): links that join all of `sets` (s, fp, bands, shingles; s may repeat) that agree in a band and are similar.

    The shingles of sets that share no block with another are never shuffled.
    A block within TILE_ROWS and TILE_BYTES is compared in one task. A larger one is cut by classes of set size, of which
    only a class and its neighbours can hold similar sets, and these into tiles. Each tile is compared in itself first.
    Then tiles meet pairwise, without the members that are known by now to be of the component that fills the other tile;
    so a block of one large group of copies is done after the first pass. Nothing is left out.
    """
    spark = sets.sparkSession
    once = sets.select("s", F.octet_length("shingles").alias("bytes"), "bands").dropDuplicates(["s"])
    banded = materialize(once.select("s", "bytes", F.explode("bands").alias("key")), "banded")
    tiles = F.greatest(F.ceil(F.col("n") / tile_rows), F.ceil(F.col("bytes") / TILE_BYTES))
    blocks = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.sum(F.xxhash64("s").cast("decimal(20,0)")).alias("sum")).filter("n > 1")
    # blocks with the same members are compared once
    blocks = blocks.groupBy("n", "sum").agg(F.min("key").alias("key"), F.max("bytes").alias("bytes")).select("key", (tiles > 1).alias("large"))
    # wider by a hair than the ratio of sizes that may be similar, so that rounding never parts two by more than a class
    size_class = F.floor(F.log(F.col("bytes") / 4) / (-math.log(similarity) * (1 + 1e-9))).cast("int").alias("c")
    members = materialize(banded.join(sent(materialize(blocks, "blocks")), "key").select("key", "large", "s", "bytes", size_class), "members")

    compared = sent(materialize(members.select("s").distinct(), "compared"))
    whole = materialize(sets.select("s", "fp", "shingles").join(compared, "s", "left_semi").dropDuplicates(["s"]), "sets")

    def compare(rows: DataFrame, across: bool) -> DataFrame:
        full = rows.join(whole, "s").select(F.xxhash64("group").alias("key"), "side", "known", "s", "fp", "shingles")
        full = full.repartition(partitions(spark), "key").sortWithinPartitions("key")
        return map_batches(full, _compare_blocks(similarity, radius, across), "a long, b long").distinct()

    inside = lambda *unit: [F.struct("key", *unit).alias("group"), F.lit(False).alias("side"), F.lit(0).cast("long").alias("known"), F.col("s")]
    small = members.filter("not large").select(*inside(F.lit(0).alias("c"), F.lit(0).alias("sub")))
    large = members.filter("large")
    if large.isEmpty():
        return compare(small, False)
    subs = large.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).select("key", "c", tiles.alias("subs"))
    large = large.join(sent(materialize(subs, "tiles")), ["key", "c"]).select("key", "c", F.pmod(F.xxhash64("s"), F.col("subs")).cast("int").alias("sub"), "s")
    large = materialize(large, "large-blocks")
    first = materialize(compare(small.unionByName(large.select(*inside("c", "sub"))), False), "links-in-tiles")
    tree = components(first)
    large = materialize(large.join(tree, F.col("s") == F.col("v"), "left").select("key", "c", "sub", "s", F.coalesce("root", "s").alias("known")), "known")
    units = large.groupBy("key", "c", "sub").agg(F.min("known").alias("low"), F.max("known").alias("high"))
    units = units.groupBy("key").agg(F.collect_list(F.struct("c", "sub", F.when(F.col("low") == F.col("high"), F.col("low")).alias("all"))).alias("units"), F.min("low").alias("low"), F.max("high").alias("high"))
    units = materialize(units.filter("low <> high").select("key", "units"), "open-blocks")
    own = F.struct("c", "sub")
    meets = lambda u: (F.abs(u["c"] - F.col("c")) <= 1) & (F.struct(u["c"].alias("c"), u["sub"].alias("sub")) != own) & (u["all"].isNull() | (u["all"] != F.col("known")))
    across = large.join(sent(units), "key").withColumn("u", F.explode(F.filter("units", meets))).withColumns({"own": own, "other": F.struct("u.c", "u.sub")})
    across = across.select(F.struct("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("group"), (F.col("own") > F.col("other")).alias("side"), "known", "s")
    return first.unionByName(compare(across, True)).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = COPY_WORDS, similarity: float = SIMILARITY, tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row per row of docs: id_col, component_id, shingle_set.

    Texts link when the sets of their shingles of `words` words have a Jaccard similarity of at least `similarity`; A-Z are
    lower-cased. Texts with equal sets always link; null, empty and blank texts all have the empty set and link. component_id
    is the smallest id reachable. Other columns are not read; an empty table gives an empty result.
    """
    with rounds() as keep:
        found = materialize(_copies(docs, id_col, text_col, words, similarity, tile_rows), "near-copies", keep)
    return found.select(F.col("id").alias(id_col), "component_id", F.col("s").alias("shingle_set"))


def _copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = COPY_WORDS, similarity: float = SIMILARITY, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(id, sha, s, root, component_id, alone) of each row of docs; root is one shingle set of the component and names it.

    Most rows are alone in their component, so only the others are joined: the sets that link, and those of several rows.
    """
    found = materialize(sketches(docs, id_col, text_col, words), "sketches")
    tree = materialize(components(copy_links(found, similarity, tile_rows)), "tree")
    sets = found.groupBy("s").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
    linked = sets.join(sent(tree), F.col("s") == F.col("v"), "left").filter("rows > 1 or root is not null").select("s", "least", F.coalesce("root", "s").alias("root"))
    linked = materialize(linked, "linked")
    least = materialize(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = materialize(linked.join(sent(least), "root").select("s", "root", "component_id"), "named")
    joined = found.select("id", "sha", "s").join(sent(named), "s", "left")
    return joined.select("id", "sha", "s", F.coalesce("root", "s").alias("root"), F.coalesce("component_id", "id").alias("component_id"), F.col("root").isNull().alias("alone"))


def text_digest(text: Column) -> Column:
    """SHA-256 of the text as it is, as bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """docs with its own columns: of each component of near_copies() one row stays, that with the smallest id.

    Null ids lose to any other. Where several texts of a component have that id, the smallest shingle set and digest decide;
    of rows that repeat in id and text one stays. Texts that are no near copies stay whatever ids they share. What goes is
    joined against the texts, not what stays, so they are not shuffled while that fits common.BROADCAST_ROWS.
    """
    with rounds() as keep:
        found = _copies(docs, id_col, text_col, **more).filter("not alone")
        told = materialize(found.groupBy("root", "id", "s", "sha").agg(F.count(F.lit(1)).alias("n")), "in-components")
        mark = F.struct(F.col("id").isNull().alias("last"), "id", "s", "sha")
        first = materialize(told.groupBy("root").agg(F.min(mark).alias("f")), "first")
        told = told.join(sent(first), "root").select("id", "sha", "n", mark.eqNullSafe(F.col("f")).alias("stays"))
        told = materialize(told, "told", keep)
    return without(docs, F.col(id_col), text_digest(F.col(text_col)), told)
