"""SimHash near-dedup by meet-in-the-middle ball hashing.

Blocks of fingerprint bits that differ in at most 2 * half bits have a common variant within `half` flips of each. Every
distinct block goes to each bucket (the first bits of a variant) that one of its variants falls into, and the bucket makes
those variants there, so the shuffle carries one row for a bucket rather than one for a variant. A bucket that would make
more than HOT variants is parted by the next STEP bits, again and again, as its rows have flips left for them, so a row is
never sent to a part where it has no variant.

`near_groups` takes the 64-bit fingerprint as one block: what meets on a variant links to the least that does, which is
within the distance by construction and is verified. Components follow by star contraction.

`near_dedup` looks for texts whose sets of five-word shingles have a Jaccard similarity of SIMILARITY or more, at which a
64-bit fingerprint differs in ten bits, too many for one ball. Its fingerprints have 256 bits, of which each of TABLES blocks
takes 32 (the first EXACT of them unflipped). What meets on a variant is compared by all 256 bits (LOOSE at most). Where many
meet, a bucket compares some of them first, keeps a least spanning forest of what is near and marks the texts of which pairs
were left out. Of these candidates, each round takes the nearest ones of every text that lead out of its component, verifies
them on the whole sets of shingles and joins components, until none is left untested. Then marked texts meet again: all their
pairs of different components are compared, and a forest of those that are near joins texts to clumps. The sets of a clump meet in
one place, or in blocks of CLUMP bytes two at a time, where those of all pairs that could be similar are compared and a forest of
those that are is told. So every pair that meets and is near is verified or lies within a component, and no step has a row for
each pair; sets of a clump of k blocks are sent k times.

Words are runs of bytes other than space and \\t to \\r, after lower-casing A-Z; shingles of `near_groups` are SHINGLE words,
repeats included; fewer words make one shingle. Cases: null, empty and blank texts have fingerprint 0 and are linked like any
other; in `near_dedup` they are copies of each other and of nothing else. Null ids take part; a component whose ids are all
null has a null id. `near_groups` repeats repeated rows, `near_dedup` keeps one row of a component; very long texts are
hashed in blocks; other columns, whatever their names, are ignored by `near_groups` and kept by `near_dedup`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, mixed, per_document, slices, small, written
from .components import anew, components
from .exact import numbered

SHINGLE, HALF = 4, 2
COPY_SHINGLE, SIMILARITY = 5, 0.8
TABLES, BLOCK, EXACT = 64, 32, 8  #: blocks of a 256-bit fingerprint, their bits, and how many of those aren't flipped
LOOSE = 56  #: bits of 256 in which candidates differ at most; texts of similarity 0.8 differ in 39, with a deviation of 6
VARIANTS = 1 << 21  #: of an average bucket, and of a slice of a large one
HOT = 1 << 24  #: variants beyond which a bucket is parted
STEP = 6  #: bits by which it is parted at a time
BESIDE = 16  #: neighbours that are compared first in a long run of equal variants
DENSE = 8  #: near pairs for each fingerprint beyond which a bucket keeps a forest of them first
HOT_BLOCK = 1 << 22  #: as HOT, for the blocks of 256-bit fingerprints, of which a bucket holds more at a time
COMPARED = 1 << 17  #: pairs whose fingerprints are compared at a time
CLUMP = 8 << 20  #: bytes of sets of a block of a clump


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """A signed 64-bit number: bit k is set if it is in over half of the shingles' hashes."""
    w = text.lower().split() if text else []
    if not w:
        return 0
    joined = b" ".join(w)
    ends = list(accumulate(len(x) + 1 for x in w))
    starts = [0, *ends[: max(0, len(w) - shingle)]]
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for k in range(0, n, 1 << 16):
        hashes = [digest(joined[a : b - 1], 42) for a, b in zip(starts[k : k + (1 << 16)], ends[min(shingle, len(w)) - 1 + k :])]
        total += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n).view(">i8")[0])


def flips(bits: int, most: int) -> np.ndarray:
    """All numbers of `bits` bits with at most `most` set."""
    found = level = [0]
    for _ in range(most):
        level = [m | 1 << k for m in level for k in range((m.bit_length() if m else 0), bits)]
        found = found + level
    return np.array(found, np.uint64)


def ball(bits: int, most: int) -> int:
    return sum(math.comb(bits, k) for k in range(most + 1))


def dealt(rows: DataFrame, width: int, exact: int, half: int, bits: int, hot: int) -> DataFrame:
    """Rows (with `table` and `block`, of `width` bits) for each bucket (table, depth, prefix) that a variant falls into."""

    def masks(start: int, n: int, most: int):
        return F.array(*[F.struct(F.lit(int(m)).alias("mask"), F.lit(int(m).bit_count()).alias("flips")) for m in flips(max(0, min(n, start + n - exact)), most)])

    first = rows.withColumn("ball", F.explode(masks(0, bits, half)))
    now = first.withColumns({"prefix": F.shiftrightunsigned("block", width - bits).bitwiseXOR(F.col("ball.mask")), "left": half - F.col("ball.flips")}).drop("ball")
    done, depth = [], bits
    while True:
        made = F.element_at(F.array(*[F.lit(ball(min(width - depth, width - exact), k)) for k in range(half + 1)]), F.col("left") + 1)
        large = now.groupBy("table", "prefix").agg(F.sum(made).alias("made")).where(F.col("made") > hot).select("table", "prefix", F.lit(True).alias("large"))
        if depth + STEP > width or large.isEmpty():
            done.append(now.withColumn("depth", F.lit(depth)))
            break
        both = now.join(small(large), ["table", "prefix"], "left")
        done.append(both.where("large IS NULL").drop("large").withColumn("depth", F.lit(depth)))
        nexts = F.shiftrightunsigned("block", width - depth - STEP).bitwiseAND(F.lit((1 << STEP) - 1))
        part = both.where("large").drop("large").withColumn("ball", F.explode(F.element_at(F.array(*[masks(depth, STEP, k) for k in range(half + 1)]), F.col("left") + 1)))
        prefix = F.shiftleft("prefix", STEP).bitwiseOR(nexts.bitwiseXOR(F.col("ball.mask")))
        now, depth = part.withColumns({"prefix": prefix, "left": F.col("left") - F.col("ball.flips")}).drop("ball"), depth + STEP
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("left")


def meetings(blocks: np.ndarray, width: int, exact: int, half: int, prefix: int, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In slices: runs of equal variants in the bucket as run numbers (ascending) and places in `blocks` (ascending in a run).

    Only runs of two members or more are told."""
    rest = width - depth
    top = np.bitwise_count((blocks >> np.uint64(rest)) ^ np.uint64(prefix)) if depth else np.zeros(len(blocks), np.int64)
    low = blocks & np.uint64((1 << rest) - 1)
    parts = [(np.flatnonzero(top == j), flips(min(rest, width - exact), half - j)) for j in range(half + 1)]
    total = sum(len(i) * len(m) for i, m in parts)
    inner = max(1, -(-total // (2 * VARIANTS)))
    for part in range(inner):
        variants, who = [], []
        for index, masks in parts:
            step = max(1, VARIANTS // max(1, len(index)))
            for k in range(0, len(masks), step):
                v = (low[index][None, :] ^ masks[k : k + step, None]).ravel()
                w = np.tile(index, len(masks[k : k + step]))
                if inner > 1:
                    mine = mixed(v) % np.uint64(inner) == part
                    v, w = v[mine], w[mine]
                variants.append(v)
                who.append(w)
        v, w = np.concatenate(variants), np.concatenate(who)
        values = np.sort(v)
        twice = np.unique(values[1:][values[1:] == values[:-1]])
        if not len(twice):
            continue
        at = np.searchsorted(twice, v)
        at[at == len(twice)] = 0
        met = twice[at] == v
        order = np.lexsort((w[met], at[met]))
        yield at[met][order], w[met][order]


def links_in_bucket(fps: np.ndarray, bucket: int, bits: int, half: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links between distinct, ascending fingerprints that have a common variant in the bucket: to the least of a variant."""
    found = [np.zeros(0, np.int64)]
    for run, who in meetings(fps, width, 0, half, bucket, bits):
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        least = np.repeat(who[first], np.diff(np.append(first, len(run))))
        found.append(np.unique((least * len(fps) + who)[least != who]))
    pairs = np.unique(np.concatenate(found))
    a, b = (fps[pairs // len(fps)], fps[pairs % len(fps)]) if len(fps) else (fps, fps)
    near = np.bitwise_count(a ^ b) <= 2 * half
    return a[near], b[near]


def links(distinct: DataFrame, half: int = HALF, bits: int | None = None) -> DataFrame:
    """a, b: links between the fingerprints of column fp that connect all those within 2 * half bits."""
    if bits is None:
        bits = max(4, math.ceil(math.log2(max(1, distinct.count()) * ball(64, half) / VARIANTS + 1)))
        bits = min(bits, 24)  # more first bits only make buckets smaller; those that are too large are parted anyhow

    def meet(bucket: pa.Table) -> pa.Table:
        fps = np.unique(bucket["fp"].to_numpy().view(np.uint64))
        a, b = links_in_bucket(fps, bucket["prefix"][0].as_py(), bucket["depth"][0].as_py(), half)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    rows = dealt(distinct.select("fp", F.lit(0).alias("table"), F.col("fp").alias("block")), 64, 0, half, bits, HOT)
    return rows.select("fp", "depth", "prefix").groupBy("depth", "prefix").applyInArrow(meet, "a long,b long")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, half: int = HALF) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least id of the component)."""
    marked = written(per_document(docs, "doc_id long,fp long", lambda _, texts: {"fp": [fingerprint(t, shingle) for t in texts]}), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), half))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id")).select(anew("root"), "component_id")
    found = marked.join(rooted.join(ids, "root").select("fp", "component_id"), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# texts of high similarity


def shingle_sets(texts: list[bytes | None], shingle: int = COPY_SHINGLE) -> list[np.ndarray]:
    """For each text the ascending hashes of its distinct shingles."""
    numbers: dict[bytes, int] = {}
    coded = [[numbers.setdefault(x, len(numbers)) for x in t.lower().split()] if t else [] for t in texts]
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in numbers], np.uint64)
    out = []
    for c in coded:
        h = hashes[c] if c else np.zeros(0, np.uint64)
        key = mixed(h)
        for n in range(1, min(shingle, len(h))):
            key = mixed(key[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[n:])
        out.append(np.unique(key))
    return out


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """256 bits as 4 numbers; zero without shingles."""
    total = np.zeros(256, np.int64)
    for k in range(0, len(hashes), 255 * 256):
        part = hashes[k : k + 255 * 256]
        words = np.stack([mixed(part + np.uint64(0x9E3779B97F4A7C15 * j % 2**64)) for j in range(1, 5)], axis=1)
        bits = np.unpackbits(words.view(np.uint8), axis=1)
        whole = len(bits) // 255 * 255
        total += bits[:whole].reshape(-1, 255, 256).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(hashes)).view(np.uint64)


def taken_bits(table: int) -> np.ndarray:
    """The bits of 256 that a table's block takes."""
    return np.random.RandomState(table).permutation(256)[:BLOCK]


def bits_of(prints: np.ndarray) -> np.ndarray:
    """The 256 bits of each fingerprint (rows of 4 numbers), a byte each."""
    return np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(-1, 32), axis=1)


def blocks_of(bits: np.ndarray, table: int) -> np.ndarray:
    """The table's block of each fingerprint's bits."""
    return np.ascontiguousarray(np.packbits(bits[:, taken_bits(table)], axis=1)).view(">u4").ravel().astype(np.uint64)


def spanning(n: int, a: np.ndarray, b: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Places of the edges over nodes 0 to n - 1, taken in order, that join two trees of a forest.

    Edges are looked at in blocks; those inside a tree that stood before the block are left out at once."""
    parent, label, kept = list(range(n)), np.arange(n), []

    def find(x: int) -> int:
        while (up := parent[x]) != x:
            parent[x] = x = parent[up]
        return x

    for k in range(0, len(a), step):
        x, y = a[k : k + step], b[k : k + step]
        left = np.flatnonzero(label[x] != label[y])
        for at, p, q in zip(left.tolist(), x[left].tolist(), y[left].tolist()):
            if (p := find(p)) != (q := find(q)):
                parent[max(p, q)] = min(p, q)
                kept.append(k + at)
        if len(left):
            label = np.array(parent)
            while (up := label[label]).tobytes() != label.tobytes():
                label = up
    return np.array(kept, np.int64)


def apart_of(prints: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bits in which the fingerprints at places a and b differ."""
    out = np.zeros(len(a), np.int16)
    for k in range(0, len(a), COMPARED):
        out[k : k + COMPARED] = np.bitwise_count(prints[a[k : k + COMPARED]] ^ prints[b[k : k + COMPARED]]).sum(axis=1)
    return out


def candidates_in_bucket(prints: np.ndarray, table: int, prefix: int, depth: int, half: int = 1, loose: int = LOOSE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of near fingerprints that meet in the bucket, the bits in which they differ, and places of those with pairs left out.

    In a run of equal variants each is compared with the first and with the BESIDE that follow it; if over DENSE pairs for each
    fingerprint are near, those of a least spanning forest are told. `others_in_bucket` tells the pairs that this leaves out."""
    n, found, rest = len(prints), [np.zeros(0, np.int64)], np.zeros(len(prints), bool)
    for run, who in meetings(blocks_of(bits_of(prints), table), BLOCK, EXACT, half, prefix, depth):
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        size = np.diff(np.append(first, len(run)))
        least = np.repeat(who[first], size)
        rest[who[np.repeat(size > BESIDE + 1, size)]] = True
        found.append(np.unique((least * n + who)[least != who]))
        for k in range(1, min(BESIDE, len(run) - 1) + 1):
            same = run[k:] == run[:-k]
            if not same.any():
                break
            found.append(np.unique(who[:-k][same] * n + who[k:][same]))
    pairs = np.unique(np.concatenate(found))
    a, b = pairs // max(1, n), pairs % max(1, n)
    apart = apart_of(prints, a, b)
    near = np.flatnonzero(apart <= loose)
    if len(near) > DENSE * len(np.unique(np.append(a[near], b[near]))):
        near = near[np.argsort(apart[near], kind="stable")]
        forest = spanning(n, a[near], b[near])
        out = np.delete(near, forest)
        rest[a[out]] = rest[b[out]] = True
        near = near[forest]
    return a[near], b[near], apart[near].astype(np.int64), np.flatnonzero(rest)


def others_in_bucket(prints: np.ndarray, roots: np.ndarray, sizes: np.ndarray, similarity: float, table: int, prefix: int, depth: int, half: int = 1, loose: int = LOOSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `candidates_in_bucket`, a spanning forest of all near pairs of different roots; sets of these sizes must be able to have
    the similarity. Pairs that the forest joins already aren't compared."""
    n, kept, tree = len(prints), [np.zeros(0, np.int64)], np.arange(len(prints))
    for run, who in meetings(blocks_of(bits_of(prints), table), BLOCK, EXACT, half, prefix, depth):
        order = np.lexsort((roots[who], run))
        run, who = run[order], who[order]
        new_run = np.append(True, run[1:] != run[:-1])
        new_root = new_run | np.append(True, roots[who[1:]] != roots[who[:-1]])
        end = lambda new: np.append(np.flatnonzero(new), len(run))[np.cumsum(new)]  # noqa: E731, B023
        after, count = end(new_root), end(new_run) - end(new_root)
        total = np.cumsum(count)
        for k in range(0, int(total[-1]), COMPARED):  # each with those of the run behind its own root
            t = np.arange(k, min(k + COMPARED, int(total[-1])))
            x = np.searchsorted(total, t, "right")
            a, b = who[x], who[after[x] + t - (total[x] - count[x])]
            able = (tree[a] != tree[b]) & (np.minimum(sizes[a], sizes[b]) >= similarity * np.maximum(sizes[a], sizes[b]))
            a, b = a[able], b[able]
            near = apart_of(prints, a, b) <= loose
            a, b = a[near], b[near]
            if len(a):
                forest = spanning(n, tree[a], tree[b])
                kept.append(np.minimum(a, b)[forest] * n + np.maximum(a, b)[forest])
                tree = joined(tree, tree[a[forest]], tree[b[forest]])
    pairs = np.sort(np.concatenate(kept))
    a, b = pairs // max(1, n), pairs % max(1, n)
    return a, b, apart_of(prints, a, b).astype(np.int64)


def joined(tree: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The tree (named by a place) of each place, once edges join those named in a and b."""
    up = list(range(len(tree)))

    def find(x: int) -> int:
        while (above := up[x]) != x:
            up[x] = x = up[above]
        return x

    for x, y in zip(map(find, a.tolist()), b.tolist()):
        y = find(y)
        up[max(x, y)] = min(x, y)
    label = np.array(up)
    while ((over := label[label]) != label).any():
        label = over
    return label[tree]


def alike_in_clump(sets: list[np.ndarray], roots: np.ndarray, similarity: float, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of sets of at least this similarity that join what all such pairs of different roots (and sides, if given) join.

    Two such sets have one of their rarest elements in common: of n, all but similarity * n, and one. So only sets that share
    one of those are compared, each with those before it that aren't joined to it yet."""
    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(sizes)
    _, element, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    element = rank[element]
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((element, owner))
    element = element[order]
    rare = np.arange(len(element)) - (ends - sizes)[owner] <= (sizes - np.ceil(similarity * sizes - 1e-9))[owner]
    posts = np.lexsort((owner[rare], element[rare]))
    held, of = owner[rare][posts], element[rare][posts]
    tree = np.unique(roots, return_index=True)[1][np.unique(roots, return_inverse=True)[1]]
    kept, mine = [], np.zeros(len(often), bool)
    for x in range(1, len(sets)):
        own = element[ends[x] - sizes[x] : ends[x]]
        first = own[rare[ends[x] - sizes[x] : ends[x]]]
        starts, stops = np.searchsorted(of, first), np.searchsorted(of, first, "right")
        met = [held[i:j] for i, j in zip(starts.tolist(), stops.tolist()) if j > i + 1]
        if not met:
            continue
        y = np.unique(np.concatenate(met))
        y = y[y < x]
        y = y[(tree[y] != tree[x]) & (np.minimum(sizes[y], sizes[x]) >= similarity * np.maximum(sizes[y], sizes[x]))]
        if sides is not None:
            y = y[sides[y] != sides[x]]
        if not len(y):
            continue
        mine[own] = True
        starts = np.cumsum(sizes[y]) - sizes[y]
        both = np.add.reduceat(mine[element[np.repeat(ends[y] - sizes[y] - starts, sizes[y]) + np.arange(sizes[y].sum())]], starts, dtype=np.int64)
        mine[own] = False
        for z in y[both >= similarity * (sizes[y] + sizes[x] - both)].tolist():
            if tree[z] != tree[x]:
                kept.append((z, x))
                tree[tree == tree[x]] = tree[z]
    found = np.array(kept, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


_PRINT = ["p0", "p1", "p2", "p3"]


def _as_prints(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.stack([np.asarray(table.column(c)).view(np.uint64) for c in _PRINT], axis=1)


def _marks(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column(1).to_pylist(), shingle)
                prints = np.stack([wide_fingerprint(s) for s in sets])
                sums = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                columns = [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(sums.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(np.ascontiguousarray(prints[:, j]).view(np.int64)) for j in range(4)]], names=["row", "doc_id", "shingles", "sums", *_PRINT])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = bits_of(_as_prints(batch))
        for table in range(TABLES):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(bits), table, np.int32)), pa.array(blocks_of(bits, table).view(np.int64))], names=[*batch.schema.names, "table", "block"])


def _meet(bucket: pa.Table) -> pa.Table:
    """Candidates, and those with pairs left out as pairs with themselves."""
    nodes = bucket["node"].to_numpy()
    a, b, apart, rest = candidates_in_bucket(_as_prints(bucket.combine_chunks()), *[bucket[c][0].as_py() for c in ("table", "prefix", "depth")])
    ends = np.append(nodes[a], nodes[rest]), np.append(nodes[b], nodes[rest])
    return pa.table({"a": np.minimum(*ends), "b": np.maximum(*ends), "apart": np.append(apart, np.zeros(len(rest), np.int64))})


def _meet_others(similarity: float):
    def run(bucket: pa.Table) -> pa.Table:
        bucket = bucket.combine_chunks()
        nodes, roots, sizes = (bucket[c].to_numpy() for c in ("node", "root", "shingles"))
        a, b, apart = others_in_bucket(_as_prints(bucket), roots, sizes, similarity, *[bucket[c][0].as_py() for c in ("table", "prefix", "depth")])
        return pa.table({"a": np.minimum(nodes[a], nodes[b]), "b": np.maximum(nodes[a], nodes[b]), "apart": apart})

    return run


def _meet_clump(similarity: float):
    def run(clump: pa.Table) -> pa.Table:
        nodes, roots, blocks = (clump[c].to_numpy() for c in ("node", "root", "block"))
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in clump["hashes"]]
        a, b = alike_in_clump(sets, roots, similarity, None if clump["lo"][0].as_py() == clump["hi"][0].as_py() else blocks)
        return pa.table({"a": nodes[a], "b": nodes[b]})

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1).to_pylist(), shingle)], pa.binary())], names=["node", "hashes"])

    return run


def _similar(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike, pa.bool_())], names=["a", "b", "alike"])

    return run


def similar_components(candidates: DataFrame, sets: DataFrame, similarity: float, ways: int = 4) -> tuple[DataFrame, DataFrame]:
    """node, root: components by those of the candidates (a, b, apart) that have at least this similarity; and those (a, b).

    A round tests for each node the nearest candidates (of each of `ways` classes of partners) that lead to another component
    and weren't tested; the nearest are aggregated map-side, so a node with many candidates isn't gathered anywhere. As each round
    shuffles the sets, all that are left are tested once they are at most twice those of the last round, or fewer than one in ten
    of those were alike."""
    left, roots, tested_, every = candidates, None, None, False
    while roots is None or not left.isEmpty():
        if every:
            pairs = left.select("a", "b")
        else:
            ends = left.select(F.col("a").alias("node"), F.col("b").alias("other"), "apart").union(left.select("b", "a", "apart"))
            classes = [F.min(F.when(F.pmod(F.xxhash64("other"), F.lit(ways)) == k, F.struct("apart", "other"))).alias(f"n{k}") for k in range(ways)]
            nearest = ends.groupBy("node").agg(*classes).select("node", F.explode(F.filter(F.array(*[f"n{k}" for k in range(ways)]), lambda x: x.isNotNull())).alias("n"))
            pairs = nearest.select(F.least("node", "n.other").alias("a"), F.greatest("node", "n.other").alias("b")).distinct()
        with_a = pairs.join(sets.select(anew("node").alias("a"), F.col("hashes").alias("x")), "a")
        with_b = with_a.join(sets.select(anew("node").alias("b"), F.col("hashes").alias("y")), "b")
        tested = written(with_b.select("a", "b", "x", "y").mapInArrow(_similar(similarity), "a long,b long,alike boolean"), "tested")
        tested_ = tested if tested_ is None else tested_.union(tested)
        roots = components(tested_.where("alike").select("a", "b"))
        done = tested.count()
        if done == left.count():
            break
        last, left = left, written(apart_by(left.join(tested.select("a", "b"), ["a", "b"], "left_anti"), roots).select("a", "b", "apart"), "untested")
        forget(last)
        every = left.count() <= 2 * done or tested.where("alike").count() * 10 < done
    return roots, tested_.where("alike").select("a", "b")


def apart_by(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends lie in different components."""
    of = lambda end: roots.select(anew("node").alias(end), F.col("root").alias(f"root_{end}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))


def similar_in_clumps(members: DataFrame, sets: DataFrame, similarity: float, most: int = CLUMP) -> DataFrame:
    """a, b: pairs of nodes whose sets have at least this similarity, which join what all such pairs of a clump join.

    members: node, root, shingles, clump. Pairs of one root are left out. A clump of over `most` bytes of sets is dealt into blocks."""
    blocks = members.groupBy("clump").agg(F.expr(f"CAST(ceil(sum(shingles) * 8 / {most}) AS INT)").alias("blocks"))
    dealt_ = members.join(blocks, "clump").withColumn("block", F.expr("CAST(pmod(xxhash64(node), blocks) AS INT)")).join(sets.select(anew("node"), "hashes"), "node")
    pairs = dealt_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = pairs.select("clump", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "root", "hashes")
    return rows.groupBy("clump", "lo", "hi").applyInArrow(_meet_clump(similarity), "a long,b long")


def near_dedup(docs: DataFrame, shingle: int = COPY_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each component of similar texts, with all its columns: the one of the least id, a null id last."""
    src = numbered(docs, F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    own = src.select("row", F.col("doc.text").cast("binary").alias("text"), F.col("doc.doc_id").cast("long").alias("doc_id"))
    marks = written(own.mapInArrow(_marks(shingle), "row long,doc_id long,shingles long,sums long,p0 long,p1 long,p2 long,p3 long"), "marks")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    nodes = written(marks.groupBy("shingles", "sums", *_PRINT).agg(F.min("row").alias("node"), first.alias("first")), "nodes")
    full = nodes.where("shingles > 0").select("node", *_PRINT)
    bits = max(4, min(EXACT, math.ceil(math.log2(max(1, nodes.count()) / (1 << 12)))))
    prints = ",".join(f"{c} long" for c in _PRINT)

    def meet(rows: DataFrame, more: str, how) -> DataFrame:
        """a, b, apart: what `how` finds in the buckets of the rows (node, fingerprint and further columns)."""
        met = dealt(rows.mapInArrow(_blocks, f"node long,{prints}{more},table int,block long"), BLOCK, EXACT, 1, bits, HOT_BLOCK)
        return met.drop("block").groupBy("table", "depth", "prefix").applyInArrow(how, "a long,b long,apart long").groupBy("a", "b").agg(F.min("apart").alias("apart"))

    def sets_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
        return written(own.join(small(ends), "row", "left_semi").select("row", "text").mapInArrow(_sets(shingle), "node long,hashes binary"), "sets")

    met = written(meet(full, "", _meet), "met")
    candidates = written(met.where("a < b"), "candidates")
    sets = sets_of(candidates)
    roots, alike = similar_components(candidates, sets, similarity)
    forget(sets)
    marked = nodes.join(met.where("a = b").select(F.col("a").alias("node")), "node").select("node", *_PRINT, "shingles")
    if not marked.isEmpty():
        marked = marked.join(roots.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select("node", *_PRINT, "shingles", F.coalesce("root", "node").alias("root"))
        others = written(meet(marked, ",shingles long,root long", _meet_others(similarity)), "others")
        clumps = components(others).select(F.col("node").alias("member"), F.col("root").alias("clump"))
        members = written(marked.join(clumps, F.col("node") == F.col("member")).select("node", "root", "shingles", "clump"), "members")
        sets = sets_of(others)
        more = written(similar_in_clumps(members, sets, similarity), "more")
        roots = components(alike.union(more))
        for done in (sets, others, members, more):
            forget(done)
    forget(met)
    rooted = nodes.join(roots.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select(F.coalesce("root", "node").alias("root"), "first")
    stay = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    gone = written(marks.select("row").join(stay, "row", "left_anti"), "gone")
    return src.join(small(gone), "row", "left_anti").select("doc.*")
