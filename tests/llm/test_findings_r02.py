"""What a review found in the corpus operators: each test fails on the code before."""

import random

import numpy as np
from clausegraph.llm import simhash
from clausegraph.llm.simhash import LOOSE, TABLES, blocks_of, bits_of, near_dedup, shingle_sets, wide_fingerprint


def test_far_members_of_a_long_run_are_compared():
    """40 fingerprints of one block, of which only the 6th and the 36th are near."""
    r = np.random.RandomState(3)
    bits = r.randint(0, 2, (40, 256)).astype(np.uint8)
    bits[35] = bits[5]
    bits[:, simhash.taken_bits(0)] = bits[0, simhash.taken_bits(0)]
    prints = np.packbits(bits, axis=1).view(np.uint64)
    a, _, _, rest = simhash.candidates_in_bucket(prints, 0, 0, 0)
    assert not len(a) and {5, 35} <= set(rest.tolist())
    told = lambda roots, sizes: [x.tolist() for x in simhash.others_in_bucket(prints, np.array(roots), np.array(sizes), 0.8, 0, 0, 0)]
    assert told(range(40), [100] * 40) == [[5], [35], [0]]
    assert told([0] * 40, [100] * 40) == told(range(40), [100] * 5 + [70] + [100] * 34) == [[], [], []]


def test_every_pair_that_meets_is_verified(spark):
    """Texts that are all near, of which some pairs are similar: a forest of the near ones leaves similar pairs out."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    data = []
    for family in range(6):
        base = [word() for _ in range(150)]
        for k in range(50):
            w = list(base)
            for at in r.sample(range(150), r.randint(2, 5)):
                w[at] = word()
            data.append((100 * family + k, " ".join(w)))
    sets = shingle_sets([t.encode() for _, t in data])
    bits = bits_of(np.stack([wide_fingerprint(s) for s in sets]))
    blocks = [blocks_of(bits, table) for table in range(TABLES)]
    root = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            apart = [int(b[i] ^ b[j]) for b in blocks]
            both = len(np.intersect1d(sets[i], sets[j]))
            if (bits[i] != bits[j]).sum() <= LOOSE and any(x >> 24 == 0 and x.bit_count() <= 2 for x in apart) and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root = [root[j] if x == root[i] else x for x in root]
    want = sorted(min(data[k][0] for k in range(len(data)) if root[k] == x) for x in set(root))
    assert 6 < len(want) < 250
    assert sorted(x.doc_id for x in near_dedup(spark.createDataFrame(data, "doc_id long,text string")).collect()) == want


def test_near_texts_that_are_not_similar_make_no_row_for_each_pair():
    """300 fingerprints of one block, all near, of different components: a bucket tells what joins them, not their pairs."""
    r = np.random.RandomState(5)
    bits = np.tile(r.randint(0, 2, 256).astype(np.uint8), (300, 1))
    free = np.setdiff1d(np.arange(256), simhash.taken_bits(0))
    for k in range(300):
        bits[k, r.choice(free, 20, replace=False)] ^= 1
    prints = np.packbits(bits, axis=1).view(np.uint64)
    a, b, apart = simhash.others_in_bucket(prints, np.arange(300), np.full(300, 100), 0.8, 0, 0, 0)
    assert len(a) == 299 and (apart <= LOOSE).all() and not simhash.joined(np.arange(300), a, b).any()


def test_clumps_join_what_all_similar_pairs_join(spark):
    """In one place and in blocks; sets with much in common, of which few are similar, some by exactly 0.8."""
    r = np.random.RandomState(7)
    common, sets, roots = r.randint(0, 1 << 62, 70, np.int64).astype(np.uint64), [], []
    own = lambda n: r.randint(0, 1 << 62, n, np.int64).astype(np.uint64)
    for k in range(120):
        base = np.append(common, own(r.randint(20, 40)))
        sets += [base, np.append(base[r.choice(len(base), len(base) - r.randint(5, 15), replace=False)], own(r.randint(0, 14)))]
        roots += [2 * k, 2 * k + 1 if k % 3 else 2 * k]
    sets += [(nine := own(9)), np.append(nine[:8], own(1)), nine[:7], np.append(nine, own(2))]  # 8 of 10, 7 of 9, 9 of 11
    roots += [240, 241, 242, 243]
    sets = [np.unique(x) for x in sets]
    alike = lambda x, y: (both := len(np.intersect1d(x, y))) >= 0.8 * (len(x) + len(y) - both)
    want = list(roots)
    for i in range(len(sets)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                want = [want[j] if x == want[i] else x for x in want]
    parts = lambda x: {frozenset(k for k in range(len(x)) if x[k] == y) for y in set(x)}
    first = np.unique(roots, return_index=True)[1][np.unique(roots, return_inverse=True)[1]]
    a, b = simhash.alike_in_clump(sets, np.array(roots), 0.8)
    assert 0 < len(a) < 120 and all(alike(sets[x], sets[y]) for x, y in zip(a, b))
    assert parts(simhash.joined(first, first[a], first[b]).tolist()) == parts(want)
    members = spark.createDataFrame([(k, roots[k], len(sets[k]), 3) for k in range(len(sets))], "node long,root long,shingles long,clump long")
    hashes = spark.createDataFrame([(k, bytearray(x.tobytes())) for k, x in enumerate(sets)], "node long,hashes binary")
    found = simhash.similar_in_clumps(members, hashes, 0.8, most=8 * sum(map(len, sets)) // 3)
    a, b = np.array(found.collect()).T
    assert parts(simhash.joined(first, first[a], first[b]).tolist()) == parts(want)
