import collections
import hashlib
import math
import os
import random
import re

import numpy as np
import pytest
import xxhash
from clausegraph.llm import decontaminate as fm
from clausegraph.llm import language, licenses, pieces, pii, quality, simhash
from clausegraph.llm.common import words
from clausegraph.llm.components import components
from clausegraph.llm.exact import exact_dedup, exact_groups
from clausegraph.llm.language import FEATURES, identify, mixtures, trigrams
from clausegraph.llm.ngram_scores import stupid_backoff
from clausegraph.llm.pieces import Encoder, Normaliser, encode, encode_digests, fields
from clausegraph.llm.shards import ShardStore, placement_sql, sharded, with_before
from clausegraph.llm.simhash import flips, links_in_bucket, near_dedup, near_groups, shingle_sets
from pyspark.sql import functions as F


def plain(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def lower(t):
    return (t or "").translate({k: k + 32 for k in range(65, 91)})


# personal data


def spans_by_regex(t):
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_rules():
    r = random.Random(1)
    for _ in range(4000):
        t = "".join(r.choice(r.choice(["a.@-b1", "1.2 3", "+1 -()9.", "4 -1", "a@b.c1 .9+é"])) for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == spans_by_regex(t), t


def test_long_runs_are_linear():
    for t in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "a@" * 100_000):
        pii.base_spans(t)
        pii.candidates(t)


def test_trees_find_added_kinds():
    model, thresholds = pii.trained()
    x, y, _ = pii.synthetic(1500, 123)
    assert ((model.probability(x) > 0.5) == y).mean() > 0.97
    t = 'mail x@y.com, call (415) 555-2671 or token = "9e5d262097869d7f87aa" on order 20240115'
    ((base, every),) = pii.all_spans([t], model, thresholds)
    assert [s[0] for s in base] == ["email"] and {s[0] for s in every} == {"email", "phone", "secret"}
    assert pii.redacted(t, every).startswith("mail [email], call [phone] or token")


def test_adjacent_numbers_are_spans_of_their_own():
    model, thresholds = pii.trained()
    for cue, parts, kinds in (("call", ["415-555-2671", "415-555-2672"], ["phone"] * 2), ("ssn", ["123-45-6788", "987-65-4321"], ["id"] * 2), ("call", ["1980-01-02", "415-555-2671"], [None, "phone"]), ("call", ["415-555-2671"] * 5, ["phone"] * 5)):
        t, want, at = " ".join([cue, *parts, "now"]), [], len(cue) + 1
        for part, kind in zip(parts, kinds):
            want += [(kind, at, at + len(part))] * bool(kind)
            at += len(part) + 1
        assert set(want) <= set(pii.candidates(t)), t
        ((_, every),) = pii.all_spans([t], model, thresholds)
        assert every == want, t


def chosen_one_by_one(t, base, model, thresholds):
    """Candidates scored alone, the likeliest first, each kept if it overlaps nothing that is kept."""
    scored = [(-float(model.probability(np.array([pii.features(t, *c)]))[0]), n, c) for n, c in enumerate(pii.candidates(t))]
    kept = list(base)
    for p, _, c in sorted(scored):
        if -p >= thresholds[c[0]] and all(c[2] <= a or b <= c[1] for _, a, b in kept):
            kept.append(c)
    return sorted(kept, key=lambda x: (pii.KINDS.index(x[0]), x[1], x[2]))


def test_added_spans_by_kind(spark):
    """Planted values that the base rules miss are found, and look-alikes in the same words are left alone."""
    r = random.Random(12)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    good = {"phone": ["call ({}) {}-{}"], "id": ["ssn {}-{}-{}"], "secret": ['api_key = "{}"', "password: {}"], "email": ["write to {} [at] {} [dot] org"]}
    fill = {"phone": lambda: (d(3), d(3), d(4)), "id": lambda: (d(3), d(2), d(4)), "secret": lambda: ("".join(r.choice("0123456789abcdef") for _ in range(32)),), "email": lambda: ("jane.doe", "exampleco")}
    bad = ["order 2024-01-{}", "on 12/11/1999 at 10", "page {} of the report", "total $ {}", "see = something", "note: nothing at all", "isbn 978{}", "version 1.{}.2"]
    model, thresholds = pii.trained()
    hit, planted, extra = collections.Counter(), collections.Counter(), 0
    for k in range(400):
        kind = r.choice(list(good))
        t = "some words here " + r.choice(good[kind]).format(*fill[kind]()) + " and more text"
        ((_, every),) = pii.all_spans([t], model, thresholds)
        planted[kind] += 1
        hit[kind] += any(x[0] == kind for x in every)
        ((_, every),) = pii.all_spans(["some words here " + r.choice(bad).format(d(2)) + " and more text"], model, thresholds)
        extra += len(every)
    assert all(hit[k] >= 0.9 * planted[k] for k in good), (hit, planted)
    assert extra <= 8, extra


def test_many_spans_take_time_in_proportion():
    import time

    model, thresholds = pii.trained()
    took = []
    for n in (1000, 8000):
        t = " ".join(f"a{k}@b.co token={k:020x}" for k in range(n))
        began = time.perf_counter()
        ((base, every),) = pii.all_spans([t], model, thresholds)
        took.append(time.perf_counter() - began)
        assert sum(x[0] == "email" for x in base) == n and len(every) >= n
    assert took[1] < 24 * took[0], took


def test_personal_data_by_document(docs, no_docs, rows):
    got = pii.find_personal_data(docs, redact=True)
    assert got.count() == len(rows) and pii.find_personal_data(no_docs).count() == 0
    model, thresholds = pii.trained()
    want = []
    for i, t, _ in rows:
        base = sorted(spans_by_regex(t or ""), key=lambda x: (pii.KINDS.index(x[0]), x[1]))
        every = chosen_one_by_one(t or "", base, model, thresholds)
        want.append((i, *[sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")], hashlib.sha256(pii.shown(base).encode()).hexdigest(), pii.shown(every)))
    assert plain(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans") == sorted(want, key=str)
    empty = got.where("doc_id = 60").first()
    assert empty.base_sha256 == hashlib.sha256(b"").hexdigest() and empty.spans == "" and empty.redacted == ""


# pieces


def tokenizer():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_normaliser_equals_the_library():
    sp = pytest.importorskip("sentencepiece")
    r = random.Random(2)
    for rule in ("nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"):
        lib = sp.SentencePieceNormalizer(rule_name=rule)
        own = Normaliser(next(v for k, v in fields(lib.serialized_model_proto()) if k == 3))
        for _ in range(300):
            t = "".join(r.choice("abAB  \t\n éüÅ①ﬁ㍿Ⅻ가ｱﾞ日́​　ßİ½") for _ in range(r.randint(0, 12)))
            got, source = own.normal(t.encode())
            assert got.decode() == lib.normalize(t) and len(source) == len(got) + 1 and (np.diff(source) >= 0).all()


def test_pieces_project_to_their_bytes():
    coder = Encoder(open(tokenizer(), "rb").read())
    for t in ("", " ", "  a  b\n é ", "日本語 x▁y", "tab\tnul\0"):
        ids, bounds = coder.encode(t.encode())
        bounds = bounds.tolist()
        assert ids == coder.lib.encode(t)
        assert bounds[0] == 0 and bounds[-1] == len(t.encode()) and bounds == sorted(bounds)
        for k, i in enumerate(ids):
            piece = t.encode()[bounds[k] : bounds[k + 1]].replace(b" ", "▁".encode())
            name = coder.lib.id_to_piece(i)
            shown = bytes([int(name[3:5], 16)]) if coder.lib.is_byte(i) else name.encode()
            assert shown in (piece, "▁".encode() + piece)


def test_encoding_by_document(docs, no_docs, rows):
    lib = Encoder(open(tokenizer(), "rb").read()).lib
    want = []
    for i, t, _ in rows:
        ids = lib.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode() if ids else b"").hexdigest()))
    assert plain(encode_digests(docs, tokenizer()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    assert encode(no_docs, tokenizer()).count() == 0
    assert encode(docs, tokenizer()).where("size(starts) != size(ids) + 1").count() == 0


def test_ids_pass_through_the_own_normaliser():
    """A model whose character map does something: ids of the own normalised bytes are those of the library."""
    sp = pytest.importorskip("sentencepiece")
    blob = open(tokenizer(), "rb").read()
    spec = next(v for k, v in fields(sp.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_model_proto()) if k == 3)
    model = b"".join(pieces.message(k, v) for k, v in fields(blob) if k in (1, 2)) + pieces.message(3, spec)
    coder, r = Encoder(model), random.Random(11)
    for _ in range(500):
        t = "".join(r.choice("abAB  \t\n éüÅ①ﬁ㍿Ⅻ가ｱﾞ日́​　ßİ½x") for _ in range(r.randint(0, 20)))
        ids, bounds = coder.encode(t.encode())
        assert ids == coder.lib.encode(t) and len(bounds) == len(ids) + 1 and (np.diff(bounds) >= 0).all()


# decontamination


def hits(text, items, size):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        p = words(t)
        for k in range(max(1, len(p) - size + 1)) if p else ():
            part = p[k : k + size]
            for j in range(len(w) - len(part) + 1):
                if w[j : j + len(part)] == part:
                    hit.update(range(j, j + len(part)))
                    found.add(item)
    return len(w), hit, sorted(found)


def test_index_finds_all_occurrences(monkeypatch):
    r = random.Random(3)
    for _ in range(150):
        size = r.choice([2, 3, 5])
        monkeypatch.setattr(fm, "SHARD", max(size, r.choice([5, 17, 1000])))
        text = lambda n, a=r.choice(["ab", "abcde", "abcdefghijklmnop"]): " ".join(r.choice(a) for _ in range(n)).encode()
        items = [(str(k), text(r.randint(0, 8))) for k in range(r.randint(0, 5))]
        texts = [r.choice([None, b"", text(r.randint(0, 40))]) for _ in range(6)]
        n, spans, found = fm.Phrases(items, size).scan(texts, [[]] * 6, [[]] * 6)
        for k, t in enumerate(texts):
            covered = {x for a, b in zip(spans[k][::2], spans[k][1::2]) for x in range(a, b)}
            assert (n[k], covered, found[k]) == hits(t, items, size)


def test_decontamination_by_document(spark, docs, no_docs, rows, monkeypatch):
    items = [("1", " ".join(rows[2][1].split()[2:14]).upper().replace("Ñ", "ñ")), ("2", "ti"), ("3", None), ("4", ""), ("5", "no such words here"), (None, " ".join(rows[4][1].split()[:11]))]
    bench = spark.createDataFrame(items, "item_id string,text string")
    coded = [(i or "", t and t.encode()) for i, t in items]
    want = []
    for i, t, _ in rows:
        n, hit, found = hits(t and t.encode(), coded, 10)
        want.append((i, n, len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert plain(fm.decontaminate(docs, bench), *names) == sorted(want, key=str)
    monkeypatch.setattr(fm, "BLOCK_BYTES", 40)  # several passes
    assert plain(fm.decontaminate(docs, bench), *names) == sorted(want, key=str)
    assert fm.uncontaminated(docs, bench).count() == sum(not w[-1] for w in want)
    assert fm.uncontaminated(docs, bench).columns == docs.columns
    assert fm.decontaminate(no_docs, bench).count() == 0 and fm.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    cut = fm.removal_spans(docs, bench.where("item_id = '1'"), cut=True).where("doc_id = 2").first()
    assert bytes(cut.text).decode().split() == rows[2][1].split()[:2] + rows[2][1].split()[14:]


# sharding


def test_store_keeps_rows_and_versions(spark, docs, rows, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), target=20_000, lowest=500, fan_in=2)
    assert store.version() == 0
    store.append(docs, "coalesce(CAST(floor(doc_id / 5) AS long), -1 - pmod(xxhash64(text), 1024))")
    before = store.manifest(1).count()
    assert store.compact() == 2 and store.manifest(2).count() < before
    want = sorted(((i, t) for i, t, _ in rows), key=str)
    assert plain(store.read(1), "doc_id", "text") == want == plain(store.read(2), "doc_id", "text")
    assert store.compact() == 2
    with pytest.raises(Exception, match="exist"):
        store.commit(store.manifest(1), 2)
    store.vacuum()
    assert plain(store.read(1), "doc_id", "text") == want
    store.vacuum(age=0)
    assert plain(store.read(), "doc_id", "text") == want and store.read().columns == docs.columns
    store.append(docs.limit(3))
    assert store.version() == 3 and store.read().count() == len(rows) + 3


def test_placement_equals_its_sql(spark, docs, no_docs, rows, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    sizes = {"target": 9000, "lowest": 300, "fan_in": 3}
    got = sharded(docs.where("doc_id IS NOT NULL"), str(tmp_path / "a"), 4, **sizes)
    documents = pd.DataFrame([(i, t) for i, t, _ in rows if i is not None], columns=["doc_id", "text"])  # noqa: F841
    names = ("doc_id", "run", "file", "shard_rows", "shard_bytes", "tier")
    want = duckdb.sql(f"SELECT {', '.join(names)} FROM ({placement_sql(4, **sizes)})").fetchall()
    assert plain(got, *names) == sorted(want, key=str)
    assert sharded(no_docs, str(tmp_path / "b")).count() == 0


def test_files_are_of_the_target_size(spark, tmp_path):
    """Ids with a stride, rows without an id, and columns of the store's own names."""
    names = ["files", "into", "run", "file", "doc", "from", "task", "first", "_part"]
    strided = spark.range(0, 4000, 4).selectExpr("id AS doc_id", "repeat('x', 500) AS text", *[f"{k} AS {n}" for k, n in enumerate(names)])
    df = strided.union(strided.limit(300).withColumn("doc_id", F.lit(None).cast("long")))
    store = ShardStore(spark, str(tmp_path / "s"), target=32_000, lowest=2000, fan_in=4)
    store.append(df, "CAST(floor(coalesce(doc_id, 0) / 500) AS long)")
    assert [store.compact() for _ in range(3)] == [2, 2, 2]
    assert all(16_000 <= r.bytes <= 64_000 for r in store.manifest().collect())
    assert store.read().columns == df.columns and plain(store.read(), *df.columns) == plain(df, *df.columns)


def test_sums_over_what_comes_before(spark):
    r = random.Random(5)
    data = [(r.choice("ab"), k, r.randint(1, 9)) for k in r.sample(range(1000), 300)]
    got = with_before(spark.createDataFrame(data, "t string,k long,v long").repartition(5), ["t"], "k", F.col("v"), "s")
    assert plain(got, "t", "k", "s") == sorted(((t, k, sum(v for u, j, v in data if u == t and j < k)) for t, k, _ in data), key=str)


# scores


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_counting(docs, no_docs, rows, order):
    texts = [words(t and t.encode()) for _, t, _ in rows]
    grams = lambda t, n: collections.Counter(tuple(t[k : k + n]) for k in range(len(t) - n + 1))
    every = {n: sum((grams(t, n) for t in texts), collections.Counter()) for n in range(1, order + 1)}
    total, want = sum(map(len, texts)), []
    for (i, _, _), t in zip(rows, texts):
        own, s, rest = {n: grams(t, n) for n in every}, 0.0, max(1, total - len(t))
        for k in range(len(t)):
            for backed, n in enumerate(range(min(order, k + 1), 0, -1)):
                gram = tuple(t[k - n + 1 : k + 1])
                if (seen := every[n][gram] - own[n][gram]) > 0:
                    context = rest if n == 1 else every[n - 1][gram[:-1]] - own[n - 1][gram[:-1]]
                    s += math.log(seen / context) + backed * math.log(0.4)
                    break
            else:
                s += -math.log(rest) + min(order, k + 1) * math.log(0.4)
        want.append((i, len(t), round(s, 6)))
    got = [(r.doc_id, r.n_words, round(r.log_score, 6)) for r in stupid_backoff(docs, order=order).collect()]
    assert total and sorted(got, key=str) == sorted(want, key=str)
    assert stupid_backoff(no_docs, order=order).count() == 0


# near copies


def print_of(t):
    w = (t or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(prints, near):
    parent = list(range(len(prints)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= near:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(len(prints))]


def test_near_groups_equal_all_pairs(docs, no_docs, rows):
    prints = [print_of(t) for _, t, _ in rows]
    of = groups_of(prints, 4)
    least = {}
    for (i, _, _), g in zip(rows, of):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted(((i, f"{p:016x}", least.get(g)) for (i, _, _), p, g in zip(rows, prints, of)), key=str)
    assert plain(near_groups(docs), "doc_id", "fingerprint", "component_id") == want
    assert near_groups(no_docs).count() == 0


def alike_of(texts, shingle=5, similarity=0.8):
    """Components by the Jaccard similarity of sets of shingles, all pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set())
    parent = list(range(len(sets)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if not x and not y or x and y and len(x & y) >= similarity * len(x | y):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(len(sets))]


def least_ids(rows):
    ids = {}
    for (i, *_), g in zip(rows, alike_of([r[1] for r in rows])):
        ids.setdefault(g, []).append(i)
    return collections.Counter(min([i for i in x if i is not None], default=None) for x in ids.values())


def test_near_dedup_equals_all_pairs(docs, no_docs, rows):
    kept = near_dedup(docs)
    assert kept.columns == docs.columns and collections.Counter(r.doc_id for r in kept.collect()) == least_ids(rows)
    assert near_dedup(no_docs).count() == 0


def test_near_dedup_keeps_one_row_of_each_component(spark, rows):
    far = "something else altogether that nobody has copied from anywhere"
    data = [(None, rows[0][1]), (None, rows[0][1]), (None, rows[1][1]), (7, rows[1][1]), (None, rows[2][1] + " "), (None, rows[2][1]), (9, far), (9, far), (9, rows[3][1]), (8, rows[3][1]), (None, None), (None, ""), (1, rows[4][1]), (7, rows[4][1])]
    df = spark.createDataFrame(data, "doc_id long,text string").withColumns({n: F.lit(1) for n in ("__id", "row", "doc", "node", "root")})
    got = near_dedup(df)
    assert got.columns == df.columns and collections.Counter(r.doc_id for r in got.collect()) == least_ids(data)


def test_families_of_near_copies(spark, monkeypatch):
    """Chains of edits, whose ends are no copies of each other, and a family in buckets that are parted."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    data = [(k, " ".join(word() for _ in range(80))) for k in range(30)]
    chain = [word() for _ in range(300)]
    for k in range(40):
        chain = list(chain)
        chain[r.randrange(300)] = word()
        data.append((100 + k, " ".join(chain)))
    r.shuffle(data)
    df = spark.createDataFrame(data, "doc_id long,text string")
    want = least_ids(data)
    assert collections.Counter(x.doc_id for x in near_dedup(df).collect()) == want and len(want) == 31
    monkeypatch.setattr(simhash, "HOT_BLOCK", 50)
    monkeypatch.setattr(simhash, "VARIANTS", 64)
    assert collections.Counter(x.doc_id for x in near_dedup(df).collect()) == want


def test_recall_of_similar_texts():
    """Of pairs at the least similarity, nine of ten and more meet in a block; of pairs at 0.9, all but one in a hundred."""
    r = random.Random(22)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    for similarity, least in ((0.8, 0.9), (0.9, 0.99)):
        met = total = 0
        while total < 200:
            w = [word() for _ in range(250)]
            v = list(w)
            for _ in range(round(250 * (1 - similarity) / (1 + similarity) / 4.6)):
                v[r.randrange(250)] = word()
            a, b = shingle_sets([" ".join(w).encode(), " ".join(v).encode()])
            both = len(np.intersect1d(a, b))
            if abs(both / (len(a) + len(b) - both) - similarity) < 0.02:
                bits = simhash.bits_of(np.stack([simhash.wide_fingerprint(a), simhash.wide_fingerprint(b)]))
                blocks = [simhash.blocks_of(bits, t) for t in range(simhash.TABLES)]
                low = (1 << simhash.BLOCK - simhash.EXACT) - 1
                met += any((x := int(p) ^ int(q)) <= low and x.bit_count() <= 2 for p, q in blocks)
                total += 1
        assert met >= least * total, (similarity, met, total)


def test_bucket_links_connect_all_near_prints():
    r = random.Random(6)
    for bits in (0, 4, 8):
        near = [r.getrandbits(64) for _ in range(4)]
        for _ in range(60):
            p = r.choice(near)
            for _ in range(r.randint(0, 4)):
                p ^= 1 << r.randrange(64)
            near.append(p)
        prints = np.unique(np.array(near, np.uint64))
        edges = set()
        for bucket in {int(m) ^ (int(p) >> (64 - bits)) for p in prints for m in flips(bits, 2)} if bits else {0}:
            a, b = links_in_bucket(prints, bucket, bits, 2)
            edges |= set(zip(a.tolist(), b.tolist()))
        assert all(bin(a ^ b).count("1") <= 4 for a, b in edges)
        parent = {int(p): int(p) for p in prints}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        of = groups_of([int(p) for p in prints], 4)
        pairs = [(i, j) for i in range(len(prints)) for j in range(i)]
        assert all((of[i] == of[j]) == (find(int(prints[i])) == find(int(prints[j]))) for i, j in pairs)


def test_components_of_paths_and_hubs(spark):
    path = [(k, k + 1) for k in range(100, 140)]
    hub = [(1, k) for k in range(2, 50)]
    edges = spark.createDataFrame(path + hub + [(60, 60)], "a long,b long")
    for share in (1 << 20, 9):  # in one task, and in tasks whose stars are joined
        got = {r.node: r.root for r in components(edges, share=share).collect()}
        assert {got[k] for k in range(100, 141)} == {100} and {got[k] for k in range(1, 50)} == {1}
    assert components(edges.limit(0)).count() == 0


# language


def test_language_of_mixtures(spark, docs, no_docs):
    r = random.Random(8)
    parts = {"en": ["the", "ing", "er", "and"], "fr": ["oui", "eau", "le", "ç"], "de": ["sch", "ung", "ei", "ß"]}
    text = lambda lang, n: " ".join("".join(r.choice(parts[lang]) for _ in range(2)) for _ in range(n))
    rows = [(k, text(lang, 30), lang) for k, lang in enumerate(r.choice(list(parts)) for _ in range(200))]
    rows += [(900, None, "en"), (901, "12 !", "en"), (902, text("de", 40) + " " + text("en", 10), None), (None, text("fr", 20), "fr"), (903, "日本", "x")]
    got = {x.doc_id: x for x in identify(spark.createDataFrame(rows, "doc_id long,text string,lang string")).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:200] if got[i].held_out) and sum(x.held_out for x in got.values()) > 20
    assert [got[k].lang_pred for k in (900, 901, 902, None)] == ["und", "und", "de", "fr"]
    assert 0.5 < got[902].score < 0.95 and got[900].score == 0
    assert identify(no_docs).count() == 0
    assert {x.lang_pred for x in identify(spark.createDataFrame(rows, "doc_id long,text string,lang string").selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect()} == {"und"}


def test_mixtures_of_more_languages():
    r = random.Random(3)
    made = lambda a: ["".join(r.choice(a) for _ in range(3)) for _ in range(40)]
    shared = made("abcdefghijklm")
    parts = {f"r{k}": (shared, [r.choice([1, 1, 1, 8]) for _ in shared]) for k in range(5)} | {"u": (made("nopqrstuvwxyz"), [1] * 40)}
    text = lambda lang, n: " ".join("".join(r.choices(*parts[lang], k=2)) for _ in range(n))
    counts = np.full((FEATURES, 6), 0.5)
    for k, lang in enumerate(sorted(parts)):
        _, f, c = trigrams([text(lang, 8000).encode()])
        counts[f, k] += c
    texts = [" ".join([text("u", 90), text("r0", 60), text("r1", 50)]).encode() for _ in range(50)]
    best, shares, selected = mixtures(texts, np.log(counts / counts.sum(axis=0)))
    assert (abs(selected.sum(axis=1) - 1) < 1e-6).all() and (selected[:, 5] > 0.4).all()
    assert set(best) == {5} and (abs(shares[:, 5] - 0.45) < 0.05).all() and (abs(shares.sum(axis=1) - 1) < 1e-9).all()


def test_mixtures_equal_plain_loops():
    """Expectation-maximisation over one text at a time, trigram by trigram."""
    r = random.Random(13)
    log_p = np.log(np.random.RandomState(1).dirichlet(np.ones(FEATURES), 3).T)
    texts = [" ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(n)).encode() for n in (1, 2, 5, 40, 200)]
    best, shares, selected = mixtures(texts, log_p)
    for t, b, share, own in zip(texts, best, shares, selected):
        _, f, c = trigrams([t])
        n = c.sum()
        alone = [sum(c[i] * log_p[f[i], k] for i in range(len(f))) for k in range(3)]
        active, pi, choice, full = [0, 1, 2], [1 / 3] * 3, None, None
        while active:
            for _ in range(language.STEPS if len(active) > 1 else 1):
                new = [0.0] * 3
                for i in range(len(f)):
                    part = [pi[k] * math.exp(log_p[f[i], k]) for k in range(3)]
                    new = [x + c[i] * y / sum(part) / n for x, y in zip(new, part)]
                pi = new
            full = full or pi
            fit = sum(c[i] * math.log(sum(pi[k] * math.exp(log_p[f[i], k]) for k in range(3))) for i in range(len(f))) - language.PENALTY / 2 * math.log(n) * (len(active) - 1)
            if choice is None or fit > choice[0] + 1e-9:
                choice = (fit, pi)
            active.remove(min(active, key=lambda k: (round(pi[k], 12), alone[k])))
            if active:
                pi = [max(pi[k], 1e-9) if k in active else 0.0 for k in range(3)]
                pi = [x / sum(pi) for x in pi]
        assert np.allclose(share, full, atol=1e-6) and np.allclose(own, choice[1], atol=1e-6) and b == int(np.argmax(choice[1]))


def test_held_out_accuracy(spark):
    """On the tables' own documents, of those that don't train."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    docs = spark.read.parquet(path)
    got = identify(docs).where("held_out AND lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL")
    right, total = got.selectExpr("count_if(lang = lang_pred)", "count(*)").first()
    assert total > 200 and right >= 0.99 * total
    assert got.where("size(languages) = 0 OR size(languages) <> size(proportions)").count() == 0


# exact copies


def test_exact_groups_equal_grouping(docs, no_docs, rows):
    of = collections.defaultdict(list)
    for i, t, _ in rows:
        of[lower(t)].append(i)
    want = []
    for i, t, _ in rows:
        ids = [x for x in of[lower(t)] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(of[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()))
    names = ("doc_id", "keep_id", "group_size", "text_sha256")
    for sizes in ({}, {"first": 2, "growth": 2}):
        got = exact_groups(docs, **sizes)
        assert plain(got, *names) == sorted(want, key=str)
        kept = [(r.text_sha256, r.doc_id, r.keep_id) for r in got.where("kept").collect()]
        assert len(kept) == len({x[0] for x in kept}) == len(of) and all(i == k for _, i, k in kept)
    assert exact_groups(no_docs).count() == 0
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(of)
    assert len({lower(r.text) for r in kept.collect()}) == len(of)


def test_exact_dedup_of_ties(spark):
    """Rows that share an id, ids that are null, and columns of the operator's own names."""
    data = [(5, "Hello There"), (5, "hello there"), (None, "x"), (-(1 << 63), "x"), (None, "X"), (None, None), (None, ""), (3, "y"), (3, "y")]
    df = spark.createDataFrame(data, "doc_id long,text string").withColumns({n: F.lit(k) for k, n in enumerate(("row", "root", "rest", "__id", "__raw", "doc"))})
    for sizes in ({}, {"first": 1, "growth": 2}):
        got = exact_dedup(df, **sizes)
        assert got.columns == df.columns
        assert sorted((lower(r.text), r.doc_id) for r in got.collect()) == sorted([("hello there", 5), ("x", -(1 << 63)), ("y", 3), ("", None)], key=str) or {(lower(r.text), r.doc_id) for r in got.collect()} == {("hello there", 5), ("x", -(1 << 63)), ("y", 3), ("", None)}
        assert got.count() == 4


# quality


def test_estimate_equals_plain_loops():
    """The same expectation-maximisation, pattern by pattern and labeller by labeller."""
    r = random.Random(14)
    k = len(quality.LABELLERS)
    seen = collections.Counter(tuple(r.choice([0, 1, 2] if j % 3 else [0, 2, 2]) for j in range(k)) for _ in range(300))
    votes, counts = list(seen), list(seen.values())
    codes = np.array([sum(v * 3 ** (k - 1 - j) for j, v in enumerate(x)) for x in votes])
    post = [0.95 if 1 not in x else 0.3 / x.count(1) for x in votes]
    for _ in range(quality.ROUNDS):
        p = []
        for j in range(k):
            bad, good = [0.0] * 3, [0.0] * 3
            for x, n, y in zip(votes, counts, post):
                bad[x[j]] += n * (1 - y)
                good[x[j]] += n * y
            bad, good = [v + 0.01 for v in bad], [v + 0.01 for v in good]
            on_good = good[1] / (good[1] + good[2])
            on_bad = max(bad[1] / (bad[1] + bad[2]), min(0.99, quality.LEAST_RATIO * on_good))
            p.append((on_bad, on_good, good[2] / (good[1] + good[2])))
        share = min(0.99, max(0.01, sum(n * y for n, y in zip(counts, post)) / sum(counts)))
        new = []
        for x in votes:
            odds = math.log(share) - math.log(1 - share)
            for v, (on_bad, on_good, clean) in zip(x, p):
                odds += math.log(on_good / on_bad) if v == 1 else math.log(clean / (1 - on_bad)) if v == 2 else 0
            new.append(1 / (1 + math.exp(-max(-50, min(50, odds)))))
        settled = max(abs(a - b) for a, b in zip(new, post)) < 1e-9
        post = new
        if settled:
            break
    assert np.allclose(quality.estimate(codes, np.array(counts, float)), post, atol=1e-6)


def test_scripts_without_blanks_are_not_voted_bad():
    for t in ("我们今天在这里讨论一个非常重要的问题。" * 8, "これは日本語で書かれた普通の文章です。" * 8, "ภาษาไทยไม่มีช่องว่างระหว่างคำ" * 8, "Это обычный текст на русском языке, который никто не назовёт плохим. " * 4):
        m = quality.measures(t.encode())
        assert not [name for name, bad, _ in quality.LABELLERS if m[name] is not None and bad[0] < m[name] <= bad[1]], t
    junk = quality.measures(("我们" * 10 + "***" * 40).encode())
    assert junk["marks"] > 0.1


def test_quality_separates_junk(spark, docs, no_docs):
    r = random.Random(9)
    word = lambda: "".join(r.choice(["an", "er", "ti", "lo", "ra", "st"]) for _ in range(r.randint(1, 3)))
    clean = lambda: ". ".join(" ".join(word() for _ in range(8)).capitalize() for _ in range(r.randint(1, 12))) + "."
    junk = [lambda: " ".join(word() + r.choice(["***", "###", "$$$"]) for _ in range(60)), lambda: " | ".join(word() for _ in range(60)), lambda: " ".join([word()] * 60), lambda: " ".join(word().upper() + "!!" for _ in range(60))]
    rows = [(k, clean() if k % 5 else r.choice(junk)()) for k in range(400)]
    got = {x.doc_id: x for x in quality.quality_scores(spark.createDataFrame(rows, "doc_id long,text string")).collect()}
    assert sum(got[k].accepted == (k % 5 > 0) for k, _ in rows) >= 396
    assert all(0 <= x.score <= 1 for x in got.values())
    assert quality.quality_scores(no_docs).count() == 0 and quality.quality_filter(no_docs).count() == 0
    assert quality.quality_filter(docs).columns == docs.columns
    assert quality.quality_scores(docs).count() == docs.count()


def test_estimate_orders_the_labellers():
    r = np.random.RandomState(0)
    k = len(quality.LABELLERS)
    truth = r.rand(5000) < 0.8
    v = np.where(r.rand(5000, k) < 0.2, 0, np.where((r.rand(5000, k) < 0.9) == truth[:, None], 2, 1))
    codes, at, n = np.unique((v * 3 ** np.arange(k - 1, -1, -1)).sum(axis=1), return_inverse=True, return_counts=True)
    assert ((quality.estimate(codes, n.astype(float))[at] > 0.5) == truth).mean() > 0.98


# licenses


def test_license_phrases_and_templates(spark, docs, no_docs, rows):
    texts = [
        "Released under the MIT License. The mit-license", "the mit licenses", None, "", "licensed under the Apache License, Version 2.0!",
        "GNU General Public License v2; general public license general public license", "Licensed under CC BY-NC 4.0.", "licensed under cc by nc sa nd 4.0",
    ]
    got = [tuple(x)[1:] for x in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long,text string")).sort("doc_id").collect()]
    assert got[0] == (8, 2, 3, 6, "mit", "mit,mit-notice", 1.0) and got[1] == (3, 0, None, None, "", "", 0.0) and got[2] == got[3] == (0, 0, None, None, "", "", 0.0)
    assert got[4][:6] == (8, 1, 3, 3, "apache", "apache,apache-2.0-notice")
    assert got[5][1:6] == (3, 1, 8, "gpl", "gpl") and got[6][5] == "cc-notice" and got[7][5] == ""
    assert licenses.license_scan(docs).count() == len(rows) and licenses.license_scan(no_docs).count() == 0


def test_automata_need_mandatory_words_only():
    a = licenses.Automaton("one <<optional>>two <<any 1 2>><<end>> three <<any 0 1>> four")
    says = lambda t: a.accepts(t.encode().split())
    assert all(map(says, ["one three four", "x one two y three four", "one two y z three q four", "one one three four"]))
    assert not any(map(says, ["one two three four x", "one three q q four", "one four", "", "one y three four"]))
    full = licenses.TEMPLATES["mit-text"].replace("<<any 1 3>>", "Software").replace("<<optional>>", "").replace("<<end>>", "")
    assert licenses.Automaton(licenses.TEMPLATES["mit-text"]).accepts(words(("Copyright 2020 me " + full + " more").encode()))
    assert not licenses.Automaton(licenses.TEMPLATES["mit-text"]).accepts(words(full.replace("sublicense", "sell on").encode()))
