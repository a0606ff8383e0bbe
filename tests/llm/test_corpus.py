"""Line dedup, sharding, mixing, near duplicates, decontamination: edge cases and brute force."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from gristmill.llm import decontam, graph, jaccard, kernels, lines, mixing, sharding

DOCS = "doc_id bigint, text string, source string, shard string, cell string, n string, t string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", "z", "w") for i, t, s in rows], DOCS)


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(50)) for _ in range(n))


ODD = [(None, None, None), (None, "a b c", "s"), (1, None, "s"), (2, "", "s"), (3, " \n\n\n ", None), (4, "ß", "s"), (4, "ß", "s"), (5, "x" * 300_000, "s")]


# kernels


def brute_tokens(text):
    out, word = [], ""
    for c in text:
        if c.isascii() and c.isalnum() or not c.isascii():
            word += c.lower() if c.isascii() else c
        elif word:
            out.append(word)
            word = ""
    return out + [word] if word else out


@pytest.mark.parametrize("text", ["", "  ", "One two-THREE", "é ñ  x", "a" * 3000 + " b", ".x."])
def test_tokens(text):
    assert kernels.text_tokens(text) == brute_tokens(text)


def test_gram_sets_equal_iff_grams_equal():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(8))) for _ in range(300)] + [None]
    sets = [s for _, s in kernels.gram_sets(pa.array(texts), 2)]
    named = []
    for t in texts:
        w = (t or "").split()
        named.append(frozenset(tuple(w[i : i + 2]) for i in range(len(w) - 1)) if len(w) > 1 else frozenset([tuple(w)] if w else []))
    assert [len(s) for s in sets] == [len(x) for x in named]
    by = {}
    for s, x in zip(sets, named):
        assert by.setdefault(x, s.tobytes()) == s.tobytes()
    assert len(set(by.values())) == len(by)


# line dedup


def brute_lines(rows):
    seen, out = set(), {}
    for key in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        text = key[1]
        l = (text or "").split("\n")
        gone = set()
        for p in range(len(l) - 2):
            w = tuple(l[p : p + 3])
            if not "".join(w).strip():
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        kept = "\n".join(x for i, x in enumerate(l) if i not in gone)
        out[key] = (text if not gone else kept, len(gone))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", "d "]) for _ in range(rng.randrange(9)))) for i in range(80)]
    rows += [(200, "q\nq\nq\nq\nq"), (201, None), (202, ""), (203, "\n\n\n\n"), (204, "l\n" * 3000), (205, rows[0][1]), (205, rows[0][1])]
    got = lines.dedup_lines(docs(spark, [(i, t, "s") for i, t in rows])).collect()
    want = brute_lines(rows)
    assert len(got) == len(rows)
    for r in got:
        source = next(t for i, t in rows if i == r["doc_id"])
        assert (r["text"], r["lines_removed"]) == want[(r["doc_id"], source)], r["doc_id"]
    assert {"n", "t", "cell"} <= set(got[0].asDict())


def test_line_dedup_odd(spark):
    assert lines.dedup_lines(docs(spark, [])).count() == 0
    got = lines.dedup_lines(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r["lines_removed"] == 0 for r in got)
    assert sorted(str(r["text"]) for r in got) == sorted(str(t) for _, t, _ in ODD)


# sharding


def brute_place(keys, **kw):
    """One position at a time, walking the ring node by node."""
    loads = Counter(keys)
    nodes = sharding.ring(kw["shards"], kw["virtual_nodes"], kw["grid_bits"])
    most, used, out = math.ceil((1 + kw["slack"]) * len(keys) / kw["shards"]), Counter(), {}
    for cell in sorted(loads):
        k = next((i for i, (p, _) in enumerate(nodes) if p >= cell), 0)
        walk = [nodes[(k + j) % len(nodes)][1] for j in range(len(nodes))]
        fit = [s for s in walk if used[s] + loads[cell] <= most]
        out[cell] = fit[0] if fit else max(range(kw["shards"]), key=lambda s: (most - used[s], -s))
        used[out[cell]] += loads[cell]
    return out


def test_sharding_places_as_brute_force():
    rng = random.Random(3)
    kw = dict(shards=5, virtual_nodes=7, slack=0.1, grid_bits=8)
    for n in (1, 10, 500):
        keys = [rng.randrange(256) for _ in range(n)]
        assert sharding.place(dict(Counter(keys)), **kw) == brute_place(keys, **kw)


def test_sharding_bounds_and_movement(spark):
    table = spark.range(20_000).withColumnRenamed("id", "doc_id")
    one = {r["doc_id"]: r["shard"] for r in sharding.consistent_shards(table, shards=16).collect()}
    two = {r["doc_id"]: r["shard"] for r in sharding.consistent_shards(table, shards=17).collect()}
    assert max(Counter(one.values()).values()) <= sharding.bound(20_000, 16, sharding.SLACK)
    assert len(set(one.values())) == 16
    assert sum(one[k] != two[k] for k in one) < 0.4 * len(one)  # rehashing would move 16 of 17


def test_sharding_odd(spark):
    got = sharding.consistent_shards(docs(spark, ODD), shards=3).collect()
    assert len(got) == len(ODD) and all(0 <= r["shard"] < 3 for r in got) and got[0]["cell"] == "y"
    assert len({r["shard"] for r in got if r["doc_id"] == 4}) == 1
    assert sharding.consistent_shards(docs(spark, [])).count() == 0
    hot = sharding.consistent_shards(docs(spark, [(7, "t", "s")] * 50), shards=4).collect()
    assert len({r["shard"] for r in hot}) == 1


# mixing


def brute_shares(sizes, budget, cap, weights):
    live = {s for s in sizes if weights.get(s, 0) > 0 and sizes[s] > 0}
    share, left = {s: 0.0 for s in sizes}, budget
    while live:
        total = sum(weights[s] for s in live)
        over = {s for s in live if sizes[s] * cap <= max(left, 0) * weights[s] / total}
        if not over:
            for s in live:
                share[s] = max(left, 0) * weights[s] / total
            break
        for s in over:
            share[s] = sizes[s] * cap
            left -= share[s]
        live -= over
    return {s: share[s] / sizes[s] if sizes[s] else 0.0 for s in sizes}


def test_water_filling_against_brute_force(spark):
    rng = random.Random(4)
    for case in range(8):
        sizes = {f"s{k}": float(rng.choice([0, 1, 10, 100, 1000])) for k in range(6)}
        weights = {s: rng.choice([0, 1, 2, 5]) for s in sizes}
        budget = rng.choice([0.0, 10.0, 500.0, 10_000.0])
        table = spark.createDataFrame(list(sizes.items()), "source string, size double")
        got = {r["source"]: r["epochs"] for r in mixing.shares(table, budget, 3.0, weights).collect()}
        want = brute_shares(sizes, budget, 3.0, weights)
        assert got == pytest.approx(want, abs=1e-6), (sizes, weights, budget)


def test_mixing_repeats(spark):
    rows = [(i, "x" * 10, "a" if i < 900 else "b") for i in range(1000)]
    got = mixing.mix_sources(docs(spark, rows), max_epochs=2.5, numbered=True).collect()
    times = Counter(r["doc_id"] for r in got)
    assert all(times[i] in (2, 3) for i in range(900, 1000))  # b: 2.5 epochs, its cap
    assert 0.75 * 900 < sum(times[i] for i in range(900)) < 0.92 * 900  # a: the rest of the budget
    again = mixing.mix_sources(docs(spark, rows).repartition(7), max_epochs=2.5).collect()
    assert Counter(r["doc_id"] for r in again) == times


def test_mixing_odd(spark):
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    got = mixing.mix_sources(docs(spark, ODD))
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert got.where("doc_id = 5").count() >= 0
    nothing = mixing.mix_sources(docs(spark, [(1, None, "s"), (2, "", None)]))
    assert nothing.count() == 0


# components


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (3, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = graph.connected_components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()
    assert {r["id"]: r["root"] for r in got} == {x: find(x) for x in list(root)}
    assert graph.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# near duplicates


def near(rng, text, share):
    w = text.split()
    for _ in range(int(len(w) * share)):
        w[rng.randrange(len(w))] = prose(rng, 1)
    return " ".join(w)


def brute_pairs(rows, n=jaccard.N, threshold=jaccard.THRESHOLD):
    sets = defaultdict(list)
    for i, t, *_ in rows:
        w = brute_tokens((t or "").lower())
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        if i is not None and s:
            sets[i].append(s)
    out = {}
    for a, b in combinations(sorted(sets), 2):
        j = max(len(x & y) / len(x | y) for x in sets[a] for y in sets[b])
        if j >= threshold:
            out[a, b] = round(j, 6)
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([1, 3, 12, 60, 250, 400, 900])) for _ in range(n)]
    rows = [(i, t, "s") for i, t in enumerate(base)]
    for i in range(n):
        for _ in range(rng.randrange(4)):
            rows.append((len(rows), near(rng, base[i], rng.choice([0, 0.01, 0.03, 0.08, 0.2])), "s"))
    return rows


def brute_classes(rows):
    """By row, as jaccard_classes has them: (doc_id, class_id, links)."""
    pairs = brute_pairs([(k, t, None) for k, (_, t, *_) in enumerate(rows)])
    up, links = list(range(len(rows))), Counter()

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        up[find(b)] = find(a)
    ids = defaultdict(list)
    for k, (i, t, *_) in enumerate(rows):
        if i is not None and brute_tokens((t or "").lower()):
            ids[i].append(k)
    for x in ids.values():
        for k in x[1:]:
            up[find(k)] = find(x[0])
    least = defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        least[find(k)].append(i)
    return Counter((i, min((x for x in least[find(k)] if x is not None), default=None), links[k]) for k, (i, *_) in enumerate(rows))


def classes(spark, rows, **kw):
    return Counter(tuple(r) for r in jaccard.jaccard_classes(docs(spark, rows), **kw).collect())


def test_jaccard_against_brute_force(spark):
    rows = corpus(6)
    want = brute_pairs(rows)
    pairs, ids = jaccard.jaccard_pairs(docs(spark, rows))
    text = {r["doc_id"]: r["text_id"] for r in ids.collect()}
    found = {(r["text_a"], r["text_b"]): r["jaccard"] for r in pairs.collect()}
    got = {p: 1.0 if text[p[0]] == text[p[1]] else found.get(tuple(sorted((text[p[0]], text[p[1]])))) for p in combinations(sorted(text), 2)}
    got = {p: v for p, v in got.items() if v is not None}
    assert got.keys() <= want.keys() and all(want[k] == v for k, v in got.items())
    assert len(got) >= 0.98 * len(want) > 50
    assert all(a < b for a, b in found)


def test_jaccard_classes_against_brute_force(spark):
    rng = random.Random(12)
    rows = corpus(13, 30) + ODD + [(5000 + k, rng.choice(["p q r s", "P q  r s!", "lone", ""]), "s") for k in range(12)]
    rows += [(3, rows[0][1], "s"), (7000, rows[0][1], "s"), (7000, rows[1][1], "s"), (None, rows[2][1], "s")]
    assert classes(spark, rows) == brute_classes(rows)


def test_jaccard_cells_in_parts(spark):
    rng = random.Random(7)
    text = prose(rng, 200)
    rows = [(i, near(rng, text, 0.02), "s") for i in range(40)]
    # a chain of sizes, each similar to its neighbours only
    words = prose(rng, 900).split()
    rows += [(100 + k, " ".join(words[: int(30 * 1.3**k)]), "s") for k in range(12)]
    rows += [(200, text, "s"), (201, text, "s"), (201, text, "s")]
    want = brute_classes(rows)
    for part in (7, 3):
        assert classes(spark, rows, part=part) == want


def test_jaccard_hot_row_and_clashing_names(spark):
    rows = [("a", "one two three four", k) for k in range(60)] + [("b", "one two three four", 0), ("c", "five six seven", 1), (None, None, 2)]
    df = spark.createDataFrame(rows, "doc_id string, text string, gone int").selectExpr("*", "1 as u", "2 as n", "'x' as _gone", "3 as class_id", "4 as k")
    got = Counter(tuple(r) for r in jaccard.jaccard_classes(df).collect())
    assert got == {("a", "a", 60): 60, ("b", "a", 60): 1, ("c", "c", 0): 1, (None, None, 0): 1}
    kept = jaccard.drop_duplicates(df)
    assert kept.columns == df.columns and Counter(r["doc_id"] for r in kept.collect()) == {"a": 60, "c": 1, None: 1}


def unbanded(rng, many):
    """Pairs of texts of a similarity of at least the threshold whose sets share no band of MinHash values."""
    out = []
    while len(out) < many:
        a = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([21, 41, 81]))]
        b = a[:]
        for k in rng.sample(range(2, len(a) - 2, 3), len(a) // 12):
            b[k] = f"x{rng.randrange(10**6)}"
        texts = [" ".join(a), " ".join(b)]
        x, y = (s for _, s in kernels.gram_sets(pa.array(texts), jaccard.N))
        shared = len(np.intersect1d(x, y))
        if shared / (len(x) + len(y) - shared) >= jaccard.THRESHOLD and not len(np.intersect1d(jaccard.band_keys(x, jaccard.THRESHOLD), jaccard.band_keys(y, jaccard.THRESHOLD))):
            out.append(texts)
    return out


def test_jaccard_finds_pairs_without_a_shared_band(spark):
    rng = random.Random(41)
    rows = [(i, t, "s") for i, t in enumerate(t for pair in unbanded(rng, 6) for t in pair)]
    want = brute_classes(rows)
    assert all(links == 1 for _, _, links in want)
    assert classes(spark, rows) == want
    # many texts of one key, in parts
    words = prose(rng, 60).split()
    rows += [(100 + k, " ".join(words[:40] + [f"y{k}z{j}" for j in range(9)]), "s") for k in range(14)]
    assert classes(spark, rows, part=4) == brute_classes(rows)


def test_similar_sets_share_a_pair_key_and_pass_the_bitmaps():
    rng = np.random.default_rng(42)
    for threshold in (0.3, 0.5, 0.7, 0.9):
        for _ in range(1500):
            size = int(2 ** rng.uniform(0, 9))
            x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            # as different as the threshold allows: some left out, some others put in
            out = int(rng.integers(0, int((1 - threshold) * size + 1e-9) + 1))
            add = max(0, int((size - out) / threshold + 1e-9) - size)
            y = np.unique(np.concatenate([x[rng.permutation(size)[out:]], rng.integers(0, 2**63, add).astype(np.uint64)]))
            shared = len(np.intersect1d(x, y))
            if shared / (len(x) + len(y) - shared) < threshold:
                continue
            keys = [jaccard.pair_keys(s, (s % np.uint64(7)).astype(np.int64), threshold) for s in (x, y)]
            assert len(np.intersect1d(*keys)), (threshold, len(x), len(y))
            one, two = ((np.array([c]), np.array([len(s)]), [jaccard.parity(s)]) for c, s in enumerate((x, y)))
            assert [(i, list(j)) for i, j in jaccard.near(one, two, threshold)] == [(0, [0])]


def test_tree_leaves_out_nothing():
    rng = np.random.default_rng(8)
    for case in range(6):
        base = [np.unique(rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64)) for _ in range(20)]
        sets = list(base)
        for s in base:
            keep = rng.random(len(s)) < rng.choice([0.7, 0.85, 0.95])
            if keep.any():
                sets.append(s[keep])
        brute = {}
        for a, b in combinations(range(len(sets)), 2):
            k = len(np.intersect1d(sets[a], sets[b]))
            j = k / (len(sets[a]) + len(sets[b]) - k)
            if j >= 0.7:
                brute[a, b] = j
        got = {(min(a, b), max(a, b)): j for a, b, j in jaccard.similar_pairs(sets, None, 0.7)}
        assert got == pytest.approx(brute)
        cut = 13 + case
        got = {(a, b + cut): j for a, b, j in jaccard.similar_pairs(sets[:cut], sets[cut:], 0.7)}
        assert got == pytest.approx({k: v for k, v in brute.items() if k[0] < cut <= k[1]})


def test_jaccard_odd(spark):
    assert jaccard.jaccard_classes(docs(spark, [])).count() == 0 and jaccard.jaccard_pairs(docs(spark, []))[0].count() == 0
    rows = ODD + [(9, "SS ß", "s"), (10, "ß", "s")]
    got = classes(spark, rows)
    assert got == brute_classes(rows) and got[4, 4, 2] == 2 and got[10, 4, 2] == 1
    kept = jaccard.drop_duplicates(docs(spark, ODD + [(10, "ß", "s")]))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, *_ in ODD)


def test_drop_duplicates_keeps_one_of_each_group(spark):
    rows = corpus(9, 30)
    root = {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute_pairs(rows):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["doc_id"] for r in jaccard.drop_duplicates(docs(spark, rows)).collect()}
    assert got == {i for i in root if find(i) == i}


# decontamination


def brute_containment(rows, items, n=decontam.N, threshold=decontam.THRESHOLD):
    def grams(t):
        w = brute_tokens((t or "").lower())
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()

    out = set()
    for i, t, *_ in rows:
        have = grams(t)
        for k, x in items:
            want = grams(x)
            if want and len(have & want) / len(want) >= threshold:
                out.add((i, k, round(len(have & want) / len(want), 9)))
    return out


def test_decontamination_against_brute_force(spark):
    rng = random.Random(10)
    items = [(k, prose(rng, rng.randrange(12, 50))) for k in range(30)] + [(90, None), (91, "")]
    rows = []
    for i in range(80):
        t = prose(rng, rng.choice([5, 100, 2000]))
        if i % 3 == 0:
            t += " . " + near(rng, items[i % 30][1], rng.choice([0, 0.05, 0.1])) + "! " + prose(rng, 50)
        rows.append((i, t, "s"))
    rows += ODD
    table = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (100, 7):
        got = {(r[0], r[1], round(r[2], 9)) for r in decontam.contaminated(docs(spark, rows), table, block=block).collect()}
        assert got == brute_containment(rows, items)
    assert len(got) > 20
    kept = decontam.decontaminate(docs(spark, rows), table)
    bad = {i for i, *_ in got}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, *_ in rows if i not in bad)


def test_decontamination_empty(spark):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontam.contaminated(docs(spark, ODD), items).count() == 0
    assert decontam.decontaminate(docs(spark, ODD), items).count() == len(ODD)
    assert decontam.contaminated(docs(spark, []), spark.createDataFrame([(1, "a b c d")], "item_id bigint, text string")).count() == 0


def test_decontamination_finds_short_items(spark):
    rng = random.Random(11)
    items = [(k, prose(rng, 3 + k % 8)) for k in range(40)]
    rows = []
    for i in range(400):
        w = items[i % 40][1].split()
        if len(w) == 5 and i % 80 < 40:
            w = w[:4]  # two of three shingles
        rows.append((i, f"{prose(rng, rng.choice([3, 100, 700]))} . {' '.join(w)} . {prose(rng, 40)}", "s"))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r[0], r[1], round(r[2], 9)) for r in decontam.contaminated(docs(spark, rows), table).collect()}
    assert got == brute_containment(rows, items) and len(got) >= 400


# names and types


CLASHING = "doc_id string, text string, source string, __id int, id int, _id int, t int, kept int, done int, removed int, __cell int, cell int, __shard int, shard int, own int, epochs int, rounds int, k int, __k int, __gone int, gone int, __bad int, bad int, u int, n int, copy int, lines_removed int"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, *range(24)) for r in rows], CLASHING)


NAMED = [("a", "x y z\n1\n2\n3", "s"), ("b", "1\n2\n3\nq w e", None), ("c", None, "s"), (None, "", "t"), (None, None, None), ("a", "x y z\n1\n2\n3", "s"), ("d", "1 2 3 4 five six", "s")]


def others(df):
    return [c for c in df.columns if c not in ("lines_removed", "shard", "copy")]


def test_names_and_text_ids_in_filters(spark):
    df = clashing(spark, NAMED)
    items = spark.createDataFrame([("i", "five six", 1), (None, "q w e", 2), ("n", None, 3)], "item_id string, text string, doc_id int")
    got = lines.dedup_lines(df)
    assert others(got) == others(df) and got.count() == 7
    assert [r["text"] for r in got.where("doc_id = 'b'").collect()] == ["q w e"]
    got = sharding.consistent_shards(df, shards=3)
    assert others(got) == others(df) and got.count() == 7 and got.where("`__shard` is null").count() == 0
    got = mixing.mix_sources(df, numbered=True)
    assert others(got) == others(df) and {r["copy"] for r in got.select("copy").collect()} >= {0}
    assert mixing.mix_sources(df).columns == df.columns
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df.union(clashing(spark, [("e", "Five SIX", "s"), (None, "q w e", "s")])), items).collect()} == {("e", "i"), ("b", None), (None, None)}
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(df, spark.createDataFrame([(7, "3 q w e"), (8, "nothing at all here")], "item_id int, text string")).collect()} == {("b", 7)}
    kept = decontam.decontaminate(df, spark.createDataFrame([(7, "3 q w e")], "item_id int, text string"))
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["None", "None", "a", "a", "c", "d"]
    for empty in (lines.dedup_lines(df.limit(0)), sharding.consistent_shards(df.limit(0)), mixing.mix_sources(df.limit(0)), decontam.decontaminate(df.limit(0), items)):
        assert empty.count() == 0 and others(empty) == others(df)


def test_sharding_bounds_its_grid(spark):
    with pytest.raises(ValueError):
        sharding.consistent_shards(docs(spark, ODD), grid_bits=25)
