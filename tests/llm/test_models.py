"""Chat roles, neighbours, scoring, toxicity, licences, the pipeline: edge cases, brute force, held-out accuracy."""

import itertools
import math
import random
import re
import textwrap
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gristmill.llm import ann, chat, licenses, scoring, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, source string, score string, at string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", "x", "y") for i, t in rows], DOCS)


ODD = [(None, None), (None, "a b c"), (1, None), (2, ""), (3, " \n\n "), (4, "ß"), (4, "ß"), (5, "x" * 100_000)]


# chat


def small_model(rng):
    emitted = rng.integers(0, 20, (len(chat.STATES), chat.N_SYMBOLS)).astype(float)
    return chat.Model(emitted, rng.integers(0, 9, (3, 3)).astype(float), rng.integers(1, 9, 3).astype(float))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    model = small_model(rng)
    sequences = [[int(x) for x in rng.integers(0, chat.N_SYMBOLS, n)] for n in (0, 1, 2, 4, 5)]
    for seq, path in zip(sequences, chat.viterbi(model, sequences)):
        assert len(path) == len(seq)
        if not seq:
            continue

        def cost(p):
            out = model.start[p[0]] + model.emission[p[0], seq[0]]
            for a, b, s in zip(p, p[1:], seq[1:]):
                out += model.transition[a, b] + model.emission[b, s]
            return out

        best = max(map(cost, itertools.product(range(len(chat.STATES)), repeat=len(seq))))
        assert cost(path) == pytest.approx(best)


@pytest.mark.parametrize(
    "line, role",
    [("User: hi", "user"), ("### Assistant", "assistant"), ("<|system|> be kind", "system"), ("Q: why", "user"), ("**AI:** so", "assistant"), ("useful: no", None), ("a quick fox", None), ("[Human]: x", "user")],
)
def test_markers(line, role):
    assert chat.marker_of(line)[0] == (1 + chat.ROLES.index(role) if role else 0)


def test_chat_recovers_roles(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    true = {}
    for r in table.orderBy("conv_id", "turn").collect():
        true.setdefault(r["conv_id"], []).append(r["role"])
    got = {r["conv_id"]: r["roles"] for r in chat.format_chats(table).collect()}
    assert got.keys() == true.keys()
    assert sum(a == b for k in true for a, b in zip(got[k], true[k])) >= 0.93 * sum(map(len, true.values()))


@pytest.mark.parametrize("form, roles, precision, recall", [("rows", 0.96, 0.98, 0.99), ("marked", 0.99, 0.98, 0.99), ("joined", 0.68, 0.7, 0.25)])
def test_chat_roles_and_bounds_by_form(spark, form, roles, precision, recall):
    """Lines of a row a message, of one text with markers, and of one without: these texts are random, so that only lengths and turns tell there."""
    table = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    model, by = chat.train(table), {}
    for r in table.orderBy("conv_id", "turn").collect():
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    sequences, true = [], []
    for rows in by.values():
        if form == "rows":
            texts = [t for _, t in rows]
        else:
            texts = ["\n".join(f"{r.title()}: {t}" if form == "marked" else t for r, t in rows)]
        sequences.append([s for t in texts for s in chat.row_symbols(t)])
        true.append([(r, k == 0) for r, t in rows for k, _ in enumerate(t.split("\n"))])
    found = [(chat.STATES[int(s)], b) for path, t in zip(chat.viterbi(model, sequences), true) for s, b in zip(path, t)]
    both = sum(a[1] and b[1] for a, b in found)
    assert sum(a[0] == b[0] for a, b in found) >= roles * len(found)
    assert both >= precision * sum(a[1] for a, _ in found) and both >= recall * sum(b[1] for _, b in found)


def test_chat_counts_its_emissions():
    rng = np.random.default_rng(2)
    emitted = rng.integers(1, 50, (len(chat.STATES), chat.N_SYMBOLS)).astype(float)
    model = chat.Model(emitted, np.ones((3, 3)), np.ones(3))
    again = chat.Model(emitted * 1000, np.ones((3, 3)), np.ones(3) * 1000)
    assert np.exp(model.emission).sum(1) == pytest.approx(np.ones(len(chat.STATES)))
    assert np.abs(np.exp(model.emission) - np.exp(again.emission)).max() < 0.01


def test_chat_names_and_text_ids(spark):
    rows = [("a", 0, "user", "hi", 1, 2), ("a", 1, "assistant", "yes " * 200, 1, 2), (None, None, None, None, 1, 2), ("b", 0, "user", "", 1, 2)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, rendered int, n_turns int"))
    assert {r["conv_id"]: r["n_turns"] for r in got.collect()} == {"a": 2, "b": 1, None: 1} and got.columns == ["conv_id", "n_turns", "roles", "rendered"]


def test_chat_reads_transcripts_and_renders(spark):
    model = chat.train(spark.read.parquet(f"{SF}/conversations.parquet"))
    text = "System: Be kind.\nUser: hello <|end|>\nhow are you?\nAssistant: Fine.\n\nAnd you?\nHuman: bye\nAI: ok"
    rows = [(1, None, None, text, "x"), (2, 0, None, None, "x"), (None, 0, "user", "a", "x"), (None, 0, "user", "a", "x")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, roles string")
    got = {r["conv_id"]: r for r in chat.format_chats(table, model).collect()}
    assert got[1]["roles"] == ["system", "user", "assistant", "user", "assistant"]
    turns = re.findall(r"<\|(\w+)\|>\n(.*?)\n<\|end\|>\n", got[1]["rendered"], re.S)
    assert [r for r, _ in turns] == got[1]["roles"] and turns[2][1] == "Fine.\n\nAnd you?" and "how are you?" in turns[1][1]
    assert got[2]["n_turns"] == 1 and got[None]["n_turns"] == 2
    assert chat.format_chats(table.limit(0)).count() == 0


# neighbours


def brute_near(ids, vectors, k):
    d = ((vectors[:, None, :] - vectors[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return {ids[i]: [ids[j] for j in np.lexsort((ids, d[i]))[:k]] for i in range(len(ids))}, d


def test_ann_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows])
    want, _ = brute_near(ids, vectors, 10)
    for shard in (10_000, 700):
        got: dict = {}
        for r in ann.nearest(table, shard=shard, block=512).orderBy("vec_id", "rank").collect():
            got.setdefault(r["vec_id"], []).append(r["neighbor_id"])
        assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
        assert np.mean([len({*got[i]} & {*want[i]}) / 10 for i in want]) >= 0.97


def test_ann_queries_against_all_rows(spark):
    """Recall of the query's form over the rows of check_s: 0.98 when it was measured."""
    table = spark.read.parquet("/root/testdata/check_s/embeddings.parquet").select("vec_id", "embedding")
    rows = table.collect()
    ids, vectors = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows])
    got: dict = {}
    for r in ann.nearest(table, shard=4000, queries=table.where("vec_id % 20 = 0")).collect():
        got.setdefault(r["vec_id"], set()).add(r["neighbor_id"])
    right = 0
    for i in np.flatnonzero(ids % 20 == 0):
        d = ((vectors - vectors[i]) ** 2).sum(1)
        d[i] = np.inf
        right += len(got[ids[i]] & {*ids[np.lexsort((ids, d))[:10]]})
    assert len(got) == (ids % 20 == 0).sum() and right / (10 * len(got)) >= 0.97


def test_ann_shifted_vectors_and_text_ids(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(600, 16)).astype(np.float32).astype(float)
    want, d = brute_near(list(range(600)), vectors, 10)
    for shift in (0.0, 100.0, 1000.0):
        table = spark.createDataFrame([(f"v{i:03}", (v + shift).tolist(), 1, 2) for i, v in enumerate(vectors)], "vec_id string, embedding array<double>, rank int, id int")
        got: dict = {}
        for r in ann.nearest(table, shard=250).collect():
            got.setdefault(int(r["vec_id"][1:]), {})[int(r["neighbor_id"][1:])] = r["distance"]
        assert got.keys() == want.keys()
        assert np.mean([len({*got[i]} & {*want[i]}) / 10 for i in want]) >= 0.99
        assert all(abs(x - d[i, j]) < 1e-3 for i, near in got.items() for j, x in near.items())


def test_ann_odd(spark):
    schema = "vec_id bigint, embedding array<double>, rank string"
    v = [1.0, 2.0]
    rows = [(1, v), (2, v), (3, v), (3, v), (4, None), (None, v), (5, [1.0]), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [])]
    table = spark.createDataFrame([(*r, "x") for r in rows], schema)
    got = {(r["vec_id"], r["neighbor_id"], r["rank"]): r["distance"] for r in ann.nearest(table).collect()}
    assert set(got) == {(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 2, 2)} and set(got.values()) == {0.0}
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    assert ann.nearest(spark.createDataFrame([(1, v, "x")], schema)).count() == 0
    asked = spark.createDataFrame([(2, v, "x"), (99, [1.0, 3.0], "x"), (98, None, "x")], schema)
    got = {(r["vec_id"], r["neighbor_id"], r["rank"]): r["distance"] for r in ann.nearest(table, queries=asked).collect()}
    assert got == {(2, 1, 1): 0.0, (2, 3, 2): 0.0, (99, 1, 1): 1.0, (99, 2, 2): 1.0, (99, 3, 3): 1.0}
    assert ann.nearest(table, queries=asked.limit(0)).count() == 0


def test_graph_survives_equal_vectors_and_bytes():
    rng = np.random.default_rng(2)
    vectors = np.repeat(rng.normal(size=(150, 8)), 6, axis=0).astype(np.float32)
    g = ann.build(np.arange(len(vectors)).astype(np.uint64), vectors)
    g = ann.Graph.loads(g.dumps())
    ids, d = g.search(vectors, 6)
    assert np.mean((ids // 6) == (np.arange(len(vectors)) // 6)[:, None]) > 0.97


# scoring


def brute_bits(text, half, tables, bits):
    """One text, byte by byte and bit by bit."""
    many, total, seen = len(scoring.ORDERS), 0.0, {}
    weights = np.full((8, many), scoring.FIRST_WEIGHT / scoring.SCALE)
    trust = scoring.FIRST_TRUST * np.log1p(np.arange(1, scoring.RUNS + 1))
    maps = 1 / (1 + np.exp(-np.linspace(-8, 8, 33)))
    for p in range(len(text)):
        rows = [np.array([text[p - k] if p >= k else 0], np.uint8) for k in range(1, max(scoring.ORDERS) + 1)]
        slots = [int(s[0]) for s in scoring.contexts(rows, bits)]
        context = text[p - scoring.HISTORY : p] if p >= scoring.HISTORY else None
        guess, run = seen.get(context, (None, 0))
        node = 1
        for k in range(8):
            bit = text[p] >> (7 - k) & 1
            t = np.array([float(tables[(1 - half) * many + o, s * scoring.ENTRIES + scoring.PLACE[node]]) for o, s in enumerate(slots)])
            own = 0
            if guess is not None and (guess | 256) >> (8 - k) == node:
                own = 1 if guess >> (7 - k) & 1 else -1
            sure = min(run, scoring.RUNS - 1)
            z = min(8.0, max(-8.0, float(weights[k] @ t) + trust[sure] * own))
            prob = 1 / (1 + np.exp(-z))
            place = 16 + int(np.rint(z * 2))
            final = (prob + maps[place]) / 2
            total -= np.log2(final if bit else 1 - final)
            maps[place] += (bit - maps[place]) * scoring.MAP_RATE
            weights[k] += scoring.RATE / scoring.SCALE**2 * (bit - prob) * t
            trust[sure] += scoring.RATE * (bit - prob) * own
            node = node << 1 | bit
        if context is not None:
            seen[context] = (text[p], run + 1 if guess == text[p] else 0)
    return total


def test_scoring_against_bit_by_bit():
    rng = np.random.default_rng(3)
    bits = 6
    tables = rng.integers(-60, 60, (scoring.HALVES * len(scoring.ORDERS), scoring.ENTRIES << bits)).astype(np.int8)
    texts = [b"", b"a", b"abcd", bytes(rng.integers(97, 100, 300)), bytes(rng.integers(0, 256, 600)), b"the same line\n" * 90, bytes(rng.integers(97, 99, 2500))]
    halves = [0, 1, 0, 1, 0, 1, 0]
    got = scoring.text_bits(texts, halves, tables, bits)
    assert got == pytest.approx([brute_bits(t, h, tables, bits) for t, h in zip(texts, halves)], rel=2e-3)
    assert (scoring.text_bits(texts[::-1], halves[::-1], tables, bits)[::-1] == got).all()


def test_history_learns_within_the_document():
    bits = 6
    tables = np.zeros((scoring.HALVES * len(scoring.ORDERS), scoring.ENTRIES << bits), np.int8)  # a corpus that says nothing
    rng = np.random.default_rng(5)
    line = rng.integers(97, 123, 80).astype(np.uint8).tobytes() + b"\n"
    once, often = scoring.text_bits([line, line * 20], [0, 0], tables, bits)
    assert often < 5 * once


def test_corpus_tables_against_counts(spark):
    rows = [(k, t) for k, t in enumerate(["abcabcabd", "abcabc", None, "", "ß" * 9, "xyz" * 5, "abcab"])]
    table = docs(spark, rows).repartition(3)
    half = {r["doc_id"]: r["half"] for r in table.select("doc_id", scoring.half_of(table).alias("half")).collect()}
    assert set(half.values()) == {0, 1}
    for bits in (10, 17):  # whole arrays, and counters that are held sparsely
        tables = scoring.corpus_tables(table, bits)
        counts: dict = {}
        for i, t in rows:
            data = (t or "").encode()
            for p, byte in enumerate(data):
                near = [np.array([data[p - k] if p >= k else 0], np.uint8) for k in range(1, max(scoring.ORDERS) + 1)]
                for o, s in enumerate(scoring.contexts(near, bits)):
                    counts.setdefault((half[i] * len(scoring.ORDERS) + o, int(s[0])), np.zeros(256))[byte] += 1
        for (o, s), c in counts.items():
            assert (tables[o, s * scoring.ENTRIES : (s + 1) * scoring.ENTRIES] == scoring.odds(c[None])[0]).all()
        assert np.count_nonzero(tables.reshape(scoring.HALVES * len(scoring.ORDERS), -1, scoring.ENTRIES).any(2)) == len(counts)


def test_scoring_codes_both_halves_in_step(monkeypatch):
    rng, bits, calls = np.random.default_rng(18), 12, []
    tables = rng.integers(-60, 60, (scoring.HALVES * len(scoring.ORDERS), scoring.ENTRIES << bits)).astype(np.int8)
    texts = [b"abra cadabra " * int(k) + bytes(rng.integers(97, 123, 40).astype(np.uint8)) for k in rng.integers(0, 30, 50)]
    halves = [int(k) for k in rng.integers(0, 2, 50)]
    alone = [scoring.text_bits([t], [h], tables, bits)[0] for t, h in zip(texts, halves)]
    code = scoring.code_texts
    monkeypatch.setattr(scoring, "code_texts", lambda *a: calls.append(1) or code(*a))
    assert scoring.text_bits(texts, halves, tables, bits).tolist() == alone and len(calls) == 1
    # few lanes over many steps, and many lanes that end one after another
    monkeypatch.setattr(scoring, "AHEAD", 1)
    assert scoring.text_bits(texts, halves, tables, bits).tolist() == alone


def test_scoring_leaves_a_document_out_of_its_own_statistics(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    alone = scoring.score_documents(docs(spark, [(1, text)])).first()["total_bits"]
    bits = scoring.slot_bits(len(text))
    nothing = np.zeros((scoring.HALVES * len(scoring.ORDERS), scoring.ENTRIES << bits), np.int8)
    assert alone == pytest.approx(scoring.text_bits([text.encode()], [0], nothing, bits)[0], rel=1e-4)
    table = docs(spark, [(k, text) for k in range(8)])
    many = scoring.score_documents(table).collect()
    assert all(r["total_bits"] < 0.8 * alone for r in many)  # the other half has copies


def test_scoring_orders_texts_and_odd_rows(spark):
    base = "the quick brown fox jumps over the lazy dog again and again "
    rng = random.Random(4)
    rows = [(k, base * 20) for k in range(300)] + [(1000, "".join(chr(rng.randrange(33, 127)) for _ in range(1200)))]
    got = {r["doc_id"]: r for r in scoring.score_documents(docs(spark, rows)).collect()}
    assert got[0]["bits_per_byte"] + 1 < got[1000]["bits_per_byte"]
    odd = scoring.score_documents(docs(spark, ODD)).collect()
    assert len(odd) == len(ODD)
    assert all((r["bits_per_byte"] is None) == (r["n_bytes"] == 0) and r["total_bits"] >= 0 for r in odd)
    assert [r["n_bytes"] for r in odd if r["doc_id"] == 5] == [100_000]
    assert scoring.score_documents(docs(spark, [])).count() == 0


def test_scoring_is_whole_and_independent_of_partitions(spark):
    rng = random.Random(8)
    rows = [(f"d{k}", "".join(rng.choice("abcdefgh ") for _ in range(n))) for k, n in enumerate((7000, 11, 300, 4097, 0, 1))]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id string, text string, total_bits int, half int")
    got = {r["doc_id"]: r["total_bits"] for r in scoring.score_documents(table).collect()}
    bits = scoring.slot_bits(sum(len(t) for _, t in rows))
    tables = scoring.corpus_tables(table, bits)
    half = {r["doc_id"]: r["half"] for r in table.select("doc_id", scoring.half_of(table).alias("half")).collect()}
    assert got == pytest.approx({i: brute_bits(t.encode(), half[i], tables, bits) for i, t in rows}, rel=2e-3)
    again = {r["doc_id"]: r["total_bits"] for r in scoring.score_documents(table.repartition(5)).collect()}
    assert again == got


def test_slots_grow_without_end():
    assert [scoring.slot_bits(1 << k) for k in (30, 31, 35)] == [16, 17, 21]


# toxicity


def brute_kernel(s, t):
    """Over all pairs of three positions in either."""
    out = 0.0
    for i in itertools.combinations(range(len(s)), 3):
        for j in itertools.combinations(range(len(t)), 3):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                out += toxicity.DECAY ** (i[2] - i[0] + 1 + j[2] - j[0] + 1)
    return out


def test_kernel_against_all_subsequences():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(1, 8))) for _ in range(30)} | {"ab", "abca", "abcab"})
    marks = ["abc", "aabca", "cé", "bcab"]
    got = toxicity.cross_kernel(words, toxicity.codes(marks, 5), width=10, chunk=7)
    own = toxicity.self_kernel(toxicity.codes(words, 10))
    for k, w in enumerate(words):
        assert own[k] == pytest.approx(brute_kernel(w, w), rel=1e-4, abs=1e-6)
        for m, x in enumerate(marks):
            assert got[k, m] == pytest.approx(brute_kernel(w, x), rel=1e-4, abs=1e-6)


def labelled(rng, n):
    fine = ["".join(rng.choice(["ka", "lo", "mi", "ne", "ru", "sta", "po"]) for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    out = []
    for k in range(n):
        w = [rng.choice(fine) for _ in range(60)]
        bad = k % 4 == 0
        if bad:
            for x in ("idiot", "moron", "scumbag"):
                w.insert(rng.randrange(len(w)), x)
        out.append((" ".join(w), int(bad)))
    return out


def test_toxicity_held_out_and_gapped():
    rng = random.Random(6)
    machine = toxicity.train(labelled(rng, 400))
    score = toxicity._scorer(machine)
    test = labelled(rng, 200)
    _, hits = score(pa.array([t for t, _ in test]))
    assert [int(h > 0) for h in hits] == [y for _, y in test]
    _, hits = score(pa.array(["ka i d i o t lo", "ka i-d-i*o.t", "an idiiot", "a mororn", "scum.bag", "moorron", "ka lo mi", ""]))
    assert hits[0] and hits[1] and hits[2] and hits[4] and not hits[6] and not hits[7]
    assert sum(h > 0 for h in hits[:6]) >= 5


def test_toxicity_whole_text_and_odd(spark):
    machine = toxicity.train(labelled(random.Random(7), 200))
    rows = ODD + [(6, "ka lo " * 30_000 + "idiot"), (7, "k" * 5000 + "idiot" + "k" * 5000)]
    got = toxicity.score_toxicity(docs(spark, rows), machine).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert [r["toxic"] for r in got if r["doc_id"] == 6] == [True] and not any(r["toxic"] for r in got if r["doc_id"] in (1, 2, 3, 4))
    kept = toxicity.drop_toxic(docs(spark, rows), machine)
    assert kept.columns == docs(spark, rows).columns and kept.where("doc_id = 6").count() == 0 and kept.where("doc_id in (1, 2, 3, 4)").count() == 5
    assert toxicity.score_toxicity(docs(spark, []), machine).count() == 0
    nothing = toxicity.train([("a b c", 0)])
    assert toxicity.drop_toxic(docs(spark, rows), nothing).count() == len(rows)


def brute_document(machine, text):
    """Every window of every size, every word by its kernel over all subsequences, the tail of Poisson summed up."""
    def tail(hits, mean):
        return 1 - sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(hits))

    def score(word):
        word = re.sub(r"[\W_]+", "", word)
        marked = f"^{word}$"
        if len(word) < toxicity.SHORTEST or not machine.near([marked])[0]:
            return -1.0
        near = [brute_kernel(marked, x) / math.sqrt(max(brute_kernel(marked, marked), 1e-12) * brute_kernel(x, x)) for x in machine.names]
        return float(np.dot(near, machine.alpha) + machine.bias)

    words, out = text.lower().split(), []
    for size, rates, limit in zip(toxicity.WINDOWS, machine.rates, machine.limits):
        best = 0.0
        for k in range(0, max(1, len(words) - size // 2), size // 2):
            part = set(words[k : k + size])
            values = [score(w) for w in part]
            for cut, rate in zip(toxicity.CUTS, rates):
                hits = sum(v > cut for v in values)
                if hits > rate * len(part):
                    best = max(best, -math.log10(tail(hits, rate * len(part))))
        many = max(1, 2 * len(words) // size) if size > toxicity.WINDOWS[0] else 1
        out.append(max(0.0, best - math.log10(many)) - limit)
    return max(out)


def test_toxicity_operator_against_brute_force():
    machine = toxicity.train(labelled(random.Random(8), 120))
    rng = random.Random(9)
    texts = [t for t, _ in labelled(rng, 6)] + ["idiot", "an idi-ot, indeed", "ka", ""] + [" ".join(t for t, _ in labelled(rng, 3)) + " moron lo"]
    got, _ = toxicity._scorer(machine)(pa.array(texts))
    # the surprise is summed up to the first terms of the tail
    assert got == pytest.approx([brute_document(machine, t) for t in texts], abs=0.05)
    assert [x > 0 for x in got] == [brute_document(machine, t) > 0 for t in texts]


def test_toxicity_recall_by_length(spark):
    """One toxic sentence is found in texts of any length, and length alone makes none toxic."""
    machine = toxicity.train(labelled(random.Random(10), 400))
    rng = random.Random(12)
    clean_words = [w for t, y in labelled(random.Random(10), 400) if not y for w in t.split()]
    texts, want = [], []
    for n in (20, 200, 2000, 20_000):
        for k in range(8):
            w = [rng.choice(clean_words) for _ in range(n)]
            if k % 2:
                at = rng.randrange(len(w))
                w[at:at] = ["you", "idiot", "and", "moron"]
            texts.append(" ".join(w))
            want.append(k % 2 == 1)
    score, _ = toxicity._scorer(machine)(pa.array(texts))
    assert [x > 0 for x in score] == want


def test_toxicity_sample(spark):
    texts = spark.createDataFrame([("a", "x y", 1), ("b", None, 1), ("c", "z", 1), ("c", "w", 1), ("d", "v", 1), (None, "u", 1)], "doc_id string, text string, y int")
    labels = spark.createDataFrame([("a", 1, 0), ("b", 0, 0), ("c", 0, 1), ("d", 0, 0), ("d", 1, 0), (None, 1, 1), ("a", None, 1)], "doc_id string, toxic int, id int")
    assert toxicity.training_sample(texts, labels) == [("x y", 1), ("w", 0)]
    assert toxicity.training_sample(texts, labels.limit(0)) == [] == toxicity.training_sample(texts.limit(0), labels)
    machine = toxicity.train(labelled(random.Random(7), 200))
    rows = spark.createDataFrame([("p", "idiot moron", 1, 2), (None, None, 3, 4)] * 2, "doc_id string, text string, score int, toxic int")
    got = sorted((str(r["doc_id"]), r["toxic"]) for r in toxicity.score_toxicity(rows, machine).collect())
    assert got == [("None", False)] * 2 + [("p", True)] * 2
    assert toxicity.drop_toxic(rows, machine).columns == rows.columns


def test_toxicity_on_labels(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    sample = toxicity.training_sample(table, labels, 250, 2000)
    machine = toxicity.train(sample)
    used = {t for t, _ in sample}
    got = toxicity.score_toxicity(table, machine).join(labels.withColumnRenamed("toxic", "y"), "doc_id").join(table, "doc_id").select("toxic", "y", "text").collect()
    held = [(r[0], r["y"]) for r in got if r["text"] not in used]
    bad = [t for t, y in held if y]
    fine = [t for t, y in held if not y]
    assert sum(bad) >= 0.8 * len(bad) > 50 and sum(fine) <= 0.02 * len(fine)


# licences


licences_of = licenses.licenses_of


def laid_out(text, form):
    lines = textwrap.wrap(text, 64)
    return [text, "\n".join(lines), text.upper(), "/*\n * " + "\n * ".join(lines) + "\n */", "# " + "\n# ".join(lines)][form]


def test_licenses(spark):
    rows = [(5 * k + form, f"Some words. {laid_out(t, form)} More words follow here.") for k, (_, t) in enumerate(licenses.TEMPLATES) for form in range(5)]
    got = licenses.scan_licenses(docs(spark, rows)).collect()
    text = dict(rows)
    for r in got:
        assert r["license"] == licenses.TEMPLATES[r["doc_id"] // 5][0] and not r["missing"] and not r["added"]
        assert licenses.words(text[r["doc_id"]][r["at"] :])[0] == licenses.WORDS[r["doc_id"] // 5][0]
    assert Counter(r["doc_id"] for r in got) == Counter(dict(rows).keys())


def brute_licences(text):
    """Every wording against every stretch of the text: no cues, no places."""
    own = licenses.words(text)
    data = " ".join(text.lower().split()).encode()
    alone, given = licenses._compressors()
    found, ranges = [], []
    for k in sorted(range(len(given)), key=lambda k: (len(given[k].compress(data)), k)):
        m = len(licenses.WORDS[k])
        slack = int(licenses.MOST_DIFFERENT * m) + 3
        for a in range(0, max(1, len(own) - m + slack), max(1, slack // 2)):
            window = own[a : a + m + slack]
            missing, added, x, y = licenses.differences(window, licenses.WORDS[k])
            if licenses.confirmed(missing, added, k) and not any(p < a + y and a + x < q for p, q in ranges):
                ranges.append((a + x, a + y))
                found.append(licenses.TEMPLATES[k][0])
    return Counter(found)


def test_licenses_against_brute_force():
    rng = random.Random(11)
    plain = "the river ran past old stones while children sang about bread and winter light over hills".split()
    some, seen = [], set()
    for k, (name, t) in enumerate(licenses.TEMPLATES):
        if k % 3 == 0 or len(licenses.WORDS[k]) > 30:
            w = t.split()
            for _ in range(len(w) // 25):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.sample(plain, rng.randrange(2))
            filler = [" ".join(rng.choice(plain) for _ in range(rng.randrange(1, 40))) for _ in range(2)]
            some.append(f"{filler[0]}.\n{laid_out(' '.join(w), rng.randrange(5))}\n{filler[1]}")
            seen.add(name)
    some += [f"{a}\n\n{b}" for a, b in zip(some[::2], some[1::2])][:8] + ["no licence here, nor a copyright or warranty", "Redistribution of wealth", "public domain"]
    right = 0
    for text in some:
        got, want = Counter(x[1] for x in licences_of(text)), brute_licences(text)
        assert got.keys() == want.keys(), (text, got, want)
        right += bool(got)
    assert right >= 0.85 * (len(some) - 3) and len(seen) > 25


def test_licenses_in_long_texts_are_linear():
    notice = "Released under the MIT License. "
    began = time.time()
    assert {x[1] for x in licences_of("warranty " * 60_000)} == set()
    assert {x[1] for x in licences_of("word copyright word " * 20_000 + notice)} == {"MIT"}
    assert {x[1] for x in licences_of("the license of the software is the license\n" * 8000 + notice)} == {"MIT"}
    assert time.time() - began < 60


@pytest.mark.parametrize(
    "text, names",
    [
        ("Licensed under CC BY-NC 4.0.", {"CC-BY-NC-4.0"}),
        ("Licensed under CC BY 4.0.", {"CC-BY-4.0"}),
        ("Licensed under the GNU General Public License, version 2", {"GPL-2.0"}),
        ("released under the   mit licence", {"MIT"}),
        ("SPDX-License-Identifier: MIT", {"MIT"}),
        ("// SPDX-License-Identifier: Apache-2.0", {"Apache-2.0"}),
        ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */", {"MPL-2.0"}),
        ("covered by a Creative Commons Attribution 4.0 International License", {"CC-BY-4.0"}),
        ("a licensed driver drove home", set()),
        ("Released under the MIT License. All rights reserved.", {"MIT", "All-rights-reserved"}),
        ("", set()),
    ],
)
def test_license_wordings(text, names):
    assert {x[1] for x in licences_of(text)} == names


def test_licenses_odd(spark):
    long = "word " * 100_000 + "\nReleased under the MIT License.\n" + "word " * 1000
    got = licenses.scan_licenses(docs(spark, ODD + [(9, long)])).collect()
    assert [(r["doc_id"], r["license"]) for r in got] == [(9, "MIT")] and got[0]["at"] == 500_001
    assert licenses.scan_licenses(docs(spark, [])).count() == 0
    named = spark.createDataFrame([("a", "SPDX-License-Identifier: ISC", 1, "x"), (None, "Licensed under CC BY 4.0.", 2, "y")] * 2, "doc_id string, text string, license int, missing string")
    assert sorted((str(r["doc_id"]), r["license"]) for r in licenses.scan_licenses(named).collect()) == [("None", "CC-BY-4.0")] * 2 + [("a", "ISC")] * 2


# queries and pipeline


ROWS = {"op1_chat_formatting": "conversations", "op2_line_dedup": "documents", "op3_consistent_sharding": "documents", "op6_ngram_jaccard_join": "documents", "op8_lm_scoring": "documents", "op9_toxicity": "documents"}


def test_queries_run(spark):
    from gristmill.llm.queries import ORACLES, QUERIES

    assert {re.match(r"op(\d+)_", k).group(1) for k in QUERIES} == {str(k) for k in range(1, 11)} and ORACLES.keys() <= QUERIES.keys()
    for name, f in QUERIES.items():
        got = f(spark, SF)
        if name in ROWS:
            table = spark.read.parquet(f"{SF}/{ROWS[name]}.parquet")
            assert got.count() == (table.select("conv_id").distinct().count() if name.startswith("op1_") else table.count()), name
        else:
            assert got.count() > 0, name


@pytest.mark.parametrize("name", ["op2_line_dedup", "op4_source_mixing", "op6_ngram_jaccard_join", "op7_decontamination"])
def test_query_agrees_with_sql(spark, name):
    import duckdb

    from gristmill.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)

    def plain(rows):
        return Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)

    assert plain(map(tuple, got.select(*columns).collect())) == plain(con.sql(ORACLES[name]).project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as p

    before = spark.read.parquet(f"{SF}/documents.parquet")
    columns = before.columns
    names = [k for k, _ in p.STAGES]
    assert len(names) == 5
    kept = []
    for name, stage in p.STAGES:
        after = stage(spark, before, SF).cache()
        kept.append(sorted(r["doc_id"] for r in after.collect()))
        if name != names[-1]:
            assert after.columns == columns
        before = after
    assert set(kept[1]) <= set(kept[0]) and set(kept[2]) <= set(kept[1]) and set(kept[3]) <= set(kept[2]) and kept[4] == kept[3]
    assert before.columns == [*columns, "shard"]
    assert sorted(r["doc_id"] for r in p.run(spark, SF).collect()) == kept[4]


def brute_pipeline(rows, labels, items):
    """The first three stages in plain Python over rows (doc_id, text): toxic ones by the trained machine, near duplicates and benchmark passages by all pairs."""
    from test_corpus import brute_classes, brute_containment

    from gristmill.llm.common import unit  # noqa: F401  the mixing draw is the operator's own

    text = dict(rows)
    sample = [(text[i], y) for i, y in sorted(labels) if i in text]
    score, _ = toxicity._scorer(toxicity.train(sample))(pa.array([t for _, t in rows]))
    rows = [r for r, x in zip(rows, score) if x <= 0]
    rows = [(i, t) for i, t in rows if (i, i) in {(a, b) for a, b, _ in brute_classes([(j, u, "s") for j, u in rows])}]
    bad = {i for i, _, _ in brute_containment(rows, items)}
    return [r for r in rows if r[0] not in bad]


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as p
    from test_corpus import near, prose

    rng = random.Random(21)
    rows, labels = [], []
    for k, (t, y) in enumerate(labelled(rng, 240)):
        rows.append((k, t))
        labels.append((k, y))
    base = [prose(rng, rng.choice([30, 120, 400])) for _ in range(40)]
    items = [(k, prose(rng, rng.choice([4, 20, 40]))) for k in range(8)]
    for k, t in enumerate(base):
        rows.append((1000 + 10 * k, t))
        rows += [(1001 + 10 * k + j, near(rng, t, 0.01 * j)) for j in range(rng.randrange(3))]
        if k % 5 == 0:
            rows.append((5000 + k, f"{prose(rng, 60)} . {items[k // 5][1]} . {prose(rng, 60)}"))
    source = {i: f"s{i % 3}" if i % 4 else "hot" for i, _ in rows}
    spark.createDataFrame([(i, t, "en", source[i], len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute_pipeline(rows, labels, items)
    got = Counter(r["doc_id"] for r in p.run(spark, str(tmp_path)).collect())
    # mixing: by its source's epochs, a document comes the floor or one more
    size = Counter()
    for i, t in want:
        size[source[i]] += len(t.encode())
    share = sum(size.values()) / len(size)
    epochs = {s: min(4.0, share / n) for s, n in size.items()}
    left = sum(size.values()) - sum(epochs[s] * n for s, n in size.items())
    assert abs(left) < 1 or max(epochs.values()) == 4.0
    assert set(got) <= {i for i, _ in want} and len(want) < len(rows) - 40
    for i, _ in want:
        if abs(left) < 1:
            assert got[i] in (int(epochs[source[i]]), int(epochs[source[i]]) + 1), i


def test_pipeline_odd_tables(spark, tmp_path):
    import corpus_pipeline as p

    schema = "doc_id bigint, text string, lang string, source string, n_chars int, shard string, gone int, __bad int, k int"
    odd = [(i, t, None, s, 1, "x", 2, 3, 4) for i, t, s in [(None, None, None), (None, "", "s"), (1, None, "s"), (2, "ß", "s"), (2, "ß", "s"), (3, "x " * 50_000, None), (4, "", None)]]
    for name, rows, labels in (("odd", odd, [(2, 1, 0), (None, 1, 1), (3, None, None)]), ("empty", [], []), ("unlabelled", odd, [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (2, "")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
        before = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, f in p.STAGES:
            after = f(spark, before, folder)
            assert [c for c in after.columns if c != "shard"] == [c for c in before.columns if c != "shard"], stage
            if stage in ("toxicity", "near_duplicates", "decontamination"):
                assert after.count() == before.count(), (name, stage)
            before = after
        out = p.run(spark, folder).collect()
        assert (len(out) > 0) == bool(rows) and all(0 <= r["shard"] < 64 for r in out)
