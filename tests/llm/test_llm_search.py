"""Best-fit packing, lexical search and hard negatives against brute force, and on odd inputs."""

from __future__ import annotations

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fillgauge.llm import best_fit, hard_negatives, lexical, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, source string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.TOKENIZER)


# --- best-fit packing -------------------------------------------------------------


def one_by_one(lengths, capacity, fit):
    """Every piece on its own against every open sequence."""
    weight = best_fit.weights(Counter(lengths), capacity)
    open_ = []
    for n in sorted(lengths, reverse=True):
        want = best_fit.demand(n)
        room = [s for s in open_ if all(x >= d for x, d in zip(s[0], want))]
        if room:
            best = min(room, key=lambda s: (best_fit.unfit(s[0], n, capacity, weight, fit), s[0]))
        else:
            best = [(capacity.tokens, capacity.documents, capacity.cost), []]
            open_.append(best)
        best[0] = tuple(x - d for x, d in zip(best[0], want))
        best[1].append(n)
    return Counter(tuple(s[1]) for s in open_)


@pytest.mark.parametrize("fit", ["norm", "dot"])
def test_plan_equals_best_fit_one_by_one(fit):
    rng = random.Random(1)
    for _ in range(150):
        tokens = rng.choice((5, 10, 32, 64))
        capacity = best_fit.Capacity(tokens, rng.choice((1, 2, 3, 8, 100)), tokens**2)
        lengths = [rng.randint(1, rng.choice((3, tokens // 2, tokens))) for _ in range(rng.randrange(150))]
        plan = best_fit.plan(Counter(lengths), capacity, fit)
        held = defaultdict(list)
        for n, many in Counter(lengths).items():
            for rank in range(many):
                sequence, offset = plan.place(n, rank)
                held[sequence].append((offset, n))
        assert sorted(held) == list(range(plan.sequences))
        for pieces in held.values():
            assert [o for o, _ in sorted(pieces)] == np.cumsum([0, *(n for _, n in sorted(pieces))])[:-1].tolist()
            assert sum(n for _, n in pieces) <= capacity.tokens and len(pieces) <= capacity.documents
            assert sum(n * n for _, n in pieces) <= capacity.cost
        assert Counter(tuple(sorted((n for _, n in p), reverse=True)) for p in held.values()) == one_by_one(lengths, capacity, fit)


def test_a_constraint_that_binds_is_kept():
    capacity = best_fit.Capacity(100, 4, 10_000)
    assert best_fit.plan({1: 1000}, capacity).sequences == 250
    with pytest.raises(ValueError):
        best_fit.Capacity(100, 4, 9_999)


def test_a_plan_does_not_grow_with_the_corpus():
    rng = np.random.default_rng(2)
    share = np.exp(-np.arange(1, 2049) / 500)
    counts = {n + 1: int(c) for n, c in enumerate(rng.multinomial(10**12, share / share.sum())) if c}
    plan = best_fit.plan(counts)
    least = -(-sum(n * c for n, c in counts.items()) // 2048)
    assert plan.sequences <= 1.001 * least
    assert sum(r.shape[1] for r in plan.runs.values()) < 50_000


def test_packing_query_holds_its_contract(spark, tokenizer):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for d, t in docs.items()}
    pieces = queries.op11_best_fit(spark, SF).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(docs)
    for d, some in by_doc.items():
        some.sort(key=lambda p: p["piece"])
        assert [p["piece"] for p in some] == list(range(len(some))) and len(some) == -(-len(ids[d]) // 2048)
        assert [p["start"] for p in some] == np.cumsum([0, *(p["length"] for p in some)])[:-1].tolist()
        assert sum(p["length"] for p in some) == len(ids[d]) and all(p["length"] == 2048 for p in some[1:])
        for p in some:
            part = np.array(ids[d][p["start"] : p["start"] + p["length"]], "<u4")
            assert p["ids_crc32"] == zlib.crc32(part.tobytes())
    for some in by_sequence.values():
        some.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in some] == np.cumsum([0, *(p["length"] for p in some)])[:-1].tolist()
        assert sum(p["length"] for p in some) <= 2048
    assert len(by_sequence) <= 1.02 * -(-sum(map(len, ids.values())) // 2048) + 1


def test_packing_of_odd_rows(spark, tokenizer):
    rows = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, "word " * 5000, None), (2, "word " * 5000, None), (3, "é" * 999, "b")]
    odd = spark.createDataFrame(rows * 3, SCHEMA).withColumn("length", F.lit("x")).withColumn("part", F.lit(1)).withColumn("head", F.lit(2))
    pieces = best_fit.pack(odd, queries.TOKENIZER).collect()
    whole = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in rows * 3]
    assert sum(p["length"] for p in pieces) == sum(whole) == sum(len(p["ids"]) // 4 for p in pieces)
    assert sorted(p["length"] for p in pieces if p["piece"] == 0) == sorted((n - 1) % 2048 + 1 for n in whole)
    spans = defaultdict(list)
    for p in pieces:
        spans[p["sequence_id"]] += range(p["offset"], p["offset"] + p["length"])
    assert all(sorted(s) == list(range(len(s))) and len(s) <= 2048 for s in spans.values())
    assert best_fit.pack(odd.where("false"), queries.TOKENIZER).count() == 0


# --- lexical search ---------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def scored_one_by_one(docs, items, k):
    """``item, doc, score`` of the k best by the formula."""
    bags = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    holding = Counter(t for _, b in bags for t in b)
    out = {}
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        found = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * n // total
            score = sum(
                c * math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m))
                for t, c in asked.items() if t in b
            )
            found += [(d, score)] if score > 0 else []
        out[item] = sorted(found, key=lambda f: (-f[1], f[0] is None, f[0] or 0))[:k]
    return out


def found_by(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["rank"])):
        out[r["item_id"]].append((r["doc_id"], r["score"]))
    return dict(out)


def test_terms_are_those_of_the_pattern():
    rng = random.Random(5)
    signs = "aZ09 \n\t_-@[`{~\x7f\x00é日İß  😀'"
    for _ in range(2000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(30)))
        assert [t.decode() for t in lexical.terms_of(text)] == TERM.findall(text.translate(LOWER))


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_scoring_everything(spark, monkeypatch, small):
    """Ties, repeated rows and ids, hot terms and a hot length; also with small blocks and several blocks of items."""
    if small:
        monkeypatch.setattr(lexical, "ITEM_BYTES", 200)
        monkeypatch.setattr(lexical, "AIM_POSTINGS", 100)
    rng = random.Random(12)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((8, 8, 8, rng.randrange(1, 200)))))) for i in range(400)]
    docs += [(1000 + i, docs[0][1]) for i in range(60)] + [(7, "w1 w2"), (7, "w1 w2"), (None, "w1 w2 w3"), (900, None), (901, " .,- "), (902, "")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))) for i in range(30)]
    items += [(50, None), (51, "--"), (52, "unheardof"), (53, "W1 w1 W2"), (None, "w3 w3")]
    got = found_by(
        lexical.search(
            lexical.build(spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("m", "row", "n", "item")})),
            spark.createDataFrame(items, "item_id bigint, text string").withColumns({c: F.lit("x") for c in ("score", "rank", "doc_id")}),
        ).collect()
    )
    want = {i: found for i, found in scored_one_by_one(docs, items, 10).items() if found}
    assert got == want and len(want) > 25


def test_blocks_are_cut_without_loss(monkeypatch):
    """Strata of several blocks, and blocks of single documents beyond the bound."""
    import pyarrow as pa

    monkeypatch.setattr(lexical, "BLOCK_DOCS", 3)
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 10)
    rng = random.Random(2)
    rows = []
    for i in range(40):
        tfs = Counter(f"t{rng.randrange(20)}" for _ in range(rng.randrange(1, 40)))
        rows.append((25 + i // 13, i % 13 // 7, i, " ".join(tfs), np.array(list(tfs.values()), "<u4").tobytes()))
    batch = pa.record_batch([pa.array([r[k] for r in rows]) for k in range(5)], names=["m", "share", "doc_id", "terms", "tfs"])
    back = []
    for block in lexical._blocks(iter([batch])):
        row = block.to_pylist()[0]
        docs = np.frombuffer(row["docs"], "<i8")
        assert len(docs) <= 3
        first, tf, end, slots = (np.frombuffer(row[c], kind) for c, kind in (("first", "<u4"), ("tf", "<u4"), ("end", "<u4"), ("slots", "<u2")))
        for k, term in enumerate(row["terms"].split()):
            runs = range(first[k], first[k + 1])
            assert list(tf[first[k] : first[k + 1]]) == sorted(set(tf[first[k] : first[k + 1]].tolist()), reverse=True)
            for r in runs:
                back += [(row["m"], int(docs[s]), term, int(tf[r])) for s in slots[end[r - 1] if r else 0 : end[r]]]
    want = [(m, d, t, int(n)) for m, _, d, terms, tfs in rows for t, n in zip(terms.split(), np.frombuffer(tfs, "<u4"))]
    assert sorted(back) == sorted(want)


def test_search_skips_what_bounds_rule_out(spark, monkeypatch):
    """With floors known, blocks whose bound is lower are not opened."""
    docs = [(i, "common " + " ".join(f"x{i}_{j}" for j in range(5 + i // 20))) for i in range(2000)] + [(5000 + i, "rare common") for i in range(20)]
    index = lexical.build(spark.createDataFrame(docs, "doc_id bigint, text string"))
    items = lexical.Items.of([(1, "rare")])
    opened = []
    blocks = [r.asDict() for r in index.blocks(spark).collect()]
    held = [lexical.Block(b, items, np.array([1000])) for b in blocks]
    assert sum(b.bounds()[0] > 0 for b in held) < len(held) / 4
    for b in held:
        opened.append(int(b.scores(0).max()))
        assert opened[-1] <= b.bounds()[0]


def test_searching_nothing(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical.search(lexical.build(docs.where("false")), items).count() == 0
    assert lexical.search(lexical.build(docs), items.where("false")).count() == 0
    # the only document holds the term, so its weight is floor(1000 ln(4 / 3))
    assert [tuple(r) for r in lexical.search(lexical.build(docs), items).collect()] == [(1, 1, 1, 287 * (10**9 // 1800))]


# --- hard negatives ---------------------------------------------------------------


def test_primes_keep_float32_sums_exact():
    for stretch in (1, 7, 64, 1000):
        first = next(iter(hard_negatives.primes(stretch)))
        assert stretch * ((first - 1) // 2) ** 2 <= 1 << 24
    with pytest.raises(ValueError):
        hard_negatives.moduli(1 << 62)


@pytest.mark.parametrize("most", [1, 150, 5_000, 10**6, 10**8])
@pytest.mark.parametrize("dims", [0, 1, 64, 65, 300])
def test_residue_products_are_exact(most, dims):
    rng = np.random.default_rng(dims + most)
    a, b = (rng.integers(-most, most + 1, (n, dims)).astype(float) for n in (7, 40))
    a[0], b[0], b[1] = most, most, -most  # the extremes
    found = hard_negatives.moduli(max(1, dims * most * most))
    want = [[sum(int(x) * int(y) for x, y in zip(v, w)) for w in b] for v in a]
    got = np.concatenate([s for _, s in hard_negatives.Product(a, b, found).strips()])
    assert got.dtype == np.int64 and got.tolist() == want


def mined_one_by_one(rows, positives=5, negatives=10, low=30, high=90):
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, label, v in rows:
        if i % 10:
            continue
        ranked = sorted(((score(v, w), -j, m) for j, m, w in rows if j != i), reverse=True)
        best = [(s, -j) for s, j, m in ranked if m == label][:positives]
        for s, j in best:
            window = [(t, -k) for t, k, m in ranked if m != label and low * s <= 100 * t <= high * s][:negatives]
            out += [(i, j, r + 1, k, s, t) for r, (t, k) in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("groups", ["one", "many"])
def test_mining_equals_all_pairs(spark, monkeypatch, groups):
    """Many equal vectors and scores, scores around 0, labels of one row; one group, and many small ones."""
    if groups == "many":
        monkeypatch.setattr(hard_negatives, "GROUP_BYTES", 4_000)
        monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 1_000)
        monkeypatch.setattr(hard_negatives, "STRIP", 100)
    rng = random.Random(4)
    rows = []
    for i in range(300):
        v = [rng.randrange(-3, 6) for _ in range(6)] if i % 3 else [2, 2, 2, 2, 2, 2]
        rows.append((i, 77 if i == 150 else rng.randrange(4), v))
    given = [(i, label, [float(x) for x in v]) for i, label, v in rows]
    given += [(900, None, [1.0]), (910, 1, None), (920, 1, [1.0, None]), (930, 1, [float("nan")]), (940, 1, [float("inf")]), (None, 1, [1.0])]
    table = spark.createDataFrame(given, "vec_id bigint, label int, embedding array<double>").withColumns({c: F.lit("x") for c in ("id", "part", "score", "a")})
    got = hard_negatives.mine(table, F.col("id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == mined_one_by_one(rows) and len(got) > 300


def test_each_row_of_a_repeated_id_is_an_anchor(spark):
    """Rows of one id meet each other, and each has positives of its own."""
    rng = random.Random(5)
    rows = [(i // 3 * 5, rng.randrange(3), [float(rng.randrange(-3, 6)) for _ in range(5)]) for i in range(120)]
    got = hard_negatives.mine(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>"), F.col("id") % 10 == 0)
    want = []
    for n, (i, label, v) in enumerate(rows):
        if i % 10 == 0:
            ranked = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for k, (j, m, w) in enumerate(rows) if k != n)
            for s, j in [(-s, j) for s, j, m in ranked if m == label][:5]:
                window = [(k, -t) for t, k, m in ranked if m != label and 30 * s <= -100 * t <= 90 * s][:10]
                want += [(i, j, r + 1, k, s, t) for r, (k, t) in enumerate(window)]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_mining_of_odd_rows(spark):
    kind = "vec_id bigint, label bigint, embedding array<float>"
    rows = [(0, 1, [2.0]), (1, 1, [1.5, 9.0]), (2, 2, []), (3, 2, [1.0]), (3, 2, [1.0]), (0, 5, [100.0]), (4, 1, [-1.0])]
    got = hard_negatives.mine(spark.createDataFrame(rows, kind), F.col("id") == 0, low=0).collect()
    # floor(1.5) is 1; the rows of id 0 do not meet; the second anchor row, of a greater label, is left out
    assert sorted(map(tuple, got)) == [(0, 1, 1, 2, 2, 0)]
    assert hard_negatives.mine(spark.createDataFrame([], kind), F.col("id") == 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame(rows[:1], kind), F.col("id") == 0).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_relabelled_rows_of_the_query(spark):
    rows = queries.op13_hard_negatives(spark, SF)
    labels = queries.table(spark, SF, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("l"))
    of = lambda c: labels.select(F.col("vec_id").alias(c), F.col("l").alias(f"l_{c}"))
    joined = rows.join(of("anchor_id"), "anchor_id").join(of("positive_id"), "positive_id").join(of("negative_id"), "negative_id")
    assert joined.where("l_anchor_id <> l_positive_id OR l_anchor_id = l_negative_id").count() == 0 and joined.count() == rows.count() > 0
