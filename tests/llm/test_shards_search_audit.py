"""Sharding, lexical search and the filter audit against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from evalframe.llm import filter_audit, lexical, sharding

# Sharding


def _shards(df, shards=8, **more):
    return sorted(sharding.shard_rows(df, shards, **more).collect(), key=lambda r: (r.shard, r.slot))


def _exact(rows, n, shards):
    sizes = Counter(r.shard for r in rows)
    assert [sizes[s] for s in range(shards)] == [n // shards + (s < n % shards) for s in range(shards)]
    assert all([r.slot for r in rows if r.shard == s] == list(range(sizes[s])) for s in range(shards))


@pytest.mark.parametrize(("n", "partitions", "shards"), [(0, 1, 8), (3, 2, 8), (10_007, 7, 8), (30_000, 70, 5), (9_000, 1, 1)])
def test_shards_have_exact_sizes_and_every_row_once(spark, n, partitions, shards):
    df = spark.range(0, n, 1, partitions).withColumn("shard", F.lit("x"))
    rows = _shards(df, shards)
    _exact(rows, n, shards)
    assert sorted(r.id for r in rows) == list(range(n))
    assert set(df.columns) | {"law", "slot", "grown_shard"} == set(sharding.shard_rows(df, shards).columns)


def test_shards_of_odd_rows(spark, documents):
    texts = [None, "", "a", "x" * 300_000] + ["same"] * 500
    df = documents([(None if k % 7 == 0 else 1, text, None) for k, text in enumerate(texts)])
    rows = _shards(df)
    _exact(rows, len(texts), 8)
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in df.collect())


def test_a_shuffle_is_uniform_and_repeats(spark, monkeypatch):
    """Shards and slots know nothing of the order that the rows came in."""
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 128)
    n, shards = 16_000, 4
    rows = _shards(spark.range(0, n, 1, 5), shards)
    assert rows == _shards(spark.range(0, n, 1, 5), shards) and rows != _shards(spark.range(0, n, 1, 5), shards, seed="other")
    # Counts of 20 stretches of the input per quarter of each shard: 20 x 16 cells of 50.
    cells = Counter((r.id * 20 // n, r.shard, r.slot * 4 // (n // shards)) for r in rows)
    chi = sum((cells[a, s, q] - 50) ** 2 / 50 for a in range(20) for s in range(shards) for q in range(4))
    assert abs(chi - 19 * 15) < 5 * math.sqrt(2 * 19 * 15)


def _pmf(good, total, draws):
    every = math.comb(total, draws)
    return [math.comb(good, k) * math.comb(total - good, draws - k) / every for k in range(min(good, draws) + 1)]


@pytest.mark.parametrize(("good", "total", "draws"), [(5, 12, 7), (1, 2, 1), (40, 300, 100), (3, 1000, 2), (12, 12, 5), (0, 9, 3), (9, 10, 10), (500, 1000, 400)])
def test_hypergeometric_draws_follow_the_law(spark, good, total, draws):
    n = 20_000
    u = (F.col("id").cast("double") + 0.5) / n
    args = [F.lit(x).cast("bigint") for x in (good, total, draws)]
    got = Counter(r.k for r in spark.range(n).select(sharding.hypergeometric(*args, u).alias("k")).collect())
    # An even grid through the inverse of the distribution meets each outcome its share of times.
    assert all(abs(got.get(k, 0) - n * p) <= 1.01 for k, p in enumerate(_pmf(good, total, draws)))
    assert sum(got.values()) == n and max(got) <= min(good, draws)


def test_matrix_keeps_both_margins(spark):
    sizes = [977] * 4 + [976] * 3
    n = [(k * 37) % 11 + (300 if k == 40 else 0) for k in range(1200)]
    sizes[0] += sum(n) - sum(sizes)
    blocks = spark.createDataFrame([(3 * k, x) for k, x in enumerate(n) if x], "node bigint, n bigint")
    rows = sharding.communication_matrix(blocks, sizes, 3600).collect()
    assert {r.node: sum(r.counts) for r in rows} == {3 * k: x for k, x in enumerate(n) if x}
    assert [sum(column) for column in zip(*[r.counts for r in rows], strict=True)] == sizes


def test_written_shards_lie_in_slot_order(spark, tmp_path):
    sharding.write_shards(sharding.shard_rows(spark.range(2000), 3), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out/shard=1")
    assert [r.slot for r in back.collect()] == list(range(667))


# Lexical search


def _terms(text):
    return re.findall(lexical.TERM, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def _ranked(docs, items, best=10):
    counted = [(doc, Counter(_terms(text))) for doc, text in docs]
    counted = [(doc, c, sum(c.values())) for doc, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked: dict = {}
    for item, text in set(items):
        asked.setdefault(item, []).extend(_terms(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, c, n in counted:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms if t in c
            )
            if score > 0:
                scored.append((-score, doc is None, doc, score))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, doc, score) for k, (_, _, doc, score) in enumerate(scored[:best])]
    return Counter(out)


def _found(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 0, "s") for i, t in docs], "doc_id bigint, text string, item_id int, score string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, term int")
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in lexical.rank_documents(d.repartition(3), b, **more).collect())


def _search_rows():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["Él", "naïve", "日本", "a", "A1", "don't", "x_y", "\x7fq", "Ω"]
    docs = [(k, rng.choice([" ", "\n", "-", " . "]).join(rng.choices(words, k=rng.randint(1, 60)))) for k in range(150)]
    docs += [(None, docs[3][1]), (3, docs[3][1]), (3, docs[3][1]), (3, "w1 other"), (900, None), (901, ""), (902, " .-\n"), (903, "w1 " * 30_000)]
    items = [(k, " ".join(rng.choices(words, k=12))) for k in range(14)]
    items += [(20, None), (21, ""), (22, "nowhere found"), (23, "w1 w1 w2"), (23, "w5"), (23, "w5"), (None, "w7 w8"), (24, "W9 " * 500 + "é")]
    return docs, items


def test_ranking_equals_brute_force(spark):
    docs, items = _search_rows()
    want = _ranked(docs, items)
    assert _found(spark, docs, items) == want
    assert _found(spark, docs, items, best=3) == _ranked(docs, items, 3)


@pytest.mark.parametrize("block_bytes", [150, 40])
def test_blocks_and_cut_items_rank_alike(spark, block_bytes):
    docs, items = _search_rows()
    assert _found(spark, docs, items, block_bytes=block_bytes) == _ranked(docs, items)


def test_blocks_keep_their_bound(spark):
    rows = [(k, f"{'x' * (k % 40)}{t}", 1) for k in range(200) for t in range(1 + k % 9)] + [(999, "y" * 500, 1)]
    terms = spark.createDataFrame(rows, "item bigint, term string, times bigint")
    dealt = lexical._blocks(terms, 300)
    sizes = {r["block"]: (r["bytes"], r["n"]) for r in dealt.groupBy("block").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()}
    assert all(size <= 300 or n == 1 for size, n in sizes.values()) and dealt.count() == len(rows)
    assert dealt.where("NOT cut").groupBy("item").agg(F.countDistinct("block").alias("n")).where("n > 1").count() == 0


def test_search_of_nothing(spark):
    assert not _found(spark, [], [(1, "a")]) and not _found(spark, [(1, "a")], []) and not _found(spark, [(1, None)], [(1, "a")])


# Filter audit


def _audited(docs, labels):
    """Every order applied literally, filter after filter."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}

    def fails(doc, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs),
        }

    rows, shapley = {}, Counter()
    for part in {s or "" for _, _, s in docs}:
        mine = [(d, fails(d, t or "")) for d, t, s in docs if (s or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order):
                removed = [x for x in left if x[1][name]]
                left = [x for x in left if not x[1][name]]
                shapley[part, name] += len(removed)
                rows[part, "".join(order), step + 1] = (
                    len(left), len(removed), sum(f[name] for _, f in mine) - len(removed),
                    sum(f[name] and sum(f.values()) == 1 for _, f in mine),
                    sum(d in good for d, _ in removed), sum(d in toxic for d, _ in removed),
                )
    return {key: (*row, shapley[key[0], key[1][key[2] - 1]]) for key, row in rows.items()}


def _audit(spark, documents, docs, labels):
    marks = spark.createDataFrame([(i, q, t, "z") for i, q, t in labels], "doc_id bigint, quality int, toxic int, source string")
    got = filter_audit.audit(documents(docs), marks).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got})
    return {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got}


def test_audit_equals_every_order_applied(spark, documents):
    rng = random.Random(9)
    docs = []
    for k in range(120):
        words = [rng.choice(["alpha", "Beta", "gamma", f"w{rng.random()}", f"v{rng.random()}"]) for _ in range(rng.choice([3, 199, 200, 260]))]
        text = rng.choice(["", "", " #", " |"]) .join([" ".join(words), ""])
        docs.append((k, text, rng.choice(["s1", "s2", None, ""])))
    docs += [(200 + k, docs[k % 9][1], rng.choice(["s1", "s2"])) for k in range(40)]
    docs += [(None, docs[0][1], "s1"), (5, docs[5][1], "s1"), (5, docs[5][1], "s2"), (5, "ELSE", "s2"), (300, None, "s1"),
             (301, "", "s1"), (299, "", None), (302, "A" * 100_000, "s3"), (303, "\x85 \xa0", "s3"), (None, None, None)]
    labels = [(k, k % 2, (k + 1) % 3 // 2) for k in range(0, 240, 2)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1), (301, None, 1), (999, 1, 1)]
    assert _audit(spark, documents, docs, labels) == _audited(docs, labels)


def test_audit_of_nothing(spark, documents):
    assert _audit(spark, documents, [], []) == {}
    assert _audit(spark, documents, [(1, "a", "s")], []) == _audited([(1, "a", "s")], [])


def test_plans_of_the_native_operators_have_no_python(spark):
    from evalframe.llm import queries

    for query in (queries.op11_sharding, queries.op13_filter_audit):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
