"""Line dedup, mixing, decontamination, near-dedup and suffix dedup against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from evalframe.llm import components, decontaminate, induced_sort, line_dedup, mixing, near_dedup, suffix_dedup
from evalframe.llm.shingles import labelled, shingle_hashes, word_hashes

ODD = [(901, None, "s1"), (902, "", None), (903, "   \n\n", "s2"), (903, "   \n\n", "s2"), (None, "no id here", "s1"), (904, "!!! ???", "s3"), (905, "!!! ???", "s3")]


def _words(rng, n):
    return [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.randrange(900)}" for _ in range(n)]


# Line dedup

def test_wide_lines_stay_at_their_first_place_only(documents):
    rows = [(i, f"own {i}\n  Shared LINE \nnarrow {i % 9}\n\nshared line", f"s{i % 12}") for i in range(48)]
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(documents(rows + ODD)).where("doc_id < 900").collect()}
    assert got[0].text == "own 0\n  Shared LINE \nnarrow 0\n" and got[0].n_removed_lines == 1
    assert all(got[i].text == f"own {i}\nnarrow {i % 9}\n" and got[i].n_removed_lines == 2 for i in range(1, 48))
    assert got[5].line == "x" and got[5].copy == 1


def test_threshold_is_exact_near_it(documents):
    rows = [(i, f"nine\nten\neleven {i}", f"s{i}") for i in range(9)] + [(9, "ten", "s9"), (10, "nine", "s8"), (11, "x", None)]
    got = {r.doc_id: r.n_removed_lines for r in line_dedup.drop_boilerplate(documents(rows), min_sites=10).collect()}
    assert got == {**{i: 1 for i in range(1, 10)}, 0: 0, 10: 0, 11: 0}


def test_line_dedup_keeps_odd_rows(documents):
    got = [(r.doc_id, r.text, r.n_removed_lines) for r in line_dedup.drop_boilerplate(documents(ODD)).collect()]
    assert sorted(got, key=repr) == sorted([(i, t, 0) for i, t, _ in ODD], key=repr)
    assert line_dedup.drop_boilerplate(documents([])).count() == 0


# Mixing

def _count(doc, rate):
    u = int(hashlib.md5(f"mix-1:{doc}".encode()).hexdigest()[:13], 16) / 2**52
    n, p = 0, math.exp(-rate)
    total = p
    while u >= total:
        n += 1
        p *= rate / n
        total += p
    return n


def test_copies_follow_the_inverse_poisson(documents):
    rows = [(i, "x" * (100 if i % 3 else 25), "big" if i % 3 else "small") for i in range(600)] + [(700, "only text", None)]
    docs = documents(rows)
    chars = collections.Counter()
    for _, t, s in rows:
        chars[s] += len(t)
    weights = {"big": 1.0, "small": 3.0}
    rates = {s: weights[s] / 4 * sum(chars.values()) / chars[s] for s in weights}
    got = mixing.mix(docs, weights).collect()
    copies = collections.defaultdict(list)
    for r in got:
        copies[r.doc_id].append(r.copy)
    assert all(sorted(copies[i]) == list(range(1, _count(i, rates[s]) + 1)) for i, _, s in rows if s)
    assert 700 not in copies and sorted(got[0].asDict()) == sorted(docs.columns)
    order = [r.doc_id for r in got]
    assert order != sorted(order) and [(r.doc_id, r.copy) for r in mixing.mix(docs, weights).collect()] == [(r.doc_id, r.copy) for r in got]


def test_default_weights_and_odd_rows(documents):
    got = mixing.mix(documents(ODD + [(1, "a" * 1000, "s1")])).collect()
    assert all(r.source in ("s1", "s2", "s3") for r in got)
    assert mixing.mix(documents([])).count() == 0
    spark_rates = {r.source: r.rate for r in mixing.rates(documents([(1, "a" * 16, "x"), (2, "a" * 4, "y"), (3, None, "z")])).collect()}
    assert spark_rates == pytest.approx({"x": 4 / 6 * 20 / 16, "y": 2 / 6 * 20 / 4})


# Decontamination

def _shingles(words):
    return collections.Counter(tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4)))


def test_leaks_equal_brute_force(spark, documents, monkeypatch):
    rng = random.Random(2)
    items = [(n, _words(rng, size)) for n, size in enumerate([3, 5, 12, 20, 20, 41, 60])]
    rows = []
    for i in range(60):
        words = _words(rng, rng.randrange(30, 200))
        _, item = rng.choice(items)
        leak = list(item)
        for _ in range(rng.choice([0, 0, 1, 2])):
            leak[rng.randrange(len(leak))] = "changed"
        if i % 4 == 0:
            words = words[:10]
        at = rng.randrange(len(words))
        rows.append((i, " ".join(words[:at] + leak + words[at:]) if i % 3 else " ".join(leak), "s"))
    want = {}
    for doc, text, _ in rows:
        words = re.findall(r"\w+", text.lower())
        for n, item in items:
            size = min(len(item), len(words))
            for at in range(len(words) - size + 1):
                a, b = _shingles(words[at : at + size]), _shingles(item)
                alike = sum((a & b).values()) / sum((a | b).values())
                if alike >= 0.8:
                    want[doc, n] = max(want.get((doc, n), 0), alike)
    bench = spark.createDataFrame([(n, " ".join(w).upper() + ".") for n, w in items] + [(50, None), (51, "")], "item_id bigint, text string")
    docs = documents(rows + ODD + [(800, "w " * 40_000 + " ".join(items[5][1]), "s")])
    for words in (decontaminate.BLOCK_WORDS, 30):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
        got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(docs, bench).collect()}
        assert got.pop((800, 5)) == 1.0 and got == pytest.approx(want) and len(want) > 20
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert kept == ({i for i, _, _ in rows + ODD} - {d for d, _ in want})
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0 and decontaminate.find_leaks(docs.limit(0), bench).count() == 0


def test_leaks_with_runs_of_one_word_equal_brute_force(spark, documents):
    rng = random.Random(12)
    items, rows, want = [], [], {}
    for n in range(30):
        run = rng.choice([12, 16, 20])
        kept = _words(rng, 12 * run)
        at = rng.randrange(len(kept))
        items.append((n, kept[:at] + [f"zero{n}"] * run + kept[at:]))
        other = [f"blank{n}"] * run if n % 2 else _words(rng, run)
        around = _words(rng, 30)
        rows.append((n, " ".join(around[:15] + kept[:at] + other + kept[at:] + around[15:]), "s"))
    for (doc, text, _), (n, item) in zip(rows, items, strict=True):
        words = text.split()
        for at in range(len(words) - len(item) + 1):
            a, b = _shingles(words[at : at + len(item)]), _shingles(item)
            alike = sum((a & b).values()) / sum((a | b).values())
            if alike >= 0.8:
                want[doc, n] = max(want.get((doc, n), 0), alike)
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(documents(rows), bench).collect()}
    assert got == pytest.approx(want) and len(want) > 25


def test_window_sums_equal_labelled_windows():
    rng = np.random.default_rng(5)
    for kinds in (1, 3, 30, 10**9):
        shingles = decontaminate.mixed(rng.integers(0, kinds, 90).astype(np.uint64))
        for per in (1, 7, 90):
            want = [decontaminate._signs(labelled(shingles[i : i + per])).sum(0) for i in range(91 - per)]
            assert (decontaminate._window_sums(shingles, per) == np.array(want)).all()


def test_index_gives_all_within_the_radius():
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 2**64, 30, np.uint64) for _ in range(200)]
    items = decontaminate.Items(list(range(200)), [w.tobytes() for w in words])
    for _ in range(60):
        base = items.prints[rng.integers(200)].copy()
        for bit in rng.choice(128, rng.integers(0, 45), replace=False):
            base[bit // 16] ^= np.uint16(1 << (bit % 16))
        far = np.bitwise_count(items.prints ^ base).sum(1)
        assert items.near(base).tolist() == np.flatnonzero(far <= decontaminate.RADIUS).tolist()


# Near-dedup

def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        p = 0
        for j, y in enumerate(b):
            q, row[j + 1] = row[j + 1], p + 1 if x == y else max(row[j], row[j + 1])
            p = q
    return row[-1]


def test_banded_alignment_equals_plain_alignment():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(1, 60))]
        b = list(a)
        for _ in range(rng.randrange(0, 12)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(12))
            b.pop(rng.randrange(len(b)))
        common = _lcs(a, b)
        alike = common / (len(a) + len(b) - common)
        got = near_dedup.similarity(np.array(a, np.uint64), np.array(b, np.uint64))
        assert got == pytest.approx(alike) if alike >= near_dedup.BORDER else got == 0


def test_sketches_see_order_and_repeats():
    x = shingle_hashes(next(word_hashes([" ".join(_words(random.Random(1), 300))])))
    assert (near_dedup.order_minhash(x) != near_dedup.order_minhash(x[::-1].copy())).mean() > 0.8
    assert len(set(labelled(np.array([5, 5, 5, 7], np.uint64)).tolist())) == 4


@pytest.mark.parametrize("single", [0, 3])
def test_classes_equal_brute_force(documents, monkeypatch, single):
    rng = random.Random(9)
    monkeypatch.setattr(near_dedup, "SINGLE", single)
    monkeypatch.setattr(near_dedup, "PIVOTS", 3)
    rows, n = [], 0
    for _ in range(25):
        base = _words(rng, rng.choice([4, 40, 150, 400]))
        for _ in range(rng.choice([1, 1, 2, 9])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                words[rng.randrange(len(words))] = f"new{rng.randrange(99)}"
            rows.append((n, rng.choice([" ", "\n"]).join(words), "s"))
            n += 1
    rng.shuffle(rows)
    parts = {i: list(_shingles(t.split()).elements()) for i, t, _ in rows}
    parts = {i: [tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))] for i, t, _ in rows}
    want = {i: i for i in parts}
    for a in sorted(parts):
        for b in sorted(parts):
            if a < b and want[a] != want[b]:
                common = _lcs(parts[a], parts[b])
                if common / (len(parts[a]) + len(parts[b]) - common) >= 0.8:
                    low, high = sorted((want[a], want[b]))
                    want = {k: low if v == high else v for k, v in want.items()}
    docs = documents(rows + ODD)
    got = collections.Counter((r.doc_id, r.class_id) for r in near_dedup.near_duplicates(docs).collect())
    assert {k: v for k, v in got if k is not None and k < 900} == want and len(set(want.values())) < len(want)
    assert {k: v for k, v in got if k is not None and k > 900} == {901: 901, 902: 902, 903: 903, 904: 904, 905: 904}
    kept = sorted(r.doc_id for r in near_dedup.keep_first(docs).where("doc_id < 900").collect())
    assert kept == sorted(set(want.values()))
    assert near_dedup.near_duplicates(documents([])).count() == 0


def test_texts_that_share_a_passage_do_not_all_meet(documents, monkeypatch):
    """A thousand texts hold one passage and are 0.6 to 0.8 alike; a few are near copies beside."""
    rng = random.Random(21)
    passage = _words(rng, 80)
    rows = []
    for i in range(1000):
        own = [f"o{i}w{j}" for j in range(rng.randrange(10, 26))]
        cut = rng.randrange(len(own))
        rows.append((i, " ".join(own[:cut] + passage + own[cut:]), "s"))
    for i in range(60):  # copies of copies, of one word changed in a text's own part or in the passage
        words = rows[i * 3][1].split()
        words[rng.choice([0, -1, len(words) // 2])] = f"changed{i}"
        rows.append((2000 + i, " ".join(words), "s"))
    shingles = {i: frozenset(enumerate_labels(t.split())) for i, t, _ in rows}
    lists = {i: [tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)] for i, t, _ in rows}
    want = {i: i for i in shingles}
    for a in sorted(shingles):
        for b in sorted(shingles):
            if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                common = _lcs(lists[a], lists[b])
                if common >= 0.8 * (len(lists[a]) + len(lists[b]) - common):
                    low, high = sorted((want[a], want[b]))
                    want = {k: low if v == high else v for k, v in want.items()}
    pairs = []
    scored = near_dedup._scored
    monkeypatch.setattr(near_dedup, "_scored", lambda met, texts: pairs.append(met.count()) or scored(met, texts))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(documents(rows)).collect()}
    assert got == want and 50 <= len(want) - len(set(want.values()))
    # Half a million pairs share a bucket.
    assert sum(pairs) < 60 * len(rows)


def test_copies_of_a_text_and_texts_somewhat_alike_do_not_all_meet(documents, monkeypatch):
    """Around one text, 200 near copies and 200 that are 0.6 to 0.8 alike to it and hardly to each other."""
    rng = random.Random(31)
    base = _words(rng, 110)
    rows = [(0, " ".join(base), "s")]
    for i in range(1, 401):
        words = list(base)
        for at in rng.sample(range(5, 105), 2 if i % 2 else 4):
            words[at] = f"changed{i}at{at}"
        rows.append((i, " ".join(words), "s"))
    for i in range(401, 421):  # copies of those somewhat alike
        words = rows[2 * (i - 400)][1].split()
        words[rng.randrange(5, 105)] = f"changed{i}"
        rows.append((i, " ".join(words), "s"))
    shingles = {i: frozenset(enumerate_labels(t.split())) for i, t, _ in rows}
    lists = {i: [tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)] for i, t, _ in rows}
    want = {i: i for i in shingles}
    for a in sorted(shingles):
        for b in sorted(shingles):
            if a < b and want[a] != want[b] and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                common = _lcs(lists[a], lists[b])
                if common >= 0.8 * (len(lists[a]) + len(lists[b]) - common):
                    low, high = sorted((want[a], want[b]))
                    want = {k: low if v == high else v for k, v in want.items()}
    pairs = []
    scored = near_dedup._scored
    monkeypatch.setattr(near_dedup, "_scored", lambda met, texts: pairs.append(met.count()) or scored(met, texts))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(documents(rows)).collect()}
    assert got == want and 100 <= len(set(want.values())) < 300
    # Some 88,000 pairs share a bucket.
    assert sum(pairs) < 20 * len(rows), pairs


def enumerate_labels(words):
    seen = collections.Counter()
    for j in range(len(words) - 4):
        key = tuple(words[j : j + 5])
        yield key, seen[key]
        seen[key] += 1


def test_rows_without_an_id_and_ids_with_several_texts(documents):
    rng = random.Random(8)
    a, b, x, y = (" ".join(_words(rng, 60)) for _ in range(4))
    rows = [(None, a, "s"), (None, b, "s"), (5, a, "s"), (7, x, "s"), (7, y, "s"), (9, y + " end", "s"), (None, a.upper(), "s"),
            (None, None, "s"), (5, a, "t")]
    got = {(r.doc_id, r.class_id) for r in near_dedup.near_duplicates(documents(rows)).collect()}
    assert got == {(None, 5), (None, None), (5, 5), (7, 7), (9, 7)}
    kept = collections.Counter((r.doc_id, r.text) for r in near_dedup.keep_first(documents(rows)).collect())
    assert kept == {(None, b): 1, (5, a): 2, (7, x): 1, (7, y): 1, (None, None): 1}


def test_long_texts_are_compared_whole(documents):
    words = _words(random.Random(2), 60_000)
    other = words[:55_000] + [f"z{i}" for i in range(5_000)]
    far = words[:50_000] + [f"q{i}" for i in range(10_000)]
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(documents(
        [(1, " ".join(words), "s"), (2, " ".join(other), "s"), (3, " ".join(far), "s")])).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(50, 51), (51, 50), (60, 60)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r.id: r.component for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 140)}, 50: 50, 51: 50}


# Suffix dedup

def test_suffix_arrays_of_small_strings(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(induced_sort, "DIRECT", 0)
    for n in range(600):
        if n == 400:
            monkeypatch.setattr(induced_sort, "DIRECT", 1 << 18)
        if n == 200:
            monkeypatch.setattr(induced_sort, "MEMORY", 40)
            monkeypatch.setattr(induced_sort, "BUCKET", 16)
            monkeypatch.setattr(induced_sort, "_LEAST", 4)
        x = [rng.randrange(1, rng.choice([2, 3, 27])) for _ in range(rng.randrange(1, 90))] + [0]
        assert induced_sort.suffix_array(np.array(x)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


@pytest.mark.parametrize("small", [False, True])
def test_removed_bytes_equal_brute_force(documents, monkeypatch, small):
    rng = random.Random(6)
    if small:
        for name, value in (("BLOCK", 900), ("STRETCH", 400), ("SHARD", 300), ("PART_BYTES", 2_000)):
            monkeypatch.setattr(suffix_dedup, name, value)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.choice([49, 50, 51, 80, 300]))) for _ in range(8)]
    passages += ["ab" * 70, "z" * 120]
    rows = []
    for i in range(70):
        parts = [rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("efgh ") for _ in range(rng.randrange(90))) for _ in range(4)]
        rows.append((rng.randrange(60), "".join(parts), "s"))
    rows += [(i, t, s) for i, t, s in ODD if i is not None] + [(70, passages[4] * 30, "s")]
    first: dict[bytes, int] = {}
    for doc, text, _ in rows:
        data = (text or "").encode()
        for at in range(len(data) - 49):
            key = data[at : at + 50]
            first[key] = min(doc, first.get(key, doc))
    want = collections.Counter()
    for doc, text, _ in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 49):
            if first[data[at : at + 50]] < doc:
                gone[at : at + 50] = b"\1" * 50
        spans = tuple((m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone)))
        want[doc, len(data), spans, bytes(c for c, g in zip(data, gone, strict=True) if not g)] += 1
    got = collections.Counter(
        (r.doc_id, r.n_bytes, tuple(zip(r.span_starts, r.span_stops, strict=True)), bytes(r.kept))
        for r in suffix_dedup.remove_repeats(documents(rows)).collect()
    )
    assert got == want and any(k[2] for k in want)
    assert suffix_dedup.remove_repeats(documents([])).count() == 0
    lone = suffix_dedup.remove_repeats(documents([(None, "y" * 60, "s"), (3, "y" * 60, "s")])).collect()
    assert {r.doc_id: len(r.kept) for r in lone} == {None: 60, 3: 0}


@pytest.mark.parametrize("line", ["subscribe to our newsletter for the latest news and offers today", "=" * 64])
def test_a_line_of_many_documents_fills_no_part(documents, monkeypatch, tmp_path, line):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = [(i, f"{text(60)}{line}{text(60)}" if i % 3 == 0 else text(180), "s") for i in range(3_000)]
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "HOT", 100, raising=False)
    sort_part = suffix_dedup._sort_part

    def measured(part):
        size = sum(len(suffix_dedup._unpack(x)[4]) for x in part["packed"])
        (tmp_path / f"{int(part['part'].iloc[0])}-{size}").touch()
        return sort_part(part)

    monkeypatch.setattr(suffix_dedup, "_sort_part", measured)
    got = {r.doc_id: list(zip(r.span_starts, r.span_stops, strict=True)) for r in suffix_dedup.remove_repeats(documents(rows)).collect()}
    first: dict[str, int] = {}
    for doc, data, _ in rows:
        for at in range(len(data) - 49):
            first.setdefault(data[at : at + 50], doc)
    for doc, data, _ in rows:
        gone = bytearray(len(data))
        for at in range(len(data) - 49):
            if first[data[at : at + 50]] < doc:
                gone[at : at + 50] = b"\1" * 50
        assert got[doc] == [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
    sizes = [int(x.name.split("-")[1]) for x in tmp_path.iterdir()]
    # Keys are dealt to parts by hash, so parts are not quite even.
    assert max(sizes) < 0.15 * sum(sizes) and len(sizes) > 10
