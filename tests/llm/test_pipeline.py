"""The corpus pipeline as a chain, each stage against brute force on what the one before wrote."""

from __future__ import annotations

import collections
import math
import random
import re

import corpus_pipeline
from test_sets import _count, _lcs, _shingles, _words

MENU, SHARED = "HOME | NEWS | SPORT", "Read on in our next issue."


def _planted(rng):
    item = _words(rng, 20)
    rows = []
    for i in range(48):
        lines = [" ".join(_words(rng, 12)) + "." for _ in range(7)]
        if i % 6 == 1:  # the item, cut in two by a line that the first stage removes
            lines[3:3] = [" ".join(item[:10]) + ".", MENU, " ".join(item[10:]) + "."]
        if i % 4 == 0:
            lines.insert(2, SHARED)
        if i % 6 == 2:  # a near copy only once menus and shared lines are gone
            copy = [x for k, line in enumerate(lines) for x in ((line, MENU, SHARED) if k % 2 else (line,))]
            rows.append((100 + i, copy))
        if i % 8 == 5 or i == 0:  # too little is left; row 0 would be the shared line's first place
            lines = [*lines, *[MENU] * 40]
        rows.append((i, [SHARED, *lines] if i == 0 else lines))
    rng.shuffle(rows)
    return item, [(i, "\n".join(lines), f"s{i // 4 % 12}") for i, lines in rows]


def _quality(rows):
    clean = [(i, t, [x for x in t.split("\n") if x.endswith(".")], s) for i, t, s in rows]
    chars = lambda x: len("".join(x.split()))
    return [(i, "\n".join(c), s) for i, t, c, s in clean if len(t.split()) >= 50 and 2 * chars("\n".join(c)) >= chars(t)]


def _lines(rows):
    sites = collections.defaultdict(set)
    for _, text, source in rows:
        for line in text.split("\n"):
            sites[line].add(source)
    seen, out = set(), []
    for i, text, source in sorted(rows):
        stay = []
        for line in text.split("\n"):
            if len(sites[line]) < 10 or line not in seen:
                stay.append(line)
            seen.add(line)
        out.append((i, "\n".join(stay), source))
    return out


def _near(rows):
    parts = {i: list(_shingles(re.findall(r"\w+", t)).elements()) for i, t, _ in rows}
    at = {i: i for i in parts}
    for a in sorted(parts):
        for b in sorted(parts):
            if a < b and at[a] != at[b] and len(set(parts[a]) & set(parts[b])) > 20:
                common = _lcs(parts[a], parts[b])
                if common / (len(parts[a]) + len(parts[b]) - common) >= 0.8:
                    low, high = sorted((at[a], at[b]))
                    at = {k: low if v == high else v for k, v in at.items()}
    return [x for x in rows if at[x[0]] == x[0]]


def _clean(rows, item):
    def leaks(words):
        for k in range(max(1, len(words) - len(item) + 1)):
            a, b = _shingles(words[k : k + len(item)]), _shingles(item)
            if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                return True
        return False

    return [x for x in rows if not leaks(re.findall(r"\w+", x[1]))]


def _mixed(rows):
    chars = collections.Counter()
    for _, text, source in rows:
        chars[source] += len(text)
    weight = {s: math.sqrt(n) for s, n in chars.items()}
    rate = {s: weight[s] / sum(weight.values()) * sum(chars.values()) / chars[s] for s in chars}
    return [(*x, n + 1) for x in rows for n in range(_count(x[0], rate[x[2]]))]


def test_each_stage_works_on_what_the_one_before_wrote(spark, documents, monkeypatch, tmp_path):
    item, rows = _planted(random.Random(21))
    documents(rows).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, write = {}, corpus_pipeline.written

    def noted(df, name):
        kept[name] = write(df, name)
        return kept[name]

    monkeypatch.setattr(corpus_pipeline, "written", noted)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    before = rows
    for name, brute in zip(
        ("quality-rules", "line-dedup", "near-dedup", "decontamination"),
        (_quality, _lines, _near, lambda x: _clean(x, item)), strict=True,
    ):
        stage = kept.pop(name).collect()
        after = sorted((r.doc_id, r.text, r.source) for r in stage)
        assert after == sorted(brute(before)) and after != sorted(before), name
        assert all(r.n_chars == len(r.text) for r in stage)
        before = after
    assert not kept and sorted((r.doc_id, r.text, r.source, r.copy) for r in got) == sorted(_mixed(before))


def _run(spark, documents, rows, items, path):
    documents(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(path))


def test_odd_rows_pass_through_all_stages(spark, documents, tmp_path):
    rng = random.Random(3)
    good = ["\n".join(" ".join(_words(rng, 15)) + "." for _ in range(6)) for _ in range(6)]
    long = "\n".join(" ".join(_words(rng, 15)) + "." for _ in range(8_000))
    rows = [(1, None, "s"), (2, "", "s"), (None, None, None), (3, " \n\n", "s"),
            (4, good[0], None), (None, good[1], "s"), (None, good[2], None), (5, good[2], "s"),
            (6, good[3], "s"), (6, good[3], "s"), (7, good[4], "t"), (7, good[5], "t"), (8, long, "u")]
    got = _run(spark, documents, rows, [(1, None), (2, "")], tmp_path)
    assert got.columns == [*corpus_pipeline.COLUMNS, "copy"]
    told = collections.Counter((r.doc_id, r.text, r.source) for r in got.collect())
    stay = [(4, good[0], None), (None, good[1], "s"), (5, good[2], "s"), (6, good[3], "s"), (6, good[3], "s"),
            (7, good[4], "t"), (7, good[5], "t"), (8, long, "u")]
    # Every document is copied as often as its id and its source's rate say; equal rows alike.
    chars = collections.Counter()
    for _, text, source in stay:
        chars[source] += len(text)
    weight = {s: math.sqrt(n) for s, n in chars.items()}
    rate = {s: weight[s] / sum(weight.values()) * sum(chars.values()) / chars[s] for s in chars}
    want = collections.Counter()
    for row in stay:
        want[row] += _count("" if row[0] is None else row[0], rate[row[2]])
    assert told == collections.Counter({k: n for k, n in want.items() if n})


def test_no_documents_give_no_result(spark, documents, tmp_path):
    got = _run(spark, documents, [], [(1, "an item of some words in a row")], tmp_path)
    assert got.collect() == [] and got.columns == [*corpus_pipeline.COLUMNS, "copy"]
