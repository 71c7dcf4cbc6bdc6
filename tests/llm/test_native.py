"""URL filters, chat formatting and quality rules on small tables."""

from __future__ import annotations

import hashlib
import re

import pytest

from evalframe.llm import chat_format, quality, url_rules
from evalframe.llm.queries import RULES

PAGES = "page_id bigint, url string, host string, rule string"


def _judged(spark, urls, rules=RULES):
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in urls], PAGES)
    return sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(df, rules).collect())


def test_rules_match_suffixes_and_prefixes_and_the_longest_wins(spark):
    got = _judged(spark, [
        (1, "http://Shop.Example.NET/en/x?q=/de/"), (2, "https://example.net/enx"), (3, "http://example.com/de/"),
        (4, "http://notexample.com/de/"), (5, "http://a.b.org/fr/1#top"), (6, "http://net"), (7, "http://x.net/"),
        (8, "http://www.example.com?x=/de/"),
    ])
    assert got == [
        (1, "shop.example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "/enx", "net/", "block"),
        (3, "example.com", "/de/", "example.com/de/", "block"), (4, "notexample.com", "/de/", None, "allow"),
        (5, "a.b.org", "/fr/1", "org/fr/", "allow"), (6, "net", "", None, "allow"), (7, "x.net", "/", "net/", "block"),
        (8, "www.example.com", "", None, "allow"),
    ]


def test_odd_urls_and_repeated_rows(spark):
    got = _judged(spark, [(1, "no scheme"), (1, "no scheme"), (2, "ftp://É.net/\n/a"), (3, ""), (4, "http://" + "a." * 5000 + "net/" + "b" * 9000)])
    assert [row[:2] for row in got[:4]] == [(1, ""), (1, ""), (2, "É.net"), (3, "")]
    assert got[4][3:] == ("net/", "block")
    null = spark.createDataFrame([(None, None, "h", "r"), (None, None, "h", "r")], PAGES)
    assert [tuple(r) for r in url_rules.judge_urls(null, RULES).collect()] == [(None, None, "", "", None, "allow")] * 2
    assert _judged(spark, []) == []
    assert _judged(spark, [(1, "http://a.net/")], ()) == [(1, "a.net", "/", None, "allow")]


def test_many_rules_shuffle_and_agree(spark, monkeypatch):
    urls = [(i, f"http://h{i % 7}.net/en/{i}") for i in range(50)]
    rules = [*RULES, url_rules.Rule("h3.net", "/en/1", "allow"), url_rules.Rule("net", "", "block")]
    broadcast = _judged(spark, urls, rules)
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", 0)
    assert _judged(spark, urls, rules) == broadcast
    assert ("h3.net/en/1" in {row[3] for row in broadcast})


def _digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_examples_hold_a_prefix_and_train_one_reply(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2"),
            (1, 4, "assistant", "a2"), (1, 5, "user", "late")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    examples = sorted(chat_format.format_conversations(df).collect(), key=lambda r: r.example)
    assert [r.n_turns for r in examples] == [3, 5, 6] and [r.final for r in examples] == [False, False, True]
    assert [r.text[r.loss_start : r.loss_start + r.loss_chars] for r in examples if r.loss_start is not None] == ["a1", "a2"]
    assert all(examples[2].text.startswith(r.text) for r in examples)


ODD = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>\n", "<~|end|>", "[~~INST] <|", "", "a\\1$2", "<s><~s>[/~INST]",
       "😀 <", "\n\n", "x" * 50_000 + "<|end|>"]


def test_control_strings_come_back(spark):
    rows = [(c, t, role, text, "z") for c, role in ((1, "user"), (2, "assistant"), (3, "<|end|>")) for t, text in enumerate(ODD)]
    rows += [(4, 0, None, None, "z"), (4, 0, "assistant", None, "z"), (None, 1, "assistant", "n", "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, example string")
    examples = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in chat_format.digests(examples).collect()}
    for conv, role in ((1, "user"), (2, "assistant"), (3, "<|end|>")):
        assert got[conv].turns_sha256 == _digest([(role, t) for t in ODD]) and got[conv].n_turns == len(ODD)
    whole = "".join(ODD)
    assert (got[2].loss_chars, got[2].loss_sha256) == (len(whole), hashlib.sha256(whole.encode()).hexdigest())
    assert got[1].loss_chars == 0 and got[1].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[4].turns_sha256 == _digest([("", ""), ("assistant", "")]) and got[None].n_turns == 1
    for row in examples.where("conv_id = 1").collect():
        assert len(re.findall(r"<\|turn\|>", row.text)) == row.n_turns
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).count() == 0


def _assess(documents, texts):
    got = quality.assess(documents([(i, t, "s") for i, t in enumerate(texts)])).collect()
    return [r.asDict() for r in sorted(got, key=lambda r: r.doc_id)]


def _repeated(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(hit)


@pytest.mark.parametrize("text", [
    "", "a", "a b c a b c", "a a a a", "a a a", "x y z q x y z q x y z", "one two\tthree\x0bone two\nthree", " a b c ", "\x85 \xa0 a",
    "a b c d " * 30 + "e f g", "the end " * 40,
])
def test_repeated_words_equal_brute_force(documents, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    got = _assess(documents, [text])[0]
    assert (got["n_words"], got["n_repeat_words"], got["word_chars"]) == (len(words), _repeated(words), sum(map(len, words)))


def test_lines_go_first_then_documents(documents):
    prose = "\n".join(f"Word{i} runs{i} past{i} the{i} quiet{i} river." for i in range(12))
    menu = "\n".join(["Home | News | Sport | Weather"] * 30)
    got = _assess(documents, [prose, menu, prose + "\n" + menu, prose + "\nAll rights reserved.\n\nREAD THIS NOW OK!!", None, prose, prose])
    assert [r["kept"] for r in got] == [True, False, False, True, False, True, True]
    assert got[3]["clean_text"] == prose + "\n"
    assert got[1]["n_dup_lines"] == 29 and got[1]["n_symbols"] == 90
    kept = quality.keep_good(documents([(1, prose + "\nx", "s"), (2, menu, "s")])).collect()
    assert [(r.doc_id, r.text, r.n_chars) for r in kept] == [(1, prose, len(prose))]
    assert quality.assess(documents([])).count() == 0


def test_long_text_is_judged_whole(documents):
    text = " ".join(f"w{i}" for i in range(60_000)) + " w1 w2 w3."
    got = _assess(documents, [text])[0]
    assert (got["n_words"], got["n_repeat_words"]) == (60_003, 0)
    got = _assess(documents, [text + " w1 w2 w3 w4."])[0]
    assert got["n_repeat_words"] == 6


def test_native_plans_have_no_python(spark):
    from evalframe.llm import queries

    for query in (queries.op3_url_filters, queries.op6_chat_format, queries.op8_quality_rules):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
