import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.llm import chunking, lookalike, mixing, tokens

ODD = ["", None, " ", "\n\n", "it's I'll we've", "a  b　 c", "<|endoftext|> x", "é ​👩‍🔬", "字" * 3000, "x" * 5000, "12 345 ½²³", "tab\tand\x01control\x85next", "Привет, мир! 你好。", "﻿\x00"]


def test_tokens_equal_the_library_and_come_back(spark):
    frame = spark.createDataFrame([(i, t, "e") for i, t in enumerate(ODD)] + [(4, ODD[4], "e")], "doc_id long, text string, ids string")
    encoded = tokens.token_ids(frame)
    got = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
    model = tokens.tokenizer()
    assert got == {i: model.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(ODD)}
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(frame.dropDuplicates(["doc_id"])).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    back = {r["doc_id"]: r["text"] for r in tokens.decoded_texts(encoded).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    assert tokens.token_ids(frame.limit(0)).count() == 0


def test_rare_words_take_the_other_way(spark, monkeypatch):
    model = tokens.tokenizer()
    texts = ["the cat and the dog and the bird", "=" * 3000 + " and " + "=" * 3000, "", None, " bird", "zebra the", *["=" * 3000] * 20]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for words, bytes_, share in ((2, 16_000_000, 1e-4), (200_000, 60, 0.05), (0, 0, 0.5)):
        monkeypatch.setattr(tokens, "BROADCAST_WORDS", words)
        monkeypatch.setattr(tokens, "BROADCAST_BYTES", bytes_)
        monkeypatch.setattr(tokens, "HOT_SHARE", share)
        got = {r["doc_id"]: list(r["ids"]) for r in tokens.token_ids(frame).collect()}
        assert got == {i: model.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
        assert {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(frame).collect()} == {i: len(x) for i, x in got.items()}


def test_one_look(spark):
    same = [("Cаfе́ ﬁne", "Café fine"), ("ＡＢ１　x", "AB1 x"), ("a​b­", "ab"), ("ѕеаrсh", "search"), ("⼀⼈", "一人"), ("が", "が")]
    n = next(i for i, p in enumerate(same) if p[1] == "ab")
    other = [("Cafe", "Café"), ("a", "A"), ("x2", "x²"), ("a b", "a  b"), ("a\nb", "a b"), ("a!", "a"), ("ß", "ss")]
    rows = [(i, t) for i, t in enumerate(x for pair in same + other for x in pair)]
    frame = spark.createDataFrame([*rows, (100, None), (101, ""), (102, "​ "), (103, " "), (104, "ab")], "doc_id long, text string")
    forms = {r["doc_id"]: r["form"] for r in lookalike.consistent_form(frame).collect()}
    assert all(forms[2 * i] == forms[2 * i + 1] for i in range(len(same))) and all(forms[2 * i] != forms[2 * i + 1] for i in range(len(same), len(same + other)))
    assert forms[100] is None and forms[101] == "" and all(unicodedata.is_normalized("NFC", f) for f in forms.values() if f)
    found = [tuple(r) for r in lookalike.look_alike_pairs(frame.unionByName(frame.where("doc_id < 4"))).collect()]
    pairs = set(found)
    assert len(found) == len(pairs)
    assert {(2 * i, 2 * i + 1) for i in range(len(same))} <= pairs and not any(a >= 2 * len(same) or b in (101, 102, 103) for a, b in pairs) and (2 * n + 1, 104) not in pairs and (2 * n, 104) in pairs
    classes = {r["doc_id"]: r["representative"] for r in lookalike.look_alike_classes(frame).collect()}
    assert classes.keys() == {x for p in pairs for x in p} and all(classes[a] == classes[b] for a, b in pairs) and classes[104] == 2 * n
    table = lookalike.mapping()
    assert all("".join(table.get(x, x) for x in v) == v for v in table.values())


def test_recomposition_equals_the_standard(spark):
    """Letters, marks of many classes in any order and number, syllables and marks without a letter, against the library."""
    import random

    r = random.Random(4)
    letters = "aeouAEOU ńéüq字가ㄱ가각ကৌেো"
    marks = [chr(i) for i in (0x300, 0x301, 0x302, 0x303, 0x304, 0x307, 0x308, 0x30A, 0x30C, 0x31B, 0x323, 0x327, 0x328, 0x331, 0x345, 0x3099, 0x9BE, 0x102E, 0x340, 0x344)]
    texts = ["".join(r.choice(letters) + "".join(r.choice(marks) for _ in range(r.choice((0, 0, 1, 2, 3, 9)))) for _ in range(r.randint(1, 8))) for _ in range(400)] + ["\u0301\u0323a", "\u0323\u0301", "a" + "\u0301" * 500]
    forms = {x["doc_id"]: x["form"] for x in lookalike.consistent_form(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    wrong = [(t, forms[i]) for i, t in enumerate(texts) if forms[i] != unicodedata.normalize("NFC", t)]
    assert not wrong


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab .\n。字́"), max_size=120), max_size=5), st.integers(1, 40), st.integers(0, 30))
def test_pieces_cover_the_text(parts, most, overlap):
    text = "".join(parts)
    ends = np.cumsum([len(p) for p in parts])[:-1] if parts else np.array([], int)
    got = chunking.cut(text, most, overlap, ends)
    kept = min(overlap, most - 1)
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(e - s <= most for s, e, _ in got)
    assert all(b[0] == a[1] - kept and b[1] > a[1] for a, b in zip(got, got[1:]))
    assert text[: got[0][1]] + "".join(text[s + kept : e] for s, e, _ in got[1:]) == text


def test_natural_boundaries_first():
    text = "One two three. Four five six.\n\n" + "Seven eight nine ten eleven. " * 3
    kinds = [k for _, _, k in chunking.cut(text, 40, 5)]
    assert kinds[0] == "paragraph" and "hard" not in kinds
    assert [k for _, _, k in chunking.cut("x" * 100, 40, 5)][:-1] == ["hard"] * 2
    assert [(s, e) for s, e, _ in chunking.cut("a" * 100, 10, 8)][:3] == [(0, 10), (2, 12), (4, 14)]


def test_oversized_items(spark):
    limits = spark.createDataFrame([("message", 10, 3), ("conversation", 12, 2)], "item_kind string, max_chars long, overlap_chars long")
    rows = spark.createDataFrame([(1, "0123456789"), (2, "0123 456789"), (3, None), (4, "👩" * 11), (5, "")], "row_id long, content string")
    assert {r["item_key"] for r in chunking.message_pieces(rows, limits).collect()} == {"2", "4"}
    talks = spark.createDataFrame([("a", [("u", "0123456", None), ("v", None, None), ("w", "789abcd", None)]), ("b", None), ("c", [])], "id string, messages array<struct<role:string,content:string,timestamp:string>>")
    pieces = chunking.conversation_pieces(talks, limits).orderBy("piece_no").collect()
    assert [(r["item_key"], r["piece"], r["boundary"]) for r in pieces] == [("a", "0123456", "message"), ("a", "56789abcd", "end")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.floats(0, 1)), max_size=40), st.integers(0, 5))
def test_pivot_keeps_the_expected_size(items, seed):
    rows = [[i, s, p] for i, (s, p) in enumerate(items)]
    decided, left = mixing.pivot([list(r) for r in rows], np.random.default_rng(seed))
    assert sorted([t for t, _ in decided] + ([left[0]] if left else [])) == list(range(len(rows)))
    wanted = sum(s * p for s, p in items if s > 0)
    got = sum(rows[t][1] * bit for t, bit in decided) + (left[1] * left[2] if left else 0)
    assert abs(wanted - got) < 1e-4


def test_pivot_is_fair():
    hits = np.zeros(4)
    for seed in range(3000):
        decided, left = mixing.pivot([[0, 3, 0.2], [1, 7, 0.5], [2, 5, 0.7], [3, 2, 0.4]], np.random.default_rng(seed))
        for t, bit in decided:
            hits[t] += bit
        if left:
            hits[left[0]] += left[2]
    assert np.abs(hits / 3000 - [0.2, 0.5, 0.7, 0.4]).max() < 0.03


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    docs = [(i, "word " * (1 + i % 7), "big" if i % 3 else "mid" if i % 2 else "tiny" if i < 60 else None) for i in range(600)]
    frame = spark.createDataFrame(docs + [(900, None, "big"), (901, "", "mid")], "doc_id long, text string, source string").repartition(9)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    rows = {r["source"]: r for r in mixing.mix_report(frame, targets).collect()}
    assert set(rows) == {"big", "mid", "tiny", "none"} and rows["none"]["actual_share"] == 0 and not rows["none"]["met"]
    for name, share in (("big", 5 / 9), ("mid", 3 / 9), ("tiny", 1 / 9)):
        assert abs(rows[name]["goal_share"] - share) < 1e-9 and rows[name]["goal_met"] or abs(rows[name]["actual_share"] - share) < 0.02
        assert rows[name]["most_copies"] <= rows[name]["max_repeats"]
    assert abs(sum(r["actual_share"] for r in rows.values()) - 1) < 1e-9
    short = {r["source"]: r for r in mixing.mix_report(frame, targets, total_tokens=10_000).collect()}
    assert short["tiny"]["tokens"] == 3 * short["tiny"]["source_tokens"] and not short["tiny"]["met"]
    copies, _ = mixing.mixed_copies(frame, targets)
    assert copies.where("copies is null").count() == 0 and copies.count() == copies.select("doc_id").distinct().count()
    assert mixing.mix_report(frame.limit(0), targets).agg(F.sum("tokens")).first()[0] == 0
