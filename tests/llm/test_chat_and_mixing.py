import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import chat, mixing
from plumbline.llm.queries import TOKENIZER

TEXT = st.lists(st.sampled_from([*"ab\\#</turn>: \n é日😀", "### ", "</turn>\n", "\\### Assistant: </turn> ok"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_template_is_reversible(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for _, a, b in spans] == [t for _, t in turns]


def test_chats_read_back(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "日本 é 😀\n\n ok"), (1, 2, "assistant", said), (2, 5, "assistant", None), (2, None, None, "x"), (3, 0, "user", "u"), (3, 0, "user", "u"), (None, 0, "assistant", "z"), (4, 0, "assistant", "long " * 20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chats(df, TOKENIZER)).collect()}
    assert got.keys() == {1, 2, 3, 4, None}
    for conv in got:
        own = sorted([(t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv])
        loss = "".join(text for _, _, role, text in own if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in own)
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(own), len(loss))
        assert (r["turns_sha256"], r["loss_sha256"]) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (whole, loss))
    assert chat.format_chats(df.limit(0), TOKENIZER).count() == 0


def mask_by_steps(offsets, spans):
    out = []
    for a, b in spans:
        done = a
        for t, (s, e) in enumerate(offsets):
            if e > a and s < b:
                lo = max(s, done)
                done = max(lo, min(e, b))
                out.append((t, lo, done))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4)), max_size=30), st.lists(st.tuples(st.integers(0, 6), st.integers(0, 9)), max_size=6))
def test_mask_against_steps(tokens, gaps):
    """Tokens that follow one another, or overlap in a character; spans that lie apart."""
    offsets, at, start = [], 0, 0
    for back, size in tokens:
        start = max(start, at - (back == 3))
        at = max(at, start + size)
        offsets.append((start, at))
    spans, at = [], 0
    for gap, size in gaps:
        spans.append((at + gap, at + gap + size))
        at += gap + size + 1
    assert list(zip(*(x.tolist() for x in chat.mask(offsets, spans)), strict=True)) == mask_by_steps(offsets, spans)


def fill(weights, caps, budget):
    """Water-filling by steps: each round shares what is left by weight among those with room."""
    out, left, open_ = [0] * len(caps), budget, [i for i, w in enumerate(weights) if w]
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if caps[i] * w <= left * weights[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] // w
            break
        for i in full:
            out[i] = caps[i]
        left -= sum(caps[i] for i in full)
        open_ = [i for i in open_ if i not in full]
    return out


@pytest.mark.parametrize("budget", [0, 7, 100, 100_000])
def test_budgets(spark, budget):
    leaves = [("a", "x", 10), ("a", "y", 50), ("b", "x", 5), ("b", "z", 40), ("c", "x", 1)]
    weights = [{"a": 3, "b": 1, "c": 0}, {"x": 2}]
    got = {(r["p"], r["q"]): r["budget"] for r in mixing.budgets(spark.createDataFrame(leaves, "p string, q string, supply long"), ["p", "q"], weights, budget, 2).collect()}
    top = fill([3, 1], [120, 90], budget)
    want = dict(zip([("a", "x"), ("a", "y")], fill([2, 1], [20, 100], top[0]), strict=True)) | dict(zip([("b", "x"), ("b", "z")], fill([2, 1], [10, 80], top[1]), strict=True))
    assert got == want


def test_mix_takes_prefixes_of_seeded_epochs(docs, rows, odd, empty):
    got = mixing.mix(docs, ["lang", "source"], [{"en": 5, "de": 1}, {}], share=(3, 4), max_epochs=3).collect()
    tokens = {i: len((t or "").split()) for i, t, *_ in rows}
    leaf = {i: (lang or "", source or "") for i, _, lang, source, *_ in rows}
    assert all(r["n_tokens"] == tokens[r["doc_id"]] and (r["lang"], r["source"]) == leaf[r["doc_id"]] for r in got)
    for key in set(leaf.values()):
        own = [r for r in got if (r["lang"], r["source"]) == key]
        if not own:
            continue
        budget, ids = own[0]["leaf_budget"], [i for i in leaf if leaf[i] == key]
        supply = sum(tokens[i] for i in ids)
        whole, rest = divmod(budget, supply)
        want, used = {(i, e) for i in ids for e in range(whole)}, 0
        for i in sorted(ids, key=lambda i: hashlib.md5(f"0:{whole}:{i}".encode()).hexdigest()):
            used += tokens[i]
            if used <= rest and rest:
                want.add((i, whole))
        assert {(r["doc_id"], r["epoch"]) for r in own} == want
    assert mixing.mix(empty, ["lang"], [{}]).count() == 0
    assert mixing.mix(odd, ["lang"], [{}], share=(1, 1)).count() == 4


@pytest.mark.parametrize("share", [(2, 1), (3, 4), (0, 1), (9, 1)])
def test_no_more_epochs_than_allowed(spark, monkeypatch, share):
    """Half of a leaf's documents are empty; no epoch goes beyond the limit, and prefixes of cut pieces fill the budget."""
    monkeypatch.setattr(mixing, "PIECE_DIGITS", 1)
    monkeypatch.setattr(mixing, "EDGE_ROWS", 4)
    rows = [(i, "" if i % 2 else "a b c", "l0") for i in range(600)] + [(1000 + i, None, "l1") for i in range(9)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["source"], [{}], share=share, max_epochs=2).collect()
    budget = min(900 * share[0] // share[1], 1800)
    assert all(r["epoch"] < 2 and r["leaf_budget"] == budget for r in got)
    assert budget - 3 < sum(r["n_tokens"] for r in got) <= budget
    assert len({(r["doc_id"], r["epoch"]) for r in got}) == len(got)
    if share[0] > share[1]:
        assert len(got) == 1200
