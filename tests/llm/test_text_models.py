"""Chat, token counts and the language model."""

import hashlib
import math
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from parley.llm import chat, lm, token_counts as tc

PARTS = st.sampled_from(["<|im_start|>", "<|im_end|>", "<\\|im_end|>", "<\\\\|im_start|>", "<", "|", "\\", "n", "\n", "\\n", "im_end|>", "a b", "é", "<|", "assistant"])
TEXT = st.lists(PARTS, max_size=8).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_any_turns_come_back(turns):
    pieces = [chat.render(role, text) for role, text in turns]
    assert [t[:2] for t in chat.parse("".join(pieces))] == turns
    for piece in pieces:
        assert piece.count(chat.START) == piece.count(chat.END) == 1


def test_plain_turns_are_written_as_they_are():
    assert chat.render("user", "a < b |im_end|") == "<|im_start|>user\na < b |im_end|<|im_end|>\n"
    for broken in ("x", "<|im_start|>user\nno end", "<|im_start|>user\na<|im_end|>", "<|im_start|>u\na<|im_start|>b<|im_end|>\n"):
        with pytest.raises(ValueError):
            chat.parse(broken)


def test_conversations_of_odd_rows(spark):
    rows = [(1, 2, "assistant", "two <|im_end|>"), (1, 1, "user", None), (1, 3, "assistant", "é"), (1, 3, "assistant", "é"), (None, None, None, None),
            (2, 1, "a\nb", "x" * 200_000), (3, None, "assistant", ""), (3, 0, "user", "last")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df.withColumns({c: F.lit(1) for c in ("piece", "seq", "start")}))).collect()}
    assert set(got) == {1, 2, 3, None}

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    assert got[1].turns_sha256 == sha("user\n\nassistant\ntwo <|im_end|>\nassistant\né\nassistant\né\n")
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (4, 16, sha("two <|im_end|>éé"))
    assert got[None].turns_sha256 == sha("\n\n") and got[2].turns_sha256 == sha("a\nb\n" + "x" * 200_000 + "\n")
    assert got[3].turns_sha256 == sha("assistant\n\nuser\nlast\n") and got[3].loss_chars == 0
    pieces = chat.format_conversations(df).filter("conv_id = 1").orderBy("seq").collect()
    whole = "".join(p.piece for p in pieces)
    assert len(whole) == got[1].formatted_chars
    assert [chat.unescape(whole[p.loss_start : p.loss_end]) for p in pieces if p.loss_start is not None] == ["two <|im_end|>", "é", "é"]
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def ranks():
    with open(tc.VOCABULARY, "rb") as f:
        return f.read()


COUNTER = tc.Counter(ranks())
PIECE = st.sampled_from(["a", "word", " ", "  ", "\n", "\n\n", "'", "'s", "'ll", "1", "12345678", "é", "!?", "\t", "日本", "<", " x", "\u00a0"])
SOME = st.lists(PIECE, max_size=150).map("".join)


@settings(max_examples=400, deadline=None)
@given(SOME, st.data())
def test_edited_trees_equal_a_fresh_encoding(text, data):
    old, tc.BLOCK = tc.BLOCK, data.draw(st.sampled_from([1, 2, 3, 32]))
    try:
        tree = tc.TokenTree(COUNTER, text)
        assert tree.n_tokens == len(COUNTER.encoding.encode_ordinary(text))
        for _ in range(data.draw(st.integers(0, 5))):
            a, b = sorted((data.draw(st.integers(0, len(tree.text))), data.draw(st.integers(0, len(tree.text)))))
            want = tree.text[:a] + (new := data.draw(st.one_of(st.just(""), SOME))) + tree.text[b:]
            tree.edit(a, b, new)
            assert tree.text == want and tree.n_tokens == len(COUNTER.encoding.encode_ordinary(want))
            assert int(tree.sums[1, 0]) == len(want)
    finally:
        tc.BLOCK = old


def test_a_small_edit_recounts_little():
    text = " ".join(f"word{i}" for i in range(20_000))
    tree = tc.TokenTree(COUNTER, text)
    tree.edit(60_000, 60_004, "other")
    assert tree.n_tokens == len(COUNTER.encoding.encode_ordinary(tree.text)) and tree.recounted <= 3 * tc.BLOCK


def test_token_counts_of_odd_rows(docs, clashing, none):
    encoding = COUNTER.encoding
    for frame in (docs, clashing):
        rows = tc.count_tokens(frame).collect()
        assert len(rows) == docs.count()
        texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in (9, None)}
        for r in rows:
            if r.doc_id in texts:
                text = after = texts[r.doc_id] or ""
                for s, e, new in reversed(tc.cleaning_edits(text)):
                    after = after[:s] + new + after[e:]
                assert (r.n_tokens, r.n_tokens_after) == (len(encoding.encode_ordinary(text)), len(encoding.encode_ordinary(after)))
    assert tc.count_tokens(none).count() == 0


def test_cleaning_edits():
    assert tc.cleaning_edits("a\nb 1234567\na\n\nb 1234567\n") == [(2 + 2, 11, "<number>"), (12, 14, ""), (15, 25, "")]


def test_levels_and_means():
    for c in [*range(1, 3000), 10**6, 10**9]:
        q = int(lm.levels(np.array([c]))[0])
        assert lm.BASE ** (q - 1) <= c < lm.BASE**q
        assert abs(lm.MEANS[q] - c) <= 0.5 * c


def test_filter_never_reads_too_low_and_rarely_too_high():
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(0, 2**64, 20_000, np.uint64, endpoint=False))
    counts = np.ceil(rng.pareto(1.0, len(hashes)) + 1).astype(np.int64)
    kept = lm.Filter({0: lm.filter_segment(hashes, counts)}, 64)
    got = kept.counts(hashes)
    true = lm.MEANS[lm.levels(counts)]
    assert (got >= true).all() and (got > true).mean() < 0.08
    other = rng.integers(0, 2**64, 20_000, np.uint64, endpoint=False)
    assert (kept.counts(other) > 0).mean() < 0.08
    assert (lm.Filter({}, 64).counts(other) == 0).all()


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def test_scores_equal_brute_force(spark, docs, clashing):
    held = F.coalesce(F.col("doc_id") % 3 == 2, F.lit(False))
    train = docs.filter(~held)
    counts, pairs = Counter(), Counter()
    for r in train.collect():
        t = tokens(r.text)
        counts.update(t)
        pairs.update(zip(["\n", *t], t))
    n, v = sum(counts.values()), len(counts)
    level = lambda c: float(lm.MEANS[lm.levels(np.array([c]))[0]]) if c else 0.0
    model = lm.train(train, bits_per_entry=256)  # so that no probe reads too high
    assert (model.tokens, model.types) == (n, v)
    rows = lm.score(docs, model, F.col("doc_id") % 3 == 2).collect()
    assert len(rows) == docs.count() and {r.doc_id for r in rows if r.held_out} == {2, 5, 8}
    want = {}
    for r in docs.collect():
        t = tokens(r.text)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t)
        smooth = sum(math.log10((min(level(pairs[a, w]), level(counts[a])) + lm.SMOOTHING * (level(counts[w]) + 1) / (n + v + 1)) / (level(counts[a]) + lm.SMOOTHING))
                     for a, w in zip(["\n", *t], t))
        want.setdefault(r.doc_id, []).append((len(t), sum(counts[w] > 0 for w in t), n, base, smooth))
    for r in rows:
        near = [x for x in want[r.doc_id] if x[:3] == (r.n_tokens, r.n_known, r.train_tokens) and x[3] == pytest.approx(r.base_score)]
        assert near, r
        assert r.score == pytest.approx(near[0][4], rel=1e-4)
    split = lm.score(clashing, model, F.col("doc_id") % 3 == 2, max_mb=1)
    assert split.count() == len(rows)


def test_passes_change_nothing(docs, monkeypatch):
    model = lm.train(docs)
    key = lambda d: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in d.collect())
    one = key(lm.score(docs, model))
    for cut in ((3, 1), (1, 2), (2, 3)):
        monkeypatch.setattr(lm, "passes", lambda m, mb: cut)
        assert key(lm.score(docs, model)) == one


def test_passes_follow_the_size_of_the_model(docs):
    model = lm.train(docs)
    assert lm.passes(model, 512) == (1, 1)
    size = lambda n, *cols: model.segments.filter(f"n = {n}").agg(sum(F.sum(F.octet_length(c)) for c in cols)).first()[0]
    unigrams, rest = size(1, "filter"), size(2, "filter") + size(1, "hashes", "counts")
    many = model._replace(segments=model.segments.crossJoin(model.segments.sparkSession.range(300)))
    of, cuts = lm.passes(many, 1)
    assert 300 * rest / of <= 1 << 19 and (cuts == 1 or 2 * 300 * unigrams / cuts <= 1 << 19) and cuts > 1


def test_no_training_texts(docs, none):
    rows = lm.score(docs, lm.train(none)).collect()
    assert len(rows) == docs.count() and all(r.base_score == r.score == r.n_known == 0 for r in rows)
    assert lm.score(none, lm.train(docs)).count() == 0


def test_held_out_texts_score_better_than_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    out = lm.score(docs, lm.train(docs.filter(~held)), held).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_edits_of_repeated_lines_take_linear_time():
    """Every edit costs the blocks it touches, wherever it is; empty blocks are passed by their sums."""
    text = "\n".join(["a repeated line of text"] * 32_000)
    tree, steps = tc.TokenTree(COUNTER, text), []
    tree._next, inner = lambda k: steps.append(k) or inner(k), tree._next
    start = time.perf_counter()
    for edit in reversed(tc.cleaning_edits(text)):
        tree.edit(*edit)
    assert time.perf_counter() - start < 5
    assert tree.text == "a repeated line of text\n" and tree.n_tokens == tc.TokenTree(COUNTER, tree.text).n_tokens
    assert len(steps) < 4 * 32_000 and tree.recounted < 4 * tc.BLOCK * 32_000
