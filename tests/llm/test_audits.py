"""Divergence audit, benchmark decontamination and hard-negative mining against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from parley.llm import decontaminate as dc, divergence as dv, hard_negatives as hn

TERM = re.compile(dv.TERM)
LOWER = {c: c + 32 for c in range(65, 91)}


# ---- divergence ---------------------------------------------------------------------

def audited(rows, min_docs, top=50):
    """What the audit should give for (lang, source, text) rows."""
    tokens = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in {t[0] for t in tokens}:
        own = [t for t in tokens if t[0] == lang]
        in_docs = Counter(w for t in own for w in set(t[2]))
        kept = [w for w, n in in_docs.items() if n >= min_docs]
        counts = defaultdict(Counter)
        for _, source, words in own:
            counts[source].update(w for w in words if in_docs[w] >= min_docs)

        def share(c):
            total = sum(c.values())
            return {w: 1 + 10**9 * (c[w] + 5) // (total + 5 * len(kept)) for w in kept}

        shares, usual = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for source, p in shares.items():
            pairs = [(sum(abs(p[w] - q[w]) for w in kept), o) for o, q in shares.items() if o != source]
            terms = [(p[w] - usual[w], w) for w in kept if counts[source][w] and p[w] > usual[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found[:most])]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = ["The", "the", "the,", "(THE)", "ab1cd", "ab", "cd", "Été", "été", "über", "x y", "\U0001F600a", "3", "--", "a-b-a"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(300):
        text = " \n\t".join(rng.choice(words, rng.integers(0, 12)))
        rows.append(([None, "", "en", "fr"][min(i % 7, 3)], [None, "a", "b", "c", "ü"][rng.integers(5)], None if i % 31 == 0 else text))
    rows += rows[:9] + [("de", "only", "1 2 3"), ("de", "other", None), ("it", "lone", "uno " * 50_000)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    clash = df.withColumns({c: F.lit("z") for c in ("chunk", "n", "docs", "term", "item", "value", "rank", "p", "a.b")})
    for least in (1, 7, 30):
        assert sorted(map(tuple, dv.audit(clash, least).collect())) == audited(rows, least)
    assert dv.audit(df.limit(0)).count() == 0


def test_documents_are_told_apart_only_in_doubt(spark, monkeypatch):
    # every form of the term stays below the least, together they pass it in some and miss it in others
    rows = [("en", "a", "Word") for _ in range(4)] + [("en", "b", "word, word.") for _ in range(3)] + [("en", "b", "Rare rare") for _ in range(3)] + [("en", "c", "plenty") for _ in range(6)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    asked = []
    inner = dv._filter
    monkeypatch.setattr(dv, "_filter", lambda chunks: asked.append({r.chunk for r in chunks.collect()}) or inner(chunks))
    counts = dv.term_counts(df, 5)
    assert {r.term for r in counts.collect()} == {"word", "plenty"}
    assert asked == [{"Word", "word,", "word.", "Rare", "rare", "plenty"}, {"Word", "word,", "word.", "Rare", "rare"}]


def test_counts_of_a_task_are_handed_on_whole(spark, monkeypatch):
    monkeypatch.setattr(dv, "TEXT_BYTES", 3)
    import pyarrow as pa

    batch = lambda *texts: pa.record_batch([["en"] * len(texts), list(texts)], names=["lang", "text"])
    made = list(dv._documents(iter([batch("a b  c\x0bd ", "\ta a"), batch("a"), batch(""), batch("a\u00a0 a\u2003\x1cb"), pa.record_batch([pa.array([], pa.string())] * 2, names=["lang", "text"])])))
    n = Counter()
    for b in made:
        for chunk, k in zip(b.column("chunk").to_pylist(), b.column("docs").to_pylist()):
            n[chunk] += k
    assert len(made) >= 2 and n == {"a": 3, "b": 1, "c": 1, "d": 1, "a\u00a0": 1, "a\u2003\x1cb": 1}


def test_distances_in_blocks_equal_one_block(spark):
    rng = np.random.default_rng(2)
    rows = [("en", f"s{i % 23}", " ".join(rng.choice([f"t{chr(97 + k)}" for k in range(15)], 6))) for i in range(200)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    counts = dv.term_counts(df, 2)
    in_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    sizes = dv.group_sizes(counts, in_lang, df.select("lang", "source").distinct())
    shares = counts.join(sizes, ["lang", "source"]).select("lang", "source", "term", dv._share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    one = sorted(map(tuple, dv.source_distances(shares, sizes).collect()))
    assert sorted(map(tuple, dv.source_distances(shares, sizes, task_rows=40, source_block=5).collect())) == one and len(one) == 23 * 22


def test_shares_beyond_64_bits(spark):
    for n in (0, 2, 3 * 10**9, 4 * 10**9, 10**15):
        got = spark.range(1).select(dv._share(F.lit(n), F.lit(3 * n), F.lit(7)).alias("p")).first().p
        assert got == 1 + 10**9 * (n + 5) // (3 * n + 35)


# ---- decontamination ------------------------------------------------------------------

def hits(text, items, size):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    covered, found = set(), set()
    for name, item in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").translate(LOWER))
        for i in range(max(len(own) - size, 0) + 1) if own else []:
            w = own[i:i + size]
            for j in range(len(words) - len(w) + 1):
                if words[j:j + len(w)] == w:
                    covered.update(range(j, j + len(w)))
                    found.add("null" if name is None else str(name))
    return words, covered, found


WORD = st.sampled_from(["a", "b", "A", "ab", "é", "É", "1", "a "])
SENTENCE = st.lists(st.tuples(WORD, st.sampled_from([" ", "\n", ", ", "'"])).map("".join), max_size=14).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(SENTENCE, max_size=4), SENTENCE, st.integers(1, 5))
def test_any_windows_are_found_with_their_places(items, text, size):
    named = list(enumerate(items))
    words, covered, found = hits(text, named, size)
    machine = dc.Automaton.of([(str(n), dc.words_of(t)) for n, t in named if dc.words_of(t)], size) if any(map(dc.words_of, items)) else None
    if machine is not None:
        spans, got = machine.scan(dc.words_of(text))
        assert {w for a, b in spans for w in range(a, b)} == covered and got == found
        for (a, b), (x, y) in zip(spans, dc.char_spans(text, spans)):
            assert [w.decode() for w in dc.words_of(text[x:y])] == words[a:b]
            assert text[x:y].translate(LOWER).startswith(words[a]) and text[x:y].translate(LOWER).endswith(words[b - 1])


def test_items_are_found_in_odd_rows(spark):
    ten = " ".join(f"w{i}" for i in range(12))
    items = [(3, ten), (20, "Short one!"), (None, "no name here"), (3, "again three"), (7, None), (8, " ,. "), (100, ten.upper() + " more")]
    long = "pad " * 60_000 + ten + " pad" * 60_000
    texts = [(1, f"x {ten.replace(' ', '-')} y"), (2, None), (3, ""), (1, "short ONE short one"), (None, long), (5, "no name here; again three"), (6, "w0 w1 w2 w3 w4 w5 w6 w7 w8"), (6, "shorts one")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("items", "starts", "ends", "n_words", "item_id")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for most in (dc.AUTOMATON_WORDS, 13):
        got = dc.find_items(df, bench, automaton_words=most)
        rows = sorted((str(r.doc_id), r.n_words, r.n, ",".join(r["items"])) for r in got.withColumn("n", dc.n_hit()).collect())
        want = [(str(d), *(lambda w, c, f: (len(w), len(c), ",".join(sorted(f))))(*hits(t, items, 10))) for d, t in texts]
        assert rows == sorted(want)
        spans = {(r.doc_id, r.text[s.start:s.end]) for r in dc.passages(got).collect() for s in r.spans}
        assert (1, ten.replace(" ", "-")) in spans and (None, ten) in spans and (5, "no name here; again three") in spans
    assert dc.find_items(df.limit(0), bench).count() == 0
    assert all(not r["items"] and not r.starts for r in dc.find_items(df, bench.limit(0)).collect())
    assert dc.item_digest(["3", "20"]) == hashlib.sha256(b"20,3").hexdigest()


# ---- hard negatives -------------------------------------------------------------------

def mined(rows, asks, positives=5, negatives=3):
    """What mining should give for (id, vector, label) rows."""
    ok = [(i, v, lab) for i, (v, lab) in enumerate((r[1], r[2]) for r in rows) if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints = {i: [int(np.floor(256 * float(x))) for x in v] for i, v, _ in ok}
    label, out = {i: lab for i, _, lab in ok}, []
    order = lambda p: (-p[0], rows[p[1]][0] is None, rows[p[1]][0] or 0, p[1])
    for a in ints:
        if rows[a][0] is None or not asks(rows[a][0]):
            continue
        scored = [(sum(x * y for x, y in zip(ints[a], ints[b])), b) for b in ints if b != a and len(ints[a]) == len(ints[b])]
        for ps, p in sorted((x for x in scored if label[x[1]] == label[a]), key=order)[:positives]:
            fits = sorted((x for x in scored if label[x[1]] != label[a] and 50 * ps <= 100 * x[0] <= 95 * ps), key=order)[:negatives]
            out += [(rows[a][0], rows[p][0], k + 1, rows[n][0], ps, ns) for k, (ns, n) in enumerate(fits)]
    return sorted(out, key=repr)


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("shard_rows", [hn.SHARD_ROWS, 7])
def test_mining_equals_brute_force(spark, shard_rows):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 4 + (0.5 if i % 3 else 0)], int(rng.choice([0, 0, 0, 1, 2, 9]))) for i in range(120)]
    rows += [(5, [0.5] * 5, 1), (5, [0.5] * 5, 1), (10, [1.0, 2.0], 1), (200, [0.5, 0.5], 1), (201, [0.75, 0.5], 0), (None, [0.5] * 5, 0), (None, [1.0] * 5, 1),
             (300, None, 1), (305, [0.1] * 5, None), (310, [float("nan")] * 5, 1), (315, [float("inf")] + [0.0] * 4, 1), (320, [None] + [0.5] * 4, 1), (325, [], 1), (330, [], 2), (335, [], 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("z") for c in ("key", "vector", "code", "n", "shard", "asks", "score", "place", "rank")})
    got = hn.mine(df, F.col("vec_id") % 5 == 0, shard_rows=shard_rows).collect()
    assert sorted(map(tuple, got), key=repr) == mined(rows, lambda i: i % 5 == 0)
    assert hn.mine(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 20), st.integers(1, 30), st.integers(0, 2**32 - 1))
def test_shift_add_scores_are_exact(dims, rows, seed):
    rng = np.random.default_rng(seed)
    wide = int(rng.choice([1, 300, hn.WIDEST - 1]))
    a, c = rng.integers(-wide, wide + 1, (4, dims)), rng.integers(-wide, wide + 1, (rows, dims))
    bits = int(max(c.max(initial=0), -1 - c.min(initial=0))).bit_length() + 1
    assert (hn.scores(hn.subset_sums(a), hn.bit_planes(c, bits)) == c @ a.T).all()


def test_too_wide_components_are_an_error(spark):
    with pytest.raises(OverflowError):
        hn.mine(spark.createDataFrame([(0, [1e30], 1), (1, [1.0], 1)], SCHEMA), F.col("vec_id") == 0)
