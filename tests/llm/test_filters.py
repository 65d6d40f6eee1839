"""Secrets, quality, urls: planted cases, brute force, odd rows."""

import time
import base64
import hashlib
import json
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from parley.llm import quality, secrets, url_filter


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


def number(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


RSA = der(0x30, number(0), *[number(3 ** (40 + k)) for k in range(8)])
EC = der(0x30, number(1), der(4, bytes(range(32))), der(0xA0, der(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")))
PKCS8 = der(0x30, number(0), der(0x30, der(6, b"\x2b\x65\x70")), der(4, der(4, bytes(32))))
PUBLIC = der(0x30, der(0x30, der(6, b"\x2b\x65\x70")), der(3, b"\0" + bytes(range(60))))
SSH = secrets.SSH_MAGIC + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"".join(
    len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519" * 4, bytes(64)))


def b64url(x):
    return base64.urlsafe_b64encode(x).decode().rstrip("=")


JWT = f"{b64url(json.dumps({'alg': 'HS256', 'typ': 'JWT'}).encode())}.{b64url(json.dumps({'sub': '1'}).encode())}.{b64url(bytes(range(32)))}"


@pytest.mark.parametrize("blob,kind", [(RSA, "der"), (EC, "der"), (PKCS8, "der"), (SSH, "ssh")])
def test_keys_are_found_in_any_encoding(blob, kind):
    plain = base64.b64encode(blob).decode()
    lines = "\n".join(plain[i : i + 64] for i in range(0, len(plain), 64))
    for text in (f"see {plain} here", f"-----BEGIN KEY-----\n{lines}\n-----END KEY-----", f"x {blob.hex()} y", f"x {blob.hex().upper()} y"):
        hits = [s for s in secrets.scan(text) if s[0] == kind]
        assert len(hits) == 1, text
        found = text[hits[0][1] : hits[0][2]].replace("\n", "")
        assert found in (plain, blob.hex(), blob.hex().upper())


@pytest.mark.parametrize("blob,kind", [(RSA, "der"), (PUBLIC, "none"), (EC, "der"), (PKCS8, "der"), (SSH, "ssh")])
def test_keys_are_found_between_other_lines(blob, kind):
    plain = base64.b64encode(blob).decode()
    rows = [plain[i : i + 64] for i in range(0, len(plain), 64)]
    for gap in ("\n", "\n    ", " \r\n\t", "\\n", "\\r\\n", "\\\\n"):
        key, bare = gap.join(rows), gap.join(rows).rstrip("=")
        for text, want in ((f"key: |{gap}{key}{gap}-----END", key), (f'"-----BEGIN KEY-----{gap}{key}{gap}-----END KEY-----{gap}"', key), (f"{gap}{bare}{gap}two{gap}words", bare),
                           (f"a_name_of_more_than_24_letters{gap}{key}", key), (f"{'x' * 30}{gap}word{gap}{bare}{gap}one{gap}more{gap}line", bare)):
            hits = [s for s in secrets.scan(text) if s[0] not in secrets.BASE]
            assert [(s[0], text[s[1] : s[2]]) for s in hits] == ([(kind, want)] if kind != "none" else []), text


def test_tokens_after_other_segments():
    for before in ("session_token.", "a_long_segment.another_segment.", "x."):
        text = f"{before}{JWT} and {JWT}"
        want = [("jwt", len(before), len(before) + len(JWT)), ("jwt", len(text) - len(JWT), len(text))]
        assert [s for s in secrets.scan(text) if s[0] == "jwt"] == want
    assert [s for s in secrets.scan("abcdefghijklmnop." * 20_000) if s[0] == "jwt"] == []


def test_only_what_parses_is_reported():
    cut = base64.b64encode(RSA[:-1]).decode()
    longer = base64.b64encode(RSA + b"\0\0").decode()
    public = base64.b64encode(PUBLIC).decode()
    noise = base64.b64encode(hashlib.sha512(b"x").digest()).decode()
    unsigned = JWT.rsplit(".", 1)[0] + ".AAAAAAAAAA"
    unnamed = f"{b64url(b'{}')}aaaaaaaaaa.{JWT.split('.', 1)[1]}"
    for text in (cut, longer, public, noise, unsigned, unnamed, "A" * 200_000, "a." * 50_000, "-" * 100_000):
        assert [s for s in secrets.scan(text) if s[0] not in secrets.BASE] == []
    assert secrets.scan(f"bearer {JWT}!") == [("jwt", 7, 7 + len(JWT))]


def naive(text):
    """Base spans by testing every start in turn."""
    out = []
    words = {"assign": (re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)"""), 1, 12),
             "access": (re.compile("(AKIA[A-Z0-9]+)"), 1, 18), "hex": (re.compile("([0-9a-f]+)"), 1, 16)}
    for kind, (pattern, group, least) in words.items():
        at = 0
        while at < len(text):
            m = pattern.match(text, at)
            if m and m.end() > at:
                if len(m[group]) >= least:
                    out.append((kind, *m.span()))
                at = m.end()
            else:
                at += 1
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


PIECES = st.sampled_from(["password", "Token", "api_key", "APIKEY", "paſſword", "to\u212aen", "=", ":", " ", '"', "'", "AKIA", "AKIAAKIA", "ABCDEFGH12345678", "abcdef0123456789", "é", "\n", "x.y", "-", "9" * 16])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_base_spans_equal_brute_force(text):
    assert [s for s in secrets.scan(text) if s[0] in secrets.BASE] == naive(text)


def test_secrets_of_odd_rows(docs, clashing, none):
    for frame in (docs, clashing):
        rows = secrets.find_secrets(frame).collect()
        assert len(rows) == docs.count()
        assert [[s.kind for s in r.spans] for r in rows if r.doc_id == 8] == [["assign"]]
        assert all(r.spans == [] for r in rows if r.doc_id in (4, 5, 6))
        kept = secrets.recount(secrets.redact(frame))
        assert kept.columns == frame.columns and kept.count() == frame.count()
        assert kept.filter("doc_id = 8").first().text == "[secret] ok"
        assert kept.filter("doc_id = 8").first().n_chars == len("[secret] ok")
    assert secrets.find_secrets(none).count() == 0 and secrets.redact(none).count() == 0


def covered(words, width=8):
    at = {}
    for i in range(len(words) - width + 1):
        at.setdefault(tuple(words[i : i + width]), []).append(i)
    return len({i + j for starts in at.values() if len(starts) > 1 for i in starts for j in range(width)})


def test_repeated_windows_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abc"), n)) for n in (0, 7, 8, 9, 15, 16, 40, 200, 900)]
    block = " ".join(f"w{i}" for i in range(11))
    texts += ["x " * 30, f"{block} mid {block}", f" {block}\x0b{block}\x1f z", f"{block}\u00a0{block} {block}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.judge(df).select("row.*", "n_repeat_words", "n_words", "n_dup_lines").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        assert (r.n_words, r.n_repeat_words) == (len(words), covered(words)), r.text


def test_quality_of_odd_rows(docs, clashing, none):
    rows = quality.judge(docs).select("row.doc_id", "n_words", "n_dup_lines", "base_failed", "kept").collect()
    assert len(rows) == docs.count()
    assert all((r.n_words, r.base_failed, r.kept) == (0, True, False) for r in rows if r.doc_id in (4, 5, 6))
    assert {r.kept for r in rows if r.doc_id in (1, 2)} == {True}
    assert [r.kept for r in rows if r.doc_id == 3] == [False]  # all capitals
    kept = quality.keep_good(clashing)
    assert kept.columns == clashing.columns and kept.count() == quality.keep_good(docs).count() > 0
    assert quality.keep_good(none).count() == 0


def test_a_rule_table_of_ones_own(docs):
    rules = (quality.Rule("long", "mean_word_length", None, 1.0),)
    assert quality.judge(docs, rules=rules).filter("kept").count() == 0


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).select("row.doc_id", "base_failed", "kept").join(labels, "doc_id")
    good = rows.filter("quality = 1 and not base_failed")
    assert good.count() > 100 and good.filter("not kept").count() == 0
    assert rows.filter("quality = 0 and kept").count() < 0.03 * rows.filter("quality = 0").count()


PAGES = [
    (1, "http://A.Example.NET/en/1?x#y", None), (2, "https://a.example.net/fr/1", '<a href="http://friend.org/x">'), (3, "http://net", None),
    (4, "http://net/", ""), (5, None, "x"), (6, "no scheme", "x"), (7, "x://", "x"), (8, "http://b.example.com?q=/de/", "x"),
    (9, "http://b.example.com/de/", 'src=http://a.example.net/i.png'), (10, "http://org/fr/", "x"), (11, "http://sub.b.example.com/en", "x"),
    (12, "ftp://a://b/c", "x"), (13, "http://friend.org/a", '<A HREF="HTTP://Good.Org/"> <a href="http://good.org/2">'), (13, "http://friend.org/a", None),
    (14, "http://good.org/fr/", None), (15, "http://notexample.com/de/", None), (16, "http://h.net:80/x", None), (None, "http://x.org/fr/z", None),
]


def test_url_rules_and_parts(spark):
    got = {(r.page_id, r.host, r.path, r.rule) for r in url_filter.filter_urls(spark.createDataFrame(PAGES, "page_id long, url string, html string")).collect()}
    want = {
        (1, "a.example.net", "/en/1", "example.net/en/"), (2, "a.example.net", "/fr/1", "net/"), (3, "net", "", None), (4, "net", "/", "net/"),
        (5, "", "", None), (6, "", "", None), (7, "", "", None), (8, "b.example.com", "", None), (9, "b.example.com", "/de/", "example.com/de/"),
        (10, "org", "/fr/", "org/fr/"), (11, "sub.b.example.com", "/en", None), (12, "a:", "//b/c", None), (13, "friend.org", "/a", None),
        (14, "good.org", "/fr/", "org/fr/"), (15, "notexample.com", "/de/", None), (16, "h.net:80", "/x", None), (None, "x.org", "/fr/z", "org/fr/"),
    }
    assert got == want


def ranks(hosts, edges, seed, rounds, damping):
    total = sum(seed.values()) or 1
    start = {h: seed.get(h, 0) / total for h in hosts}
    rank = dict(start)
    out = {}
    for (a, _), w in edges.items():
        out[a] = out.get(a, 0) + w
    for _ in range(rounds):
        given = dict.fromkeys(hosts, 0.0)
        for (a, b), w in edges.items():
            given[b] += rank[a] * w / out[a]
        rank = {h: (1 - damping) * start[h] + damping * given[h] for h in hosts}
    return rank


def settled(hosts, edges):
    """Standing of every host against 400 rounds; what is left to come changes no verdict."""
    e, h = {(r.src, r.dst): r.weight for r in edges.collect()}, {r.host: r for r in hosts.collect()}
    trust = ranks(h, e, {k: r.allowed for k, r in h.items()}, 400, url_filter.DAMPING)
    back = ranks(h, {(b, a): w for (a, b), w in e.items()}, {k: r.blocked for k, r in h.items()}, 400, url_filter.DAMPING)
    got = {r.host: r for r in url_filter.standing(hosts, edges).collect()}
    assert set(got) == set(h)
    for k, r in got.items():
        t, d = trust[k] * len(h), back[k] * len(h)
        assert r.trust <= t + 1e-9 and r.distrust <= d + 1e-9
        assert r.bad == (d >= url_filter.THRESHOLD and d > t + url_filter.TOLERANCE)
    return got


def test_standing_equals_power_iteration(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    hosts, edges = url_filter.host_graph(pages)
    e = {(r.src, r.dst): r.weight for r in edges.collect()}
    assert e[("friend.org", "good.org")] == 1.0 and e[("b.example.com", "a.example.net")] == 1.0
    assert e[("sub.b.example.com", "b.example.com")] == e[("b.example.com", "sub.b.example.com")] == url_filter.PARENT_WEIGHT
    h = {r.host: r for r in hosts.collect()}
    settled(hosts, edges)
    verdicts = {r.page_id: r.verdict for r in url_filter.filter_urls(pages).collect()}
    assert verdicts[8] == "block" and verdicts[13] == "allow" and verdicts[5] == "allow"


def test_ranks_are_settled(spark):
    """A chain of links longer than any few rounds, blocked and allowed at either end."""
    rows = [(0, "http://h0.a/x", '<a href="http://h1.a/">')]
    rows += [(k, f"http://h{k}.a/x", f'<a href="http://h{k + 1}.a/"> <a href="http://h{k - 1}.a/">') for k in range(1, 20)]
    rows += [(20, "http://h20.a/x", '<a href="http://bad.net/">'), (21, "http://bad.net/x", '<a href="http://h20.a/">'), (22, "http://h0.org/fr/", '<a href="http://h0.a/">')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    hosts, edges = url_filter.host_graph(pages)
    got = settled(hosts, edges)
    assert got["h15.a"].distrust > 0 and {r.page_id for r in url_filter.filter_urls(pages).collect()} == set(range(23))


def test_ranks_of_rings_settle(spark):
    """What runs round a ring of seven comes back every seven rounds, not every block of rounds."""
    rows = [(k, f"http://r{k}.a/x", f'<a href="http://r{(k + 1) % 7}.a/">') for k in range(7)]
    rows += [(7, "http://r0.net/x", '<a href="http://r3.a/">'), (8, "http://good.org/fr/", '<a href="http://r5.a/">'), (9, "http://r4.a/y", '<a href="http://r0.net/">')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert settled(*url_filter.host_graph(pages))


def test_urls_with_clashing_columns_and_no_rows(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    odd = pages.withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "row", "known", "trust")})
    same = lambda d: sorted(url_filter.filter_urls(d).select("page_id", "verdict").collect(), key=str)
    assert same(odd) == same(pages)
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("head,line", [
    ("", "b3BlbnNzaC1rZXktdjEAAAAABG5vbmUA"), ("", "MIIEvQIBADANBgkqhkiG9w0BAQEFAASC"), ("b3BlbnNzaC1rZXktdjEAAAAAAAAAAAAAAAAA\n", "A" * 32), ("", "MIAwADAAMAAwADAAMAAwADAAMAAwADAA"),
    ("", "MIQAAAAAAgEAAgEAAgEAAgEAAgEAAgEA")])
def test_lines_that_look_like_keys_take_linear_time(head, line):
    text = head + (line + "\n") * (5_000_000 // len(line))
    start = time.perf_counter()
    secrets.scan(text)
    assert time.perf_counter() - start < 5


def test_bytes_are_decoded_where_they_are_read():
    raw = bytes(range(256)) * 3
    chars = "xy" + base64.b64encode(raw).decode().rstrip("=")
    coded = secrets.Coded(chars, 2, len(raw))
    for a in range(0, 40):
        assert coded[a] == raw[a]
        for b in (a, a + 1, a + 5, 767, 900):
            assert coded[a:b] == raw[a:b]
