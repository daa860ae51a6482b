"""Secret scans, archives, URL filters."""

import base64
import hashlib
import math
import random
import re
import string
from collections import Counter, defaultdict

import pytest

from sieveworks.llm.common import new_path
from sieveworks.llm.secret_scan import Battery, base_spans, battery, cutoffs, encoding_of, evidence, find_secrets, rival, runs, sha256_of
from sieveworks.llm.url_filter import Reputation, UrlRule, filter_urls
from sieveworks.llm.warc import Layout, chunked, parse, read_archives, reassemble, unchunk, write_archives

RNG = random.Random(8)
RANDOM64 = "".join(RNG.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(44))


def brute_spans(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    for n, kind, pattern, least in ((1, "access", r"AKIA[A-Z0-9]+", 20), (2, "hex", r"[0-9a-f]+", 24)):
        out += [(m.start(), n, m.end(), kind) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [(a, b, k) for a, _, b, k in sorted(out)]


@pytest.mark.parametrize("text", ["api_key=token:secret12 Token = 'abcdef'", "AKIA" + "A1" * 8 + " XAKIAB AKIAKIA" + "Z" * 16, "é 0123456789abcdef01234567 secreT\x20:\x20\"" + "a" * 30, "paſſword=abcdefg toKen=abcdefg password = short", ""])
def test_base_spans(text):
    assert base_spans(text) == brute_spans(text)


def test_battery_and_discovery_control(spark, odd_docs, no_docs):
    assert encoding_of(RANDOM64) == "base64" and encoding_of("ordinarywordsareplain") is None and encoding_of("1234567890" * 3) is None
    assert battery(RANDOM64, "base64") >= 0.01 and battery("AbAbAbAbAbAbAbAbAbAbAbAb1", "base62") < 0.01
    assert evidence(RANDOM64, "base64", rival({})) > 6 and evidence("ThisIsAnOrdinaryName01", "base62", rival({})) < 2
    assert list(runs(f"id-{RANDOM64} a_b-{'c' * 20}", 20)) == [(3, 3 + len(RANDOM64)), (4 + len(RANDOM64), 28 + len(RANDOM64))]
    assert cutoffs([(6, 0, 1000), (6, 9, 5), (5, 1, 10)], Battery(fdr=0.01)) == {6: 5}
    docs = [(1, f"key {RANDOM64} end"), (2, "ThisIsAnOrdinaryIdentifierName and CamelCaseWordsAreNotSecrets_ok"), (3, f"token = {RANDOM64}"), (4, None)]
    got = {r["doc_id"]: r for r in find_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1]["spans"] == f"random:4:{4 + len(RANDOM64)}" and got[2]["spans"] == "" and got[4]["n_assign"] == 0
    assert got[3]["spans"] == f"assign:0:{8 + len(RANDOM64)}" and got[3]["base_sha256"] == sha256_of(brute_spans(docs[2][1]))
    assert got[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert find_secrets(odd_docs).count() == odd_docs.count() and find_secrets(no_docs).count() == 0


def brute_random(texts, how):
    """Spans of random strings, by the definitions: every p-value, then Benjamini-Hochberg by steps of ten."""
    sets = [string.digits + "abcdef", string.digits + "ABCDEF", string.ascii_uppercase + "234567", string.digits + string.ascii_lowercase, string.digits + string.ascii_uppercase]
    sets += [string.ascii_letters + string.digits + x for x in ("", "+/", "-_")]
    order = [string.digits + "abcdef", string.digits + "ABCDEF", string.ascii_uppercase + "234567", string.digits + string.ascii_lowercase, string.digits + string.ascii_uppercase]
    order += [string.ascii_uppercase + string.ascii_lowercase + string.digits + x for x in ("", "+/", "-_")]
    prior = {c: 10_000 * s / len(cs) for cs, s in ((string.ascii_lowercase, 0.86), (string.ascii_uppercase, 0.08), (string.digits, 0.04), ("+/-_", 0.02)) for c in cs}
    seen = Counter(c for t in texts.values() for c in t or "" if c in prior)
    share = {c: (seen[c] + prior[c]) / (sum(seen.values()) + 10_000) for c in prior}
    tested = []
    for i, text in texts.items():
        for m in re.finditer(r"[\w+/-]+={0,2}", text or "", re.A):
            cut = re.split("[-_]", m[0]) if set(m[0]) & set("+/") and set(m[0]) & set("-_") else [m[0]]
            at = m.start()
            for part in cut:
                a, b, at = at, at + len(part), at + len(part) + 1
                body = part.rstrip("=")
                chars = set(body)
                if len(body) < how.min_chars or any(a < e and s < b for s, e, _ in brute_spans(text)) or len(chars) < 2:
                    continue
                if any(chars <= set(x) for x in (string.digits, string.ascii_lowercase, string.ascii_uppercase)) or not any(chars <= set(x) for x in sets):
                    continue
                alphabet = next(x for x, y in zip(order, sets) if chars <= set(y))
                n, size, codes = len(body), len(alphabet), [alphabet.index(c) for c in body]
                chi = sum((codes.count(k) - n / size) ** 2 / (n / size) for k in range(size))
                p = [0.5 * math.erfc((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n) / 2**0.5)]
                high = [c >= size // 2 for c in codes]
                n1, n0 = sum(high), n - sum(high)
                if n1 and n0:
                    mean = 1 + 2 * n0 * n1 / n
                    var = (mean - 1) * (mean - 2) / (n - 1)
                    p.append(math.erfc(abs(1 + sum(x != y for x, y in zip(high, high[1:])) - mean) / math.sqrt(var) / 2**0.5) if var > 0 else 1)
                else:
                    p.append(2.0 ** (1 - n))
                mid = (size - 1) / 2
                p.append(math.erfc(abs(sum((x - mid) * (y - mid) for x, y in zip(codes, codes[1:]))) / ((size**2 - 1) / 12 * math.sqrt(n - 1)) / 2**0.5))
                told = max(0.0, -sum(math.log10(share[c] * size) for c in body))
                tested.append((i, a, b, len(bin(b - a)), int(told) if 3 * min(p) >= how.min_random else -1))
    out = set()
    for length in {t[3] for t in tested}:
        steps = [t[4] for t in tested if t[3] == length]
        good = [s for s in range(max(steps, default=0) + 1) if any(x >= s for x in steps) and 10.0**-s * len(steps) <= how.fdr * sum(x >= s for x in steps)]
        out |= {t[:3] for t in tested if t[3] == length and good and t[4] >= min(good)}
    return out


def test_random_spans_match_brute_force(spark):
    rng = random.Random(44)
    alphabets = [string.hexdigits[:16], string.ascii_uppercase + "234567", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.ascii_lowercase, "ab01"]
    texts = {0: None, 1: ""}
    for i in range(2, 120):
        words = [rng.choice(["the", "quick", "someIdentifierNameThatIsLong", "snake_case_name_of_some_length", "path/to/some-file/with_names", "1234567890" * 3, "AAAAAAAAAAAAAAAAAAAAAAAAa1"]) for _ in range(12)]
        words += ["".join(rng.choice(rng.choice(alphabets[:5])) if rng.random() < 0.02 else rng.choice(a) for _ in range(rng.randrange(15, 70))) for a in rng.sample(alphabets, 2)]
        words += [f"id-{''.join(rng.choice(alphabets[3]) for _ in range(30))}=="] * (i % 5 == 0) + ["token = secretvalue0123456789abcdefgh"] * (i % 7 == 0)
        rng.shuffle(words)
        texts[i] = " ".join(words)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for how in (Battery(), Battery(min_random=0.2, fdr=0.2, min_chars=24)):
        got = {(r["doc_id"], *map(int, s.split(":")[1:])) for r in find_secrets(frame, how).collect() for s in r["spans"].split(",") if s.startswith("random")}
        assert got == brute_random(texts, how) and len(got) > 20


def test_framing():
    data = bytes(range(256)) * 40
    assert unchunk(chunked(data, 1000)) == data and unchunk(chunked(b"", 5)) == b""
    assert unchunk(b"3;x=y\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"
    assert reassemble("n", [(2, 5, b"de"), (1, None, b"abc")]) == [b"abcde"]
    for bad in ([(1, None, b"a")], [(1, None, b"a"), (3, 2, b"b")], [(1, None, b"a"), (2, 9, b"b")]):
        with pytest.raises(ValueError):
            reassemble("n", bad)


def test_archives_round_trip(spark):
    big = "x漢" * 9000
    pages = [(1, "http://a/", "same"), (2, None, "same"), (3, "u\r\nX: y", "same"), (4, "u", None), (5, "u", ""), (6, "u", big), (7, "u", big), (8, "u", "y" * 500), (8, "u", "y" * 500), (None, "u", "same"), (None, "u", "lone"), (9, "u", "z" * 40000), (9, "u", "z" * 40000)]
    frame = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, keeper int, name string").repartition(3)
    for layout in (Layout(segment_bytes=700, chunk_bytes=300, file_bytes=2000), Layout(), Layout(min_revisit_bytes=10)):
        files = write_archives(frame, new_path(spark, "test-archives"), layout)
        got = sorted((tuple(r) for r in read_archives(spark, files).collect()), key=str)
        expected = []
        for i, _, html in pages:
            body = (html or "").encode()
            last = max((j for j, _, h in pages if j is not None and (h or "") == (html or "")), default=None)
            again = len(body) >= layout.min_revisit_bytes and last is not None and i != last
            expected.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", last if again else None))
        assert got == sorted(expected, key=str)
    kinds = {f["warc-type"] for r in write_archives(frame, new_path(spark, "test-archives"), Layout(segment_bytes=700)).collect() for f, _ in parse(r["uri"])}
    assert kinds == {"response", "revisit", "continuation"}
    assert read_archives(spark, write_archives(frame.limit(0), new_path(spark, "test-archives"))).count() == 0


def test_url_rules_and_reputation(spark):
    rules = [UrlRule("com", "/", "allow"), UrlRule("example.com", "/en/", "block"), UrlRule("www.example.com", "/en/", "allow")]
    urls = ["http://X.Example.COM/en/1?q", "https://www.example.com/en/a#b", "http://a.com", "nothing", None, "http://notcom/en/", "ftp://u@bad.net:80/x?y://z", "http://example.com/en", "http://[::1]/a", "http://a.co.uk/"]
    pages = [(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://bad{i % 3}.net/{i}") for i in range(300)] + [(1000 + i, f"http://good.org/{i}") for i in range(300)] + [(None, "http://bad0.net/")]
    frame = spark.createDataFrame([(*p, "x", 1.0) for p in pages], "page_id long, url string, host string, n double")
    labels = spark.createDataFrame([(100 + i, True) for i in range(300)] + [(1000 + i, i % 20 == 0) for i in range(300)] + [(None, True), (5, None)], "page_id long, bad boolean")
    got = {r["page_id"]: tuple(r)[1:] for r in filter_urls(frame, labels, rules).collect()}
    assert got[0] == ("x.example.com", "/en/1", "example.com/en/", "block") and got[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[2] == ("a.com", "", None, "allow") and got[3] == ("", "", None, "allow") == got[4] and got[5][2] is None
    assert got[6][:2] == ("u@bad.net:80", "/x") and got[7][2] == "com/" and got[None][3] == "block"
    assert all(got[100 + i][3] == "block" for i in range(300)) and all(got[1000 + i][3] == "allow" for i in range(300))
    assert filter_urls(frame, labels.limit(0), rules).where("verdict = 'block'").count() == 1
    assert filter_urls(frame.limit(0), labels, rules, Reputation()).count() == 0


def test_urls_of_any_length(spark):
    urls = ["http://a.net/es/" + "x" * 200_000, "http://" + "h" * 100_000 + ".net/fr/", "x" * 100_000, "://" * 50_000]
    rows = filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame([], "page_id long, bad boolean"), [UrlRule("net", "/es/", "block")]).orderBy("page_id").collect()
    assert [(len(r["host"]), len(r["path"]), r["verdict"]) for r in rows] == [(5, 200_004, "block"), (100_004, 4, "allow"), (0, 0, "allow"), (1, 149_996, "allow")]


@pytest.mark.parametrize("suffixes, expected", [([], "block"), (["uk.net"], "allow")])
def test_listed_suffixes_part_domains(spark, suffixes, expected):
    """Hosts below a listed suffix are no kin of each other's domain."""
    pages = [(i, f"http://bad{i % 4}.uk.net/{i}") for i in range(80)] + [(100 + i, f"http://good{i}.net/{i}") for i in range(80)] + [(200, "http://new.uk.net/")]
    labels = spark.createDataFrame([(i, i < 80) for i, _ in pages if i < 200], "page_id long, bad boolean")
    got = {r["page_id"]: r["verdict"] for r in filter_urls(spark.createDataFrame(pages, "page_id long, url string"), labels, [], suffixes=suffixes).collect()}
    assert got[0] == "block" and got[100] == "allow" and got[200] in (expected, "block")


def test_hosts_without_labels_take_their_domains_reputation(spark):
    names = {"new.bad.net": 1, "new.good.net": 1, "other.com": 1, "new.bad.net:8080": 1, "a.org": 1} | {f"{h}{i}.{d}.net": 20 for h in "xy" for i in range(3) for d in ("bad", "good")}
    pages = [(f"{h}/{j}", f"https://{h}/{j}") for h, n in names.items() for j in range(n)]
    frame = spark.createDataFrame([*pages, (None, "https://null.bad.net/")], "page_id string, url string")
    labels = spark.createDataFrame([(i, ".bad." in i) for i, _ in pages if i[0] in "xy"], "page_id string, bad boolean")
    got = defaultdict(set)
    for r in filter_urls(frame, labels, []).collect():
        got[r["host"]].add(r["verdict"])
    assert got.keys() == names.keys() | {"null.bad.net"}
    assert all(v == ({"block"} if ".bad." in h else {"allow"}) for h, v in got.items())
    assert filter_urls(frame, labels.limit(0), []).where("verdict = 'block'").count() == 0
