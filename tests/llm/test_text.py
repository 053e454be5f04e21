"""Fingerprints, decontamination and URL filters against plain versions."""

import hashlib
import random

import numpy as np
import pytest

from holdfast.llm import decontaminate, digests, merkle
from tests.llm import cases


def test_passages_join_to_the_text():
    for text in [t or "" for _, t, *_ in cases.rows()] + ["a. b! c?? d", "no end " * 500, "\n\nx\n", "é.\n🙂"]:
        assert "".join("".join(p) for p in merkle.passages(text)) == text


@pytest.mark.parametrize("extra", [False, True])
def test_fingerprints_follow_the_next_document(spark, extra):
    docs = cases.documents(spark, extra=extra)
    got = {r["doc_id"]: r for r in merkle.fingerprint_edits(docs).collect()}
    known = sorted((i, t or "") for i, t, *_ in cases.rows() if i is not None)
    for at, (i, text) in enumerate(known):
        following = known[(at + 1) % len(known)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = got[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == merkle.fingerprint(text)
        assert r["near_next"] == merkle.likeness(r["fingerprint"], merkle.fingerprint(following))
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[3]["fingerprint"]
    assert got[None]["n_chars"] == len(cases.rows()[12][1])


def test_fingerprints_of_one_none_and_repeats(spark):
    assert merkle.fingerprint_edits(cases.documents(spark, empty=True)).count() == 0
    one = spark.createDataFrame([(3, "alone here", "en", "a", 1)], cases.SCHEMA)
    assert merkle.fingerprint_edits(one).collect()[0]["near_next"] == 1.0
    twice = spark.createDataFrame([(3, "same", "en", "a", 1)] * 2, cases.SCHEMA)
    assert merkle.fingerprint_edits(twice).count() == 2


def test_differences_locate_edits():
    text = "\n".join(f"Line {i} " + " ".join(f"w{i}x{j}" for j in range(25)) + "." for i in range(60))
    for start, end, new in ((300, 340, "changed"), (0, 5, ""), (len(text) - 4, len(text), "x")):
        other = text[:start] + new + text[end:]
        a, b = merkle.fingerprint(text), merkle.fingerprint(other)
        (found,) = merkle.differences(a, b)
        assert found[0] <= start and found[1] >= min(end, len(text) - 1) and found[1] - found[0] < 700
        assert text[: found[0]] == other[: found[2]] and text[found[1] :] == other[found[3] :]
        assert 0.8 < merkle.likeness(a, b) < 1
    assert merkle.differences(a, a) == [] and merkle.likeness(a, a) == 1.0
    assert merkle.root(a) != merkle.root(b)


def plain_distance(pattern, text):
    row = list(range(len(pattern) + 1))
    out = []
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[-1] + 1))
        row = new
        out.append(row[-1])
    return out


def test_myers_is_exact():
    rng = random.Random(1)
    for _ in range(150):
        p = "".join(rng.choices("abcd", k=rng.randint(1, 90)))
        t = "".join(rng.choices("abcd", k=rng.randint(0, 120)))
        assert list(decontaminate.myers(p, t)) == plain_distance(p, t)


def test_every_edited_item_is_found(spark):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choice(cases.WORDS) for _ in range(rng.randrange(12, 40)))) for i in range(25)]
    rows, want = [], set()
    for d in range(120):
        text = cases.sentence(d, 40)
        if d % 2:
            i, item = rng.choice(items)
            edited = list(decontaminate.normal(item))
            for _ in range(int(len(edited) * 0.08)):
                at = rng.randrange(len(edited))
                edited[at : at + 1] = rng.choice([["Q"], [], [edited[at], "z"]])
            text = text[:90] + "  " + "".join(edited).upper().replace(" ", "\n ") + " " + text[90:]
        rows.append((d, text, "en", "a", 1))
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_items(docs, bench).collect()
    for d, text, *_ in rows:
        norm = decontaminate.normal(text)
        for i, item in items:
            pattern = decontaminate.normal(item)
            if min(plain_distance(pattern, norm)) <= int(len(pattern) * 0.08):
                want.add((d, i))
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) >= 55
    texts = {d: t for d, t, *_ in rows}
    for r in got:
        part = decontaminate.normal(texts[r["doc_id"]][r["start"] : r["end"]])
        assert plain_distance(dict(items)[r["item_id"]], part)[-1] <= r["distance"]
    clean = {r["doc_id"] for r in decontaminate.without_items(docs, bench).collect()}
    assert clean == set(texts) - {d for d, _ in want}
    parted = decontaminate.find_items(docs, bench, max_chars=1500).collect()
    assert {(r["doc_id"], r["item_id"]) for r in parted} == want


def test_decontamination_edge_cases(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, cases.sentence(3, 60)), (4, cases.sentence(11, 50))], "item_id long, text string")
    docs = cases.documents(spark, extra=True)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(docs, bench).collect()}
    assert got == {(1, None), (2, None), (3, None), (4, 4)}
    assert {r["doc_id"] for r in decontaminate.without_items(docs, bench).collect()} == {i for i, *_ in cases.rows()} - {1, 2, 3, 4}
    none = spark.createDataFrame([], bench.schema)
    assert decontaminate.find_items(docs, none).count() == 0
    assert decontaminate.without_items(docs, none).count() == len(cases.rows())
    assert decontaminate.find_items(cases.documents(spark, empty=True), bench).count() == 0


def test_short_items_match_whole_words(spark):
    items = [(1, "What is 6 x 7?"), (2, "Paris"), (3, "capital of France"), (4, "東京"), (5, "naïve"), (6, " \n"), (7, "42")]
    texts = {
        1: "Quiz:\nWHAT  is 6 x 7? ok", 2: "comparison of parishes", 3: "in (paris), he said", 4: "the capitol of france",
        5: "the capital of frances", 6: "the capital of francesca", 7: "私は東京都に住む", 8: "naïveté", 9: "so nai\u0308ve", 10: "so NAÏVE",
        11: "142 or 421", 12: "42", 13: None, 14: "xcapital of france", 15: "acapital of francex",
    }
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts.items()], cases.SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (texts[r["doc_id"]][r["start"] : r["end"]], r["distance"], r["budget"]) for r in decontaminate.find_items(docs, bench).collect()}
    assert got == {
        (1, 1): ("WHAT  is 6 x 7?", 0, 1), (3, 2): ("paris", 0, 0), (4, 3): ("capitol of france", 1, 1),
        (5, 3): ("capital of frances", 1, 1), (7, 4): ("東京", 0, 0), (10, 5): ("NAÏVE", 0, 0), (12, 7): ("42", 0, 0),
        (14, 3): ("xcapital of france", 1, 1),
    }
    clean = {r["doc_id"] for r in decontaminate.without_items(docs, bench).collect()}
    assert clean == set(texts) - {i for i, _ in got}


URLS = [
    None, "", "no scheme", "http://A.Example.COM/en/1?x=/en/", "https://www.example.com/en/2#a/b", "http://example.net",
    "http://example.net/", "http://x.net/es/5", "http://x.net/fr", "http://net/fr/", "http://spam-farm.example.org/q",
    "http://spam-farm.example.com/q", "ftp://u@h.org:80/p", "http://notexample.com/en/3", "http://x.org?u=http://y.com/",
    "http://www.example.com/en/2#a/b", "http://WWW.example.com/en", "http://.com/", "://com/", "http://É.com/é",
]
ENTRIES = [
    ("com/", False), ("example.com/en/", True), ("www.example.com/en/", False), ("net/es/", True), ("net/fr/", True),
    ("name:spam-farm", True), (None, True),
]


def plain_verdict(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for key, blocked in ENTRIES:
        if key and not key.startswith("name:"):
            h, _, p = key.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(key) > len(best[0] if best else ""):
                best = (key, blocked)
    if best:
        return host, path, best[0], "block" if best[1] else "allow"
    return host, path, None, "block" if "spam-farm" in host.split(".") else "allow"


@pytest.mark.parametrize("most", [1000, 2])
def test_url_verdicts(spark, most):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS)], "page_id long, url string, verdict string")
    entries = spark.createDataFrame(ENTRIES, "key string, blocked boolean")
    got = digests.judge_urls(pages, entries, max_local=most).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {
        i: plain_verdict(u) for i, u in enumerate(URLS + URLS)
    }
    none = digests.judge_urls(pages, entries.limit(0), max_local=most).collect()
    assert {r["verdict"] for r in none} == {"allow"} and len(none) == 2 * len(URLS)
    assert digests.judge_urls(pages.limit(0), entries, max_local=most).count() == 0


def test_digest_collisions_are_confirmed(monkeypatch):
    monkeypatch.setattr(digests, "digest", lambda keys: np.array([len(k) % 3 for k in keys], np.uint64))
    block = digests.DigestArray.pack([("aaa", True), ("bbb", False), ("c", True), ("c", False)])
    array = digests.DigestArray(np.frombuffer(block, np.uint8))
    assert array.probe(["aaa", "bbb", "ccc", "c", ""]).tolist() == [1, 0, -1, 1, -1]
