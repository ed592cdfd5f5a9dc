import random
import re
import time

from sparquill.llm import licenses, queries


def test_matching_statistics_are_brute_force():
    rng = random.Random(0)
    for _ in range(60):
        rows = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(4)]
        auto, subs = licenses.Automaton(rows), {}
        for t, r in enumerate(rows):
            for i in range(len(r)):
                for j in range(i + 1, len(r) + 1):
                    subs.setdefault(tuple(r[i:j]), {}).setdefault(t, j - 1)
        text = [rng.randrange(3) for _ in range(20)]
        state = length = 0
        for i, w in enumerate(text):
            state, length = auto.step(state, length, w)
            assert length == max(k for k in range(i + 2) if not k or tuple(text[i + 1 - k : i + 1]) in subs)
            if length:
                assert auto.ends[state] == subs[tuple(text[i + 1 - length : i + 1])]


def brute(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = sorted((i, label) for label, p in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), places


TEXTS = ["", None, "Released under the MIT License.", "under the under the mit license under the MIT-license", "CC BY-NC 4.0; cc by nc", "ÄPFEL Apache License, Version 2.0 (apache license version 2)", "x " * 50_000 + "under the mit license", "the mit license under", "same", "same"]


def test_places(spark, documents):
    rows = licenses.scan(documents(TEXTS)).orderBy("doc_id").collect()
    assert [(r.n_words, sorted((p.word, p.label) for p in r.places)) for r in rows] == [brute(t) for t in TEXTS]
    assert licenses.scan(documents([]), "text").count() == 0


def test_chains_bridge_gaps():
    s = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    body = dict(licenses.TEMPLATES)["mit"].split()
    _, _, spans = s.scan(" ".join(["lead"] * 3 + body[:20] + ["CHANGED", "words"] + body[20:]))
    assert [(k, a, b) for k, a, b, _ in spans] == [("mit", 3, 3 + len(body) + 1)] and spans[0][3] == 1
    assert s.scan(" ".join(body[:10]))[2] == []


def test_chains_are_closed_once_their_gap_is_passed():
    """Stray fragments of a template, each the beginning of a chain that nothing continues: the time grows with their number only."""
    s = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    body = dict(licenses.TEMPLATES)["mit"].split()
    stray = " ".join(body[: licenses.LINK_WORDS + 1] + ["x"] * (licenses.GAP_WORDS + 5)) + " "
    began = time.process_time()
    few = s.scan(stray * 400)[2]
    once = time.process_time() - began
    many = s.scan(stray * 8000 + " ".join(body))[2]
    assert few == [] and [(k, c) for k, _, _, c in many] == [("mit", 1.0)]
    assert time.process_time() - began < 100 * max(once, 0.02)


def test_query(spark):
    rows = queries.op5_licenses(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        n, places = brute(texts[r.doc_id])
        at = [p for p, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({k for _, k in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert (r.score > 0) == (r.labels != "")
