import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from sparquill.llm import common, pii, queries

RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, rule) in enumerate(RULES):
        for m in re.finditer(rule, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), k, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


TEXTS = [
    "", None, "a@b.c", "x a@b.c@d.e a@b.c.@d.e a@b.c_x@d.e @x.y a@b", "é😀 joe.x+1@mail-2.example.com, 1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.4 256.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111 4111  1111 1111 1111 41111111111111111111 4111 1111 1111 1112", "+1 (499) 555-6503, +12 3456789 +1234567890123456 +1.2 ++1 499 555 65 03-",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2", "9" * 50_000 + " a@b.c " + "z" * 50_000 + "@", "mail:a@b.c1.2.3.4 +49-30-123 456 78", "1-2-3.4.5.6@7.8",
]


def test_base_spans(spark, documents):
    rows = documents(TEXTS).withColumn("spans", pii.base_spans(F.col("text"))).orderBy("doc_id").collect()
    assert [[tuple(s) for s in r.spans or []] for r in rows] == [brute(t) for t in TEXTS]


def test_find_keeps_clashing_columns_and_empty_tables(spark, documents):
    docs = documents(["a@b.c", None]).withColumnRenamed("score", "spans")
    out = pii.find(docs)
    assert [len(r.spans) for r in out.orderBy("doc_id").collect()] == [1, 0] and "n_words" in out.columns
    assert pii.find(docs.limit(0)).count() == 0


def test_terms_that_reveal_an_entity(spark, documents):
    told = [f"{w} zebulon wrote joe@x.org {w} again" for w in ("alpha", "bravo", "carol", "delta")]
    other = [f"common words {w} again and alpha wrote bravo carol delta" for w in ("here", "there", "where", "nowhere")] * 5
    docs = documents(told + other + ["Zebulon was here", "zebulons were not"])
    found = pii.find(docs)
    rows = {r.doc_id: r for r in found.collect()}
    assert [s.kind for s in rows[0].spans] == ["term", "email"] and [s.kind for s in rows[24].spans] == ["term"]
    assert not rows[25].spans and not rows[4].spans
    clean = {r.doc_id: r.text for r in pii.sanitise(found).collect()}
    assert clean[0] == "alpha [TERM] wrote [EMAIL] alpha again" and clean[24] == "[TERM] was here" and clean[4] == other[0]


def _prose(seed, words=40):
    rng = random.Random(seed)
    return " ".join(rng.choice(["river", "stone", "garden", "window", "paper", "yellow", "morning", "letter"]) for _ in range(words))


def test_terms_of_two_documents_and_far_from_the_entity(spark, documents):
    far = [f"zebulon {_prose(1)} joe@x.org", f"{_prose(2)} joe@x.org {_prose(3)} zebulon"]
    copy = f"quillon {_prose(4)} {_prose(5)} ann@x.org"
    docs = documents(far + [copy, copy + " more"] + [_prose(i) for i in range(10, 110)] + [f"lonesome {_prose(6)} bob@x.org"])
    rows = {r.doc_id: [s.kind for s in r.spans] for r in pii.find(docs).collect()}
    assert rows[0] == ["removed", "email"] and rows[1] == ["email", "removed"]
    assert rows[2] == rows[3] == ["email"] and rows[104] == ["email"] and not rows[10]


def disclosed(texts):
    """Terms and their disclosure by the formula, for texts that are copies only where they are equal."""
    n, held, words = len(texts), {}, [{w for w in re.split(r"[^a-zA-Z]+", t.lower()) if len(w) >= pii.MIN_LETTERS} for t in texts]
    for i, t in enumerate(texts):
        for _, a, b in brute(t):
            held.setdefault(t[a:b], set()).add(i)
    held = {e: rows for e, rows in held.items() if len({texts[i] for i in rows}) > 1}
    pairs = {(e, w): [i for i in rows if w in words[i]] for e, rows in held.items() for w in set().union(*[words[i] for i in rows])}
    out = {}
    for (e, w), both in pairs.items():
        groups, met, usual = len({texts[i] for i in held[e]}), len({texts[i] for i in both}), sum(w in x for x in words) / n
        share = met / groups
        if met < 2 or usual >= share:
            continue
        other = (1 - share) * math.log((1 - share) / (1 - usual)) if share < 1 else 0
        told = math.log2(len(both) / (n * usual) * n / len(held[e])) / math.log2(n / len(held[e]))
        if math.log(len(pairs)) - groups * (share * math.log(share / usual) + other) <= math.log(pii.CHANCE) and told >= pii.GENERALISE:
            out[w] = max(out.get(w, 0), told)
    return out


def _corpus():
    rng = random.Random(9)
    vocabulary = [a + b + c for a in ("lo", "mi", "tu", "ra") for b in ("ker", "san", "dov") for c in ("ane", "ist", "um")]
    texts = []
    for i in range(240):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(8, 40))]
        if i % 12 < 2:  # five people, with a name that others bear now and then
            words[rng.randrange(len(words))] = f"person{i % 12}{'abcde'[i // 12 % 5]}@x.org"
            words[rng.randrange(len(words))] += f" quill{'abcde'[i // 12 % 5]}on"
        elif rng.random() < 0.04:
            words[0] = f"Quill{rng.choice('abcde')}on"
        texts.append(" ".join(words))
    return texts + texts[:13] + [" ".join(texts[20:60]) * 20]  # copies, and a very long one


def test_disclosure_and_query_against_brute_force(spark, tmp_path):
    texts = _corpus()
    want = disclosed(texts)
    assert want
    rows = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0]), (900, None), (901, "")], "doc_id long, text string")
    keyed = rows.where("doc_id < 900").select("doc_id", "text", F.coalesce(pii.base_spans(F.col("text")), F.array().cast(pii._SPAN)).alias("spans"))
    found = {r.term: r.disclosure for r in pii.disclosing_terms(keyed.select(common.row_key(F.col("doc_id"), F.col("text")).alias("row"), "text", "spans")).collect()}
    assert set(found) == set(want) and all(abs(found[w] - want[w]) < 1e-9 for w in want)

    rows.where("doc_id < 900").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in queries.op2_pii(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        base = brute(t)
        more = [("removed" if want[m.group().lower()] >= pii.REMOVE else "term", *m.span()) for m in re.finditer("[a-zA-Z]+", t) if m.group().lower() in want]
        more = [s for s in more if not any(s[1] < b and a < s[2] for _, a, b in base)]
        told = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert out[i].base_sha256 == hashlib.sha256(told(base).encode()).hexdigest() and out[i].n_email == sum(k == "email" for k, _, _ in base)
        assert out[i].spans == told(sorted(base + more, key=lambda s: s[1]))
    assert {r.doc_id: len(r.spans) for r in pii.find(rows.where("doc_id is null or doc_id >= 900 or doc_id = 0")).collect()} == {None: 1, 0: 1, 900: 0, 901: 0}


def test_very_many_matches(spark, documents):
    text = "é a@b.c +1 499 555 6503, " * 3000
    (row,) = documents([text]).select(pii.base_spans(F.col("text")).alias("spans")).collect()
    assert [tuple(s) for s in row.spans] == brute(text)


def test_sanitise_overlaps(spark):
    df = spark.createDataFrame([("abcdef", [("email", 1, 4), ("ip", 2, 5)]), (None, []), ("x", [])], "text string, spans array<struct<kind:string,start:int,end:int>>")
    assert [r.text for r in pii.sanitise(df).collect()] == ["a[EMAIL]f", None, "x"]


def test_no_python_in_the_plan(spark, documents):
    plan = pii.find(documents(["a@b.c"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
