import hashlib
import re

import numpy as np

from weftline.llm import pii, queries

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(out)]


TEXTS = [
    None, "", "nothing here", "a@b.c", "x a.b+c@d-e.fg.hi. and a@b", "a@b.c_d@e.f a@b.c.d@e.f.g @x.y", "é😀 mail me: jo@ex.org, now", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1.1 0001.2.3.4 01.002.03.0000255",
    "99999999999999999999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "card 4111111111111111 4111  1111 1111 1111", "0" * 12, "0" * 19, "0" * 20, "0" * 11, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7",
    "+1 (743) 555-3824 +1 2 +123456789012345 +1234567890123456 +44 20 7946 0958.", "++1 (2) 3.4-5 6 7 8 9 0 x", "tel (743) 555-3824, 743-555-3824", "user [at] mail [dot] example [dot] com", "9" * 5000 + " a" * 3000 + "@" + ".b" * 2000,
    "1-2-" * 4000 + "3", "+1" + "(" * 4000 + "2", "5555 5555 5555 4444 5555 5555 5555 4444",
]


def test_base_spans_equal_the_definition(spark):
    rng = np.random.default_rng(3)
    alphabet = list("0123456789") * 3 + list(" -.+()@a.b-_%") + ["é", "\n"]
    texts = TEXTS + ["".join(rng.choice(alphabet, int(rng.integers(5, 120)))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["spans"] for r in pii.spans(docs).collect()}
    for i, t in enumerate(texts):
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in got[i] if s["base"]] == brute(t), t


def test_query_columns_and_digest(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a@b.org 1.2.3.4"), (2, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op2_weak_pii(spark, str(tmp_path)).collect()}
    assert (rows[1]["n_email"], rows[1]["n_ip"], rows[1]["n_card"], rows[1]["n_phone"]) == (1, 1, 0, 0)
    assert rows[1]["base_sha256"] == hashlib.sha256(b"email:0:7,ip:8:15").hexdigest()
    assert rows[1]["spans"].startswith("email:0:7,ip:8:15")
    assert rows[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[2]["spans"] == ""


def test_em_recovers_planted_reliabilities():
    rng = np.random.default_rng(5)
    truth = rng.random(20000) < 0.3
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    votes = np.where(rng.random((20000, 5)) < right, np.where(truth, 1, 2)[:, None], np.where(truth, 2, 1)[:, None])
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    q, table = pii.reliabilities(patterns, n.astype(float))
    assert np.abs(table[:, 1, 1] - right).max() < 0.03
    assert abs((q * n).sum() / 20000 - 0.3) < 0.02


def test_loose_spans_are_added_where_the_corpus_supports_them_and_clean_text_is_not_touched(spark):
    rows = [(i, f"please call us: phone +1 (743) 555-{1000 + i} today") for i in range(200)]
    rows += [(1000 + i, f"phone: (743) 555-{2000 + i}") for i in range(40)]
    rows += [(2000 + i, f"plain prose number {i} with version 1.2.3 and order {10**11 + i * 7919}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["spans"] for r in pii.spans(docs).collect()}
    assert sum(len(got[1000 + i]) for i in range(40)) == 40
    assert sum(len([s for s in got[2000 + i] if not s["base"]]) for i in range(200)) == 0


def test_redaction_keeps_columns_and_counts_anew(spark):
    docs = spark.createDataFrame([(1, "write a@b.org from 1.2.3.4!", 27, "x"), (2, None, 0, "y"), (3, "clean", 5, "z")], "doc_id long, text string, n_chars long, spans string")
    got = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert got[1]["text"] == "write [EMAIL] from [IP]!" and got[1]["n_chars"] == 24
    assert got[2]["text"] is None and got[3]["text"] == "clean" and got[3]["spans"] == "z"
    assert pii.redact(docs).columns == docs.columns
    assert pii.redact(docs.limit(0)).count() == 0


def test_spans_and_redaction_of_long_texts_with_many_candidates(spark):
    # More than one block of matches and chunks of characters, touching and overlapping spans, wide characters.
    rng = np.random.default_rng(8)
    parts = ["a@b.org", "x y", "1.2.3.4", "é😀", "+1 (743) 555-3824", "_d@e.fr", "4111 1111 1111 1111", "(743) 555-3824", "é" * 500, " "]
    texts = ["".join(parts[int(i)] for i in rng.integers(0, len(parts), 3000)) for _ in range(3)] + [" ".join(f"p{i}@ex{i}.org," for i in range(700))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["row"]["doc_id"]: r for r in pii.spans(docs).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    for i, text in enumerate(texts):
        spans = got[i]["spans"]
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["base"]] == brute(text)
        sure = [(s["start"], s["end"]) for s in spans if s["base"]]
        assert all(e <= s["start"] or s["end"] <= a for s in spans if not s["base"] for a, e in sure)
        out, at = "", 0
        for s in spans:
            if s["start"] >= at:
                out += text[at : s["start"]] + f"[{s['kind'].upper()}]"
            at = max(at, s["end"])
        assert clean[i] == out + text[at:]


def test_time_of_a_long_text_is_in_proportion(spark):
    from time import monotonic

    text = " ".join(f"person{i}@mail{i}.org and more" for i in range(40_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begun = monotonic()
    assert len(pii.redact(docs, {}).first()["text"]) == 40_000 * len("[EMAIL] and more ") - 1
    assert monotonic() - begun < 60


def test_context_reaches_over_neighbouring_matches(spark):
    from pyspark.sql import functions as F

    from weftline.llm.places import found, places_of

    texts = ["", "ab12cd", "12", "1 22  333" + "x" * 50 + "4", "1a" * 700, "é1😀2"]
    matches, gaps = found(F.col("text"), "[0-9]+", F.lit(True))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", matches.alias("m")).select("text", "m", gaps(F.col("m")).alias("g"))
    for r in rows.select("text", places_of(F.col("m"), F.col("g"), 7).alias("p")).collect():
        want = [(m.start(), m.end(), m[0], r["text"][max(0, m.start() - 7) : m.start()], r["text"][m.end() : m.end() + 7]) for m in re.finditer("[0-9]+", r["text"])]
        assert [tuple(p) for p in r["p"]] == want
