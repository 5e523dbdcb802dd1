"""Validators, mouth shapes and assembled parts on literal rows."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import validators as va
from weftline.functions import visemes
from weftline.operators import assemble, folds


def values(spark, rows, schema, column):
    return [r["x"] for r in spark.createDataFrame(rows, schema).select(column.alias("x")).collect()]


@pytest.mark.parametrize("payload,reason", [
    ('hl.dsp.focus({workspace = 3})', None), ('hl.dsp.focus({name = "web 1", on = true})', None), ("", "empty"), ("  ", "empty"), ("hl.dsp.exec_cmd({x = 1})", "forbidden"),
    ("os.execute('x')", "forbidden"), ("hl.dsp.focus({x = y})", "shape"), ('hl.dsp.focus({x = "a;b"})', "shape"), ("hl.dsp.focus({x = 1}) hl.dsp.focus({x = 1})", "shape"), ("hl.dsp.close({x = 1})", "dispatcher"),
])
def test_egress(spark, payload, reason):
    assert values(spark, [(payload,)], "p string", va.egress_reason(F.col("p"))) == [reason]


def test_answers(spark):
    rows = [("Yes!", 0.0, 0.0), ("go ahead", 0.0, 0.0), ("Don't", 0.0, 0.0), ("thank you", 0.0, 0.0), ("yes", 0.5, 0.0), ("yes", 0.0, -1.5), ("yes I think you should do", 0.0, 0.0), ("maybe", 0.0, 0.0), (None, 0.0, 0.0), ("haan  ji", 0.0, 0.0)]
    got = values(spark, rows, "t string, n double, l double", va.answer(F.col("t"), F.col("n"), F.col("l")))
    assert got == ["yes", "yes", "no", "ambiguous", "ambiguous", "ambiguous", "ambiguous", "ambiguous", "ambiguous", "yes"]
    both = [("yes", "no"), ("yes", None), (None, None)]
    assert values(spark, both, "v string, c string", va.decision(F.col("v"), F.col("c"))) == ["no", "yes", "timeout"]


def test_heard_and_files(spark):
    rows = [(" hello ", 0.1, -0.2), ("hello", 0.5, -0.2), ("hello", 0.1, -1.2), ("Thank you.", 0.1, -0.2)]
    assert values(spark, rows, "t string, n double, l double", va.heard(F.col("t"), F.col("n"), F.col("l"))) == ["hello", "", "", ""]
    assert values(spark, [("data/me.wav",), ("src/a.py",)], "p string", va.tracked_recording(F.col("p"))) == [True, False]
    cases = [(1, 10, 1.0, True, "direct"), (0, 0, 1.0, False, "paid"), (0, 0, 1.0, False, "direct"), (3, 10, 1.0, False, "direct"), (3, 900_000_000, 1.0, False, "direct")]
    got = values(spark, cases, "f int, b long, g double, m boolean, a string", va.fetch_status(*[F.col(c) for c in "fbgma"]))
    assert got == ["already", "needs-paid", "no-data", "too-small", "done"]


def test_shapes_and_timelines(spark):
    assert [visemes.shape(p) for p in ("s", "u", "!", "ː", "ˈ", "@", "")] == ["ih", "ou", "", "", "", "aa", ""]
    assert visemes.shape("ː", "ou") == "ou" and visemes.shape("tʃ") == "ih" and visemes.shape("ã") == "aa"
    rows = spark.createDataFrame([(1, "ssuː!", [0.1, 0.1, 0.2, 0.3, 0.5]), (2, None, None)], "id int, p string, d array<double>")
    got = {r["id"]: [(round(t["start"], 3), t["shape"], round(t["seconds"], 3)) for t in r["timeline"]] for r in visemes.timelines(rows, "id", "p", "d").collect()}
    assert got == {1: [(0.0, "ih", 0.2), (0.2, "ou", 0.5), (0.7, "", 0.5)], 2: []}


def test_fragments(spark):
    rows = [(1, 0, 0, "open", '{"a"'), (1, 0, 1, None, ": 1}"), (1, 1, 0, None, "{}"), (1, 2, 0, "bad", "{oops"), (1, 3, 0, "none", None)]
    got = assemble.joined_calls(spark.createDataFrame(rows, "turn int, index int, seq int, name string, arguments string"), ["turn"], "seq")
    assert sorted((r["index"], r["name"], r["arguments"]) for r in got.collect()) == [(0, "open", '{"a": 1}'), (3, "none", "{}")]


def test_blocks_pairs_places_and_rings(spark):
    text = ["junk", "Sink #1", "  Name: one", "  Rate: 48000", "Sink #2", "  Name: two"]
    lines = spark.createDataFrame([("k", i, t) for i, t in enumerate(text)], "key string, i int, line string")
    got = assemble.blocks(lines, ["key"], "i", r"^Sink #(\d+)", {"name": r"Name: (.*)", "rate": r"Rate: (\d+)"})
    assert sorted((r["head"], r["name"], r["rate"]) for r in got.collect()) == [("1", "one", "48000"), ("2", "two", None)]
    rows = spark.createDataFrame([("p", 1, "Hi "), ("p", 2, "hi"), ("q", 1, "a"), ("q", 2, "b"), ("r", 1, "x"), (None, 1, "x")], "pair string, id int, reply string")
    assert {r["pair"]: r["differ"] for r in assemble.matched_pairs(rows, "pair", "id", F.col("reply")).collect()} == {"p": False, "q": True}
    table, asked = spark.createDataFrame([(0, "a"), (1, "b")], "index int, value string"), spark.createDataFrame([(1,), (5,), (-1,)], "index int")
    assert {r["index"]: (r["value"], r["reason"]) for r in assemble.positions(table, asked).collect()} == {1: ("b", None), 5: (None, "beyond the end"), -1: (None, "negative")}
    events = spark.createDataFrame([("u", float(t), t) for t in (0, 1, 5, 6)], "u string, at double, v int")
    assert [r["recent"] for r in assemble.recent(events, ["u"], "at", 1.0, "v").orderBy("at").collect()] == [[0], [0, 1], [5], [5, 6]]
    scored = spark.createDataFrame([(0.9, False), (0.1, False), (0.9, True)], "s double, p boolean")
    assert [r["weight"] for r in assemble.hard_negatives(scored, "s", "p").collect()] == [8.0, 1.0, 1.0]
    spans = spark.createDataFrame([(0.0, 2.0), (1.5, 3.0)], "s double, e double")
    assert [r["label"] for r in assemble.inside(spans, "s", "e", 0.5, 1.5).collect()] == [1, 0]


def test_listener_segments():
    ear = folds.Listener()
    quiet, loud = [0.1] * 8, [0.9] * 10
    got = [ear.feed(p)[0] for p in quiet + loud + quiet + loud + quiet]
    assert [g for g in got if g] == ["utterance", "utterance"]
    long = folds.Listener(most_ms=320.0)
    assert [g for g in (long.feed(0.9)[0] for _ in range(30)) if g].count("forced") >= 2


def test_tag_parser_does_not_depend_on_fragments():
    for size in (1, 3, 100):
        parser, got, spoken = folds.TagParser(), [], ""
        for i in range(0, 24, size):
            label, intensity, text = parser.feed("<e:Happy:9>  Yes, sure. "[i : i + size])
            got += [(label, intensity)] if label else []
            spoken += text
        assert got == [("happy", 1.0)] and spoken == "Yes, sure. "
    short = folds.TagParser()
    assert short.feed("Sure.") == (None, None, "") and short.feed("", True) == ("neutral", 0.5, "Sure.")
    assert folds.TagParser().feed("x" * 40) == ("neutral", 0.5, "x" * 40)


def test_gate_order_and_limits():
    gate = folds.Gate(per_tool=2, in_all=3)
    ask = lambda tool, at, **k: gate.feed(tool, at, *[{"source": True, "reach": True, "effect": True, "needs": False, "said": False, **k}[x] for x in ("source", "reach", "effect", "needs", "said")])[0]
    assert ask("a", 0, source=False) == "source_refused" and ask("a", 0, reach=False) == "reach_refused"
    assert [ask("a", 0), ask("a", 1), ask("a", 2), ask("b", 3), ask("c", 4), ask("d", 5, effect=False)] == ["allowed", "allowed", "rate_limited", "allowed", "rate_limited", "allowed"]
    assert ask("a", 70, needs=True) == "denied" and ask("a", 71, needs=True, said=True) == "allowed"


def test_clauses_call_rates_and_samples(spark):
    from weftline.functions import calls
    from weftline.operators import splits, stats
    from weftline.sources import speech

    runs = spark.createDataFrame([(1, 30.0, 0.5), (1, 10.0, 0.7), (8, 90.0, 2.0)], "words int, ttfa double, audio double")
    clauses = stats.by_clause(runs, "words", "ttfa", "audio")
    assert {r["words"]: (r["n"], r["p50"], round(r["audio_s"], 3)) for r in clauses.collect()} == {1: (2, 10.0, 0.6), 8: (1, 90.0, 2.0)}
    assert not stats.longest_within(clauses, 50.0).first()["passed"]
    replies = spark.createDataFrame([("words",), ("<tool_call><function=f></function></tool_call>",)], "reply string")
    rates = stats.call_rates(replies.select("reply", calls.call_shape(F.col("reply"), F.array(F.lit("f"))).alias("check"))).first()
    assert (rates["well_formed"], rates["known"], rates["examples"]) == (0.5, 1.0, ["words"])
    rows = spark.createDataFrame([(f"f{i % 4}", i) for i in range(40)], "file_path string, row_index int")
    some = splits.sample_per_file(rows, 2, 3, 1)
    assert some.count() == 6 and some.select("file_path").distinct().count() == 2
    clips = spark.createDataFrame([(1, bytearray(b"a"), "HAPPY"), (2, bytearray(b"a"), "WIKI"), (3, bytearray(b"b"), "HAPPY")], "i int, bytes binary, style string")
    assert speech.content_names(clips).select("file").distinct().count() == 2
    assert [r["file"] for r in speech.style_names(clips, "style", ["i"], ["HAPPY"]).orderBy("i").collect()] == ["HAPPY_0", "HAPPY_1"]
    frame = speech.packed_frames(spark.createDataFrame([(7, [1.0, 0.5])], "id int, v array<double>"), "id", "v").first()["frame"]
    assert bytes(frame) == b"\x07\0\0\0\0\0\x80?\0\0\0?"
    assert calls.patched("a {x} b", "{x}", "y") == "a y b"
    with pytest.raises(ValueError):
        calls.patched("a", "{x}", "y")
