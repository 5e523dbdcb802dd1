"""Statistics, dialogue operators, folds and column functions on literal rows."""

import math
import random
import statistics
import unicodedata

import pytest
from pyspark.sql import functions as F

from weftline.functions import arrays, calls, labels, text
from weftline.operators import corpus, dialogue, folds, logs, rolling, stats
from weftline.plans import corpora, evaluation


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def words(spark, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))


@pytest.mark.parametrize("raw,want", [("  hi 😀⭐ ", "hi"), (None, ""), ("a‍b️", "ab"), ("\x1c x 　", "x")])
def test_clean(spark, raw, want):
    assert words(spark, raw).select(text.clean(F.col("c0")).alias("x")).first()["x"] == want


def test_spoken_and_words(spark):
    assert words(spark, "**Bold**\n\n and  more").select(text.spoken(F.col("c0")).alias("x")).first()["x"] == "Bold and more"
    got = words(spark, "Don’t, don't! मैं हूँ। 20​0").select(text.spoken_words(F.col("c0")).alias("x")).first()["x"]
    assert got == ["don", "t", "don't", "मैं", "हूँ", "200"]
    apart, joined = "क़", "क़"
    row = words(spark, joined, apart).select(text.spoken_words(F.col("c0"), False).alias("a"), text.spoken_words(F.col("c1"), False).alias("b")).first()
    assert row["a"] == row["b"]


def test_decomposed_texts_are_composed_for_scoring(spark, tmp_path):
    texts = ["caf\u00e9 na\u00efve", "Vi\u1ec7t ng\u1eef", "\u0915\u093c \u0928\u0947", "plain", None]
    apart = [t and unicodedata.normalize("NFD", t) for t in texts]
    assert apart[:2] != texts[:2]
    for name, made in (("nfc", texts), ("nfd", apart)):
        spark.createDataFrame([(i, t, "s", "l") for i, t in enumerate(made)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    counts = [sorted(tuple(r) for r in corpora.norm_token_counts(spark, f"{tmp_path}/{n}").collect()) for n in ("nfc", "nfd")]
    assert counts[0] == counts[1]
    assert [r["errors"] for r in evaluation.wer_pairs(spark, f"{tmp_path}/nfd").filter("doc_id < 4").collect()] == [0] * 4


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_word_errors_equal_the_definition(spark):
    rng = random.Random(4)
    rows = [([rng.choice(["a", "bb", "ccc", "é", "मैं"]) for _ in range(rng.randrange(9))], [rng.choice(["a", "bb", "ccc", "é", "मैं"]) for _ in range(rng.randrange(9))]) for _ in range(60)]
    rows.append(([f"w{i}" for i in range(7000)], [f"w{i}" for i in range(0, 7000, 2)]))
    got = spark.createDataFrame(rows, "r array<string>, h array<string>").select("r", "h", text.word_errors(F.col("r"), F.col("h")).alias("e")).collect()
    assert all(g["e"] == (levenshtein(g["r"], g["h"]) if len(g["r"]) < 100 else 3500) for g in got)


def test_word_errors_of_any_length(spark):
    rng = random.Random(5)
    for n in (1, 7, 63, 64, 65, 300):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randrange(n // 2, n + 1))] for _ in range(2))
        assert text.edit_distance(a, b) == levenshtein(a, b)
    many = [f"w{i}" for i in range(140_000)]
    rows = [(many, many[:70_000] + ["x"] + many[70_001:]), (None, ["a"]), ([], ["a", "b"])]
    got = spark.createDataFrame(rows, "r array<string>, h array<string>").select(text.word_errors(F.col("r"), F.col("h")).alias("e")).collect()
    assert [g["e"] for g in got] == [1, None, 2]


def test_whole_texts_are_scored(spark, tmp_path):
    rng = random.Random(6)
    made = lambda n: [rng.choice(["a", "bb", "ccc", "dd", "e"]) for _ in range(n)]
    same = made(20)
    pairs = [(same + made(n), same + made(m)) for n, m in ((1, 4), (30, 0), (80, 900), (0, 0), (500, 450), (3, 60), (9, 9))]
    spark.createDataFrame([(i, " ".join(r)) for i, (r, _) in enumerate(pairs)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, " ".join(h), f"l{i % 2}") for i, (_, h) in enumerate(pairs)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: (len(r), levenshtein(r, h)) for i, (r, h) in enumerate(pairs)}
    assert {r["doc_id"]: (r["ref_words"], r["errors"]) for r in evaluation.wer_pairs(spark, str(tmp_path)).collect()} == want
    for r in evaluation.wer_by_group(spark, str(tmp_path)).collect():
        words, errors = (sum(v[k] for i, v in want.items() if f"l{i % 2}" == r["lang"]) for k in (0, 1))
        assert (r["words"], r["errors"]) == (words, errors) and abs(r["wer"] - errors / words) < 1e-6
    rates = sorted(((round(e / n, 6), -i) for i, (n, e) in want.items()), reverse=True)[:5]
    assert [(r["rate"], -r["doc_id"]) for r in evaluation.wer_worst5(spark, str(tmp_path)).collect()] == rates


def test_corpus_rate_is_not_a_mean_of_rates(spark):
    rows = spark.createDataFrame([(1, 1), (0, 10)], "errors int, ref_words int")
    assert abs(stats.corpus_wer(rows).first()["wer"] - 1 / 11) < 1e-12
    assert math.isnan(stats.corpus_wer(rows.limit(0)).first()["wer"])


@pytest.mark.parametrize("n", [1, 2, 4, 5, 8, 10, 11, 20, 100])
def test_nearest_rank(spark, n):
    table = spark.range(1, n + 1).select(F.col("id").cast("double").alias("v"))
    got = table.agg(*[stats.nearest_rank("v", q).alias(str(i)) for i, q in enumerate((0.5, 0.9, 0.95, 1.0))]).first()
    assert list(got) == [math.ceil(q * n) for q in (0.5, 0.9, 0.95, 1.0)]


def test_auc(spark):
    table = lambda rows: spark.createDataFrame(rows, "g string, s double, p boolean")
    value = lambda rows: stats.auc(table(rows), "s", "p").first()["auc"]
    assert value([("a", 2.0, True), ("a", 1.0, False)]) == 1.0 and value([("a", 1.0, True), ("a", 2.0, False)]) == 0.0
    assert value([("a", 1.0, True), ("a", 1.0, False)]) == 0.5 and math.isnan(value([("a", 1.0, True), ("a", 2.0, True)]))
    rng = random.Random(1)
    rows = [("a", float(rng.randrange(6)), rng.random() < 0.5) for _ in range(80)]
    pairs = [(x > y) + (x == y) / 2 for _, x, p in rows if p for _, y, q in rows if not q]
    assert abs(value(rows) - sum(pairs) / len(pairs)) < 1e-12


def test_concordance_and_endpoint(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "p double, t double")
    assert abs(rows.agg(stats.concordance("p", "t").alias("c")).first()["c"] - 1) < 1e-12
    assert rows.limit(1).agg(stats.concordance("p", "t").alias("c")).first()["c"] == 0.0
    decide = lambda rows: stats.endpoint(spark.createDataFrame(rows, "f boolean, e boolean, d double"), "f", "e", "d").first()
    ends = [(True, True, 100.0)] * 8 + [(True, True, 3000.0)] * 2
    assert (decide(ends)["p50"], decide(ends)["p90"], decide(ends)["passed"]) == (100.0, 3000.0, True)
    assert decide([(False, True, 0.0)] * 4 + [(True, True, 1.0)] * 6)["missed"] == 0.4
    assert decide([(True, False, 0.0)] + ends)["false_cuts"] == 1.0
    none = stats.endpoint(spark.createDataFrame([], "f boolean, e boolean, d double"), "f", "e", "d").first()
    assert math.isnan(none["p50"]) and not none["passed"]


def test_labels(spark):
    rows = spark.createDataFrame([("ANG",), ("Pleasant surprise",), ("xxx",), ("nothing",)], "l string")
    assert [r["x"] for r in rows.select(labels.canonical(F.col("l")).alias("x")).collect()] == ["anger", "surprise", "", ""]
    kinds = spark.createDataFrame([("CREMA-D",), ("msp-podcast-v2-0",), ("emonet-voice-bench",), ("mine",)], "c string")
    assert [tuple(r) for r in kinds.select(labels.speech_kind(F.col("c")), labels.acted(F.col("c"))).collect()] == [("acted", True), ("natural", False), ("synthetic", None), (None, None)]
    assert one(spark, labels.exaggeration(F.lit("happy"), F.lit(1.0))) == pytest.approx(0.8) and one(spark, labels.strength(F.lit(0.5))) == ""


def test_readings(spark):
    z = F.create_map(F.lit("rms_mean"), F.lit(2.0), F.lit("pause_ratio"), F.lit(-1.0))
    assert one(spark, arrays.composite(z, arrays.AROUSAL)) == pytest.approx((0.3 * 2 + 0.1) / 0.4)
    assert one(spark, arrays.composite(F.create_map(F.lit("other"), F.lit(1.0)), arrays.AROUSAL)) is None
    assert one(spark, arrays.describe(F.lit(2.5), F.lit(0.8))) == "more energy than usual, tone-confidence high"
    assert one(spark, arrays.describe(F.lit(2.5), F.lit(0.2))) is None and one(spark, arrays.describe(F.lit(0.5), F.lit(0.9))) is None
    assert one(spark, arrays.confidence(F.lit(4), F.lit(1.0), F.lit(3.0))) == 0.0
    assert one(spark, arrays.confidence(F.lit(50), F.lit(0.25), F.lit(3.0))) == pytest.approx(0.5)


def test_arrays(spark):
    nums = F.array(*[F.lit(float(v)) for v in (5, 1, 4)])
    assert one(spark, arrays.median(nums)) == 4.0 and one(spark, arrays.median(F.array().cast("array<double>"))) is None
    assert one(spark, arrays.masked(F.array(F.lit(7), F.lit(8)), F.array(F.lit(0), F.lit(1)))) == [-100, 8]
    assert one(spark, arrays.padded(F.array(F.lit(7)), 3)) == [7, -100, -100]
    assert one(spark, arrays.without_start(F.array(F.lit(1), F.lit(2)), 1)) == [2] and one(spark, arrays.without_start(F.array(F.lit(3)), 1)) == [3]
    assert one(spark, arrays.tail(F.array(*map(F.lit, range(5))), 2)) == [3, 4]
    levels = arrays.rms(F.array(*[F.lit(v) for v in (1.0, 1.0, 0.0, 0.0, 9.0)]), 2)
    assert one(spark, levels) == [1.0, 0.0] and one(spark, arrays.pause_ratio(levels)) == 0.5


def test_dialogue_arrays(spark):
    said = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(t).alias("text")) for r, t in (("user", "a"), ("assistant", "b"), ("user", "c"))])
    assert [m["text"] for m in one(spark, dialogue.finish(said))] == ["a", "b"]
    assert one(spark, dialogue.finish(F.slice(said, 1, 1))) is None


def test_calls(spark):
    good = "<tool_call>\n<function=open>\n<parameter=x>1</parameter>\n</function>\n</tool_call>"
    rows = spark.createDataFrame([(good,), (good.replace("</parameter>", ""),), ("words",), (good.replace("open", " "),)], "t string")
    got = [r["c"] for r in rows.select(calls.call_shape(F.col("t"), F.array(F.lit("open"))).alias("c")).collect()]
    assert [(g["well_formed"], g["known"]) for g in got] == [(True, True), (False, None), (False, None), (False, None)]
    cells = spark.createDataFrame([("[{'h1': {'Shame': 1}}, {'h2': {'Shame': 2}}]",), ("[{'h1': {'A%20b': 0}}]",), ("[{'h1': {'A': 1}}, {'h2': {'B': 1}}]",), ("[{'h1': {'A': True}}]",), ("oops",), ("[]",)], "c string")
    assert [r["x"] and (r["x"]["category"], list(r["x"]["scores"])) if r["x"]["category"] else None for r in cells.select(calls.rated_label("c").alias("x")).collect()] == [("Shame", [1, 2]), ("A b", [0]), None, None, None, None]
    lines = spark.createDataFrame([('data: {"a": 1}',), ("data: [DONE]",), (": ping",), ("data: {bad",)], "l string")
    assert [r["x"] for r in lines.select(calls.sse_json(F.col("l")).alias("x")).collect()] == ['{"a": 1}', None, None, None]
    args = spark.createDataFrame([("",), ('{"a": 1}',), ("[1]",), ("null",)], "a string")
    assert [r["x"] for r in args.select(calls.object_arguments(F.col("a")).alias("x")).collect()] == ["{}", '{"a": 1}', None, None]
    assert calls.schema_type("Callable[[float], float]") == "Callable[[float], float]" and calls.schema_type("str, optional") == "string"


def test_tags(spark):
    rows = spark.createDataFrame([("<e:Happy:9>  Yes",), ("No tag here",)], "r string")
    assert [tuple(r["t"]) for r in rows.select(text.leading_tag(F.col("r")).alias("t")).collect()] == [("happy", 1.0, "Yes"), ("neutral", 0.5, "No tag here")]


def test_rates_and_gates_by_hand():
    limit = folds.RateLimit(2, 60.0)
    assert [limit.feed(t)[0] for t in (0, 1, 2, 59, 60, 61.5)] == [True, True, False, False, True, True]
    gate = folds.SpeechGate()
    assert [gate.feed(p)[0] for p in [0.9] * 6 + [0.1] * 10] == [None, None, "started"] + [None] * 9 + ["stopped", None, None, None]
    barge = folds.BargeIn()
    fired = [barge.feed(0.9)[0] for _ in range(16)]
    assert fired.index(True) == 13 and not any(folds.BargeIn().feed(0.5)[0] for _ in range(30))
    streak = folds.Streak()
    assert [streak.feed(ok)[1] for ok in (True, True, True, False, True)] == [False, False, True, False, False]
    cap = folds.GreedyCap(10)
    assert [cap.feed(v)[0] for v in (6, 5, 4, 1)] == [True, False, True, False]
    two = folds.TwoPhase()
    assert [two.feed(*x) for x in (("stage", 1.0), ("commit", None), ("stage", 9.0), ("discard", None), ("commit", None))] == [(0, None), (1, 1.0), (1, 1.0), (1, 1.0), (1, 1.0)]
    run = folds.RunLength()
    assert [run.feed(c, t) for t, c in enumerate((True, True, False, True))] == [(1, 0), (2, 0), (0, None), (1, 3)]


def test_baseline_resets_after_drift_and_bands_settle():
    base = folds.DriftingBaseline()
    calm = [base.feed(10.0 + (i % 3)) for i in range(20)]
    assert calm[0] == (None, False) and not any(r for _, r in calm)
    wild = [base.feed(500.0) for _ in range(8)]
    assert [r for _, r in wild] == [False] * 7 + [True] and len(base.past) == 1
    band = folds.BandHysteresis()
    assert [band.feed(z)[1] for z in (3, 0, 0, 3, 0, 3, 3)] == ["higher", "higher", "usual", "usual", "usual", "higher", "higher"]


def test_blend_moves_and_is_bounded():
    face = folds.Blender()
    first = face.feed("happy", 1.0, 0.05)[0]["happy"]
    assert 0 < first < 1 and face.feed("happy", 1.0, 5.0)[0]["happy"] > 0.99
    assert sum(face.feed("sad", 1.0, 0.05)[0].values()) <= 1.0 + 1e-9
    surprise = [folds.Blender() for _ in range(1)][0]
    peak = max(surprise.feed("surprised", 1.0, 0.1)[0]["surprised"] for _ in range(10))
    assert surprise.feed("surprised", 1.0, 3.0)[0]["surprised"] < peak / 2


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_chunks_do_not_depend_on_fragments(size):
    story = "Well now, here it is. Is it? Yes! 3.14 stays whole, doesn't it; the end"
    chunker, out = folds.Chunker(), []
    for i in range(0, len(story), size):
        out += chunker.feed(story[i : i + size])[0]
    out += chunker.feed("", True)[0]
    assert out == ["Well now,", "here it is.", "Is it?", "Yes!", "3.14 stays whole, doesn't it; the end"]


def test_rolling_z_equals_the_expression(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.gauss(10, 3)) for k in "ab" for i in range(70)]
    table = spark.createDataFrame(rows, "k string, i int, v double")
    for r in rolling.rolling_z(table, ["k"], ["i"], "v").collect():
        past = [v for k, i, v in rows if k == r["k"] and r["i"] - 50 <= i < r["i"]]
        if not past:
            assert r["z"] is None
            continue
        centre = statistics.median(past)
        sigma = max(1.4826 * statistics.median(abs(p - centre) for p in past), 0.05 * abs(centre))
        assert r["z"] == pytest.approx(max(-6, min(6, (r["v"] - centre) / sigma)))
    some = F.array(*[F.lit(float(v)) for v in (1, 2, 3, 10)])
    assert one(spark, arrays.robust_z(F.lit(4.0), some)) == pytest.approx(1.5 / 1.4826)


def test_logs(spark):
    rows = spark.createDataFrame([("open", 1, 1, "attempted"), ("open", 1, 2, "attempted"), ("open", 1, 2, "succeeded")], "tool string, turn int, call int, event string")
    assert [(r["turn"], r["call"]) for r in logs.unfinished(rows).collect()] == [(1, 1)]
    line = lambda **k: F.create_map(*[F.lit(x) for p in k.items() for x in p])
    assert one(spark, logs.headline(line(endpoint=1.0, sink_played=1.5))) == 500.0 and one(spark, logs.headline(line(endpoint=1.0))) is None
    assert one(spark, logs.logged_latency(F.lit(0.0), line(endpoint=1.0, sink_played=1.2))) == pytest.approx(200.0)
    turns = spark.createDataFrame([("local", None, 1.0), (None, "earbuds", 2.0), ("box", "earbuds", 3.0)], "tier string, profile string, latency_ms double")
    assert stats.latency(logs.of_tier(turns, "local", "earbuds")).first()["n"] == 2


def test_skip_reasons_keep_their_order(spark):
    rows = spark.createDataFrame([(None,), (5,), (50,)], "n int")
    got = corpus.skip_reasons(rows, [("none", F.col("n").isNull()), ("small", F.col("n") < 10), ("any", F.lit(True))])
    assert [r["skip_reason"] for r in got.collect()] == ["none", "small", "any"]


def test_canonical_key_ignores_source(spark):
    rows = spark.createDataFrame([("a", [("user", "x")], None), ("b", [("user", "x")], None)], "source string, messages array<struct<role:string,content:string>>, tools string")
    keys = rows.select(corpus.canonical(F.col("messages"), F.col("tools")).alias("k")).distinct()
    assert keys.count() == 1


def test_ranks_over_ranges_equal_plain_ones(spark):
    from weftline.operators import ranks

    rng = random.Random(12)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1.5, 2.0, 7.25, -3.0, 11.0]), i) for i in range(400)] + [("c", None, 900)]
    df = spark.createDataFrame(rows, "g string, v double, i int")
    got = {(r["g"], r["i"]): r["n"] for r in ranks.numbered(df, ["g"], ["i"], "n").collect()}
    for g in ("a", "b", "c", None):
        assert [got[g, i] for i in sorted(i for k, _, i in rows if k == g)] == list(range(sum(k == g for k, _, _ in rows)))
    key = lambda r: str(r["g"])
    told = [sorted(ranks.nearest_ranks(df, ["g"], "v", {"p50": 0.5, "p95": 0.95, "top": 1.0}, few).collect(), key=key) for few in (0, 10**6)]
    assert told[0] == told[1]
    for r in told[0]:
        own = sorted(v for k, v, _ in rows if k == r["g"] and v is not None)
        assert r["n"] == len(own) and [r["p50"], r["p95"], r["top"]] == [own[-(-int(q * 100) * len(own) // 100) - 1] for q in (0.5, 0.95, 1.0)]
    whole = sorted(v for _, v, _ in rows if v is not None)
    assert ranks.nearest_ranks(df, [], "v", {"p": 0.5}).first()["p"] == whole[len(whole) // 2 - 1]


def test_caps_leave_other_sources_whole(spark):
    df = spark.createDataFrame([(s, i) for s in ("a", "b", None) for i in range(9)], "source string, i int")
    got = sorted((r["source"] or "", r["i"]) for r in corpus.capped_by_source(df, "source", ["i"], {"a": 2, "x": 5}).collect())
    assert got == sorted([("a", 0), ("a", 1), *[(s, i) for s in ("b", "") for i in range(9)]])


def test_parts_of_transcripts():
    assert list(calls.objects('a {"x": "}{", "y": {"z": 1}} b {} \\" {"q": "\\"}"}')) == ['{"x": "}{", "y": {"z": 1}}', "{}", '{"q": "\\"}"}']
    with pytest.raises(ValueError):
        list(calls.objects('{"x": {}'))
    assert calls.parts("a<t> 1 </t>b<t>\\n2\\n</t>", "t") == ("ab", ["1", "2"])
    with pytest.raises(ValueError):
        calls.parts("a<t>1", "t")
    for text in ('{"name": "g", "arguments": {"a": 1}}', '{"name": "g", "arguments": "{\\"a\\": 1}"}', "{\"name\": \"g\", \"arguments\": '{\"a\": 1}'}"):
        assert calls.written_call(text) == ("g", {"a": 1})
    said = [calls.Said("user", "u"), calls.Said("tool", results=("r",))]
    assert calls.messages_of(said) is None and not calls.results_follow_calls(said)
