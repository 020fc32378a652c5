"""Hand-computed edge cases of functions and operators."""

from __future__ import annotations

import ast
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orefall import config
from orefall.functions import scores as S
from orefall.functions import text as X
from orefall.operators import chunking as C
from orefall.operators import evaluation as E
from orefall.operators import repo as R
from orefall.operators import retrieval
from orefall.operators import state as T


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_tier_and_level_bounds(spark):
    got = values(spark, [(0.9,), (0.7,), (0.5,), (0.49,)], "s double", S.tier(F.col("s")))
    assert [g[0] for g in got] == ["gold", "silver", "bronze", "rejected"]
    got = values(spark, [(0.80,), (0.79,), (0.60,), (0.59,)], "s double", S.level(F.col("s")))
    assert [g[0] for g in got] == ["high", "medium", "medium", "low"]


def test_final_score(spark):
    s = S.final_score(F.col("c"), F.col("r"))
    got = values(spark, [(0.8, 0.7), (0.82, 0.1), (0.9, 0.8), (0.5, None), (0.5, 0.3)], "c double, r double", s["score"], s["status"])
    assert [(round(a, 6), b) for a, b in got] == [(0.77, "normal"), (0.82, "needs_review"), (0.87, "high_confidence"), (0.5, "normal"), (0.44, "normal")]


def test_upper_median(spark):
    assert values(spark, [([1.0, 4.0, 2.0, 3.0],)], "a array<double>", E.upper_median(F.col("a"))) == [(3.0,)]
    rows = spark.createDataFrame([(float(i), "gold", True) for i in (1, 2, 3, 4)], "score double, tier string, sft_ready boolean")
    assert E.basic_stats(rows).head()["median"] == 3.0


def test_completeness_bounds(spark):
    got = values(spark, [("x" * n,) for n in (49, 50, 199, 200)], "a string", S.completeness(F.col("a")))
    assert [g[0] for g in got] == [0.3, 0.6, 0.6, 0.9]


def test_smart_truncate(spark):
    (same, cut), = values(spark, [("ab" * 50,)], "t string", X.smart_truncate(F.col("t"), 100), X.smart_truncate(F.col("t"), 99))
    assert same == "ab" * 50
    assert len(cut) == 99 and config.ELLIPSIS in cut


def test_penalty(spark):
    c, e = R.insight_penalty(F.col("d"), F.col("d"), F.lit(4), F.lit(4), F.lit(8))
    (a, b), = values(spark, [(0.8,)], "d double", c, e)
    assert (round(a, 6), round(b, 6)) == (0.51, 0.52)


def test_empty_tree_scores_nothing(spark):
    got = values(spark, [("",)], "t string", *[R.rule_score(F.col("t"), d) for d in config.SIGNALS])
    assert got == [(0.0, 0.0, 0.0, 0.0)]


def test_rrf_of_one_document_in_both_lists(spark):
    one = spark.createDataFrame([(1, 7, 1)], "qid long, doc_id long, rank int")
    got = retrieval.rrf(one, one, 3).head()
    assert got["score"] == pytest.approx(1 / 61 + 0.3 / 61, abs=1e-8)


def test_multi_route(spark):
    hits = spark.createDataFrame([(1, 0, 1.0, 5, 1), (1, 1, 0.82, 5, 2), (1, 1, 0.82, 6, 1)], "qid long, route int, weight double, doc_id long, rank int")
    got = {r["doc_id"]: r["score"] for r in retrieval.multi_route(hits, 3).collect()}
    assert got == {5: pytest.approx(1.41), 6: pytest.approx(0.82)}


@pytest.mark.parametrize(("n", "kept"), [(1000, 1000), (1001, 500), (1501, 1000), (1502, 500)])
def test_fifo(spark, n, kept):
    keys = spark.range(n)
    got = sorted(r["id"] for r in T.fifo_kept(keys, "id").collect())
    assert got == list(range(n - kept, n))


def test_ordinals_over_blocks(spark):
    rows = spark.createDataFrame([(i * 1000,) for i in range(200)], "x long")
    got = {r["x"]: r["ordinal"] for r in T.ordinals(rows, "x", block=7000).collect()}
    assert got == {i * 1000: i for i in range(200)}


def test_memory_window(spark):
    rows = spark.createDataFrame([(1, t) for t in range(20)] + [(2, t) for t in range(21)], "conv_id long, turn long")
    got = T.memory_window(rows, 10).groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("first")).orderBy("conv_id").collect()
    assert [(r["n"], r["first"]) for r in got] == [(20, 0), (20, 1)]


@pytest.mark.parametrize(("lines", "starts"), [(0, []), (1, [1]), (100, [1]), (101, [1, 101])])
def test_line_windows(spark, lines, starts):
    files = spark.createDataFrame([("f", "\n".join(["x"] * lines))], "file string, content string")
    assert sorted(r["start_line"] for r in C.line_windows(files).collect()) == starts
    assert [c.start for c in C.chunk_source("\n".join(["x"] * lines), "f.txt")] == starts


def test_admission_with_one_place(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2)], "b int, id int")
    got = {r["id"]: r["accepted"] for r in T.admitted(rows, "b", "id", 1).collect()}
    assert got == {1: True, 2: False}


def test_bm25_empty_corpus_and_query(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "qid long, text string")
    assert retrieval.bm25_search(queries, docs, 3).count() == 0


def test_bm25_in_place_equals_the_join(spark):
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "x"]
    docs = spark.createDataFrame([(i, " ".join(words[(i * j) % 7] for j in range(i % 9))) for i in range(1, 700)] + [(0, None)], "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame([(1, "alpha the the"), (2, "GAMMA beta of"), (3, "unknown"), (4, None), (5, "x")], "qid long, text string")
    got = [sorted(tuple(r) for r in retrieval.bm25_search(queries, docs, 4, cells=c).collect()) for c in (retrieval.CELLS, 0)]
    assert got[0] == got[1] and {g[0] for g in got[0]} == {1, 2, 5}


def test_vector_search_of_odd_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [])], "qid long, embedding array<double>")
    d = spark.createDataFrame([(1, [1.0, None]), (2, [1.0, 1.0]), (3, None), (4, [2.0]), (5, [float("nan"), 1.0])], "doc_id long, embedding array<double>")
    assert sorted((r["qid"], r["doc_id"]) for r in retrieval.vector_search(q, d, 3).collect()) == [(1, 2), (3, 4)]


def test_vector_search_skips_zero_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<double>")
    d = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0])], "doc_id long, embedding array<double>")
    assert [(r["doc_id"], r["rank"]) for r in retrieval.vector_search(q, d, 3).collect()] == [(2, 1)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='abc{};"\'`/*\n #()', max_size=60))
def test_brace_chunks_never_fail_and_keep_blocks(source):
    for opened, end in C.top_blocks(source):
        assert source[opened] == "{" and source[end - 1] == "}"
    assert all(c.end >= c.start for c in C.brace_chunks(source))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text_is_chunked_under_any_extension(source):
    for path in ("a.py", "a.c", "a.md"):
        chunks = C.chunk_source(source, path)
        assert bool(chunks) == bool(source) or (path == "a.py" and not source.strip())


def test_braces_outside_of_text_only():
    source = 'a "{" \'\\\'{\' `{`\n/* { */ // {\n  #define X { \\\n {\nint f() {} x # {\n}"open {'
    assert [source[: at + 1].rsplit("\n", 1)[-1] for at in C.braces(source)] == ["int f() {", "int f() {}", "int f() {} x # {", "}", '}"open {']


_PARTS = ["def f(a):\n    return 'é'\n", "x = 1\r\n", "class A:\r\n    y = '''a\n\x0cb'''\n", "\x0cz = 2\r", "s = 'é'; t = s\n", "\n"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(_PARTS), max_size=8).map("".join))
def test_segments_equal_the_parsers_own(source):
    try:
        tree = ast.parse(source)
    except SyntaxError:
        return
    segment = C.segments(source)
    for node in ast.walk(tree):
        if hasattr(node, "end_lineno"):
            assert segment(node) == ast.get_source_segment(source, node)


def test_symbols_of_odd_sources(spark):
    rows = [
        ("a.java", "public static class A {\n * b\n  public List<String> items() {\n  if (x) {\n"), ("b.ts", "subclass Odd\nconst run = async (a) =>\ngo(a) {\nmake(a): {\n"),
        ("c.go", "func (t *T) Run() {\nfunc Main() {\ntype I interface {\n"), ("d.rs", None), ("e.js", ""), ("f", "class F"),
    ]
    got = {}
    for r in C.symbols(spark.createDataFrame(rows, "file string, content string")).orderBy("file", "ord").collect():
        got.setdefault(r["file"], []).append(r["symbol"].strip())
    assert got == {"a.java": ["[C] A", "- items"], "b.ts": ["[C] Odd", "- run", "- make"], "c.go": ["- Run", "- Main", "[C] I"], "f": ["[C] F"]}
    many = spark.createDataFrame([("x.ts", "class A\n" * 60)], "file string, content string")
    assert C.symbols(many).count() == config.MAX_SYMBOLS


def test_breaker_opens_expires_and_closes():
    failed = [True] * 5 + [True, False, True, True, False, True]
    at = [0.0, 1, 2, 3, 4, 50, 100, 124, 125, 126, 127]
    found, state = T.breaker_walk(failed, at, (0, None), 5, 120.0)
    # the fifth failure opens until 124; what comes before is turned away, then failures count anew
    assert found == [(True, 1), (True, 2), (True, 3), (True, 4), (True, 5), (False, 5), (False, 5), (True, 1), (True, 2), (True, 0), (True, 1)]
    assert state == (1, None)


def test_breaker_over_a_table(spark):
    rows = [(k, i, i * 10, i % 7 < 5) for k in "ab" for i in range(60)] + [(None, 1, 1, True), ("c", 1, 5, None)]
    d = spark.createDataFrame(rows, "k string, id long, sec long, bad boolean").selectExpr("k", "id", "timestamp_seconds(sec) AS ts", "bad")
    got = {(r["k"], r["id"]): (r["allowed"], r["failures"]) for r in T.breaker(d, "k", "ts", "id", "bad").collect()}
    for k in "ab":
        want, _ = T.breaker_walk([i % 7 < 5 for i in range(60)], [i * 10.0 for i in range(60)], (0, None), 5, 120.0)
        assert [got[k, i] for i in range(60)] == want
    assert got["c", 1] == (True, 0) and len(got) == 121 and T.breaker(d.limit(0), "k", "ts", "id", "bad").count() == 0


def test_queue_keeps_its_count_between_batches(spark, tmp_path):
    from orefall.streaming import flows

    for i in range(3):
        part = spark.range(i * 6, i * 6 + 6).selectExpr("id AS event_id", "TIMESTAMP_NTZ '2024-01-01 05:00:00' AS ts", "1L AS user_id", "'view' AS event_type", "1.0D AS value", "'{}' AS props")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(flows.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events").selectExpr("event_id", "CAST(ts AS TIMESTAMP) AS ts")
    got = [r["accepted"] for r in flows.bounded_queue(stream, 10).collect()]
    assert len(got) == 18 and sum(got) == 10


def test_r2_rounds_as_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i / 1000 + d,) for i in range(1001) for d in (0.0, 1e-6)] + [(-0.575,), (0.015,), (None,)]
    got = values(spark, rows, "x double", "x", S.r2(F.col("x")))
    with duckdb.connect() as c:
        assert all(y == c.execute("SELECT round(CAST(? AS DOUBLE), 2)", [x]).fetchone()[0] for x, y in got)
    assert dict(got)[0.575] == 0.57


@pytest.fixture(scope="module")
def pairs_at_the_tie(tmp_path_factory):
    """Conversations whose one pair scores 0.575 (faithful 0.342857, relevant 0.5, complete 0.9), beside two others."""
    pd = pytest.importorskip("pandas")
    words = [c * 40 for c in "abcdefg"]
    tie = ["about " + words[0], f"{words[1]} how does parsing work", " ".join(words)]
    other = ["about nothing", "tell me of it all", " ".join(words)]
    said = [(i, turn, role, text) for i, texts in ((1, tie), (2, tie), (4, other), (5, tie)) for turn, (role, text) in enumerate(zip(("assistant", "user", "assistant"), texts, strict=True))]
    folder = tmp_path_factory.mktemp("tie")
    pd.DataFrame(said, columns=["conv_id", "turn", "role", "text"]).to_parquet(folder / "conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["offline_gate", "rejection_counts", "top_issues"])
def test_scores_on_a_tie_equal_the_sql(spark, pairs_at_the_tie, name):
    duckdb = pytest.importorskip("duckdb")
    from compare import differences

    from orefall.plans import registry

    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{pairs_at_the_tie}/conversations.parquet')")
        wanted = c.execute(registry.oracles()[name]).fetchdf()
    got = registry.queries()[name](spark, pairs_at_the_tie).toPandas()
    assert not differences(got, wanted)


@pytest.fixture(scope="module")
def odd_pairs(tmp_path_factory):
    """Conversations with vertical tabs, capitals of odd lower case, and blanks of other scripts around small talk."""
    pd = pytest.importorskip("pandas")
    words = [c * 40 for c in "abcdefg"]
    said = []
    for i, (before, query, answer) in enumerate(
        [
            (words[0], "how does parsing work", "\x0b".join(words)),
            ("ΑΣΒ " + words[0], "how does ΑΣ parsing work", " ".join([*words, "ΑΣ"])),
            ("ISTANBUL " + words[0], "İstanbul where is it", " ".join([*words, "istanbul"])),
            ("def f " + " ".join(words), "\u3000hello my friend of these parts", " ".join(words)),
            ("def f " + " ".join(words), " ".join(words) + "\u00a0", " ".join(words)),
        ]
    ):
        said += [(7 * i + 1, turn, role, text) for turn, (role, text) in enumerate(zip(("assistant", "user", "assistant"), (before, query, answer), strict=True))]
    folder = tmp_path_factory.mktemp("odd")
    pd.DataFrame(said, columns=["conv_id", "turn", "role", "text"]).to_parquet(folder / "conversations.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["offline_gate", "top_issues", "generation_score", "chatty_filter"])
def test_odd_words_equal_the_sql(spark, odd_pairs, name):
    duckdb = pytest.importorskip("duckdb")
    from compare import differences

    from orefall.plans import registry

    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{odd_pairs}/conversations.parquet')")
        wanted = c.execute(registry.oracles()[name]).fetchdf()
    assert not differences(registry.queries()[name](spark, odd_pairs).toPandas(), wanted)


@pytest.mark.parametrize("name", ["route_positive", "route_negative"])
def test_routes_take_in_the_measures_once(spark, sf, name):
    from orefall.plans import registry

    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(") == 1 and plan.count("array_except(") == 1


def test_long_contexts_are_lowered_once_a_row(spark):
    plan = spark.createDataFrame([("A b", "b C")], "c string, a string").select(S.faithfulness(F.col("c"), F.col("a")).alias("f"))
    assert plan.head()["f"] == 0.7
    assert "Contains(lower" not in plan._jdf.queryExecution().analyzed().toString()


def test_routes_make_code_of_bounded_size(spark, sf):
    from orefall.plans import registry

    plan = registry.queries()["route_positive"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") < 60


@settings(max_examples=100, deadline=None)
@given(st.text("ab é中\0", max_size=200), st.lists(st.text("abé中\0", min_size=1, max_size=40)), st.sampled_from([0, 1 << 14]), st.sampled_from([7, 1 << 20]))
def test_first_ends_equal_find(text, words, plain, block):
    raw, asked = text.encode(), {w.encode() for w in [*words, *text.split(), text[3:50]]} - {b""}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(E, "PLAIN", plain)
        m.setattr(E, "BLOCK", block)
        assert E.first_ends(raw, asked) == {w: raw.find(w) + len(w) for w in asked if w in raw}


def test_words_found_earlier_equal_contains(spark):
    texts = ["ab cd", "é中 abc", None, "cd x", "", "abc x ab"]
    rows = [(g, i, t, None if i % 5 == 3 else ["b", "ab cd", "d\né", "x", "zz", "中 a"]) for g in (1, None, 2) for i, t in enumerate(texts[g or 0 :])]
    for gap in (1, 2):
        got = E.found_earlier(spark.createDataFrame(rows, "g int, i int, t string, w array<string>"), "g", "i", "t", "w", gap).collect()
        assert len(got) == len(rows)
        for r in got:
            before = "\n".join(x[2] for x in rows if x[0] == r["g"] and x[1] <= r["i"] - gap and x[2] is not None)
            words = next(x[3] for x in rows if x[:2] == (r["g"], r["i"]))
            assert r["found"] == (None if words is None else sum(w in before for w in words))


def test_a_long_conversation_takes_time_in_proportion(spark, tmp_path):
    from orefall.plans import registry

    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: F.substring(F.sha2((F.col("id") * 60 + k).cast("string"), 224), 1, 12)), " ")
    said = spark.range(3000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    said.write.parquet(str(tmp_path / "conversations.parquet"))
    began = time.time()
    assert len(registry.queries()["route_audit"](spark, str(tmp_path)).collect()) == 1500
    assert time.time() - began < 20


def test_many_blocks_take_time_in_proportion():
    block = 'int f(int a) {\n  f("{"); // {\n  return a;\n}\n'
    began = time.process_time()
    chunks = C.brace_chunks(block * 100_000)
    assert time.process_time() - began < 15
    assert len(chunks) == 100_000 and [c.start for c in chunks[:3]] == [1, 4, 8] and chunks[-1].end == 400_000


def test_chunks_with_the_columns_named(spark):
    files = spark.createDataFrame([("a.c", "int f(int a) {}\nint g(int a) {}\n" * 2), ("b.c", None), ("c.md", "x")], "file string, content string")
    whole, part = C.chunk_files(files), C.chunk_files(files, columns=("file", "start_line", "type"))
    assert part.columns == ["file", "type", "start_line"]
    assert sorted(map(tuple, part.collect())) == sorted((r["file"], r["type"], r["start_line"]) for r in whole.collect())
    assert whole.count() == 5


_TOPS = [
    "import os\n", "x = 1\r\n", "def f(a):\n    return os.path.join(a, 'a text that is long enough')\n", "@dec\nasync def g(b):\n    await b  # a text that is long enough to stay\n",
    "class A:\n    v = 1\n", '"""\ndef h():\n    pass\n"""\n', "y = (\n", "z = 2\\\n", "\n", "def bad(:\n", "a != b\n", "from __future__ import barry_as_FLUFL\n", "s = 'é'\r",
]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(_TOPS), max_size=8).map("".join))
def test_sources_parsed_in_pieces_equal_the_whole(source):
    assert "".join(C._pieces(source)) == source

    def outcome(parse):
        try:
            return parse(source, 50)
        except (SyntaxError, ValueError):
            return None

    assert outcome(C._parsed_in_pieces) == outcome(C._parsed)


def test_equal_functions_are_parsed_once(monkeypatch):
    seen = []
    parse = ast.parse
    monkeypatch.setattr(C.ast, "parse", lambda source, *a, **k: seen.append(source) or parse(source, *a, **k))
    C._kept_parse.cache_clear()
    one = "def f_once(value):\n    return os.path.join(str(value), 'a constant text')\n"
    chunks = C.python_chunks("import os\n" + one * 500)
    assert [c.start for c in chunks] == [2 + 2 * i for i in range(500)] and sum(map(len, seen)) < 3 * len(one)
