"""Filters, pages and aggregations on small log frames."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timberline.functions import filters as f
from timberline.functions import patterns, text
from timberline.functions.extract import extract
from timberline.operators import aggregations as agg
from timberline.operators import rows

AS_OF = "2026-08-10 12:00:00"
NOW = dt.datetime(2026, 8, 10, 12)


def frame(spark, *entries):
    made = [(i + 1, NOW - dt.timedelta(seconds=age), level, source, file, message) for i, (age, level, source, file, message) in enumerate(entries)]
    return extract(spark.createDataFrame(made, "doc_seq long, ts timestamp, level string, source string, file string, message string"))


@pytest.fixture(scope="module")
def status(spark):
    return frame(
        spark, (10, "ERROR", "payments-api", "app.log", '{"status": 500, "service": "payments"}'), (20, "ERROR", "test-runner", "app.log", '{"status": 500, "service": "test"}'),
        (30, "INFO", "payments-api", "app.log", '{"status": 200, "service": "payments"}'), (40, "WARN", "payments-api", "app.log", "plain unstructured message with no shape"),
    ).cache()


@pytest.fixture(scope="module")
def numeric(spark):
    return frame(spark, *[(10 * (i + 1), "INFO", s, "app.log", f'{{"duration_ms": {v}}}') for i, (v, s) in enumerate([(100, "payments-api"), (200, "payments-api"), (300, "payments-api"), (50, "test-runner")])]).cache()


@pytest.fixture(scope="module")
def simple(spark):
    return frame(spark, (10, "ERROR", "source-a", "app.log", "boom failure"), (20, "INFO", "source-b", "web.log", "all good"), (30, "WARN", "source-a", "app.log", "careful now"), (864000, "ERROR", "source-a", "app.log", "ancient failure")).cache()


def ids(df, where):
    return sorted(r.doc_seq for r in df.where(where).collect())


@pytest.mark.parametrize(("where", "expected"), [
    (lambda: f.equals("status", "500"), [1, 2]),
    (lambda: f.equals("field.status", "500"), [1, 2]),
    (lambda: f.equals("level", "ERROR") & f.equals("source", "payments-api"), [1]),
    (lambda: f.between("status", 500), [1, 2]),
    (lambda: f.between("status", None, 500, with_high=False), [3]),
    (lambda: f.phrase("unstructured message") & f.differs("source", "test-runner"), [4]),
    (lambda: f.phrase("message unstructured"), []),
    (lambda: f.differs("status", "500"), [3, 4]),
    (lambda: f.term("shape nowhere"), [4]),
    (lambda: f.term("--"), []),
    (lambda: f.matches("pay.*"), [1, 3]),
    (lambda: f.matches("PAY.*"), []),
    (lambda: f.matches("pay", "service"), []),
    (lambda: f.matches('"payments"|x', "service"), [1, 3]),
    (lambda: f.clauses(must_not=[f.equals("level", "INFO")]), []),
    (lambda: f.clauses(must=[f.equals("level", "ERROR")], should=[f.term("test")]), [1, 2]),
    (lambda: f.clauses(should=[f.equals("status", "200"), f.term("plain")]), [3, 4]),
    (lambda: f.wildcard("serv*", "service"), []),
    (lambda: f.wildcard("paym?nts", "service"), [1, 3]),
    (lambda: f.prefix("unstr"), [4]),
    (lambda: f.fuzzy("shpae"), [4]),
    (lambda: f.lexical_range("service", "q", None), [2]),
    (lambda: f.everything(), [1, 2, 3, 4]),
])
def test_filters(status, where, expected):
    assert ids(status, where()) == expected


def test_simple_search(simple):
    assert ids(simple, f.simple("failure", as_of=AS_OF, range_minutes=60)) == [1]
    assert ids(simple, f.simple("web.log")) == [2]
    assert ids(simple, f.simple("  ", ["ERROR", "WARN"])) == [1, 3, 4]
    assert ids(simple, f.simple(source="source-a", disabled=["source-b"])) == [1, 3, 4]
    assert ids(simple, f.simple(disabled=["source-a"])) == [2]


def test_pages_and_files(simple):
    recent = simple.where("doc_seq < 4")
    assert [r.level for r in rows.page(recent, "level", "asc").collect()] == ["ERROR", "WARN", "INFO"]
    assert [r.doc_seq for r in rows.page(recent, size=2, number=1).collect()] == [3]
    assert rows.pages(3, 2) == 2
    assert [r.file for r in rows.files(simple.withColumn("file", F.when(F.col("doc_seq") == 4, "APP.log").otherwise(F.col("file")))).collect()] == ["app.log", "web.log"]


def test_counts(status):
    assert {r.key: r["count"] for r in agg.count_by(status.where(f.equals("level", "ERROR")), "source").collect()} == {"payments-api": 1, "test-runner": 1}
    assert [(r.key, r["count"]) for r in agg.count_by(status, "status").collect()] == [("500", 2), ("200", 1)]
    assert [r.key for r in agg.count_by(status.withColumn("file", F.lit(None).cast("string")), "file").collect()] == ["—"]


@pytest.mark.parametrize(("statistic", "expected"), [("avg", 162.5), ("min", 50), ("max", 300), ("sum", 650), ("p50", 100), ("p95", 300), ("p99", 300)])
def test_statistics(numeric, statistic, expected):
    assert [(r.key, r["count"], r.stat_value) for r in agg.numeric_by(numeric, statistic, "duration_ms").collect()] == [("all", 4, expected)]
    (only,) = agg.numeric_over_time(numeric, statistic, "duration_ms", AS_OF, 60, 3_600_000).collect()
    assert (only["count"], only.stat_value) == (4, expected)


def test_average_by_source(numeric):
    assert {r.key: r.stat_value for r in agg.numeric_by(numeric, "avg", "duration_ms", "source").collect()} == {"payments-api": 200.0, "test-runner": 50.0}
    assert agg.numeric_by(numeric, "avg", "nothing").collect() == []


def test_rates(numeric):
    found = agg.count_over_time(numeric, AS_OF, 2, 60_000, with_rate=True).orderBy("i").collect()
    assert [(r["count"], r.rate) for r in found] == [(0, 0.0), (4, 4 / 60)]


@pytest.mark.parametrize(("text_", "expected"), [("Web.log 10.0.0.1 1,000.5 don't", ["web.log", "10.0.0.1", "1,000.5", "don't"]), ("payments-api a.1", ["payments", "api", "a", "1"]), (None, [])])
def test_tokens(spark, text_, expected):
    assert spark.createDataFrame([(text_,)], "x string").select(text.tokens(F.col("x"))).first()[0] == expected


@pytest.mark.parametrize(("pattern", "yes", "no"), [
    ("a^b$", ["a^b$"], ["ab", "a^b$\n"]), ('x"a.b"', ["xa.b"], ["xacb"]), ("@[^@]", ["ab", "a\nb", "é"], ["", "a@"]),
    ("a.b", ["a\nb", "a\U0001f600b"], ["ab"]), ("#|x", ["x"], ["", "#"]), ("()", [""], ["a"]), ("a**?", ["", "aaa"], ["b"]), ("[a&&b]+", ["a&b"], ["|"]), ("[\\d_]{2}", ["1_"], ["a_"]),
    ("<1-20>", ["1", "007", "20"], ["0", "21", "", "1a"]), ("<01-20>", ["01", "20"], ["1", "001"]), ("<20-01>", ["07"], ["21"]), ("v<8-123>x", ["v8x", "v0123x"], ["v7x", "v124x"]), ("<0-0>", ["0"], ["00"]),
    ("~a", ["~a"], ["a", "b"]), ("ab&.*b&a@", ["ab"], ["b"]), ("a|b&c", ["a"], ["b", "c"]), ("(a@&@b)c", ["abc", "a1bc"], ["abcc", "ac"]), ("(.*&<1-5>){2}", ["11", "53"], ["1", "16", "0105"]),
])
def test_term_patterns(spark, pattern, yes, no):
    frame = spark.createDataFrame([*[(t, True) for t in yes], *[(t, False) for t in no]], "t string, expected boolean")
    assert [r.t for r in frame.where(F.col("t").rlike(patterns.whole_term_pattern(pattern)) != F.col("expected")).collect()] == []


@pytest.mark.parametrize("pattern", ['"open', "(a", "a)", "a{2,1}", "a{", "<5>", "[z-a]", "[a", "a\\", "<a-b>"])
def test_refused_patterns(pattern):
    with pytest.raises(ValueError):
        patterns.whole_term_pattern(pattern)


def random_pattern(rng, depth):
    """A pattern, and a function that gives every place where its terms that begin at a place of a text end."""
    kind = rng.choice(["char", "char", "class", "range"] if depth == 0 else ["cat", "cat", "or", "and", "not", "many", "char"])
    if kind in ("char", "class"):
        pattern, held = {"char": [("a", "a"), ("b", "b"), ("1", "1")], "class": [("[^a]", "b01"), (".", "ab01"), ("\\d", "01")]}[kind][rng.randrange(3)]
        return pattern, lambda s, i: {i + 1} if i < len(s) and s[i] in held else set()
    if kind == "range":
        low, high = sorted((rng.randrange(12), rng.randrange(100)))
        wide = len(str(low)) == len(str(high))
        return f"<{low}-{high}>", lambda s, i: {j for j in range(i + 1, len(s) + 1) if s[i:j].isdecimal() and low <= int(s[i:j]) <= high and (not wide or j - i == len(str(high)))}
    p, first = random_pattern(rng, depth - 1)
    if kind == "not":
        return f"~({p})", lambda s, i: {*range(i, len(s) + 1)} - first(s, i)
    if kind == "many":

        def closed(s, i):
            found, todo = {i}, {i}
            while todo:
                todo = {k for j in todo for k in first(s, j)} - found
                found |= todo
            return found

        return f"({p})*", closed
    q, last = random_pattern(rng, depth - 1)
    if kind == "cat":
        return f"({p})({q})", lambda s, i: {k for j in first(s, i) for k in last(s, j)}
    return (f"({p}|{q})", lambda s, i: first(s, i) | last(s, i)) if kind == "or" else (f"({p}&{q})", lambda s, i: first(s, i) & last(s, i))


def test_any_term_pattern_agrees_with_brute_force(spark):
    import itertools
    import random

    rng = random.Random(5)
    made = [random_pattern(rng, rng.choice([1, 2, 3])) for _ in range(150)]
    assert sum("&" in p for p, _ in made) > 20 and sum("~" in p for p, _ in made) > 20
    texts = ["".join(t) for n in range(5) for t in itertools.product("ab01", repeat=n)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    found = frame.select("t", *[F.col("t").rlike(patterns.whole_term_pattern(p, complement=True)).alias(f"p{i}") for i, (p, _) in enumerate(made)]).collect()
    wrong = [(p, r.t) for r in found for i, (p, ends) in enumerate(made) if r[i + 1] != (len(r.t) in ends(r.t, 0))]
    assert wrong == []


def test_patterns_with_too_many_states_are_refused():
    with pytest.raises(ValueError, match="states"):
        patterns.whole_term_pattern("(@a.{12}&@b.{9})c")


LEAVES = [("level", "ERROR"), ("source", "payments-api"), ("status", "500"), ("service", "test")]
TREES = st.recursive(st.sampled_from(LEAVES), lambda sub: st.tuples(st.sampled_from(["and", "or", "not"]), sub, sub), max_leaves=6)


def build(tree):
    if len(tree) == 2:
        return f.equals(*tree)
    kind, a, b = tree
    return f.negate(build(a)) if kind == "not" else build(a) & build(b) if kind == "and" else build(a) | build(b)


def holds(tree, row):
    if len(tree) == 2:
        return (row[tree[0]] if tree[0] in ("level", "source") else row["fields"].get(tree[0])) == tree[1]
    kind, a, b = tree
    return not holds(a, row) if kind == "not" else (holds(a, row) and holds(b, row)) if kind == "and" else (holds(a, row) or holds(b, row))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(tree=TREES)
def test_any_predicate_agrees_with_plain_python(status, tree):
    everything = status.collect()
    assert ids(status, build(tree)) == [r.doc_seq for r in everything if holds(tree, r.asDict())]


def plain_near(tokens, words, slop):
    """By trying every choice of positions."""
    import itertools

    places = [[i for i, t in enumerate(tokens) if t == w] for w in words]
    for chosen in itertools.product(*places):
        shifts = [p - i for i, p in enumerate(chosen)]
        if len(set(chosen)) == len(chosen) and max(shifts) - min(shifts) <= slop:
            return True
    return False


@pytest.mark.parametrize("phrase", ["a b", "a a", "a b a", "a b c", "b b b", "ä b"])
@pytest.mark.parametrize("slop", [1, 2, 4])
def test_sloppy_phrases(spark, phrase, slop):
    import random

    rng = random.Random(f"{phrase}{slop}")
    texts = [" ".join(rng.choices(["a", "b", "c", "x", "ä"], k=rng.randint(0, 9))) for _ in range(120)] + [None, ""]
    frame = spark.createDataFrame([*enumerate(texts)], "k int, t string")
    found = {r.k for r in frame.where(text.has_near_phrase(F.col("t"), phrase, slop)).select("k").collect()}
    assert found == {k for k, t in enumerate(texts) if plain_near((t or "").split(), phrase.split(), slop)}


def test_sloppy_phrase_without_tokens(spark):
    assert spark.range(3).where(text.has_near_phrase(F.lit("a b"), "...", 3)).count() == 0
