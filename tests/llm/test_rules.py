"""Quality rules against plain counts, with every odd case, and the paths that few documents take."""

import collections
import re

import pytest
from conftest import ODD
from pyspark.sql import functions as F

from timberline.llm import quality_rules
from timberline.llm.quality_rules import BASE, METRICS, RULES, Threshold, judge, text_metrics

EXTRA = [(50, "a a a a a", "en"), (51, "a b c d a b c", "en"), (52, "a b c a b", "en"), (53, "x y", None), (54, "...\n- one\n• two\nthree…\r\n\n  \nthree…\r\n- one", "en"), (55, "p q r\n" * 40 + "s p q r s p q", "fr"), (56, "# * $ % & | < > ## x", "xx"), (57, "é\x0bü\x0c\x85ñ\x1fz 漢字 1 2a", "de")]


def plain_metrics(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def rows(spark, odd):
    extra = spark.createDataFrame([(*r, "s") for r in EXTRA], "doc_id long, text string, lang string, source string")
    return odd.unionByName(extra, allowMissingColumns=True)


def plain_of(rows):
    return sorted((str(i), *plain_metrics(t)) for i, t, *_ in rows)


@pytest.mark.parametrize("bits", [24, 2, 62])
def test_metrics_equal_plain_counts(rows, monkeypatch, bits):
    """Also where keys collide (62: hashes of one bit) and where documents have too many places (2)."""
    monkeypatch.setattr(quality_rules, "PLACE_BITS", bits)
    found = text_metrics(rows).select(F.col("doc_id").cast("string"), *METRICS[:5]).collect()
    assert sorted((str(r[0]), *r[1:]) for r in found) == plain_of([*ODD, *EXTRA])


def test_verdicts(rows):
    found = {r.doc_id: r for r in judge(text_metrics(rows)).collect() if r.doc_id is not None}
    for d, text, *_ in [*ODD, *EXTRA]:
        if d is not None:
            n, _, _, _, again = plain_metrics(text)
            assert found[d].base_failed == (n < 50 or 100 * again > 50 * n), d
            assert not (found[d].kept and found[d].base_failed) and found[d].kept == (found[d].failed_rules == "")
    assert found[55].failed_rules == "repeated_words,word_length,stop_words,repeated_lines"
    assert found[56].failed_rules == "too_short,word_length,symbols,wordless"  # no stop words are known for its language


def test_empty_table(none):
    assert judge(text_metrics(none)).count() == 0


def test_table_of_thresholds(spark):
    metrics = spark.createDataFrame([(1, 5, "en"), (2, 50, None), (3, 500, "de")], "doc_id long, n_words long, lang string")
    rules = (Threshold("few", "n_words", least=10), Threshold("many", "n_words", most=100, langs=("en", "de")), Threshold("open", "n_words"))
    assert [(r.doc_id, r.base_failed, r.kept, r.failed_rules) for r in judge(metrics, rules, ()).orderBy("doc_id").collect()] == [(1, False, False, "few"), (2, False, True, ""), (3, False, False, "many")]


def test_good_documents_stay_and_bad_ones_go(spark, documents, data):
    labels = spark.read.parquet(f"{data}/labels.parquet").where("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    found = judge(text_metrics(documents)).join(labels, "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r.quality: r.share for r in found}
    assert share[1] == 1.0 and share.get(0, 0) <= 0.1


def test_no_python_and_no_shuffle(documents):
    found = documents.sparkSession._jvm.PythonSQLUtils.explainString(judge(text_metrics(documents))._jdf.queryExecution(), "formatted")
    assert "Python" not in found and "Exchange" not in found and "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in found
    assert len(BASE) + len(RULES) > 8
