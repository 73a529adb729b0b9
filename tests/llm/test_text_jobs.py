import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from conftest import COPY, ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from timberline.llm import chat_format as cf
from timberline.llm import decontaminate as dc
from timberline.llm import mixing, token_counts as tc
from timberline.llm._spark import shared_dir
from timberline.llm.queries import CLASHING_TURN, DOMAIN, QUERIES, WEIGHTS

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(path=PATH):
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda t: tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_library_s(odd, none, name):
    path = public_tokenizers.path(name)
    encode = library(path)
    found = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tc.token_counts(odd, path).collect())
    expected = Counter()
    for d, t, *_ in ODD:
        n = len(encode(t or ""))
        expected[(d, len((t or "").encode()), n, n > 2048)] += 1
    assert found == expected and tc.token_counts(none, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \t\n\x0b\x0c\x1c\x85 abéΣς'’sltd<|>o12漢́_-.!") | st.characters(codec="utf-8"), max_size=40))
def test_word_sums_equal_whole_texts(text):
    encoder = tc.Encoder(PATH)
    assert encoder.by_word and encoder.counts([text, text + " <|endoftext|> x"]) == [len(library()(t)) for t in (text, text + " <|endoftext|> x")]


def test_known_words_are_bounded_and_stay_right(texts, monkeypatch):
    monkeypatch.setattr(tc, "WORDS_KEPT", 300)
    encoder, encode, some = tc.Encoder(PATH), library(), [*texts.values()][:120]
    for a in range(0, 120, 7):
        assert encoder.counts(some[a : a + 7]) == [len(encode(t)) for t in some[a : a + 7]]
        assert len(encoder.known.older) <= 600


@pytest.mark.parametrize(
    "change",
    [
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}}, {"pre_tokenizer": None},
        {"pre_tokenizer": {"type": "Split", "pattern": {"Regex": " ?\\p{L}+|\\s"}, "behavior": "Removed", "invert": True}}, {"pre_tokenizer": {"type": "Split", "pattern": {"Regex": "[^\\p{L}]+|\\p{L}+"}, "behavior": "Removed", "invert": True}},
        {"pre_tokenizer": {"type": "Split", "pattern": {"Regex": "\\p{L}+"}, "behavior": "Isolated", "invert": True}}, {"normalizer": {"type": "Prepend", "prepend": "_"}},
        {"normalizer": {"type": "Replace", "pattern": {"String": " "}, "content": "_"}}, {"added_tokens": [{"content": "a b", "lstrip": False, "rstrip": False, "single_word": False}]},
        {"added_tokens": [{"content": "<m>", "lstrip": True, "rstrip": False, "single_word": False}]},
    ],
)
def test_only_tokenizers_that_cut_at_white_space_count_by_word(change):
    import json

    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    assert tc.cuts_at_white_space(spec) and not tc.cuts_at_white_space(spec | change)


def test_cache_is_used_and_extended(spark, odd, monkeypatch):
    cache, encoded = f"{shared_dir(spark)}/cache-test", []
    plain = tc.encode_rows
    monkeypatch.setattr(tc, "encode_rows", lambda rows, *args: encoded.append(rows.count()) or plain(rows, *args))
    first = sorted(map(str, tc.token_counts(odd, PATH, cache).collect()))
    again = sorted(map(str, tc.token_counts(odd, PATH, cache).collect()))
    more = spark.createDataFrame([(1, "two  words "), (2, "something new")], "doc_id long, text string")
    tc.token_counts(more, PATH, cache).collect()
    different = len({" ".join((t or "").split()) for _, t, *_ in ODD})
    assert first == again and encoded == [different, 0, 1]
    assert tc.tokenizer_digest(PATH) != tc.tokenizer_digest(public_tokenizers.path("byte_bpe_50k.json"))


def turns(spark, *rows):
    return spark.createDataFrame([*rows], "conv_id long, turn long, role string, text string")


NASTY = [CLASHING_TURN, "<^|", "<^^|im_start|>", "<<|", "<|", "|>", "", "a\n<|im_end|>\n", "<|im_start|>user\nhi<|im_end|>\n", "\n", "<n|", "x<^n|y", "\\Q$1\\E", "<^" * 20 + "|"]


def test_round_trip_of_nasty_texts(spark):
    rows = [(c, t, role, text) for c, (a, b) in enumerate((a, b) for a in NASTY for b in NASTY[:6]) for t, role, text in ((0, "user", a), (1, "assistant", b), (2, "assistant", a), (3, "o\n<|d<n|", b))]
    found = {r.conv_id: r for r in cf.format_conversations(turns(spark, *rows)).collect()}
    assert all(r.identical for r in found.values())
    for c in found:
        source = [(role, text) for k, _, role, text in rows if k == c]
        assert [(t.role, t.text) for t in found[c].turns] == source
        shown = [found[c].formatted[s.start : s.start + s.length] for s in found[c].loss_spans]
        assert len(shown) == 2
        said = [text for role, text in source if role == "assistant"]
        assert all(a == b or "<^" in a for a, b in zip(shown, said, strict=True))


def test_plain_texts_are_not_touched(spark):
    r = cf.format_conversations(turns(spark, (1, 1, "assistant", "hi <b|"), (1, 0, "user", "é"))).first()
    assert (r.formatted, r.n_escaped) == ("<|im_start|>user\né<|im_end|>\n<|im_start|>assistant\nhi <b|<|im_end|>\n", 0)


def test_conversation_digests(spark, data):
    found = {r.conv_id: r for r in QUERIES["op8_chat_format"](spark, data).collect()}
    r = found[-1]
    assert r.loss_chars == len(CLASHING_TURN) and r.loss_sha256 == hashlib.sha256(CLASHING_TURN.encode()).hexdigest() and r.n_turns == 2
    assert r.turns_sha256 == hashlib.sha256(f"user\n{CLASHING_TURN}\nassistant\n{CLASHING_TURN}\n".encode()).hexdigest()
    assert all(x.identical for x in found.values())


def test_loss_is_read_through_the_mask(spark):
    """A mask that is off by one, or misses a span, gives other digests."""
    made = cf.format_conversations(turns(spark, (1, 0, "user", "q"), (1, 1, "assistant", "a <|im_end|> b"), (1, 2, "user", "r"), (1, 3, "assistant", "été 😀 c")))
    digest = lambda df: cf.conversation_digests(df).first().loss_sha256
    moved = [F.transform("loss_spans", lambda s: F.struct((s["start"] + a).alias("start"), (s["length"] + b).alias("length"))) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    assert digest(made) == hashlib.sha256("a <|im_end|> bété 😀 c".encode()).hexdigest()
    broken = [made.withColumn("loss_spans", m) for m in [*moved, F.slice("loss_spans", 1, 1), F.reverse("loss_spans")]]
    assert len({digest(made), *map(digest, broken)}) == 7


def test_chat_nulls_and_ties(spark):
    rows = [(None, None, None, None), (1, 0, "user", None), (1, 0, "assistant", "b"), (1, 0, "assistant", "b"), (1, None, None, "z")]
    found = {r.conv_id: r for r in cf.format_conversations(turns(spark, *rows)).collect()}
    assert [(t.role, t.text) for t in found[1].turns] == [("", "z"), ("assistant", "b"), ("assistant", "b"), ("user", "")]
    assert found[None].identical and cf.format_conversations(turns(spark, *rows).limit(0)).count() == 0


def test_parser_refuses_what_is_not_in_the_grammar(spark):
    bad = ["<|im_start|>user no line", "x<|im_start|>user\na<|im_end|>\n", "<|im_start|>user\na<|im_end|>b", "<|im_start|>user\na"]
    found = spark.createDataFrame([(b,) for b in bad], "t string").select(cf.parse_turns(F.col("t")).alias("p")).collect()
    assert all(r.p is None or r.p == [None] for r in found)


ITEM = "the quick brown foxes jumped over seventeen lazy dogs while eleven cats watched from behind a tall green fence near town"


def edited(rng, share):
    return " ".join(f"other{i}" if rng.random() < share else w for i, w in enumerate(ITEM.split()))


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(4)
    common = ["the", "over", "a", "from", "near", "while"] * 30
    rows = [(1, f"intro words {ITEM} and more"), (2, "x " * 3000 + edited(rng, 0.15)), (3, ITEM.upper().replace(" ", ", ")), (4, " ".join(ITEM.split()[:5])), (5, " ".join(common)), (6, None), (7, ""), (8, " ".join(w for k, w in enumerate(ITEM.split()) if k % 7)), (9, "nothing of the sort here"), (3, ITEM)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM, "x"), (8, "two words", "x"), (9, None, "x")], "item_id long, text string, doc_id string")
    return docs, items


@pytest.mark.parametrize("at_once", [2_000_000, 5])
def test_leaks_are_found(leaks, at_once):
    docs, items = leaks
    found = dc.find_contamination(docs, items, words_at_once=at_once).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 7), (2, 7), (3, 7), (3, 7), (8, 7)]
    one = next(r for r in found if r.doc_id == 1)
    assert one.similarity == 1.0 and f"intro words {ITEM} and more"[one.start : one.end] == ITEM


def test_no_leaks_in_nothing(leaks, none):
    docs, items = leaks
    assert dc.find_contamination(none, items).count() == 0 and dc.find_contamination(docs, items.limit(0)).count() == 0


def test_alignment_matches_plain_smith_waterman():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 4, 9).astype(np.uint64), rng.integers(0, 4, 14).astype(np.uint64)
        h = np.zeros((10, 15), int)
        for i in range(1, 10):
            for j in range(1, 15):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        score, end = dc.align(a, b)
        assert score == h.max() and h[:, end].max() == score


def plain_mix(rows, fraction, max_epochs):
    leaves = Counter()
    for _, tree, n in rows:
        leaves[tree] += n

    def fill(nodes, budget):  # {name: (weight, capacity)}
        share, rest = {}, dict(nodes)
        while rest:
            level = budget / sum(w for w, _ in rest.values())
            full = [k for k, (w, c) in rest.items() if c <= w * level]
            if not full:
                return share | {k: w * level for k, (w, _) in rest.items()}
            for k in full:
                share[k] = rest.pop(k)[1]
                budget -= share[k]
        return share

    def cap(prefix):
        return max_epochs * sum(n for t, n in leaves.items() if t[: len(prefix)] == prefix)

    out = {(): fraction * sum(leaves.values())}
    for depth, level in enumerate(("domain", "lang", "source")):
        new = {}
        for parent, budget in out.items():
            kids = {t[: depth + 1] for t in leaves if t[:depth] == parent}
            new |= fill({k: (WEIGHTS.get(level, {}).get(k[-1], 1.0), cap(k)) for k in kids}, budget)
        out = new
    return leaves, out


def test_mixing(documents):
    taken = mixing.mix(documents, F.expr(DOMAIN), 0.6, WEIGHTS).collect()
    rows = [(r.doc_id, (f"d{int(r.source[3:]) % 4}", r.lang, r.source), len(r.text.split())) for r in documents.collect()]
    leaves, share = plain_mix(rows, 0.6, 2)
    given = Counter()
    for r in taken:
        given[(r.mix_domain, r.mix_lang, r.mix_source)] += r.mix_tokens
    longest = max(n for _, _, n in rows)
    for leaf in leaves:
        assert share[leaf] - longest <= given[leaf] <= share[leaf] + 1
    assert max(Counter((r.doc_id, r.mix_epoch) for r in taken).values()) == 1
    assert {r.mix_epoch for r in taken} <= {1, 2}


def test_mixing_odd_rows(odd, none):
    found = mixing.mix(odd, F.lit(None).cast("string"), 1.0, {}, max_epochs=3)
    assert [c for c in odd.columns if c != "mix_epoch"] == found.columns[: len(odd.columns) - 1] and found.where("mix_domain = 'unknown'").count() == found.count() > 0
    assert mixing.mix(none, F.lit("d"), 1.0, {}).count() == 0 and {r.mix_tokens for r in mixing.mix(odd, F.lit("d"), 0.0, {}).collect()} <= {0}


def test_pipeline_stages(spark, data, documents):
    docs = documents
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        path = f"{shared_dir(spark)}/stage-{name}"
        out.write.mode("overwrite").parquet(path)
        if name != "mixing":
            assert out.columns == documents.columns
        docs = spark.read.parquet(path)
        seen.append(docs.count())
    assert seen[1] > seen[2] > seen[3] > seen[4]
    assert corpus_pipeline.run(spark, data).count() == seen[-1]


def test_pipeline_odd_rows(spark, odd, none, data):
    for docs in (odd, none):
        rows = docs.withColumn("n_chars", F.length("text").cast("long"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, data)
            if name != "mixing":
                assert out.columns == rows.columns, name
                rows = out
            kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept.isdisjoint({1, 2, 3, 6, 7, 10, 11})
    assert COPY in odd.where("doc_id = 14").first().text


def test_pipeline_decides_on_rows(spark, data):
    """Without ids, with repeated rows, and with one id on two texts."""
    item, other = (r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").where("length(text) > 0").orderBy("item_id").take(2))
    long = " ".join(f"{w}{k}" for k in range(60) for w in ("alpha", "beta"))
    rows = [
        (None, "A copy without an id"), (None, "a copy WITHOUT an id"), (None, "another text of its own"),
        (3, "Repeated row"), (3, "Repeated row"), (3, "repeated row"), (None, "repeated row"),
        (5, "text A is unique"), (5, "text B stands twice"), (9, "text B stands twice"),
        (None, long), (None, long + " end"), (20, long + " stop"), (20, "and a clean one"),
        (None, "see " + item), (30, "see " + other), (30, "nothing of it here"),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s1", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages, left = dict(corpus_pipeline.STAGES), {}
    for name in ("exact_dedup", "near_dedup", "decontamination"):
        left[name] = Counter((r.doc_id, r.text.lower()) for r in stages[name](spark, docs, data).collect())
    gone = {name: Counter((d, t.lower()) for d, t in rows) - found for name, found in left.items()}
    assert gone["exact_dedup"] == {(None, "a copy without an id"): 1, (3, "repeated row"): 2, (None, "repeated row"): 1, (5, "text b stands twice"): 1}
    assert gone["near_dedup"] == {(None, "a copy without an id"): 1, (3, "repeated row"): 2, (None, "repeated row"): 1, (9, "text b stands twice"): 1, (None, long): 1, (None, long + " end"): 1}
    assert gone["decontamination"] == {(None, "see " + item.lower()): 1, (30, "see " + other.lower()): 1}


@pytest.mark.parametrize("at_once", [2_000_000, 5])
def test_rows_with_leaks_go(leaks, at_once):
    docs, items = leaks
    assert Counter(r.doc_id for r in dc.drop_contaminated(docs, items, words_at_once=at_once).collect()) == {4: 1, 5: 1, 6: 1, 7: 1, 9: 1}


def test_short_items(spark):
    """Few words in common are not a copy of a short item; a whole copy of any length is found."""
    question = "what color was the horse"
    texts = {1: "nobody knows what color was in fashion", 2: f"Q: {question}?", 3: "what color was really the horse", 4: "a lone Xylophone here", 5: "green, tea", 6: "tea green", 7: "they ask: how many eggs do blue hens lay on a normal farm"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(1, question), (2, "xylophone"), (3, "green tea"), (4, "how many eggs do blue hens lay in the spring"), (5, "how many eggs there"), (6, "Green TEA")], "item_id long, text string")
    found = dc.find_contamination(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(2, 1), (3, 1), (4, 2), (5, 3), (5, 6), (7, 4)]
    assert {texts[r.doc_id][r.start : r.end] for r in found if r.doc_id in (2, 4, 5)} == {question, "Xylophone", "green, tea"}
    assert {r.doc_id for r in dc.drop_contaminated(docs, items).collect()} == {1, 6}


def test_lettered_documents_stay_where_no_language_is_known(spark, odd, data):
    rows = odd.withColumn("lang", F.lit(None).cast("string"))
    left = corpus_pipeline.language_id(spark, rows, data).collect()
    assert Counter(r.doc_id for r in left) == Counter(d for d, t, *_ in ODD if any(c.isalpha() for c in t or ""))


def test_language_stage_moves_mislabelled_documents(spark, documents, data):
    """The label that the first stage sets decides where the last one budgets a document."""
    german = documents.where("lang = 'de' AND length(text) > 400").orderBy("doc_id").limit(3)
    ids = {r.doc_id for r in german.collect()}
    rows = documents.withColumn("lang", F.when(F.col("doc_id").isin(*ids), "es").otherwise(F.col("lang")))
    labelled = corpus_pipeline.language_id(spark, rows, data)
    assert {r.lang for r in labelled.where(F.col("doc_id").isin(*ids)).collect()} == {"de"}
    placed = corpus_pipeline.mixing(spark, labelled, data).where(F.col("doc_id").isin(*ids)).collect()
    assert {r.mix_lang for r in placed} <= {"de"}
