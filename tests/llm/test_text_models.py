"""Source divergence, token alignment and toxicity: against plain versions, on held-out rows and on odd input."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tideloom.llm import alignment, divergence, token_counts, toxicity

LETTERS = "abcdefghijklmnopqrstuvwxyzé"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


# source divergence


def plain_audit(rows, least):
    words = [(lang or "", source or "", brute.terms(text)) for lang, source, text in rows]
    groups = {(lang, source) for lang, source, _ in words}
    held = defaultdict(Counter)
    whole, docs = Counter(), Counter()
    for lang, source, terms in words:
        held[lang, source].update(terms)
        whole.update((lang, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang, source in groups:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= least)
        share = lambda count: (lambda n: {t: 1 + 10**9 * (count(t) + 2) // (n + 2 * len(kept)) for t in kept})(sum(map(count, kept)))
        p = share(lambda t: held[lang, source][t])  # noqa: B023
        q = share(lambda t: whole[lang, t])  # noqa: B023
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = []
        for other in sorted(s for x, s in groups if x == lang and s != source):
            r = share(lambda t: held[lang, other][t])  # noqa: B023
            pairs.append((-sum(apart(p[t], r[t]) for t in kept), other))
        terms = [(-apart(p[t], q[t]), t) for t in kept if held[lang, source][t] and p[t] > q[t]]
        for part, found, top in (("pair", pairs, None), ("term", terms, 10)):
            found.sort(key=lambda x: (x[0], x[1].encode()))
            out += [(lang, source, part, item, -value, i) for i, (value, item) in enumerate(found[:top], 1)]
    return sorted(out, key=repr)


def words_of(make, n, longest):
    return ["".join(make.choice(LETTERS) for _ in range(make.randint(1, longest))) for _ in range(n)]


@pytest.mark.parametrize("tile,block,piece", [(256, 1024, 2 << 20), (2, 3, 300)])
def test_audit_equals_plain_version(spark, monkeypatch, tile, block, piece):
    make = random.Random(7)
    words = words_of(make, 40, 3) + words_of(make, 20, 20) + words_of(make, 5, 80)
    rows = [
        (make.choice(["en", "de", None]), make.choice(["s1", "s2", "s3", "s4", "", None]),
         make.choice([None, " ", "-".join(make.choices(words, k=make.randint(1, 120))).title(), "x " * make.randint(1, 9)]))
        for _ in range(150)
    ] + [("fr", "s1", "rare words only"), ("fr", "s2", None), ("es", "one", "x")]
    for name, value in (("TILE", tile), ("TERMS", block), ("PIECE", piece)):
        monkeypatch.setattr(divergence, name, value)
    got = divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string"), least=4)
    assert rows_of(got) == plain_audit(rows, 4)


def test_radix_order_sorts_words():
    make = np.random.default_rng(1)
    words = [make.integers(0, 3, 500).astype(np.uint64), make.integers(0, 1 << 62, 500).astype(np.uint64) << np.uint64(1)]
    order = divergence.radix_order(words)
    assert order.tolist() == sorted(range(500), key=lambda i: (words[0][i], words[1][i], i))


def test_audit_odd(odd, empty):
    assert {r["part"] for r in divergence.audit(odd, least=1).collect()} == {"pair", "term"}
    assert divergence.audit(empty).collect() == []


# token alignment


@pytest.fixture(scope="module")
def files():
    return alignment.load(f"{token_counts.TOKENIZERS}/byte_bpe_50k.json", f"{token_counts.TOKENIZERS}/piece_bpe_32k.model")


@pytest.mark.parametrize("chunk,cut", [(512 << 10, 256 << 10), (900, 200)])
def test_alignment_equals_plain_version(spark, data, files, monkeypatch, chunk, cut):
    docs = spark.read.parquet(f"{data}/documents.parquet").filter("length(text) < 700").select("doc_id", "text").limit(60)
    rows = [tuple(r) for r in docs.collect()] + [
        (None, None), (7, ""), (8, "<|endoftext|> <s> </s> <unk> x"), (9, "\x00 a\tb  c d▁e"), (10, "  lead"), (11, "日本語 éü 🎉🎉"),
        (12, "a b " * 9), (12, "a b " * 9), (13, "x" * 2_500), (14, "word after word " * 60),
    ]
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "CUT", cut)
    got = alignment.align_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), files)
    assert rows_of(got) == sorted(brute.aligned(rows, alignment.Tokenizers(files)), key=repr)


def test_pointer_jumping_ends_at_the_terminal_token():
    make = np.random.default_rng(2)
    for _ in range(200):
        n = int(make.integers(1, 40))
        a, b = (np.unique(np.r_[make.integers(1, n + 1, 8), n]) for _ in range(2))
        label_a, label_b, link_a, link_b = alignment.align(a, b)
        common = np.intersect1d(a, b)
        assert label_a.tolist() == [len(a) + int(np.searchsorted(b, common[np.searchsorted(common, e)])) for e in a]
        assert label_b.tolist() == [len(a) + int(np.searchsorted(b, common[np.searchsorted(common, e)])) for e in b]
        begin = lambda ends, i: ends[i - 1] if i else 0
        want = [(i, j) for i in range(len(a)) for j in range(len(b)) if begin(a, i) < b[j] and begin(b, j) < a[i]]
        assert sorted(zip(link_a.tolist(), link_b.tolist())) == want


def test_both_encoders_of_side_a_agree(files):
    tokens, make = alignment.Tokenizers(files), random.Random(4)
    letters = [chr(i) for i in range(0x250)]
    for _ in range(400):
        text = "".join(make.choice(letters if make.random() < 0.5 else " \t\n'stredvlm1x.") for _ in range(150))
        assert tokens.fast.encode_ordinary(text) == tokens.a.encode(text, add_special_tokens=False).ids


def test_alignment_odd(odd, empty, files):
    got = {r["doc_id"]: r for r in alignment.align_documents(odd.filter("doc_id > 0 or doc_id is null"), files).collect()}
    assert got[1]["n_a"] == 0 and got[1]["groups_sha256"] == "" and got[6]["n_links"] > 0
    assert alignment.align_documents(odd, files).count() == odd.count()
    assert alignment.align_documents(empty, files).collect() == []


# toxicity


def test_forward_backward_equals_all_taggings():
    make = np.random.default_rng(3)
    lengths = [1, 4, 2, 5, 1]
    sequence = np.repeat(np.arange(len(lengths)), lengths)
    emission, moves = make.normal(size=len(sequence)), make.normal(size=(2, 2))
    chance, pairs, plain, total = toxicity.forward_backward(emission, sequence, moves)
    for s in range(len(lengths)):
        at = np.flatnonzero(sequence == s)
        weight, hits, joint = [], np.zeros(len(at)), np.zeros((len(at), 2, 2))
        for tags in itertools.product((0, 1), repeat=len(at)):
            w = np.exp(sum(emission[i] * t for i, t in zip(at, tags)) + sum(moves[x, y] for x, y in zip(tags, tags[1:])))
            weight.append(w)
            hits += w * np.array(tags)
            for k in range(1, len(at)):
                joint[k, tags[k - 1], tags[k]] += w
        assert np.allclose(chance[at], hits / sum(weight))
        assert np.allclose(pairs[:, :, at].transpose(2, 0, 1)[1:], joint[1:] / sum(weight))
        assert np.isclose(total[s], np.log(sum(weight))) and np.isclose(plain[s], np.log(weight[0] / sum(weight)))


def test_toxicity_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    field = toxicity.learn(docs, labels)
    scored = toxicity.score(docs.join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))), field)
    rows = scored.select("row.toxic", "toxicity.*", "row.text").collect()
    bad, good = ([r for r in rows if r["toxic"] == k] for k in (1, 0))
    above = sum((b["score"] > g["score"]) + 0.5 * (b["score"] == g["score"]) for b in bad for g in good)
    assert above > 0.95 * len(bad) * len(good)
    assert sum(r["predicted"] for r in bad) > 0.9 * len(bad) and sum(r["predicted"] for r in good) < 0.03 * len(good)
    spans = [r["text"][s["start"] : s["end"]] for r in bad for s in r["spans"]]
    assert spans and all(s and not s[0].isspace() and not s[-1].isspace() for s in spans)


def test_pieces_of_a_text_score_like_the_whole(spark, monkeypatch):
    field = toxicity.Field(np.random.default_rng(1).normal(size=toxicity.CELLS), np.zeros((2, 2)), np.zeros(0, np.uint64), np.zeros(4))
    text = "\n".join(f"líne {i} wörd{i % 7} other" for i in range(200))
    rows = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    whole = toxicity.score(rows, field).first()["toxicity"]
    monkeypatch.setattr(toxicity, "PIECE", 150)
    parts = toxicity.score(rows, field).first()["toxicity"]
    assert parts["spans"] == whole["spans"] and len(whole["spans"]) > 50
    assert abs(parts["expected"] - whole["expected"]) < 1e-9


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, 0), (None, 1), (5, None)], "doc_id bigint, toxic int")
    field = toxicity.learn(odd, labels)
    rows = toxicity.score(odd, field).select("row.doc_id", "row.kept", "toxicity.score", "toxicity.predicted").collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["kept"] == "kept" for r in rows)
    assert toxicity.score(empty, field).collect() == []
    assert toxicity.learn(empty, labels).logistic[-1] == 0
