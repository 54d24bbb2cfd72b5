"""Learned scores: held-out accuracy, exact parts against brute force, and odd rows."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.llm import pseudo, quality, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None, 1), (2, "", 1), (3, " \n\t", 1), (4, "a", 1), (4, "a", 1), (None, "no key", 1), (5, "long words " * 100_000, 1), (6, "é" * 50, 1), (7, "\x00\ud7ff|", 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, score int").repartition(3)


@pytest.fixture(scope="module")
def judged(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def auc(score, truth):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    n = truth.sum()
    return (rank[truth].sum() - n * (n - 1) / 2) / (n * (~truth).sum())


def held_out_rows(df, labels, column):
    rows = df.filter("held_out").join(labels, "doc_id").select("score", "predicted", column).collect()
    return np.array([r["score"] for r in rows]), np.array([r[column] == 1 for r in rows]), np.array([r["predicted"] for r in rows])


def test_quality_on_held_out_rows(judged):
    documents, labels = judged
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = quality.fit_quality(documents, labels.filter((F.col("quality") == 1) & (fold != 1)), "doc_id", "text")
    assert abs(model[1] - 341 / 399) < 0.12
    score, good, predicted = held_out_rows(quality.score_quality(documents, "doc_id", "text", model, fold == 1), labels, "quality")
    assert auc(score, good) > 0.97 and (predicted == good).mean() > 0.95 and predicted[good].mean() > 0.97


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(4)
    for prior in (0.3, 0.6, 0.9):
        good, mixed = rng.normal(2, 1, 4000), np.where(rng.random(8000) < prior, rng.normal(2, 1, 8000), rng.normal(-2, 1, 8000))
        assert abs(quality.class_prior(good, mixed) - prior) < 0.08
        net, found = quality.fit(good[:, None], mixed[:, None], steps=150)
        assert abs(found - prior) < 0.1 and net.logit(np.array([[3.0]]))[0] > 0 > net.logit(np.array([[-3.0]]))[0]


def test_risk_gradient():
    """The network's gradient is the loss's slope."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20, 4))
    net = quality.Net.new(x, 5, 1)
    z, target = net.inputs(x), rng.random(20)
    out, h = net.forward(z)
    slopes = net.gradient(z, h, quality.sigmoid(out) - target)
    loss = lambda: float((np.logaddexp(0, net.forward(z)[0]) - target * net.forward(z)[0]).sum())
    for part, slope in zip(net.parts, slopes, strict=True):
        at = tuple(rng.integers(0, n) for n in part.shape)
        part[at] += 1e-5
        up = loss()
        part[at] -= 2e-5
        assert (up - loss()) / 2e-5 == pytest.approx(slope[at], abs=1e-4)
        part[at] += 1e-5


@pytest.mark.parametrize("fitted", [True, False])
def test_quality_of_odd_rows(odd, judged, fitted):
    documents, labels = judged
    model = quality.fit_quality(documents, labels.filter("quality = 1"), "doc_id", "text", 100, 200) if fitted else quality.fit_quality(odd, odd.filter("false"), "doc_id", "text")
    assert (model is not None) == fitted
    got = quality.score_quality(odd, "doc_id", "text", model, F.lit(False)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(k for k, _, _ in ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert quality.score_quality(odd.filter("false"), "doc_id", "text", model, F.lit(False)).count() == 0
    assert odd.filter(quality.is_good("text", model)).columns == odd.columns


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abc"), n))
    for _ in range(15):
        terms = list({(word(int(rng.integers(2, 13))), bool(rng.random() < 0.4)) for _ in range(6)})
        terms = [t for k, t in enumerate(terms) if t[0] not in {x for x, _ in terms[:k]}]
        lexicon = toxicity.FuzzyLexicon(terms)
        for _ in range(150):
            base = terms[int(rng.integers(len(terms)))][0] if rng.random() < 0.7 else word(int(rng.integers(0, 14)))
            text = list(base)
            for _ in range(int(rng.integers(0, 4))):
                at = int(rng.integers(0, len(text) + 1))
                text[at : at + int(rng.integers(0, 2))] = [rng.choice(list("abcz"))] * int(rng.integers(0, 2))
            text = "".join(text)
            fits = []
            for number, (term, stem) in enumerate(terms):
                best = min(distance(term, text[:n]) for n in range(len(text) + 1)) if stem else distance(term, text)
                if best <= toxicity.edits_allowed(len(term)):
                    fits.append(best)
            got = lexicon.walk(text)
            assert (got[1] if got else None) == (min(fits) if fits else None), (terms, text)


def test_quotation_is_weaker_than_abuse():
    lexicon = toxicity.FuzzyLexicon([("idiot", False), ("scum", True)])
    of = lambda t: dict(zip(toxicity.FEATURES, toxicity.context_features(toxicity.words_of(t), lexicon, [3.0, 3.0]), strict=True))
    abuse, quoted, said = of("you are an idi0t and scummy"), of("the word “idiot” is rude, and so is “scum”"), of("he said idiot")
    assert abuse["quoted"] == 0 and abuse["addressed"] > 0 and abuse["fuzzy"] > 0 and abuse["kinds"] == pytest.approx(np.log(3))
    assert quoted["quoted"] == 1 and said["quoted"] == 1 and quoted["weight"] < abuse["weight"]
    assert set(of("nothing here").values()) == {0.0}


def test_toxicity_on_held_out_rows(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = toxicity.fit_toxicity(documents, labels.filter(fold != 2).select("doc_id", F.col("toxic").alias("label")), "doc_id", "text")
    score, toxic, predicted = held_out_rows(toxicity.score_toxicity(documents, "doc_id", "text", model, fold == 2), labels, "toxic")
    assert auc(score, toxic) > 0.95 and predicted[toxic].mean() > 0.9 and predicted[~toxic].mean() < 0.01


@pytest.mark.parametrize("fitted", [True, False])
def test_toxicity_of_odd_rows(spark, odd, fitted):
    texts = spark.createDataFrame([(k, "vile stuff here" if k % 2 else "kind words there", k % 2) for k in range(40)], "doc_id long, text string, label int")
    model = toxicity.fit_toxicity(texts, texts.select("doc_id", "label").filter("label = 1" if not fitted else "true"), "doc_id", "text")
    assert (model is not None) == fitted
    got = toxicity.score_toxicity(odd, "doc_id", "text", model, F.lit(True)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(k for k, _, _ in ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert toxicity.score_toxicity(odd.filter("false"), "doc_id", "text", model, F.lit(True)).count() == 0
    if fitted:
        (hit,) = toxicity.score_toxicity(texts.filter("doc_id = 1"), "doc_id", "text", model, F.lit(True)).collect()
        assert hit["predicted"] == 1


def test_rare_and_many_terms_are_kept():
    name = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(3)) + "zz"
    counts = [(name(k), 20, 0) for k in range(400)] + [("raregrub", 12, 0), ("chance", 4, 0), ("common", 900, 1800)]
    terms = {t for t, _, _ in toxicity.choose_terms(counts, 3_000, 6_000, 5_000)}
    assert terms == {name(k) for k in range(400)} | {"raregrub"}
    few = {t for t, _, _ in toxicity.choose_terms([("raregrub", 6, 0), ("chance", 4, 3)], 300, 3_000, 100)}
    assert few == {"raregrub"}


def test_texts_under_one_header_are_all_fitted(spark):
    header = "Message to all members of the list: "
    rows = [(k, header + (f"vile t{k} stuff" if k % 2 else f"kind c{k} words"), k % 2) for k in range(60)]
    rows += [(100 + k, "  \n" + header.upper() + "only  COPIES here", 1) for k in range(30)] + [(200, None, 1), (201, "", 0)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(5)
    model = toxicity.fit_toxicity(texts, texts.select("doc_id", "label"), "doc_id", "text")
    terms = {t for t, _, _ in model.terms}
    assert {"vile", "stuff"} <= terms and not terms & {"only", "copies", "here"}
    assert model == toxicity.fit_toxicity(texts.repartition(3), texts.select("doc_id", "label"), "doc_id", "text")
    few = toxicity.fit_toxicity(texts, texts.select("doc_id", "label"), "doc_id", "text", 20, 20)
    assert {"vile", "stuff"} <= {t for t, _, _ in few.terms}


def test_pseudo_likelihood_is_the_sum_over_windows(spark):
    rows = [(k, t) for k, t in enumerate(["the cat sat, the cat", "The dog; a dog", "", None, "one", "é ü 12 !! the", "cat " * 50])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    classes, net = pseudo.fit_pseudo_likelihood(df, "text", 4)
    words = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for _, t in rows]
    counted = Counter(w for ws in words for w in ws)
    import pyarrow as pa

    of, _ = classes.of(pa.array(sorted(counted)))
    number = dict(zip(sorted(counted), of.tolist(), strict=True))
    assert {w for w, c in number.items() if 1 <= c <= 4} >= {"cat", "the"} and len({c for c in number.values() if 1 <= c <= 4}) == 4
    want = {}
    for (k, _), ws in zip(rows, words, strict=True):
        path = [0, *(number[w] for w in ws), 0]
        want[k] = sum(float(net.log_probabilities(np.array([path[i - 1]]), np.array([path[i + 1]]))[0, path[i]]) for i in range(1, len(path) - 1))
    for r in pseudo.score_texts(df, "doc_id", "text", (classes, net)).collect():
        n = len(words[r["doc_id"]])
        assert r["n_words"] == n and r["log_likelihood"] == pytest.approx(want[r["doc_id"]], rel=1e-4)
        assert (r["per_word"] is None) == (n == 0)


@pytest.mark.parametrize("common", [0, 2, 100])
def test_a_word_counts_itself_and_not_only_its_shape(spark, common):
    rows = [(1, "the cart the card"), (2, "the cart the cart"), (None, "the curt the cart"), (4, ""), (5, None), (5, "the the")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words = pseudo.word_counts(df, "text")
    counted = Counter(w for _, t in rows for w in (t or "").split())
    assert sorted(r["n"] for r in words.collect()) == sorted(counted.values())
    model = pseudo.fit_pseudo_likelihood(df, "text", 1, words)
    plain = {(r["doc_id"], r["n_words"]): r["log_likelihood"] for r in pseudo.score_texts(df, "doc_id", "text", model).collect()}
    got = {(r["doc_id"], r["n_words"]): r["log_likelihood"] for r in pseudo.score_texts(df, "doc_id", "text", model, words, common).collect()}
    shaped = sum(n for w, n in counted.items() if w != "the")
    share = lambda w: np.log(counted[w] / (shaped + 1))
    want = {(k, len((t or "").split())): sum(share(w) for w in (t or "").split() if w != "the") for k, t in rows}
    assert len(got) == len(rows) and got == pytest.approx({k: plain[k] + w for k, w in want.items()}, abs=1e-6)
    assert plain[1, 4] == pytest.approx(plain[2, 4]) and got[1, 4] < got[2, 4]
    new = spark.createDataFrame([(1, "the zzzz")], "doc_id long, text string")
    (unseen,), (bare,) = (pseudo.score_texts(new, "doc_id", "text", model, *w).collect() for w in ((words, common), ()))
    assert unseen["log_likelihood"] == pytest.approx(bare["log_likelihood"] - np.log(shaped + 1), abs=1e-6)


def test_training_beats_single_words(judged):
    documents, _ = judged
    classes = pseudo.frequent_words(documents, "text")
    counts = pseudo.neighbour_counts(documents, "text", classes)
    assert counts.sum() == documents.selectExpr(r"sum(size(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)))").first()[0]
    net = pseudo.train(counts)
    answers = net.table()
    assert np.allclose(np.exp(answers).sum(1), 1, atol=1e-4)
    words = counts.sum((0, 2))
    single = (words * np.log(np.maximum(words, 1) / words.sum())).sum() / words.sum()
    assert (counts * answers).sum() / counts.sum() > single + 0.05


def test_pseudo_likelihood_of_odd_rows(odd):
    model = pseudo.fit_pseudo_likelihood(odd, "text", 5)
    got = pseudo.score_texts(odd, "doc_id", "text", model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(k for k, _, _ in ODD)
    assert all((r["n_words"] == 0) == (r["per_word"] is None) and r["log_likelihood"] <= 0 for r in got)
    nothing = odd.filter("false")
    assert pseudo.score_texts(nothing, "doc_id", "text", pseudo.fit_pseudo_likelihood(nothing, "text")).count() == 0
