"""Quality and toxicity: held-out accuracy, restoration, edge cases."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from panelloom.llm import quality, toxicity
from panelloom.llm.common import read
from tests.llm.conftest import LARGER, LARGEST, ODD


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable")) + 1.0
    for s in np.unique(scores):
        same = scores == s
        order[same] = order[same].mean()
    pos = labels == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def held_out_results(frame, labels, column):
    rows = frame.where("held_out").join(labels, "doc_id").select("score", "predicted", column).collect()
    return np.array([[float(v) for v in r] for r in rows]).T


def test_quality_on_held_out_rows(spark):
    scored = quality.op3_quality(spark, LARGER)
    assert scored.count() == 1000
    score, predicted, label = held_out_results(scored, read(spark, LARGER, "labels"), "quality")
    assert auc(score, label) > 0.95
    assert (predicted == label).mean() > 0.92


def test_quality_of_odd_rows(spark, docs_of):
    docs = docs_of(ODD)
    labels = spark.createDataFrame([(4, 1), (5, 1), (5, None), (8, 0)], "doc_id bigint, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    none = quality.score_quality(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert quality.score_quality(docs_of([]), labels).collect() == []


def test_quality_ignores_held_out_labels(spark, docs_of):
    docs = docs_of([(i, f"text number {i}") for i in range(30)])
    from panelloom.llm.common import held_out

    kept = spark.range(30).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "1 AS quality")
    fewer = kept.where(~held_out())
    a, b = (sorted(map(tuple, quality.score_quality(docs, x).collect())) for x in (kept, fewer))
    assert a == b


def test_toxicity_on_held_out_rows(spark):
    """On sf0.1: of the six held-out toxic texts of sf0.01, two hold no toxic word."""
    scored = toxicity.op8_toxicity(spark, LARGEST)
    assert scored.count() == 10_000
    score, predicted, label = held_out_results(scored, read(spark, LARGEST, "labels"), "toxic")
    assert auc(score, label) > 0.9
    assert predicted[label == 0].mean() < 0.02
    assert predicted[label == 1].mean() > 0.75


@pytest.fixture(scope="module")
def scorer(spark):
    docs, labels = read(spark, LARGER, "documents"), read(spark, LARGER, "labels")
    return toxicity.Scorer(toxicity.learn(docs, labels), toxicity.language_model(docs))


@pytest.mark.parametrize(
    "written",
    ["idiot", "IDIOT!", "1d1ot", "id10t", "!d!0t", "iddiiioot", "idiooooot", "i d i o t", "i.d.i.o.t", "i-d-i-o-t",
     "l0ser", "m0r0n", "$tup1d", "w0rthle$$", "dísgusting", "p@thetic", "ID1OT,", "i d i o t!"],
)
def test_obfuscated_words_are_found(scorer, written):
    assert scorer.score(f"Is and retitioning of the {written} it and the on".encode()) >= 0.5


@pytest.mark.parametrize(
    "written",
    ["(idiot)", "@moron", "you,idiot", "stupid-idiot", "idiot/moron", "you...idiot", "“idiot”", "idiot…", "—moron—", "(1d1ot)",
     "i  d  i  o  t", "i\nd\ni\no\nt", "i\r\nd\r\ni\r\no\r\nt", "id iot", "mo ron", "m0 r0n", "hi idiot the", "\"!d!0t!\"", "you,i.d.i.o.t",
     "idiot\u00a0", "🙂moron🙂"],
)
def test_words_behind_marks_and_in_pieces_are_found(scorer, written):
    assert scorer.score(f"Is and retitioning of the {written} it and the on".encode()) >= 0.5


def test_decoding_finds_the_best_of_all_paths(scorer):
    """Against an enumeration of every path through the lattice."""
    table = toxicity._symbols()

    def value(letters, channel):
        x, y, score = 0, 0, channel
        for c in letters + " ":
            z = int(table[min(ord(c), 0x100)])
            score += float(scorer.model[x, y, z])
            x, y = y, z
        return score

    for written in ["1d1ot", "l0$er", "w0rthle$$", "m0 r0n", "(b@d)", "é1!", "aa88", "6|t", "", "-"]:
        paths = itertools.product(*toxicity.lattice(written))
        best = max(value("".join(t for t, _ in path), sum(p for _, p in path)) for path in paths)
        got = toxicity.decode(written, scorer.model)
        ends = [value(got + " " * n, p) for n in (0, 1) for p in {sum(c for _, c in path) for path in itertools.product(*toxicity.lattice(written)) if "".join(t for t, _ in path) == got + " " * n}]
        assert max(ends) == pytest.approx(best, abs=1e-3)


def test_every_feature_names_itself(scorer):
    words = [f for f in scorer.weights if f and not f.endswith("~")]
    assert len(words) >= 5
    for f in words:
        assert f in scorer._named(f) and toxicity.admits(f, f)
        assert f in scorer._named("".join(c * 3 for c in f))
    assert not toxicity.admits("as", "ass") and toxicity.admits("a$$", "ass") and toxicity.admits("wörthles$", "worthl~")


def test_rare_words_are_features_too(spark, docs_of):
    """No cap and no least share: significance alone decides."""
    rng = random.Random(6)
    plain = lambda: " ".join("".join(rng.choice("aeioukt") for _ in range(4)) for _ in range(12))
    toxic = range(0, 9000, 10)
    rows = [(i, f"{plain()} {f'zork quib{i // 80}' if i in toxic else ''}") for i in range(9000)]
    labels = spark.createDataFrame([(i, int(i in toxic)) for i, _ in rows], "doc_id bigint, toxic int")
    weights = toxicity.learn(docs_of(rows), labels)
    learnt = Counter(i // 80 for i in toxic if zlib.crc32(str(i).encode()) % 5)
    expected = {f"quib{k}" for k, n in learnt.items() if n >= toxicity.LEAST_DOCS}
    assert len(expected) > 90 and min(n for n in learnt.values() if n >= 5) < 0.01 * sum(learnt.values())
    assert expected <= set(weights) and "zork" in weights


def test_toxicity_of_empty_tables_and_odd_stages(spark, docs_of, tmp_path):
    spark.createDataFrame([(4, 0), (5, 1), (None, 1), (9, None)], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert toxicity.stage(spark, docs_of([]), str(tmp_path)).collect() == []
    kept = toxicity.stage(spark, docs_of(ODD), str(tmp_path))
    assert kept.count() == len(ODD) and kept.columns == docs_of(ODD).columns
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert toxicity.op8_toxicity(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("text", ["avoid iota and hello serve", "video, is it", "the idiom-of moronic (idiotx)", "a (b) c|d", "!" * 50_000])
def test_clean_pieces_are_left_alone(scorer, text):
    assert scorer.score(text.encode()) < 0.5


@pytest.mark.parametrize(
    "text",
    ["", "Is and retitioning ouen the of", "call +49 (151) 555-0100 or 192.168.0.1", "a b c d e f g", "ä ä ä ä ä",
     "ldlot ltlo", "password=a9ce335683f9772ddc", "4111111111111111", "the idiom of moronic", "a$$$ thtion$$$ of%%%"],
)
def test_clean_texts_are_left_alone(scorer, text):
    assert scorer.score(text.encode()) < 0.5


def test_toxicity_of_odd_rows(spark, docs_of):
    docs = docs_of(ODD + [(20, "you idiot")])
    labels = spark.createDataFrame([(1, 0), (20, None)], "doc_id bigint, toxic int")
    weights = toxicity.learn(docs, labels)
    assert list(weights) == [""] and -0.7 < weights[""] < 0
    table = toxicity.language_model(docs)
    assert np.allclose(np.exp(table).sum(axis=2), 1, atol=1e-3)
    assert np.isfinite(toxicity.language_model(docs_of([]))).all()


def test_toxic_stage_keeps_columns(spark):
    docs = read(spark, LARGER, "documents").selectExpr("*", "doc_id AS score", "text AS features")
    kept = toxicity.stage(spark, docs, LARGER)
    assert kept.columns == docs.columns
    rejected = toxicity.op8_toxicity(spark, LARGER).where("predicted = 1").count()
    assert kept.count() == 1000 - rejected and rejected > 50
