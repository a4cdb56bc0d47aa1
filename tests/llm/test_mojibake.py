"""Wrong encodings: every chain planted in clean text, decoys, and what can't be restored."""

import pyarrow.parquet as pq
import pytest

from ribospark.llm import mojibake as mj

SCHEMA = "doc_id bigint, text string, lang string, n_lost string, chains string"
DECOYS = [
    "Ville de PÂTIS-LÈS-GRÈVES", "marked «Груз № 17».", "契約書 (exhibit 12)", "in Greek: «Ἀπόφασις» and “νόμος”.", "the seal 🏛 on page 2",
    "│ item │ sum │\n├──────┼─────┤\n│ 1 │ 40 │", "kept at 4 °C ± 1, ½ full, at 3 µm.", "Â is the mark; Ã that of its rival", "the ██ was ████ [redacted]",
    "naïve, café, Zoë", "ﬁnal ﬁgure", "plain ascii", "Maß“ und Spaß”", "«l’été à l’œuvre»",
]


@pytest.fixture(scope="module")
def clean():
    memo = {}
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    return [t for t in texts if t and not t.isascii() and mj.is_clean(t, memo)]


@pytest.fixture(scope="module")
def model(spark, clean):
    return mj.train(frame(spark, [*clean, *DECOYS * 5]))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], SCHEMA)


def found(spark, texts, model=None):
    return {r.doc_id: r for r in mj.garbled_documents(frame(spark, texts), model).collect()}


@pytest.mark.parametrize("codec", mj.MISREAD_UTF8)
def test_misread_utf8_is_restored(spark, clean, model, codec):
    texts = clean[::11][:40]
    got = found(spark, [mj.garble(t, codec) for t in texts], model)
    assert set(got) == set(range(len(texts)))
    right = sum(got[i].restored_text == t for i, t in enumerate(texts))
    assert right >= 0.9 * len(texts)


def test_twice_garbled_and_single_byte(spark, clean, model):
    texts = clean[::13][:30]
    twice = found(spark, [mj.garble(mj.garble(t, "cp1252"), "cp1252") for t in texts], model)
    assert sum(twice[i].restored_text == t for i, t in enumerate(texts)) >= 27
    single = found(spark, [mj.garble(t, "cp1251", "cp1252") for t in texts], model)
    assert len(single) == len(texts)


def test_held_out_clean_text_and_decoys(spark, clean, model):
    assert found(spark, [*clean, *DECOYS], model) == {}


def test_lost_characters(spark, clean, model):
    got = found(spark, ["caf� au lait", "a � b", "é"], model)
    assert {i: (r.n_garbled, r.n_lost, r.restored_text) for i, r in got.items()} == {0: (1, 1, "caf� au lait"), 1: (1, 1, "a � b")}


def test_one_garbled_place_in_a_text(spark, clean, model):
    texts = [t.replace("é", mj.garble("é", "cp1252"), 1) for t in clean[:60] if "é" in t]
    got = found(spark, texts, model)
    assert len(got) == len(texts) and all(r.n_garbled == 1 for r in got.values())


def test_nulls_empty_and_long(spark, model):
    texts = [None, "", "  ", "x" * 100_000, mj.garble("Señor Müller ", "cp1252") * 20_000]
    assert set(found(spark, texts, model)) == {4}
    assert mj.garbled_documents(frame(spark, ["a"]).limit(0)).count() == 0
    assert mj.garbled_documents(frame(spark, [None, ""])).count() == 0


def test_every_clean_context_counts(spark, clean):
    # contexts that rewriting makes likelier, behind more rows than a sample of the first ones would hold
    plain = ["All is well in the “old” court, said the judge."] * 1_500
    odd = ["costs á la carte"]
    texts = [*plain, *odd]
    model = mj.train(frame(spark, texts).coalesce(1))
    contexts = {"".join(mj._context(t, m.start(), m.end())) for t in texts for m in mj._RUN.finditer(t)}
    assert model.margins == mj.validated_margins(*mj.context_gains(model, contexts))
    assert model.margins != mj.validated_margins(*mj.context_gains(model, [c for c in contexts if "á" not in c]))
    assert model.margins == mj.train(frame(spark, texts[::-1]).repartition(5)).margins


def test_garbled_marks_are_not_clean(spark, clean):
    texts = [mj.garble("the ██ was", c) for c in mj.MISREAD_UTF8]
    assert not any(mj.is_clean(t, {}) for t in texts) and mj.is_clean("the ██ was", {})


def test_a_model_holds_so_many_triples(spark):
    rows = spark.createDataFrame([(3, i, "", 2 + i) for i in range(100)] + [(3, 100 + i, "", 1) for i in range(50)], "n int, code bigint, context string, count bigint")
    assert mj.least_count(rows) == 2
    least = mj.least_count(rows, 60)
    assert least == 64 and rows.where(f"count >= {least}").count() <= 60
