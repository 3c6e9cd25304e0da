import base64
import random

import numpy as np
import pytest

from florilege.llm import mail, reading, tokens
from florilege.llm.boosting import Boosted, Settings, calibrate

OWN = "The field kept the seed. We saw the old map on the shelf by the door, and then she read the row."
QUOTE = "> The heterogeneous classification problematised everything.\n> More of it.\n"
HEAD = "From: a@b.example\nSubject: x\nContent-Type: text/plain; charset=utf-8\n"
B64 = base64.b64encode((OWN + "\n").encode()).decode()
MAILS = [
    f"{HEAD}\n{OWN}\n", f"{HEAD}\nHello all,\n\n{OWN}\n\nBest wishes\nAnn\n-- \nAnn Example\nPhone: 5\n", f"{HEAD}\nOn Monday Bob wrote:\n\n{QUOTE}\n{OWN}\n", f"{HEAD}\n{OWN}\n\n-----Original Message-----\nFrom: Bob\nSubject: x\n\nThe classification.\n",
    f"{HEAD}\n-----Original Message-----\nFrom: Bob\n\nThe classification.\n\nMore.\n\n\n{OWN}\n", f"{HEAD}Content-Transfer-Encoding: base64\n\n{B64}\n",
    f"From: a\nContent-Type: multipart/alternative;\n boundary=\"q\"\n\n--q\nContent-Type: text/plain\n\n{OWN}\n--q\nContent-Type: text/html\n\n<p>no</p>\n--q--\n",
    f"From: a\nContent-Type: text/html\n\n<html><head><style>p{{}}</style></head><body><p>{OWN}</p>\n<p>&gt; quoted words</p></body></html>\n",
    f"From: a\nContent-Type: multipart/mixed; boundary=q\n\n--q\nContent-Type: application/pdf\nContent-Transfer-Encoding: base64\n\nAAAA\n--q\nContent-Type: text/plain\n\n{OWN}\n",
]


@pytest.mark.parametrize("text", MAILS)
def test_own_text(text):
    assert " ".join(mail.own_text(text)).split() == OWN.split()


NOTICE = "NOTA BENE: nothing in this message is binding, and whoever got it by mistake is asked to say so."
#: A quotation that holds an attached message's line; an attached one that ends with a quotation; a greeting below a quotation;
#: a heading before the text; an announcement in words of no list.
CHAINS = [
    f"{HEAD}\nBob wrote:\n\n> Yes.\n>\n> -----Original Message-----\n> From: Ann\n>\n> More.\n\n{OWN}\n\nCheers\nAnn\n", f"{HEAD}\n-----Ursprüngliche Nachricht-----\nVon: Bob\n\nDie Karte.\n\n>> Das Blatt.\n>> Die Tafel.\n\n{OWN}\n",
    f"{HEAD}\nAm 1.2. schrieb Bob:\n\n| Die Karte.\n\nHallo Ann,\n\n{OWN}\n", f"{HEAD}\nGreetings all,\n\n{OWN}\n\nHasta luego\nAnn\n", f"{HEAD}\n{OWN}\n\n--- Oorspronkelijk bericht ---\nVan: Bob\n\nHet blad.\n",
]


@pytest.mark.parametrize("text", CHAINS)
def test_chains(text):
    assert " ".join(mail.own_text(text)).split() == OWN.split()


def documents(spark, texts):
    return spark.createDataFrame([(i, None if i % 3 else "s", f"{HEAD}\n{t}\n", 1.0) for i, t in enumerate(texts)], "doc_id long, source string, text string, x double")


def test_one_line_messages_have_no_level(spark):
    two = "We saw the old map on the shelf\nand we read it."
    one = "We saw the old map on the shelf by the door and then we read it in the sun."
    assert len(two.split()) == 12 and len(one.split()) >= 18
    got = {r["doc_id"]: r["x"] for r in reading.features(documents(spark, [two, one, "", "Yes."])).collect()}
    assert got[0] is not None and got[1] is None and got[2] is None and got[3] is None


def test_repeated_notices_are_not_the_senders(spark):
    words = [f"The {a} kept the {b} seed, and we\nsaw it." for a in ("red", "old", "dry", "wet") for b in ("long", "short", "good")]
    want = {i: reading.measure([w.replace("\n", " ")]) for i, w in enumerate(words)}
    df = documents(spark, [f"{w}\n\n{NOTICE}" for w in words])
    for most in (reading.MOST_NOTICES, 0):  # broadcast, and joined
        got = {r["doc_id"]: r["x"] for r in reading.features(df, most).collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[i], want[i], atol=1e-4) for i in want)
    few = reading.features(df.limit(4)).collect()
    assert all(r["n_words"] > len(words[0].split()) for r in few)


@pytest.mark.parametrize("text", [None, "", "\n\n", "no header at all", "Content-Type: multipart/mixed\n\nx", "Content-Type: multipart/mixed; boundary=\"\"\n\nx", "Content-Transfer-Encoding: base64\n\n!!!", "a: b\n\n" + "<" * 100_000, "a: b\n\n" + "x" * 1_000_000, "a: b\n\n" + "> " * 200_000])
def test_odd_messages(text):
    out = mail.own_text(text)
    assert isinstance(out, list)
    assert reading.measure(out) is None or len(reading.measure(out)) == len(reading.FEATURES)


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = np.clip(np.round(3 + x[:, 0] + (x[:, 1] > 0)), 1, 5)
    model = Boosted(Settings(trees=80)).fit(x[:400], y[:400])
    score = model.predict(x[400:])
    assert np.abs(score - y[400:]).mean() < 0.45
    cuts = calibrate(score, y[400:])
    assert (cuts.grade(score) == y[400:]).mean() > 0.75 and (np.diff(cuts.cuts) >= 0).all()
    assert Boosted().fit(x[:0], y[:0]).predict(x[:3]).tolist() == [0.0] * 3
    assert calibrate(np.array([1.0]), np.array([2])).grade(np.array([9.0])).tolist() == [2]


EASY, HARD = ["the", "cat", "sat", "on", "a", "mat", "red", "dog", "ran"], ["notwithstanding", "classification", "institutional", "heterogeneity", "interoperability", "of", "the", "nomenclatural"]


def corpus(n=160):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        level = 1 + i % 5
        words = lambda k: " ".join(rng.choice(HARD if rng.random() < (level - 1) / 4 else EASY) for _ in range(k))
        docs.append((i, f"s{i % 4}" if i % 7 else None, "A: b\n\n" + " ".join(words(4 + 4 * level) + "." for _ in range(5)), "clash"))
        if i % 2:
            labels.append((i, level))
    return docs + [(900, "s0", "A: b\n\nThanks, got it.", ""), (901, None, None, ""), (902, "s1", "", ""), (903, "s1", docs[0][2], "")], labels


def test_grades(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs, "doc_id long, source string, text string, level string")
    l = spark.createDataFrame([*labels, labels[0], (None, 1), (5000, 2)], "doc_id long, level int")
    measured = reading.features(d)
    rows = reading.training_rows(measured, l)
    assert len(rows) == len(labels)
    fold = reading.fold_of(rows["source"])
    assert rows.assign(f=fold, s=rows["source"].fillna("")).groupby("s")["f"].nunique().max() == 1
    model, calibration, _ = reading.train(rows, Settings(trees=40))
    got = {r["doc_id"]: r["level"] for r in reading.grade(measured, model, calibration).collect()}
    assert got[900] is None and got[901] is None and got[902] is None and got[903] == got[0]
    off = [abs(got[i] - (1 + i % 5)) for i in range(160)]
    assert sum(o == 0 for o in off) > 0.8 * len(off) and max(off) <= 1
    assert len(reading.training_rows(measured, l, most_labels=7)) == 7


def test_validation_knows_nothing_of_the_held_out_sources(spark, monkeypatch):
    docs, labels = corpus(80)
    d = spark.createDataFrame(docs, "doc_id long, source string, text string, level string")
    rows = reading.training_rows(reading.features(d), spark.createDataFrame(labels, "doc_id long, level int"))
    seen, fit = [], Boosted.fit
    monkeypatch.setattr(reading, "cross_validate", lambda rows, settings: seen.append(set(rows["source"].fillna(""))) or np.linspace(1, 5, len(rows)))
    grades = reading.validate(rows, Settings(trees=5))
    assert len(grades) == len(rows) and Boosted.fit is fit
    part, sources = reading.fold_of(rows["source"]), rows["source"].fillna("")
    assert seen == [set(sources[part != k]) for k in np.unique(part)]


def test_no_labels_and_no_documents(spark):
    d = spark.createDataFrame(corpus(10)[0], "doc_id long, source string, text string, level string")
    none = spark.createDataFrame([], "doc_id long, level int")
    assert all(r["level"] is None for r in reading.levels(d, none).collect())
    assert reading.levels(d.where("false"), none).collect() == []


def test_tokens(spark):
    encoding = tokens.load(tokens.TOKENIZER)
    texts = [None, "", "The field kept the seed.", "é" * 50, "<|endoftext|>", "a" * 200_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.sized(df, ["doc_id"]).collect()}
    assert got[0] == got[1] == 0 and got[2] == 6
    for i in (2, 3, 4, 5):
        ids = encoding.encode_ordinary(texts[i])
        assert got[i] == len(ids) and encoding.decode(ids) == texts[i]


def test_stretches_do_not_change_the_count():
    encoding = tokens.load(tokens.TOKENIZER)
    text = "".join(f"The {i}th line of it, nothing more.\n" + "\n" * (i % 3) for i in range(300))
    for size in (40, 100, 1000):
        pieces = tokens.stretches(text, size)
        assert "".join(pieces) == text and max(map(len, pieces)) <= size
        assert sum(len(encoding.encode_ordinary(p)) for p in pieces) == len(encoding.encode_ordinary(text))
    assert "".join(tokens.stretches("x" * 95, 10)) == "x" * 95
