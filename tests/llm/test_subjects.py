"""Subjects of made-up commits: held-out accuracy, passing words, texts that tell of nothing."""

import random

import numpy as np
import pytest

from starloom.llm import subjects as su

WORDS = {
    "sport": "goalkeeper offside playoff referee dribbling marathon hurdles stadium wrestler midfielder".split(),
    "law": "verdict bailiff notary statute plaintiff tribunal affidavit easement probate injunction".split(),
    "music": "violin sonata octave lullaby trumpet overture clarinet ballad soprano metronome".split(),
}
COMMON = ["total += 3", "import os", "return value", "width: 3px;", "for item in items:", "name: default"]


def commit(rng, about, lines=4, passing=None):
    words = lambda s: rng.sample(WORDS[s], 2)
    body = [f"Values of the {words(s)[0]} below {rng.randrange(99)} are marked." for s in about for _ in range(2)]
    if passing:
        body.append(f"Someone compared this to a {rng.choice(WORDS[passing])}, which made us laugh.")
    diff = [f"+def check_{words(s)[0]}({words(s)[1]}, limit=3):" for s in about for _ in range(lines)] + ["+" + rng.choice(COMMON) for _ in range(3)]
    rng.shuffle(diff)
    return "commit 0123456789abcdef\nAuthor: Sonata Verdict <a@b>\n\n    tidy up\n\n    " + " ".join(body) + "\n\ndiff --git a/violin.py b/violin.py\n@@ -1 +1 @@ sonata\n import sonata\n" + "\n".join(diff)


def corpus(n, seed=3):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        kind = rng.random()
        if kind < 0.2:
            text, about = rng.choice([None, "", " \n\t", "Merge branch 'main'", "tidy\n\ndiff --git a/x b/x\n-import os\n+import os"]), set()
        else:
            about = set(rng.sample(list(WORDS), 2 if kind > 0.85 else 1))
            text = commit(rng, sorted(about), passing=rng.choice([None, *(s for s in WORDS if s not in about)]))
        docs.append((i, text))
        truth[i] = about or {su.NONE}
    return docs, truth


def run(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' as subject", "1 as terms")
    l = spark.createDataFrame(labels, "doc_id bigint, subject string")
    s = spark.createDataFrame([(x, "") for x in (*WORDS, su.NONE)], "subject string, description string")
    out: dict[int, set] = {}
    for r in su.assign_subjects(d, l, s).collect():
        assert r["subject"] not in out.setdefault(r["doc_id"], set())
        out[r["doc_id"]].add(r["subject"])
    return out


def test_held_out_accuracy(spark):
    docs, truth = corpus(500)
    rng = random.Random(9)
    labels = [(i, s) for i in range(150) for s in truth[i]]
    wrong = {i: rng.choice(list(WORDS)) for i in rng.sample(range(150), 5)}
    labels = [(i, wrong.get(i, s)) for i, s in labels] + [(None, "law"), (3, None), (99999, "law")] + labels[:3]
    got = run(spark, docs, labels)
    assert set(got) == set(truth)
    held = range(150, 500)
    assert sum(got[i] == truth[i] for i in held) / len(held) > 0.95
    assert all(got[i] == {su.NONE} for i, t in docs if not (t or "").strip())


def test_without_labels_or_documents(spark):
    docs, _ = corpus(20)
    assert all(v == {su.NONE} for v in run(spark, docs, []).values())
    assert run(spark, [], [(1, "law")]) == {}


def test_no_subjects_but_none(spark):
    d = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "doc_id bigint, text string")
    out = su.assign_subjects(d, spark.createDataFrame([(1, "law")], "doc_id bigint, subject string"), spark.createDataFrame([(su.NONE,)], "subject string"))
    assert sorted(map(tuple, out.collect()), key=str) == [(1, su.NONE), (2, su.NONE), (None, su.NONE)]


def test_units():
    text = "From abc 2024\nSubject: [PATCH 1/2] first. Second (x.) third\n\n* one\ntwo\n* three\nSigned-off-by: Q\n---\ndiff --git a/p b/p\n--- a/p\n+++ b/p\n@@ -1 @@ h\n context\n+added_line\n-goneLine\n-- \n2.1"
    assert su.units_of(text) == ["first.", "Second (x.)", "third", "* one two", "* three", "added_line", "goneLine"]
    assert su.words_of("fooBar_baz2Qux HTTPServer") == ["foo", "bar", "baz", "qux", "httpserver"]
    assert su.units_of("a\r\n\r\nb") == ["a", "b"]


def test_passing_words_do_not_count():
    model = su.Model(["a", "b"], np.arange(2), np.eye(2, dtype=np.float32), np.eye(2, dtype=np.float32))
    flat = np.array([0, -1, 0, -1, 1, -1, 1, -1, 0, 0, -1, 0, -1, 1, -1, 1, -1])
    got = su.document_subjects(flat, np.array([6, 2, 0, 9]), model)
    assert got.tolist() == [[True, False], [False, True], [False, False], [True, True]]


@pytest.mark.parametrize("shape", [(40, 30), (5, 60)])
def test_svd_is_the_usual_one(shape):
    rng = np.random.default_rng(1)
    dense = rng.random(shape) * (rng.random(shape) < 0.4)
    r, c = np.nonzero(dense)
    v, s = su.truncated_svd(r, c, dense[r, c], shape, 3, rounds=60)
    _, s0, v0 = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(s, s0[:3], rtol=1e-4) and np.allclose(np.abs((v * v0[:3].T).sum(0)), 1, atol=1e-2)


def test_rare_wording_of_a_large_corpus_counts(spark):
    """Six documents of thousands, none of them labelled, hold a wording: too few for any sample."""
    docs, truth = corpus(300)
    rng = random.Random(4)
    rare = [(1000 + i, commit(rng, ["sport"]) + "\n+def keepnet(ball, limit=3):") for i in range(6)]
    filler = [(10_000 + i, "Merge branch 'main'") for i in range(8000)]
    d = spark.createDataFrame([*docs, *rare, *filler], "doc_id bigint, text string")
    l = spark.createDataFrame([(i, s) for i in range(150) for s in truth[i]], "doc_id bigint, subject string")
    model, _ = su.train(d, l, spark.createDataFrame([(x,) for x in WORDS], "subject string"))
    assert su.Terms().of("keepnet")[0] in model.terms


def test_svd_over_the_corpus(spark):
    rng = np.random.default_rng(2)
    lists = [rng.integers(0, 12, rng.integers(0, 9)).tolist() + [-1] for _ in range(60)]
    features = spark.createDataFrame(list(enumerate(lists)), "doc_id bigint, terms array<int>").repartition(3)
    weight = rng.random(12) + 0.5
    v, s, length = su.corpus_svd(features, weight, 60, 4, rounds=30)
    flat, lengths = np.concatenate([np.array(x) for x in lists]), np.array([len(x) for x in lists])
    rows, cols, _, values = su._weighted(flat, lengths, weight)
    dense = np.zeros((60, 12))
    dense[rows, cols] = values
    _, s0, v0 = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(s, s0[:4], rtol=1e-3) and np.allclose(np.abs((v * v0[:4].T).sum(0)), 1, atol=2e-2)
    assert np.allclose(length, np.linalg.norm(dense, axis=0))


def test_more_than_a_thousand_subjects(spark):
    """Every subject counts, however many there are."""
    word = lambda i: "".join(chr(97 + int(c)) for c in f"{i:04d}")
    docs = [(i, f"tidy\n\ndiff --git a/x b/x\n+value of q{word(i % 1200)}q here\n+and q{word(i % 1200)}q again") for i in range(6000)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    l = spark.createDataFrame([(i, f"s{i % 1200}") for i in range(6000)], "doc_id bigint, subject string")
    s = spark.createDataFrame([(f"s{i}", None) for i in range(1200)], "subject string, description string")
    model, _ = su.train(d, l, s)
    assert len(model.subjects) == 1200 and model.centroids.any(1)[:1200].all()


def test_subjects_without_labels_start_from_their_description(spark):
    docs, truth = corpus(400)
    labels = [(i, s) for i in range(200) for s in truth[i] if "music" not in truth[i]]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    l = spark.createDataFrame(labels, "doc_id bigint, subject string")
    s = spark.createDataFrame([("law", None), ("sport", ""), ("music", " ".join(WORDS["music"]))], "subject string, description string")
    model, _ = su.train(d, l, s)
    assert model.subjects == ["law", "music", "sport"]
    music = [x for x in WORDS["music"] if su.Terms().of(x)[0] in model.terms]
    assert bool(music) == bool(model.centroids[1].any())
