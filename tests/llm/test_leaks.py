"""Leaks against brute force; re-worded leaks by template."""

import random
import re

from starloom.llm import leaks as lk

PASSAGE = "On day 21 the equity stood 65 steps behind the gentle hedge ratio, which Clemoto called narrow and gentle. Later Clemoto wrote to Halrofaton about it."
OTHER = "Nobody in Storaltadorf expected the silent tax to wander before the fund had been named by Quiltussa and 12 of the others."


def tables(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item_id", "2 as n_exact")
    return d, spark.createDataFrame(items, "item_id bigint, passage string").selectExpr("*", "'p' as prompt", "3 as doc_id")


def brute(docs, items):
    def grams(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    return sorted((d, i) for d, t in docs for i, p in items if grams(t) & grams(p))


ITEMS = [(1, PASSAGE), (2, OTHER), (3, None), (4, "too short"), (5, PASSAGE), (6, "")]


def test_exact_leaks(spark):
    rng = random.Random(2)
    noise = lambda n: " ".join(rng.choice(["the", "of", "stood", "21", "day", "x_y", "Clemoto"]) for _ in range(n))
    words = PASSAGE.split()
    docs = [(0, None), (1, ""), (2, "  \n"), (3, PASSAGE.upper()), (4, "\n+".join(words[:14])), (5, " ".join(words[:11])), (6, " * ".join(words[3:20]))]
    docs += [(7, noise(3000) + " " + OTHER + noise(3000)), (8, PASSAGE + OTHER), (9, " ".join(words[:8] + ["odd"] + words[8:])), (3, PASSAGE)]
    docs += [(100 + i, noise(40) + " " + " ".join(words[i : i + rng.randrange(9, 16)]) + " " + noise(20)) for i in range(20)]
    d, i = tables(spark, docs, ITEMS)
    want = brute(docs, ITEMS)
    assert (3, 5) in want and (5, 1) not in want
    for find in (lk.document_matches, lk.document_matches_shuffled):
        assert sorted(set(map(tuple, lk.shared_passages(find(d, i)).collect()))) == sorted(set(want))


def test_templates_and_slots(spark):
    renamed = PASSAGE.replace("21", "34").replace("65", "7").replace("Clemoto", "Halrofaton_").replace("Halrofaton.", "Clemoto.").replace("_", "")
    renamed = renamed.replace("to Halrofaton about", "to Clemoto about")
    broken = PASSAGE.replace("21", "34").replace("which Clemoto", "which Halrofaton")
    docs = [(1, renamed), (2, broken), (3, PASSAGE), (4, PASSAGE.replace("gentle hedge", "rough hedge").replace("narrow and gentle", "rough"))]
    d, i = tables(spark, docs, [(1, PASSAGE)])
    for find in (lk.document_matches, lk.document_matches_shuffled):
        m = {r["doc_id"]: r for r in find(d, i).collect()}
        assert m[1]["n_exact"] == 0 and m[1]["consistent"] and m[3]["n_exact"] == m[3]["n_template"]
        assert not m[2]["consistent"]
        kinds = {r["doc_id"]: r["kind"] for r in lk.template_leaks(find(d, i)).collect()}
        assert kinds[1] == "re-parameterised" and kinds[3] == "exact"


def test_names_and_tokens():
    names = lk.names_of([PASSAGE, OTHER])
    assert {"clemoto", "halrofaton", "storaltadorf", "quiltussa"} <= names and not names & {"on", "later", "the", "nobody"}
    t = lk.Templates(names)
    assert t.token("65") == t.token("7") == "\0number" and t.token("evenings") == "\0unit" and t.token("the") == "the"


def test_names_that_no_item_uses(spark):
    other = PASSAGE.replace("Clemoto", "Xandor").replace("Halrofaton", "Quibble").replace("21", "9")
    d, i = tables(spark, [(1, other), (2, other.lower())], [(1, PASSAGE)])
    for find in (lk.document_matches, lk.document_matches_shuffled):
        m = {r["doc_id"]: r for r in find(d, i).collect()}
        assert m[1]["consistent"] and m[1]["n_template"] > m[2]["n_template"]


def test_no_items_no_documents(spark):
    d, i = tables(spark, [(1, PASSAGE)], ITEMS)
    assert lk.document_matches(d, i.limit(0)).count() == 0 and lk.document_matches(d.limit(0), i).count() == 0
    assert lk.document_matches_shuffled(d.limit(0), i).count() == 0


def test_large_item_sets_go_through_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(lk, "BROADCAST_WINDOWS", 100)
    d, i = tables(spark, [(1, PASSAGE)], ITEMS)
    assert {r["item_id"] for r in lk.shared_passages(lk.document_matches(d, i)).collect()} == {1, 5}


def test_an_item_held_twice_with_other_numbers(spark):
    """Old and new line of a diff, each filled consistently, but not alike."""
    twice = "-" + PASSAGE.replace("21", "34") + "\n+" + PASSAGE.replace("21", "35")
    neither = "-" + PASSAGE.replace("Later Clemoto", "Later Xandor") + "\n+" + PASSAGE.replace("which Clemoto", "which Quibble")
    neither = neither.replace("21", "34").replace("65", "7").replace("Halrofaton", "Zemlor")
    d, i = tables(spark, [(1, twice), (2, neither)], [(1, PASSAGE.replace("65", "64"))])
    for find in (lk.document_matches, lk.document_matches_shuffled):
        m = {r["doc_id"]: r for r in find(d, i).collect()}
        assert m[1]["consistent"] and not m[2]["consistent"]


# --- planted copies of the tables' own items ----------------------------------------------------

NEW_NAMES = "Xandor Quibble Zemlor Thrapston Vexley Morwenna Ballantyr Osgood Pellwick Grantham".split()
FILLERS = "merge sort of the queue was slow before this change and nobody had looked at it for a while because the tests were green anyway".split()


def reworded(rng, passage, names, double=False):
    """Other numbers and names, the same for the same."""
    fill = {}

    def other(m):
        w = m[0]
        low = w.lower()
        if low.isnumeric():
            return fill.setdefault(low, str(rng.randrange(2, 990)))
        if low in names and w[0].isupper():
            new = " ".join(rng.sample(NEW_NAMES, 2)) if double else rng.choice(NEW_NAMES)
            return fill.setdefault(low, new)
        return w

    return re.sub(r"[^\W_]+", other, passage)


def planted(spark, folder, seed=5):
    items = [(r["item_id"], r["passage"]) for r in spark.read.parquet(f"{folder}/eval_items.parquet").collect()]
    prose = [(i, p) for i, p in items if not p.startswith("def ") and sum(c.isdigit() for c in p) > 3]
    names = lk.names_of([p for _, p in items])
    rng = random.Random(seed)
    docs, truth = [], {}

    def add(kind, item, text):
        noise = lambda: " ".join(rng.sample(FILLERS, 14))
        docs.append((len(docs), f"{noise()}\n{text}\n{noise()}"))
        truth[len(docs) - 1] = (kind, item)

    for i, p in rng.sample(prose, 60):
        new = lambda **k: reworded(rng, p, names, **k)
        add("once", i, new())
        add("twice", i, new() + "\n" + new())
        add("diff", i, "-" + new() + "\n+" + new())
        add("upper", i, new().upper())
        add("double names", i, new(double=True))
        add("wrapped", i, "\n".join(" * " + " ".join(w) for w in (lambda x: [x[a : a + 7] for a in range(0, len(x), 7)])(new().split())))
    # no leaks: the words between the slots are other ones, in every dozen
    for i, p in rng.sample(prose, 60):
        words = reworded(rng, p, names).split()
        for a in range(0, len(words), 9):
            words[a] = rng.choice(["heuristic", "lattice", "marmalade", "tangent", "oboe"])
        add("none", None, " ".join(words))
    # no leaks: what is one value in the item is another one at each place
    for i, p in rng.sample(prose, 60):
        low = [w.lower() for w in lk.words_of(p)]
        if len({w for w in low if low.count(w) > 1 and (w.isnumeric() or w in names)}) > 0:
            rest = iter(range(1000, 9999))
            text = re.sub(r"[^\W_]+", lambda m: str(next(rest)) if m[0].isnumeric() else f"Name{next(rest)}x" if m[0].lower() in names and m[0][0].isupper() else m[0], p)
            add("inconsistent", i, text)
    return docs, truth, items


def test_recall_and_precision_of_reworded_copies(spark, small):
    docs, truth, items = planted(spark, small)
    passages = dict(items)
    d, i = tables(spark, docs, items)
    found = {}
    for r in lk.template_leaks(lk.document_matches(d, i)).collect():
        found.setdefault(r["doc_id"], set()).add(r["item_id"])
    kinds = {}
    for doc, (kind, item) in truth.items():
        if kind not in ("none", "inconsistent"):
            hit, n = kinds.setdefault(kind, [0, 0])
            kinds[kind] = [hit + (item in found.get(doc, ())), n + 1]
    assert {k: n for k, (_, n) in kinds.items()} == dict.fromkeys(["once", "twice", "diff", "upper", "double names", "wrapped"], 60)
    assert all(hit / n >= 0.9 for hit, n in kinds.values()), kinds

    def right(doc, item):
        """Items may share a paragraph: then a copy of one is a copy of the other's."""
        kind, planted_item = truth[doc]
        if kind == "none":
            return False
        if kind == "inconsistent":
            return None
        mine, theirs = (set(re.split(r"(?<=[.])\s", passages[x])) for x in (planted_item, item))
        return item == planted_item or bool(mine & theirs)

    judged = [right(d, x) for d, xs in found.items() for x in xs]
    judged = [x for x in judged if x is not None]
    assert sum(judged) / len(judged) >= 0.9


def test_both_paths_give_the_same_rows(spark, small, monkeypatch):
    docs, _, items = planted(spark, small, 6)
    more = [(r["doc_id"] + 10_000, r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    d, i = tables(spark, [*docs, *more, (90_000, None), (90_001, ""), (90_002, "7 " * 300)], [*items, (-1, None), (-2, "8 7 " * 40), (-3, "7 " * 30)])
    want = sorted(map(tuple, lk.document_matches(d, i).collect()))
    assert any(x[0] == 90_002 and x[1] == -3 and x[2] for x in want) and not any(x[0] == 90_002 and x[1] == -2 for x in want)
    assert sorted(map(tuple, lk.document_matches_shuffled(d, i).collect())) == want
    exact = sorted({(x[0], x[1]) for x in want if x[2]})
    for find in (lk.document_matches, lk.document_matches_shuffled):
        assert sorted(map(tuple, lk.shared_passages(find(d, i, reworded=False)).collect())) == exact
    monkeypatch.setattr(lk, "BROADCAST_WORDS", 10)  # names are names, however many words the items have
    assert sorted(map(tuple, lk.document_matches_shuffled(d, i).collect())) == want


def test_rows_of_numbers_are_quick():
    items = [(i, " ".join(str(x) for x in range(i, i + 60))) for i in range(50)]
    side, rng = lk.ItemWindows(items), random.Random(1)
    row = [str(rng.randrange(10**6)) for _ in range(20_000)]
    assert list(side.compare(row)) == []
    assert [m[0] for m in side.compare([str(x) for x in range(60)])] and next(side.compare([str(x) for x in range(12)]))[1] == 1
