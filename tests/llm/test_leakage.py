"""Evaluation leaks: planted passages with edits, decoys, and a search of every window by brute force."""

import random
import unicodedata

import numpy as np
import pytest

from ribospark.llm import leakage
from ribospark.llm.leakage import Index, Leak, align, holds_run, rare_seeds, words

DOC = "doc_id bigint, text string, item_id string, item_text string"
ITEM = "item_id bigint, item_text string, doc_id string, text string"
VOCABULARY = [a + b for a in ("ka", "lo", "mi", "ru", "te", "zo") for b in ("ban", "dor", "fel", "gim", "hut", "jas", "kel")]


def text(rnd, n):
    return [rnd.choice(VOCABULARY) for _ in range(n)]


def edited(rnd, ws, edits):
    ws = list(ws)
    for k in rnd.sample(range(1, len(ws) - 1), edits):
        ws[k] = rnd.choice(["changed", None, ws[k] + " added"])
    return [w for w in ws if w]


@pytest.fixture(scope="module")
def items():
    rnd = random.Random(5)
    shared = text(rnd, 9)
    return {i: [*shared, *text(rnd, 40)] for i in range(30)}


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(docs)], DOC)
    e = spark.createDataFrame([(i, " ".join(t) if t else t, "", "") for i, t in items.items()], ITEM)
    return sorted((r.doc_id, r.item_id) for r in leakage.leaked(d, e).collect())


def test_planted(spark, items):
    rnd = random.Random(7)
    docs, expected = [], []
    for k in range(120):
        item, n = k % 30, rnd.choice([15, 16, 24, 32])
        at = rnd.randint(0, 49 - n)
        passage = edited(rnd, items[item][at : at + n], rnd.randint(0, n // 8))
        docs.append(" ".join([*text(rnd, rnd.randint(0, 200)), *passage, *text(rnd, 60)]))
        expected.append((k, item))
    assert set(expected) <= set(found(spark, docs, items))


def test_decoys(spark, items):
    rnd = random.Random(9)
    docs = [" ".join([*text(rnd, 50), *items[i][12:20], "and so it ends here with other words", *text(rnd, 50)]) for i in range(20)]
    shuffled = [rnd.sample(items[i], len(items[i])) for i in range(20)]
    docs += [" ".join([*text(rnd, 50), *s]) for s in shuffled]
    assert found(spark, [*docs, None, "", "  ", "\n"], items) == []


def test_spelling_that_does_not_count(spark):
    item = "Later seventy-two drovers from Thäldott swear they forgot no canoe, only a salted kite and fifty coins remained"
    forms = [
        item.upper(),
        unicodedata.normalize("NFD", item),
        item.replace(" ", "\n\t "),
        item.replace(",", " — ;"),
        item.replace("drovers", "dro-\nvers").replace("forgot", "for­got").replace("coins", "co​ins"),
        item.replace("seventy-two", "seventy two").replace("ä", "a"),
        item.replace("seventy-two", "seventy-\ntwo"),
        item.replace("seventy-two", "seventytwo"),
    ]
    got = found(spark, [f"Before. {f} after" for f in forms], {4: item.split()})
    assert got == [(i, 4) for i in range(len(forms))]


def test_seeds_survive_the_allowed_edits(items):
    rule = Leak()
    common = {g: k % 7 for k, g in enumerate({tuple(ws[k : k + 4]) for ws in items.values() for k in range(len(ws) - 3)})}
    seeds = rare_seeds(items, rule, common)
    assert sum(map(len, seeds.values())) < sum(len(ws) - 3 for ws in items.values())
    for i, ws in items.items():
        kept = [i in seeds.get(tuple(ws[k : k + 4]), ()) for k in range(len(ws) - 3)]
        for a in range(len(ws) - rule.run + 1):
            for edit in range(a, a + rule.run):
                assert any(kept[k] for k in range(a, a + rule.run - 3) if not k <= edit < k + 4)


def test_alignment_against_plain_smith_waterman():
    rnd = random.Random(3)
    for _ in range(40):
        a, b = (np.array([rnd.randint(0, 3) for _ in range(rnd.randint(1, 14))]) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                same = leakage.MATCH if a[i - 1] == b[j - 1] else -1
                table[i, j] = max(0, table[i - 1, j - 1] + same, table[i - 1, j] - 1, table[i, j - 1] - 1)
        path = align(a, b)
        assert sum(leakage.MATCH if min(s) >= 0 and a[s[0]] == b[s[1]] else -1 for s in path) == table.max()
        assert [i for i, _ in path if i >= 0] == list(range(path[0][0], path[0][0] + sum(i >= 0 for i, _ in path))) if path else True


def run(doc, item, doc_words=None, item_words=None):
    """Whether two texts of one letter a word, laid side by side (`-` for none), hold a run."""
    d, t = ([c for c in x if c != "-"] for x in (doc, item))
    i, j, path = 0, 0, []
    for x, y in zip(doc, item, strict=True):
        path.append((i if x != "-" else -1, j if y != "-" else -1))
        i, j = i + (x != "-"), j + (y != "-")
    return holds_run(path, d, t, Leak(), doc_words or range(len(d)), item_words or range(len(t)))


def test_runs():
    assert run("abcdefghijklmno", "abcdefghijklmno")
    assert not run("abcdefghijklmn", "abcdefghijklmn")
    assert run("abcdefghijklmnx", "abcdefghijklmno")  # the run's last word is changed
    assert not run("abcdefghijklmxx", "abcdefghijklmno")
    assert run("abcdefgxijklmno", "abcdefghijklmno") and not run("abcdefgxxjklmno", "abcdefghijklmno")
    assert run("abcdefgxxxxxxxxx-hijklmnopqrstuv", "abcdefg---------yhijklmnopqrstuv")
    # one word of two parts is changed
    words = [*range(8), 7, *range(8, 15)]
    assert run("abcdefgxyjklmnop", "abcdefghijklmnop", words, words)
    assert not run("abcdefgxyjklmno", "abcdefghijklmno")


def test_long_text_two_places_and_empty_tables(spark, items):
    passage = " ".join(items[3][20:40])
    rnd = random.Random(1)
    filler = " ".join(text(rnd, 60_000))
    docs = [f"{filler} {passage}", f"{passage} x {passage}"]
    assert found(spark, docs, items) == [(0, 3), (1, 3)]
    assert found(spark, docs, {1: None, 2: ["too", "short"]}) == []
    empty = spark.createDataFrame([], DOC)
    none = spark.createDataFrame([], ITEM)
    assert leakage.leaked(empty, none).count() == 0


def test_items_in_blocks(spark, items, monkeypatch):
    monkeypatch.setattr(leakage, "MAX_ITEM_WORDS", 400)
    docs = [" ".join(items[i][10:40]) for i in range(30)]
    assert found(spark, docs, items) == [(i, i) for i in range(30)]


def test_a_better_path_does_not_hide_a_run(items):
    ws = items[0]
    worse = [w if k % 3 else "other" for k, w in enumerate(ws)]
    index = Index([(0, " ".join(ws))], Leak())
    assert index.leaks(" ".join([*worse, "gap", *ws[20:35]])) == [0]
    assert words(None) == []
    assert words("l'avocat, fifty-three") == ["l", "avocat", "fifty", "three"]


@pytest.fixture(scope="module")
def natural():
    """Items with compounds and elisions, and filler of other words."""
    rnd = random.Random(11)
    joined = ["fifty-three", "seventy-two", "l'avocat", "d'une", "Qu'elle", "vice-président", "Straßen-Ämter", "mother-in-law"]
    made = {i: [rnd.choice(joined) if rnd.random() < 0.15 else w for w in text(rnd, 60)] for i in range(40)}
    return made, text(rnd, 500)


SPELLINGS = {
    "as it is": lambda rnd, t: t,
    "hyphen apart": lambda rnd, t: t.replace("-", " "),
    "elision apart": lambda rnd, t: t.replace("'", " "),
    "joined": lambda rnd, t: t.replace("-", ""),
    "upper case": lambda rnd, t: t.upper(),
    "line hyphen": lambda rnd, t: " ".join(w[:2] + "-\n" + w[2:] if len(w) > 4 and rnd.random() < 0.3 and w.isalpha() else w for w in t.split(" ")),
    "invisible": lambda rnd, t: "".join(c + ("\u200b" if rnd.random() < 0.1 and c.isalpha() else "") for c in t),
}


@pytest.mark.parametrize("spelling", SPELLINGS)
@pytest.mark.parametrize("edits", [False, True])
def test_recall_of_planted_runs(natural, spelling, edits):
    """Runs of 15 to 17 words in every spelling, with as many edits as are allowed, at their ends too."""
    made, filler = natural
    rnd = random.Random(f"{spelling}{edits}")
    index = Index([(i, " ".join(ws)) for i, ws in made.items()], Leak())
    lost = 0
    for k in range(300):
        item, n = k % 40, rnd.choice([15, 16, 17])
        at = rnd.randint(0, 60 - n)
        ws = made[item][at : at + n]
        if edits:
            for x in rnd.sample(range(n), n // 8):
                ws[x] = rnd.choice(["changed", "", ws[x] + " added"])
        passage = SPELLINGS[spelling](rnd, " ".join(w for w in ws if w))
        a = rnd.randint(0, 400)
        lost += item not in index.leaks(f"{' '.join(filler[:a])} {passage} {' '.join(filler[a:])}")
    assert lost <= 3


def test_short_or_shuffled_phrases_of_natural_items(natural):
    made, filler = natural
    rnd = random.Random(2)
    index = Index([(i, " ".join(ws)) for i, ws in made.items()], Leak())
    for item, ws in made.items():
        at = rnd.randint(0, 50)
        assert index.leaks(" ".join([*filler[:100], *ws[at : at + 8], *filler[100:]])) == []
        assert index.leaks(" ".join([*filler[:100], *rnd.sample(ws, 60), *filler[100:]])) == []


def test_common_seeds_are_counted_in_the_corpus(spark, items):
    docs = spark.createDataFrame([(i, " ".join(items[i][:20])) for i in range(30)] * 2, "doc_id bigint, text string")
    index = Index([(i, " ".join(ws)) for i, ws in items.items()], Leak())
    grams = sorted(index.grams)
    got = {grams[r.seed]: r.n for r in leakage.seed_frequencies(docs, spark.sparkContext.broadcast(index), grams).collect()}
    assert max(got.values()) == 60 and got[tuple(items[3][10:14])] == 2
    before = len(index.seeds)
    index.choose(got)
    assert len(index.seeds) <= before and tuple(items[0][:4]) not in index.seeds
