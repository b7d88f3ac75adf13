"""Held-out accuracy, the back-off against plain Python, and texts without letters."""

import random
import zlib

import numpy as np
import pytest

from foliospark.llm.op5_language import LONGEST, Model, coded, language

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98


def test_back_off_by_hand():
    counts = {"der": {"de": 5}, "haus": {"de": 3}, "the": {"en": 6}, "house": {"en": 4}, "in": {"de": 4, "en": 4}}
    model = Model([{"word": w, "each": [{"lang": k, "times": n} for k, n in c.items()]} for w, c in counts.items()])
    tables = {}
    for size in range(LONGEST + 1):
        units = {}
        for word, c in counts.items():
            marked = f"_{word}_"
            for unit in [word] if not size else [marked[k : k + size] for k in range(len(marked) - size + 1)]:
                for lang, n in c.items():
                    units.setdefault(unit, dict.fromkeys(model.langs, 0))[lang] += n
        totals = {x: sum(u[x] for u in units.values()) + 0.5 * (len(units) + 1) for x in model.langs}
        tables[size] = {unit: [np.log((c[x] + 0.5) / totals[x]) for x in model.langs] for unit, c in units.items()}

    def plain(word):
        if word in tables[0]:
            return np.array(tables[0][word])
        marked, total = f"_{word}_", np.zeros(len(model.langs))
        for k in range(len(marked)):
            for size in range(min(LONGEST, len(marked) - k), 0, -1):
                if marked[k : k + size] in tables[size]:
                    total += tables[size][marked[k : k + size]]
                    break
        return total * 3 / len(marked)

    words = ["der", "derhaus", "houses", "xyz", "i", "thein", "ünd"]
    codes, starts, ends, _ = coded([" ".join(words)], model.letter)
    for word, scores in zip(words, model.scores(codes, starts, ends), strict=True):
        assert scores == pytest.approx(plain(word))


def test_odd_texts(documents_of):
    learn = [(k, "el perro de la casa que no es" if k % 2 else "the dog of the house that is not", "es" if k % 2 else "en", "s") for k in range(80)]
    odd = [(100, None, "en", "s"), (101, "", None, "s"), (102, "123 !! --", "en", "s"), (103, "the dog " * 30_000, None, "s"), (None, "el perro", None, "s"), (None, "la casa", "es", None), (104, "𝐱 🙂 İstanbul", "en", "s")]
    rows = language(documents_of(learn + odd + odd[:1])).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == 88
    assert [by_id[k].lang_pred for k in (100, 101, 102, 103)] == ["und", "und", "und", "en"]
    assert by_id[100].score == 0 and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id is None} == {"es"}


def test_nothing_to_learn_from(documents_of):
    assert language(documents_of([])).count() == 0
    assert {r.lang_pred for r in language(documents_of([(1, "some words", None, "s")])).collect()} == {"und"}


def made_language(rng, seed):
    """Texts of words that hardly ever come twice, of the syllables of one language."""
    letters = rng.sample("abcdefghijklmnopqrstuvwxyzáéíóúñçöüß", 12)
    syllables = ["".join(rng.sample(letters, 2)) for _ in range(25)]
    return lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(25))


def held_out_share(spark, documents_of, texts):
    rows = [(k, text, lang, "s") for k, (lang, text) in enumerate(texts)]
    of = {k: lang for k, _, lang, _ in rows}
    held = [r for r in language(documents_of(rows)).collect() if r.held_out]
    right = {}
    for r in held:
        right.setdefault(of[r.doc_id], []).append(r.lang_pred == of[r.doc_id])
    return {lang: sum(x) / len(x) for lang, x in right.items()}


def test_a_small_language_of_rare_words_is_known(spark, documents_of):
    rng = random.Random(3)
    english = lambda: " ".join(rng.choice("the dog of house that is not a big one and they go home to see her now".split()) for _ in range(25))
    strange = made_language(rng, 1)
    texts = [("en", english()) for _ in range(300)] + [("qq", strange()) for _ in range(40)]
    shares = held_out_share(spark, documents_of, texts)
    assert shares["qq"] == 1 and shares["en"] == 1


def test_many_small_languages(spark, documents_of):
    rng = random.Random(4)
    langs = {f"l{k:03d}": made_language(rng, k) for k in range(200)}
    texts = [(lang, make()) for lang, make in langs.items() for _ in range(20)]
    rng.shuffle(texts)
    shares = held_out_share(spark, documents_of, texts)
    assert len(shares) > 190 and sum(shares.values()) / len(shares) > 0.9
