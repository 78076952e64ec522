import random
from collections import Counter

import pytest

from corpusloom.llm import mojibake, pairs

WORDS = {
    "en": "the old river carries a small boat along the green bank while every child watches the slow water and the bridge near the town",
    "de": "der alte Fluss trägt ein kleines Boot am grünen Ufer während jedes Kind das langsame Wasser über der Brücke für die Stadt sieht",
    "fr": "la vieille rivière porte un petit bateau près de la rive verte où chaque élève regarde l'eau lente et le château après la fête",
    "es": "el río viejo lleva un pequeño barco junto a la orilla verde donde cada niño mira el agua lenta y el corazón de la canción",
    "ru": "старая река несёт маленькую лодку вдоль зелёного берега пока каждый ребёнок смотрит на медленную воду и мост около города",
}


def sentence(rng, lang):
    words = WORDS[lang].split()
    s = " ".join(rng.choice(words) for _ in range(rng.randrange(7, 13)))
    return s[:1].upper() + s[1:] + "."


def question(rng, lang):
    return {"en": "Explain why ", "de": "Erkläre, warum gilt: ", "fr": "Explique pourquoi ", "es": "Explica por qué ", "ru": "Объясни, почему "}[lang] + sentence(rng, lang)


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(1500):
        lang = rng.choice(list(WORDS))
        q, a = question(rng, lang), " ".join(sentence(rng, lang) for _ in range(rng.randrange(2, 5)))
        kind = rng.random()
        if kind < 0.04:
            a, want[i] = pairs.make_refusal(q, lang, rng), "refusal"
        elif kind < 0.08:
            a, want[i] = q, "copied"
        elif kind < 0.12:
            a, want[i] = " ".join(sentence(rng, rng.choice([x for x in WORDS if x != lang])) for _ in range(3)), "language"
        elif kind < 0.16:
            end = {"en": "the", "de": "der", "fr": "la", "es": "el", "ru": "на"}[lang]
            a, want[i] = a + " " + " ".join(sentence(rng, lang).rstrip(".").split()[: rng.randrange(2, 6)]) + " " + end, "truncated"
        elif kind < 0.2:
            a, want[i] = rng.choice(("", "  ", None, "N/A", "...", "null")), "empty"
        if i % 2:
            rows.append((i, q, a, None, None, None, lang, "x"))
        else:
            rows.append((i, None, None, q, rng.choice((None, "")), a, lang, "x"))
    rows += [rows[3], (9000, None, "The old river carries a small boat. Every child watches the bridge.", None, None, None, None, "x"), (9001, None, None, None, None, None, None, "x")]
    return spark.createDataFrame(rows, "pair_id long, prompt string, response string, instruction string, input string, output string, lang string, defect string"), want


def test_held_out_defects(table):
    df, want = table
    got = {r.pair_id: r.defect for r in pairs.pair_defects(df).collect()}
    assert got.pop(9001) == "empty" and 9000 not in got
    for kind in set(want.values()):
        truth, found = {k for k, v in want.items() if v == kind}, {k for k, v in got.items() if v == kind}
        assert len(truth & found) >= 0.9 * len(truth), (kind, len(truth & found), len(truth))
        assert len(found - truth) <= 0.1 * len(found) + 1, (kind, len(found - truth), len(found))


def test_no_rows(table):
    assert pairs.pair_defects(table[0].limit(0)).count() == 0


def test_clauses_lose_no_words():
    text = "One. Two!  Three\n- four\n```py\nx = 1. y\n```\nfive? \"Six.\" 7.5 and e.g. end"
    parts = pairs.clauses(text)
    assert "".join("".join(parts).split()) == "".join(text.split())
    assert "```py\nx = 1. y\n```" in parts and '"Six."' in parts
    assert pairs.clauses("") == [] and pairs.clauses(" \n ") == []


@pytest.mark.parametrize("a,empty", [(None, True), (" ​", True), ("<p></p>", True), ("<|assistant|>", True), ("(no answer)", True), ("n/a", True), ("0", False), ("B", False), ("No", False), ("```\n```", True)])
def test_stand_ins(a, empty):
    assert pairs.is_empty(a) is empty


def test_late_words_of_a_clause_are_features():
    languages = pairs.Languages([], [])
    opening = "On the matter of the old river and the small boat near the green bank of the town, "
    features = pairs.describe(None, opening + "I am afraid I cannot help.", languages)[1][0]
    for k in ("wcannot", "bi_cannot", "ti_cannot_help"):
        assert pairs._hash(k) % pairs.DIMENSIONS in features, k


CHAINS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac-roman"), ("cp1252", "cp850"), ("cp1252", "mac-roman")]


def test_garbled_texts_are_found_and_restored(spark):
    rng = random.Random(3)
    rows, truth, original = [], set(), {}
    for i in range(1200):
        lang = rng.choice(list(WORDS))
        text = "\n".join(" ".join(sentence(rng, lang) for _ in range(4)) for _ in range(3))
        if rng.random() < 0.06 and not text.isascii():
            stored, read = rng.choice(CHAINS) if lang != "ru" else rng.choice([("utf-8", "latin-1"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251")])
            try:
                bad = text.encode(stored).decode(read)
            except UnicodeError:
                bad = None
            if bad and bad != text:
                truth.add(i)
                original[i] = text
                text = bad
        rows.append((i, text, lang if i % 9 else None))
    rows += [(5000, "A page that shows \"Ã©\" instead of the letter was read wrongly.", "en"), (5001, None, "en"), (5002, "", None), (5003, "Die Br�cke ist da.", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.restored for r in mojibake.garbled(df).collect()}
    assert got.pop(5003, "missing") is None
    assert not {5000, 5001, 5002} & set(got)
    assert len(truth & set(got)) >= 0.9 * len(truth) and len(set(got) - truth) <= 2
    assert Counter(got[i] == original[i] for i in truth & set(got))[True] >= 0.85 * len(truth)
    assert mojibake.garbled(df.limit(0)).count() == 0


def test_garbled_text_does_not_vote_itself_usual(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(" ".join(sentence(rng, lang) for _ in range(4)) for _ in range(2)), lang) for i, lang in enumerate(["ru", "fr", "es"] * 80)]
    copied = " ".join(sentence(rng, "ru") for _ in range(4))
    own = [" ".join(sentence(rng, "ru") for _ in range(4)) for _ in range(12)]
    original = dict(enumerate([copied] * 30 + own, 1000))
    rows += [(i, t.encode("cp1251").decode("cp1252"), "ru") for i, t in original.items()]
    rows += [(i, "∂L/∂w ≈ 0.25 · √n, Δ ≤ 0.5 ± 0.1", lang) for i, lang in enumerate(("fr", "es", "ru"), 2000)]  # signs between figures are sound
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id: r.restored for r in mojibake.garbled(df).collect()} == original


@pytest.mark.parametrize("text", ["�ber der Stadt.", "Er sagt: �ber.", "Der Kaffee im Caf� ist alt.", "Das Caf�.", "It said â€œneverâ€�.\nMore.", "������ �� ����.", "He said “so.� Then", "20 �C"])
def test_lost_characters_are_found(text):
    model = mojibake.Model({"de": WORDS["de"].encode(), "en": WORDS["en"].encode()})
    assert mojibake.repair(text, "de", model) == (True, None)


@pytest.mark.parametrize("text", ["The sign \"�\" stands for a lost one.", "It is shown as �.", "(�)"])
def test_a_shown_replacement_character_is_sound(text):
    assert mojibake.repair(text, "en", mojibake.Model({"en": WORDS["en"].encode()})) == (False, None)


def test_undoing_is_exact():
    text = "Größe – “naïve” café 🙂"
    for e in ("latin-1", "cp437", "cp850", "mac-roman"):
        assert mojibake.undo_utf8(text.encode().decode(e), e) == text
    twice = text.encode().decode("latin-1").encode().decode("latin-1")
    assert mojibake.undo_utf8(mojibake.undo_utf8(twice, "latin-1"), "latin-1") == text
    assert mojibake.undo_single("Größe".encode("cp1252").decode("cp850"), "cp850", "cp1252") == "Größe"
