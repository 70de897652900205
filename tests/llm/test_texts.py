"""Residue, languages, truncation and pairs on small fixtures."""

import random

import numpy as np
import pytest

from evalmill.llm import languages, ngrams, pairs, residue, truncation

NAMES = ["Arlon", "Bexter", "Corvin Labs", "Dunmere", "Eskil Works", "Fanholt"]
SENTENCES = [
    "The court of {n} dismissed the claim on {d} May.", "A base rate over the last {d} cases is about {d}%.", "I would move up only if a second source confirmed it.",
    "Reports since {d} June have been mixed, so I stay close to the prior.", "The water board in {n} closed {d} trails because of smoke.", "Taken together, this makes the outcome more likely than not.",
    "Shares of {n} closed {d}% lower after the profit warning.", "Seasonal effects do not seem to play a role.",
]


def _sentence(rnd):
    return rnd.choice(SENTENCES).format(n=rnd.choice(NAMES), d=rnd.randrange(2, 90))


def _text(rnd, n=5):
    return " ".join(_sentence(rnd) for _ in range(n))


def test_hashing_does_not_cross_texts():
    a, _ = ngrams.hashed(["abc", "bcd"], 3, 1 << 10)
    assert list(a) == [*ngrams.hashed(["abc"], 3, 1 << 10)[0], *ngrams.hashed(["bcd"], 3, 1 << 10)[0]]
    assert ngrams.hashed(["", "a"], 3, 1 << 10)[0].size == 0
    scores, grams = ngrams.text_scores(["abcd", "", "xyz"], 3, np.zeros((2, 1 << 10), np.float32), chunk=2)
    assert scores.shape == (3, 2) and list(grams) == [2, 0, 1]


@pytest.mark.parametrize("text, language", [("Das ist eine Frage, die noch niemand beantwortet hat.", "de"), ("Nous ne savons pas encore ce que cela veut dire.", "fr"), ("El puerto atiende menos barcos por la huelga de ayer.", "es"), ("Rain is expected in the north before the weekend.", "en"), ("Базовая частота составляет около половины случаев.", "ru"), ("总体来看，这一结果更有可能发生。", "zh")])
def test_languages(text, language):
    scores, _ = languages.posteriors([text, None, ""], languages.model())
    assert languages.LANGUAGES[int(scores[0].argmax())] == language


def _prompts(rnd, n, tag):
    return [(f"{tag}{i}", _text(rnd)) for i in range(n)]


#: Wordings that are not among the seeds; each was written for this test.
PLANTED = {
    "slot": ["{{ customer.nickname }}", "${shippingWeight}", "<%= harvest_year %>", "[[chapter]]", "{% for boat in fleet %}", "%(sculptor)s", "__RIVER_NAME__", "{3} {4}", "<insert painter>", "[INSERT BRIDGE NAME HERE]", "@@TOWER@@", "«harbour»"],
    "filler": ["Dolore magna tempor nulla velit consectetur aliquip.", "TBA", "TODO: rework before print", "Blindtext folgt in Kürze.", "This is dummy copy, to be replaced.", "xxx xxx xxxx", "Texte provisoire à remplacer.", "Some placeholder words go here.", "undefined", "#DIV/0!"],
    "notice": ["HTTP 504 Gateway Timeout", "We're sorry, this page could not be found on the server.", "Access to this document was denied by the administrator.", "JavaScript must be turned on in your browser to use this site.", "Your session timed out. Please log in again.", "Internal server error. Please try again later.",
               "Bitte aktivieren Sie Cookies und JavaScript in Ihrem Browser.", "Cette page n'existe pas ou a été supprimée.", "El servidor no responde. Inténtelo más tarde.", "We use cookies to personalise content. Accept all | Reject all", "Checking that the connection is secure, please wait.", "The database connection was refused."],
}
#: Talk about such things, and notation on purpose.
TALK = ["The template syntax puts a variable between {{ and }} marks.", "Visitors see a 404 page, as counted by the board.", "The set {A, B} stands for both.", "It works without JavaScript, they say.", "Answer as \\boxed{answer} please.", "Give it as [low, high] if you can.",
        "A record like {\"id\": 3, \"state\": \"open\"} counts.", "Regulators want cookie banners to be plain.", "The designer left 'lorem ipsum' in a sample theme.", "The registry returned 503 errors for an hour.", "See [12] and Table 3 (p. 40).", "The price is $40, or 12% less.", "The term is undefined for a single case."]


def test_residue(spark):
    rnd = random.Random(4)
    clean = _prompts(rnd, 300, "c")
    talk = [(f"t{i}-{j}", _text(rnd, 3) + " " + s) for i in range(12) for j, s in enumerate(TALK)]
    bad = [(f"{kind}{j}", f"{_text(rnd, 2)}\n{s}\n{_text(rnd, 1)}") for kind, own in PLANTED.items() for j, s in enumerate(own)] + [("whole", "Please enable JavaScript and cookies to go on")]
    rows = [*clean, *talk, *bad, ("null", None), ("blank", "  "), ("long", _text(rnd, 4000)), ("whole", "Please enable JavaScript and cookies to go on")]
    df = spark.createDataFrame(rows, "item_id string, prompt string")
    found = residue.residue_rows(df, "item_id", "prompt").collect()
    got, want = {r["key"] for r in found}, {k for k, _ in bad}
    assert len(got & want) >= 0.9 * len(want), sorted(want - got)
    assert len(got & want) >= 0.97 * len(got), sorted(got - want)
    assert sum(r["key"] == "whole" for r in found) == 2 and all(0 < r["covered"] <= 1 for r in found)
    assert residue.residue_rows(df.limit(0), "item_id", "prompt").collect() == []


def test_residue_is_decided_by_the_models(spark):
    """Without the residue models nothing is found, and the windows leave most clean texts alone."""
    rnd = random.Random(8)
    texts = [t for _, t in _prompts(rnd, 300, "c")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    ratios = residue.fit(df, "t")
    passed = residue.Finder(ratios).windows(residue.Codes(texts))
    assert len(passed) < 0.2 * len(texts)
    planted = [s for own in PLANTED.values() for s in own]
    assert sum(bool(s) for s in residue.Finder(ratios).residue(planted)) >= 0.9 * len(planted)
    assert not any(residue.Finder(np.zeros_like(ratios)).residue(planted))


def test_residue_blocks():
    long = "\n".join(["The court waits."] * 50_000)
    groups = list(residue._blocks(["a", None, " ", long, "b"]))
    assert "".join(t for g in groups for i, _, t in g if i == 3) == long and {i for g in groups for i, _, _ in g} == {0, 3, 4}
    assert all(t.endswith("\n") or at + len(t) == len(long) for g in groups for i, at, t in g if i == 3)
    counts = residue.count(["abcd abcd", "abcd"], [[], []])
    assert counts[residue.PROSE].max() == 2  # once a text


def _cut_rows():
    rnd = random.Random(9)
    rows, cut = [], set()
    for i in range(1200):
        t = _text(rnd)
        rows.append((i, t + rnd.choice(["", "\n0.42", " \\boxed{B}", " *0.31*"])))
    for i, text in enumerate(["Reports since 4 June have been mixed, so I stay", "Seasonal effects do not se", "The water board in Dunm", "I would move up only if a second source", "My answer: \\boxed{Corvin", "Shares of Arlon closed 4% lower after the …[cut]", "Taken together, this makes the outcome more�"]):
        rows.append((5000 + i, f"{_text(rnd, 2)} {text}"))
        cut.add(5000 + i)
    whole = ["Seasonal effects do not seem to play a role", "Taken together, this makes the outcome more likely than not", "0.42", "\\boxed{A}", None, "", "Final answer:", "I would move up only if a second source confirmed it..."]
    rows += [(6000 + i, t if t is None or i > 1 else f"{_text(rnd, 2)} {t}") for i, t in enumerate(whole)]
    return rows, cut


def test_truncation(spark):
    rows, cut = _cut_rows()
    df = spark.createDataFrame(rows, "row_id bigint, text string")
    found = {r["row_id"] for r in truncation.truncated_texts(df).collect()}
    assert found == cut
    # repeated rows are judged each; the number of partitions does not matter
    twice = df.unionByName(df.selectExpr("row_id + 100000 as row_id", "text")).repartition(5)
    assert {r["row_id"] for r in truncation.truncated_texts(twice).collect()} == cut | {c + 100000 for c in cut}
    assert truncation.truncated_texts(df.limit(0)).collect() == []


def test_truncation_rates(spark):
    rows, cut = _cut_rows()
    df = spark.createDataFrame([(i, "a" if i >= 5000 else None, t) for i, t in rows], "row_id bigint, source string, text string")
    out = {r["source"]: (r["n_texts"], r["n_truncated"]) for r in truncation.truncation_rates(df).collect()}
    assert out == {"a": (14, 7), None: (1200, 0)}


def test_defective_pairs(spark):
    rnd = random.Random(6)
    q = {"en": "Will the court of Arlon grant the settlement before 4 May? The case has been open since last year, and both sides said that they would wait for the ruling.", "de": "Senkt die Notenbank den Leitzins noch in diesem Jahr? Die Preise sind gestiegen, und die Händler rechnen mit einer Entscheidung im Herbst."}
    items = spark.createDataFrame([("en", q["en"]), ("en", q["en"]), ("de", q["de"]), ("null", None)], "item_id string, prompt string")
    good = [(i, "en", _text(rnd) + " \\boxed{A}") for i in range(400)]
    cases = [
        (900, "en", None, {"empty"}), (901, "en", " **Answer:** \\boxed{} ", {"empty"}), (902, "en", "<think>\n</think>", {"empty"}),
        (903, "en", "I'm sorry, but I can't help with this request.", {"refusal"}), (904, "de", "Leider kann ich diese Frage nicht beantworten.", {"refusal"}),
        (905, "en", q["en"].upper(), {"copies_question"}), (906, "en", "Question: Will the court of Arlon grant the settlement before 4 May?\n\nWill the court of Arlon grant the settlement before 4 May?", {"copies_question"}),
        (907, "en", "Die Preise sind gestiegen, und ich halte es für wahrscheinlich, dass die Entscheidung im Herbst kommt. 0.42", {"other_language"}),
        (908, "de", "Die Preise sind gestiegen, und ich halte es deshalb für wahrscheinlich. One headline reads: „The bank will wait until the end of the year“. 0.42", set()),
        (909, "en", _text(rnd, 2) + " Reports since 4 June have been mixed, so I stay", {"truncated"}), (910, "en", "0.42", set()), (911, "en", "I can't see live data, so this rests on what is given above. \\boxed{A}", set()),
        (912, "null", "I can't see why it would not happen, as the base rate is high. 0.9", set()), (913, "gone", None, set()), (914, "en", _text(rnd, 3), set()), (915, "en", None, {"empty"}),
    ]
    rows = [*good, *[c[:3] for c in cases]]
    replies = spark.createDataFrame(rows, "row_id bigint, item_id string, text string")
    out = pairs.defective_pairs(replies, items, replies.select("row_id", "text")).collect()
    got = {}
    for r in out:
        got.setdefault(r["row_id"], set()).add(r["defect"])
    assert got == {i: d for i, _, _, d in cases if d}
    assert pairs.defective_pairs(replies.limit(0), items, replies.select("row_id", "text").limit(0)).collect() == []


@pytest.mark.parametrize("text", [
    "Το ποσοστό ανεργίας μειώθηκε ξανά και δεν περιμένω κάποια αλλαγή μέχρι το καλοκαίρι.", "मुझे लगता है कि यह फैसला गर्मियों से पहले नहीं आएगा, क्योंकि दोनों पक्ष अब भी बात कर रहे हैं।",
    "אני חושב שההחלטה לא תתקבל לפני הקיץ, כי שני הצדדים עדיין מדברים ביניהם.", "ผมคิดว่าการตัดสินใจจะไม่เกิดขึ้นก่อนฤดูร้อน เพราะทั้งสองฝ่ายยังคุยกันอยู่",
    "Ceny v posledních týdnech vzrostly a nevěřím, že by soud rozhodl ještě před létem.", "Hinnat ovat nousseet viime viikkoina, enkä usko, että oikeus tekee päätöksen ennen kesää.",
    "Giá cả đã tăng trong những tuần gần đây và tôi không tin rằng tòa án sẽ quyết định trước mùa hè.",
])
def test_languages_beside_the_prompts(spark, text):
    """A reply in a language that no prompt has is told from the prompt's, in whatever script."""
    rnd = random.Random(9)
    items = spark.createDataFrame([("en", "Will the court of Arlon decide before the end of the month? Reports since June have been mixed, and the question is open."), ("rare", "Entscheidet das Gericht vor dem Ende des Monats? Die Berichte seit Juni sind gemischt, und die Frage ist offen.")] + [(f"e{i}", _text(rnd)) for i in range(1000)], "item_id string, prompt string")
    replies = spark.createDataFrame([(1, "en", text), (2, "en", _text(rnd)), (3, "rare", "Ich glaube nicht, dass das Gericht noch vor dem Sommer entscheidet."), (4, "rare", _text(rnd))], "row_id bigint, item_id string, text string")
    out = pairs.defective_pairs(replies, items, replies.select("row_id", "text")).filter("defect = 'other_language'").collect()
    assert {r["row_id"] for r in out} == {1, 4}
