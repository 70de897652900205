"""Nothing is lost to repetition: what one text repeated often does to the counts over the corpus."""

import random

import pytest

from evalmill.llm import pairs, residue, truncation

from test_texts import _cut_rows, _text


def test_copies_of_a_cut_text_do_not_vouch_for_its_end(spark):
    rows, cut = _cut_rows()
    text = dict(rows)[5001]
    rows += [(100000 + i, text) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id bigint, text string")
    assert text.endswith("Seasonal effects do not se")
    assert {r["row_id"] for r in truncation.truncated_texts(df).collect()} == cut | set(range(100000, 100600))


@pytest.mark.parametrize("copies", [True, False])
def test_common_residue_does_not_become_prose(spark, copies):
    rnd = random.Random(5)
    clean = [(f"c{i}", _text(rnd)) for i in range(600)]
    hosts = [(f"{_text(rnd, 3)} {{}} {_text(rnd, 3)}", s) for s in ("{{question}}", "TBD", "\nAccess denied\n")]
    dirty = [(f"d{i}", (hosts[i % 3][0] if copies else f"{_text(rnd, 3)} {{}} {_text(rnd, 3)}").replace("{}", hosts[i % 3][1], 1)) for i in range(300)]
    df = spark.createDataFrame(clean + dirty, "item_id string, prompt string")
    assert {r["key"] for r in residue.residue_rows(df, "item_id", "prompt").collect()} == {k for k, _ in dirty}


@pytest.mark.parametrize("pages", [1, 6])
def test_rest_of_error_pages_does_not_become_residue(spark, pages):
    rnd = random.Random(8)
    names = ["The cloud region", "The login service", "The browser engine", "The package registry"]
    outage = [f"{n} returned 503 errors after a certificate expired." for n in names]
    clean = [(f"c{i}", _text(rnd)) for i in range(600)] + [(f"o{i}", f"{_text(rnd, 2)} {outage[i % 4]} {_text(rnd, 2)}") for i in range(120)]
    page = "Error {}: the server did not answer. Your session has expired, please log in again. Please enable JavaScript in your browser to view this page.\n{}"
    dirty = [(f"d{i}", page.format(500 + i, outage[i % 4])) for i in range(pages)] + [(f"v{i}", f"{_text(rnd, 2)}\nNoneType\n{_text(rnd, 2)}") for i in range(2)]
    df = spark.createDataFrame(clean + dirty, "item_id string, prompt string")
    assert {r["key"] for r in residue.residue_rows(df, "item_id", "prompt").collect()} == {k for k, _ in dirty}


def test_texts_cut_after_a_point(spark):
    rows, cut = _cut_rows()
    base = rows[0][1].rsplit("\n", 1)[0] + "\n"
    ends = ["Answer: 0.", "Final answer: **0.", "So p = 0.", "\\boxed{0.", "\\boxed{The court of Arlon.", "Sie schrieb: „Die Bank wartet ab.", "1. One headline.\n2. Another headline.\n3."]
    whole = ["Answer: 0.42.", "\\boxed{0.} is no value.", "Sie schrieb: „Die Bank wartet ab.“", "»Ja«, sagte sie.", "The answer was 3.", "In all there were\n3.", "Note: \\boxed{A} is the answer."]
    rows += [(200000 + i, base + s) for i, s in enumerate(ends)] + [(300000 + i, base + s) for i, s in enumerate(whole)]
    found = {r["row_id"] for r in truncation.truncated_texts(spark.createDataFrame(rows, "row_id bigint, text string")).collect()}
    assert found == cut | {200000 + i for i in range(len(ends))}


def test_copies_of_a_prompt_that_ends_like_an_answer(spark):
    rnd = random.Random(6)
    ask = "Will the court of Arlon grant the settlement before 4 May? Both sides said that they would wait for the ruling."
    prompts = {"percent": f"{ask}\nGive the chance that turnout will exceed 50%", "digits": f"{ask}\nanswer 0 or 1", "boxes": f"{ask}\n\\boxed{{Yes}} or \\boxed{{No}}"}
    items = spark.createDataFrame(list(prompts.items()), "item_id string, prompt string")
    copied = [(900, "percent", prompts["percent"]), (901, "digits", prompts["digits"]), (902, "boxes", prompts["boxes"]), (903, "percent", "Question: " + prompts["percent"].splitlines()[1])]
    answered = [(800, "percent", ask + "\n50%"), (801, "digits", ask + "\n1"), (802, "boxes", ask + "\n\\boxed{Yes}"), (803, "digits", "1")]
    rows = [*copied, *answered, *((i, "digits", _text(rnd) + " \\boxed{A}") for i in range(200))]
    replies = spark.createDataFrame(rows, "row_id bigint, item_id string, text string")
    out = pairs.defective_pairs(replies, items, replies.select("row_id", "text")).filter("defect = 'copies_question'").collect()
    assert {r["row_id"] for r in out} == {r[0] for r in copied}


def test_very_long_words(spark):
    rows, cut = _cut_rows()
    rnd = random.Random(7)
    blob = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH") for _ in range(100_000))
    rows += [(400000 + i, f"The file of Arlon holds {blob} as it was sent on {i} May.") for i in range(30)]
    rows += [(410000 + i, f"The file of Arlon holds {blob[: 60 + 5 * i]}") for i in range(5)]
    found = {r["row_id"] for r in truncation.truncated_texts(spark.createDataFrame(rows, "row_id bigint, text string")).collect()}
    assert found == cut | {410000 + i for i in range(5)}
