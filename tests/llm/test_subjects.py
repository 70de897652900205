"""Subject areas: held-out documents of a small corpus."""

import random

from evalmill.llm import subjects

TALK = {
    "sport": ["The striker scored twice before the break.", "Their captain is out with a knee injury.", "The league table changed after the away match.", "Fans saw the goalkeeper save a late penalty."],
    "law": ["The judge dismissed the appeal on Monday.", "Counsel argued that the contract was void.", "The jury acquitted on all counts.", "Prosecutors amended the indictment again."],
    "energy": ["The reactor returned to service after repairs.", "Storage tanks for gas are nearly full.", "A transformer fire cut output at the plant.", "Solar output grew while the grid was saturated."],
}
GENERAL = ["I would move up only if another source confirmed it.", "Past announcements of this kind were late.", "So far nothing suggests a delay.", "It helps to ask what would have to happen."]


def _corpus(n=240, seed=1):
    rnd = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        own = rnd.sample(sorted(TALK), rnd.choice([1, 1, 2]))
        lines = [rnd.choice(TALK[s]) for s in own for _ in range(4)] + [rnd.choice(GENERAL) for _ in range(4)]
        rnd.shuffle(lines)
        docs.append((i, " ".join(lines)))
        truth[i] = set(own)
    return docs, truth


def _found(spark, docs, labels, areas=None):
    areas = areas or [(s, s.title(), {"sport": "Matches and players", "law": "Judges and appeals", "energy": "Plants and grids"}[s]) for s in TALK]
    out = subjects.document_subjects(
        spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, subject string"), spark.createDataFrame(areas, "subject string, subject_name string, description string")
    )
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    return got


def test_held_out(spark):
    docs, truth = _corpus()
    labels = [(i, s) for i in range(0, 240, 6) for s in truth[i]] + [(99999, "sport"), (1, "no such area")]
    got = _found(spark, [*docs, (1000, None), (1001, "  "), (1002, GENERAL[0]), (1003, TALK["law"][0] * 3000), (1004, docs[7][1])], labels)
    held = [i for i in truth if i % 6 and i != 1]
    assert sum(got.get(i) == truth[i] for i in held) >= 0.97 * len(held)
    assert not {1000, 1001, 1002} & set(got) and got[1003] == {"law"} and got[1004] == got[7]
    # documents with labels are not put out again, whatever their label says
    assert not {i for i in got if i % 6 == 0 and i < 240} and 1 not in got


def test_empty(spark):
    assert _found(spark, [], [(1, "sport")]) == {}


def test_sentences():
    assert subjects.sentences("<p>Step 1.1: The runner &amp; the keeper met Arlon Labs on 4 May.</p>\n\n* 12%\n\\boxed{A}") == ["the runner the keeper met on may"]
    assert subjects.sentences(None) == [] and subjects.sentences(" ") == []
