"""Lowering of prose to steps, and coverage by spans: cases by hand."""

import pytest

from ferrograph.operators.procedures import clauses, coverage, cover, entries, frames, lowered, reaction_candidates, sentences


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("It weighs 1.5 g (ca. 2 g). At 25 °C. Then e.g. more; J. Smith said so.", ["It weighs 1.5 g (ca. 2 g).", "At 25 °C.", "Then e.g. more; J. Smith said so."]),
        ("1. Add water\n2) Stir. Wait\n- Filter", ["Add water", "Stir.", "Wait", "Filter"]),
        ("no end", ["no end"]), ("", []), (" \n ", []), ("...", ["..."]),
    ],
)
def test_sentences(text, parts):
    assert [text[a:b] for a, b in sentences(text)] == parts


def test_clauses():
    said = lambda t: [t[a:b] for a, b in clauses(t, 0, len(t))]
    assert said("The layers were separated (washed, dried and filtered), dried, and then concentrated.") == ["The layers were separated (washed, dried and filtered)", "dried", "concentrated"]
    assert said("Salt and water were mixed, and it was stirred") == ["Salt and water were mixed", "it was stirred"]


def test_frames_and_what_they_read():
    got = frames("It was washed 3 x 20 mL, stirred at rt for 2 h. The product was formed. Odd. Extracted three times with MTBE and heated to 40.5 °C overnight.")
    shown = [(f[1], f[2], *f[5:11]) for f in got]
    assert shown == [
        ("step", "wash", None, None, 20.0, "mL", 3, None), ("step", "hold", 25.0, 120.0, None, None, None, None), ("observation", None, *[None] * 6), ("unparsed", "observe", *[None] * 6),
        ("step", "extract", None, None, None, None, 3, "MTBE"), ("step", "heat", 40.5, 960.0, None, None, None, None),
    ]
    assert got[3][-1] == "W805" and frames("") == [] and frames(" ,; .") == []


def test_coverage_follows_from_spans(spark):
    text = "Water was added. It was filtered (then washed) NaCl. A solid formed when heated."
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "Nothing.")], "id bigint, t string")
    framed = lowered(docs, "id", "t", ["add", "filter", "wash"])
    got = {(r["source"], text[r["start"] : r["end_"]]): r["status"] for r in coverage(entries(docs, "id", "t"), framed, "id").collect()}
    assert got == {
        ("english_action_keyword", "added"): "covered_by_step", ("english_action_keyword", "filtered"): "covered_by_step", ("english_action_keyword", "washed"): "uncovered_action_like",
        ("english_action_keyword", "heated"): "covered_by_observation", ("observation_keyword", "formed"): "covered_by_observation", ("material_like", "NaCl"): "uncovered_material_like",
    }
    parts = sorted((r["id"], r["start"], r["end_"], r["covered"]) for r in cover(framed, docs, "id", "t").collect())
    assert parts == [(1, 0, 15, True), (1, 15, 17, False), (1, 17, 51, True), (1, 51, 53, False), (1, 53, 79, True), (1, 79, 80, False), (4, 0, 8, False)]


def test_cover_merges_what_overlaps(spark):
    docs = spark.createDataFrame([(1, "x" * 30)], "id bigint, t string")
    spans = spark.createDataFrame([(1, "step", 2, 9), (1, "step", 4, 6), (1, "observation", 8, 12), (1, "step", 12, 14), (1, "unparsed", 15, 20), (1, "step", 22, 30)], "id bigint, kind string, start int, end_ int")
    assert sorted((r["start"], r["end_"], r["covered"]) for r in cover(spans, docs, "id", "t").collect()) == [(0, 2, False), (2, 14, True), (14, 22, False), (22, 30, True)]


def test_reaction_candidates(spark):
    texts = {
        1: "The flask was charged with NaCl. NaOH was added with HCl. Then more was added. It was heated to 50 °C, cooled to 0 °C and stirred for 2 h. It was washed with brine to yield the salt.",
        2: "It was charged with KOH and stirred for 5 min.", 3: "It was washed with brine. It was charged with KOH, heated to 40 °C.", 4: "Nothing.", 5: None,
    }
    docs = spark.createDataFrame(list(texts.items()), "id bigint, t string")
    got = {r["id"]: tuple(r)[1:] for r in reaction_candidates(lowered(docs, "id", "t"), docs, "id", "t").collect()}
    assert got == {
        1: ("NaCl", "HCl", "50.0", "120.0", "the salt", "brine", round((0.84 * 2 + 0.67 + 0.84 * 2 + 0.82) / 6, 4), "candidate"),
        2: ("KOH", "", None, "5.0", None, "", 0.84, "product_required"), 3: ("", "", None, None, None, "brine", None, "insufficient"),
    }


def test_a_sentence_is_read_once_a_batch(spark):
    from ferrograph.operators.procedures import by_sentence

    docs = spark.createDataFrame([(i, "Go on. It was heated. Go on. " * 3) for i in range(20)], "id bigint, t string").coalesce(1)
    reads = spark.sparkContext.accumulator(0)

    def find(sentence):
        reads.add(1)
        return [("x", 0, len(sentence))]

    got = sorted((r["id"], r["place"], r["start"], r["end_"]) for r in by_sentence(docs, "id", "t", find, "kind string, start int, end_ int").collect())
    one = [(29 * k + a, 29 * k + b) for k in range(3) for a, b in ((0, 6), (7, 21), (22, 28))]
    assert got == [(i, n, a, b) for i in range(20) for n, (a, b) in enumerate(one)]
    assert reads.value == 2
