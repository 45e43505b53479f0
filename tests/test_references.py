"""Reference tokens: fields, quotes, case, ranges."""

from ferrograph.operators.references import reference_tokens, references


def shown(text):
    return [(line, a, b, field, target) for line, a, b, field, _, target, _, _ in references(text)]


def test_fields_and_tokens():
    assert shown("reactants: [ @mol-a, route-b#rxn-b; ]\nnotes: @rxn-b") == [(1, 14, 20, "reactants", "mol-a"), (1, 22, 36, "reactants", "route-b#rxn-b"), (2, 8, 14, "@", "rxn-b")]
    assert shown("  prev : a|b.c\r\nPrev: a\nprev a") == [(1, 10, 11, "prev", "a"), (1, 12, 15, "prev", "b.c")]
    assert references("prev: @d.x#n1")[0][4:] == ("@d.x#n1", "d.x#n1", "d.x", "n1")


def test_quotes():
    assert shown('a "no @x" @y') == [(1, 11, 13, "@", "y")]
    assert shown("a 'no \"@x' @y") == [(1, 12, 14, "@", "y")]
    assert shown('say \\"@in and "@out \\" @still" @End "@open\n@next') == [(1, 7, 10, "@", "in"), (1, 32, 36, "@", "End"), (2, 1, 6, "@", "next")]


def test_what_is_no_reference():
    assert [x[4] for x in shown("@ @# @a# @#b @a#b#c @é x@Y_1.z;")] == ["Y_1.z"] and shown("x@Y_1.z;") == [(1, 2, 8, "@", "Y_1.z")]
    assert shown("") == [] and shown("product:") == [] and shown('product: "x"') == []


def test_over_a_table(spark):
    df = spark.createDataFrame([(1, "@a\n@B"), (2, None), (3, "none")], "id bigint, t string")
    assert [(r["id"], r["line"], r["target"]) for r in reference_tokens(df, "id", "t").collect()] == [(1, 1, "a"), (1, 2, "B")]
