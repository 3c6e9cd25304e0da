import json

import pytest

from florilege.operators import records as rec

RANKS = [("floraveg_sample", "SPE"), ("wcvp_taxon", "Species"), ("wcvp_taxon", "Genus")]
TAIL = "|Fam|Gen|spec||Gen spec|L.|{rank}|Accepted|1|||p|||i|{props}|u"


def run(spark, lines):
    raw = spark.createDataFrame([(i, f, x, "clash") for i, (f, x) in enumerate(lines)], "record_id long, feed string, line string, rank string")
    ranks = spark.createDataFrame(RANKS, "feed string, rank string")
    return {r["record_id"]: r["reason"] for r in rec.failures(raw, ranks).collect()}, raw, ranks


FLORAVEG = [
    ("A b|SPE|accepted||1", None), ("A b||x|C d|2\r", None), (' "A | b" | SPE |x|""|3', None), ('"A ""b"" c"||x||4', None), ('"A\nb"||x||5', None), ("A b|spe|x||6", "value"), ("|SPE|x||7", "value"), ('""||x||8', "value"),
    ("A b||x|C 4|9", "value"), ("A b||x|-|10", "value"), ("A b||x|× C d (L.) & M, 'x'|11", None), ("A b||x||", "value"), ("A b||x||1.5", "value"), ("A b||x||٣", "value"), ("A b||x|12", "columns"), ("", "columns"), ("a|b|c|d|e|f", "columns"),
    ('"A b||x||13', "quoting"), ('A "b"||x||14', "quoting"), ('"A" b||x||15', "quoting"), ('"A"b"||x', "quoting"), ('A b||x|"|16', "quoting"), ('"A b"|"SPE"|"x"|"C d"|"17"', None), (None, "columns"), ('"""A"""||x||18', None), ("A\nb||x||19", "quoting"),
]
WCVP = [
    ("12345678" + TAIL.format(rank="species", props='{"powoid":"1"}'), None), (" 12345678 " + TAIL.format(rank="", props=""), None), ("1234567" + TAIL.format(rank="", props=""), "value"), ("12345678" + TAIL.format(rank="Order", props=""), "value"),
    ("12345678" + TAIL.format(rank="", props="[1]"), "value"), ("12345678" + TAIL.format(rank="", props='{"a":NaN}'), "value"), ("12345678" + TAIL.format(rank="", props='{"a":1} x'), "value"), ("12345678" + TAIL.format(rank="", props="{'a':1}"), "value"),
    ("12345678" + TAIL.format(rank="GENUS", props='{"a":"say \\"x\\""}'), None), ('12345678|"Fam' + TAIL.format(rank="", props="")[4:], None), ("12345678|x", "columns"),
]


def test_reasons(spark):
    lines = [("floraveg_sample", x) for x, _ in FLORAVEG] + [("wcvp_taxon", x) for x, _ in WCVP] + [("other", "x"), (None, "x")]
    want = [w for _, w in FLORAVEG + WCVP] + ["columns", "columns"]
    got, raw, ranks = run(spark, lines)
    assert {i: got.get(i) for i in range(len(lines))} == dict(enumerate(want))
    rows = {r["record_id"]: r for r in rec.valid(rec.check(raw, ranks, rec.FLORAVEG)).collect()}
    assert rows[2]["taxon"] == "A | b" and rows[2]["accepted_taxon"] is None and rows[3]["taxon"] == 'A "b" c' and rows[1]["source_id"] == "2" and rows[24]["taxon"] == '"A"'
    assert len(rows) + sum(1 for i in got if i < len(FLORAVEG)) == len(FLORAVEG)


def test_very_long_and_empty(spark):
    long = '"' + 'x""' * 200_000 + '"'
    got, _, _ = run(spark, [("floraveg_sample", f"{long}||x||1"), ("floraveg_sample", "A" * 3_000_000 + "||x||1"), ("floraveg_sample", '"' * 100_001)])
    assert got == {2: "quoting"}
    assert run(spark, [])[0] == {}


@pytest.mark.parametrize("text", ['{"a":' * 50_000 + "1" + "}" * 50_000, '{"a":[1,2.5e3,true,null,"x",{}]}', "{}", '{"a":1,}', '{"a" 1}', "{1:2}", '{"a":"\n"}', "", "{", '{"a":01}', '{"a":' * 9 + "[" + "]" + "}" * 9])
def test_strict_object(text):
    try:
        want = isinstance(json.loads(text), dict)
    except RecursionError:
        want = True
    except ValueError:
        want = False
    assert rec._strict_object(text) == want
    if text:
        assert rec._deep_object(text) == want
