"""Licence notices wrapped over lines, as file headers have them."""

import textwrap

import pytest

from tidewright.llm import licenses
from tidewright.llm.queries import QUERIES

PROSE = ["The river rose in the night and the bridge was closed.", "Nobody in the village had seen so much water before."]
LONG = [(f, t) for f, texts in licenses.TEMPLATES.items() for t in texts if len(t) > 72]


@pytest.fixture(scope="module")
def model():
    return licenses.train(PROSE * 50)


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "-- "])
@pytest.mark.parametrize("width", [40, 72])
def test_wrapped(model, mark, width):
    for family, text in LONG:
        header = [mark + x for x in textwrap.wrap(text, width)]
        for before, after in (([], []), ([*PROSE, mark.strip()], [mark.strip(), *PROSE]), (PROSE, PROSE)):
            found = [x for x in model.findings("\n".join([*before, *header, *after])) if x[4]]
            assert [(x[0], x[1]) for x in found] == [(len(before), family)], (family, mark, found)


def test_two_families_and_repeats_in_one_paragraph(model):
    texts = dict(LONG)
    mit, gpl = (textwrap.wrap(texts[f], 60) for f in ("MIT", "GPL-3.0"))
    found = model.findings("\n".join([*mit, *gpl, *mit]))
    assert [(x[0], x[1], x[4]) for x in found] == [(0, "MIT", True), (len(mit), "GPL-3.0", True), (len(mit) + len(gpl), "MIT", True)]
    one = "Released under the MIT License."
    assert [x[:2] for x in model.findings(f"{one}\n{PROSE[0]}\n{one}\n{one}")] == [(0, "MIT"), (2, "MIT"), (3, "MIT")]


def test_query(spark, tmp_path):
    rows = [(i, "\n".join([*PROSE, "", *textwrap.wrap(t, 72), "", *PROSE])) for i, (_, t) in enumerate(LONG)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["families"], r["findings"], r["confirmed"], r["first_line"]) for r in QUERIES["op7_license_scan"](spark, str(tmp_path)).collect()}
    assert got == {i: (f, 1, 1, 3) for i, (f, _) in enumerate(LONG)}
