import pytest

from strandloom.llm import html_extract as H
from tests.llm.test_html import P, Q


def text_of(source, **kwargs):
    return "\n".join(" ".join(text.split()) for _, _, text in H.parse(source, **kwargs).texts if text.strip())


LISTS = "<datalist id=d><option value=a><option value=b></datalist>"


@pytest.mark.parametrize(
    "dropped",
    [LISTS, "<datalist><option>one<option>two</option></datalist>", "<div><object data=x><p>instead</div>", "<div><iframe src=x></div>", "<div><svg><path d=x></div>",
     "<object><object>x</object>y</object>", "<template><div></template>", "<select><option>a<option>b</select>", "<option>a", "<noscript><style>x</noscript></style></noscript>"],
)
def test_text_after_dropped_elements_stays(dropped):
    assert text_of(f"<article>{dropped}<p>{P}</p>{dropped}<p>{Q}</p></article>") == f"{P}\n{Q}"


def test_raw_text_without_end_goes_to_the_end():
    for tag in ("script", "style", "textarea", "title"):
        assert text_of(f"<div>{P}</div><div><{tag}>x</div><p>{Q}</p>") == P


def test_many_options(spark):
    source = "<div>" * 200 + "<option>a" * 20_000 + "<template><b>" * 5000 + f"</i></div><p>{P}</p>"
    assert text_of(source) == P


@pytest.mark.parametrize("value", ["Price", "content", "boiler", "frame", ""])
def test_labels_of_extracted_pages_do_nothing(spark, value):
    model = H.default_model(spark)
    page = '<article><h1>T</h1><p>{}</p><table><tr><td{}>4.2</td></tr></table></article>'
    given = [(0, "u", page.format(P, f' data-label="{value}"')), (1, "u", page.format(P, ""))]
    a, b = (r["text"] for r in H.extract(spark.createDataFrame(given, "page_id long, url string, html string"), model).orderBy("page_id").collect())
    assert a == b and P in a


def test_unknown_labels_of_labelled_pages_are_ignored():
    labels = H.parse("<p data-label=content><b data-label=Price>x</b></p><div data-label=boiler>", labelled=True).labels
    assert labels == [0, 1, 1, 2] and H.parse("<p data-label=content>").labels == [0, 0]
