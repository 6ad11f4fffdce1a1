"""Cases that earlier versions got wrong."""

import random

from cedarlog.llm import html_extract, toxicity
from tests.llm.test_llm import frame, prose

LONG = "All the text of the page is here and is kept. " * 4


def test_elements_whose_end_tag_is_missing_take_no_text_along():
    text = html_extract.main_text
    assert text(f"<datalist id=x><option value=a><option value=b></datalist><p>{LONG}") == LONG.strip()
    assert text(f"<select><option>One<option>Two</select><p>{LONG}") == LONG.strip()
    assert text(f"<option>One<option>Two<p>{LONG}") == LONG.strip()
    assert text(f"<button>Go<p>{LONG}") == LONG.strip()
    assert text(f"<p>{LONG}<button>Copy</button> and after it</p>") == f"{LONG.strip()}\n\nand after it"


def test_class_words_inside_an_article_and_notices():
    page = f"<article><p>{LONG}</p><div class='share-price'><p>A share rose.</p></div><div class='side-note ad-hoc'>Done ad hoc.</div><div class='share-buttons'>Tweet</div><div class='site-newsletter'>Sign up</div></article>"
    assert html_extract.main_text(page) == f"{LONG.strip()}\n\nA share rose.\n\nDone ad hoc."
    notice = f"<div class='cookie-notice'><p>{'We use cookies. ' * 40}</p><p>{'More of them. ' * 40}</p></div><p>{LONG}</p>"
    assert html_extract.main_text(notice) == LONG.strip()


def test_the_fit_takes_a_bounded_number_of_rows_of_one_id(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, prose(rng, 30) + (" moron" if i % 3 == 0 else "")) for i in range(60)]
    rows += [(1, prose(rng, 20)) for _ in range(500)] + [(3, rows[3][1])] * 700
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    seen = []
    logistic = toxicity._logistic
    monkeypatch.setattr(toxicity, "_logistic", lambda rows, *rest: seen.append(len(rows)) or logistic(rows, *rest))
    docs = frame(spark, rows)
    toxicity.fit_toxicity(docs, labels, bound=100)
    toxicity.fit_toxicity(docs, labels, bound=10_000)
    assert seen[0] <= 100 and 500 < seen[1] <= 560  # equal rows count once
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, bound=10_000))
    assert scored.count() == len(rows)
    long = frame(spark, [(1, "moron " * 400_000), (2, None)])
    assert toxicity.score_toxicity(long, toxicity.fit_toxicity(docs, labels)).count() == 2
