"""The line-block rule against a plain version, and markup that is hard to read."""

import numpy as np

from flowloom.llm import html_text
from flowloom.llm.html_text import main_text

P = "The quick brown fox jumps over the lazy dog and keeps running through the forest until night falls."


def plain_between(weights, window, surge):
    """Line by line: inside from a line with weight whose window reaches the threshold, until a window holds nothing."""
    sums = [sum(weights[k : k + window]) for k in range(len(weights))]
    least = min(surge, max(sums, default=0))
    kept, inside = [], False
    for w, s in zip(weights, sums):
        if inside and s == 0:
            inside = False
        elif not inside and least > 0 and w > 0 and s >= least:
            inside = True
        kept.append(inside)
    return kept


def test_surge_and_dive_match_a_plain_version():
    rng = np.random.default_rng(7)
    for _ in range(3000):
        n, window, surge = int(rng.integers(0, 25)), int(rng.integers(1, 6)), int(rng.integers(1, 150))
        weights = (rng.integers(0, 120, size=n) * (rng.random(n) < rng.random())).tolist()
        assert html_text.between(weights, window, surge).tolist() == plain_between(weights, window, surge)


def test_windows_decide_inside_an_article_too():
    share = "<p><a href=x>Share it</a></p>"
    page = f"<article>{share}<h1>Title</h1><p>{P}</p>{share}<p>{P}</p>{share * 4}<p>{P}</p>{share}</article>"
    assert main_text(page) == f"Title\n{P}\nShare it\n{P}\n{P}"
    assert main_text(page.replace("article>", "div>")) == f"Title\n{P}\nShare it\n{P}\n{P}"
    assert main_text(f"<article><p>{P}</p><ul><li><a>Share on X</a><li><a>Subscribe</a></ul><p>{P}</p></article>") == f"{P}\n{P}"


def test_only_an_article_with_the_weight_has_a_say():
    assert main_text(f"<!-- <main> --><script>'<article>'</script><div><p>{P}</p></div>") == P
    cards = "".join(f"<article><p>Card {k}</p></article>" for k in range(3))
    assert main_text(f"<div><p>{P}</p><p>{P}</p></div><p><a>x</a></p>" * 2 + cards).startswith(f"{P}\n{P}")
    assert main_text(f"<p>Two words</p><article><p>{P}</p><p>{P}</p></article><p>Another line</p>") == f"{P}\n{P}"
    assert main_text(f"<main><p>intro of {P}</p><article><p>{P}</p></article></main>") == f"intro of {P}\n{P}"


def test_stray_quotes_and_wrapping_forms():
    assert main_text(f'<p><a title=5">x</a></p><p>{P}</p>').endswith(P)
    assert main_text(f'<a title=5">x</a><p>{P}</p>') == P
    assert main_text(f"<div data-x=it's><p>{P}</p><p>it's</p><p>{P}</p></div>") == f"{P}\nit's\n{P}"
    assert main_text(f"<div title='a > b' data-y = \"c > d\"><p>{P}</p></div>") == P
    assert main_text(f"<form id=aspnetForm><p>{P}</p><p>{P}</p><p>{P}</p><label>Mail</label></form>") == f"{P}\n{P}\n{P}"
    assert main_text(f"<p>{P}</p><form><p>{P}</p><p>{P}</p><p>{P}</p></form>") == P
    assert main_text(f"<div class=has-sidebar><p>{P}</p><p>{P}</p><p>{P}</p><div class=sidebar>{P}</div></div>") == f"{P}\n{P}\n{P}"
    assert main_text(f"<p>{P}</p><p>1 < 2 and 3 > 2 <3</p>") == f"{P}\n1 < 2 and 3 > 2 <3"


def test_long_pages_repeated_rows_and_clashing_columns(spark):
    long = "".join(f"<p>{P} {k}</p>" for k in range(20_000))
    rows = [(1, "u", long, "was", 7, 1), (1, "u", long, "was", 7, 1), (None, None, f"<p>{P}" + "<b>" * 5000, None, None, 2), (3, "u", "<p>" + "x" * 3_000_000, None, None, 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, weight int")
    out = html_text.extract_main_text(pages)
    assert out.columns == ["page_id", "url", "weight", "text", "n_chars"]
    got = {r["weight"]: r for r in out.collect()}
    assert out.where("weight = 1").count() == 2 and out.where("page_id = 1").distinct().count() == 1
    assert got[1]["text"].count("\n") == 19_999 and got[2]["text"] == P and got[3]["n_chars"] == 3_000_000
