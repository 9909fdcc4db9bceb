"""The outline of a page: intervals over one text, linear in the page."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storelens.functions import dom, outline
from storelens.operators import products, relations

WANTED, WORDS, PARTS = (outline.re.compile(p, outline.re.I) for p in (relations.WANTED, relations.POLICY_WORDS, relations.PARTS))


def read(page):
    return outline.outline_page(page, WANTED, frozenset(relations.WITHIN_TAGS), WORDS, PARTS)


def size(found):
    return pa.array([found], type=outline.ARROW).nbytes


def flat(n):
    return "<div class='product-grid'>" + "".join(f"<div class='product-card'><h3>Lamp {i}</h3><span class='price'>$1</span></div>" for i in range(n)) + "</div>"


def nested(n):
    return "".join(f"<div class='product-card'><h3>Lamp {i}</h3>" for i in range(n)) + "</div>" * n


@pytest.mark.parametrize("shape", [flat, nested])
def test_bytes_and_time_grow_with_the_page(shape):
    sizes, times = [], []
    for n in (1000, 4000):
        began = time.process_time()
        sizes.append(size(read(shape(n))))
        times.append(time.process_time() - began)
    assert sizes[1] < 4.5 * sizes[0] and sizes[1] < 12 * len(shape(4000)) + 200 * 3 * 4000 and times[1] < 9 * times[0] + 0.2


@pytest.mark.parametrize("page", ["<a " * 40_000, "<p class='" * 40_000, "<div class='product'>" * 5000 + "<li>" * 5000, "<" * 100_000, "<dt>" + "<b>" * 4000 + "<h2></h2>" * 4000])
def test_odd_pages_take_no_square_of_their_length(page):
    began = time.process_time()
    read(page)
    assert time.process_time() - began < 5


def test_pieces_hold_the_markup_once():
    page = "<main class='faq'>a<div class='faq-item'>b<h3>c?</h3>d<p>e</p>f</div>g</main>h"
    found = read(page)
    assert "".join(found["pieces"]) == page[page.index("a<div") : page.index("</main>")]
    inner = {(e["tag"]): "".join(found["pieces"][e["start"] : e["stop"]]) for e in found["elements"]}
    assert inner == {"main": "a<div class='faq-item'>b<h3>c?</h3>d<p>e</p>f</div>g", "div": "b<h3>c?</h3>d<p>e</p>f", "h3": "c?", "p": "e"}
    assert [(e["seq"], e["last"], e["parent"], e["depth"]) for e in found["elements"]] == [(1, 4, 0, 0), (2, 4, 1, 1), (3, 3, 2, 2), (4, 4, 2, 2)]


@pytest.mark.parametrize("depth", [3, dom.CLIMBED, dom.CLIMBED + 40])
def test_owners_are_the_elements_around(pages, depth):
    page = "<i class='product'></i>".join(f"<div class='product-{i}'>" for i in range(depth)) + "<a href=/p>x</a>" + "</div>" * depth
    found = relations.page_blocks(pages(("https://s.com/", page)))
    around = found.select(F.explode(F.transform("dom", lambda e: F.struct(e["tag"].alias("tag"), F.transform(dom.owners(F.col("dom"), e), lambda o: o["opener"]).alias("o"))))).select("col.*")
    got = {r.tag: r.o for r in around.collect() if r.tag == "a"}
    assert got == {"a": [f"<div class='product-{i}'>" for i in range(depth)]}
    assert all(len(r.o) <= depth for r in around.collect())


def test_nested_cards_are_products(pages):
    found = products.products_from_cards(pages(("https://s.com/", nested(300)))).collect()
    assert {r.name for r in found} == {f"Lamp {i}" for i in range(300)}


def test_pieces_go_through_no_exchange(pages):
    found = products.union_products(pages(("https://s.com/", flat(3))))
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and not any("pieces" in line for line in exchanges)


def test_outlines_become_one_array_column_by_column():
    """Same array as from nested rows; what was said of an opening tag is kept for short ones only."""
    import re

    import pyarrow as pa

    from storelens.functions import outline as module

    said = re.compile("card|faq", re.I)
    html = '<div class="faq"><h2>Q</h2>t<p>x</p></div><div class="card"><h3>A</h3></div><div class="card"></div>'
    for wanted in (said, module.Remembered(said), module.Remembered(said, longest=3)):
        page = module.outline_page(html, wanted, frozenset(), re.compile("(?!)"), said)
        empty = module.outline_page("", wanted, frozenset(), re.compile("(?!)"), None)
        for outlines in ([], [None], [page, None, empty, page], [empty]):
            built = module.as_arrow(outlines)
            built.validate(full=True)
            assert built.to_pylist() == pa.array(outlines, type=module.ARROW).to_pylist()
    held = module.Remembered(said, longest=3)
    assert not held.search("abc") and held.search("<card>") and held._known.cache_info().currsize == 1
