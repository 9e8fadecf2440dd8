"""Page text: attributes, lists of links in articles, elements of other namespaces, and accuracy by class on pages of two generators."""

from collections import Counter

import pytest

from tribuna.llm import pagetext as P

TEXT = "A sentence of the article that is long enough to be read as what the page is about."
ARTICLE = f"<h1>A title of the page</h1><p>{TEXT}</p><p>{TEXT} Again.</p>"


@pytest.fixture(scope="module")
def model():
    return P.fit()


def lines(body, model):
    return P.main_text(f"<html><head><title>x</title></head><body>{body}</body></html>", model).split("\n")


def test_other_attributes_are_no_class_words(model):
    for attrs in ('data-id="comment-ad"', 'data-class="cookie"', 'aria-role="navigation"', 'title="class=comment hidden "', "data-hidden", 'alt="display:none"', 'x:id="footer"'):
        assert lines(f"<article>{ARTICLE}<p {attrs}>This stays in the text.</p></article>", model)[-1] == "This stays in the text.", attrs
    assert list(P.attribute_words(' CLASS = "a-b c" id=d data-id="e" role=\'f\' hidden')) == ["a", "b", "c", "d", "f", "hidden"]
    assert list(P.attribute_words(' style="color:red; DISPLAY : none"')) == ["hidden"]
    assert "hidden" in list(P.attribute_words(' style="color:red;display: none"')) and "hidden" not in list(P.attribute_words(' data-style="display:none"'))


def test_sources_of_an_article_stay_and_menus_go(model):
    sources = "<ul><li><a href=a>A study of some things and others in 2019</a></li><li><a href=b>Another report on what was found</a></li></ul>"
    got = lines(f"<nav><ul><li><a href=x>Home</a><li><a href=y>About us</a></ul></nav><article>{ARTICLE}<h3>Sources</h3>{sources}</article>", model)
    assert got[-3:] == ["Sources", "A study of some things and others in 2019", "Another report on what was found"] and got[0] == "A title of the page"


def test_elements_of_other_namespaces(model):
    got = lines(f"<my-nav><a>Home</a> <a>About</a></my-nav><site-header>Name of the site</site-header><article>{ARTICLE}<p>An <x-term>inline</x-term> word.</p></article>", model)
    assert got == ["A title of the page", TEXT, f"{TEXT} Again.", "An inline word."]
    nodes = P.parse("<my-box><p>a</p><my-box>b</my-box>c</my-box>d</never-opened>e")
    assert [(x.tag, [t for _, t in x.texts]) for x in nodes] == [("#root", ["de"]), ("my-box", ["c"]), ("p", ["a"]), ("my-box", ["b"])]


@pytest.mark.parametrize("make", [P.labelled_pages, P.labelled_sheets])
def test_accuracy_by_class(model, make):
    """Pages of another seed: text blocks of articles, of their lists, and of everything else."""
    right, seen = Counter(), Counter()
    for page, labels in make(250, 4711):
        nodes = P.parse(page)
        assert len(nodes) == len(labels) + 1
        for x, p, label in zip(nodes[1:], P.marginals(nodes, model)[1:], labels):
            if x.texts:
                kind = (label, "links" if x.linked == x.chars else "list" if x.tag in ("li", "dd", "td") else "text")
                seen[kind] += 1
                right[kind] += (p > 0.5) == label
    assert sum(right.values()) / sum(seen.values()) >= 0.95
    for kind, n in seen.items():
        assert n < 40 or right[kind] / n >= 0.80, (kind, right[kind] / n, n)
