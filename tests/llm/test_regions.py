"""The scan against all regions, what stands at the edges of content, and odd pages."""

from __future__ import annotations

import random
import time

import pytest

from docketry.llm import regions

PARAGRAPH = "<p>" + " ".join(f"word{i}" for i in range(80)) + ".</p>"
MENU = '<div class="x1"><a href="a">Menu one</a> <a href="b">Menu two</a></div>'
FOOT = '<div class="x2"><p>Foot words that every page repeats at its end</p></div>'


@pytest.fixture(scope="module")
def weight():
    """Weights of pages that label their article; x1 and x2 are in no list."""
    pages = [f"<html><body>{MENU}<article><h1>Title {i}</h1>{PARAGRAPH}<ul><li>one<li>two</ul></article>{FOOT}</body></html>" for i in range(30)]
    inside, outside = regions.Counter(), regions.Counter()
    for page in pages:
        a, b = regions.features(page)
        inside += a
        outside += b
    return regions.weights(inside, outside)


def test_the_scan_finds_the_first_best_region():
    rnd = random.Random(4)
    for _ in range(300):
        run = [("text", "w " * rnd.randint(0, 3), rnd.random() < 0.1, 0, rnd.choice([-2, -1, 0.5, 1, 2])) if rnd.random() < 0.6 else ("tag", "b", False, 0, 0.0) for _ in range(rnd.randint(0, 25))]
        worth = [-0.5 if k != "text" else (-1.0 if aside else w * len(v.split())) for k, v, aside, _, w in run]
        every = {(i, j): sum(worth[i:j]) for i in range(len(run)) for j in range(i + 1, len(run) + 1)}
        start, end = regions.scan(run, -0.5, -1.0)
        best = max([0.0, *every.values()])
        assert sum(worth[start:end]) == best and (best == 0 or end == min(j for (i, j), v in every.items() if v == best))


@pytest.mark.parametrize(("tail", "text"), [
    ("<ul><li>one<li>two<li>three</ul>", "one\ntwo\nthree"), ("<dl><dt>k<dd>v</dl>", "k\nv"), ("<table><tr><td>a<td>b<tr><td>c<td>d</table>", "a\nb\nc\nd"), ("<p>End.</p><hr><p>Fin.</p>", "End.\nFin."),
    ('<div class="share-price">The price rose</div>', "The price rose"), ('<section id="notice-of-law">By law</section>', "By law"), ('<table class="login-times"><tr><td>At nine</table>', "At nine"),
])
def test_content_goes_on_to_its_end_and_from_its_start(weight, tail, text):
    found = regions.extract(f"<html><body>{MENU}<article>{tail}{PARAGRAPH}{tail}</article>{FOOT}</body></html>", weight)
    assert found.startswith(f"{text}\nword0") and found.endswith(f"word79.\n{text}") and "Menu" not in found and "Foot" not in found


def test_asides_in_the_content_are_left_out(weight):
    holes = '<div class="advert">Buy now</div><nav>Go on</nav><form>Your name</form><section class="post comments">First!</section><div hidden>Unseen</div>'
    assert regions.extract(f"<body><article>{PARAGRAPH}{holes}<p>Last &amp; least.</p></article></body>", weight).endswith("word79.\nLast & least.")


def test_pages_without_content_elements(weight):
    found = regions.extract(f'<body>{MENU}<div class="new"><h2>Head of the text</h2>{PARAGRAPH}{PARAGRAPH}</div>{FOOT}</body>', weight)
    assert found.startswith("Head of the text\nword0") and found.endswith("word79.") and "Menu" not in found and "Foot" not in found


def test_deep_and_unclosed_markup_takes_time_in_proportion(weight):
    began = time.perf_counter()
    deep = "".join(f'<div class="c{i}">' for i in range(40_000)) + "words " * 50
    assert regions.extract(deep, weight).startswith("words") and regions.features("<article>" + deep)[0]["text"] == 50
    regions.extract("<button>x " * 40_000 + "<select>y " * 40_000, weight)
    assert time.perf_counter() - began < 30


def test_odd_pages(weight):
    assert [regions.extract(p, weight) for p in (None, "", "   ", "<", "<p", "<!-- never closed", "<script>x = 1", "</div></p>")] == ["", "", "", "<", "", "", "", ""]
