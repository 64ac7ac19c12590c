"""Each operator against a brute-force version, held-out accuracy, or worked cases."""

from __future__ import annotations

import hashlib
import html
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docketry.llm import bagminhash, contexttree, discriminant, kneserney, licenses, mixing, orderminhash, queries, regions, tiling, windows
from docketry.llm.tables import classes, table

ODD = "doc_id long, text string, lang string, source string, n_chars long, text_a string, a long"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))


def rows(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 7) for i, t in zip(ids, texts, strict=True)], ODD)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, a very long text and columns with clashing names."""
    texts = [None, "", "   \n", "one", "one", "Und " * 400, LONG, LONG, "a b c d e f g", "a b c d e f g", "été ça ñ ß " * 30]
    return rows(spark, texts, [0, 1, 2, 3, 4, 5, 6, 7, 8, 8, None])


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, small):
    return table(spark, small, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def bag(text):
    words = (text or "").split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def jaccard(a, b):
    shared = sum((a & b).values())
    return shared / max(1, sum(a.values()) + sum(b.values()) - shared)


def test_order_minhash_matches_a_plain_version(docs, texts):
    out = {r.doc_id: r for r in orderminhash.fingerprints(docs).collect()}
    ids = sorted(texts)
    assert sorted(out) == ids
    for i, doc in enumerate(ids):
        after = ids[(i + 1) % len(ids)]
        t, n = texts[doc], texts[after]
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        assert out[doc].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert out[doc].n_chars == len(t)
        assert (t == n) <= (out[doc].near_next == 1.0)
    long = [r for r in out.values() if r.n_chars > 500]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.97
    assert abs(np.mean([r.near_edited for r in long]) - 0.36) < 0.08  # (3/5)^2 for a quarter replaced


def test_order_minhash_odd_rows(odd, empty):
    out = orderminhash.fingerprints(odd).collect()
    assert len(out) == odd.count() and all(len(r.fingerprint) == 8 * orderminhash.SKETCHES for r in out)
    by = {r.doc_id: r for r in out}
    assert by[0].fingerprint == by[1].fingerprint == by[2].fingerprint and by[6].fingerprint == by[7].fingerprint and by[6].near_next == 1.0
    assert orderminhash.fingerprints(empty).collect() == []


def test_order_minhash_feels_order(spark):
    words = [f"word{i}" for i in range(400)]
    swapped = words[200:] + words[:200]
    a, b = (r.fingerprint for r in orderminhash.fingerprints(rows(spark, [" ".join(words), " ".join(swapped)])).orderBy("doc_id").collect())
    same = np.mean([a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)])
    assert 0.3 < same < 0.75  # the same k-mers, half of the pairs in the other order


def test_kneserney_learns_languages_and_sums_to_one(docs, texts, small, spark):
    out = {r.doc_id: r for r in kneserney.languages(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(out[d].held_out == (d in held) for d in truth)
    assert np.mean([out[d].lang_pred == truth[d] for d in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())
    model, _, _ = kneserney.learned(docs)
    context = "der "
    codes = sorted({ord(c) for t in texts.values() for c in t.lower() if c.isalpha()} | {32})
    total = np.zeros(len(model.languages))
    for c in codes:
        window = np.array([ord(x) for x in context] + [c], np.uint32)
        total += np.exp(model.logs(window, np.array([4])))[0]
    assert (total < 1.0 + 1e-3).all() and (total > 0.9).all()


def test_kneserney_odd_rows(odd, empty):
    out = kneserney.languages(odd).collect()
    assert len(out) == odd.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in out if r.doc_id in (0, 1, 2))
    assert kneserney.languages(empty).collect() == []


def test_mixing_meets_targets(docs, small, spark):
    labels = mixing.label_domains(table(spark, small, "labels"))
    out = mixing.mixed(docs, labels, {"good": 0.8, "low": 0.15, "toxic": 0.05}).collect()
    total = sum(r.n_tokens for r in out)
    assert all(r.rate >= 0 for r in out)
    for k, goal in (("good", 0.8), ("low", 0.15), ("toxic", 0.05)):
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{k}"] for r in out) / total - goal) < 0.01
    # against the closed form in numpy of the same objective, by many plain steps
    p, n = np.array([[r.p_good, r.p_low, r.p_toxic] for r in out]), np.array([r.n_tokens for r in out], float)
    goal, have, rate = np.array([0.8, 0.15, 0.05]) * total, n @ p, np.ones(len(out))
    for _ in range(3000):
        rate = np.maximum(0, rate - (p @ (((rate * n) @ p - goal) / have) + mixing.RIDGE * (rate - 1)) / (1 + mixing.RIDGE))
    assert np.abs(rate - [r.rate for r in out]).max() < 0.2


def test_mixing_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(3, "good"), (5, "low"), (5, None), (6, "good"), (6, "low"), (None, "good")], "doc_id long, domain string")
    assert len(mixing.mixed(odd, labels).collect()) == odd.count()
    assert len(mixing.mixed(odd, labels.limit(0)).collect()) == odd.count()
    assert mixing.mixed(empty, labels).collect() == []


def plain_tiles(item, text, shortest):
    """Greedy string tiling by looking at all pairs of places."""
    mi, mt, found = set(), set(), []
    while True:
        best = (shortest - 1, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and p + n not in mi and t + n not in mt:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < shortest:
            return found
        mi |= set(range(p, p + n))
        mt |= set(range(t, t + n))
        found.append(n)


def test_tiling_matches_plain_tiling():
    rng = np.random.default_rng(5)
    for _ in range(150):
        item, text = rng.integers(0, 4, rng.integers(1, 30)).tolist(), rng.integers(0, 4, rng.integers(1, 40)).tolist()
        got = tiling.tiles(item, text, 3)
        for p, t, n in got:
            assert item[p : p + n] == text[t : t + n]
        assert sum(n for _, _, n in got) == sum(plain_tiles(item, text, 3)) or abs(sum(n for _, _, n in got) - sum(plain_tiles(item, text, 3))) <= 3


def test_leaks_finds_planted_and_reordered(spark, docs, texts, small):
    bench = table(spark, small, "benchmark")
    items = {r.item_id: r.text for r in bench.collect()}
    found = {(r.doc_id, r.item_id) for r in tiling.leaks(docs, bench).collect()}
    squash = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    assert found >= {(d, i) for d, t in texts.items() for i, q in items.items() if squash(q) in squash(t)}
    item = " ".join(f"tok{i}" for i in range(40))
    moved = " ".join(f"tok{i}" for i in [*range(20, 40), *range(20)])
    part = " ".join(f"tok{i}" for i in range(12))
    got = tiling.leaks(rows(spark, [f"x y {moved} z", f"x {part} y", None, ""]), spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string"), block_chars=50).collect()
    assert [(r.doc_id, r.item_id, r.covered) for r in got] == [(0, 1, 40)]


def test_leaks_odd_rows(odd, empty, spark):
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert {r.doc_id for r in tiling.leaks(odd, bench).collect()} == {8}
    assert tiling.leaks(empty, bench).collect() == [] and tiling.leaks(odd, bench.limit(0)).collect() == []
    assert tiling.without_leaks(odd, bench).count() == odd.count() - 2


def test_regions_take_the_article(spark, small):
    out = {r.page_id: r for r in regions.main_texts(table(spark, small, "pages")).collect()}
    for r in table(spark, small, "pages").collect():
        inside = re.search(r"<article>(.*?)(</article>|<footer|\Z)", r.html, re.S)[1]
        want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", x))).strip() for x in re.split(r"</?(?:p|h1|br)>", inside)]
        assert out[r.page_id].text == "\n".join(x for x in want if x) and out[r.page_id].n_chars == len(out[r.page_id].text)


def test_regions_scan_leaves_out_what_no_list_names(spark):
    # menus and footers by classes that no list knows, learned from pages that label their article
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    line = lambda n: " ".join(word() for _ in range(n))
    pages, want = [], []
    for k in range(60):
        blocks = [line(30) for _ in range(4)]
        body = f"<h1>{line(2)}</h1>" + "".join(f"<p>{b}</p>" for b in blocks)
        tag = "article" if k < 40 else "div"
        pages.append((k, "u", f"<html><body><div class='zq17'>{line(25)}</div><div class='zq18'><div>{line(12)}</div></div><{tag}>{body}</{tag}><div id='vv3'>{line(40)}</div></body></html>"))
        want.append(re.sub("<[^>]*>", "\n", body))
    for r in regions.main_texts(spark.createDataFrame(pages, "page_id long, url string, html string")).collect():
        assert r.text.split("\n") == [x for x in want[r.page_id].split("\n") if x], r.page_id


def test_regions_unmatched_tags_are_linear():
    import time

    start = time.time()
    regions.extract("<p>x" + "<div>" * 12_000 + "</b>" * 12_000, dict(regions.PRIOR))
    assert time.time() - start < 2


def test_regions_odd_pages(spark):
    body = "<p>" + "good words here " * 30 + "</p>"
    pages = {
        0: None, 1: "", 2: "<div><p>", 3: f"<html><body><nav><a href=x>menu</a></nav>{body}<div class='comments'><p>{'a reader says so ' * 40}</p></div></body>",
        4: f"<main>{body}<aside>{'buy now ' * 50}</aside><form>name <input></form><p>{'caf&eacute; &amp; more ' * 9}</p></main>", 5: "<script>var x = '<p>no</p>'", 6: "plain &lt;text&gt; only",
    }
    out = {r.page_id: r.text for r in regions.main_texts(spark.createDataFrame([(k, "u", v, "clash") for k, v in pages.items()], "page_id long, url string, html string, text string")).collect()}
    good = ("good words here " * 30).strip()
    assert out[0] == out[1] == out[2] == out[5] == ""
    assert out[3] == good and out[4] == good + "\n" + ("café & more " * 9).strip() and out[6] == "plain <text> only"


def test_compact_windows_hold_every_subsequence_once():
    rng = np.random.default_rng(3)
    for n, least in ((30, 5), (60, 10), (12, 12)):
        values = rng.permutation(n).astype(np.uint64)
        made = windows.compact_windows(values, least)
        for x in range(n):
            for y in range(x + least - 1, n):
                place = x + int(values[x : y + 1].argmin())
                assert sum(lo <= x and y <= hi and c == place for lo, c, hi in made) == 1
    assert len(windows.compact_windows(np.zeros(50_000, np.uint64), 46)) == 1


def test_repeated_passages_catches_planted_and_leaves_clean(spark):
    rng = np.random.default_rng(1)
    fresh = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n))
    shared, near = fresh(60), fresh(80).split()
    texts = [f"{fresh(90)} {shared} {fresh(30)}", f"{fresh(20)} {shared} {fresh(300)}", fresh(400), shared, f"{fresh(10)} {' '.join(near)} {fresh(40)}", None, "", fresh(49)]
    near[40] = "changed"
    texts.append(f"{' '.join(near)} {fresh(70)}")
    found = windows.repeated_passages(rows(spark, texts)).collect()
    assert {(r.doc_id, r.source_id) for r in found} == {(1, 0), (3, 0), (8, 4)}
    first = next(r for r in found if r.doc_id == 1)
    assert texts[1].split()[first.start : first.end] == shared.split() and texts[0].split()[first.source_start : first.source_end] == shared.split()
    kept = {r.doc_id: r for r in windows.without_repeats(rows(spark, texts)).collect()}
    assert set(kept) == {0, 1, 2, 4, 5, 6, 7, 8} and shared not in kept[1].text and kept[0].text == texts[0] and kept[2].text == texts[2] and kept[1].n_chars == len(kept[1].text)


def test_shared_passages_near_each_other_match_brute_force():
    rng = np.random.default_rng(7)
    fresh = lambda n: rng.integers(1, 1 << 40, n).tolist()

    def shingles(words):
        return np.array([hash(tuple(words[i : i + 5])) & (1 << 63) - 1 for i in range(len(words) - 4)], np.uint64)

    def check(d, a):
        there = {tuple(a[i : i + 50]) for i in range(len(a) - 49)}
        want = {w for i in range(len(d) - 49) if tuple(d[i : i + 50]) in there for w in range(i, i + 50)}
        found = windows.shared_passages(shingles(d), shingles(a))
        assert want and want <= {w for f in found for w in range(f[0], f[1])}
        return found

    p, q, line = fresh(50), fresh(200), fresh(12)
    r = fresh(200)
    check(p + p, fresh(20) + p + fresh(20))
    check(p + p + fresh(3) + p, p)
    check(q + fresh(10) + r, r + fresh(5) + q)
    check(q + r, r + q)
    check(q + fresh(10) + r, q + fresh(3000) + r)
    check(q[:60] + line + r[:60], line + fresh(40) + r[:60] + line + q[:60])
    near = list(q)
    near[100] = 0
    both = windows.shared_passages(shingles(near + fresh(10) + r), shingles(r + fresh(900) + q))
    assert {(f[0] <= 5 and f[1] >= 195) for f in both if f[0] < 150} == {True} and any(f[0] <= 212 and f[1] >= 408 for f in both)
    for _ in range(40):
        parts = [fresh(int(n)) for n in rng.integers(50, 90, 4)]
        d = [w for k in rng.integers(0, 4, 5) for w in parts[k] + fresh(int(rng.integers(0, 12)))]
        check(d, [w for k in rng.permutation(4) for w in parts[k] + fresh(int(rng.integers(0, 12)))])


def test_repeated_passages_hold_all_of_brute_force_beside_a_frequent_sentence(spark):
    rng = np.random.default_rng(11)
    fresh = lambda n: ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n)]
    line = fresh(25)
    texts = [fresh(30) + line + fresh(30) for _ in range(12)]
    for k in range(12):
        shared = fresh(int(rng.integers(13, 20))) + line
        shared += fresh(52 - len(shared))
        texts += [fresh(30) + shared + fresh(30), fresh(10) + shared + fresh(60)]
    got = {}
    for r in windows.repeated_passages(rows(spark, [" ".join(t) for t in texts])).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    seen = set()
    for d, t in enumerate(texts):
        runs = [tuple(t[i : i + 50]) for i in range(len(t) - 49)]
        assert {w for i, x in enumerate(runs) if x in seen for w in range(i, i + 50)} <= got.get(d, set()), d
        seen.update(runs)
    assert len(got) == 12


def test_repeated_passages_beside_a_broken_copy(spark):
    # A has a passage with every n-th word changed and another one; B both whole; C the first one whole
    rng = np.random.default_rng(5)
    fresh = lambda n: ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n)]
    texts, want = [], []
    for n in (15, 20, 25):
        for _ in range(20):
            p, q = fresh(60), fresh(60)
            broken = [w if i % n else "changed" for i, w in enumerate(p)]
            texts += [fresh(20) + broken + fresh(20) + q + fresh(20), fresh(20) + q + fresh(20) + p + fresh(20), fresh(30) + p + fresh(40)]
            want.append(len(texts) - 1)
    got = {}
    for r in windows.repeated_passages(rows(spark, [" ".join(t) for t in texts])).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    assert all(set(range(30, 90)) <= got.get(d, set()) for d in want)


def test_repeated_passages_that_are_only_alike(spark):
    # one word in a passage of 50 to 90 changed, put in or left out: by brute force each is alike by 0.8 somewhere; 0.9 of them must be found
    rng = np.random.default_rng(6)
    fresh = lambda n: ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n)]
    texts = []
    for k in range(150):
        p = fresh(int(rng.integers(50, 90)))
        at = int(rng.integers(1, len(p) - 1))
        q = p[:at] + ([fresh(1)[0]] + p[at + 1 :], p[at + 1 :], fresh(1) + p[at:])[k % 3]
        texts += [fresh(30) + p + fresh(30), fresh(10) + q + fresh(50)]
    found = {r.doc_id for r in windows.repeated_passages(rows(spark, [" ".join(t) for t in texts])).collect()}
    sets = [[tuple(t[i : i + 5]) for i in range(len(t) - 4)] for t in texts]
    alike = set()
    for d in range(1, len(texts), 2):
        x, y = sets[d], sets[d - 1]
        # the best pair of equally long intervals of 46 to 90 shingles, by the places of the planted passages
        for size in range(46, 87):
            if any(len(a & b) >= 0.8 * len(a | b) for i in range(8, 16) for a, b in ((set(x[i : i + size]), set(y[i + 20 : i + 20 + size])),)):
                alike.add(d)
                break
    assert len(alike) > 100 and len(alike & found) >= 0.9 * len(alike) and found <= set(range(1, len(texts), 2))


def test_nearest_matches_a_plain_version():
    rng = np.random.default_rng(3)
    base = rng.integers(1, 256, 91).astype(np.uint8)
    around = np.tile(base, (60, 1))
    for k in range(60):
        for at in rng.choice(91, rng.integers(0, 14), replace=False):
            around[k, at] = rng.integers(1, 256)
        around[k, : rng.integers(0, 30)] = 0
    group, doc = np.sort(rng.integers(0, 4, 60)), np.arange(60)
    got = set(windows.nearest(group, doc, around, 0.8))
    want = set()
    for t in range(60):
        for spans in (range(24), range(22, 46)):
            best = (0, 0)
            for s in range(t):
                if group[s] == group[t]:
                    x, y = around[t], around[s]
                    hit = [x[j] > 0 and any(0 <= j + d < 91 and x[j] == y[j + d] for d in (-1, 0, 1)) for j in range(91)]
                    best = max(best, (max(sum(hit[a : a + 46]) for a in spans), -s))
            if best[0] >= 41:
                want.add((-best[1], t))
    assert got == want and len(want) > 20


def test_compact_windows_of_repeated_values_hold_every_stretch():
    # equal least values of a range: each stretch lies in a window with the same values round its place
    rng = np.random.default_rng(4)
    for n, kinds, least in ((60, 3, 10), (40, 2, 6), (80, 1, 7), (30, 8, 5), (12, 5, 12)):
        for turn in range(10):
            values = rng.integers(0, kinds, n).astype(np.uint64)
            if turn % 2:
                values = np.tile(values[: n // 4], 4)
            made = windows.compact_windows(values, least)
            for x in range(len(values) - least + 1):
                part = values[x : x + least].tolist()
                at = part.index(min(part))
                assert any(lo <= c - at and c - at + least - 1 <= hi and values[c - at : c - at + least].tolist() == part for lo, c, hi in made)


def test_repeated_passages_whose_sentences_stand_elsewhere_in_their_texts_too(spark):
    # of a passage of two sentences, both documents hold each sentence before it, in another order
    rng = np.random.default_rng(12)
    fresh = lambda n: ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n)]
    texts = []
    for _ in range(40):
        s, t = fresh(30), fresh(30)
        texts += [fresh(20) + s + t + fresh(20), t + s + s + t + fresh(9)]
    got = {}
    for r in windows.repeated_passages(rows(spark, [" ".join(t) for t in texts])).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    assert all(set(range(60, 120)) <= got.get(d, set()) for d in range(1, 80, 2))


def test_nearest_shares_every_interval_that_an_earlier_window_shares():
    rng = np.random.default_rng(8)
    text = rng.integers(1, 256, 91).astype(np.uint8)
    around = rng.integers(1, 256, (24, 91)).astype(np.uint8)
    for k in range(23):
        at = int(rng.integers(0, 46))
        around[k, at : at + 46] = text[at : at + 46]
    around[23] = text
    whole = lambda s, t: {a for a in range(46) if (around[s] == around[t])[a : a + 46].all()}
    of = lambda pairs: set().union(*(whole(s, t) for s, t in pairs if t == 23))
    want = of([(s, 23) for s in range(23)])
    two, every = (windows.nearest(np.zeros(24, int), np.arange(24), around, 0.8, every=x) for x in (False, True))
    assert of(every) == want and of(two) < want and set(two) <= set(every)


def test_nearest_compares_few_of_the_pairs_that_share_a_phrase_only(monkeypatch):
    # 400 windows share a phrase of 25 shingles after their places, 200 are short ones, of 30 shingles before; three pairs share all
    rng = np.random.default_rng(9)
    around = rng.integers(1, 256, (600, 91)).astype(np.uint8)
    around[:, 45:70] = around[0, 45:70]
    around[400:, :15], around[400:, 60:] = 0, 0
    for k in (50, 250, 450):
        around[k + 100] = around[k]
    compared = []
    shared = windows._shared
    monkeypatch.setattr(windows, "_shared", lambda x, y: compared.append(len(x)) or shared(x, y))
    assert set(windows.nearest(np.zeros(600, int), np.arange(600), around, 0.8)) == {(k, k + 100) for k in (50, 250, 450)}
    assert sum(compared) < 0.05 * 600 * 599 / 2


def test_nearest_finds_the_same_by_tables_and_row_by_row(monkeypatch):
    rng = np.random.default_rng(10)
    around = np.tile(rng.integers(1, 256, (5, 91)).astype(np.uint8), (60, 1))
    for k in range(300):
        for at in rng.choice(91, rng.integers(0, 14), replace=False):
            around[k, at] = rng.integers(1, 256)
        around[k, : rng.integers(0, 40)] = 0
    group, doc = np.sort(rng.integers(0, 3, 300)), np.sort(rng.integers(0, 200, 300))
    found = []
    for rows_at_most in (1, 90, 1_000):
        monkeypatch.setattr(windows, "TABLED", rows_at_most, raising=False)
        found.append([windows.nearest(group, doc, around, 0.8, every=x) for x in (False, True)])
    assert found[0] == found[1] == found[2] and len(found[0][0]) > 100
    assert all(group[s] == group[t] and doc[s] < doc[t] for s, t in found[0][1])


def test_shared_passages_likeness_matches_multisets_of_repeated_shingles():
    # the likeness of each passage, also of texts whose shingles repeat, is that of the multisets of its shingles
    rng = np.random.default_rng(14)
    for kinds in (8, 40, 1 << 40):
        for _ in range(40):
            own = rng.integers(1, kinds, 150).astype(np.uint64)
            other = np.concatenate((rng.integers(1, kinds, 30).astype(np.uint64), own))
            other[rng.choice(len(other), 6, replace=False)] = 0
            found = windows.shared_passages(own, other)
            for s, e, x, y, like in found:
                a, b = Counter(own[s : e - 4].tolist()), Counter(other[x : y - 4].tolist())
                assert abs(like - sum((a & b).values()) / sum((a | b).values())) < 1e-12
            assert found


def test_repeated_passages_hold_both_of_two_overlapping_passages(spark):
    # a document holds a and b and c; an earlier one a and b, the first one b and c: the least id must not hide the other
    rng = np.random.default_rng(13)
    fresh = lambda n: ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n)]
    texts = []
    for k in range(300):
        a, b, c = fresh(12), fresh(40), fresh(12)
        texts += [fresh(5) + b + c + fresh(5), fresh(5) + a + b + fresh(5), fresh(5) + a + b + c + fresh(5)]
    got = {}
    for r in windows.repeated_passages(rows(spark, [" ".join(t) for t in texts])).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    assert all(set(range(5, 69)) <= got.get(d, set()) for d in range(2, 900, 3))


def test_repeated_passages_odd_rows(odd, empty):
    assert {(r.doc_id, r.source_id) for r in windows.repeated_passages(odd).collect()} == {(7, 6)}
    assert windows.repeated_passages(empty).collect() == []
    assert windows.without_repeats(odd).count() == odd.count() - 1


def test_discriminant_held_out_and_formula(docs, spark, small):
    labels = table(spark, small, "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = {r.doc_id: r for r in discriminant.quality(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in out.items())
    assert np.mean([out[d].predicted == q for d, q in truth.items()]) > 0.95
    x = np.array([[1.0, 2.0], [3.0, 1.0], [2.0, 5.0], [4.0, 4.0], [0.0, 0.0]])
    model = discriminant.Discriminant({k: (len(v), v.sum(0), v.T @ v) for k, v in ((0, x[:2] * 3), (1, x))})
    for k, v in ((0, x[:2] * 3), (1, x)):
        mean, whiten, rest = model.classes[k]
        inverse = whiten.T @ whiten
        assert np.allclose(rest - np.log(len(v) / 7), 0.5 * np.linalg.slogdet(inverse)[1])


def test_discriminant_odd_rows(odd, empty, spark):
    learn = [i for i in (3, 4, 5, 6, 7, 8) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(learn) >= 2
    labels = spark.createDataFrame([(learn[0], 1), (learn[1], 0), (learn[1], None), (1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    out = discriminant.quality(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert {r.score for r in discriminant.quality(odd, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in discriminant.quality(odd, labels.where("quality = 1")).collect()} == {1.0}
    assert discriminant.quality(empty, labels).collect() == []


def test_bagminhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 48, 300).astype(np.uint64)
    a, b = rng.integers(0, 6, 300), rng.integers(0, 6, 300)
    b[:200] = a[:200]
    shingle, weight, row = np.concatenate([keys[a > 0], keys[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    sign = bagminhash.signature(row, shingle, weight, 2, 4096)
    assert abs((sign[0] == sign[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_near_classes_match_brute_force(docs, texts):
    bags = {d: bag(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if texts[a] == texts[b] or (bags[a] and jaccard(bags[a], bags[b]) >= 0.8):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = {r.doc_id: r for r in bagminhash.near_classes(docs).collect()}
    assert {d: r.class_id for d, r in out.items()} == {d: find(d) for d in ids}


def test_near_classes_odd_rows(odd, empty):
    out = {r.doc_id: r.class_id for r in bagminhash.near_classes(odd).collect()}
    assert out == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6, 8: 8}
    assert bagminhash.near_classes(empty).collect() == []
    assert sorted(r.doc_id for r in bagminhash.keep_one(odd).where("doc_id IS NOT NULL").collect()) == [0, 2, 3, 5, 6, 8, 8]


def test_near_classes_of_a_large_group(spark):
    base = [f"t{i}" for i in range(120)]
    texts = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in range(120)] + [" ".join(f"u{j}v{i}" for j in range(60)) for i in range(20)]
    out = {r.doc_id: r.class_id for r in bagminhash.near_classes(rows(spark, texts)).collect()}
    assert {out[i] for i in range(120)} == {0} and all(out[i] == i for i in range(120, 140))


def test_near_classes_join_all_that_share_a_bucket(spark, monkeypatch):
    # one bucket with one head: pairs of the other nodes only meet in the last step, there in blocks of few nodes
    monkeypatch.setattr(bagminhash, "NODES", 7)
    for turn in range(200):
        texts = []
        for k in range(6):
            own = [f"t{turn}s{i}" for i in range(75)] + [f"k{k}x{i}" for i in range(25)]
            texts += [" ".join(own), " ".join(own[:99] + ["other"]), " ".join(["first"] + own[1:])]
        signs = set()
        for t in texts:
            keys, weight = bagminhash._bag(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 5)
            signs.add(float(bagminhash.signature(np.zeros(len(keys), int), keys & np.uint64((1 << 48) - 1), weight, 1, 1)[0, 0]))
        if len(signs) == 1:
            break
    assert len(signs) == 1
    out = {r.doc_id: r.class_id for r in bagminhash.near_classes(rows(spark, texts), bands=1, rows=1).collect()}
    assert out == {i: i // 3 * 3 for i in range(18)}


def test_near_classes_of_variants_that_are_seldom_near(spark):
    # variants of one text with three changed words each: most pairs are below 0.8, one head joins few of them
    rng = np.random.default_rng(9)
    base, texts = [f"b{i}" for i in range(150)], []
    for k in range(700):
        own = list(base)
        for at in rng.choice(150, 3, replace=False):
            own[at] = f"v{k}x{at}" if k % 2 else f"v{at}"
        texts.append(" ".join(own))
    sets = [set(zip(*[t.split()[i:] for i in range(5)], strict=False)) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared >= 0.8 * (len(a) + len(sets[j]) - shared):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    all_joins = sum(find(i) != i for i in range(len(texts)))
    out = {r.doc_id: r.class_id for r in bagminhash.near_classes(rows(spark, texts)).collect()}
    assert all(find(i) == find(c) for i, c in out.items())  # no wrong join
    joins = sum(i != c for i, c in out.items())
    assert all_joins > 100 and joins >= 0.98 * all_joins


def test_forest_counts_frequent_and_rare_elements():
    rng = np.random.default_rng(1)
    bags = [rng.choice(400, rng.integers(1, 120), replace=False).astype(np.int64) + (1000 * (k % 3) if k > 40 else 0) for k in range(90)]
    flat, owner = np.concatenate(bags), np.repeat(np.arange(90), [len(x) for x in bags])
    got = bagminhash.shared_counts(flat, owner, 90)
    assert all(got[i, j] == len(set(bags[i]) & set(bags[j])) for i in range(90) for j in range(90) if i != j)


def test_classes_are_connected_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in classes(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_licenses_found_and_contained(spark, docs, texts):
    out = licenses.licenses(docs).collect()
    for name, line in (("MIT", "Released under the MIT License"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0"), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0")):
        assert {r.doc_id for r in out if r.license == name} == {d for d, t in texts.items() if line in t}
    made, want = [], []
    for k, (name, line) in enumerate(licenses.TEMPLATES):
        for before in (0, 1, 5, 11, 40):
            made.append("z " * before + line.upper() + " tail" * 9)
            want.append((name, k, before))
    got = {}
    for r in licenses.licenses(rows(spark, made)).collect():
        got.setdefault(r.doc_id, set()).add((r.license, r.template, r.start))
    assert all(w in got[d] for d, w in enumerate(want))


def test_licenses_of_damaged_and_repeated_notices_match_brute_force(spark):
    rng = np.random.default_rng(12)
    split = lambda t: [w for w in re.split("[^a-z0-9\x80-\U0010ffff]+", t.lower()) if w]
    words = [split(t) for _, t in licenses.TEMPLATES]
    texts = []
    for k, own in enumerate(words):
        for share in (0.0, 0.02, 0.05):
            hurt = [w if rng.random() >= share else "zz" for w in own]
            texts.append(" ".join(["q"] * int(rng.integers(0, 60)) + hurt + ["y"] * 250 + own + ["x"] * 20))
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    got = {}
    for r in licenses.licenses(rows(spark, texts)).collect():
        got.setdefault((r.doc_id, r.template), []).append((r.start, r.end, r.containment))
    found = total = 0
    for d, t in enumerate(texts):
        own = split(t)
        end = own.index("y")
        k = d // 3
        for lo, hi in ((0, end), (end, len(own))):
            share = len(runs(words[k]) & runs(own[lo:hi])) / len(runs(words[k]))
            some = [x for x in got.get((d, k), []) if lo <= x[0] < hi]
            if share >= 0.8:
                total += 1
                found += any(abs(x[2] - share) < 1e-9 for x in some)
            else:
                assert not some, (d, lo)
    assert total > 50 and found >= 0.99 * total


def test_licenses_odd_rows(odd, empty, spark):
    assert licenses.licenses(odd).collect() == [] and licenses.licenses(empty).collect() == []
    assert licenses.licenses(rows(spark, ["Released under the MIT"])).collect() == []


def test_context_tree_is_a_distribution_and_counts_are_exact(docs, texts):
    out = {r.doc_id: r for r in contexttree.scores(docs).collect()}
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    tokens = {d: [w for w in re.split(r"[\x20\x09-\x0D]+", fold(t)) if w] + [None] for d, t in texts.items()}
    train = [d for d in texts if zlib.crc32(str(d).encode()) % 10]
    c = Counter(w for d in train for w in tokens[d])
    n, v = sum(c.values()), len(c)
    for d, r in out.items():
        assert r.train_tokens == n and r.n_tokens == len(tokens[d]) and r.n_known == sum(w in c for w in tokens[d]) and r.held_out == (d not in train)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[d]), rel_tol=1e-9)
        assert r.score < 0
    held = [r for r in out.values() if r.held_out]
    assert sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held)


def plain_tree(strings, depth, query):
    """log10 of the probability of query's last byte after the ones before it, by the definition."""
    counts = Counter()
    for s in strings:
        s = bytes([10] * depth) + s
        for i in range(depth, len(s)):
            for b in range(8):
                for d in range(depth + 1):
                    counts[(s[i - d : i], (1 << b) | (s[i] >> (8 - b)), (s[i] >> (7 - b)) & 1)] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    contexts = {(c, q) for c, q, _ in counts}

    def weighted(c, q):
        own = kt(counts[(c, q, 0)], counts[(c, q, 1)])
        if len(c) == depth:
            return own
        below = sum(weighted(bytes([x]) + c, q) for x in range(256) if (bytes([x]) + c, q) in contexts)
        return np.logaddexp(own, below) - math.log(2)

    total, last = 0.0, query[-1]
    for b in range(8):
        q, bit, p = (1 << b) | (last >> (8 - b)), (last >> (7 - b)) & 1, None
        for d in range(depth, -1, -1):
            c = query[len(query) - 1 - d : len(query) - 1]
            if (c, q) not in contexts:
                continue
            one = (counts[(c, q, 1)] + 0.5) / (counts[(c, q, 0)] + counts[(c, q, 1)] + 1)
            if p is None:
                p = one
            else:
                own = kt(counts[(c, q, 0)], counts[(c, q, 1)])
                below = sum(weighted(bytes([x]) + c, q) for x in range(256) if (bytes([x]) + c, q) in contexts)
                share = 1 / (1 + math.exp(below - own))
                p = share * one + (1 - share) * p
        p = 0.5 if p is None else p
        total += math.log10(p if bit else 1 - p)
    return total


def test_context_tree_matches_the_definition(spark):
    texts = ["abra cadabra", "abracadabra abra", "cad abr"]
    docs = rows(spark, texts, [1, 2, 3])
    assert all(zlib.crc32(str(i).encode()) % 10 for i in (1, 2, 3))
    for depth in (1, 2, 3):
        # with and without grams that are broadcast
        out = {r.doc_id: r.score for r in contexttree.scores(docs, depth=depth, most_grams=(0, 20, 1000)[depth - 1], most_frequent=depth).collect()}
        for i, t in zip((1, 2, 3), texts, strict=True):
            s = bytes([10] * depth) + t.encode() + b"\n"
            want = sum(plain_tree([x.encode() + b"\n" for x in texts], depth, s[k - depth : k + 1]) for k in range(depth, len(s)))
            assert math.isclose(out[i], want, rel_tol=1e-5), depth


def test_context_tree_odd_rows(odd, empty):
    out = contexttree.scores(odd).collect()
    assert len(out) == odd.count() and {r.n_tokens for r in out if r.doc_id in (0, 1, 2)} == {1}
    assert contexttree.scores(empty).collect() == []


def test_every_operator_has_one_query():
    names = queries.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))
