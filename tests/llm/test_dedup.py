import random

import duckdb
import numpy as np
import pytest

from parcelwise.llm import jaccard_join, language_id, line_dedup, substring_dedup

from .conftest import prose


def brute_components(texts, size, percent):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in texts]
    label = [i for i, _ in texts]
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(s), c) for (i, _), s, c in zip(texts, sets, label)}


def near_copies(seed, n, edits, words=200, first=0):
    r, base, out = random.Random(seed), prose(seed, words).split(" "), []
    for k in range(n):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        out.append((first + k, " ".join(w)))
    return out


@pytest.mark.parametrize("size,percent,paired", [(3, 90, 64), (5, 80, 64), (3, 90, 4)])
def test_components_against_brute_force(make, monkeypatch, size, percent, paired):
    monkeypatch.setattr(jaccard_join, "PAIRED", paired)
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    hot = prose(1, 60)
    texts = near_copies(3, 40, 9) + near_copies(4, 12, 14, first=100) + [(200 + k, hot + " " + prose(500 + k, 3)) for k in range(30)] + [(300 + k, prose(900 + k, 40)) for k in range(10)]
    texts += [(400, ""), (401, "one"), (402, "ONE"), (403, "two words"), (404, None)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(make(texts), size, percent).collect()}
    assert got == brute_components(texts, size, percent)


def test_join_of_odd_rows(make, odd):
    got = jaccard_join.jaccard_components(make(odd)).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[5].component_id == 4 and by[4].component_id == 4 and by[2].n_shingles == 0 and by[2].component_id == 2 and by[8].n_shingles == 1
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard_join.jaccard_components(make([])).count() == 0
    kept = jaccard_join.keep_one(make(odd))
    assert kept.columns == make(odd).columns and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 4, 6, 7, 8, 9, 10, 11]
    assert jaccard_join.keep_one(make([])).count() == 0


def test_divide_skip_against_counting():
    r = random.Random(2)
    for percent in (50, 70, 90):
        sets = [np.array(sorted(r.sample(range(60), r.randrange(8, 30))), np.uint64) for _ in range(60)]
        block = jaccard_join.Block(sets)
        for q in sets:
            need = jaccard_join.least_overlap(len(q), percent)
            assert sorted(block.search(q, percent)) == [k for k, s in enumerate(sets) if len(set(q.tolist()) & set(s.tolist())) >= need]


def test_line_dedup_against_sql(make, spark):
    common = "Subscribe to our daily letter now"
    texts = []
    for k in range(60):
        lines = prose(k, 30).split("\n") + ([common + " \t"] if k % 4 else []) + (["Only nine sites say this"] if k < 9 else ["Ten sites say this"] if k < 20 else []) + ["", "Hi."]
        texts.append((k, "\n".join(lines), "en", f"s{k % 12 if k >= 20 else k % 10}"))
    docs = make(texts)
    got = {r.doc_id: (r.text, r.gone) for r in line_dedup.remove_spread_lines(docs, count_col="gone").select("doc_id", "text", "gone").collect()}
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    assert got == {a: (b, c) for a, b, c in con.sql(line_dedup.SQL).fetchall()}
    assert sum(g for _, g in got.values()) > 40 and common in got[1][0] and common not in got[2][0]


def test_line_dedup_of_odd_rows(make, odd):
    docs = make(odd)
    out = line_dedup.remove_spread_lines(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert line_dedup.remove_spread_lines(make([])).count() == 0


def test_clashing_names(make):
    """A column of the name of an own result column is replaced by it; all others stay."""
    docs = make([(k, f"{prose(k, 20)}\none line for all of them here", "en", f"s{k}") for k in range(12)])
    docs = docs.select("*", *[docs["_x"].alias(c) for c in ("Removed_Lines", "removed", "keeper", "h1", "sites", "digest", "earlier", "first", "a.b", "x`y")])
    out = line_dedup.remove_spread_lines(docs, count_col="removed_lines")
    assert out.columns == [c for c in docs.columns if c != "Removed_Lines"] + ["removed_lines"]
    assert sorted(r.removed_lines for r in out.select("removed_lines").collect()) == [0] + [1] * 11
    out = substring_dedup.remove_repeats(docs, spans_col="removed")
    assert out.columns == [c for c in docs.columns if c != "removed"] + ["removed"] and out.count() == 12
    assert line_dedup.remove_spread_lines(docs).columns == docs.columns == substring_dedup.remove_repeats(docs).columns
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 12


def test_passages_inside_lines_go_but_first(make):
    passage = prose(77, 55).replace("\n", " ")
    texts = [(k, prose(k, 40) + " begin " + (passage if k % 2 else "") + " end " + prose(100 + k, 40)) for k in range(12)]
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(make(texts), spans_col="gone").collect()}
    core = " ".join(passage.split()[20:35])
    flat = lambda t: " ".join(t.split())
    assert core in flat(out[1].text)
    for k, text in texts:
        if k % 2 == 0:
            assert out[k].text == text and out[k].gone == []
        elif k > 1:
            assert core not in flat(out[k].text)
            assert flat(prose(k, 40)) in flat(out[k].text) and flat(prose(100 + k, 40)) in flat(out[k].text)
            cut = [text.encode()[s.start : s.end].decode() for s in out[k].gone]
            assert sum(len(c.split()) for c in cut) >= 35 and all(flat(c) in flat(f"begin {passage} end") for c in cut)


def test_only_passages_that_stand_earlier_as_a_whole_go(make):
    r = random.Random(11)
    few = prose(5, 40).split()
    texts = [(k, " ".join(r.choice(few) for _ in range(300))) for k in range(40)]  # all short units stand somewhere earlier, no 16 words in a row do
    copied = " ".join(texts[3][1].split()[50:150])
    texts.append((40, " ".join(r.choice(few) for _ in range(60)) + " " + copied + " " + " ".join(r.choice(few) for _ in range(60))))
    out = {x.doc_id: x for x in substring_dedup.remove_repeats(make(texts), spans_col="gone").collect()}
    for k, text in texts[:-1]:
        assert out[k].text == text and out[k].gone == []
    text = texts[-1][1].encode()
    cut = [text[s.start : s.end].decode() for s in out[40].gone]
    assert len(cut) == 1 and cut[0] in copied and len(cut[0].split()) > 70


@pytest.mark.parametrize("min_words", [4, 16])
def test_removed_units_against_brute_force(min_words):
    r = random.Random(3)
    few = prose(6, 30).split()
    for _ in range(30):
        a, b = ([r.choice(few) for _ in range(r.randrange(1, 120))] for _ in range(2))
        at = r.randrange(len(b))
        b = b[:at] + a[r.randrange(len(a)) :][: r.randrange(60)] + b[at:]
        old, new = " ".join(a).encode(), " ".join(b).encode()

        def spans(text):
            sizes = substring_dedup.units(text)[1]
            return np.concatenate([[0], np.cumsum(sizes)]).tolist()

        plain = lambda w, x, y: tuple(v.lower().strip(".") for v in w[x:y])
        edges, cuts = spans(old), spans(new)
        known = {plain(a, x, y) for x in edges for y in edges if y - x >= min_words}
        gone = set()
        for i, x in enumerate(cuts):
            for y in cuts[i:]:
                if y - x >= min_words and (plain(b, x, y) in known or any(plain(b, u, u + y - x) == plain(b, x, y) for u in cuts[:i] if u + y - x in cuts)):
                    gone |= set(range(x, y))
        hashes, sizes, starts, ends = substring_dedup.units(new)
        found = substring_dedup.removed_spans(new, substring_dedup.sequences(*substring_dedup.units(old)[:2], min_words)[0], min_words)
        words = [m for k, m in enumerate(np.cumsum([0] + [len(w) + 1 for w in b[:-1]]))]
        assert {k for k, at in enumerate(words) if any(s <= at < e for s, e in found)} == gone


def test_substring_dedup_of_odd_rows(make, odd):
    docs = make(odd)
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(odd)
    by = {r.doc_id: r.text for r in out.collect()}
    assert by[4] == prose(4) and by[5] == "" and by[1] is None and by[2] == "" and by[9] == odd[10][1]
    assert substring_dedup.remove_repeats(make([])).count() == 0
