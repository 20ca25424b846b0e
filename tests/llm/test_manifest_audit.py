import collections
import hashlib
import itertools
import os
import zlib

import duckdb
import pytest

from parcelwise.llm import entry, filter_audit, merkle_manifest

from .conftest import SCHEMA, prose, rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(docs):
    """docs: rows of doc_id, text, lang, source, n_chars."""

    def leaf(d, more=0):
        doc_id, text, lang, source, n = d[:5]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in [doc_id, source, lang, None if n is None else n + more, text]))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][k : k + 2])) for k in range(0, len(levels[-1]), 2)])
        return levels

    def way(levels, k):
        out = []
        for level in levels[:-1]:
            run = [(j, x) for j, x in enumerate(level) if j // 2 == k // 2]
            out.append(([x for j, x in run if j < k], [x for j, x in run if j > k]))
            k //= 2
        return out

    groups = collections.defaultdict(list)
    for d in docs:
        groups[d[2]].append(d)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for held in groups.values():
        held.sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
    trees = {x: tree([leaf(d) for d in groups[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    root, out = top[-1][0], []
    for at, x in enumerate(langs):
        for k, d in enumerate(groups[x]):
            path = way(trees[x], k) + way(top, at)
            tampered = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
            h = leaf(d, int(tampered))
            for before, after in path:
                h = sha("".join(before) + h + "".join(after))
            out.append((d[0], leaf(d), trees[x][-1][0], root, sha("".join("".join(b + a) for b, a in path)), h, h == root))
    return sorted(out, key=repr)


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("digit", [4, 12])
def test_manifest_against_brute_force(spark, odd, digit):
    texts = odd + [(100 + 37 * k, f"text {k}", ["en", "fr", "de", None, "", "é"][k * k % 6], None if k % 5 == 0 else "s") for k in range(60)]
    texts += [(-5, "below"), (2**62, "far", "en", "s"), (-(2**63), "least", "en", "s"), (2**63 - 1, "most", "en", "s"), (77, "alone", "xx", "s")] + [(None, f"nameless {k % 4}") for k in range(9)] + [(300, "again")] * 20
    held = rows(texts)
    held += [(500, "no count", "en", "s0", None, "", 1, [1]), (7777, "most", "en", "s0", 2**63 - 1, "", 1, [1])]
    got = merkle_manifest.manifest(spark.createDataFrame(held, SCHEMA).repartition(3), digit).select(NAMES).collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(held)


def test_manifest_of_few_rows(spark, make):
    assert merkle_manifest.manifest(make([])).count() == 0
    one = merkle_manifest.manifest(make([(1, "x")])).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("")


def test_ranks_span_blocks(spark):
    """More than one block of the production width, ids far apart, and one group with most rows."""
    docs = [(k * 1_000_003, "t", "en" if k % 9 else "de", "s", 1) for k in range(9500)]
    got = merkle_manifest.manifest(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")).select(NAMES).collect()
    assert sorted(map(tuple, got), key=repr) == brute_manifest(docs)


def brute_audit(docs, labels):
    def fails(d):
        text = d[1] or ""
        words = [w for w in text.encode().split() if w]
        return {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= x <= "Z" for x in text) > 5 * len(text),
            "D": any(x in "#$%&*|" for x in text),
            "E": d[0] is not None and any((e[1] or "") == text and e[0] is not None and e[0] < d[0] for e in docs),
        }

    label = collections.defaultdict(set)
    for doc_id, quality, toxic in labels:
        label[doc_id] |= ({"good"} if quality == 1 else set()) | ({"toxic"} if toxic == 1 else set())
    told = [(d[3] or "", fails(d), label[d[0]] if d[0] is not None else set()) for d in docs]
    out = []
    for part in {t[0] for t in told}:
        held = [t for t in told if t[0] == part]
        orders = ["".join(p) for p in itertools.permutations("ABCDE")]
        removed = {(o, k): sum(f[o[k]] and not any(f[x] for x in o[:k]) for _, f, _ in held) for o in orders for k in range(5)}
        shapley = {x: sum(removed[o, o.index(x)] for o in orders) for x in "ABCDE"}
        for o in orders:
            for k, x in enumerate(o):
                before = [(f, any(f[y] for y in o[:k]), lab) for _, f, lab in held]
                here = [lab for f, gone, lab in before if f[x] and not gone]
                out.append((part, o, k + 1, sum(not gone and not f[x] for f, gone, _ in before), len(here), sum(gone and f[x] for f, gone, _ in before), sum(f[x] and sum(f.values()) == 1 for f, _, _ in before), sum("good" in lab for lab in here), sum("toxic" in lab for lab in here), shapley[x]))
    return sorted(out)


COUNTS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_against_brute_force(spark, make, odd):
    texts = [t for t in odd if not (t[1] or "").startswith("a" * 99)] + [(20 + k, prose(k % 7, 30 + 9 * (k % 7)) + ["", " #", " ABC DEF GHI JKL MNO PQR", ""][k % 4], "en", ["s0", "s1", None, ""][k % 4]) for k in range(40)]
    texts += [(200 + k, "same words " * (30 if k % 2 else 2), "en", f"s{k % 3}") for k in range(20)] + [(200, "same words " * 2, "en", "s1")] * 3 + [(None, "same words " * 2, "en", "s0")] * 2
    docs = rows(texts)
    labels = [(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(1, 230, 2)] + [(21, 1, None), (21, None, 1), (None, 1, 1), (22, None, None), (5000, 1, 1)]
    got = filter_audit.audit(make(texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).select(COUNTS).collect()
    assert sorted(map(tuple, got)) == brute_audit(docs, labels)


def test_audit_of_nothing(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(make([]), none).count() == 0
    assert filter_audit.audit(make([(1, None)]), none).filter("removed > 0").count() == 120


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_filter_audit"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
