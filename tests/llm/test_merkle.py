from __future__ import annotations

import hashlib
import zlib

import pytest

from visiquarry.llm import merkle, queries

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def sha(x):
    return hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """(top, path of every node): path of (sibling or None, sibling is on the left)."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, joined = [], []
        for i in range(0, len(nodes), 2):
            pair = nodes[i : i + 2]
            for k in range(len(pair)):
                for x in groups[i + k]:
                    paths[x].append((pair[1 - k] if len(pair) == 2 else None, k == 1))
            up.append(sha("".join(pair)))
            joined.append([x for g in groups[i : i + 2] for x in g])
        nodes, groups = up, joined
    return nodes[0], paths


def plain(rows):
    """Rows (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r, leaf(*r)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    tops, out = [], []
    for lang in langs:
        own = sorted(by[lang], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        top, paths = tree([h for _, h in own])
        tops.append(top)
        out.append((own, paths))
    root, above = tree(tops)
    rows = []
    for k, (own, paths) in enumerate(out):
        for (r, h), path in zip(own, paths):
            path, now = path + above[k], h
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                now = leaf(r[0], r[1], r[2], None if r[3] is None else r[3] + 1, r[4])
            for other, left in path:
                now = sha((other or "") + now if left else now + (other or ""))
            rows.append((r[0], h, tops[k], root, sha("".join(x for x, _ in path if x)), now, now == root))
    return rows


def got(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=str)


def test_query_equals_brute_force(spark, sf_dir, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got(queries.op11_merkle(spark, sf_dir)) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("digits", [1, 2, 3])
@pytest.mark.parametrize("sizes", [(1,), (1, 1), (2, 3, 1), (4, 5, 8, 9, 17), (33, 1, 64)])
def test_blocks_of_any_size(spark, digits, sizes):
    rows = [(100 * k + i, "s", None if k == 0 else f"l{k}", i, f"text {i}") for k, n in enumerate(sizes) for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert got(merkle.proofs(frame, digits)) == sorted(plain(rows), key=str)


def test_many_languages(spark):
    rows = [(i, "s", f"é{i % 37}" if i % 3 else f"z{i % 11}", None if i % 5 else i, "t") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert got(merkle.proofs(frame, 2)) == sorted(plain(rows), key=str)


def test_odd_tables(spark, odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got(merkle.proofs(odd)) == sorted(plain(rows), key=str)
    assert merkle.proofs(empty).count() == 0
    same = spark.createDataFrame([(None, None, None, None, None)] * 5 + [(7, "a", "", 1, "x")] * 6, "doc_id long, source string, lang string, n_chars long, text string")
    assert got(merkle.proofs(same, 1)) == sorted(plain([tuple(r) for r in same.collect()]), key=str)


def test_no_window_over_a_language_and_no_python(spark, docs):
    plan = merkle.rollup(merkle.ranked(merkle.leaves(docs), "doc_id", "h"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    # windows only over the table of ranges
    assert "Window [" not in plan.split("Physical Plan")[-1] or "rows" in plan
