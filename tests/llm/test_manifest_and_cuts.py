"""Winnowing, the Merkle manifest and fill-in-the-middle against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from deskgauge.llm import common, fill_in_middle, merkle_manifest, winnowing
from llm import samples

TEXTS = st.text(alphabet="ab c\nÄ€𝄞<PSM>", max_size=80)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# ------------------------------------------------------------------------ winnowing

def plain_marks(text, gram=winnowing.GRAM, window=winnowing.WINDOW):
    codes = list(map(ord, text))
    if not codes:
        return []
    gram = min(gram, len(codes))
    hashes = []
    for i in range(len(codes) - gram + 1):
        h = 0
        for code in codes[i:i + gram]:
            h = (h * winnowing.BASE + code) % 2**64
        hashes.append(h >> winnowing.PLACE_BITS)
    window = min(window, len(hashes))
    kept = {max(range(i, i + window), key=lambda p: (-hashes[p], p))
            for i in range(len(hashes) - window + 1)}
    return [(hashes[p], p) for p in sorted(kept)]


def found_marks(text, **options):
    return [(int(m["hash"]), int(m["position"]))
            for m in winnowing.marks(winnowing.codes_of(text.encode()), **options)]


@given(TEXTS, st.integers(1, 9), st.integers(1, 12), st.sampled_from([1, 2, 7, 1 << 19]))
@settings(max_examples=300, deadline=None)
def test_marks_of_any_text(text, gram, window, piece):
    found = found_marks(text, gram=gram, window=window, piece=piece)
    assert found == plain_marks(text, gram, window)


def test_marks_of_long_texts_and_their_form():
    text = samples.sentence(random.Random(3), 4000)
    assert found_marks(text) == plain_marks(text) == found_marks(text, piece=1000)
    for example in (text, "", "x", "a" * 500):
        marks = winnowing.marks(winnowing.codes_of(example.encode()))
        assert (winnowing.unpacked(winnowing.packed(marks)) == marks).all()


def test_long_matches_share_a_mark_and_tell_where():
    rnd = random.Random(5)
    shared = samples.sentence(rnd, 30)[:winnowing.GRAM + winnowing.WINDOW - 1]
    for _ in range(50):
        left, right = samples.sentence(rnd, 20), samples.sentence(rnd, 9)
        one = dict(found_marks(left + shared + samples.sentence(rnd, 5)))
        two = dict(found_marks(right + shared + samples.sentence(rnd, 8)))
        assert any(one[h] - len(left) == two[h] - len(right) >= 0 for h in one.keys() & two.keys())


def plain_neighbours(rows):
    """``rows`` (id, text, tie): what the query returns, without fingerprints' form."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    hashes = lambda t: {h for h, _ in plain_marks(t)}
    out = []
    for (i, text, _), (_, following, _) in zip(rows, rows[1:] + rows[:1]):
        text, following = text or "", following or ""
        quarter = len(text) // 4
        changed = text[:len(text) - quarter] + following[:quarter]
        out.append((i, len(text), sha(changed), likeness(hashes(text), hashes(changed)),
                    likeness(hashes(text), hashes(following))))
    return sorted(out, key=repr)


def test_neighbours(spark):
    rows = [(i, t[:4000] if t else t) for i, t in enumerate(samples.texts())]
    rows += [rows[0], rows[3], (None, "no id"), (None, None), (None, "no id"),
             (-2**63, "first"), (2**63 - 1, "last")]
    rows += [(5, f"same id, other text {k}" * 3) for k in range(40)]
    docs = samples.documents(spark, rows)
    found = winnowing.with_next(docs).collect()
    ties = [tuple(r) for r in docs.selectExpr("doc_id", "text", "xxhash64(text)").collect()]
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next)
                   for r in found), key=repr) == plain_neighbours(ties)
    for r in found:
        assert winnowing.likeness(winnowing.unpacked(r.fingerprint),
                                  winnowing.unpacked(r.edited_fingerprint)) == r.near_edited


def test_neighbours_of_few_rows_and_mark_rows(spark):
    assert winnowing.with_next(samples.empty(spark)).count() == 0
    one = winnowing.with_next(samples.documents(spark, [(1, "alone " * 20)])).first()
    assert one.near_next == 1.0 and one.n_chars == 120
    nothing = winnowing.with_next(samples.documents(spark, [(1, None), (2, "")])).collect()
    assert [(r.near_edited, r.near_next, r.fingerprint) for r in nothing] == [(1.0, 1.0, "")] * 2
    text = samples.sentence(random.Random(1), 60)
    rows = winnowing.fingerprints(samples.documents(spark, [(4, text), (5, "")]))
    assert samples.rows(rows, "hash", "position") == sorted(plain_marks(text), key=repr)


def test_texts_are_shuffled_once_and_in_even_ranges(spark):
    docs = samples.documents(spark, [(None if i % 3 else i, f"text {i}") for i in range(900)])
    plan = winnowing.with_next(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in plan


# -------------------------------------------------------------------- Merkle manifest

def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i:i + 2])) for i in range(0, len(below), 2)])
    return levels


def plain_way(levels, at):
    way = []
    for nodes in levels[:-1]:
        way.append((at % 2, nodes[at ^ 1] if at ^ 1 < len(nodes) else ""))
        at //= 2
    return way


def plain_manifest(rows):
    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(plain_tree([leaf(r) for r in groups[name]]))
    top = plain_tree([t[-1][0] for t in trees])
    out = []
    for rank, (name, tree) in enumerate(zip(names, trees)):
        for place, row in enumerate(groups[name]):
            way = plain_way(tree, place) + plain_way(top, rank)
            crc = zlib.crc32(("" if row[0] is None else str(row[0])).encode())
            claimed = list(row)
            if crc % 7 == 0 and row[3] is not None:
                claimed[3] += 1
            folded = leaf(claimed)
            for right, other in way:
                folded = sha(other + folded if right else folded + other)
            root = top[-1][0]
            out.append((row[0], leaf(row), tree[-1][0], root, sha("".join(d for _, d in way)),
                        folded, folded == root))
    return sorted(out, key=repr)


def manifest_rows(frame):
    manifest = merkle_manifest.build(frame, claims=merkle_manifest.tampered())
    return samples.rows(manifest.verified())


def check_manifest(frame):
    wanted = plain_manifest([tuple(r) for r in frame.select(*merkle_manifest.COLUMNS).collect()])
    assert manifest_rows(frame) == wanted
    return wanted


def test_manifest_with_every_awkward_id(spark):
    rows = [(i, f"t{i}", ("en", "de", None, "", "é")[i % 5], "s", i) for i in range(1500)]
    rows += [(5, "copy", "en", None, None)] * 40 + [(5, "other", "en", None, 3)]
    rows += [(None, f"n{i % 7}", "en", "s", 1) for i in range(300)]
    rows += [(63, "a", "en", "b", 2), (63, "c", "en", "b", 2), (-1, "q", "de", "z", 0)]
    rows += [(127, t, None, "", 2**63 - 1) for t in ("", None)]
    rows += [(i, "edge", "de", "z", 0) for i in (-2**63, 2**63 - 1)] + [(7, "x" * 300_000, "fr", "", 9)]
    frame = spark.createDataFrame(rows, samples.DOCS).withColumns(
        {name: F.lit("other") for name in ("grp", "place", "leaf", "claimed", "slots", "n")})
    found = check_manifest(frame.repartition(5))
    assert {r[-1] for r in found} == {True, False}


def test_manifest_of_sparse_ids_and_many_groups(spark):
    rows = [(i * 2**50 + 7 * i, "t", f"l{i % 300}", "s", i) for i in range(1, 900)]
    check_manifest(spark.createDataFrame(rows, samples.DOCS))


def test_manifest_of_one_row_and_none(spark):
    (row,) = check_manifest(samples.documents(spark, [(3, "alone")]))
    assert row[1] == row[2] == row[3] and row[4] == sha("")
    assert manifest_rows(samples.empty(spark)) == []


def test_proofs_lead_to_the_root(spark):
    manifest = merkle_manifest.build(samples.documents(spark, [(i, "t") for i in range(1, 301)]))
    for row in manifest.proofs().collect():
        way = iter(row.path)
        assert merkle_manifest.fold(row.leaf, way, row.place, 300) == manifest.root
        assert next(way, None) is None and row.grp == "en"
    assert samples.rows(manifest.proofs(), "doc_id", "place") == sorted(
        ((i, i - 1) for i in range(1, 301)), key=repr)


@pytest.mark.parametrize("ids", [range(5000), [2**40 * k - 2**62 for k in range(3000)]])
def test_directory_counts_what_comes_before(spark, ids):
    rows = spark.createDataFrame([("1a", True, i) for i in ids], "grp string, known boolean, id bigint")
    words = merkle_manifest.directory(merkle_manifest.bitmap_words(rows)).collect()
    assert sum(r.bits.bit_count() if r.bits >= 0 else 64 - (~r.bits).bit_count()
               for r in words) == len(ids)
    total = 0
    for row in sorted(words, key=lambda r: r.word):
        assert row.before == total
        total += row.n


# ------------------------------------------------------------------- fill in the middle

@given(st.lists(st.one_of(
    st.integers(0, 300_000),
    st.integers(0, 4).flatmap(lambda k: st.just(70_000 * k)))), st.integers(0, 70_000),
    st.integers(0, 9_000), st.integers(1, 3))
@settings(max_examples=60, deadline=None)
def test_boundary_sets_select(offsets, start, length, step):
    offsets = sorted({*offsets, *range(start, start + length * step, step)} or {0})
    found = fill_in_middle.BoundarySet(np.array(offsets))
    assert len(found) == len(offsets)
    for k in {0, len(offsets) // 3, len(offsets) // 2, len(offsets) - 1}:
        assert found.select(k) == offsets[k]
    with pytest.raises(IndexError):
        found.select(len(offsets))


def test_all_kinds_of_containers():
    rnd = random.Random(2)
    offsets = np.array([*range(0, 65_536), *range(65_536, 131_072, 2), 131_080, 140_000,
                        *sorted(rnd.sample(range(196_608, 262_144), 9_000))])
    found = fill_in_middle.BoundarySet(offsets)
    assert [type(c).__name__ for c in found.containers] == ["_Runs", "_Bitmap", "_Array", "_Bitmap"]
    assert [found.select(k) for k in range(0, len(offsets), 997)] == offsets[::997].tolist()


def plain_example(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = sha(f"7:{'' if doc_id is None else doc_id}")
    h1, h2, _, h4 = (int(x[k:k + 8], 16) for k in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text):
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, len(units))))
    if h4 % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.one_of(st.none(), st.integers()), TEXTS)
@settings(max_examples=400, deadline=None)
def test_examples_of_any_text(doc_id, text):
    made = fill_in_middle.transform(doc_id, text.encode())
    n, form, prefix, middle, output = plain_example(doc_id, text)
    assert (made.units, made.form, made.output) == (n, form, output.encode())
    if form != "plain":
        assert fill_in_middle.characters(made.prefix) == prefix
        assert fill_in_middle.characters(made.middle) == middle
    assert fill_in_middle.restore(made.output, made.form) == text.encode()


def test_example_tables(spark):
    rows = [*enumerate(samples.texts()), (None, None), (None, "a\nb\n"), (7, "has <S> inside\n"),
            (8, "\n" * 70_000), (8, "\n" * 70_000)]
    docs = samples.documents(spark, rows)
    wanted = sorted(((i, *plain_example(i, t)[:4], sha(plain_example(i, t)[4]), sha(t or ""))
                     for i, t in rows), key=repr)
    assert samples.rows(fill_in_middle.digests(docs)) == wanted
    made = samples.rows(fill_in_middle.examples(docs), "doc_id", "form", "output")
    assert made == sorted(((i, plain_example(i, t)[1], plain_example(i, t)[4]) for i, t in rows),
                          key=repr)
    assert fill_in_middle.digests(samples.empty(spark)).count() == 0


def test_rates(spark):
    never = fill_in_middle.Rates(cut=0)
    assert fill_in_middle.transform(1, b"a\nb", never).form == "plain"
    always = fill_in_middle.Rates(suffix_first=100)
    forms = {fill_in_middle.transform(i, b"a\nb", always).form for i in range(50)}
    assert forms == {"spm"}
    assert common.crc_of_id(None) == 0
