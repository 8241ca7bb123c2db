"""Exact dedup, near copies and repeated passages against plain Python."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import panelmetrics.llm.words
from panelmetrics.llm import bbit_minhash, exact_dedup, golomb, jaccard_join, substring_dedup
from panelmetrics.llm.recompression import Anchors
from panelmetrics.llm.words import WordHashes

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


@pytest.mark.parametrize("bits", [64, 48, 10])
@pytest.mark.parametrize("count", [0, 1, 2, 700])
def test_golomb_blocks_are_read_back(bits, count):
    values = np.unique(np.random.default_rng(count).integers(0, 2**bits, count, dtype=np.uint64))
    assert (golomb.decode(golomb.encode(values, bits)) == values).all()


def test_golomb_ends_of_the_range():
    values = np.array([0, 2**64 - 1], dtype=np.uint64)
    assert golomb.decode(golomb.encode(values, 64)).tolist() == values.tolist()


def plain(text):
    return re.sub("[\\x20\\x09-\\x0D]+", " ", text or "")


def test_exact_groups_of_odd_rows(make_documents, odd_rows):
    found = exact_dedup.exact_groups(make_documents(odd_rows).repartition(3), owners=5, bits=12).collect()
    groups = defaultdict(list)
    for doc_id, text in odd_rows:
        groups[hashlib.sha256(plain(text).encode()).digest()].append(doc_id)
    assert len(found) == len(odd_rows)
    for sha, ids in groups.items():
        mine = [r for r in found if bytes(r.sha) == sha]
        known = [i for i in ids if i is not None]
        assert sorted(str(r.doc_id) for r in mine) == sorted(map(str, ids))
        assert {r.keep_id for r in mine} == {min(known, default=None)}
        assert {r.group_size for r in mine} == {len(ids)}
        assert [r.doc_id for r in mine if r.kept] == [min(known, default=None)]


def test_one_row_of_each_text_stays_with_all_columns(make_documents, odd_rows):
    documents = make_documents(odd_rows)
    kept = exact_dedup.drop_copies(documents.repartition(3), owners=5, bits=12)
    assert kept.columns == documents.columns
    texts = [plain(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({plain(t) for _, t in odd_rows})
    assert {r.key for r in kept.collect()} == {"k"}


def test_dedup_of_an_empty_table(make_documents):
    none = make_documents([])
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_copies(none).count() == 0
    assert jaccard_join.similar_documents(none).count() == 0
    assert jaccard_join.keep_one_of_class(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert bbit_minhash.near_components(none).count() == 0


def near_texts(seed, families, members):
    """Families of texts that share most of their words, with a passage that all share."""
    chance = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [chance.choice(vocabulary) for _ in range(30)]
    texts = []
    for _ in range(families):
        base = [chance.choice(vocabulary) for _ in range(chance.randint(40, 120))] + passage
        for _ in range(members):
            words = list(base)
            for _ in range(chance.randint(0, 3)):
                words[chance.randrange(len(words))] = chance.choice(vocabulary)
            texts.append(" ".join(words))
    return texts


def links_of(rows):
    """Links and classes by comparing every pair."""
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (WORD.findall(t or "") for _, t in rows)]
    links, parent = Counter(), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [links[i] for i in range(len(rows))], [root(i) for i in range(len(rows))]


@pytest.mark.parametrize("settings", [{}, {"block": 4}, {"miss": 1e-9}])
def test_links_and_classes_equal_those_of_all_pairs(make_documents, settings):
    """With small blocks, nodes and groups are dealt out; another target recall gives another depth."""
    rows = [(i, t) for i, t in enumerate(near_texts(5, 8, 9))]
    links, classes = links_of(rows)
    found = {r.doc_id: r for r in jaccard_join.similar_documents(make_documents(rows), **settings).collect()}
    assert [found[i].n_links for i in range(len(rows))] == links
    assert [found[i].class_id for i in range(len(rows))] == classes
    sizes = Counter(classes)
    assert [found[i].class_size for i in range(len(rows))] == [sizes[c] for c in classes]


def test_depth_follows_from_the_target_recall():
    assert [jaccard_join.depth_for(m) for m in (1e-6, 1e-9, 1e-3, 0.5)] == [4, 3, 7, 17]


def test_trie_connects_what_all_pairs_connect():
    chance = np.random.default_rng(9)
    for _ in range(30):
        base = chance.integers(0, 256, (6, 128))
        rows = base[chance.integers(0, 6, 70)]
        rows = np.where(chance.random(rows.shape) < chance.choice([0.02, 0.3]), chance.integers(0, 256, rows.shape), rows).astype(np.uint8)
        group = np.sort(chance.integers(0, 5, 70))
        order = np.lexsort([*rows.T[::-1], group])
        rows, group = rows[order], group[order]
        expected = np.arange(70)
        for i in range(70):
            for j in range(i):
                if group[i] == group[j] and (rows[i] == rows[j]).mean() >= 0.6 and expected[i] != expected[j]:
                    both = (expected == expected[i]) | (expected == expected[j])
                    expected[both] = expected[both].min()
        assert jaccard_join.connected_by_trie(rows, group, 0.6).tolist() == expected.tolist()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables not present")
def test_recall_over_all_documents_is_whole(spark):
    """All pairs of documents that share a shingle, against the links and classes of the join."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: WORD.findall(r.text or "") for r in documents.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in rows.items()}
    holders = defaultdict(list)
    links, least = Counter(), {i: i for i in rows}
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in holders[s])
        for j, n in shared.items():
            if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                links.update((i, j))
                if least[i] != least[j]:
                    both = {least[i], least[j]}
                    least = {k: min(both) if v in both else v for k, v in least.items()}
        for s in sets[i]:
            holders[s].append(i)
    found = {r.doc_id: (r.n_links, r.class_id) for r in jaccard_join.similar_documents(documents).collect()}
    assert found == {i: (links[i], least[i]) for i in rows}
    assert sum(links.values()) > 100


def test_near_copies_of_odd_rows(make_documents, odd_rows):
    found = jaccard_join.similar_documents(make_documents(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    by_id = {r.doc_id: r for r in found}
    assert (by_id[6].class_id, by_id[7].class_id, by_id[6].n_links) == (6, 6, 1)
    assert all(r.n_links == 0 and r.class_id == r.doc_id for r in found if r.doc_id not in (6, 7))


def test_one_document_of_each_class_stays(make_documents, odd_rows):
    rows = [(100 + i, t) for i, t in enumerate(near_texts(6, 4, 5))] + odd_rows
    documents = make_documents(rows)
    kept = jaccard_join.keep_one_of_class(documents)
    assert kept.columns == documents.columns
    _, classes = links_of(rows)
    firsts = sorted(str(rows[i][0]) for i in range(len(rows)) if classes[i] == i)
    assert sorted(str(r.doc_id) for r in kept.collect()) == firsts


def test_classes_that_share_an_id_keep_one_document_each(make_documents):
    """One id on texts of two classes, and near copies without ids."""
    a, b, c, d = (near_texts(seed, 1, 1)[0] for seed in (21, 22, 23, 24))
    rows = [(1, a), (2, a + " x"), (1, b), (3, b + " x"), (None, c), (None, c + " x"), (None, d), (7, d + " x")]
    kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one_of_class(make_documents(rows)).collect()]
    assert sorted(r for r in kept if r[0] is not None) == sorted([(1, a), (1, b), (7, d + " x")])
    assert [r[1] in (c, c + " x") for r in kept if r[0] is None] == [True]


def components_by_hand(rows):
    """(doc_id, n_shingles, component_id, kept) of each row by comparing every pair."""

    def words(text):
        return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    sets = [frozenset(tuple(w[k : k + 4]) for k in range(max(len(w) - 3, 1))) if w else frozenset() for w in (words(t) for _, t in rows)]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    result = []
    for at, (doc_id, _) in enumerate(rows):
        mine = [rows[i][0] for i in range(len(rows)) if label[i] == label[at] and rows[i][0] is not None]
        found = min(mine, default=None)
        result.append((doc_id, len(sets[at]), found, doc_id == found))
    return Counter(result)


@pytest.mark.parametrize("settings", [{}, {"block": 4}])
def test_components_equal_those_of_all_pairs(make_documents, settings):
    """Families of near copies with a shared passage; small blocks deal groups out."""
    rows = [(500 - i, t if i % 4 else t.upper()) for i, t in enumerate(near_texts(31, 8, 9))]
    rows += [(1000 + i, " ".join(f"c{k}" for k in range(i, i + 60))) for i in range(0, 60, 3)]  # a chain of links
    found = bbit_minhash.near_components(make_documents(rows).repartition(3), **settings).collect()
    assert Counter(map(tuple, found)) == components_by_hand(rows)


def test_components_of_odd_rows(make_documents, odd_rows):
    rows = odd_rows + [(20, "a b"), (21, "A b"), (22, "a b c d"), (None, "x y z w v u"), (None, "x y z w v u"), (30, "B c"), (31, "b C ")]
    found = bbit_minhash.near_components(make_documents(rows)).collect()
    assert Counter(map(tuple, found)) == components_by_hand(rows)


def test_packed_signatures_estimate_similarity():
    chance = np.random.default_rng(6)
    by = bbit_minhash.factors()
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(30):
            common = chance.integers(0, 2**64, round(share * 1000), dtype=np.uint64)
            rest = [chance.integers(0, 2**64, (1000 - len(common)) // 2, dtype=np.uint64) for _ in range(2)]
            left, right = (bbit_minhash.packed(bbit_minhash.minima(np.concatenate([common, r]), by)) for r in rest)
            errors.append(float(bbit_minhash.estimated(left[None], right[None])[0]) - share)
        assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.2


def removed_by_hand(rows, width):
    """(n_words, n_removed, kept) of each row by comparing every window; rows in order."""
    seen, result = set(), []
    for _, text in rows:
        words, gone = WORD.findall(text or ""), set()
        for start in range(len(words) - width + 1):
            window = tuple(words[start : start + width])
            if window in seen:
                gone.update(range(start, start + width))
            seen.add(window)
        result.append((len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return result


@pytest.mark.parametrize("settings", [{"bits": 6}, {"bits": 20}, {"bits": 20, "often": 1}, {"bits": 20, "often": 3, "often_bits": 4}])
def test_repeats_equal_those_of_all_windows(make_documents, settings):
    """Runs, periods, shared passages and windows that overlap; full bitmaps and how windows travel change nothing."""
    chance = random.Random(11)
    few, many = ["a", "b"], [f"v{i}" for i in range(300)]
    passage = " ".join(chance.choice(many) for _ in range(45))
    texts = ["a " * 50, "a " * 30 + "b", "x y z " * 20, "x y z " * 9]
    texts += [" ".join(chance.choice(few) for _ in range(chance.randint(0, 120))) for _ in range(25)]
    texts += [f"{' '.join(chance.choice(many) for _ in range(15))} {passage} {chance.choice(many)}" for _ in range(10)]
    rows = list(enumerate(texts))
    found = substring_dedup.remove_repeats(make_documents(rows).repartition(4), **settings).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept) for r in found] == removed_by_hand(rows, 20)


def test_repeats_of_odd_rows(make_documents, odd_rows):
    found = substring_dedup.remove_repeats(make_documents(odd_rows)).collect()
    assert len(found) == len(odd_rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[7].n_removed == by_id[7].n_words == 60_000
    assert (by_id[7].kept, by_id[3].kept, by_id[4].kept) == ("", "", "a b c")
    assert 0 < by_id[6].n_removed < 60_000  # its own period


@pytest.mark.parametrize("tasks", [1, 5])
def test_repeated_rows_are_one_document(make_documents, tasks):
    """In one chunk and in chunks of several tasks, rows that repeat id and text keep what one document keeps."""
    chance = random.Random(17)
    text = " ".join(chance.choice(["a", "b"]) for _ in range(200))  # repeats itself as well
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(1, text), (2, f"{text} {other}"), (3, f"x {other}"), (9, " ".join(f"u{i}" for i in range(30)))]
    rows.append((None, " ".join(f"t{i}" for i in range(25))))
    by_hand = dict(zip(rows, removed_by_hand(rows, 20), strict=True))
    documents = make_documents([r for r in rows for _ in range(3)]).repartition(tasks)
    found = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(documents).collect())
    assert found == {(doc_id, *by_hand[doc_id, text]): 3 for doc_id, text in rows}


def window_rows(spark, rows):
    kinds = "owner long, hash long, doc_id long, row long, start int, hashes binary, length int, first_row long, first_start int"
    return spark.createDataFrame(rows, kinds)


def test_different_windows_of_one_anchor_spread(spark):
    """Single windows that share an anchor only are dealt out, and equal ones still meet."""
    rows = [(7, i % 3000, 1 + i // 3000, 1 + i // 3000, i % 3000, None, None, None, None) for i in range(6000)]
    rows.append((3, None, None, 3, 5, None, 9, 1, 7))
    found = substring_dedup.named_windows(window_rows(spark, rows))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = {r.task for r in found.where("row = 2").withColumn("task", F.spark_partition_id()).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    covered = Counter((r.row, r.start + k, r.first_row, r.first_start + k) for r in found.collect() for k in range(r.length))
    assert covered == Counter([(2, s, 1, s) for s in range(3000)] + [(3, 5 + k, 1, 7 + k) for k in range(9)])
    assert len(tasks) > 1


def test_runs_and_single_windows_give_the_same_matches(spark):
    chance, singles, runs = random.Random(41), [], []
    for owner in range(300):
        for _ in range(chance.randint(1, 6)):
            doc, start, hashes = chance.randrange(40), chance.randrange(90), [chance.randrange(4) for _ in range(chance.randint(1, 5))]
            runs.append((owner, None, doc, 1000 + doc, start, np.array(hashes, "<i8").tobytes(), None, None, None))
            singles += [(owner, h, doc, 1000 + doc, start + k, None, None, None, None) for k, h in enumerate(hashes)]

    def matches(rows):
        found = substring_dedup.named_windows(window_rows(spark, rows)).collect()
        return {(r.row, r.start + k, r.first_row, r.first_start + k) for r in found for k in range(r.length)}

    assert matches(runs) == matches(singles) and len(matches(runs)) > 500


def test_matches_are_as_long_as_they_go(spark):
    rows = [(1, 5, 3, 9, 50), (1, 8, 2, 9, 53), (1, 6, 1, 9, 51), (1, 20, 1, 9, 65), (1, 10, 4, 8, 55), (2, 11, 1, 9, 56), (2, 12, 1, 9, 57)]
    found = substring_dedup.whole_matches(spark.createDataFrame(rows, substring_dedup.MATCH))
    assert sorted((r.row, r.first_row, r["shift"], r.start, r.length) for r in found.collect()) == [
        (1, 8, 45, 10, 4), (1, 9, 45, 5, 5), (1, 9, 45, 20, 1), (2, 9, 45, 11, 2),
    ]


def test_matches_of_unequal_words_are_not_removed(spark):
    """Matches proposed by hashes alone: those whose words differ lose the windows that hold the difference."""
    text = [f"w{i}" for i in range(150)]
    changed = [*text[:70], "other", *text[71:]]
    frame = spark.createDataFrame([(1, "first " + " ".join(text)), (2, " ".join(changed)), (3, "x " * 60)], "row long, text string")
    proposed = [(2, 1, 1, 0, 131), (3, 1, 1, 0, 20)]
    matches = spark.createDataFrame(proposed, "row long, first_row long, shift int, start int, length int")
    named = {r.row: list(map(tuple, r.named)) for r in substring_dedup.earlier_words(matches, frame, 20).collect()}
    words = [w.encode() for w in changed]
    found = substring_dedup.verified_stretches(words, named[2], 20)
    assert all(words[a:b] == [w.encode() for w in text[a:b]] for a, b in found)
    cell = substring_dedup.CELL
    assert found == [(0, 71 // cell * cell - 1), ((71 // cell + 1) * cell - 1, 150)]
    assert substring_dedup.verified_stretches([b"x"] * 60, named[3], 20) == []


@pytest.mark.parametrize("segment", [1 << 20, 40])
def test_word_hashes_tell_words_apart_and_stand_for_words_only(monkeypatch, segment):
    monkeypatch.setattr(panelmetrics.llm.words, "SEGMENT", segment)
    chance = random.Random(23)
    texts = ["".join(chance.choices(["a", "b", "ab", " ", "\t\n", "é", "\x1c", "\u3000", "\x0b"], k=chance.randint(0, 60))) for _ in range(200)]
    texts += ["", " ", "x" * 5000, "a" * 64 + " " + "a" * 65]
    hashes, edges = WordHashes().of_many([t.encode() for t in texts])
    seen = {}
    for i, text in enumerate(texts):
        words = WORD.findall(text)
        mine = hashes[edges[i] : edges[i + 1]].tolist()
        assert len(mine) == len(words)
        for word, number in zip(words, mine, strict=True):
            assert seen.setdefault(word, number) == number
    assert len(set(seen.values())) == len(seen) > 100
    none, only = WordHashes().of_many([])
    assert len(none) == 0 and only.tolist() == [0]


def test_anchors_of_several_texts_are_those_of_each():
    chance, anchors = random.Random(13), Anchors(20)
    texts = [np.array([chance.choice([5, 5, 6, 7, 8, 9]) for _ in range(n)], dtype=np.uint64) for n in (0, 45, 19, 20, 3, 80, 0, 21, 0)]
    edges = np.cumsum([0, *map(len, texts)])
    at, whole, keys, another = anchors(np.concatenate(texts), edges)
    apart = [anchors(t) for t in texts]
    assert at.tolist() == [int(s) + int(e) for (starts, *_), e in zip(apart, edges) for s in starts]
    for found, which in ((whole, 1), (keys, 2)):
        assert found.tolist() == np.concatenate([a[which] for a in apart]).tolist()
    assert (another | ~np.concatenate([a[3] for a in apart])).sum() >= len(at) - len(texts)


def test_equal_windows_have_equal_anchors():
    chance, anchors, seen = random.Random(3), Anchors(20), {}
    numbers = {w: chance.getrandbits(64) for w in range(5)}
    for _ in range(60):
        words = [chance.choice([0, 0, 0, 1, 2, 3, 4]) for _ in range(chance.randint(20, 90))]
        _, whole, keys, _ = anchors(np.array([numbers[w] for w in words], dtype=np.uint64))
        for start in range(len(words) - 19):
            found = (int(whole[start]), int(keys[start]))
            assert seen.setdefault(tuple(words[start : start + 20]), found) == found
