"""Vector codes and centroid clusters against plain numpy, with odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from panelmetrics.llm import centroid_zones, vector_codes
from panelmetrics.llm.vectors import LIMIT, squared_distances

EXTRA = "cluster string, code int, part string, row int, place string, distance string, error string, low int, high int, vector int"
CLASH = ("c", 1, "p", 2, "pl", "d", "e", 3, 4, 5)


@pytest.fixture(scope="module")
def make_vectors(spark):
    """Rows (vec_id, embedding, label) with extra columns of clashing names."""

    def make(rows):
        schema = f"vec_id long, embedding array<double>, label int, {EXTRA}"
        return spark.createDataFrame([(*r, *CLASH) for r in rows], schema)

    return make


def random_rows(seed, count, width, spread=1.0):
    chance = np.random.default_rng(seed)
    middles = chance.normal(0, spread, (5, width))
    rows = [(i, (middles[i % 5] + chance.normal(0, 0.3, width)).tolist(), i % 3 or None) for i in range(count)]
    rows += [(1000 + i, list(rows[7][1]), 9) for i in range(count // 3)]  # one vector of very many rows
    random.Random(seed).shuffle(rows)
    return rows


def odd_rows(width):
    whole = [0.5] * width
    return [
        (None, whole, 1), (None, whole, 1), (4, whole, 1), (4, whole, None), (4, [0.25] * width, None), (5, None, 1), (6, [], 2),
        (7, [*whole[1:], None], 1), (8, [*whole[1:], math.nan], 1), (9, [*whole[1:], -math.inf], 1), (10, whole[1:], 1),
        (11, [*whole, 0.5], 1), (12, [*whole[1:], 1e30], None), (None, None, None),
    ]


def whole(vector, scale):
    return [int(max(-LIMIT, min(LIMIT, math.floor(x * scale) if abs(x * scale) < 2**60 else math.copysign(2**60, x)))) for x in vector]


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def nearest(points, entries):
    """Index and distance of the nearest entry by comparing all of them, in Python's numbers."""
    found = []
    for p in points:
        every = [sum((a - b) ** 2 for a, b in zip(p, e, strict=True)) for e in entries]
        found.append((every.index(min(every)), min(every)))
    return found


def moved(points, entries, rounds):
    for _ in range(rounds):
        groups = {}
        for p, (k, _) in zip(points, nearest(points, entries), strict=True):
            groups.setdefault(k, []).append(p)
        entries = [[sum(c) // len(c) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(entries)]
    return entries


def clusters_by_hand(rows, width, scale, clusters, rounds):
    kept = [(i, whole(v, scale)) for i, v, _ in rows if usable(v) and len(v) == width]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    points = [v for _, v in kept]
    centroids = moved(points, [v for _, v in start[:clusters]], rounds)
    found = nearest(points, centroids)
    sums = {k: sum(d for j, d in found if j == k) for k, _ in found}
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = sum(sums.values())
    return sorted(map(repr, [(i, k, d, sums[k], total, shas[k]) for (i, _), (k, d) in zip(kept, found, strict=True)]))


@pytest.mark.parametrize("block", [3, 256])
@pytest.mark.parametrize("width,spread", [(64, 1.0), (3, 5.0)])
def test_clusters_equal_those_of_all_comparisons(make_vectors, block, width, spread):
    rows = random_rows(3, 120, width, spread) + odd_rows(width)[:5] + odd_rows(width)[5:12]
    found = centroid_zones.cluster_vectors(make_vectors(rows).repartition(3), width=width, clusters=7, block=block)
    assert sorted(repr(tuple(r)) for r in found.collect()) == clusters_by_hand(rows, width, 64, 7, 3)


def test_clusters_of_odd_rows_and_of_few(make_vectors):
    rows = odd_rows(4)
    found = [tuple(r) for r in centroid_zones.cluster_vectors(make_vectors(rows), width=4).collect()]
    assert sorted(map(repr, found)) == clusters_by_hand(rows, 4, 64, 16, 3)
    assert len(found) == 6 and max(r[2] for r in found) == 0


def test_clusters_of_nothing(make_vectors):
    for rows in ([], [(1, None, 1), (2, [1.0], 1)]):
        found = centroid_zones.cluster_vectors(make_vectors(rows))
        assert found.count() == 0 and found.columns[:3] == ["vec_id", "cluster", "distance"]


def test_box_candidates_hold_the_nearest_and_drop_others():
    chance = np.random.default_rng(8)
    dropped = 0
    for _ in range(200):
        points = chance.integers(-30, 30, 4) + chance.integers(-3, 4, (9, 4))
        centroids = chance.integers(-40, 40, (12, 4))
        candidates = centroid_zones.box_candidates(points.min(axis=0), points.max(axis=0), centroids)
        every = squared_distances(points, centroids)
        assert set(every.argmin(axis=1)) <= set(candidates)
        dropped += 12 - len(candidates)
    assert dropped > 1500


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 2), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1).T
    places = centroid_zones.hilbert_places(cells, bits)
    assert len(set(places)) == len(cells)
    path = cells[sorted(range(len(cells)), key=places.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_distances_are_exact_beyond_doubles():
    points = np.array([[LIMIT, -LIMIT, 3], [0, 1, 2]])
    entries = np.array([[-LIMIT, LIMIT, 2], [1, 1, 1]])
    by_hand = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e, strict=True)) for e in entries] for p in points]
    assert squared_distances(points, entries).tolist() == by_hand


def codes_by_hand(rows, parts, scale, entries, rounds):
    kept = sorted(((i, whole(v, scale), label) for i, v, label in rows if usable(v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1])
    width = size // parts
    held = [r for r in kept if len(r[1]) == size]
    codes, errors, books = [""] * len(held), [0] * len(held), []
    for part in range(parts):
        points = [v[part * width : (part + 1) * width] for _, v, _ in held]
        book = moved(points, points[:entries], rounds)
        books += [str(x) for e in book for x in e]
        for at, (k, d) in enumerate(nearest(points, book)):
            codes[at] += f"{k:02x}"
            errors[at] += d
    sums = {label: sum(e for e, r in zip(errors, held, strict=True) if r[2] == label) for _, _, label in kept}
    sha = hashlib.sha256(",".join(books).encode()).hexdigest()
    result = [(r[0], r[2], c, e, sums[r[2]], sha) for r, c, e in zip(held, codes, errors, strict=True)]
    result += [(r[0], r[2], None, None, sums[r[2]], sha) for r in kept if len(r[1]) != size]
    return sorted(map(repr, result))


@pytest.mark.parametrize("initial", [0.0, 0.5, 1.0])
@pytest.mark.parametrize("entries", [5, 70])
def test_codes_equal_those_of_all_comparisons(make_vectors, entries, initial):
    rows = random_rows(4, 150, 8) + odd_rows(8)
    found = vector_codes.compress_vectors(make_vectors(rows).repartition(3), entries=entries, initial=initial)
    assert sorted(repr(tuple(r)) for r in found.collect()) == codes_by_hand(rows, 4, 1024, entries, 4)


def test_codes_of_nothing_and_of_lengths_without_parts(make_vectors):
    assert vector_codes.compress_vectors(make_vectors([])).count() == 0
    assert vector_codes.compress_vectors(make_vectors([(1, None, 1)])).count() == 0
    found = vector_codes.compress_vectors(make_vectors([(1, [1.0] * 5, 1), (2, [1.0] * 4, 1), (3, [], None)])).collect()
    assert [(r.code, r.error, r.label_error) for r in found] == [(None, None, 0)] * 3


def test_masks_name_the_entries_of_a_cube():
    chance = np.random.default_rng(5)
    entries, points = chance.integers(-9, 9, (130, 3)), chance.integers(-9, 9, (40, 3))
    search = vector_codes.SliceMasks(entries)
    for radius in (0, 2, 5, 40):
        masks = search.within(points, np.full(len(points), radius))
        marks = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, :130].astype(bool)
        assert (marks == (np.abs(points[:, None] - entries).max(axis=2) <= radius)).all()
