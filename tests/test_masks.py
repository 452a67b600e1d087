"""Golden masks: pixels laid out by hand."""

import math

import pytest

from cellmorph.functions import masks

SQUARE = [(y, x) for y in range(5) for x in range(5)]
PLUS = [(2, x) for x in range(5)] + [(y, 2) for y in range(5) if y != 2]
RING = [p for p in SQUARE if p in {(y, x) for y in range(5) for x in range(5) if y in (0, 4) or x in (0, 4)}]
LINE = [(0, x) for x in range(10)]
BLOBS = [(y, x) for y in range(3) for x in range(3)] + [(y, x) for y in (3, 4) for x in (3, 4)]


def test_components():
    assert max(masks.label(BLOBS, 8).values()) == 1
    assert max(masks.label(BLOBS, 4).values()) == 2
    assert masks.label([], 8) == {}


@pytest.mark.parametrize("px,length", [(SQUARE, 16), (LINE, 18), ([(3, 3)], 0), ([(0, 0), (1, 1)], 2 * math.sqrt(2)), (RING, 16), ([], 0)])
def test_perimeter(px, length):
    assert masks.perimeter(px) == pytest.approx(length)


def test_perimeter_of_plus():
    # Around a plus sign: out and back along four arms of two pixels, corners cut diagonally.
    assert masks.perimeter(PLUS) == pytest.approx(8 + 4 * math.sqrt(2))


def test_perimeter_ignores_order_and_adds_up():
    far = [(y + 100, x) for y, x in SQUARE]
    assert masks.perimeter(list(reversed(SQUARE)) + far) == pytest.approx(32)


def test_hull():
    assert masks.hull(SQUARE) == (16, 16)
    assert masks.hull(LINE) == (0, 18)
    assert masks.hull([(1, 1)]) == (0, 0)
    assert masks.hull(PLUS)[0] == pytest.approx(8)


def test_topology():
    assert masks.betti(SQUARE) == (1, 0)
    assert masks.betti(RING) == (1, 1)
    assert masks.betti(BLOBS) == (2, 0)
    assert masks.betti([]) == (0, 0)
    assert masks.euler(RING, 8) == masks.euler(RING, 4) == 0
    assert masks.euler(BLOBS, 4) == 2 and masks.euler(BLOBS, 8) == 1


def test_thinning():
    assert sorted(masks.thin(LINE)) == LINE
    thick = [(y, x) for y in range(3) for x in range(20)]
    thin = masks.thin(thick)
    assert 0 < len(thin) <= 20 and max(masks.label(thin, 8).values()) == 1
    assert masks.thin([]) == []


def test_junctions():
    assert masks.junction_count(PLUS) == 1
    assert masks.junction_count(LINE) == 0


def test_fill_holes():
    shifted = [(y + 1, x + 1) for y, x in RING]
    assert len(masks.filled(shifted, 8, 8)) == 25
    assert masks.filled([], 4, 4) == []
