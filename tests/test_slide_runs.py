"""A slide's tiles are kept as runs."""

from cellmorph.operators import pixels


def test_repeated_pixels_count_once_and_tiles_are_stored_as_runs(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(pixels, "stored", lambda df, tag, real=pixels.stored: kept.append((tag, real(df, tag))) or kept[-1][1])
    px = spark.sql("SELECT 1L AS slide, y, x FROM (SELECT explode(array(3L, 3L, 9L)) AS y) LATERAL VIEW explode(sequence(0L, 49L)) AS x")
    got = {tuple(r) for r in pixels.slide_components(px, 8, 16).collect()}
    assert got == {(1, y, x, y, 0) for y in (3, 9) for x in range(50)}
    assert dict(kept)["tiles"].count() == 8
