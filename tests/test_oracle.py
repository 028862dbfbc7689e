"""Every registered query against its SQL, on the smallest data on which it has rows."""

import pytest

from geofold.plans import catalog

from .oracle import compare, connect

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
catalog.load()
# Without rows at the smallest scale.
SPARSE = {
    "ecef_distance", "haversine_m", "bearing_deg", "polygons_intersect", "clip_features", "parcel_conflicts", "objects_in_cell", "apply_overrides",
    "chunks_in_ball", "water_polygon_fill", "causality_violations", "category_warnings", "tile_probe", "channel_backing",
}


@pytest.fixture(scope="module")
def ducks():
    return {sf: connect(sf) for sf in (SMALL, LARGER)}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, ducks, name):
    """Equal rows where there is SQL, and rows in any case."""
    sf = LARGER if name in SPARSE else SMALL
    assert compare(spark, ducks[sf], name, sf) is None
