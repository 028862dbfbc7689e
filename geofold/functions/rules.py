"""Classification rules as Column expressions over small fixed tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import big, clamp, col, geoid_undulation

# ---------------------------------------------------------------------------------------------------------
# Label tables.
# ---------------------------------------------------------------------------------------------------------
CLIMATE_BANDS = [
    (10, "TropicalRainforest"),
    (20, "TropicalMonsoon"),
    (25, "TropicalSavanna"),
    (35, "HumidSubtropical"),
    (40, "MediterraneanHot"),
    (50, "OceanicMaritime"),
    (60, "HumidContinental"),
    (70, "SubarcticBoreal"),
    (80, "Tundra"),
]
TROPICAL = ["TropicalRainforest", "TropicalMonsoon", "TropicalSavanna"]
MEDITERRANEAN = ["MediterraneanHot", "MediterraneanWarm"]
TEMPERATE = ["OceanicMaritime", "HumidContinental"]
DESERTS = ["HotDesert", "ColdDesert"]
STEPPES = ["HotSteppe", "ColdSteppe"]

SOIL_DEPTH = {
    "BedRock": 0,
    "GravelBed": 1,
    "Granite": 2,
    "Basalt": 2,
    "Sandstone": 3,
    "Sand": 6,
    "TemperateBrown": 6,
    "RedClay": 8,
    "GreyClay": 8,
    "TropicalRed": 10,
    "Silty": 12,
    "Peat": 12,
    "UrbanFill": 0,
    "Permafrost": 0,
}

# id: (name, solid, transparent, density, red, green, blue)
MATERIALS = {
    0: ("AIR", False, True, 1.2, 135, 206, 235),
    1: ("STONE", True, False, 2500.0, 128, 128, 128),
    2: ("DIRT", True, False, 1600.0, 152, 85, 38),
    3: ("GRASS", True, False, 1200.0, 78, 130, 50),
    4: ("SAND", True, False, 1600.0, 210, 190, 140),
    5: ("GRAVEL", True, False, 1800.0, 150, 140, 125),
    6: ("SNOW", True, False, 400.0, 255, 250, 250),
    7: ("ICE", True, True, 917.0, 175, 238, 238),
    8: ("GRASS_DRY", True, False, 1100.0, 138, 148, 60),
    9: ("LATERITE", True, False, 1700.0, 178, 82, 38),
    10: ("WATER", False, True, 1000.0, 65, 105, 225),
    11: ("LAVA", False, False, 3100.0, 255, 69, 0),
    20: ("WOOD", True, False, 700.0, 139, 90, 43),
    21: ("LEAVES", True, True, 400.0, 46, 125, 50),
    30: ("CONCRETE", True, False, 2400.0, 192, 192, 192),
    31: ("BRICK", True, False, 2000.0, 178, 34, 34),
    32: ("ASPHALT", True, False, 2400.0, 64, 64, 64),
    33: ("GLASS", True, True, 2500.0, 230, 255, 255),
    34: ("STEEL", True, False, 7850.0, 176, 196, 222),
    100: ("BEDROCK", True, False, 3000.0, 32, 32, 32),
}

# highway tag: class
ROAD_CLASS = {
    "motorway": "Motorway",
    "motorway_link": "Motorway",
    "trunk": "Trunk",
    "trunk_link": "Trunk",
    "primary": "Primary",
    "primary_link": "Primary",
    "secondary": "Secondary",
    "secondary_link": "Secondary",
    "tertiary": "Tertiary",
    "tertiary_link": "Tertiary",
    "residential": "Residential",
    "living_street": "Residential",
    "unclassified": "Residential",
    "service": "Service",
    "footway": "Path",
    "path": "Path",
    "pedestrian": "Path",
    "cycleway": "Cycleway",
}
# class: (carriageway width m, paved, footpath width m, material)
ROAD_ATTRS = {
    "Motorway": (12.0, True, 0.0, "ASPHALT"),
    "Trunk": (10.0, True, 0.0, "ASPHALT"),
    "Primary": (8.0, True, 1.5, "ASPHALT"),
    "Secondary": (7.0, True, 1.5, "ASPHALT"),
    "Tertiary": (6.0, True, 1.5, "ASPHALT"),
    "Residential": (6.0, True, 1.0, "ASPHALT"),
    "Service": (4.0, True, 0.0, "ASPHALT"),
    "Path": (2.0, False, 0.0, "GRAVEL"),
    "Cycleway": (2.0, False, 0.0, "CONCRETE"),
    "Other": (5.0, False, 0.0, "GRAVEL"),
}
# waterway type: (carve half width m, carve depth, profile half width m, profile depth m)
WATERWAY = {
    "river": (12.0, 5, 8.0, 2.0),
    "canal": (6.0, 4, 6.0, 2.5),
    "stream": (3.0, 3, 2.0, 0.8),
    "drain": (2.0, 2, 1.5, 0.6),
    "ditch": (1.5, 2, 0.8, 0.4),
}
WATERWAY_OTHER = (1.5, 2, 1.0, 0.5)
CHANNEL_TYPES = ["river", "stream", "canal", "drain", "ditch", "riverbank"]
RESERVOIR_TYPES = ["reservoir", "basin", "pond", "lagoon"]

# area type: land use class
LANDUSE_CLASS = {
    "residential": "Residential",
    "commercial": "Commercial",
    "industrial": "Industrial",
    "retail": "Retail",
    "forest": "Forest",
    "wood": "Forest",
    "farmland": "Farmland",
    "orchard": "Farmland",
    "vineyard": "Farmland",
    "meadow": "Meadow",
    "grass": "Meadow",
    "grassland": "Meadow",
}
LANDUSE_PRIORITY = {
    "Water": 5,
    "Residential": 4,
    "Commercial": 4,
    "Industrial": 4,
    "Retail": 4,
    "Farmland": 3,
    "Meadow": 3,
    "Forest": 2,
}
# area type: (priority, boundary strength, interior strength, kind, seeds support, line half width m, halo 1, halo 2)
GROUND_PROFILE = {
    "aerodrome": (1, 0.9, 0.95, "explicit", False, None, None, None),
    "recreation_ground": (1, 0.85, 1.0, "explicit", True, None, 0.85, 0.65),
    "pitch": (2, 1.0, 1.0, "explicit", True, None, None, None),
    "stadium": (2, 1.0, 1.0, "explicit", True, None, None, None),
    "sports_centre": (2, 1.0, 1.0, "explicit", True, None, None, None),
    "playground": (2, 1.0, 1.0, "explicit", False, None, None, None),
    "taxiway": (3, 0.95, 1.0, "explicit", True, 18.0, None, None),
    "apron": (3, 0.95, 1.0, "explicit", True, 25.0, None, None),
    "helipad": (3, 0.95, 1.0, "explicit", True, 12.0, None, None),
    "runway": (4, 1.0, 1.0, "explicit", True, 35.0, None, None),
    "park": (0, 0.75, 0.9, "support", False, None, 0.75, 0.5),
    "grass": (0, 0.75, 0.9, "support", False, None, 0.75, 0.5),
}
GROUND_FIELDS = [
    "priority", "boundary_strength", "interior_strength", "kind", "seeds_support", "line_half_width_m", "halo1", "halo2",
]

AMENITY_MODEL = {
    "bench": "bench",
    "waste_basket": "bin",
    "recycling": "bin",
    "post_box": "letterbox",
    "traffic_signals": "traffic_light",
}
# biome: (density, trunk min, trunk max, crown radius, crown shape)
VEGETATION = {
    "SubtropicalForest": (0.30, 7, 14, 4, "Sphere"),
    "RiparianCorridor": (0.30, 7, 14, 4, "Sphere"),
    "DrySclerophyllForest": (0.14, 5, 10, 3, "Cone"),
    "MontaneForest": (0.28, 6, 12, 3, "Cone"),
    "BorealForest": (0.28, 6, 12, 3, "Cone"),
    "SubtropicalGrassland": (0.05, 4, 8, 2, "Sparse"),
    "MangroveCoast": (0.22, 2, 5, 2, "Sphere"),
    "Wetland": (0.10, 3, 6, 2, "Sphere"),
    "Shrubland": (0.18, 0, 1, 2, "Shrub"),
    "Urban": (0.012, 4, 6, 2, "Sphere"),
    "Agricultural": (0.025, 4, 7, 2, "Sphere"),
}

# Tag allow-lists.
WAY_KEYS = [
    "building", "highway", "natural", "waterway", "leisure", "landuse", "railway", "barrier", "power", "aeroway",
    "man_made", "tourism", "historic", "amenity", "military", "healthcare", "public_transport", "addr:housenumber",
    "place",
]
GENERIC_KEYS = WAY_KEYS[10:]
HIGHWAY_ACCEPT = list(ROAD_CLASS)
NATURAL_AREAS = [
    "wood", "scrub", "heath", "grassland", "beach", "sand", "bare_rock", "cliff", "wetland", "glacier",
]
LEISURE_AREAS = ["pitch", "golf_course", "playground", "stadium", "sports_centre", "marina", "swimming_pool"]
BARRIERS = ["wall", "fence", "hedge", "retaining_wall", "guard_rail", "city_wall"]
POWER_LINES = ["line", "cable", "minor_line"]
WATERWAYS_ACCEPT = ["river", "canal", "stream", "drain"]
POI_KEYS = ["tourism", "historic", "man_made", "place", "healthcare", "military", "emergency", "shop", "office"]
POI_NATURAL = ["peak", "volcano", "cave_entrance", "spring", "waterfall"]


def lookup(key, table: dict, default=None, pick=lambda v: v) -> Column:
    """Map a column through a small fixed table with a literal map; no join needed."""
    pairs = [F.lit(x) for k, v in table.items() if pick(v) is not None for x in (k, pick(v))]
    found = F.element_at(F.create_map(*pairs), col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


# ---------------------------------------------------------------------------------------------------------
# Climate, biome, substrate
# ---------------------------------------------------------------------------------------------------------
def climate_zone(lat, elev) -> Column:
    band = F.floor(F.greatest(F.abs(col(lat)) + col(elev) / 150.0, F.lit(0.0)))
    out = None
    for top, name in CLIMATE_BANDS:
        cond = band <= top
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit("IceCap"))


def treeline_m(climate) -> Column:
    c = col(climate)
    return (
        F.when(c.isin("TropicalRainforest", "TropicalMonsoon"), 3500.0)
        .when(c == "HumidSubtropical", 1800.0)
        .when(c.isin(*TEMPERATE), 1200.0)
        .when(c == "SubarcticBoreal", 600.0)
        .when(c.isin("Tundra", "IceCap"), 0.0)
        .otherwise(2000.0)
    )


def biome(elev, slope, twi, coast_m, landuse, climate) -> Column:
    elev, slope, twi, coast_m, c = col(elev), col(slope), col(twi), col(coast_m), col(climate)
    use, line = col(landuse), treeline_m(climate)
    moist = twi > 7.0
    return (
        F.when(use.isin("Residential", "Commercial", "Industrial", "Retail"), "Urban")
        .when(use.isin("Farmland", "Meadow"), "Agricultural")
        .when(use == "Water", "Lake")
        .when(elev < 0.0, "Ocean")
        .when((coast_m < 500.0) & (slope > 20.0), "RockyCoast")
        .when((coast_m < 500.0) & (twi > 10.0), "MangroveCoast")
        .when(coast_m < 500.0, "Beach")
        .when(twi > 14.0, "Wetland")
        .when((twi > 10.0) & (slope < 5.0), "RiparianCorridor")
        .when(elev > line + 500.0, "IceCap")
        .when(elev > line, "AlpineGrassland")
        .when(c.isin(*TROPICAL) & (elev > 800.0), "MontaneForest")
        .when(c.isin(*TROPICAL), "SubtropicalForest")
        .when((c == "HumidSubtropical") & (elev > 600.0), "DrySclerophyllForest")
        .when((c == "HumidSubtropical") & moist, "SubtropicalForest")
        .when(c == "HumidSubtropical", "SubtropicalGrassland")
        .when(c.isin(*MEDITERRANEAN) & moist, "SubtropicalForest")
        .when(c.isin(*MEDITERRANEAN), "Shrubland")
        .when(c.isin(*TEMPERATE), "SubtropicalForest")
        .when(c == "SubarcticBoreal", "BorealForest")
        .when(c.isin(*DESERTS), "Desert")
        .when(c.isin(*STEPPES), "Shrubland")
        .when(c == "Tundra", "Tundra")
        .otherwise("IceCap")
    )


def substrate(biome_c, climate, slope, twi, tri, elev) -> Column:
    b, c, slope, twi, tri, elev = col(biome_c), col(climate), col(slope), col(twi), col(tri), col(elev)
    river = b.isin("RiparianCorridor", "River")
    grade = F.floor(F.greatest(slope, F.lit(0.0)))
    return (
        F.when(b == "Urban", "UrbanFill")
        .when(b.isin("Ocean", "Lake"), "Sand")
        .when(b == "Wetland", "Peat")
        .when(b == "Beach", "Sand")
        .when(b == "MangroveCoast", "Silty")
        .when((slope > 50.0) & (tri > 40.0), "BedRock")
        .when(river & (grade <= 1), "Silty")
        .when(river & (grade <= 4), "GreyClay")
        .when(river, "GravelBed")
        .when(b.isin("IceCap", "Tundra"), "Permafrost")
        .when(c.isin(*TROPICAL), "TropicalRed")
        .when((c == "HumidSubtropical") & (elev > 400.0), "Sandstone")
        .when((c == "HumidSubtropical") & (twi > 8.0), "GreyClay")
        .when(c == "HumidSubtropical", "RedClay")
        .when(c.isin(*MEDITERRANEAN), "Sandstone")
        .when(c.isin(*DESERTS), "Sand")
        .when(c.isin(*STEPPES), "RedClay")
        .otherwise("TemperateBrown")
    )


def classify_column(df, lat="lat", elev="z", slope="slope_deg", twi="twi", tri="tri", coast="coast_m",
                    landuse="landuse", ocean="ocean"):
    """Add climate (unless it is there), biome, substrate, soil depth and sealed flag; missing rasters take moderate defaults."""
    have = set(df.columns)

    def raster(name, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)

    use = F.col(landuse) if landuse in have else F.lit(None).cast("string")
    sea = F.coalesce(F.col(ocean), F.lit(False)) if ocean in have else F.lit(False)
    slope_c, twi_c, tri_c = raster(slope, 5.0), raster(twi, 7.0), raster(tri, 5.0)
    out = df if "climate" in have else df.withColumn("climate", climate_zone(lat, elev))
    out = out.withColumn(
        "biome",
        F.when(sea & (F.col(elev) <= 5.0) & ~use.eqNullSafe("Water"), "Ocean").otherwise(
            biome(elev, slope_c, twi_c, raster(coast, 100000.0), use, "climate")
        ),
    )
    out = out.withColumn("substrate", substrate("biome", "climate", slope_c, twi_c, tri_c, elev))
    return out.withColumn("soil_depth", big(lookup("substrate", SOIL_DEPTH))).withColumn(
        "sealed", F.col("substrate") == "UrbanFill"
    )


def moisture_class(twi) -> Column:
    t = col(twi)
    return F.when(t > 12.0, "Waterlogged").when(t > 8.0, "Wet").when(t > 5.0, "Moderate").otherwise("Dry")


def likely_river(acc, slope) -> Column:
    return (col(acc) > 500.0) & (col(slope) < 15.0)


def likely_cliff(slope, tri) -> Column:
    return (col(slope) > 45.0) & (col(tri) > 20.0)


# ---------------------------------------------------------------------------------------------------------
# Materials
# ---------------------------------------------------------------------------------------------------------
def _base_surface(biome_c, substrate_c) -> Column:
    b, s = col(biome_c), col(substrate_c)
    return (
        F.when(b.isin("Ocean", "Lake", "River"), "WATER")
        .when(b == "Beach", "SAND")
        .when(b.isin("Wetland", "RiparianCorridor", "MangroveCoast", "BorealForest"), "GRASS")
        .when(b == "Urban", "ASPHALT")
        .when(
            b.isin("Agricultural", "DrySclerophyllForest", "SubtropicalGrassland", "Shrubland", "Desert"), "GRASS_DRY"
        )
        .when(b.isin("AlpineGrassland", "Tundra", "IceCap"), "SNOW")
        .when(s.isin("BedRock", "Sandstone", "Granite", "Basalt"), "STONE")
        .when(s == "Sand", "SAND")
        .when(s == "UrbanFill", "ASPHALT")
        .when(s.isin("RedClay", "TropicalRed"), "LATERITE")
        .otherwise("GRASS")
    )


def surface_materials(biome_c, substrate_c, soil_depth, slope) -> Column:
    s, sub, depth = col(slope), col(substrate_c), big(col(soil_depth))
    base = _base_surface(biome_c, substrate_c)
    surface = (
        F.when(s > 65.0, "STONE")
        .when((s > 45.0) & ~base.isin("STONE", "SAND"), "DIRT")
        .when((s > 25.0) & (s <= 45.0) & (base == "GRASS"), "DIRT")
        .otherwise(base)
    )
    below = (
        F.when(sub == "Sand", "SAND")
        .when(sub == "UrbanFill", "CONCRETE")
        .when(sub.isin("BedRock", "Sandstone", "Granite", "Basalt"), "STONE")
        .when(sub.isin("RedClay", "TropicalRed"), "LATERITE")
        .otherwise("DIRT")
    )
    soil = (
        F.when(s > 65.0, F.lit(1))
        .when(s > 45.0, F.greatest(F.floor(depth / 2), F.lit(1)))
        .otherwise(depth)
    )
    return F.struct(surface.alias("surface"), below.alias("subsurface"), big(soil).alias("soil"))


def material_properties(df, key: str = "material"):
    """Add solid, transparent, density and colour columns by material name."""
    by_name = {v[0]: v for v in MATERIALS.values()}
    out = df
    for i, name, default, kind in (
        (1, "solid", False, "boolean"), (2, "transparent", True, "boolean"), (3, "density", 0.0, "double"),
        (4, "red", 0, "bigint"), (5, "green", 0, "bigint"), (6, "blue", 0, "bigint"),
    ):
        out = out.withColumn(name, lookup(key, by_name, default, lambda v, i=i: v[i]).cast(kind))
    return out


# ---------------------------------------------------------------------------------------------------------
# Roads, water, buildings, land use
# ---------------------------------------------------------------------------------------------------------
def road_class(highway) -> Column:
    return lookup(highway, ROAD_CLASS, "Other")


def road_width_m(cls) -> Column:
    return lookup(cls, ROAD_ATTRS, None, lambda v: v[0])


def road_paved(cls) -> Column:
    return lookup(cls, ROAD_ATTRS, None, lambda v: v[1])


def footpath_width_m(cls) -> Column:
    return lookup(cls, ROAD_ATTRS, None, lambda v: v[2])


def road_material(cls) -> Column:
    return lookup(cls, ROAD_ATTRS, None, lambda v: v[3])


def waterway_defaults(kind) -> Column:
    def at(i, cast):
        return lookup(kind, WATERWAY, WATERWAY_OTHER[i], lambda v: v[i]).cast(cast)

    return F.struct(
        at(0, "double").alias("half_width_m"),
        at(1, "bigint").alias("depth_vox"),
        at(2, "double").alias("base_half_width_m"),
        at(3, "double").alias("base_depth_m"),
    )


def building_height(tags) -> Column:
    """Explicit ``height`` in metres (an ``m`` suffix is allowed), else levels times three, else two levels."""
    t = col(tags)
    explicit = F.trim(F.regexp_replace(F.element_at(t, "height"), "m+$", "")).try_cast("double")
    levels = F.element_at(t, "building:levels").try_cast("double")
    return F.coalesce(explicit, F.coalesce(levels, F.lit(2.0)) * 3.0)


def landuse_class(area_type) -> Column:
    return lookup(area_type, LANDUSE_CLASS)


def landuse_priority(cls) -> Column:
    return lookup(cls, LANDUSE_PRIORITY).cast("bigint")


def ground_profile(area_type) -> Column:
    fields = []
    for i, name in enumerate(GROUND_FIELDS):
        fields.append(lookup(area_type, GROUND_PROFILE, None, lambda v, i=i: v[i]).alias(name))
    return F.struct(*fields)


def amenity_model(amenity) -> Column:
    return lookup(amenity, AMENITY_MODEL)


def node_model(tags) -> Column:
    t = col(tags)
    return (
        F.when(F.element_at(t, "highway") == "street_lamp", "streetlight")
        .when(
            (F.element_at(t, "highway") == "traffic_signals") | (F.element_at(t, "amenity") == "traffic_signals"),
            "traffic_light",
        )
        .when(F.element_at(t, "power") == "pole", "streetlight")
    )


def engineered_height(source, target, strength) -> Column:
    s = clamp(F.coalesce(col(strength), F.lit(0.0)), 0.0, 1.0)
    return F.when(s <= 0.05, col(source)).otherwise(col(source) + (col(target) - col(source)) * s)


def ortho_to_voxel_y(height, lat, lon, origin_alt, origin_vy) -> Column:
    """Orthometric height to a voxel row; the fraction is cut toward zero."""
    return big(col(origin_vy)) + big(col(height) + geoid_undulation(lat, lon) - col(origin_alt))


def bank_zone_width_m(half_width, depth) -> Column:
    return clamp(F.greatest(col(half_width) * 0.75, col(depth) * 2.0), 4.0, 24.0)


def reference_usable(status) -> Column:
    return ~F.endswith(col(status), F.lit("_context"))


def dem_plausible(z) -> Column:
    z = col(z)
    return z.isNotNull() & ~F.isnan(z) & (z > -1000.0) & (z < 10000.0)


# ---------------------------------------------------------------------------------------------------------
# Tags
# ---------------------------------------------------------------------------------------------------------
def tag_get(tags, key: str) -> Column:
    return F.element_at(col(tags), key)


def has_tag(tags, key: str, value: str | None = None) -> Column:
    if value is None:
        return F.map_contains_key(col(tags), key)
    return F.coalesce(F.element_at(col(tags), key) == value, F.lit(False))


def accept_way(tags) -> Column:
    return F.arrays_overlap(F.map_keys(col(tags)), F.array(*[F.lit(k) for k in WAY_KEYS]))


def accept_poi(tags) -> Column:
    return F.arrays_overlap(F.map_keys(col(tags)), F.array(*[F.lit(k) for k in POI_KEYS])) | F.coalesce(
        F.element_at(col(tags), "natural").isin(*POI_NATURAL), F.lit(False)
    )


def way_layers(tags, closed, profile: str = "import") -> Column:
    """Layers a way belongs to, by the first matching key; an empty array means it is dropped.

    ``import`` follows the extract importer (allow-lists, natural before waterway); ``live`` follows the
    service answer (no allow-lists for roads and barriers, water before leisure, aeroway before landuse).
    """
    t, none = col(tags), F.array().cast("array<string>")

    def has(k):
        return F.map_contains_key(t, k)

    def val(k):
        return F.element_at(t, k)

    def one(*names):
        return F.array(*[F.lit(n) for n in names])

    def keep(cond, layer):
        return F.when(cond, one(layer)).otherwise(none)

    closed = col(closed)
    if profile == "live":
        water = val("natural").isin("water", "riverbank") | has("waterway")
        return (
            F.when(has("building"), one("buildings"))
            .when(has("highway"), one("roads"))
            .when(water, F.when(closed | has("natural"), one("water")).otherwise(one("waterway_lines")))
            .when(val("leisure") == "park", one("parks"))
            .when(has("railway"), one("railways"))
            .when(has("barrier"), one("barriers"))
            .when(has("power"), one("power"))
            .when(has("aeroway"), one("aeroways"))
            .when(has("landuse"), one("land_areas"))
            .when(has("natural"), keep(val("natural").isin(*NATURAL_AREAS), "land_areas"))
            .when(has("leisure"), keep(val("leisure").isin(*LEISURE_AREAS), "land_areas"))
            .otherwise(none)
        )
    generic = F.arrays_overlap(F.map_keys(t), one(*GENERIC_KEYS))
    natural = (
        F.when(val("natural").isin("water", "riverbank"), one("water"))
        .when(val("natural").isin(*NATURAL_AREAS), one("land_areas"))
        .otherwise(none)
    )
    waterway = (
        F.when(val("waterway") == "dam", one("dams"))
        .when(val("waterway").isin(*WATERWAYS_ACCEPT), F.when(closed, one("water")).otherwise(one("waterway_lines")))
        .otherwise(none)
    )
    leisure = F.when(val("leisure") == "park", one("parks", "land_areas")).otherwise(
        keep(val("leisure").isin(*LEISURE_AREAS), "land_areas")
    )
    landuse = F.when(val("landuse") == "grass", one("parks", "land_areas")).otherwise(one("land_areas"))
    return (
        F.when(has("building"), one("buildings"))
        .when(has("highway"), keep(val("highway").isin(*HIGHWAY_ACCEPT), "roads"))
        .when(has("natural"), natural)
        .when(has("waterway"), waterway)
        .when(has("leisure"), leisure)
        .when(has("landuse"), landuse)
        .when(has("railway"), one("railways"))
        .when(has("barrier"), keep(val("barrier").isin(*BARRIERS), "barriers"))
        .when(has("power"), keep(val("power").isin(*POWER_LINES), "power"))
        .when(has("aeroway"), one("aeroways"))
        .when(generic, one("extra_ways"))
        .otherwise(none)
    )


def node_layers(tags) -> Column:
    """Layers of a node; one node may feed several."""
    t = col(tags)

    def when(cond, name):
        return F.when(cond, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))

    lamp = F.coalesce(F.element_at(t, "highway").isin("street_lamp", "traffic_signals"), F.lit(False))
    return F.concat(
        when(F.map_contains_key(t, "amenity"), "amenities"),
        when(F.coalesce(F.element_at(t, "power").isin("tower", "pole"), F.lit(False)), "power"),
        when(accept_poi(t) | lamp, "extra_nodes"),
    )


def way_attributes(tags, profile: str = "import") -> Column:
    t = col(tags)

    def flag(k):
        v = F.element_at(t, k)
        return F.coalesce(v == "yes" if profile == "live" else v != "no", F.lit(False))

    return F.struct(
        F.element_at(t, "name").alias("name"),
        flag("bridge").alias("is_bridge"),
        flag("tunnel").alias("is_tunnel"),
        F.coalesce(F.element_at(t, "layer").try_cast("bigint"), F.lit(0)).cast("bigint").alias("layer"),
        F.coalesce(
            F.element_at(t, "water"), F.element_at(t, "waterway"), F.element_at(t, "natural"), F.lit("water")
        ).alias("water_type"),
    )
