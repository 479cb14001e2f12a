"""Quantities of materials from dimensions: Column arithmetic over tables of coefficients."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.units import TMT_KG_PER_M

#: Factors, wastage, mixes (cement, sand, aggregate), masonry units (length, width, height, joint in mm), mortars, steel bands.
DRY, MORTAR_DRY, CEMENT_KG_M3, BAG_KG, CFT = 1.54, 1.33, 1440.0, 50.0, 35.3147
WASTAGE = {"concrete": 0.03, "brick": 0.05, "steel": 0.03, "pipe": 0.05, "mortar": 0.15}
MIXES = {"M5": (1, 5, 10), "M7.5": (1, 4, 8), "M10": (1, 3, 6), "M15": (1, 2, 4), "M20": (1, 1.5, 3), "M25": (1, 1, 2)}
UNITS = {
    "clay_230": (230, 110, 75, 10),
    "clay_modular_190": (190, 90, 90, 10),
    "flyash_230": (230, 110, 75, 10),
    "aac_600x200x100": (600, 200, 100, 10),
    "aac_600x200x150": (600, 200, 150, 10),
    "aac_600x200x200": (600, 200, 200, 10),
    "concrete_400x200x100": (400, 200, 100, 10),
    "concrete_400x200x200": (400, 200, 200, 10),
}
MORTARS = {"cm_1_3": (1, 3), "cm_1_4": (1, 4), "cm_1_5": (1, 5), "cm_1_6": (1, 6)}
STEEL = {"footing": (40, 80), "column": (80, 250), "beam": (80, 160), "slab": (50, 90), "lintel": (50, 100), "staircase": (80, 150)}


def _of(table: dict, key: Column, place: int) -> Column:
    out = F.lit(None).cast("double")
    for name, row in table.items():
        out = F.when(key == name, F.lit(float(row[place]))).otherwise(out)
    return out


def _bags(cement_m3: Column) -> Column:
    return cement_m3 * CEMENT_KG_M3 / BAG_KG


def _up(x: Column, step: float = 1) -> Column:
    """Bought in whole steps; a hair over a step is that step."""
    return (F.ceil(F.round(x / step, 9)) * step).cast("bigint")


def concrete(volume_m3: Column, grade: Column, wastage: float | None = None) -> dict[str, Column]:
    """Bags of cement, cubic feet of sand and aggregate; null for a grade without a nominal mix."""
    w = WASTAGE["concrete"] if wastage is None else wastage
    c, s, a = (_of(MIXES, F.upper(F.trim(grade)), i) for i in range(3))
    dry = volume_m3 * DRY * (1 + w)
    total = c + s + a
    bags = _bags(dry * c / total)
    return {"cement_bags": bags, "buy_bags": _up(bags), "sand_cft": dry * s / total * CFT, "aggregate_cft": dry * a / total * CFT}


def mortar(dry_m3: Column, mix: Column) -> dict[str, Column]:
    c, s = _of(MORTARS, mix, 0), _of(MORTARS, mix, 1)
    return {"cement_bags": _bags(dry_m3 * c / (c + s)), "sand_cft": dry_m3 * s / (c + s) * CFT}


def masonry(area_m2: Column, unit: Column, mix: Column, thickness_mm: Column | None = None, openings: Column | None = None, wastage: float | None = None) -> dict[str, Column]:
    """Units, and cement and sand of the mortar. A block wall is one block thick, a brick wall one brick long."""
    w = WASTAGE["brick"] if wastage is None else wastage
    length, width, height, joint = (_of(UNITS, unit, i) for i in range(4))
    block = unit.startswith("aac") | unit.startswith("concrete")
    default = F.when(block, height).otherwise(length)
    thick = default if thickness_mm is None else F.coalesce(thickness_mm.cast("double"), default)
    per_m3 = 1 / ((length + joint) / 1000 * ((width + joint) / 1000) * ((height + joint) / 1000))
    net = area_m2 * (thick / 1000) * (1 - (F.lit(0.0) if openings is None else F.coalesce(openings.cast("double"), F.lit(0.0))))
    units = net * per_m3 * (1 + w)
    solid = net * per_m3 * (length * width * height) / 1e9
    dry = F.greatest(F.lit(0.0), net - solid) * MORTAR_DRY * (1 + WASTAGE["mortar"])
    return {"units_per_m3": per_m3, "units": units, "buy_units": _up(units)} | mortar(dry, mix)


def plaster(area_m2: Column, mix: Column, thickness_mm: Column | None = None, faces: Column | None = None) -> dict[str, Column]:
    t = F.lit(12.0) if thickness_mm is None else F.coalesce(thickness_mm.cast("double"), F.lit(12.0))
    n = F.lit(1) if faces is None else F.coalesce(faces, F.lit(1))
    return mortar(area_m2 * n * (t / 1000) * MORTAR_DRY * (1 + WASTAGE["mortar"]), mix)


def steel(volume_m3: Column, element: Column, diameter_mm: Column | None = None, rod_m: Column | None = None) -> dict[str, Column]:
    """A band of kilograms, and of rods where a diameter is given; never its middle."""
    w = 1 + WASTAGE["steel"]
    low, high = volume_m3 * _of(STEEL, element, 0) * w, volume_m3 * _of(STEEL, element, 1) * w
    out = {"low_kg": low, "high_kg": high, "buy_kg": _up(low, 10)}
    if diameter_mm is not None:
        rod = _of({str(k): (v,) for k, v in TMT_KG_PER_M.items()}, diameter_mm.cast("string"), 0) * (F.lit(12.0) if rod_m is None else F.coalesce(rod_m.cast("double"), F.lit(12.0)))
        out |= {"low_rods": _up(low / rod), "high_rods": _up(high / rod)}
    return out


def pipe(run_m: Column, length_m: Column | None = None) -> dict[str, Column]:
    need = run_m * (1 + WASTAGE["pipe"])
    each = F.lit(3.0) if length_m is None else F.coalesce(length_m.cast("double"), F.lit(3.0))
    return {"metres": need, "lengths": _up(need / each)}


def dimensions(text: Column) -> Column:
    """STRUCT<volume_m3, area_m2, ambiguous> of '10 ft x 12 ft x 4 in', '20x30 ft' or '3.5 m3'.

    A stated volume wins; a part without a unit takes the last one's; without any
    unit the text is ambiguous and has no figures.
    """
    low = F.regexp_replace(F.lower(text), "[×*]", "x")
    m3 = F.regexp_extract(low, r"(\d+(?:\.\d+)?)\s*(?:m3|m³|cum|cubic\s?met(?:re|er)s?)", 1).try_cast("double")
    cft = F.regexp_extract(low, r"(\d+(?:\.\d+)?)\s*(?:cft|ft3|cubic\s?f(?:ee|oo)t)", 1).try_cast("double")
    unit = r"(mm|cm|feet|foot|ft|inches|inch|in|metres?|meters?|mtr|m|'|\")?"
    found = [F.regexp_extract(low, rf"(\d+(?:\.\d+)?)\s*{unit}\s*x\s*(\d+(?:\.\d+)?)\s*{unit}(?:\s*x\s*(\d+(?:\.\d+)?)\s*{unit})?", i) for i in range(1, 7)]
    numbers, units = [found[i].try_cast("double") for i in (0, 2, 4)], [F.when(found[i] != "", found[i]) for i in (1, 3, 5)]
    last = F.coalesce(units[2], units[1], units[0])
    scale = lambda u: F.when(u == "mm", 0.001).when(u == "cm", 0.01).when(u.isin("feet", "foot", "ft", "'"), 0.3048).when(u.isin("inches", "inch", "in", '"'), 0.0254).otherwise(1.0)
    metres = [n * scale(F.coalesce(u, last)) for n, u in zip(numbers, units)]
    stated = F.coalesce(m3, cft / CFT)
    known = last.isNotNull()
    return F.struct(
        F.coalesce(stated, F.when(known, metres[0] * metres[1] * metres[2])).alias("volume_m3"),
        F.when(stated.isNull() & known, metres[0] * metres[1]).alias("area_m2"),
        (stated.isNull() & numbers[0].isNotNull() & ~known).alias("ambiguous"),
    )


#: For each duty of a wall, the blocks that suit it, the first one preferred.
DUTY_GUIDE = {
    "below_dpc": ("Red clay brick", "Concrete solid block"),
    "load_bearing": ("Red clay brick", "Concrete solid block", "Fly ash brick"),
    "framed_infill": ("AAC block", "CLC block", "Fly ash brick"),
    "external_envelope": ("AAC block", "Red clay brick", "Concrete hollow block"),
    "compound_wall": ("Concrete solid block", "Fly ash brick", "Red clay brick"),
}


def blocks_for(duty: Column) -> Column:
    """The blocks that suit a wall's duty, in order; null for an unknown duty."""
    out = F.lit(None).cast("array<string>")
    for name, blocks in DUTY_GUIDE.items():
        out = F.when(duty == name, F.array(*map(F.lit, blocks))).otherwise(out)
    return out


def run(kind: str, **given) -> dict[str, Column]:
    """An estimate by the name of its kind: the registry that tools call."""
    kinds = {"concrete": concrete, "masonry": masonry, "plaster": plaster, "steel": steel, "pipe": pipe}
    if kind not in kinds:
        raise ValueError(f"unknown estimate {kind!r}; known: {', '.join(kinds)}")
    return kinds[kind](**given)
