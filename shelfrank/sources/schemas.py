"""Schemas of the catalogue, of conversation messages and of chip documents."""

from __future__ import annotations

from pyspark.sql.types import StructType

_BOX = "struct<value: double, unit: string>"
_META = "struct<brand: string, model: string, lifecycle: string, variants: array<struct<name: string, link: string>>, releaseDate: string, releaseStatus: string>"
_SPECS = "map<string, map<string, string>>"
_CAMERAS = "array<struct<megapixel: double, position: string, type: string>>"

DISPLAY = f"struct<type: struct<type: string, score: double>, brightness: {_BOX}, refreshRate: {_BOX}, ppi: {_BOX}, colorDepth: {_BOX}, resolution: struct<value: string, unit: string>, hdr: struct<type: string, score: double>>"
BATTERY = f"struct<capacity: {_BOX}, fastCharging: struct<supported: boolean, power: {_BOX}>>"
CAMERA = f"struct<rearCamera: {_CAMERAS}, frontCamera: {_CAMERAS}, ois: string>"
TECHNICAL = "struct<chipset: string, benchmark: struct<antutu: struct<total: string, breakdown: map<string, string>>, geekbench: struct<breakdown: map<string, string>>>>"
EXTRACTED = f"struct<display: {DISPLAY}, battery: {BATTERY}, camera: {CAMERA}, technical: {TECHNICAL}>"

CATALOGUE = f"_id string, link string, title string, brand string, price double, success boolean, images array<string>, parseHtmlSpec struct<meta: {_META}, specs: {_SPECS}>, normalizedSpecs struct<meta: {_META}, specs: {_SPECS}, extracted: {EXTRACTED}>, createdAt timestamp, updatedAt timestamp"



def struct_of(columns: str) -> str:
    """A column list as a struct type."""
    return StructType.fromDDL(columns).simpleString()


LIFECYCLES = ("unknown", "considerable")

PRODUCTS = "array<struct<title: string, verdict: string, price: double, link: string, brand: string, dbRecordId: string, images: array<string>>>"
MESSAGE = f"thread_id string, seq bigint, type string, role string, content string, timestamp timestamp, products {PRODUCTS}"

_PAIRS = "map<string, string>"
CHIP = f"title string, description string, reviewScores array<struct<name: string, value: string>>, antutu struct<total: string, breakdown: {_PAIRS}>, recentAntutu array<struct<date: string, score: string, user: string, phone: string>>, geekbench struct<breakdown: {_PAIRS}>, smartphones array<struct<name: string, url: string, score: string>>, sections map<string, {_PAIRS}>"
LISTING = "title string, price string, description string, link string, image string, rating string"
RANKING = "name string, brand string, rating string, antutu string, geekbench string, cores string, clock string, gpu string, href string"
