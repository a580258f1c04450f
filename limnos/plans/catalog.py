"""The default brand system and the catalogue of formats, as small tables and literals."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

# The default system.
TOKENS = (
    ("primary", 0x1A, 0x56, 0xDB, "primary"),
    ("primary-dark", 0x1E, 0x3A, 0x8A, "primary"),
    ("accent", 0xF5, 0x9E, 0x0B, "accent"),
    ("ink", 0x11, 0x18, 0x27, "ink"),
    ("muted", 0x6B, 0x72, 0x80, "text"),
    ("surface", 0xF3, 0xF4, 0xF6, "surface"),
    ("white", 0xFF, 0xFF, 0xFF, "surface"),
)
FONTS = ("Inter", "Helvetica Neue", "Arial", "sans-serif")
TYPE_SCALE = (12.0, 14.0, 16.0, 20.0, 24.0, 32.0, 48.0, 64.0)
STROKES = (1.0, 2.0, 4.0, 8.0)
MAX_COLORS, SNAP_WARNING, GRID, MIN_SIZE, ALIGN_TOLERANCE = 6, 0.18, 8.0, 4.0, 2.0
MIN_PRINT_STROKE, MAX_INK = 0.75, 300.0
CONTRAST_TEXT, CONTRAST_LARGE, LARGE_TEXT = 4.5, 3.0, 24.0
WEIGHTS = {"error": 5.0, "warning": 2.0, "info": 0.5}
LARGE_AREA, SMALL_AREA = 0.25, 0.05
SURFACE_ROLES, TEXT_ROLES, ACCENT_ROLES = ("surface", "background"), ("ink", "text"), ("primary", "accent")
# The status machine of requests.
EDGES = (
    ("Draft", "Queued"), ("Draft", "Failed"), ("Queued", "Processing"), ("Queued", "Failed"), ("Processing", "Ready"), ("Processing", "Failed"),
    ("Ready", "Delivered"), ("Ready", "Failed"), ("Delivered", "Failed"),
)


class Format(NamedTuple):
    name: str
    width: float
    height: float
    category: str
    margin: float = 0.05
    min_text: float = 0.0
    dpi: float = 96.0
    bleed: float | None = None


def mm(value: float, dpi: float) -> float:
    """Millimetres as pixels, to a tenth, ties to even."""
    return round(value * dpi / 25.4, 1)


# The built-in formats.
FORMATS = (
    Format("logo", 1024, 1024, "brand", 0.0), Format("icon", 512, 512, "brand", 0.0),
    Format("instagram-post", 1080, 1080, "social", min_text=24), Format("instagram-story", 1080, 1920, "social", 0.08, 28),
    Format("x-post", 1600, 900, "social", min_text=24), Format("facebook-cover", 1640, 856, "social", 0.08, 24),
    Format("linkedin-banner", 1584, 396, "social", 0.08, 20), Format("youtube-thumbnail", 1280, 720, "social", min_text=32),
    Format("a4-poster", 794, 1123, "print", min_text=12), Format("a3-poster", 1123, 1587, "print", min_text=14),
    Format("business-card", 336, 192, "print", 0.08, 7),
    Format("pen-barrel-70x15", mm(70, 300), mm(15, 300), "print", 0.08, mm(2, 300), 300, mm(2, 300)),
    Format("a1-poster", 7016, 9933, "print", min_text=44, dpi=300), Format("pullup-banner", 10039, 23622, "print", min_text=71, dpi=300),
    Format("signboard-2000x800", mm(2000, 150), mm(800, 150), "print", min_text=mm(25, 150), dpi=150),
    Format("z-fold-a4", mm(297, 300), mm(210, 300), "print", 0.06, mm(2.5, 300), 300),
    Format("corporate-folder-a4", mm(445, 300), mm(385, 300), "print", 0.03, mm(2.5, 300), 300),
    Format("web-leaderboard", 728, 90, "web", 0.06, 12), Format("web-mpu", 300, 250, "web", 0.06, 12), Format("og-image", 1200, 630, "web", min_text=24),
    Format("slide-16x9", 1920, 1080, "presentation", min_text=18),
    Format("tutor-card", 1080, 1440, "app", 0.0), Format("tutor-avatar", 512, 512, "app", 0.0), Format("tutor-avatar-small", 168, 168, "app", 0.0),
    Format("onboarding-slide", 1080, 1920, "app", 0.0), Format("onboarding-card", 1080, 1350, "app", 0.0),
)


def formats(spark: SparkSession) -> DataFrame:
    rows = [(f.name, float(f.width), float(f.height), f.category, float(f.margin), float(f.min_text), float(f.dpi), f.bleed) for f in FORMATS]
    return spark.createDataFrame(rows, "name string, width double, height double, category string, margin double, min_text double, dpi double, bleed double")


def format_named(name: str) -> Format:
    found = {f.name: f for f in FORMATS}
    if name not in found:
        raise ValueError(f"no format {name}; known: {', '.join(sorted(found))}")
    return found[name]
