"""Fixed word lists and constants of the field rules."""

from __future__ import annotations

# Address keywords, matched as substrings.
ADDRESS_KEYWORDS = ("JALAN", "KAMPUNG", "TAMAN", "STREET", "STRASSE", "AVENUE", "ROAD", "RUA", "VIA", "LORONG")
# Whole-block stopwords.
STOPWORDS = (
    "MALAYSIA", "MYKAD", "MYKID", "IDENTITY", "WARGANEGARA", "ISLAM", "LELAKI", "PEREMPUAN", "PASSPORT", "REPUBLIC",
    "LICENCE", "LICENSE", "SPECIMEN", "KAD PENGENALAN", "KADPENGENALAN", "IDENTITY CARD", "IDENTITYCARD",
    "NO DAFTAR KELAHIRAN", "PEMASTAUTIN TETAP", "NEGERI LAHIR", "INITIAL", "ACKNOWLEDGMENT SENT", "IMMEDIATE ADVISE",
    "DATE", "RM", "RATE",
)
# Particles between given name and father's name.
NAME_PARTICLES = ("A/L", "A/P", "BINTI", "BINTE", "BINT", "BIN")
# Labels of the pretrained entity model, by field.
ENTITY_LABELS = {"name": ("GIVENNAME", "SURNAME"), "address": ("STREET", "BUILDINGNUM", "CITY", "ZIPCODE"), "birth_date": ("DATEOFBIRTH",)}
# Thresholds of the rule layer.
NGRAM, SMOOTHING, MIN_OVERLAP, INLIER_K, GAP_FRACTION, SOFT_THRESHOLD = 3, 1.0, 0.6, 4.0, 0.05, 0.15
SEED_THRESHOLD, BOILERPLATE_THRESHOLD, NAME_LEAK, PLAIN_ADDRESS = 0.15, 0.15, 0.7, 0.5
FIELDS = ("name", "birth_date", "address")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
