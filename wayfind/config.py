"""Engine configuration: one frozen value, read from defaults, a Python file and the environment."""

from __future__ import annotations

import os
import runpy
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keys next to each on an azerty keyboard, for substitutions.
FUZZY_KEY_MAP = {
    "a": "ezqop", "z": "aqse", "e": "azsdryu", "r": "edft", "t": "rfgy", "y": "teghu", "u": "yehji", "i": "ujko", "o": "iaklp", "p": "oalm",
    "q": "azsw", "s": "qzedxw", "d": "serfcx", "f": "drtgvc", "g": "ftyhbv", "h": "gyujnb", "j": "huikn", "k": "jil", "l": "kom", "m": "lpu",
    "w": "qsx", "x": "wsdc", "c": "xdfvio", "v": "cfgb", "b": "vghn", "n": "bhj",
}


@dataclass(frozen=True)
class FieldSpec:
    """An indexed field. boost: a number, or a function that gives a Column over the documents."""

    key: str
    boost: float | Callable[[], Column] = 1.0
    nullable: bool = True
    kind: str | None = None


def postcode_boost() -> Column:
    return F.when(F.array_contains("type", "municipality"), F.lit(1.2)).otherwise(F.lit(1.0))


FIELDS = (
    FieldSpec("name", 4.0, nullable=False, kind="name"), FieldSpec("street"), FieldSpec("postcode", postcode_boost), FieldSpec("city"),
    FieldSpec("housenumbers", kind="housenumbers"), FieldSpec("context"),
)


@dataclass(frozen=True)
class EngineConfig:
    #: Limits, thresholds and weights of search.
    bucket_min: int = 10
    bucket_max: int = 100
    filters_multi_value_separator: str | None = " "
    max_filter_values: int = 10
    common_threshold: int = 10_000
    intersect_limit: int = 100_000
    match_threshold: float = 0.9
    min_score: float = 0.1
    query_max_length: int = 200
    geohash_precision: int = 7
    min_edge_ngrams: int = 3
    max_edge_ngrams: int = 20
    importance_weight: float = 0.1
    geo_distance_weight: float = 0.1
    default_boost: float = 1.0
    max_meaningful: int = 10
    scan_rows: int = 501
    attribution: str = "BANO"
    licence: str = "ODbL"
    filters: tuple[str, ...] = ("type", "postcode")
    fields: tuple[FieldSpec, ...] = FIELDS
    extra_fields: tuple[FieldSpec, ...] = ()
    synonyms: dict[str, str] = field(default_factory=dict)
    fuzzy_key_map: dict[str, str] | None = field(default_factory=lambda: dict(FUZZY_KEY_MAP))
    collectors: tuple[str, ...] = (
        "commons_near_center_autocomplete", "housenumbers_near_center", "stop_without_tokens", "only_commons", "commons_autocomplete_then_judge", "commons_autocomplete",
        "meaningful", "reduce_with_commons", "near_center", "autocomplete", "fuzzy", "relations", "fewer_tokens",
    )
    scorer: str = "ngrams"

    @property
    def indexed(self) -> tuple[FieldSpec, ...]:
        return self.fields + self.extra_fields

    @property
    def name_field(self) -> str:
        return next((f.key for f in self.indexed if f.kind == "name"), "name")

    @property
    def housenumbers_field(self) -> str:
        return next((f.key for f in self.indexed if f.kind == "housenumbers"), "housenumbers")


def load_synonyms(lines) -> dict[str, str]:
    """`a, b => c` lines: a and b become c. Comments start with #; blanks in the list are passed over; the last of equal terms wins."""
    out = {}
    for line in lines:
        line = line.strip()
        if line.startswith("#") or "=>" not in line:
            continue
        terms, to = line.split("=>", 1)
        out |= {t.strip(): to.strip() for t in terms.split(",") if t.strip()}
    return out


def _typed(default, text: str):
    if isinstance(default, bool):
        return text.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(default, (int, float)):
        return type(default)(text)
    if isinstance(default, tuple):
        return tuple(x.strip() for x in text.split(",") if x.strip())
    return text


def load_config(path: str | None = None, env: dict[str, str] | None = None, prefix: str = "WAYFIND_", defaults: dict | None = None, **overrides) -> EngineConfig:
    """Defaults (those given before the engine's own), then the upper-case names of the Python file at `path`, then PREFIX_NAME of the environment (as the default's type; tuples split on commas), then overrides. A file may add extra_fields and name a synonyms_path."""
    env = os.environ if env is None else env
    values: dict = {}
    known = {f.name: getattr(EngineConfig(), f.name) for f in fields(EngineConfig)}
    synonyms_path = None
    if path := path or env.get(f"{prefix}CONFIG"):
        found = {k.lower(): v for k, v in runpy.run_path(path).items() if k.isupper()}
        synonyms_path = found.pop("synonyms_path", None)
        values |= {k: tuple(v) if isinstance(known[k], tuple) else v for k, v in found.items() if k in known}
    values |= {k: _typed(v, env[f"{prefix}{k.upper()}"]) for k, v in known.items() if f"{prefix}{k.upper()}" in env and k not in ("fields", "extra_fields", "synonyms", "fuzzy_key_map")}
    if synonyms_path := env.get(f"{prefix}SYNONYMS_PATH", synonyms_path):
        with open(synonyms_path) as lines:
            values["synonyms"] = load_synonyms(lines)
    return replace(EngineConfig(), **((defaults or {}) | values | overrides))
