"""The search shell's query language: options and filters inside a query, and its commands by name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from wayfind.config import EngineConfig
from wayfind.operators import inspect
from wayfind.plans.search import Engine


def match_option(key: str, query: str) -> tuple[str, str | None]:
    """`KEY value` or `KEY=value`, taken out of the query."""
    if found := re.search(rf"{key}[= ]([^ ]*)", query):
        return (query[: found.start()] + query[found.end() :]).strip(), found[1].strip(" =")
    return query.strip(), None


def parse_filters(query: str, config: EngineConfig = EngineConfig()) -> tuple[str, dict]:
    """Filters by their upper-case names, repeated or with values parted by |; blanks are dropped, a single value stays a string."""
    out: dict = {}
    for name in config.filters:
        option = re.compile(rf"{name.upper()}[= ]([^ ]*)")
        if values := [v.strip() for found in option.findall(query) for v in found.split("|") if v.strip()]:
            query = option.sub("", query).strip()
            out[name] = values if len(values) > 1 else values[0]
    return query, out


def parse_query(line: str, config: EngineConfig = EngineConfig()) -> dict:
    """A line as a query: AUTOCOMPLETE 0|1, LIMIT n, CENTER lat lon (or lat,lon), filters, the rest is text."""
    out: dict = {"limit": 10, "autocomplete": True}
    line, flag = match_option("AUTOCOMPLETE", line)
    if flag is not None:
        out["autocomplete"] = bool(int(flag))
    line, limit = match_option("LIMIT", line)
    if limit is not None:
        out["limit"] = int(limit)
    if center := re.search(r"CENTER[= ](-?[\d.]+)[ ,](-?[\d.]+)", line):
        out["lat"], out["lon"] = float(center[1]), float(center[2])
        line = line.replace(center[0], "").strip()
    line, out["filters"] = parse_filters(line, config)
    return out | {"q": line.strip()}


class Shell:
    """One method for each command; run() takes a line, whose first word is a command or the start of a search."""

    def __init__(self, engine: Engine):
        self.engine, self.index, self.config, self.spark = engine, engine.index, engine.config, engine.spark
        self.commands = {k[3:]: getattr(self, k) for k in dir(self) if k.startswith("do_")}

    def run(self, line: str):
        word, _, rest = line.strip().partition(" ")
        return self.commands[word](rest.strip()) if word in self.commands else self.do_SEARCH(line.strip())

    def _word(self, s: str) -> str:
        return inspect.tokenize(self.spark, s, self.config).first().tok

    def _point(self, s: str) -> tuple[float, float]:
        lat, lon = re.split(r"[ ,]+", s.strip())[:2]
        return float(lat), float(lon)

    def do_SEARCH(self, s: str) -> DataFrame:
        return self.engine.search(self.engine.queries([parse_query(s, self.config)])).orderBy("rank")

    def do_EXPLAIN(self, s: str) -> DataFrame:
        """Results with every score and the keys that matched."""
        rows = self.engine.search(self.engine.queries([parse_query(s, self.config)]), whole=True)
        return rows.select("rank", "doc_id", "label", "score", "str_distance", "importance_score", "geo_score", "matched").orderBy("rank")

    def do_BUCKET(self, s: str) -> DataFrame:
        return self.engine.candidates(self.engine.queries([parse_query(s, self.config)])).select("rank", "doc_id", "label", "score").orderBy("rank")

    def do_REVERSE(self, s: str) -> DataFrame:
        s, limit = match_option("LIMIT", s)
        s, filters = parse_filters(s, self.config)
        lat, lon = self._point(s)
        f = {k: v if isinstance(v, list) else [v] for k, v in filters.items()}
        row = [(0, lat, lon, int(limit or 1), f)]
        return self.engine.reverse(self.spark.createDataFrame(row, "query_id long, lat double, lon double, limit int, filters map<string,array<string>>"))

    def do_INTERSECT(self, s: str) -> DataFrame:
        s, limit = match_option("LIMIT", s)
        tokens = [r.tok for r in inspect.tokenize(self.spark, s, self.config).collect()]
        return inspect.intersect(self.index, tokens, int(limit or 100))

    def do_INDEX(self, s: str) -> DataFrame:
        return inspect.index_rank(self.index, s)

    def do_FREQUENCY(self, s: str) -> DataFrame:
        return inspect.frequency(self.index, self._word(s))

    def do_BESTSCORE(self, s: str) -> DataFrame:
        return inspect.best_score(self.index, self._word(s))

    def do_PAIR(self, s: str) -> DataFrame:
        return inspect.pair(self.index, self._word(s))

    def do_AUTOCOMPLETE(self, s: str) -> DataFrame:
        return inspect.autocomplete(self.index, self._word(s))

    def do_FUZZY(self, s: str) -> DataFrame:
        return inspect.fuzzy(self.spark, self._word(s), self.config)

    def do_FUZZYINDEX(self, s: str) -> DataFrame:
        return inspect.fuzzy_index(self.index, self._word(s), self.config)

    def do_GEODISTANCE(self, s: str) -> DataFrame:
        doc_id, _, point = s.partition(" ")
        return inspect.geo_distance(self.index, doc_id, *self._point(point))

    def do_GEOHASH(self, s: str) -> DataFrame:
        return inspect.geohash_of(self.spark, *self._point(s), self.config)

    def do_GEOHASHTOGEOJSON(self, s: str) -> DataFrame:
        s, n = match_option("NEIGHBORS", s)
        return inspect.geohash_to_geojson(self.spark, *self._point(s), int(n or 0), self.config)

    def do_GEOHASHMEMBERS(self, s: str) -> DataFrame:
        s, n = match_option("NEIGHBORS", s)
        return inspect.geohash_members(self.index, s, n != "0")

    def do_GET(self, s: str) -> DataFrame:
        return inspect.get(self.index, s)

    def do_TOKENIZE(self, s: str) -> DataFrame:
        return inspect.tokenize(self.spark, s, self.config)

    def do_STRDISTANCE(self, s: str) -> DataFrame:
        return inspect.string_distance(self.spark, *s.split("|", 1))

    def do_CONFIG(self, s: str):
        return getattr(self.config, s.lower()) if s else self.config

    def do_DBINFO(self, s: str) -> dict[str, int]:
        return inspect.info(self.index)
