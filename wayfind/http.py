"""A WSGI application over an engine: /search, /reverse and /health."""

from __future__ import annotations

import json
import time
from urllib.parse import parse_qs

from wayfind.plans.search import Engine, QueryTooLong
from wayfind.sources.sinks import collections


class Refused(Exception):
    def __init__(self, status: str, title: str, description: str | None = None):
        self.status, self.body = status, {"title": title, **({"description": description} if description else {})}


def invalid(name: str, why: str) -> Refused:
    return Refused("400 Bad Request", "Invalid parameter", f'The "{name}" parameter is invalid. {why}')


def missing(name: str) -> Refused:
    return Refused("400 Bad Request", "Missing parameter", f'The "{name}" parameter is required.')


class App:
    """routes: path to a function of the parameters (lists of strings) that gives a JSON text; plugins may add more."""

    def __init__(self, engine: Engine, slow_ms: int = 0, log=None):
        self.engine, self.slow_ms, self.log = engine, slow_ms, log
        self.routes = {"/search": self.search, "/reverse": self.reverse, "/health": self.health}
        self.headers = [("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Headers", "X-Requested-With")]

    def __call__(self, environ, start_response):
        path = environ.get("PATH_INFO", "").rstrip("/") or "/"
        params = parse_qs(environ.get("QUERY_STRING", ""), keep_blank_values=False)
        try:
            if path not in self.routes:
                raise Refused("404 Not Found", "404 Not Found")
            status, text = "200 OK", self.routes[path](params)
        except Refused as e:
            status, text = e.status, json.dumps(e.body)
        start_response(status, [("Content-Type", "application/json; charset=utf-8"), *self.headers])
        return [text.encode()]

    def number(self, params, *names: str) -> float | None:
        for name in names:
            if name in params:
                try:
                    return float(params[name][-1])
                except ValueError:
                    raise invalid(name, "invalid value") from None
        return None

    def whole(self, params, name: str) -> int | None:
        if name not in params:
            return None
        try:
            return int(params[name][-1])
        except ValueError:
            raise invalid(name, "The value must be an integer.") from None

    def center(self, params) -> tuple[float | None, float | None]:
        lat, lon = self.number(params, "lat", "latitude"), self.number(params, "lon", "lng", "long", "longitude")
        if lon is not None and abs(lon) > 180:
            raise invalid("lon", "out of range")
        if lat is not None and abs(lat) > 90:
            raise invalid("lat", "out of range")
        return lat, lon

    def filters(self, params) -> dict[str, list[str]]:
        cut = self.engine.config.filters_multi_value_separator
        out = {}
        for name in self.engine.config.filters:
            values = [v for x in params.get(name, []) for v in (x.split(cut) if cut else [x])]
            if values := [v.strip() for v in values if v.strip()]:
                out[name] = values
        return out

    def search(self, params) -> str:
        q = params.get("q", [""])[-1]
        if not q:
            raise missing("q")
        limit = self.whole(params, "limit") or 5
        if not 1 <= limit <= 100:
            raise invalid("limit", "out of range (1..100)")
        flag = params.get("autocomplete", ["1"])[-1].lower()
        if flag not in ("1", "0", "true", "false", "yes", "no", "on", "off", "t", "f", "y", "n"):
            raise invalid("autocomplete", "The value must be a boolean.")
        lat, lon = self.center(params)
        rows = self.engine.queries([{"q": q, "limit": limit, "autocomplete": flag in ("1", "true", "yes", "on", "t", "y"), "lat": lat, "lon": lon, "filters": self.filters(params)}])
        began = time.perf_counter()
        try:
            text = collections(self.engine.search(rows, whole=True), rows, self.engine.config).first().geojson
        except QueryTooLong as e:
            raise Refused("413 Content Too Large", str(e)) from None
        if self.log:
            self.log(q, text, int((time.perf_counter() - began) * 1000))
        return text

    def reverse(self, params) -> str:
        lat, lon = self.center(params)
        if lon is None:
            raise missing("lon")
        if lat is None:
            raise missing("lat")
        row = (0, lat, lon, self.whole(params, "limit") or 1, self.filters(params))
        rows = self.engine.spark.createDataFrame([row], "query_id long, lat double, lon double, limit int, filters map<string,array<string>>")
        return collections(self.engine.reverse(rows, whole=True), rows, self.engine.config).first().geojson

    def health(self, params) -> str:
        return json.dumps({"status": "HEALTHY", "spark_version": self.engine.spark.version})
