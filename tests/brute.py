"""Search one query at a time over plain dicts: what the batch plans are held against."""

import math
import re
import unicodedata
from collections import Counter, defaultdict

from wayfind.plans.collect import interlinked


def norm(s):
    s = s.lower().replace("ß", "ss").replace("œ", "oe").replace("æ", "ae")
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def fold(s):
    return re.sub(" {2,}", " ", re.sub(r"[^\w]", " ", norm(s))).strip()


def toks(s):
    return [norm(x) for x in re.findall(r"\w+", s)]


def sim(a, b):
    if len(a) == len(b) == 1:
        return float(a == b)
    x, y = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (a, b))
    n = sum((x & y).values())
    return n / (sum(x.values()) + sum(y.values()) - n) if n else 0.0


def km(lat1, lon1, lat2, lon2):
    a, b, c, d = map(math.radians, (lat1, lon1, lat2, lon2))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * math.asin(math.sqrt(h)) * 6367


def cell(lat, lon):
    return math.floor((lon + 180) / 360 * 2**18), math.floor((lat + 90) / 180 * 2**17)


class Brute:
    """docs: dicts with doc_id, type, name, postcode, city, context (lists or None), importance, lat, lon, housenumbers (key to raw, lat, lon)."""

    def __init__(self, docs, config):
        self.c, self.docs = config, {d["doc_id"]: d for d in docs}
        self.post, self.facets, self.cells = defaultdict(dict), {}, defaultdict(set)
        for d in docs:
            for key, boost in (("name", 4.0), ("street", 1.0), ("postcode", 1.2 if "municipality" in (d["type"] or []) else 1.0), ("city", 1.0), ("context", 1.0)):
                for v in d.get(key) or []:
                    t = toks(v)
                    for x in t:
                        b = 1.0 / len(t) * (boost + d["importance"] * 0.1)
                        self.post[x][d["doc_id"]] = max(b, self.post[x].get(d["doc_id"], 0))
            self.facets[d["doc_id"]] = {("type", v) for v in d["type"] or []} | {("postcode", v) for v in d["postcode"] or []} | ({("type", "housenumber")} if d["housenumbers"] else set())
            for lat, lon in [(d["lat"], d["lon"]), *((h["lat"], h["lon"]) for h in d["housenumbers"].values())]:
                self.cells[cell(lat, lon)].add(d["doc_id"])
        self.of = defaultdict(set)
        for t, ds in self.post.items():
            for x in ds:
                self.of[x].add(t)
        self.ngrams = defaultdict(set)
        for t in self.post:
            if not t.isdigit():
                for n in range(3, min(len(t), 21)):
                    self.ngrams[t[:n]].add(t)

    def df(self, t):
        return len(self.post.get(t, ()))

    def paired(self, a, b):
        return a != b and bool(self.post.get(a, {}).keys() & self.post.get(b, {}).keys())

    def ok(self, d):
        return all(any((k, v) in self.facets[d] for v in vs) for k, vs in self.filters.items())

    def hits(self, keys, geo=False, limit=0):
        cap = limit if limit > 0 else max(self.wanted, 100)
        keys = list(dict.fromkeys(keys))
        if keys:
            ds = set.intersection(*[set(self.post.get(k, ())) for k in keys])
            ds = {d for d in ds if self.ok(d) and (not geo or d in self.near)}
            return sorted(ds, key=lambda d: (round(sum(self.post[k][d] for k in keys), 12), d), reverse=True)[:cap]
        if geo:
            ds = sorted((d for d in self.near if self.ok(d)), reverse=True)
            return ds[:cap] if self.filters else ds
        return sorted((d for d in self.docs if self.ok(d)), reverse=True)[:cap] if self.filters else []

    def add(self, keys, geo=False, limit=None):
        self.matched |= set(keys)
        self.bucket |= set(self.hits(keys, geo, limit or 100 - len(self.bucket)))

    def new(self, keys, geo=False, limit=0):
        self.matched = set(keys)
        self.bucket = set(self.hits(keys, geo, limit))

    full = property(lambda s: s.wanted <= len(s.bucket) < 100)
    over = property(lambda s: len(s.bucket) >= 100)
    dry = property(lambda s: len(s.bucket) < s.wanted)

    def cream(self):
        if not self.bucket or len(self.bucket) > 10:
            return 0
        self.convert()
        return sum(r["str"] >= 0.9 for r in self.results.values())

    def convert(self):
        for d in self.bucket - self.results.keys():
            if r := self.result(self.docs[d]):
                self.results[d] = r

    def result(self, d):
        number = None
        lat, lon = d["lat"], d["lon"]
        if self.check and self.hn and self.hn in d["housenumbers"]:
            h = d["housenumbers"][self.hn]
            number, lat, lon = h["raw"], h["lat"], h["lon"]
            d = d | {k: [h[k]] for k in ("city", "postcode") if k in h}
        if self.check and self.only and not number:
            return None
        name, city, code = d["name"][0], (d["city"] or [""])[0], (d["postcode"] or [""])[0]
        label = name
        if city and city != name:
            label += (f" {code}" if code else "") + f" {city}"
        if number:
            label = f"{number} {label}"
        labels = [fold(x) for x in [label, *d["name"][1:]]]
        grams = 0.0
        scale = 0.9 if self.ac else 1.0
        for x in labels:
            s = sim(x, self.q) * scale
            grams = max(grams, s)
            if s >= 0.9:
                break
        text = grams
        if self.ac:
            best = max(1.0 if self.q == x else 0.9 if x.startswith(self.q) else 0.7 if self.q in x else 0.0 for x in labels)
            text = best or grams
        imp, top, extra = d["importance"] * 0.1, 1.1, 0.0
        if self.center:
            k = km(lat, lon, *self.center)
            extra, top = (0.0 if k > 100 else math.exp(-((k / 50) ** 2))) * 0.1, 1.2
            text, imp = text * 0.9, imp * 0.1
        return {"str": text, "score": (imp + text + extra) / top, "label": label}

    def complete(self, tokens, geo=False, skip=False):
        keys = [t for t in tokens if t != self.last]
        cand = {c for c in self.ngrams.get(self.last, ()) if all(self.paired(k, c) for k in keys)}
        key = (lambda t: (-max(self.post[t].values()), t)) if len(tokens) == 1 else (lambda t: (-self.df(t), t))
        for t in sorted(cand, key=key):
            if skip and self.df(t) > self.c.common_threshold:
                continue
            if not self.over or self.last in self.nof:
                self.add([*keys, t], geo)

    def fuzz(self, tokens, commons=True):
        from wayfind.config import FUZZY_KEY_MAP

        if not self.dry or not tokens:
            return
        tokens.sort(key=len, reverse=True)
        every = self.keys + ([t for t in self.common if t not in self.keys] if commons else [])
        for t in tokens:
            if self.full:
                break
            keys = [k for k in every if k != t]
            if t.isdigit():
                continue
            az = "abcdefghijklmnopqrstuvwxyz"
            near = [t[:i] + t[i + 1] + t[i] + t[i + 2 :] for i in range(len(t) - 1)]
            near += [t[:i] + c + t[i + 1 :] for i in range(len(t)) for c in FUZZY_KEY_MAP.get(t[i], "") if c != t[i]]
            near += [t[:i] + c + t[i:] for c in az for i in range(len(t) + 1)]
            near += [t[:i] + t[i + 1 :] for i in range(len(t))] if len(t) > 3 else []
            words = [n for n in dict.fromkeys(near) if n in self.post and all(self.paired(k, n) for k in keys)]
            if self.filters and self.keys_set:
                words = []
            for n in words:
                if self.dry:
                    self.add([*keys, n])

    def __call__(self, q, lat=None, lon=None, limit=10, autocomplete=False, fuzzy=True, filters=None):
        self.wanted, self.ac, self.filters = limit, autocomplete, {k: v for k, v in (filters or {}).items() if v}
        types = self.filters.get("type")
        self.check, self.only = (True, False) if not types else ("housenumber" in types, set(types) == {"housenumber"})
        self.center = (lat, lon) if lat is not None and lon is not None else None
        self.near = set()
        if self.center:
            x, y = cell(lat, lon)
            self.near = set().union(*[self.cells.get((x + i, y + j), set()) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        geo = bool(self.near)
        self.q = fold(q)
        words = toks(self.q)
        self.hn = words[0] if words and words[0].isdigit() else ""
        self.last = words[-1] if words else ""
        tokens = sorted(words[1:] if self.hn else words, key=len, reverse=True)
        self.common = sorted((t for t in tokens if self.df(t) > self.c.common_threshold), key=self.df)
        mean = sorted((t for t in tokens if 0 < self.df(t) <= self.c.common_threshold), key=self.df)
        self.nof = [t for t in tokens if not self.df(t)]
        self.common, self.mean = self.common + mean[10:], mean[:10]
        least = math.ceil(2 / 3 * len(tokens))
        self.bucket, self.matched, self.results, self.keys, self.keys_set = set(), set(), {}, [], False
        self.collect(tokens, geo, least, fuzzy)
        self.convert()
        ranked = sorted(self.results, key=lambda d: (-round(self.results[d]["score"], 12), d))[:limit]
        return [(d, self.results[d]["score"], self.results[d]["label"]) for d in ranked if self.results[d]["score"] >= 0.1]

    def collect(self, tokens, geo, least, fuzzy):
        commons = bool(tokens) and len(tokens) == len(self.common)
        if geo and commons:
            self.complete(tokens, geo=True)
        if not tokens and self.hn and geo:
            self.new([], True, 10)
        if not tokens:
            return
        if commons:
            tried = len(tokens) == 1 or geo
            if tried:
                self.add(tokens, geo)
            if self.dry and len(tokens) + geo + (tried and bool(self.filters)) > 1:
                tokens.sort(key=self.df)
                rarest = self.df(tokens[0])
                some = sum(self.ok(d) for d in self.docs) if self.filters else None
                if rarest < self.c.intersect_limit or (self.filters and some < rarest):
                    self.add(tokens)
                else:
                    found = []
                    for d in sorted(self.post[tokens[0]], key=lambda d: (self.post[tokens[0]][d], d), reverse=True)[:501]:
                        if all(d in self.post[t] for t in tokens) and self.ok(d) and len(found) < self.wanted:
                            found.append(d)
                    self.bucket |= set(found)
        if not self.mean and self.common:
            self.complete(self.common)
            self.mean = self.common[:1]
            if len(self.matched) >= least and (self.full or self.over or self.cream()):
                return
        if commons:
            self.complete(tokens, skip=True)
            if self.bucket:
                return
        if self.mean:
            if len(self.mean) == 1 and self.common and not self.filters:
                self.mean += [t for t in self.common if t not in self.mean][:1]
            self.keys, self.keys_set = list(self.mean), True
            if not self.bucket:
                self.new(self.keys, limit=10)
                if len(self.bucket) == 10:
                    self.new(self.keys)
                if not self.ac and 0 < self.cream() < 10:
                    return
            else:
                self.add(self.keys)
        if not commons:
            for t in self.common:
                if t not in self.mean and self.over:
                    self.mean.append(t)
                    self.keys = list(self.mean)
                    self.new(self.keys)
        if self.over and geo:
            self.add(self.keys, True, max(self.wanted, 10))
        if self.ac and not self.over:
            if geo:
                self.complete(self.mean, geo=True)
            self.complete(self.mean)
        if fuzzy and not self.cream():
            self.fuzz(self.nof)
            if self.dry and not self.cream():
                self.fuzz(self.mean)
            if self.dry and not self.cream() and self.common:
                self.fuzz(self.mean, False)
        if self.dry:
            every = {t: self.df(t) for t in [*self.mean, *self.common]}
            ties = {(a, b) for a in every for b in every if self.paired(a, b)}
            for g in interlinked(every, ties, self.c.common_threshold):
                self.add(g)
                if self.over:
                    break
        if self.full or self.cream() or not self.dry:
            return
        if not self.bucket or len(self.mean) - 1 > least:
            self.mean.sort(key=lambda t: (2 if t.isdigit() else 1, self.df(t)), reverse=True)
            for t in self.mean:
                self.add([k for k in self.keys if k != t])
                if self.over:
                    break
            if not self.bucket and len(self.mean) > 3:
                for t in self.mean:
                    for u in self.mean:
                        if t != u:
                            self.add([k for k in self.keys if k not in (t, u)])
