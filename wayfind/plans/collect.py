"""The collectors of search as stages over a table of query states.

A collector makes an ordered list of attempts (sets of keys) from each state. All attempts of all queries are answered by
one shuffled intersection; a fold over each query's answers in order then does what trying them one by one would: limits
shrink as the bucket fills, and once a stop condition holds the rest change nothing. Between stages the states are
written, which cuts the plan; queries that a stage doesn't concern cost it nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.config import EngineConfig
from wayfind.functions.text import analyze, fold, fuzzy_neighbors, is_digits
from wayfind.operators import retrieve
from wayfind.operators.index import Index
from wayfind.operators.score import score_candidates

ATTEMPTS = "array<struct<toks:array<string>,geo:boolean>>"
TOKEN = "struct<tok:string,last:boolean,df:bigint>"
STRINGS = "array<string>"
#: So many (query, document) pairs are broadcast to find their documents; some 200 bytes each.
FEW_PAIRS = 20_000


def names(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: t["tok"])


def attempt(toks: Column, geo: Column | bool = False) -> Column:
    return F.struct(toks.alias("toks"), (F.lit(geo) if isinstance(geo, bool) else geo).alias("geo"))


def one_if(condition: Column, *items: Column) -> Column:
    return F.when(condition, F.array(*items)).otherwise(F.array().cast(ATTEMPTS))


class Chain:
    """keep: writes a DataFrame and reads it back. drop: deletes what keep wrote under a name."""

    def __init__(self, index: Index, config: EngineConfig, keep, drop=None):
        self.index, self.config, self.keep, self.step, self.drop = index, config, keep, 0, drop
        self.close: DataFrame | None = None
        self.held: DataFrame | None = None
        self.most = config.bucket_max
        self.used: list[str] = []

    def kept(self, df: DataFrame) -> DataFrame:
        """df, written as the next state. What led to it is used up."""
        out, last = self.aside(df), self.used.pop()
        while self.drop is not None and self.used:
            self.drop(self.used.pop())
        self.used = [last]
        return out

    def aside(self, df: DataFrame, stays: bool = False) -> DataFrame:
        """df, written on the way to the next state, until that is written. stays: or for all states."""
        self.step += 1
        self.used += [] if stays else [f"s{self.step}"]
        return self.keep(df, f"s{self.step}")

    # states

    def prepare(self, queries: DataFrame) -> DataFrame:
        """One state per query: its tokens sorted by length and sorted out into meaningful, common and not found."""
        c = self.config
        types = F.col("filters")["type"]
        check, only = retrieve.housenumber_checks(F.when(F.size(types) > 0, types))
        q = queries.select(
            "query_id", fold(F.trim(F.coalesce("q", F.lit("")))).alias("q"), "lat", "lon", F.coalesce("limit", F.lit(10)).alias("wanted"), F.coalesce("autocomplete", F.lit(False)).alias("autocomplete"),
            F.coalesce("fuzzy", F.lit(True)).alias("fuzzy"), retrieve.filter_groups(F.col("filters"), c).alias("fl"), check.alias("check_hn"), only.alias("only_hn"),
        )
        toks = analyze(F.col("q"), c)
        q = self.kept(q.withColumn("_t", toks))
        asked = q.agg(F.max("wanted").alias("wanted"), F.count(F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), 1)).alias("centers")).first()
        self.most = max(c.bucket_max, asked.wanted or 0)
        # without a center no cell is looked at
        near = self.aside(retrieve.near(self.index, q, c) if asked.centers else q.select("query_id", F.lit("").alias("doc_id")).limit(0), stays=True)
        self.close = near
        flat = q.select("query_id", F.size("_t").alias("_n"), F.posexplode("_t").alias("i", "t")).select("query_id", "_n", "i", F.col("t.tok").alias("token"), "t.kind")
        known = flat.join(self.index.token_stats.select("token", "df"), "token", "left")
        entry = F.struct((-F.length("token")).alias("size"), "i", F.col("token").alias("tok"), (F.col("i") == F.col("_n") - 1).alias("last"), "df", "kind")
        lists = known.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("_s"))
        has = near.select("query_id").distinct().withColumn("geo", F.lit(True))
        # the neighbourhood counts as soon as any document is in it, filters aside
        if not q.where("size(fl) > 0 and lat is not null").isEmpty():
            has = retrieve.near(self.index, q, c, filtered=False).select("query_id").distinct().withColumn("geo", F.lit(True))
        s = q.drop("_t").join(lists, "query_id", "left").join(has, "query_id", "left").withColumn("geo", F.coalesce("geo", F.lit(False)))
        s = s.withColumn("_s", F.coalesce("_s", F.array().cast("array<struct<size:int,i:int,tok:string,last:boolean,df:bigint,kind:string>>")))
        number = lambda t: t["kind"].isNotNull() & (t["kind"] == "housenumber")
        own = F.filter("_s", lambda t: ~number(t))
        plain = lambda xs: F.transform(xs, lambda t: F.struct(t["tok"].alias("tok"), t["last"].alias("last"), t["df"].alias("df")))
        by_df = lambda xs: plain(F.array_sort(F.transform(F.filter(own, xs), lambda t, i: F.struct(t["df"].alias("df"), i.alias("i"), t["tok"].alias("tok"), t["last"].alias("last")))))
        mean = by_df(lambda t: t["df"] <= c.common_threshold)
        s = s.withColumns({"toks": plain(own), "_mean": mean, "_com": by_df(lambda t: t["df"] > c.common_threshold), "nof": plain(F.filter(own, lambda t: t["df"].isNull()))})
        hn = F.array_join(F.transform(F.array_sort(F.transform(F.filter("_s", number), lambda t: F.struct(t["i"].alias("i"), t["tok"].alias("tok")))), lambda t: t["tok"]), "")
        last = F.element_at(F.filter("_s", lambda t: t["last"]), 1)["tok"]
        last = F.when(F.size("_s") > 0, last)
        s = s.withColumns(
            {
                "hn": hn, "last": F.coalesce(last, F.lit("")), "meaningful": F.slice("_mean", 1, c.max_meaningful), "common": F.concat("_com", F.slice("_mean", c.max_meaningful + 1, 10_000)),
                "least_match": F.ceil(F.size("toks") * F.lit(2 / 3)), "keys": F.array().cast(STRINGS), "matched": F.array().cast(STRINGS), "bucket": F.array().cast(STRINGS),
                "seen": F.array().cast(STRINGS), "done": F.lit(False), "aliased": F.lit(False),
            }
        )
        return self.kept(s.drop("_s", "_mean", "_com"))

    @property
    def only_commons(self) -> Column:
        return ~F.col("done") & (F.size("toks") > 0) & (F.size("toks") == F.size("common"))

    def dry(self, bucket: Column | None = None) -> Column:
        return F.size(F.col("bucket") if bucket is None else bucket) < F.col("wanted")

    def overflow(self, bucket: Column | None = None) -> Column:
        return F.size(F.col("bucket") if bucket is None else bucket) >= self.config.bucket_max

    def full(self) -> Column:
        return ~self.dry() & ~self.overflow()

    # attempts

    def answers(self, s: DataFrame) -> DataFrame:
        """query_id and _r, the answered attempts in order: toks, ids by rank.

        Attempts with the same tokens, filters and cap are answered once for all queries, but for those near a center,
        which are a query's own. Towns and common words repeat in a batch, and their postings are the long ones.
        """
        cap = F.greatest(F.col("wanted"), F.lit(self.config.bucket_max))
        a = s.select("query_id", "fl", cap.alias("cap"), F.posexplode("_a").alias("no", "a")).select("query_id", "fl", "cap", "no", "a.toks", "a.geo")
        same = F.to_json(F.struct(F.sort_array(F.array_distinct("toks")).alias("toks"), "fl", "cap", F.when(F.col("geo"), F.col("query_id")).alias("near")))
        a = a.withColumn("_same", same)
        first = F.min_by(F.struct("query_id", "no", "toks", "geo", "fl", "cap"), F.struct("query_id", "no"))
        each = self.aside(a.groupBy("_same").agg(first.alias("x")).select("_same", "x.*"))
        tries = each.drop("_same")
        some = tries.agg(F.count(F.when(F.size("toks") == 0, 1)).alias("bare"), F.count(F.when(F.size("toks") > 0, 1)).alias("worded"), F.count(F.when(F.col("geo"), 1)).alias("near")).first()
        if self.held is None:
            self.held = self.aside(retrieve.held(self.index.postings), stays=True)
        parts = [retrieve.intersect(self.index, tries.where("size(toks) > 0"), self.close if some.near else None, self.most, self.held, self.aside)] if some.worded else []
        parts += [retrieve.without_tokens(self.index, tries.where("size(toks) = 0"), self.close)] if some.bare else []
        hits = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        ids = hits.groupBy("query_id", "no").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("ids"))
        found = each.select("_same", "query_id", "no").join(ids, ["query_id", "no"]).select("_same", "ids")
        rows = a.select("query_id", "no", "toks", "_same").join(found, "_same", "left")
        entry = F.struct("no", "toks", F.coalesce("ids", F.array().cast(STRINGS)).alias("ids"))
        return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("_r"))

    def extend(self, s: DataFrame, attempts: Column, go=None, limit: Column | None = None, replace: bool = False) -> DataFrame:
        """Try attempts in order. go(bucket, no): whether the next is tried. replace: each takes the bucket's place instead of adding to it."""
        cap = F.greatest(F.col("wanted"), F.lit(self.config.bucket_max))
        s = s.withColumn("_a", F.when(F.col("done"), F.array().cast(ATTEMPTS)).otherwise(attempts))
        if s.where("size(_a) > 0").isEmpty():
            return s.drop("_a").withColumn("_tried", F.lit(0)) if replace else s.drop("_a")
        s = s.join(self.answers(s.where("size(_a) > 0")), "query_id", "left")
        start = F.struct(F.col("bucket").alias("bucket"), F.col("matched").alias("matched"), F.lit(0).alias("tried"))

        def step(acc: Column, x: Column) -> Column:
            room = F.lit(self.config.bucket_max) - F.size(acc["bucket"]) if limit is None else limit
            room = F.when(room > 0, room).otherwise(cap)
            room = cap if replace and limit is None else room
            if replace:
                new = F.struct(F.slice(x["ids"], F.lit(1), room).alias("bucket"), F.array_distinct(x["toks"]).alias("matched"), (acc["tried"] + 1).alias("tried"))
            else:
                # a neighbourhood alone has no limit
                new_ids = F.when(F.size(x["toks"]) == 0, x["ids"]).otherwise(F.slice(x["ids"], F.lit(1), room))
                new = F.struct(F.array_union(acc["bucket"], new_ids).alias("bucket"), F.array_union(acc["matched"], x["toks"]).alias("matched"), (acc["tried"] + 1).alias("tried"))
            return new if go is None else F.when(go(acc["bucket"], acc["tried"]), new).otherwise(acc)

        s = s.withColumn("_acc", F.when(F.col("_r").isNull(), start).otherwise(F.aggregate("_r", start, step)))
        s = s.withColumns({"bucket": F.col("_acc.bucket"), "matched": F.col("_acc.matched"), "_tried": F.col("_acc.tried")})
        return self.kept(s.drop("_acc", "_a", "_r", *([] if replace else ["_tried"])))

    def cream(self, s: DataFrame, when: Column) -> DataFrame:
        """_cream: matches among what has been scored so far, where the bucket is small enough to look; 0 elsewhere."""
        look = when & ~F.col("done") & (F.size("bucket") > 0) & (F.size("bucket") <= self.config.bucket_min)
        s = s.withColumn("seen", F.when(look, F.array_union("seen", "bucket")).otherwise(F.col("seen")))
        if s.where(look).isEmpty():
            return s.withColumn("_cream", F.lit(0).cast("long"))
        pairs = s.where(look).select("query_id", F.explode("seen").alias("doc_id"))
        scored = self.scored(pairs, s)
        count = scored.where(F.col("str_distance") >= self.config.match_threshold).groupBy("query_id").agg(F.count("*").alias("_cream"))
        return self.kept(s.join(count, "query_id", "left").withColumn("_cream", F.coalesce("_cream", F.lit(0).cast("long"))))

    def scored(self, pairs: DataFrame, s: DataFrame) -> DataFrame:
        """pairs (query_id, doc_id) scored. Written documents are small and large once read, so the size of their files must not have them broadcast: a few pairs are, many meet them in a shuffle."""
        pairs = self.aside(pairs)
        few = pairs.count() <= FEW_PAIRS
        return score_candidates(pairs, s, self.index.documents, self.config, "broadcast" if few else "merge")

    def autocompleted(self, s: DataFrame, when: Column, tokens: str, geo: bool = False, skip_commons: bool = False) -> DataFrame:
        """Attempts with the last token completed: completions must share a document with each other token."""
        if s.where(when).isEmpty():
            return s
        others = F.transform(F.filter(tokens, lambda t: ~t["last"]), lambda t: t["tok"])
        want = s.where(when).select("query_id", F.col("last").alias("prefix"), others.alias("with"), F.size(tokens).alias("n"))
        cand = want.join(self.index.edge_ngrams, "prefix").select("query_id", F.col("token").alias("cand"), "with", "n")
        cand = retrieve.paired_with_all(self.index, cand, "cand", ("query_id",)).join(self.index.token_stats.withColumnRenamed("token", "cand"), "cand")
        if skip_commons:
            cand = cand.where(F.col("df") <= self.config.common_threshold)
        order = F.struct(F.when(F.col("n") == 1, -F.col("max_boost")).otherwise(-F.col("df").cast("double")).alias("by"), "cand")
        lists = cand.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["cand"]).alias("_c"))
        s = self.kept(s.join(lists, "query_id", "left"))
        made = F.transform(F.coalesce("_c", F.array().cast(STRINGS)), lambda x: attempt(F.concat(others, F.array(x)), F.col("geo") if geo else False))
        unknown = F.array_contains(names(F.col("nof")), F.col("last"))
        return self.extend(s, made, lambda b, i: ~self.overflow(b) | unknown).drop("_c")

    # collectors, by the names in EngineConfig.collectors

    def commons_near_center_autocomplete(self, s: DataFrame) -> DataFrame:
        return self.autocompleted(s, self.only_commons & F.col("geo"), "toks", geo=True)

    def housenumbers_near_center(self, s: DataFrame) -> DataFrame:
        here = (F.size("toks") == 0) & (F.col("hn") != "") & F.col("geo")
        return self.extend(s, one_if(here, attempt(F.array().cast(STRINGS), True)), limit=F.when(F.size("fl") > 0, self.config.bucket_min).otherwise(2**31 - 1), replace=True).drop("_tried")

    def stop_without_tokens(self, s: DataFrame) -> DataFrame:
        return s.withColumn("done", F.col("done") | (F.size("toks") == 0))

    def _only_commons(self, s: DataFrame) -> DataFrame:
        c = self.config
        n = F.size("toks")
        s = self.extend(s, one_if(self.only_commons & ((n == 1) | F.col("geo")), attempt(names(F.col("toks")), F.col("geo"))))
        tried = (n == 1) | F.col("geo")
        many = n + F.col("geo").cast("int") + F.when(tried & (F.size("fl") > 0), 1).otherwise(0) > 1
        scan = self.only_commons & self.dry() & many
        by_df = F.transform(F.array_sort(F.transform("toks", lambda t, i: F.struct(t["df"].alias("df"), i.alias("i"), t["tok"].alias("tok"), t["last"].alias("last")))), lambda t: F.struct(t["tok"].alias("tok"), t["last"].alias("last"), t["df"].alias("df")))
        s = s.withColumn("toks", F.when(scan, by_df).otherwise(F.col("toks"))).withColumn("_scan", scan)
        rarest = F.get("toks", F.lit(0))["df"]
        small = rarest < c.intersect_limit
        large = s.where(F.col("_scan") & ~small & (F.size("fl") > 0))
        if large.isEmpty():
            s = s.withColumn("_fsize", F.lit(None).cast("long"))
        else:
            sizes = retrieve.documents_with(self.index, large).groupBy("query_id").agg(F.count("*").alias("_fsize"))
            s = s.join(sizes, "query_id", "left")
        narrow = small | ((F.size("fl") > 0) & (F.coalesce("_fsize", F.lit(0).cast("long")) < rarest))
        s = s.withColumn("_narrow", F.coalesce(narrow, F.lit(False)))
        s = self.extend(s, one_if(F.col("_scan") & F.col("_narrow"), attempt(names(F.col("toks")))))
        left = s.where("_scan and not _narrow and not done")
        if not left.isEmpty():
            found = retrieve.manual_scan(self.index, left.select("query_id", "fl", "wanted", names(F.col("toks")).alias("toks")), c.scan_rows)
            ids = found.groupBy("query_id").agg(F.sort_array(F.collect_list("doc_id"), False).alias("_ids"))
            s = self.kept(s.join(ids, "query_id", "left").withColumn("bucket", F.array_union("bucket", F.coalesce("_ids", F.array().cast(STRINGS)))).drop("_ids"))
        return s.drop("_scan", "_narrow", "_fsize")

    def commons_autocomplete_then_judge(self, s: DataFrame) -> DataFrame:
        here = ~F.col("done") & (F.size("meaningful") == 0) & (F.size("common") > 0)
        s = s.withColumn("_here", here)
        s = self.autocompleted(s, F.col("_here"), "common")
        s = s.withColumn("meaningful", F.when(F.col("_here"), F.slice("common", 1, 1)).otherwise(F.col("meaningful")))
        enough = F.col("_here") & (F.size("matched") >= F.col("least_match"))
        s = self.cream(s, enough & ~self.full() & ~self.overflow())
        return s.withColumn("done", F.col("done") | (enough & (self.full() | self.overflow() | (F.col("_cream") > 0)))).drop("_here", "_cream")

    def commons_autocomplete(self, s: DataFrame) -> DataFrame:
        s = s.withColumn("_here", self.only_commons)
        s = self.autocompleted(s, F.col("_here"), "toks", skip_commons=True)
        return s.withColumn("done", F.col("done") | (F.col("_here") & (F.size("bucket") > 0))).drop("_here")

    def meaningful(self, s: DataFrame) -> DataFrame:
        c = self.config
        some = ~F.col("done") & (F.size("meaningful") > 0)
        lone = some & (F.size("meaningful") == 1) & (F.size("fl") == 0)
        other = F.filter("common", lambda t: ~F.array_contains(names(F.col("meaningful")), t["tok"]))
        s = s.withColumn("meaningful", F.when(lone, F.concat("meaningful", F.slice(other, 1, 1))).otherwise(F.col("meaningful")))
        s = s.withColumns({"keys": F.when(some, names(F.col("meaningful"))).otherwise(F.col("keys")), "aliased": F.col("aliased") | (some & (F.size("fl") > 0)), "_new": some & (F.size("bucket") == 0)})
        s = self.extend(s, one_if(some & F.col("_new"), attempt(F.col("keys"))), replace=True).drop("_tried")
        # with fewer than the least bucket the search isn't run again without that limit
        s = self.extend(s, one_if(some & ~F.col("_new"), attempt(F.col("keys"))))
        s = self.cream(s, F.col("_new") & ~F.col("autocomplete"))
        return s.withColumn("done", F.col("done") | (F.col("_new") & (F.col("_cream") > 0) & (F.col("_cream") < c.bucket_min))).drop("_new", "_cream")

    def reduce_with_commons(self, s: DataFrame) -> DataFrame:
        here = ~F.col("done") & ~self.only_commons & self.overflow()
        more = F.filter("common", lambda t: ~F.array_contains(names(F.col("meaningful")), t["tok"]))
        s = s.withColumn("_more", F.when(here, more).otherwise(F.array().cast(f"array<{TOKEN}>")))
        tries = F.transform("_more", lambda _, i: attempt(names(F.concat("meaningful", F.slice("_more", F.lit(1), i + 1)))))
        s = self.extend(s, tries, lambda b, i: self.overflow(b), replace=True)
        s = s.withColumn("meaningful", F.when(F.col("_tried") > 0, F.concat("meaningful", F.slice("_more", F.lit(1), F.col("_tried")))).otherwise(F.col("meaningful")))
        s = s.withColumns({"keys": F.when(F.col("_tried") > 0, names(F.col("meaningful"))).otherwise(F.col("keys"))})
        return s.drop("_more", "_tried")

    def near_center(self, s: DataFrame) -> DataFrame:
        return self.extend(s, one_if(self.overflow() & F.col("geo"), attempt(F.col("keys"), True)), limit=F.greatest(F.col("wanted"), F.lit(10)))

    def autocomplete(self, s: DataFrame) -> DataFrame:
        s = s.withColumn("_here", ~F.col("done") & F.col("autocomplete") & ~self.overflow())
        s = self.autocompleted(s, F.col("_here") & F.col("geo"), "meaningful", geo=True)
        return self.autocompleted(s, F.col("_here"), "meaningful").drop("_here")

    def fuzzy(self, s: DataFrame) -> DataFrame:
        s = self.cream(s, F.col("fuzzy"))
        s = s.withColumn("_here", ~F.col("done") & F.col("fuzzy") & (F.col("_cream") == 0)).drop("_cream")
        s = self._try_fuzzy(s, F.col("_here"), "nof", True)
        for commons in (True, False):
            s = self.cream(s, F.col("_here") & self.dry())
            go = F.col("_here") & self.dry() & (F.col("_cream") == 0)
            s = s.withColumn("_go", go if commons else go & (F.size("common") > 0)).drop("_cream")
            s = self._try_fuzzy(s, F.col("_go"), "meaningful", commons).drop("_go")
        return s.drop("_here")

    def _try_fuzzy(self, s: DataFrame, when: Column, tokens: str, include_common: bool) -> DataFrame:
        c = self.config
        here = when & self.dry() & (F.size(tokens) > 0)
        by_length = F.transform(F.array_sort(F.transform(tokens, lambda t, i: F.struct((-F.length(t["tok"])).alias("n"), i.alias("i"), t.alias("t")))), lambda x: x["t"])
        s = s.withColumn(tokens, F.when(here, by_length).otherwise(F.col(tokens))).withColumn("_fz", here)
        if s.where("_fz").isEmpty():
            return s.drop("_fz")
        every = F.concat("keys", F.filter(names(F.col("common")), lambda t: ~F.array_contains("keys", t))) if include_common else F.col("keys")
        rows = s.where("_fz").select("query_id", "aliased", every.alias("all"), F.posexplode(tokens).alias("i", "t")).where(~is_digits(F.col("t.tok")))
        rows = rows.select("query_id", "aliased", "i", F.array_remove("all", F.col("t.tok")).alias("with"), F.posexplode(fuzzy_neighbors(F.col("t.tok"), c)).alias("j", "cand"))
        # among the keys of a filtered query is its filter, which no word is paired with
        rows = rows.where(~F.col("aliased")).drop("aliased").join(self.index.token_stats.select(F.col("token").alias("cand")), "cand", "left_semi").select("query_id", "i", "with", "j", "cand")
        rows = retrieve.paired_with_all(self.index, rows, "cand", ("query_id", "i"))
        tries = rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", F.concat("with", F.array("cand")).alias("toks")))), lambda x: attempt(x["toks"])).alias("_f"))
        s = self.kept(s.join(tries, "query_id", "left"))
        return self.extend(s, F.coalesce("_f", F.array().cast(ATTEMPTS)), lambda b, i: self.dry(b)).drop("_f", "_fz")

    def relations(self, s: DataFrame) -> DataFrame:
        here = ~F.col("done") & self.dry() & (F.size(F.array_union(names(F.col("meaningful")), names(F.col("common")))) > 1)
        s = s.withColumn("_here", here)
        if s.where("_here").isEmpty():
            return s.drop("_here")
        every = s.where("_here").select("query_id", F.array_distinct(F.concat("meaningful", "common")).alias("_e"))
        words = every.select("query_id", "_e", F.explode("_e").alias("a"))
        both = words.select("query_id", F.col("a.tok").alias("token"), F.explode("_e").alias("b")).select("query_id", "token", F.col("b.tok").alias("other")).distinct()
        tied = both.join(self.index.pairs, ["token", "other"], "left_semi").groupBy("query_id").agg(F.collect_list(F.struct("token", "other")).alias("ties"))
        rows = every.join(tied, "query_id").select("query_id", names(F.col("_e")).alias("toks"), F.transform("_e", lambda t: t["df"]).alias("dfs"), F.transform("ties", lambda t: F.concat(t["token"], F.lit(" "), t["other"])).alias("ties"))
        common = self.config.common_threshold

        @F.pandas_udf("array<array<string>>")
        def groups(toks: pd.Series, dfs: pd.Series, ties: pd.Series) -> pd.Series:
            return pd.Series([interlinked(dict(zip(t, d)), {tuple(x.split(" ")) for x in e}, common) for t, d, e in zip(toks, dfs, ties)])

        s = self.kept(s.join(rows.select("query_id", groups("toks", "dfs", "ties").alias("_g")), "query_id", "left"))
        tries = F.transform(F.coalesce("_g", F.array().cast("array<array<string>>")), lambda g: attempt(g))
        return self.extend(s, tries, lambda b, i: (i == 0) | ~self.overflow(b)).drop("_g", "_here")

    def fewer_tokens(self, s: DataFrame) -> DataFrame:
        s = self.cream(s, ~self.full())
        s = s.withColumn("done", F.col("done") | self.full() | (F.col("_cream") > 0)).drop("_cream")
        here = ~F.col("done") & self.dry() & ((F.size("bucket") == 0) | (F.size("meaningful") - 1 > F.col("least_match")))
        order = lambda t, i: F.struct(F.when(is_digits(t["tok"]), F.lit(-2)).otherwise(F.lit(-1)).alias("kind"), (-t["df"]).alias("df"), i.alias("i"), t.alias("t"))
        ranked = F.transform(F.array_sort(F.transform("meaningful", order)), lambda x: x["t"])
        s = s.withColumn("_here", here).withColumn("meaningful", F.when(here, ranked).otherwise(F.col("meaningful")))
        usable = lambda xs: F.filter(xs, lambda a: (F.size(a["toks"]) > 0) | (F.size("fl") > 0))
        none = F.array().cast(ATTEMPTS)
        fewer = F.transform("meaningful", lambda t: attempt(F.array_remove("keys", t["tok"])))
        s = self.extend(s, F.when(F.col("_here"), usable(fewer)).otherwise(none), lambda b, i: (i == 0) | ~self.overflow(b))
        two = F.flatten(F.transform("meaningful", lambda t: F.transform(F.filter("meaningful", lambda u: u["tok"] != t["tok"]), lambda u: attempt(F.array_remove(F.array_remove("keys", t["tok"]), u["tok"])))))
        again = F.col("_here") & (F.size("bucket") == 0) & (F.size("meaningful") > 3)
        return self.extend(s, F.when(again, usable(two)).otherwise(none), lambda b, i: (i == 0) | ~self.overflow(b)).drop("_here")

    def run(self, queries: DataFrame) -> DataFrame:
        """States after all collectors."""
        s = self.prepare(queries)
        for name in self.config.collectors:
            s = getattr(self, "_only_commons" if name == "only_commons" else name)(s)
        return self.kept(s)


def interlinked(dfs: dict[str, int], ties: set[tuple[str, str]], common: int) -> list[list[str]]:
    """Largest groups of tokens that all share documents pairwise, common tokens taken out, by mean frequency; groups within others are dropped."""
    order = sorted(dfs, key=lambda t: (dfs[t], t))
    found = []
    for origin in order:
        group = [origin]
        for t in order:
            if t != origin and all((t, g) in ties or (g, t) in ties for g in group):
                group.append(t)
        kept = frozenset(t for t in group if dfs[t] <= common)
        if len(kept) > 1:
            found.append(kept)
    unique: list[frozenset] = []
    for g in sorted(found, key=len, reverse=True):
        if not any(g <= u for u in unique):
            unique.append(g)
    return [sorted(g, key=lambda t: (dfs[t], t)) for g in sorted(unique, key=lambda g: (sum(dfs[t] for t in g) / len(g), sorted(g)))]
