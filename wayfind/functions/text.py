"""The analyzer and string similarities, each a Column of built-in expressions."""

from __future__ import annotations

import string
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfind.config import EngineConfig

TOKEN = r"[\p{L}\p{N}_]+"
#: Letters that have no decomposition into a letter and marks.
LETTERS = {
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ħ": "h", "ı": "i", "ŋ": "ng", "ŧ": "t", "ĸ": "k", "ſ": "s",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r",
    "ς": "s", "σ": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s",
    "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia", "є": "ie", "і": "i", "ђ": "dj",
    "ј": "j", "љ": "lj", "њ": "nj", "ћ": "ch", "џ": "dz",
}
TOK = "struct<tok:string,raw:string,pos:int,sub:int,kind:string>"


@lru_cache
def fold_map() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Lower-case letters beyond ASCII with one ASCII letter (two strings, letter by letter), and those with several."""
    one, many = {}, {}
    for code in [*range(0x80, 0x250), *range(0x1E00, 0x2000), *range(0x300, 0x460)]:
        c = chr(code)
        if c != c.lower() or unicodedata.category(c)[0] not in "LMN":
            continue
        plain = LETTERS[c] if c in LETTERS else "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        plain = "".join(LETTERS.get(x, x) for x in plain).lower()
        if plain.isascii() and len(plain) <= 1:
            one[c] = plain
        elif plain.isascii():
            many[c] = plain
    letters = [c for c in one if one[c]] + [c for c in one if not one[c]]  # translate drops what has no partner
    return "".join(letters), "".join(one[c] for c in letters), tuple(many.items())


def normalize(text: Column) -> Column:
    """Lower-cased, without accents, ligatures taken apart, Greek and Cyrillic in Latin letters; other scripts stay."""
    source, target, many = fold_map()
    plain = F.translate(F.lower(text), source, target)
    out = plain
    for c, letters in many:
        out = F.replace(out, F.lit(c), F.lit(letters))
    return F.when(plain.rlike(r"[^\x00-\x7F]"), out).otherwise(plain)


def tokens_of(text: Column) -> Column:
    """Words in order: array of strings."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def alphanumerize(text: Column) -> Column:
    """Anything but letters, digits and _ becomes a space; runs of spaces one; none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_]", " "), " {2,}", " "))


def fold(text: Column) -> Column:
    return alphanumerize(normalize(text))


def is_digits(token: Column) -> Column:
    return token.rlike(r"^\p{Nd}+$")


def flag_housenumber(token: Column, position: Column) -> Column:
    return F.when((position == 0) & is_digits(token), F.lit("housenumber"))


def synonym_of(token: Column, synonyms: dict[str, str]) -> Column:
    """Tokens that stand for one: array of strings."""
    if not synonyms:
        return F.array(token)
    table = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    return F.split(F.coalesce(F.element_at(table, token), token), r"\s+")


def analyze(text: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Tokens of a text: array of tok, raw, pos, sub (place within a synonym) and kind."""
    words = F.transform(tokens_of(text), lambda x, i: F.struct(x.alias("raw"), normalize(x).alias("tok"), i.alias("pos")))
    each = lambda w: F.transform(
        synonym_of(w["tok"], config.synonyms),
        lambda t, j: F.struct(t.alias("tok"), w["raw"].alias("raw"), w["pos"].alias("pos"), j.alias("sub"), flag_housenumber(w["tok"], w["pos"]).alias("kind")),
    )
    return F.flatten(F.transform(words, each))


def too_long(text: Column, config: EngineConfig = EngineConfig()) -> Column:
    """The message for a query over the limit, else null."""
    n = F.length(text)
    return F.when(n > config.query_max_length, F.concat(F.lit("Query too long, "), n.cast("string"), F.lit(f" chars, limit is {config.query_max_length}")))


def _grams(text: Column, n: int) -> Column:
    size = F.length(text) - (n - 1)
    return F.when(size < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(text, i, F.lit(n))))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """The set of n-grams of the text between two spaces."""
    return F.array_distinct(_grams(F.concat(F.lit(" "), text, F.lit(" ")), n))


def once(value: Column, f) -> Column:
    """f(value), value evaluated once, also inside of another lambda, where equal expressions are not shared."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def bigram_similarity(left: Column, right: Column) -> Column:
    """Jaccard similarity of the multisets of bigrams of two folded strings; of two single letters, equality."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))

    def ratio(g: Column) -> Column:
        a, b, both = g["a"], g["b"], g["both"]
        # where one side repeats no bigram, the common ones are a plain set
        plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
        common = F.when(plain, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda z, x: z + F.least(count(a, x), count(b, x))))
        return F.when(F.size(both) == 0, F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common))

    grams = F.struct(_grams(left, 2).alias("a"), _grams(right, 2).alias("b"))
    shared = once(once(grams, lambda g: F.struct(g["a"], g["b"], F.array_intersect(g["a"], g["b"]).alias("both"))), ratio)
    return F.when((F.length(left) == 1) & (F.length(right) == 1), (left == right).cast("double")).otherwise(shared)


def string_similarity(left: Column, right: Column) -> Column:
    """Of two folded strings: shares of common trigrams and a bounded edit distance. Null where one is empty."""
    a, b = char_ngrams(left), char_ngrams(right)
    common = F.size(F.array_intersect(a, b))
    la, lb = F.length(left), F.length(right)
    distance = (F.levenshtein(left, right) - F.abs(la - lb)) / F.greatest(la, lb)
    score = common / F.size(b) * F.lit(0.85) + common / F.size(a) * F.lit(0.05) + (F.lit(1) - distance) * F.lit(0.1)
    return F.when((la > 0) & (lb > 0), score)


def label_match(query: Column, label: Column) -> Column:
    """1 for equal folded strings, 0.9 if the label starts with the query, 0.7 if it has it, else 0."""
    return F.when(query == label, F.lit(1.0)).when(F.startswith(label, query), F.lit(0.9)).when(F.contains(label, query), F.lit(0.7)).otherwise(F.lit(0.0))


def edge_ngrams(token: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Prefixes of at least the least length, never the token itself."""
    last = F.least(F.length(token), F.lit(config.max_edge_ngrams + 1)) - 1
    none = F.array().cast("array<string>")
    return F.when(last < config.min_edge_ngrams, none).otherwise(F.transform(F.sequence(F.lit(config.min_edge_ngrams), last), lambda i: F.substring(token, F.lit(1), i)))


def fuzzy_neighbors(word: Column, config: EngineConfig = EngineConfig()) -> Column:
    """Strings one edit away, in order of preference: transpositions, substitutions by neighbouring keys, insertions, and, over 3 letters, deletions."""
    n = F.length(word)
    left = lambda i: F.substring(word, F.lit(1), i)
    right = lambda i: F.substring(word, i, F.length(word))
    places = lambda least, last: F.when(last < least, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(least), last))
    swap = F.transform(places(1, n - 1), lambda i: F.concat(left(i - 1), F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1)), right(i + 2)))
    letters = F.array(*[F.lit(c) for c in string.ascii_lowercase])
    if config.fuzzy_key_map is None:
        change = F.flatten(F.transform(letters, lambda c: F.transform(F.filter(places(1, n), lambda i: F.substring(word, i, F.lit(1)) != c), lambda i: F.concat(left(i - 1), c, right(i + 1)))))
    else:
        keys = F.create_map(*[F.lit(x) for pair in config.fuzzy_key_map.items() for x in pair])
        near = lambda i: F.filter(F.split(F.coalesce(F.element_at(keys, F.substring(word, i, F.lit(1))), F.lit("")), ""), lambda c: (c != "") & (c != F.substring(word, i, F.lit(1))))
        change = F.flatten(F.transform(places(1, n), lambda i: F.transform(near(i), lambda c: F.concat(left(i - 1), c, right(i + 1)))))
    insert = F.flatten(F.transform(letters, lambda c: F.transform(places(1, n + 1), lambda i: F.concat(left(i - 1), c, right(i)))))
    delete = F.when(n > 3, F.transform(places(1, n), lambda i: F.concat(left(i - 1), right(i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(swap, change, insert, delete))
