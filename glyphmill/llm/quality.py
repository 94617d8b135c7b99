"""Quality rules by distribution divergence, in DataFrame functions alone.

Each text gives two histograms: over character classes, and over the common words of its language (with one bin for
all other words). Common words come from the corpus: of all documents of a language that pass the base rules, the
COMMON words of letters alone, lower-cased, that most of these documents hold (ties: smallest). References are the summed
histograms of the same documents, less the document's own; a language of too few documents or words, or beyond the
LANGUAGES of most documents, has the common words and sums of all languages together. A document is
rejected if the Jensen-Shannon distance (base 2, 0 to 1) of either histogram to its language's reference is
over a limit; texts with fewer words than a guard aren't judged by that histogram, as their histograms
are mostly chance. Base rules on length and repeated three-word windows come first.

Words are runs of characters other than U+0020 and U+0009 to U+000D.

Results in odd cases: a null or empty text has no words, fails the base rules and has null distances; a
null language is a language of its own; where no other document passes the base rules there is no reference, distances are
null, and the base rules decide; repeated rows count each; new columns replace others of the same name; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.shared import forget, fresh, let, stored

# White space between words; characters that count as symbols.
WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Regular expressions whose matches are counted; every other character of words is in the class `other`.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "symbol": "[#*$%&|<>]", "mark": "[.,;:!?'\"()\\[\\]{}/_=+-]"}
CLASS_NAMES = [*CLASSES, "wide", "white", "other"]

MIN_WORDS, REPEATED = 50, 50
#: Words that a text must have before a histogram judges it, and the distance that rejects it.
CLASS_GUARD, CLASS_LIMIT = 50, 0.2
WORD_GUARD, WORD_LIMIT = 80, 0.28
#: Common words of a language. More of them tell more, but the distance of short clean texts grows with them.
COMMON = 16
#: Documents and words that a language's reference needs.
SUPPORT_DOCS, SUPPORT_WORDS = 20, 2000
#: Languages that have references of their own, those of most documents first; so what is broadcast stays below a few MB.
LANGUAGES = 1024


def words_of(text: Column) -> Column:
    return let(F.btrim(text, F.lit(WHITE)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[\\x20\\x09-\\x0D]+")))


def covered(windows: Column, span: int) -> Column:
    """How many places the windows (sorted structs of hash and first place) cover that share their hash with another."""

    def places(w: Column) -> Column:
        def repeated(x: Column, i: Column) -> Column:
            return (x["h"] == F.get(w, i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(w, i - 1)["h"]))

        return F.transform(F.filter(w, lambda x, i: F.coalesce(repeated(x, i), F.lit(False))), lambda x: x["p"])

    def total(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(span)), F.lit(span))), F.lit(0), lambda s, x: s + x)

    return let(F.sort_array(places(windows)), total)


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and class_counts."""
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_counts", "common"]
    kept = df.drop(*(c for c in df.columns if c.lower() in new and c != text))
    t = F.coalesce(F.col(text), F.lit(""))
    out = kept.withColumns({"__t": t}).withColumns({"__w": words_of(F.col("__t"))} | {f"__{k}": F.regexp_count("__t", F.lit(v)) for k, v in CLASSES.items()})
    white = F.regexp_count("__t", F.lit("[\\x20\\x09-\\x0D]"))
    w = F.col("__w")
    grams = F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    )
    out = out.withColumns({"__g": grams, "__white": white, "__n": F.size(w).cast("long")})
    g = F.col("__g")
    windows = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    classes = {**{k: F.col(f"__{k}") for k in CLASSES}, "wide": F.octet_length("__t") - F.char_length("__t"), "white": F.col("__white")}
    inner = sum((F.col(f"__{k}") for k in CLASSES), F.lit(0))
    classes["other"] = F.char_length("__t") - F.col("__white") - inner
    out = out.withColumns({
        "n_words": F.col("__n"),
        "word_chars": (F.char_length("__t") - F.col("__white")).cast("long"),
        "n_symbols": F.col("__symbol").cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(windows, lambda x: covered(x, 3))).cast("long"),
        "class_counts": F.array(*(classes[k].cast("long") for k in CLASS_NAMES)),
    })
    return out.drop("__t", "__w", "__g", "__n", "__white", *(f"__{k}" for k in CLASSES))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))


def common_words(sound: DataFrame, key: Column, text: str) -> tuple[DataFrame, DataFrame]:
    """__lang and word (at most COMMON a language, of the LANGUAGES of most documents that have support), and those of all together.

    sound: documents that pass the base rules. Words are counted within each task before any are sent.
    """
    rank = Window.partitionBy("__lang").orderBy(F.desc("docs"), "word")
    sizes = sound.groupBy(key.alias("__lang")).agg(F.count("*").alias("all"), F.sum("n_words").alias("words"))
    own = sizes.where((F.col("all") >= SUPPORT_DOCS) & (F.col("words") >= SUPPORT_WORDS)).orderBy(F.desc("all"), "__lang").limit(LANGUAGES).select("__lang")
    held = sound.select(key.alias("__lang"), F.explode(F.array_distinct(words_of(F.lower(text)))).alias("word"))
    held = held.groupBy("__lang", "word").agg(F.count("*").alias("docs")).where(F.col("word").rlike("^\\p{L}+$"))
    held = stored(held, "words")
    best = held.join(F.broadcast(own), "__lang").withColumn("at", F.row_number().over(rank)).where(F.col("at") <= COMMON)
    pooled = held.groupBy("word").agg(F.sum("docs").alias("docs")).orderBy(F.desc("docs"), "word").limit(COMMON)
    found = stored(best.select("__lang", "word"), "common"), stored(pooled.select(F.lit("all").alias("__lang"), "word"), "common")
    forget(held)
    return found


def with_common(features: DataFrame, text: str, bins: list[str]) -> DataFrame:
    """features with common: each of the bins that the text holds (word) and how often (n)."""
    if not bins:
        return features.withColumn("common", F.array().cast("array<struct<word:string,n:bigint>>"))
    held = F.filter(words_of(F.lower(F.coalesce(F.col(text), F.lit("")))), lambda x: x.isin(bins))

    def counted(c: Column) -> Column:
        return F.transform(F.array_distinct(c), lambda x: F.struct(x.alias("word"), F.size(F.filter(c, lambda y: y == x)).cast("long").alias("n")))

    return features.withColumn("__c", held).withColumn("common", counted(F.col("__c"))).drop("__c")


def references(features: DataFrame, key: Column, words: DataFrame) -> DataFrame:
    """A row for each key with common words: __lang, class_sums, word_sums (map of its common words) and words_all, over all rows."""
    key = key.alias("__lang")
    sums = features.groupBy(key).agg(F.array(*(F.sum(F.col("class_counts")[i]) for i in range(len(CLASS_NAMES)))).alias("class_sums"), F.sum("n_words").alias("words_all"))
    common = features.select(key, F.explode("common").alias("c")).groupBy("__lang", "c.word").agg(F.sum("c.n").alias("n"))
    common = common.join(F.broadcast(words), ["__lang", "word"])  # at most COMMON x LANGUAGES rows
    maps = common.groupBy("__lang").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "n")))).alias("word_sums"))  # at most COMMON entries
    return sums.join(maps, "__lang")


def _part(p: Column, q: Column) -> Column:
    """What a bin with shares p and q adds to twice the divergence, in bits."""

    def term(x: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)

    return term(p) + term(q)


def class_distance() -> Column:
    """Jensen-Shannon distance of class_counts and class_sums (less the text's own where __own is 1); null without a reference."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)

    parts = F.zip_with("class_counts", "class_sums", lambda x, y: F.struct(x.alias("x"), (y - x * F.col("__own")).alias("y")))
    sizes = F.struct(total(F.col("class_counts")).alias("p"), (total(F.col("class_sums")) - total(F.col("class_counts")) * F.col("__own")).alias("q"))

    def sums(s: Column) -> Column:
        return F.when(s["q"] > 0, F.aggregate(parts, F.lit(0.0), lambda acc, e: acc + _part(e["x"] / s["p"], e["y"] / s["q"])))

    return let(let(sizes, sums), lambda v: F.when(v.isNotNull(), F.sqrt(F.greatest(v / 2, F.lit(0.0)))))


def word_distance() -> Column:
    """Jensen-Shannon distance over common words and one bin of all others; bins the text lacks add their share. Null without a reference."""
    all_ = F.col("words_all") - F.col("__own") * F.col("n_words")

    def counted(words: Column) -> Column:
        known = lambda e: F.try_element_at("word_sums", e["word"])
        return F.transform("__bins", lambda e: F.struct((e["n"] / F.col("n_words")).alias("p"), ((known(e) - F.col("__own") * e["n"]) / words).alias("q")))

    def distance(bins: Column, words: Column) -> Column:
        def total(a: Column, field: str) -> Column:
            return F.aggregate(a, F.lit(0.0), lambda s, e: s + e[field])

        mine = F.aggregate("__bins", F.lit(0).cast("bigint"), lambda s, e: s + e["n"])
        everything = (F.aggregate(F.map_values("word_sums"), F.lit(0).cast("bigint"), lambda s, x: s + x) - F.col("__own") * mine) / words
        shared = F.aggregate(bins, F.lit(0.0), lambda s, e: s + _part(e["p"], e["q"]))
        sums = F.struct(total(bins, "p").alias("own"), total(bins, "q").alias("seen"), everything.alias("all"))
        return let(sums, lambda t: shared + _part(F.greatest(1 - t["own"], F.lit(0.0)), F.greatest(1 - t["all"], F.lit(0.0))) + F.greatest(t["all"] - t["seen"], F.lit(0.0)))

    found = let(all_, lambda words: F.when(words > 0, let(counted(words), lambda bins: distance(bins, words))))
    return let(found, lambda v: F.when(v.isNotNull(), F.sqrt(F.greatest(v / 2, F.lit(0.0)))))


def judged(features: DataFrame, words: tuple[DataFrame, DataFrame], lang: str = "lang") -> DataFrame:
    """features (stored, with common) with class_distance, word_distance, base_failed and kept. words: as common_words gives them."""
    base, key = base_failed(), F.coalesce(F.col(lang), F.lit(""))
    sound = features.where(~base)
    found = F.broadcast(stored(references(sound, key, words[0]), "references"))  # at most LANGUAGES rows
    pooled = stored(references(sound, F.lit("all"), words[1]), "pooled")  # one row
    names = ("class_sums", "word_sums", "words_all")
    joined = features.withColumns({"__lang": key, "__all": F.lit("all")}).join(found, "__lang", "left")
    pooled = pooled.select(F.col("__lang").alias("__all"), *(F.col(c).alias(f"__{c}") for c in names))
    joined = joined.join(F.broadcast(pooled), "__all", "left").withColumns({c: F.coalesce(c, f"__{c}") for c in names} | {"__own": F.when(base, 0).otherwise(1)})
    known = F.filter("common", lambda e: F.map_contains_key("word_sums", e["word"]))
    joined = joined.withColumn("__bins", F.coalesce(known, F.array().cast("array<struct<word:string,n:bigint>>")))
    words = F.col("n_words") > 0
    out = joined.withColumns({"class_distance": F.when(words, class_distance()), "word_distance": F.when(words, word_distance()), "base_failed": base})
    far = ((F.col("n_words") >= CLASS_GUARD) & (F.col("class_distance") > CLASS_LIMIT)) | ((F.col("n_words") >= WORD_GUARD) & (F.col("word_distance") > WORD_LIMIT))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).drop("__lang", "__all", "__own", "__bins", *names, *(f"__{c}" for c in names))


#: Names of columns that this module needs for itself while it works.
OWN = ["__t", "__w", "__g", "__c", "__n", "__white", *(f"__{k}" for k in CLASSES), "__lang", "__all", "__own", "__bins", "__class_sums", "__word_sums", "__words_all", "class_sums", "word_sums", "words_all"]


def quality(df: DataFrame, text: str = "text", lang: str = "lang", keep_text: bool = True) -> DataFrame:
    """df with features, distances and verdict. Features are stored, as common words, references and verdicts all read them."""
    away = dict(zip(clashes := [c for c in df.columns if c.lower() in OWN], fresh(df, *(f"kept_{n}" for n in range(len(clashes)))), strict=True))
    t, g = away.get(text, text), away.get(lang, lang)
    featured = stored(with_features(df.withColumnsRenamed(away), t), "features")
    words = common_words(featured.where(~base_failed()), F.coalesce(F.col(g), F.lit("")), t)
    bins = sorted({r["word"] for some in words for r in some.select("word").distinct().collect()})  # at most COMMON x (LANGUAGES + 1)
    full = with_common(featured, t, bins)
    counted = stored(full if keep_text else full.drop(t), "features")
    forget(featured)
    return judged(counted, words, g).withColumnsRenamed({b: a for a, b in away.items()})
