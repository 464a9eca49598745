"""Quality rules whose thresholds follow the data: quantile sketches per language and source. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, few, written

#: a word is a run of characters other than 0x20 and 0x09-0x0D
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: ranks of the quantiles of symbols in which a break is looked for
GRID = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.925, 0.95, 0.97, 0.98, 0.99]
#: between two neighbouring quantiles is a break if, counted from 1, one is so many times the other
BREAK = 8
#: fences of the length of words stand at so many of the lesser of the distances from the median to the quartiles
REACH = 10
#: documents that the quantiles of a language weigh as in those of its sources, and those of the corpus in those of its languages
PRIOR = 100
#: relative rank error of the sketches is one in so many
ACCURACY = 10_000
#: groups whose fences are sent to every task; with more of them they are joined by a shuffle
MOST_SENT = 20_000


def base_columns(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long) to docs.

    Everything is computed inside the row, in time near to linear in the text: windows become hashes, equal ones meet by sorting.
    """
    text = F.coalesce("text", F.lit(""))
    out = docs.withColumns({"_words": F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))})
    n = F.size("_words")
    every = F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    windows = F.slice(every, 1, F.greatest(n - 2, F.lit(0)))
    out = out.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.char_length(F.regexp_replace(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, f"{SYMBOLS}+", ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": windows,
    })
    return out.withColumn("n_repeat_words", F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0)).otherwise(_covered(F.col("_windows"))).cast("long")).drop("_words", "_lines", "_windows")


def _covered(windows: Column) -> Column:
    """Words covered by 3-word windows whose hash comes twice or more."""
    at = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    near = F.arrays_zip(at.alias("own"), F.concat(none, at).alias("left"), F.concat(F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), none).alias("right"))
    twice = F.filter(near, lambda x: x["own"].isNotNull() & (F.coalesce(x["left"]["h"] == x["own"]["h"], F.lit(False)) | F.coalesce(x["right"]["h"] == x["own"]["h"], F.lit(False))))
    places = F.array_sort(F.transform(twice, lambda x: x["own"]["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum"))
    return F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(3), p - acc["last"])).alias("sum")), lambda acc: acc["sum"])


def _metrics(based: DataFrame) -> DataFrame:
    """Whole numbers, so that they compare alike everywhere: symbols for a thousand characters of words, and hundredths of a character for a word."""
    return based.withColumns({
        "symbols": F.expr("(1000 * n_symbols) div greatest(word_chars, 1)"),
        "word_length": F.expr("(100 * word_chars) div greatest(n_words, 1)"),
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    })


def break_in(quantiles: Column) -> Column:
    """Where ordered values part most: the geometric middle of the two neighbours, counted from 1, of which one is the largest multiple of the other; null if that is under BREAK."""
    steps = F.transform(F.sequence(F.lit(0), F.size(quantiles) - 2), lambda i: F.struct(((quantiles[i + 1] + 1) / (quantiles[i] + 1)).alias("ratio"), (-i).alias("first"), F.sqrt((quantiles[i] + 1.0) * (quantiles[i + 1] + 1.0)).alias("middle")))
    most = F.array_max(steps)
    return F.when(most["ratio"] >= BREAK, most["middle"] - 1)


def fences(measured: DataFrame) -> DataFrame:
    """_lang, _source, _most_symbols, _least_word_length, _most_word_length: the values beyond which a document of the group is rejected.

    One mergeable quantile sketch per metric and group, of the documents that pass the base rules; sketches of a group are built in every task and
    merged after the shuffle, so that a source with a third of all rows sends one sketch per task. All fences are quantiles or made of them:

    * symbols: most texts have about as many as others of their source, junk has many times that. The fence lies in the largest break between
      neighbouring quantiles of GRID. A group without a break takes that of its language, or else of the corpus; without any, symbols reject nothing.
    * length of words: REACH times the lesser distance between median and quartiles on both sides of the median, and as far more as that was drawn.

    The quantiles of length and the break of n documents of a source are drawn to those of its language, as if these came from PRIOR documents more, and
    those of a language to those of the corpus: one rule for groups of any size. Null languages and sources are groups of their own. The
    driver gets the quantiles of the whole corpus, one row.
    """
    lengths = F.percentile_approx("word_length", [0.25, 0.5, 0.75], ACCURACY)
    cube = measured.filter(~F.col("base_failed")).rollup("lang", "source").agg(F.grouping_id().alias("_level"), F.count("*").alias("_n"), lengths.alias("_w"), break_in(F.percentile_approx("symbols", GRID, ACCURACY)).alias("_b"))
    cube = checkpointed(cube.select("lang", "source", "_level", "_n", *(F.col("_w")[k].cast("double").alias(f"_w{k}") for k in range(3)), "_b"))
    by_source, by_lang = (cube.filter(F.col("_level") == k).drop("_level") for k in (0, 1))
    whole = cube.filter(F.col("_level") == 3).select("_w0", "_w1", "_w2", "_b").first()
    names, prior = ["_w0", "_w1", "_w2", "_b"], F.lit(float(PRIOR))
    drawn = lambda own, parent: F.coalesce((F.col("_n") * own + prior * parent) / (F.col("_n") + prior), own, parent)  # noqa: E731  a missing one has no say
    by_lang = by_lang.select(F.col("lang").alias("_lang"), *(drawn(F.col(m), F.lit(whole[m] if whole else None).cast("double")).alias(f"{m}_lang") for m in names))
    out = by_source.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang"))).select("lang", "source", F.col("_w1").alias("_own"), *(drawn(F.col(m), F.col(f"{m}_lang")).alias(m) for m in names))
    reach = REACH * F.least(F.col("_w1") - F.col("_w0"), F.col("_w2") - F.col("_w1")) + F.abs(F.col("_own") - F.col("_w1"))
    return out.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("_b").alias("_most_symbols"), (F.col("_w1") - reach).alias("_least_word_length"), (F.col("_w1") + reach).alias("_most_word_length"))


def _judged(docs: DataFrame, carried: list[Column]) -> DataFrame:
    """Rows are measured once and written with what is carried of them; the fences and the verdicts come from the written numbers."""
    measured, _ = written(_metrics(base_columns(docs.select("text", "lang", "source", *carried))).drop("text"), "measured")
    limits = few(checkpointed(fences(measured)), MOST_SENT)
    out = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.coalesce(F.col("symbols") <= F.col("_most_symbols"), F.lit(True)) & F.col("word_length").between(F.col("_least_word_length"), F.col("_most_word_length"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def judged(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang, source): doc_id, the base columns, base_failed, kept.

    Null text counts as empty, which fails the base rules. Null languages and sources are groups like others; repeated rows and null doc_ids are
    judged like others. An empty table gives no rows. Other columns are ignored. Groups of more than about ACCURACY / 2 rows have sketched
    quantiles, whose rank is off by one in ACCURACY at most; a document so near a fence may be judged otherwise when tasks end in another order.
    """
    return _judged(docs, [F.col("doc_id")]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_filter(docs: DataFrame) -> DataFrame:
    """Rows of docs that the rules keep, with all columns of docs as they are, whatever their names."""
    return _judged(docs, [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")]).filter("kept").select("_row.*")
