"""Quality rules by distribution divergence, in DataFrame expressions only.

Each text gets base counts (words, symbols, repeated lines and 5-word windows), a histogram of
character classes and one of common words.  The histograms of all texts of a language, summed, are
that language's references; a language with too little text, which would be held against itself, has
those of all texts.  A text is rejected where a base rule fails, or where the Jensen-Shannon
distance of a histogram from its reference exceeds a limit and the text is long enough to tell.

Defined results: a null or empty text has no words and fails; rows with a null lang share one
reference; repeated rows get equal results; a null doc_id stays null; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

BROADCAST_ROWS = 10_000
#: Limits of the two distances, and the characters or words from which on they count.
MOST_CLASS, LEAST_CHARS = 0.35, 100
MOST_COMMON, LEAST_WORDS = 0.25, 100  # a text with none of the common words is at 0.24 to 0.3, ordinary prose at 0.1
#: Words from which on a language's texts make a reference of their own; others are held against all texts.
LEAST_REFERENCE = 10_000

#: Common words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in is that for it with "
    "der die und das ist nicht von zu den mit "
    "le la les et des que une est pour dans "
    "el los en un por con se del las como"
).split()
#: Character classes of words, told in this order; what is left is one more.
CLASSES = (("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("letter", r"\p{L}+"), ("stop", "[.,;:!?'\"()-]+"))
SYMBOLS = "#*$%&|<>"
_SPACE = r"[\x20\x09-\x0D]+"


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two share arrays."""
    half = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    parts = F.zip_with(p, q, lambda x, y: half(x, y) + half(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2))


def _repeated_windows() -> Column:
    """Places of the windows that occur twice or more, from ``placed`` (hash, place) in order of hash."""
    near = lambda x, k: F.coalesce(F.get("placed", k)["h"] == x["h"], F.lit(False))
    return F.sort_array(F.transform(F.filter("placed", lambda x, k: near(x, k - 1) | near(x, k + 1)), lambda x: x["i"]))


def counted(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, the base counts and both histograms."""
    text = F.coalesce("text", F.lit(""))
    one = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), text.alias("t"), F.array_remove(F.split(text, _SPACE), "").alias("words"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    bare = F.col("t")
    for s in SYMBOLS:
        bare = F.replace(bare, F.lit(s), F.lit(""))
    two = one.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"), F.array_join("words", "").alias("joined"), F.length("t").alias("chars"),
        (F.length("t") - F.length(bare)).cast("long").alias("n_symbols"), lines.alias("lines"),
        F.when(F.size("words") >= 5, F.transform(F.sequence(F.lit(1), F.size("words") - 4), lambda i: F.xxhash64(F.slice("words", i, 5)))).otherwise(F.array().cast("array<long>")).alias("w5"),
        F.array_remove(F.transform("words", lambda w: F.array_position(F.lit(COMMON_WORDS), w)), 0).alias("common"),
    )
    # Only texts that repeat a window pay for the order of theirs.  A lambda would compute what it
    # reads anew for each element, so that must be a column.
    placed = F.sort_array(F.transform("w5", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    three = two.withColumn("placed", F.when(F.size(F.array_distinct("w5")) < F.size("w5"), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    three = three.withColumn("at", _repeated_windows())
    rest, classes = F.col("joined"), []
    for name, pattern in CLASSES:
        three = three.withColumn(f"after_{name}", F.regexp_replace(rest, pattern, ""))
        classes.append((F.length(rest) - F.length(f"after_{name}")).cast("double"))
        rest = F.col(f"after_{name}")
    classes += [F.length(rest).cast("double"), (F.col("chars") - F.length("joined")).cast("double")]
    steps = F.transform("at", lambda x, k: F.least(F.coalesce(F.get("at", k + 1) - x, F.lit(5)), F.lit(5)))
    words = [(F.size("common") - F.size(F.array_remove("common", k + 1))).cast("double") for k in range(len(COMMON_WORDS))]
    return three.select(
        "doc_id", "lang", "n_words", F.length("joined").cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        F.array(*classes).alias("classes"), F.array(*words, (F.col("n_words") - F.size("common")).cast("double")).alias("commons"),
    )


def apply_rules(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): the base counts, base_failed, both distances and kept."""
    rows = stored(counted(docs), "counted")
    sums = lambda name, n: F.array(*(F.sum(F.col(name)[k]) for k in range(n)))
    own = rows.groupBy("lang").agg(sums("classes", len(CLASSES) + 2).alias("c"), sums("commons", len(COMMON_WORDS) + 1).alias("w"), F.sum("n_words").alias("n"))
    own = stored(own, "sums", 4)
    all_c, all_w = own.agg(sums("c", len(CLASSES) + 2), sums("w", len(COMMON_WORDS) + 1)).first()  # one row of fixed length
    enough = F.col("n") >= LEAST_REFERENCE
    whole = lambda name, values: F.when(enough, F.col(name)).otherwise(F.array(*(F.lit(v) for v in values)))
    references = stored(own.select("lang", _shares(whole("c", all_c)).alias("c"), _shares(whole("w", all_w)).alias("w")), "references", 4)
    small = references.count() <= BROADCAST_ROWS
    out = rows.join(F.broadcast(references) if small else references, "lang")
    out = out.withColumn("class_distance", distance(_shares(F.col("classes")), F.col("c"))).withColumn("common_distance", distance(_shares(F.col("commons")), F.col("w")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    odd = ((F.col("word_chars") >= LEAST_CHARS) & (F.col("class_distance") > MOST_CLASS)) | ((F.col("n_words") >= LEAST_WORDS) & (F.col("common_distance") > MOST_COMMON))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~odd).alias("kept"), F.round("class_distance", 6).alias("class_distance"), F.round("common_distance", 6).alias("common_distance"))
