"""Quality rules with adaptive thresholds, in DataFrame operations only.

Every text is measured; each measure becomes a bin of a fixed-bin quantile sketch by
language and source. Such sketches are counts, so they merge by addition: partial
aggregation merges them within and across tasks, and a group with fewer than `MIN_GROUP`
documents borrows the sketch merged over its language, or over everything. The quartiles
of the sketch give the fences that replace fixed cutoffs, and the fences are joined back to
the documents. No fence holds a constant of its own:

* marks (ASCII characters within words that are neither letters nor digits, by characters) and
  word_length lie within some quartile distances of the quartiles, marks on the upper side only;
* variety (different words by the root of the words) has a lower fence as far below the lower
  quartile, by ratio, as the quartiles are apart;
* dup_lines and repeats are zero in most texts, so their sketches count only the texts that
  have any, and the fence lies beyond the quartiles of those.

The smaller a sketch, the further out its fences, as its quartiles are less certain.

Null texts count as empty. A null language or source is a group of its own. Documents that
fail the base rules are in no sketch. Every row is judged by itself, repeated rows alike;
an empty table gives an empty result. Columns other than doc_id, text, lang and source are
ignored by assess() and kept by keep_documents().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise

SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 8  # a power of two
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_GROUP = 50
#: Measure: quartile distances that the fences lie beyond the quartiles; for variety, ratios of the quartiles below the lower one.
#: Ratios are in thousandths, the others in tenths; bins are 0 to 1000.
MEASURES = {"marks": 7, "word_length": 4, "variety": 3, "dup_lines": 3, "repeats": 3}
#: Measures whose sketches leave out zeros.
WHERE_ANY = ("dup_lines", "repeats")
#: Measures of which any text may have little.
NO_LEAST = ("marks", *WHERE_ANY)
#: Times 1 / sqrt(size) that the distances of a sketch of this size are longer.
SMALL = 2.0
#: ASCII punctuation and symbols.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTED = ("n_lines", "n_marks", "n_different", *BASE)
MEASURED = (*COUNTED, "base_failed")


def measure(docs: DataFrame) -> DataFrame:
    """Adds the base counts, n_lines, n_marks, n_different and base_failed. Added columns replace any of the same name.

    Steps whose arrays are read more than once are columns of their own, so that no lambda
    computes an array again for each element.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    x = docs.withColumns({"_words": words, "_lines": lines, "n_words": F.size(words).cast("long")})
    x = x.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    span = 1
    while span < WINDOW_WORDS:  # a hash of 2n words is a hash of two hashes of n words
        pairs = F.greatest(F.size("_hashes") - span, F.lit(0))
        x = x.withColumn("_hashes", F.zip_with(F.slice("_hashes", 1, pairs), F.slice("_hashes", span + 1, pairs), lambda a, b: F.xxhash64(a, b)))
        span *= 2
    x = x.withColumns(
        {
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_marks": (F.length(text) - F.length(F.translate(text, MARKS, ""))).cast("long"),
            "n_different": F.size(F.array_distinct("_words")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    sorted_windows = F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    x = x.withColumn("_sorted", sorted_windows)
    before = F.concat(F.array(F.lit(None).cast("long")), F.slice(F.col("_sorted.h"), 1, F.size("_sorted") - 1))
    after = F.concat(F.slice(F.col("_sorted.h"), 2, F.size("_sorted")), F.array(F.lit(None).cast("long")))
    x = x.withColumns({"_before": before, "_after": after})
    found = F.filter(F.arrays_zip(F.col("_sorted.h").alias("h"), F.col("_sorted.i").alias("i"), F.col("_before").alias("b"), F.col("_after").alias("a")), lambda e: F.coalesce(e["h"] == e["b"], F.lit(False)) | F.coalesce(e["h"] == e["a"], F.lit(False)))
    starts = F.array_sort(F.transform(found, lambda e: e["i"]))
    zero = F.struct(F.lit(-WINDOW_WORDS).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(starts, zero, lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW_WORDS), i - acc["last"])).alias("n")), lambda acc: acc["n"])
    x = x.withColumn("n_repeat_words", F.when(F.col("_sorted").isNull(), F.lit(0)).otherwise(covered).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    x = x.withColumn("base_failed", failed)
    # a generator, through which no filter is pushed: a filter on a measure would compute it, and all it is made of, again
    measured = F.inline(F.array(F.struct(*MEASURED)))
    return x.select(*(F.col(f"`{c}`") for c in docs.columns if c not in MEASURED), measured)


def bins() -> dict[str, Column]:
    """The sketch bin of each measure, by whole-number division."""

    def share(a: str, b: str, scale: int) -> Column:
        return F.least(F.lit(1000), F.floor(F.col(a) * scale / F.greatest(F.col(b), F.lit(1)))).cast("long")

    variety = F.least(F.lit(1000), F.floor(10 * F.col("n_different").cast("double") / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double")))).cast("long")
    return {"marks": share("n_marks", "word_chars", 1000), "word_length": share("word_chars", "n_words", 10), "variety": variety, "dup_lines": share("n_dup_lines", "n_lines", 1000), "repeats": share("n_repeat_words", "n_words", 1000)}


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: the counts of each group's bins."""
    good = measured.where(~F.col("base_failed")).select("lang", "source", *(b.alias(k) for k, b in bins().items()))
    by_row = F.array(*(F.struct(F.lit(k).alias("measure"), F.col(k).alias("bin")) for k in MEASURES))
    counted = ~F.col("measure").isin(*WHERE_ANY) | (F.col("bin") > 0)
    return good.select("lang", "source", F.inline(by_row)).where(counted).groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))


def quartiles(counts: DataFrame, *keys: str) -> DataFrame:
    """size, q1 and q3 of each group's sketch, merged over the columns that are not in keys."""
    merged = counts.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    x = merged.select(*keys, "measure", "bin", F.sum("n").over(group).alias("size"), F.sum("n").over(group.orderBy("bin")).alias("below"))

    def quantile(quarters: int) -> Column:
        return F.min(F.when(4 * F.col("below") >= quarters * F.col("size"), F.col("bin")))

    return x.groupBy(*keys, "measure").agg(F.max("size").alias("size"), quantile(1).alias("q1"), quantile(3).alias("q3"))


def _power(x: str, n: int) -> Column:
    """By products of whole numbers, which are exact."""
    out = F.col(x)
    for _ in range(n - 1):
        out = out * F.col(x)
    return out


def thresholds(counts: DataFrame) -> DataFrame:
    """lang, source, and low and high of each measure, by the finest sketch with MIN_GROUP documents."""
    names = F.explode(F.array(*(F.lit(k) for k in MEASURES))).alias("measure")
    groups = counts.select("lang", "source").distinct().select("lang", "source", names)
    fine = quartiles(counts, "lang", "source").withColumnsRenamed({"lang": "_l0", "source": "_s0", "measure": "_m0"})
    by_lang = quartiles(counts, "lang").select(F.col("lang").alias("_l1"), F.col("measure").alias("_m1"), *(F.col(c).alias(f"{c}_lang") for c in ("size", "q1", "q3")))
    overall = quartiles(counts).select(F.col("measure").alias("_m2"), *(F.col(c).alias(f"{c}_all") for c in ("size", "q1", "q3")))
    x = groups.join(fine, F.col("lang").eqNullSafe(F.col("_l0")) & F.col("source").eqNullSafe(F.col("_s0")) & (F.col("measure") == F.col("_m0")), "left")
    x = x.join(by_lang, F.col("lang").eqNullSafe(F.col("_l1")) & (F.col("measure") == F.col("_m1")), "left").join(overall, F.col("measure") == F.col("_m2"), "left")

    def chosen(q: str) -> Column:
        return F.when(F.col("size") >= MIN_GROUP, F.col(q)).when(F.col("size_lang") >= MIN_GROUP, F.col(f"{q}_lang")).otherwise(F.col(f"{q}_all"))

    x = x.select("lang", "source", "measure", *(chosen(q).cast("double").alias(q) for q in ("size", "q1", "q3")))
    columns = []
    for name, times in MEASURES.items():
        reach = times * F.greatest(F.col("q3") - F.col("q1"), F.lit(1.0)) * (1.0 + SMALL / F.sqrt("size"))
        if name == "variety":
            low, high = _power("q1", times + 1) / _power("q3", times), F.lit(1000.0)
        else:
            low, high = F.lit(0.0) if name in NO_LEAST else F.col("q1") - reach, F.col("q3") + reach
        columns += [F.max(F.when(F.col("measure") == name, at)).alias(f"{name}_{side}") for side, at in (("low", low), ("high", high))]
    return x.groupBy("lang", "source").agg(*columns)


def verdict(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds kept: base rules passed and every measure within the fences of the document's group."""
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    x = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = ~F.col("base_failed")
    for name, b in bins().items():
        inside = inside & F.coalesce(b.between(F.col(f"{name}_low"), F.col(f"{name}_high")), F.lit(True))
    return x.withColumn("kept", inside).drop(*limits.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    have = docs.columns
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c) if c in have else F.lit(None).cast(T.StringType()).alias(c) for c in ("lang", "source")))


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document. Texts are read once."""
    measured = materialise(measure(_keyed(docs)).drop("text"), "measured")
    return verdict(measured, materialise(thresholds(sketches(measured)), "thresholds")).select("doc_id", *BASE, "base_failed", "kept")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns. They are measured once, and written with what was measured."""
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_own")
    keyed = docs.select(own, "text", *(F.col(c) if c in docs.columns else F.lit(None).cast(T.StringType()).alias(c) for c in ("lang", "source")))
    measured = materialise(measure(keyed).drop("text"), "measured")
    return verdict(measured, materialise(thresholds(sketches(measured)), "thresholds")).where("kept").select("_own.*")


#: The same in SQL.
SQL = rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
m AS (SELECT doc_id, lang, source, ws, len(ws) AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  length(regexp_replace(text, '[^!-/:-@\[-`{{-~]', '', 'g')) AS n_marks, len(list_distinct(ws)) AS n_different,
  len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, row_number() OVER () AS r FROM w),
g AS (SELECT r, unnest(range(1, n_words - 6)) AS i, ws FROM m WHERE n_words >= 8),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, hash(ws[i:i + 7])) AS k FROM g),
s AS (SELECT r, i - lag(i, 1, -7) OVER (PARTITION BY r ORDER BY i) AS gap FROM h WHERE k > 1),
c AS (SELECT r, sum(least(8, gap)) AS n_repeat_words FROM s GROUP BY r),
a AS (SELECT m.* EXCLUDE (ws), coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  least(1000, 1000 * n_marks // greatest(word_chars, 1)) AS marks,
  least(1000, 10 * word_chars // greatest(n_words, 1)) AS word_length,
  least(1000, floor(10 * n_different::DOUBLE / sqrt(greatest(n_words, 1)::DOUBLE)))::BIGINT AS variety,
  least(1000, 1000 * n_dup_lines // greatest(n_lines, 1)) AS dup_lines,
  least(1000, 1000 * n_repeat_words // greatest(n_words, 1)) AS repeats FROM a),
u AS (SELECT lang, source, measure, bin FROM f UNPIVOT (bin FOR measure IN ({', '.join(MEASURES)})) WHERE NOT base_failed),
k AS (SELECT * FROM u WHERE bin > 0 OR measure NOT IN ({', '.join(f"'{m}'" for m in WHERE_ANY)})),
g3 AS (SELECT DISTINCT lang, source, measure FROM u),
q3 AS (SELECT lang, source, measure, count(*) AS n, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM k GROUP BY ALL),
q2 AS (SELECT lang, measure, count(*) AS n, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM k GROUP BY ALL),
q1 AS (SELECT measure, count(*) AS n, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3 FROM k GROUP BY ALL),
p AS (SELECT g3.lang, g3.source, g3.measure,
  (CASE WHEN q3.n >= {MIN_GROUP} THEN q3.n WHEN q2.n >= {MIN_GROUP} THEN q2.n ELSE q1.n END)::DOUBLE AS n,
  (CASE WHEN q3.n >= {MIN_GROUP} THEN q3.q1 WHEN q2.n >= {MIN_GROUP} THEN q2.q1 ELSE q1.q1 END)::DOUBLE AS lo,
  (CASE WHEN q3.n >= {MIN_GROUP} THEN q3.q3 WHEN q2.n >= {MIN_GROUP} THEN q2.q3 ELSE q1.q3 END)::DOUBLE AS hi
  FROM g3 LEFT JOIN q3 ON g3.lang IS NOT DISTINCT FROM q3.lang AND g3.source IS NOT DISTINCT FROM q3.source AND g3.measure = q3.measure
  LEFT JOIN q2 ON g3.lang IS NOT DISTINCT FROM q2.lang AND g3.measure = q2.measure LEFT JOIN q1 ON g3.measure = q1.measure),
l AS (SELECT lang, source, measure,
  CASE measure WHEN 'variety' THEN {' * '.join(['lo'] * (MEASURES['variety'] + 1))} / ({' * '.join(['hi'] * MEASURES['variety'])}) WHEN 'word_length' THEN lo - reach ELSE 0 END AS low,
  CASE measure WHEN 'variety' THEN 1000 ELSE hi + reach END AS high FROM (
  SELECT *, CASE measure {' '.join(f"WHEN '{k}' THEN {t}" for k, t in MEASURES.items())} END * greatest(hi - lo, 1) * (1 + {SMALL} / sqrt(n)) AS reach FROM p)),
x AS (SELECT r, bool_or(bin NOT BETWEEN low AND high) AS outside
  FROM (SELECT * FROM f UNPIVOT (bin FOR measure IN ({', '.join(MEASURES)}))) v
  JOIN l ON v.lang IS NOT DISTINCT FROM l.lang AND v.source IS NOT DISTINCT FROM l.source AND v.measure = l.measure GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(outside, false) AS kept
FROM f LEFT JOIN x USING (r)
"""
