"""Quality rules by distribution divergence, in DataFrame operations.

Each document's histogram of character classes and of its language's common
words is compared with the language's reference by Jensen-Shannon distance
(square root of the divergence in bits, from 0 to 1). References are summed
over all documents that pass the base rules. Documents under a minimum length
are not judged by a histogram they are too short to fill.

Defined results
- Null or blank text: all counts 0, base_failed, not kept.
- Null or other language: those documents form a language of their own, with the common words of all four.
- A language none of whose documents pass the base rules has no reference: distances are null and reject nothing.
- Repeated rows are judged row by row. Empty table: no rows. Columns named in ``keep`` pass through.
- Windows are told apart by 38 hash bits and then by their words, in texts of up to 2**26 words.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD, Scratch

# Frequent function words of four languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "on"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "du", "que", "une", "dans", "est"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "ist", "im"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "por", "con"],
}
COMMON_WORDS["other"] = sorted({w for ws in COMMON_WORDS.values() for w in ws})

#: Character classes, each by the pattern of what isn't in it; all other characters are the last class.
CLASSES = {
    "lower": "[^a-z]++",
    "upper": "[^A-Z]++",
    "digit": "[^0-9]++",
    "blank": "[^\\x20\\x09-\\x0D]++",
    "stops": "[^.,;:'\"?()\\-]++",
    "marks": "[^!#*$%&|<>=_{}~^@+/\\\\\\[\\]`]++",
}

MIN_CHARS = 200
MIN_WORDS = 100
MAX_CHAR_DISTANCE = 0.28
MAX_WORD_DISTANCE = 0.26
_PLACE_BITS = 26


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Number of words in a 3-word window found twice or more in the array, the first find included.

    Windows are packed as hash bits and place into one long and sorted, which
    puts equal windows side by side; equality is settled on the words. Places
    of repeated windows, sorted again, each cover the words up to the next
    place, three at most.
    """
    low = F.lit((1 << _PLACE_BITS) - 1)
    packed = lambda i: F.shiftleft(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), _PLACE_BITS).bitwiseOR(i.cast("long"))

    def same(x: Column, y: Column) -> Column:
        i, j = x.bitwiseAND(low).cast("int"), y.bitwiseAND(low).cast("int")
        bits = F.shiftright(x, _PLACE_BITS) == F.shiftright(y, _PLACE_BITS)
        for k in range(3):
            bits = bits & (F.get(words, i + k) == F.get(words, j + k))
        return F.coalesce(bits, F.lit(False))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    def places(o: Column) -> Column:
        hit = F.transform(o, lambda x, k: F.when(same(x, F.get(o, k - 1)) | same(x, F.get(o, k + 1)), x.bitwiseAND(low).cast("int")))
        return F.sort_array(F.array_compact(hit))

    many = let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), packed)), lambda o: let(places(o), covered))
    return F.when(F.size(words) >= 4, many).otherwise(F.lit(0)).cast("long")


def _by_language(lang: Column, value: Callable[[Sequence[str]], Column]) -> Column:
    out = value(COMMON_WORDS["other"])
    for code, ws in COMMON_WORDS.items():
        if code != "other":
            out = F.when(lang == code, value(ws)).otherwise(out)
    return out


def features(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(row, lang, base counts, chars, commons): keep's columns as a struct, counts and both histograms."""
    t = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("t"), F.when(docs[lang_col].isin(list(COMMON_WORDS)), docs[lang_col]).otherwise("other").alias("lang"))
    sizes = [F.length(F.regexp_replace("t", p, "")).cast("long") for p in CLASSES.values()]
    chars = let(F.array(*sizes), lambda a: F.concat(a, F.array(F.length("t").cast("long") - F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y))))
    edge = "(?<![^\\x20\\x09-\\x0D])(?i:%s)(?![^\\x20\\x09-\\x0D])"
    found = F.transform(F.regexp_extract_all("t", _by_language(F.col("lang"), lambda ws: F.lit(edge % "|".join(ws))), F.lit(0)), F.lower)
    listed = _by_language(F.col("lang"), lambda ws: F.array(*[F.lit(w) for w in ws]))
    commons = let(found, lambda f: F.transform(listed, lambda w: F.size(F.filter(f, lambda x: x == w)).cast("long")))
    lines = F.transform(F.filter(F.split("t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lambda x: F.sha2(x, 256))
    text = let(
        F.regexp_extract_all("t", F.lit(WORD), F.lit(0)),
        lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).alias("n_repeat_words")),
    )
    t = t.select(
        "row",
        "lang",
        text.alias("text"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]++", "")).cast("long").alias("n_symbols"),
        chars.alias("chars"),
        commons.alias("commons"),
    )
    n = F.col("text.n_words")
    t = t.select(
        "row",
        "lang",
        n.alias("n_words"),
        (F.aggregate("chars", F.lit(0).cast("long"), lambda x, y: x + y) - F.get("chars", F.lit(list(CLASSES).index("blank")))).alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        F.col("text.n_repeat_words").alias("n_repeat_words"),
        "chars",
        F.concat("commons", F.array(n - F.aggregate("commons", F.lit(0).cast("long"), lambda x, y: x + y))).alias("commons"),
    )
    return t.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _js(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; null where one is empty."""
    total = lambda a: F.nullif(F.aggregate(a, F.lit(0.0), lambda x, y: x + y), F.lit(0.0))
    term = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    shares = lambda a: let(total(a), lambda s: F.transform(a, lambda x: x / s))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(shares(p), shares(q), lambda x, y: (term(x, y) + term(y, x)) / 2), F.lit(0.0), lambda x, y: x + y)))


def judge_documents(
    docs: DataFrame,
    keep: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    lang_col: str = "lang",
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """features() with char_distance, word_distance and kept. One pass over the texts; its counts are read twice."""
    done = Scratch(docs.sparkSession).save(features(docs, keep, text_col, lang_col), "features")
    widest = max(len(ws) for ws in COMMON_WORDS.values()) + 1
    # a language has its own number of bins, so an absent bin sums to null and goes
    sums = lambda name, n: F.array_compact(F.array(*[F.sum(F.get(name, F.lit(k))).cast("double") for k in range(n)]))
    refs = done.where("not base_failed").groupBy("lang").agg(sums("chars", len(CLASSES) + 1).alias("ref_chars"), sums("commons", widest).alias("ref_commons"))
    out = done.join(F.broadcast(refs), "lang", "left")  # five languages at most
    as_double = lambda name: F.transform(name, lambda x: x.cast("double"))
    long_enough = F.aggregate("chars", F.lit(0).cast("long"), lambda x, y: x + y) >= MIN_CHARS
    out = out.withColumn("char_distance", F.when(long_enough & F.col("ref_chars").isNotNull(), _js(as_double("chars"), F.col("ref_chars"))))
    out = out.withColumn("word_distance", F.when((F.col("n_words") >= MIN_WORDS) & F.col("ref_commons").isNotNull(), _js(as_double("commons"), F.col("ref_commons"))))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= max_char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance)
    return out.withColumn("kept", ~F.col("base_failed") & near)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judge_documents(docs).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """DuckDB SQL of op10_quality_rules for tables of distinct ids."""
    kinds = ", ".join(f"length(regexp_replace(t, '{p.replace('++', '+').replace(chr(39), chr(39) * 2)}', '', 'g')) AS {n}" for n, p in CLASSES.items())
    bins = " UNION ALL ".join(f"SELECT doc_id, lang, base_failed, '{n}' AS bin, {n} AS n FROM c" for n in CLASSES)
    rest = " - ".join(CLASSES)
    listed = ", ".join(f"('{code}', '{w}')" for code, ws in COMMON_WORDS.items() for w in ws)
    codes = ", ".join(f"'{c}'" for c in COMMON_WORDS if c != "other")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({codes}) THEN lang ELSE 'other' END AS lang FROM documents),
w AS (SELECT doc_id, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, lang, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
tri AS (SELECT doc_id, i, w, lead(w, 1) OVER o AS a, lead(w, 2) OVER o AS b FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, a, b) AS c FROM tri WHERE b IS NOT NULL) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY 1),
cnt AS (SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars FROM w GROUP BY 1),
ln AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
c AS (SELECT d.doc_id, lang, length(t) AS chars, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
   coalesce(n_words, 0) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * coalesce(n_words, 0) AS base_failed, {kinds}
  FROM d LEFT JOIN cnt USING (doc_id) LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)),
listed(lang, bin) AS (VALUES {listed}),
hits AS (SELECT doc_id, l.lang, l.bin, count(*) AS n FROM w JOIN listed l ON l.lang = w.lang AND l.bin = lower(w.w) GROUP BY 1, 2, 3),
wb AS (SELECT c.doc_id, c.lang, base_failed, l.bin, coalesce(h.n, 0) AS n FROM c JOIN listed l ON l.lang = c.lang LEFT JOIN hits h ON h.doc_id = c.doc_id AND h.bin = l.bin),
b AS (SELECT 'char' AS kind, * FROM ({bins} UNION ALL SELECT doc_id, lang, base_failed, 'rest', chars - {rest} FROM c) UNION ALL SELECT 'word', * FROM wb UNION ALL SELECT 'word', doc_id, lang, any_value(base_failed), '#', any_value(n_words) - sum(n) FROM wb JOIN c USING (doc_id, lang, base_failed) GROUP BY doc_id, lang),
ref AS (SELECT kind, lang, bin, sum(n)::DOUBLE AS m FROM b WHERE NOT base_failed GROUP BY 1, 2, 3),
s AS (SELECT b.doc_id, b.kind, n / nullif(sum(n) OVER p, 0) AS x, m / nullif(sum(m) OVER p, 0) AS y FROM b LEFT JOIN ref r ON r.kind = b.kind AND r.lang = b.lang AND r.bin = b.bin WINDOW p AS (PARTITION BY b.doc_id, b.kind)),
js AS (SELECT doc_id, kind, sqrt(greatest(0, sum((CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2))) AS distance FROM s GROUP BY 1, 2)
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (chars < {MIN_CHARS} OR coalesce(k.distance, 0) <= {MAX_CHAR_DISTANCE}) AND (n_words < {MIN_WORDS} OR coalesce(v.distance, 0) <= {MAX_WORD_DISTANCE}) AS kept
FROM c LEFT JOIN js k ON k.doc_id = c.doc_id AND k.kind = 'char' LEFT JOIN js v ON v.doc_id = c.doc_id AND v.kind = 'word'
"""


OP10_SQL = _oracle()
