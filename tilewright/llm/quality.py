"""Quality rules: counts of a text, and the divergence of its histograms from its language's.

A document's character classes (lower, white space, upper, digit, sentence marks, symbols, beyond
ASCII, all else) and its counts of the language's ``common`` most frequent words (all others are
one more bin) are compared with the same histograms of all documents of its language, by
Jensen-Shannon distance (base 2, square root). Guards: the class test needs ``min_chars``
characters, the word test ``min_words`` words; a language needs ``min_reference`` words to be a
reference, else its documents face the base rules alone. A short text's histogram is coarse, so
``slack`` times sqrt(bins / size) is allowed on top of each limit.

All of it is DataFrame functions on one row at a time; the references are two aggregations with
partial sums. Word windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.common import SPACE, bound, read_table, renamed, restored, staged, words_of

COMMON = 20
CLASS_LIMIT = 0.25
WORD_LIMIT = 0.25
SLACK = 0.5
MIN_CHARS = 100
MIN_WORDS = 20
MIN_REFERENCE = 1000
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Classes that are counted after lower-case letters and white space, in this order, with the first two before and the rest behind.
OTHER_CLASSES = ("[A-Z]+", "[0-9]+", "[.,;:!?'\"()-]+", "[#*$%&|<>]+", r"[^\x00-\x7F]+")
N_CLASSES = len(OTHER_CLASSES) + 3


def _without(text: str, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def with_classes(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with array ``name`` of character counts: lower, white space, OTHER_CLASSES, all else.

    Letters go first, so that all other patterns run over the short rest.
    """
    rows = bound(rows, "_rest1", F.regexp_replace(text, "[a-z]+", ""))
    rows = bound(rows, "_rest2", F.regexp_replace("_rest1", SPACE, ""))
    first = [F.length(text) - F.length("_rest1"), F.length("_rest1") - F.length("_rest2"), *[_without("_rest2", c) for c in OTHER_CLASSES]]
    rows = bound(rows, "_some", F.array(*first).cast("array<bigint>"))
    return bound(rows, name, F.concat("_some", F.array(F.length(text) - F.aggregate("_some", F.lit(0).cast("long"), lambda a, b: a + b)))).drop("_rest1", "_rest2", "_some")


def text_counts(docs: DataFrame, text: str) -> DataFrame:
    """All columns of ``docs``, _words, and _base, the counts of a text.

    _base: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (bigint), classes (array of 8
    bigint). Null and empty texts have zeros and no words.
    """
    rows = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    rows = bound(rows, "_words", words_of(F.col("_text")))
    rows = bound(rows, "_windows", F.expr("case when size(_words) >= 3 then transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])) else array() end"))
    # starts of windows found twice or more, in order; most texts have none and skip the sort
    rows = bound(rows, "_sorted", F.expr("""
        case when size(array_distinct(_windows)) = size(_windows) then cast(array() as array<struct<h:bigint,i:int>>)
             else sort_array(transform(_windows, (h, i) -> struct(h as h, i as i))) end"""))
    starts = F.expr("""
        sort_array(transform(filter(_sorted, (x, k) -> (k > 0 and _sorted[greatest(k - 1, 0)].h = x.h) or (k < size(_sorted) - 1 and _sorted[least(k + 1, size(_sorted) - 1)].h = x.h)), x -> x.i))""")
    covered = F.aggregate(starts, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
                          lambda a, i: F.struct(i.alias("last"), (a.n + F.least(F.lit(3), i - a.last)).alias("n")), lambda a: a.n)
    lines = F.transform(F.array(F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]
    rows = with_classes(rows, "_text", "_classes")
    base = F.struct(
        F.size("_words").cast("long").alias("n_words"), (F.length("_text") - F.col("_classes")[1]).cast("long").alias("word_chars"), F.col("_classes")[5].alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"), covered.alias("n_repeat_words"), F.col("_classes").alias("classes"))
    return bound(rows, "_base", base).select(*docs.columns, "_words", "_base")


def language_references(docs: DataFrame, *, text: str = "text", lang: str = "lang", common: int = COMMON, min_reference: int = MIN_REFERENCE) -> DataFrame:
    """(lang, classes, words, shares): histograms of all documents of a language; the last share is of all other words.

    A null language is the empty string. Ties between words go by the word.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = with_classes(rows, "text", "counts").select("lang", F.posexplode("counts").alias("k", "n")).groupBy("lang", "k").agg(F.sum("n").alias("n"))
    classes = counted.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("c")).select("lang", F.expr("transform(c, x -> x.n)").alias("c"))
    classes = classes.selectExpr("lang", "c", "aggregate(c, 0L, (a, b) -> a + b) as chars").where("chars > 0").selectExpr("lang", "transform(c, x -> x / chars) as classes")
    counts = staged(rows.select("lang", F.explode(words_of(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")), "word-counts")
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("place") <= common)
    top = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "word", "n"))).alias("top"))
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= min_reference)
    shares = top.join(sizes, "lang").select("lang", F.col("top.word").alias("words"), F.expr("transform(top, x -> x.n / total)").alias("shares"))
    shares = shares.withColumn("shares", F.expr("concat(shares, array(greatest(0D, 1 - aggregate(shares, 0D, (a, b) -> a + b))))"))
    return staged(classes.join(shares, "lang"), "references")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares of equal length."""
    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2))


def judge_quality(docs: DataFrame, references: DataFrame | None = None, *, text: str = "text", lang: str = "lang", class_limit: float = CLASS_LIMIT,
                  word_limit: float = WORD_LIMIT, slack: float = SLACK, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with struct base, class_distance, word_distance and diverges.

    Distances are null where a guard leaves the test out; ``diverges`` is then false. Columns of these
    names are replaced, all others pass through. Repeated rows stay; an empty table stays empty.
    """
    references = language_references(docs, text=text, lang=lang) if references is None else references
    refs = references.select(F.col("lang").alias("_lang"), F.col("classes").alias("_ref_classes"), F.col("words").alias("_ref_words"), F.col("shares").alias("_ref_shares"))
    rows, names = renamed(docs)
    now = {old: new for new, old in names.items()}
    rows = text_counts(rows, now[text])
    rows = rows.join(refs, F.coalesce(F.col(now[lang]).cast("string"), F.lit("")) == F.col("_lang"), "left")
    chars = F.aggregate("_base.classes", F.lit(0).cast("long"), lambda a, b: a + b)
    found = F.expr("transform(_ref_words, r -> size(_words) - size(array_remove(_words, r)))")
    known = F.col("_ref_words").isNotNull()
    rows = bound(rows, "_common", F.when(known & (F.size("_words") >= min_words), found))
    n = F.col("_base.n_words")
    shares = F.concat(F.transform("_common", lambda c: c / n), F.array(F.greatest(F.lit(0.0), 1 - F.aggregate("_common", F.lit(0.0), lambda a, b: a + b) / n)))
    class_distance = F.when(known & (chars >= min_chars), js_distance(F.transform("_base.classes", lambda c: c / chars), F.col("_ref_classes")))
    word_distance = F.when(F.col("_common").isNotNull(), js_distance(shares, F.col("_ref_shares")))
    rows = bound(rows, "_far", F.struct(class_distance.alias("classes"), word_distance.alias("words"), chars.alias("chars")))
    over = (F.col("_far.classes") > class_limit + slack * F.sqrt(F.lit(float(N_CLASSES)) / F.col("_far.chars"))) | (
        F.col("_far.words") > word_limit + slack * F.sqrt((F.size("_ref_words") + 1) / n))
    return rows.select(*restored(names, ("base", "class_distance", "word_distance", "diverges")), F.col("_base").alias("base"), F.col("_far.classes").alias("class_distance"), F.col("_far.words").alias("word_distance"), F.coalesce(over, F.lit(False)).alias("diverges"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every whole text."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = judge_quality(docs)
    failed = (F.col("base.n_words") < 50) | (100 * F.col("base.n_repeat_words") > 50 * F.col("base.n_words"))
    return judged.select("doc_id", *[f"base.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"),
                         (~failed & ~F.col("diverges")).alias("kept"), F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def _class_sql(text: str) -> str:
    rest1 = f"regexp_replace({text}, '[a-z]+', '', 'g')"
    rest2 = f"regexp_replace({rest1}, '[\\x20\\x09-\\x0D]+', '', 'g')"
    parts = [f"length({text}) - length({rest1})", f"length({rest1}) - length({rest2})"]
    parts += ["length({0}) - length(regexp_replace({0}, '{1}', '', 'g'))".format(rest2, c.replace("'", "''")) for c in OTHER_CLASSES]
    return f"[{', '.join(parts)}]"


def _js_sql(p: str, q: str) -> str:
    def half(x: str, y: str) -> str:
        return f"case when {x} > 0 then {x} * log2(2 * {x} / ({x} + {y})) else 0 end"
    a, b = f"({p})[i]", f"({q})[i]"
    return f"sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {half(a, b)} + {half(b, a)})) / 2))"


#: The same by unnested windows and grouped counts.
OP2_SQL = rf"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
c as (select *, list_append(part, length(text) - list_sum(part)) as classes from (select *, {_class_sql('text')} as part from d)),
tri as (select doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] as t from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d where len(ws) >= 3)),
often as (select doc_id, t from tri group by doc_id, t having count(*) > 1),
cov as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from tri join often using (doc_id, t)) group by doc_id),
rc as (select lang, list(n order by k) as sums, sum(n) as total from (select lang, k, sum(classes[k]) as n from (select lang, classes, unnest(range(1, {N_CLASSES} + 1)) as k from c) group by lang, k) group by lang having sum(n) > 0),
wc as (select lang, w, count(*) as n from (select lang, unnest(ws) as w from d) group by lang, w),
sz as (select lang, sum(n) as total from wc group by lang having sum(n) >= {MIN_REFERENCE}),
top as (select lang, list(w order by place) as words, list(n order by place) as ns from (select *, row_number() over (partition by lang order by n desc, w) as place from wc) where place <= {COMMON} group by lang),
ref as (select lang, list_transform(sums, lambda x: x / rc.total) as ref_classes, words, list_append(list_transform(ns, lambda x: x / sz.total), greatest(0, 1 - list_sum(ns) / sz.total)) as ref_shares
  from rc join sz using (lang) join top using (lang)),
j as (select c.*, ref_classes, ref_shares, words, length(text) as chars, len(ws) as n_words, coalesce(cov.n, 0) as n_repeat,
   list_transform(words, lambda r: len(list_filter(ws, lambda x: x = r))) as common from c left join cov using (doc_id) left join ref using (lang)),
k as (select *, case when words is not null and chars >= {MIN_CHARS} then {_js_sql('list_transform(classes, lambda x: x / chars)', 'ref_classes')} end as class_distance,
   case when words is not null and n_words >= {MIN_WORDS} then {_js_sql('list_append(list_transform(common, lambda x: x / n_words), greatest(0, 1 - list_sum(common) / n_words))', 'ref_shares')} end as word_distance from j)
select doc_id, cast(n_words as bigint) as n_words, cast(chars - classes[2] as bigint) as word_chars, cast(classes[6] as bigint) as n_symbols,
  cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(n_repeat as bigint) as n_repeat_words, n_words < 50 or 100 * n_repeat > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat > 50 * n_words) and not coalesce(class_distance > {CLASS_LIMIT} + {SLACK} * sqrt({N_CLASSES} / chars) or word_distance > {WORD_LIMIT} + {SLACK} * sqrt((len(words) + 1) / n_words), false) as kept,
  round(class_distance, 6) as class_distance, round(word_distance, 6) as word_distance
from (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from k)
"""
