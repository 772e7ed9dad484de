"""Benchmark decontamination by template windows, in DataFrame expressions only.

Texts are turned into templates: numbers, units after numbers, and names
(capitalised words inside a sentence) become typed placeholders, the rest is
lower-cased words. Windows of template words are hashed and joined with the
benchmark's. Windows that line up at one distance between document and item
form an alignment; in each, a slot's value in the item must stand for one value
in the document, so a question with other numbers or names is caught, and a
chance meeting of placeholders is not. In an alignment where one does not,
windows count that lie in a passage of ``RUN`` words or more whose raw words
equal the item's. Windows with fewer than
``LITERALS`` literal words, and items shorter than a window, are met by their
raw words (short items of literal words also as templates). A document is
contaminated by an item if the windows that count make up ``SHARE`` of the
item's, and ``LEAST`` at least (or all, if the item has fewer), be it of all
windows or of those met as templates.

Null and blank texts have no windows; an item of fewer words than a window is one
window, which is looked for at every place of a document. Items of fewer than
``OWN`` words say too little for that: they are found where their raw words are a
whole document or a line of their own. Rows without an id
take no part; repeated rows count once; empty tables give an empty result.
Columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import save

WINDOW, LITERALS, SHARE, LEAST = 8, 4, 0.1, 2
#: Words from which an item is looked for inside lines.
OWN = 4
#: Words of a verbatim passage that counts beside inconsistent slots.
RUN = 13
#: Benchmark windows, and documents with hits, that may be broadcast (at most about 40 bytes each).
BROADCAST_ROWS = 500_000
UNITS = "mm cm dm m km mg g kg t ml cl l s min h kb mb gb tb w kw v a hz khz mhz usd eur gbp percent meters metres miles feet inches pounds grams kilograms liters litres seconds minutes hours days weeks months years dollars euros degrees".split()
#: Placeholders, and what stands for a number's decimal point.
NUMBER, NAME, UNIT, POINT = "0", "@", "%", "#"


def _raw(text: Column) -> Column:
    """Text whose numbers are single tokens, apart from letters, and whose own placeholder signs are gone.

    A number is its digits and, after a point, a fraction; commas part numbers.
    """
    plain = F.translate(text, NAME + UNIT + POINT, "   ")
    numbers = F.regexp_replace(F.regexp_replace(plain, r"([0-9]+)\.([0-9]+)", rf"$1{POINT}$2"), r"([0-9])(\p{L})", "$1 $2")
    return F.when(text.rlike("[0-9]"), numbers).otherwise(plain)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}@%#]+"), "")


def _templates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, raw text, template text. Each step is a column of its own, so that none is computed twice."""
    raw = df.select(id_col, _raw(F.col(text_col)).alias("raw"))
    named = raw.select(id_col, "raw", F.regexp_replace("raw", r"([\p{Ll},;] )\p{Lu}\p{L}*", "$1@").alias("named"))
    units = F.regexp_replace(F.regexp_replace("named", r"[0-9]+(#[0-9]+)?", NUMBER), rf"(0 )(?i:{'|'.join(UNITS)})\b", "$1%")
    return named.select(id_col, "raw", F.when(F.col("named").rlike("[0-9]"), units).otherwise(F.col("named")).alias("template"))


def _both_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, words of the template, raw words; these match place by place."""
    return _templates(df, id_col, text_col).select(id_col, _words(F.col("template")).alias("words"), _words(F.col("raw")).alias("raws"))


def _hash(words: Column, exact: bool) -> Column:
    """Hash of a window; that of raw words never equals that of a template."""
    return F.xxhash64(words, F.lit(1)) if exact else F.xxhash64(words)


def _places(words: Column, length: int, exact: bool) -> Column:
    """dpos, exact, hash of each window of so many words; none if there are fewer."""
    each = F.transform(F.sequence(F.lit(1), F.size(words) - (length - 1)), lambda i: F.struct((i - 1).alias("dpos"), F.lit(exact).alias("exact"), _hash(F.slice(words, i, length), exact).alias("hash")))
    return F.when(F.size(words) >= length, each).otherwise(F.array().cast("array<struct<dpos:int,exact:boolean,hash:bigint>>"))


def _literal(word: Column) -> Column:
    return ~word.isin(NUMBER, NAME, UNIT)


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, ipos, length, exact, hash, item_windows, template_windows; exact windows are met by their raw words."""
    words = _both_words(benchmark.where(F.col(id_col).isNotNull()).withColumnRenamed(id_col, "item_id"), "item_id", text_col)
    last = F.greatest(F.size("words") - WINDOW, F.lit(0))
    at = words.select("item_id", "words", "raws", F.explode_outer(F.when(F.size("words") > 0, F.sequence(F.lit(0), last))).alias("ipos")).where("ipos is not null")
    window, raw = (F.slice(c, F.col("ipos") + 1, WINDOW) for c in ("words", "raws"))
    length = F.size(window)
    literal = F.size(F.filter(window, _literal)) >= F.least(F.lit(LITERALS), length)
    key = lambda exact, w: F.struct(F.lit(exact).alias("exact"), _hash(w, exact).alias("hash"))
    keys = F.when(~literal | (length < OWN), F.array(key(True, raw))).when(length < WINDOW, F.array(key(False, window), key(True, raw))).otherwise(F.array(key(False, window)))
    kept = at.select("item_id", "ipos", length.alias("length"), F.explode(keys).alias("key")).select("item_id", "ipos", "length", "key.exact", "key.hash").distinct()
    counts = kept.groupBy("item_id").agg(F.countDistinct("ipos").alias("item_windows"), F.countDistinct(F.when(~F.col("exact"), F.col("ipos"))).alias("template_windows"))
    return kept.join(counts, "item_id")


def _slots(df: DataFrame, id_col: str, text_col: str, place: str, value: str) -> DataFrame:
    """Words of texts that a template changes or may change: id, place, kind, value."""
    both = _both_words(df, id_col, text_col).select(id_col, F.arrays_zip(F.col("words").alias("kind"), F.col("raws").alias("value")).alias("w"))
    each = both.select(id_col, F.posexplode_outer("w").alias(place, "w"))
    return each.where(F.col("w.kind").rlike(f"[{NUMBER}{NAME}{UNIT}]")).select(id_col, place, F.col("w.kind").alias("kind"), F.col("w.value").alias(value))


#: What names an alignment.
_LINE = ("id", "item_id", "shift")


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verbatim(hits: DataFrame, edited: DataFrame) -> DataFrame:
    """Hits in passages of RUN words or more whose raw words equal the item's; edited: places whose words differ."""
    touched = edited.select(*_LINE, F.explode(F.sequence(F.col("ipos") - (WINDOW - 1), F.col("ipos"))).alias("ipos")).distinct()
    equal = hits.join(touched, [*_LINE, "ipos"], "left_anti").dropDuplicates([*_LINE, "ipos"])
    # Windows that follow one another have one difference between place and rank.
    runs = equal.withColumn("run", F.col("ipos") - F.row_number().over(Window.partitionBy(*_LINE).orderBy("ipos")))
    long = runs.groupBy(*_LINE, "run").agg(F.count("*").alias("n")).where(F.col("n") > RUN - WINDOW)
    return runs.join(long, [*_LINE, "run"], "left_semi").select(hits.columns)


def _own_lines(texts: DataFrame) -> DataFrame:
    """id, dpos, exact, hash of the raw words of whole texts and of lines, where they are fewer than OWN."""
    lines = texts.select("id", F.explode_outer(F.concat(F.split("text", r"[\r\n]+"), F.array("text"))).alias("line"))
    words = _both_words(lines, "id", "line")
    return words.where(F.size("raws").between(1, OWN - 1)).select("id", F.lit(0).alias("dpos"), F.lit(True).alias("exact"), _hash(F.col("raws"), True).alias("hash"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, item_id, n_windows, item_windows, changed_slots: one row for each document and item that contaminates it."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    wanted = save(benchmark_windows(items, "item_id", "text"), "windows")
    # An outer generator: of an inner one Spark infers a filter, which would compute all windows a second time.
    found = sorted((r.length, r.exact) for r in wanted.select("length", "exact").distinct().collect())
    kinds = [k for k in found if k[0] >= OWN] or [(WINDOW, False)]
    places = F.concat(*(_places(F.col("raws" if exact else "words"), n, exact) for n, exact in kinds))
    own = _both_words(texts, "id", "text").select("id", F.explode_outer(places).alias("at")).select("id", "at.dpos", "at.exact", "at.hash")
    shift = (F.col("dpos") - F.col("ipos")).alias("shift")
    hits = own.join(_bounded(wanted.where(F.col("length") >= OWN)), ["exact", "hash"])
    if kinds != found:
        hits = hits.unionByName(_own_lines(texts).join(_bounded(wanted.where(F.col("length") < OWN)), ["exact", "hash"]))
    hits = save(hits.select("id", "item_id", shift, "ipos", "exact", "item_windows", "template_windows").distinct(), "hits")

    found = _bounded(save(hits.select("id").distinct(), "ids"))
    islots = _slots(items, "item_id", "text", "ipos", "ivalue")
    dslots = _slots(texts.join(found, "id", "left_semi"), "id", "text", "dpos", "dvalue")
    covered = hits.where(~F.col("exact")).select("id", "item_id", "shift", F.explode(F.sequence(F.col("ipos"), F.col("ipos") + (WINDOW - 1))).alias("ipos")).distinct()
    pairs = covered.join(islots, ["item_id", "ipos"]).withColumn("dpos", F.col("ipos") + F.col("shift")).join(dslots, ["id", "dpos", "kind"])
    differs = lambda c: F.col(c) != F.col("ivalue")
    values = pairs.where(~_literal(F.col("kind"))).groupBy(*_LINE, "kind", "ivalue").agg(F.min("dvalue").alias("low"), F.max("dvalue").alias("high"))
    slots = values.groupBy(*_LINE).agg(F.max((F.col("low") != F.col("high")).cast("int")).alias("torn"), F.sum((differs("low") | differs("high")).cast("long")).alias("changed"))

    judged = save(hits.join(slots, [*_LINE], "left"), "judged")
    torn = judged.where("torn = 1")
    edited = pairs.where(differs("dvalue")).join(torn.select(*_LINE).distinct(), [*_LINE], "left_semi")
    sound = judged.where(F.coalesce("torn", F.lit(0)) == 0).unionByName(_verbatim(torn, edited))
    template = F.countDistinct(F.when(~F.col("exact"), F.col("ipos"))).alias("n_template")
    total = sound.groupBy("id", "item_id").agg(F.countDistinct("ipos").alias("n_windows"), template, F.max("item_windows").alias("item_windows"), F.max("template_windows").alias("template_windows"), F.coalesce(F.max("changed"), F.lit(0)).alias("changed_slots"))
    enough = lambda n, of: (F.col(n) > 0) & (F.col(n) >= F.greatest(F.least(F.lit(LEAST), F.col(of)), F.ceil(F.col(of) * SHARE)))
    found = total.where(enough("n_windows", "item_windows") | enough("n_template", "template_windows"))
    return found.select(F.col("id").alias(id_col), "item_id", "n_windows", "item_windows", "changed_slots")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


_SQL_RAW = r"""CASE WHEN regexp_matches(text, '[0-9]') THEN regexp_replace(regexp_replace(translate(text, '@%#', '   '), '([0-9]+)\.([0-9]+)', '\1#\2', 'g'), '([0-9])(\p{L})', '\1 \2', 'g') ELSE translate(text, '@%#', '   ') END"""
_SQL_NAMED = r"""regexp_replace(raw, '([\p{Ll},;] )\p{Lu}\p{L}*', '\1@', 'g')"""
OP9_SQL = rf"""
WITH t AS (
  SELECT true AS d, doc_id AS id, {_SQL_RAW} AS raw FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
  UNION ALL SELECT false, item_id, {_SQL_RAW} FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
c AS (SELECT d, id, raw, CASE WHEN regexp_matches(raw, '[0-9]') THEN regexp_replace(regexp_replace({_SQL_NAMED}, '[0-9]+(#[0-9]+)?', '0', 'g'), '(0 )(?i:{'|'.join(UNITS)})\b', '\1%', 'g') ELSE {_SQL_NAMED} END AS tpl FROM t),
w AS (SELECT d, id, regexp_extract_all(lower(tpl), '[\p{{L}}\p{{N}}@%#]+') AS ws, regexp_extract_all(lower(raw), '[\p{{L}}\p{{N}}@%#]+') AS rs FROM c),
g AS (SELECT DISTINCT least(len(ws), 8) AS n FROM w WHERE NOT d AND len(ws) >= 4),
p AS (SELECT d, id, n, unnest(range(0, len(ws) - n + 1)) AS pos, unnest(list_transform(range(0, len(ws) - n + 1), lambda i: ws[i + 1:i + n])) AS win,
      unnest(list_transform(range(0, len(ws) - n + 1), lambda i: rs[i + 1:i + n])) AS raws FROM w, g WHERE len(ws) >= n AND (d OR n = least(len(ws), 8))),
x AS (SELECT d, id, pos, n, win, 't ' || array_to_string(win, ' ') AS tk, 'r ' || array_to_string(raws, ' ') AS rk FROM p),
b AS (SELECT DISTINCT id AS item_id, pos AS ipos, unnest(CASE WHEN len(list_filter(win, lambda y: y NOT IN ('0', '@', '%'))) < 4 THEN [rk] WHEN n < 8 THEN [tk, rk] ELSE [tk] END) AS k FROM x WHERE NOT d
      UNION SELECT id, 0, 'l ' || array_to_string(rs, ' ') FROM w WHERE NOT d AND len(ws) BETWEEN 1 AND 3),
n AS (SELECT item_id, count(DISTINCT ipos) AS item_windows, count(DISTINCT CASE WHEN k LIKE 't %' THEN ipos END) AS template_windows FROM b GROUP BY 1),
y AS (SELECT id, regexp_extract_all(lower({_SQL_RAW}), '[\p{{L}}\p{{N}}@%#]+') AS rs
      FROM (SELECT doc_id AS id, unnest(list_append(string_split_regex(text, '[\r\n]+'), text)) AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
o AS (SELECT id, pos, tk AS k FROM x WHERE d UNION ALL SELECT id, pos, rk FROM x WHERE d UNION ALL SELECT id, 0, 'l ' || array_to_string(rs, ' ') FROM y WHERE len(rs) BETWEEN 1 AND 3),
h AS (SELECT DISTINCT o.id, b.item_id, o.pos - b.ipos AS shift, b.ipos, k LIKE 't %' AS tpl FROM o JOIN b USING (k)),
s AS (SELECT * FROM (SELECT d, id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS kind, unnest(rs) AS val FROM w) WHERE kind IN ('0', '@', '%')),
cov AS (SELECT DISTINCT id, item_id, shift, unnest(range(ipos, ipos + 8)) AS ipos FROM h WHERE tpl),
v AS (SELECT cov.id, cov.item_id, cov.shift, i.kind, i.val AS iv, min(o.val) AS low, max(o.val) AS high
      FROM cov JOIN s i ON NOT i.d AND i.id = cov.item_id AND i.pos = cov.ipos
      JOIN s o ON o.d AND o.id = cov.id AND o.pos = cov.ipos + cov.shift AND o.kind = i.kind GROUP BY 1, 2, 3, 4, 5),
a AS (SELECT id, item_id, shift, max(CAST(low <> high AS INT)) AS torn, sum(CAST(low <> iv AS INT)) AS changed FROM v GROUP BY 1, 2, 3),
r AS (SELECT h.id, h.item_id, count(DISTINCT h.ipos) AS n_windows, count(DISTINCT CASE WHEN tpl THEN h.ipos END) AS n_template, coalesce(max(a.changed), 0) AS changed_slots
      FROM h LEFT JOIN a USING (id, item_id, shift) WHERE coalesce(torn, 0) = 0 GROUP BY 1, 2)
SELECT r.id AS doc_id, r.item_id, r.n_windows, n.item_windows, CAST(r.changed_slots AS BIGINT) AS changed_slots FROM r JOIN n USING (item_id)
WHERE n_windows >= greatest(least(2, item_windows), ceil(item_windows * 0.1)) OR (n_template > 0 AND n_template >= greatest(least(2, template_windows), ceil(template_windows * 0.1)))
"""
