"""Benchmark decontamination by template canonicalisation. DataFrame operations only.

Names, numbers and units become typed placeholders, so a question with other values keeps its
template. Windows of canonical words are joined by hash with the benchmark's windows; an item is found in
a document when enough of its windows are there and, where windows hold placeholders, one value of
the item always stands for one value of the document along an alignment.

Words have three forms: with placeholders where names stand inside a sentence, with placeholders for every capitalised word, and
plain, so that a copy in capitals is found, too. A window that is the same in all forms goes once.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_SEPARATORS, Scratch, packed, table, unpacked

WINDOW = 5
COVERAGE = 0.8
#: Literal words that a window must hold to be looked for.
LITERALS = 2
#: Windows of a benchmark that are broadcast at most; beyond it both sides are shuffled by hash.
BROADCAST_WINDOWS = 200_000
#: Bare hashes of windows (some 32 bytes each) that are broadcast at most, so that only windows which may
#: be met are shuffled.
BROADCAST_HASHES = 2_000_000

NAME, NUMBER, UNIT = "", "", ""
UNITS = (
    "km m cm mm mi ft in kg g mg lb oz l ml s ms min h hours hour minutes minute seconds second days day weeks week months month "
    "years year miles mile meters meter metres metre feet inches grams gram kilograms kilogram pounds pound dollars dollar euros euro cents cent percent degrees degree"
).split()
#: A capitalised word after a word or comma on the same line; one that opens a sentence isn't a name.
_NAME = r"\p{Lu}(?<=[\p{L}\p{N},;] \p{Lu})\p{Ll}+"
#: Any capitalised word, sentence and line openers and words after quotes too.
_CAPITALISED = r"(?<![\p{L}\p{M}\p{N}])\p{Lu}\p{Ll}+"
_NUMBER = r"\p{N}+(?:[.,]\p{N}+)*"
_UNIT = rf"{NUMBER}( ?)(?:{'|'.join(UNITS)})([^\p{{L}}]|$)"
#: The usual letters come first: a class is tried in order.
_PUNCTUATION = rf"[^a-z\x20\p{{L}}\p{{M}}\p{{N}}{NAME}-{UNIT}\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, _PUNCTUATION, ""), WORD_SEPARATORS), lambda w: w != "")


def canonical_words(text: Column, name: str = _NAME) -> Column:
    """Lower-case words without punctuation, with placeholders; as many as `plain_words`."""
    named = F.regexp_replace(F.regexp_replace(text, name, NAME), _NUMBER, NUMBER)
    return _words(F.regexp_replace(F.lower(named), _UNIT, f"{NUMBER}$1{UNIT}$2"))


def plain_words(text: Column) -> Column:
    return _words(F.lower(text))


def _windows(words: Column, of) -> Column:
    """`of` each run of WINDOW words, in order; fewer words make one run, none make none."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: of(F.slice(words, i, WINDOW)))
    return F.when(n >= WINDOW, runs).when(n > 0, F.array(of(words)))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _window_hashes(words: Column) -> Column:
    """A hash for each run of WINDOW words, from their hashes in pairs: no run is made. Fewer words are one run."""
    n = F.size(words)
    both = lambda a, b: F.xxhash64(a, b)
    part = lambda x, start, size: F.slice(x, start, F.greatest(size, F.lit(0)))
    two = F.zip_with(part(words, 1, n - 1), part(words, 2, n - 1), both)
    four = F.zip_with(part(two, 1, n - 3), part(two, 3, n - 3), both)
    five = F.zip_with(part(four, 1, n - 4), part(words, WINDOW, n - 4), both)
    return F.when(n >= WINDOW, five).when(n > 0, F.array(F.xxhash64(words)))


def _run_hash(run: Column) -> Column:
    """The same for one run of words."""
    return _window_hashes(_hashes(run))[0]


def _is_slot(word: Column) -> Column:
    return word.rlike(f"[{NAME}-{UNIT}]")


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).dropDuplicates().withColumn("item_hash", F.xxhash64("text"))


#: The forms of words: how names are told in the first two; the last is plain.
_NAMED = (_NAME, _CAPITALISED)
PLAIN = len(_NAMED)


def _plain_windows(items: DataFrame) -> DataFrame:
    """(form, window, item, item_hash, at, slots) for each window of plain words of items of WINDOW words or more."""
    worded = items.withColumn("words", _hashes(plain_words(F.col("text")))).where(F.size("words") >= WINDOW)
    runs = worded.select("item", "item_hash", F.posexplode(_window_hashes(F.col("words"))).alias("at", "window"))
    return runs.select(F.lit(PLAIN).alias("form"), "window", "item", "item_hash", "at", F.lit(False).alias("slots"))


def _item_windows(items: DataFrame, name: str = _NAME, form: int = 0) -> DataFrame:
    """(form, window, item, item_hash, at, slots) for each looked-for window of each different item row."""
    runs = items.withColumn("words", canonical_words(F.col("text"), name)).select("item", "item_hash", F.posexplode(_windows(F.col("words"), lambda w: w)).alias("at", "run"))
    slots = F.size(F.filter("run", _is_slot))
    return runs.where(F.size("run") - slots >= F.least(F.lit(LITERALS), F.size("run"))).select(F.lit(form).alias("form"), _run_hash(F.col("run")).alias("window"), "item", "item_hash", "at", (slots > 0).alias("slots"))


def _plain_runs(words: Column, n: int) -> Column:
    """Hashes of every run of n words, in order; none where there are fewer."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n))))


def _short_pairs(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(id, text_hash, item, item_hash, n_matched, n_windows) of items of fewer than WINDOW words, which are one
    window and found by their words as they stand. None where there is no such item."""
    worded = items.select("item", "item_hash", plain_words(F.col("text")).alias("words"))
    asked = scratch.write(worded.where((F.size("words") > 0) & (F.size("words") < WINDOW)).select("item", "item_hash", F.size("words").alias("length"), F.xxhash64("words").alias("window")))
    lengths = {r.length: r.n for r in asked.groupBy("length").agg(F.count("*").alias("n")).collect()}  # fewer than WINDOW rows
    if not lengths:
        return None
    sized = F.broadcast(asked) if sum(lengths.values()) <= BROADCAST_WINDOWS else asked
    own = docs.select("id", F.xxhash64("text").alias("text_hash"), plain_words(F.col("text")).alias("words"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("length"), F.coalesce(F.array_distinct(_plain_runs(F.col("words"), n)), F.array()).alias("runs")) for n in sorted(lengths))))
    seen = own.select("id", "text_hash", each.alias("e")).select("id", "text_hash", "e.length", F.explode("e.runs").alias("window"))
    one = F.lit(1).cast("long")
    return seen.join(sized, ["length", "window"]).select("id", "text_hash", "item", "item_hash", one.alias("n_matched"), one.alias("n_windows")).distinct()


def _consistent(hits: DataFrame, docs: DataFrame, items: DataFrame, name: str = _NAME) -> DataFrame:
    """Of the hits those on an alignment along which each item value stands for one document value."""
    doc_words = docs.select(F.col("id").alias("_id"), F.xxhash64("text").alias("_hash"), plain_words(F.col("text")).alias("words")).dropDuplicates(["_id", "_hash"])
    item_words = items.select(F.col("item").alias("_item"), F.xxhash64("text").alias("_item_hash"), plain_words(F.col("text")).alias("asked"), canonical_words(F.col("text"), name).alias("template")).dropDuplicates(["_item", "_item_hash"])
    place = ["id", "text_hash", "item", "item_hash", "shift"]
    here = hits.join(doc_words, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).join(item_words, F.col("item").eqNullSafe(F.col("_item")) & (F.col("item_hash") == F.col("_item_hash")))
    pairs = here.select(*place, F.explode(F.sequence(F.col("at") + 1, F.least(F.col("at") + WINDOW, F.size("template")))).alias("i"), "words", "asked", "template", )
    values = pairs.select(*place, F.get("template", F.col("i") - 1).alias("slot"), F.get("asked", F.col("i") - 1).alias("asks"), F.get("words", (F.col("i") - 1 + F.col("shift")).cast("int")).alias("has"))
    torn = values.where(F.col("slot").rlike(f"[{NAME}-{UNIT}]")).groupBy(*place, "asks").agg(F.countDistinct("has").alias("n")).where("n > 1").select(*place).distinct()
    same = F.lit(True)
    for c in place:
        same = same & hits[c].eqNullSafe(torn[c])
    return hits.join(torn, same, "left_anti")


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(id, text_hash, item, n_matched, n_windows): documents that hold COVERAGE of an item's windows.

    A window is five words. Canonical windows meet in one of two forms, one in which names stand inside a sentence and one
    in which every capitalised word is a name; slots are held against each form by itself, and windows with under two
    literal words are not looked for. An item is also found by COVERAGE of its windows of plain words, all of which are
    looked for, and an item of fewer than five words by these words in a row, anywhere in a text. Where both find it, the
    greater share counts, then the one of more windows. Null and wordless texts match nothing. Repeated rows count once;
    equal texts under different items give a row for each. The private-use characters that serve as placeholders are
    read as such where a text holds them. Empty tables give no rows; other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = _items(benchmark, item_col, item_text_col)
    wanted = scratch.write(reduce(DataFrame.union, (_item_windows(items, name, k) for k, name in enumerate(_NAMED)), _plain_windows(items)))
    asked = wanted.agg(F.count("*").alias("n"), F.coalesce(F.bool_or("slots"), F.lit(False)).alias("slots")).first()
    sized = F.broadcast(wanted) if asked["n"] <= BROADCAST_WINDOWS else wanted
    # A word is hashed once, a window from its words' hashes; these are columns of their own, else each window made them anew.
    words = [*(canonical_words(F.col("text"), name) for name in _NAMED), plain_words(F.col("text"))]
    worded = own.select("id", F.xxhash64("text").alias("text_hash"), *(_hashes(w).alias(f"words{k}") for k, w in enumerate(words)))
    # Where a form changes no word its windows are the plain ones.
    plain = F.coalesce(_window_hashes(F.col(f"words{PLAIN}")), F.array())
    worded = worded.withColumn(f"runs{PLAIN}", plain)
    runs = [F.when(F.col(f"words{k}") == F.col(f"words{PLAIN}"), F.col(f"runs{PLAIN}")).otherwise(F.coalesce(_window_hashes(F.col(f"words{k}")), F.array())).alias(f"runs{k}") for k in range(PLAIN)] + [F.col(f"runs{PLAIN}")]
    # A window that is the same in all forms goes once, for all; `of` has a bit for each form.
    hashed = [F.col(f"r.runs{k}") for k in range(len(words))]
    same = reduce(and_, (h == hashed[0] for h in hashed[1:]))
    one = F.array(F.struct(F.lit((1 << len(words)) - 1).alias("of"), hashed[0].alias("window")))
    each = F.array(*(F.struct(F.lit(1 << k).alias("of"), h.alias("window")) for k, h in enumerate(hashed)))
    zipped = worded.select("id", "text_hash", *runs).select("id", "text_hash", F.posexplode(F.arrays_zip(*(f"runs{k}" for k in range(len(words))))).alias("pos", "r"))
    seen = zipped.select("id", "text_hash", "pos", F.explode(F.when(same, one).otherwise(each)).alias("w")).select("id", "text_hash", "pos", "w.of", "w.window")
    if asked["n"] > BROADCAST_WINDOWS:
        hashes = wanted.select("window").distinct()
        if hashes.count() <= BROADCAST_HASHES:
            seen = seen.join(F.broadcast(hashes), "window", "left_semi")
    place = ["id", "text_hash", "item", "item_hash", "at"]
    met = seen.join(sized, "window").where("(of & shiftleft(1, form)) != 0")
    hits = scratch.write(met.groupBy(*place, (F.col("pos") - F.col("at")).alias("shift"), "form", "slots").agg(F.count("*").alias("n")))

    def covered(found: DataFrame, form: int) -> DataFrame:
        """Of one form's windows; those of the second form stand at places of the first and hold as many literals at most."""
        got = found.groupBy("id", "text_hash", "item", "item_hash").agg(F.countDistinct("at").alias("n_matched"), F.bool_or("slots").alias("slots"))
        per = wanted.where(F.col("form") == form).groupBy(F.col("item").alias("_item"), F.col("item_hash").alias("_item_hash")).agg(F.count("*").alias("n_windows"))
        return got.join(per, F.col("item").eqNullSafe(F.col("_item")) & (F.col("item_hash") == F.col("_item_hash"))).where(F.col("n_matched") >= COVERAGE * F.col("n_windows")).drop("_item", "_item_hash")

    pairs = covered(hits.where(F.col("form") < PLAIN), 0)
    if asked["slots"]:
        pairs = scratch.write(pairs)
        doubtful = pairs.where("slots").select("id", "text_hash", "item", "item_hash")
        keys = doubtful.columns
        held = hits.where(F.col("form") < PLAIN).join(doubtful, [hits[c].eqNullSafe(doubtful[c]) for c in keys], "left_semi")
        texts = doubtful.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
        few = own.join(texts, F.col("id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_semi")
        sound = reduce(DataFrame.union, (_consistent(held.where(F.col("form") == k), few, items, name) for k, name in enumerate(_NAMED)))
        pairs = pairs.where("not slots").union(covered(sound, 0))
    names = ["id", "text_hash", "item", "item_hash", "n_matched", "n_windows"]
    pairs = pairs.select(names).union(covered(hits.where(F.col("form") == PLAIN), PLAIN).select(names))
    short = _short_pairs(own, items, scratch)
    pairs = pairs if short is None else pairs.union(short)
    best = F.max(F.struct((F.col("n_matched") / F.col("n_windows")).alias("share"), "n_windows", "n_matched")).alias("m")
    found = pairs.groupBy("id", "text_hash", "item", "item_hash").agg(best)
    return found.select(F.col("id").alias(id_col), "text_hash", F.col("item").alias(item_col), "m.n_matched", "m.n_windows")


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "n_matched", "n_windows", (F.col("n_matched") / F.col("n_windows")).alias("coverage")).distinct()


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows whose document holds no benchmark item stay.

    Null and wordless texts stay. Rows of one id are judged each by its text; repeated rows stay or go
    together. An empty table or benchmark takes nothing away.
    """
    scratch = Scratch(spark)
    bad = scratch.write(contaminated_pairs(docs, table(spark, sf_dir, "benchmark"), scratch=scratch).select("doc_id", "text_hash").distinct())
    own = packed(docs, doc=F.col("doc_id"), own_hash=F.xxhash64("text"))
    return unpacked(own.join(bad, own["doc"].eqNullSafe(bad["doc_id"]) & (own["own_hash"] == bad["text_hash"]), "left_anti"))


_SQL_CLEAN = rf"list_filter(string_split_regex(regexp_replace({{}}, '[^\p{{{{L}}}}\p{{{{M}}}}\p{{{{N}}}}{NAME}-{UNIT}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
OP9_SQL = rf"""
WITH source AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT DISTINCT 'b', item_id, text FROM benchmark WHERE text IS NOT NULL
), spaced AS (SELECT side, id, text, string_split(text, ' ') AS e FROM source),
named AS (
  SELECT side, 0 AS form, id, array_to_string(list_transform(range(1, len(e) + 1), lambda i: CASE
    WHEN i > 1 AND regexp_matches(e[i], '^\p{{Lu}}\p{{Ll}}+') AND regexp_matches(e[i - 1], '[\p{{L}}\p{{N}},;]$') THEN regexp_replace(e[i], '^\p{{Lu}}\p{{Ll}}+', '{NAME}') ELSE e[i] END), ' ') AS t FROM spaced
  UNION ALL SELECT side, 1, id, regexp_replace(text, '(^|[^\p{{L}}\p{{M}}\p{{N}}])\p{{Lu}}\p{{Ll}}+', '\1{NAME}', 'g') FROM source
), plain AS (SELECT side, id, {_SQL_CLEAN.format("lower(text)")} AS w FROM source),
canonical AS (
  SELECT side, form, id, {_SQL_CLEAN.format(f"regexp_replace(lower(regexp_replace(t, '{_NUMBER}', '{NUMBER}', 'g')), '{_UNIT}', '{NUMBER}" + chr(92) + f"1{UNIT}" + chr(92) + "2', 'g')")} AS w FROM named
  UNION ALL SELECT side, {PLAIN}, id, w FROM plain
), windows AS (
  SELECT side, form, id, spot, CASE WHEN len(w) >= {WINDOW} THEN w[spot:spot + {WINDOW - 1}] ELSE w END AS run
  FROM (SELECT side, form, id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 2))) AS spot FROM canonical WHERE len(w) > 0)
), wanted AS (
  SELECT form, id AS item_id, spot, run, CASE WHEN form < {PLAIN} THEN len(list_filter(run, lambda w: regexp_matches(w, '[{NAME}-{UNIT}]'))) ELSE 0 END AS slots
  FROM windows WHERE side = 'b' AND CASE WHEN form = {PLAIN} THEN len(run) = {WINDOW} ELSE len(list_filter(run, lambda w: NOT regexp_matches(w, '[{NAME}-{UNIT}]'))) >= least({LITERALS}, len(run)) END
), hit AS (SELECT DISTINCT b.form, d.id AS doc_id, b.item_id, b.spot, d.spot - b.spot AS shift, b.slots > 0 AS slots FROM windows d JOIN wanted b ON d.run = b.run AND d.form = b.form WHERE d.side = 'd'),
total AS (SELECT form, item_id, count(*) AS n_windows FROM wanted GROUP BY ALL),
pair AS (SELECT doc_id, item_id, n_matched, n_windows, doubtful FROM (SELECT doc_id, item_id, count(DISTINCT spot) AS n_matched, bool_or(slots) AS doubtful FROM hit WHERE form < {PLAIN} GROUP BY ALL) JOIN total USING (item_id) WHERE form = 0 AND n_matched >= {COVERAGE} * n_windows),
held AS (SELECT hit.* FROM hit JOIN pair USING (doc_id, item_id) WHERE doubtful AND form < {PLAIN}),
cell AS (SELECT DISTINCT form, doc_id, item_id, shift, spot + k AS i FROM held CROSS JOIN range({WINDOW}) r(k)),
-- Along an alignment a value of the item stands for one value of the document.
torn AS (SELECT DISTINCT form, doc_id, item_id, shift FROM (
  SELECT c.form, c.doc_id, c.item_id, c.shift, a.w[c.i] AS asks, d.w[c.i + c.shift] AS has FROM cell c JOIN canonical b ON b.side = 'b' AND b.form = c.form AND b.id = c.item_id
  JOIN plain a ON a.side = 'b' AND a.id = c.item_id JOIN plain d ON d.side = 'd' AND d.id = c.doc_id
  WHERE c.i <= len(b.w) AND regexp_matches(b.w[c.i], '[{NAME}-{UNIT}]')) GROUP BY form, doc_id, item_id, shift, asks HAVING count(DISTINCT has) > 1),
sound AS (SELECT doc_id, item_id, count(DISTINCT spot) AS n_matched FROM held ANTI JOIN torn USING (form, doc_id, item_id, shift) GROUP BY ALL),
as_it_stands AS (SELECT doc_id, item_id, count(DISTINCT spot) AS n_matched FROM hit WHERE form = {PLAIN} GROUP BY ALL),
short AS (SELECT id AS item_id, w FROM plain WHERE side = 'b' AND len(w) BETWEEN 1 AND {WINDOW - 1}),
found AS (
  SELECT doc_id, item_id, n_matched, n_windows FROM pair WHERE NOT doubtful
  UNION ALL SELECT doc_id, item_id, n_matched, n_windows FROM sound JOIN total USING (item_id) WHERE form = 0 AND n_matched >= {COVERAGE} * n_windows
  UNION ALL SELECT doc_id, item_id, n_matched, n_windows FROM as_it_stands JOIN total USING (item_id) WHERE form = {PLAIN} AND n_matched >= {COVERAGE} * n_windows
  UNION ALL SELECT d.id, s.item_id, 1, 1 FROM short s JOIN plain d ON d.side = 'd' AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(s.w, ' ') || ' '))
SELECT doc_id, item_id, n_matched, n_windows, n_matched / n_windows AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched / n_windows DESC, n_windows DESC) AS k FROM found) WHERE k = 1
"""
