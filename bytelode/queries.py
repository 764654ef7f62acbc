"""The registered queries of the search engine, over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bytes import fnv1a64
from .functions.sql import register
from .operators import cache, querylog, search
from .operators.index import build_corpus_index, build_index, bwt_counts, c_table, index_info, suffix_array, suffix_table, text_c_table
from .operators.rank import bit_ranks, byte_access, byte_histogram, byte_rank, byte_ranks
from .operators.rollup import MINUTE, MetricRollup
from .operators.signatures import sign_texts
from .operators.timeseries import SeriesStore
from .session import Scratch
from .sources.blocks import BlockTexts, cut_texts, join_chunks
from .sources.corpus import compress_text, from_compressed, read_table
from .streaming.incremental import IncrementalCorpus

PATTERNS = ["the", "é", "tion", "onon", "anan", "\n", "zzzzz", ""]
CORPUS = ["the", "e", "", "zzzzz", "tion", " the and", "I would like"]
INDEXED = ["the", "on", "tion", " in", ".", "zzzzz", "", "the oned"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "benchmark")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark(spark, sf_dir).select("item_id", "text")


def _folder(spark: SparkSession) -> str:
    """A folder that goes with the driver, or with the scope it is made in."""
    return f"{Scratch(spark).root}/stored"


def contamination_pairs(spark, sf_dir):
    return search.contains(_documents(spark, sf_dir), _items(spark, sf_dir)).select("doc_id", F.col("pattern_id").alias("item_id"))


def docs_with_any(spark, sf_dir):
    return search.contains(_documents(spark, sf_dir), _items(spark, sf_dir), how="semi").select("doc_id", "lang")


def docs_with_none(spark, sf_dir):
    return search.contains(_documents(spark, sf_dir), _items(spark, sf_dir), how="anti").select("doc_id", "lang")


def count_by_document(spark, sf_dir):
    return search.count(_documents(spark, sf_dir), PATTERNS)


def count_many_patterns(spark, sf_dir):
    return search.count(_documents(spark, sf_dir), _items(spark, sf_dir)).select("doc_id", F.col("pattern_id").alias("item_id"), "n_matches")


def count_by_lang(spark, sf_dir):
    return search.total_counts(_documents(spark, sf_dir), PATTERNS, by=["lang"])


def count_ci(spark, sf_dir):
    return search.count(_documents(spark, sf_dir), ["THE", "É", "tION"], ci=True)


def contains_ci(spark, sf_dir):
    return search.contains(_documents(spark, sf_dir), ["THE ", "é", "zz"], ci=True)


def locate_positions(spark, sf_dir):
    return search.locate(_documents(spark, sf_dir), ["tion", "é"])


def locate_ci(spark, sf_dir):
    return search.locate(_documents(spark, sf_dir), ["TION"], ci=True)


def locate_arrays(spark, sf_dir):
    found = search.locate_all(_documents(spark, sf_dir), ["tion", "é"])
    return found.select("doc_id", "pattern_id", F.size("positions").cast("long").alias("n"), F.array_join("positions", ",").alias("positions"))


def text_length(spark, sf_dir):
    return search.text_lengths(_documents(spark, sf_dir))


def index_sizes(spark, sf_dir):
    return index_info(_documents(spark, sf_dir), 4)


def suffix_arrays(spark, sf_dir):
    """Of every document: as many rows as the texts have bytes."""
    return suffix_array(_documents(spark, sf_dir))


def suffix_array_items(spark, sf_dir):
    return suffix_array(_benchmark(spark, sf_dir), "item_id")


def _item_suffixes(spark, sf_dir):
    return suffix_table(_benchmark(spark, sf_dir), "item_id")


def bwt_items(spark, sf_dir):
    return _item_suffixes(spark, sf_dir).select("item_id", "sa_rank", "bwt_byte")


def c_table_items(spark, sf_dir):
    return c_table(_item_suffixes(spark, sf_dir), "item_id")


def _item_index(spark, sf_dir):
    return build_index(_benchmark(spark, sf_dir), _folder(spark), id_col="item_id")


def search_range_items(spark, sf_dir):
    return _item_index(spark, sf_dir).search_range(INDEXED, absent=True)


def locate_suffix_order_items(spark, sf_dir):
    return _item_index(spark, sf_dir).locate(INDEXED)


def locate_first_items(spark, sf_dir):
    return _item_index(spark, sf_dir).locate(["on", "the"], first=3)


def count_ci_index_items(spark, sf_dir):
    return build_index(_benchmark(spark, sf_dir), _folder(spark), id_col="item_id", ci=True).count(["THE", "tIoN "])


def _document_index(spark, sf_dir, ci=False):
    return build_index(_documents(spark, sf_dir), _folder(spark), ci=ci)


def search_range_documents(spark, sf_dir):
    """From the stored index over all documents; texts without a pattern have no row for it."""
    return _document_index(spark, sf_dir).search_range(INDEXED)


def locate_first_documents(spark, sf_dir):
    return _document_index(spark, sf_dir).locate(["onon", "tion th"], first=3).select("doc_id", "pattern_id", "pos")


def count_index_table_documents(spark, sf_dir):
    """The index asked for a table of patterns: the benchmark's different words of six and of nine letters, which name themselves."""
    words = _benchmark(spark, sf_dir).select(F.explode(F.split("text", "[^a-zA-Z]+")).alias("word")).where("length(word) in (6, 9)").distinct()
    found = _document_index(spark, sf_dir).count(words.select("word", F.col("word").alias("pattern")))
    return found.withColumnRenamed("pattern_id", "word")


def count_ci_index_documents(spark, sf_dir):
    return _document_index(spark, sf_dir, ci=True).count(["THE", "tIoN "])


def bwt_counts_documents(spark, sf_dir):
    """How often each byte is in the BWT of each document."""
    return bwt_counts(_documents(spark, sf_dir))


def c_table_documents(spark, sf_dir):
    return text_c_table(_documents(spark, sf_dir))


def byte_ranks_documents(spark, sf_dir):
    return byte_ranks(_documents(spark, sf_dir))


def byte_access_documents(spark, sf_dir):
    """Bytes at the start, the middle and beyond the end, and how many e's precede the middle."""
    text, middle = F.col("text"), F.floor(F.octet_length("text") / 2)
    return _documents(spark, sf_dir).select("doc_id", byte_access(text, 0).alias("first"), byte_access(text, middle).alias("middle"), byte_access(text, F.octet_length("text")).alias("beyond"), byte_rank(text, ord("e"), middle).alias("e_before"))


def count_letter_fours(spark, sf_dir):
    """A table of 456,976 patterns: all strings of four lower-case letters, each named by its number."""
    letters = [F.char(97 + F.expr(f"id div {26**k} % 26")) for k in (3, 2, 1, 0)]
    fours = spark.range(26**4).select("id", F.concat(*letters).alias("pattern"))
    return search.total_counts(_documents(spark, sf_dir), fours)


def count_named_patterns(spark, sf_dir):
    """Patterns from a table whose ids are texts."""
    names = read_table(spark, sf_dir, "region").select(F.concat(F.lit("r "), "r_name").alias("name"), F.lower(F.substring("r_name", 1, 3)).alias("pattern"))
    return search.count(_documents(spark, sf_dir), names).withColumnRenamed("pattern_id", "name")


def byte_ranks_items(spark, sf_dir):
    return byte_ranks(_benchmark(spark, sf_dir), "item_id")


def byte_histogram_by_lang(spark, sf_dir):
    return byte_histogram(_documents(spark, sf_dir), ["lang"])


def bit_ranks_events(spark, sf_dir):
    """Ranks over one long bit vector: whether an event's value is over 50, by event."""
    bits = read_table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), (F.col("value") > 50).alias("bit"))
    return bit_ranks(bits)


def page_hits(spark, sf_dir):
    return search.count(read_table(spark, sf_dir, "pages"), ["<p>", "</a>", "href", "é"], id_col="page_id", text_col="html")


def conversation_hits(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations").withColumn("key", F.struct("conv_id", "turn"))
    found = search.count(turns, ["the", "in", "."], id_col="key")
    return found.select("key.conv_id", "key.turn", "pattern_id", "n_matches")


def incremental_snapshot(spark, sf_dir):
    """Conversations as texts that grow by turns; matches span turns."""
    corpus = IncrementalCorpus(spark, _folder(spark))
    corpus.append(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    corpus.rebuild()
    return corpus.count(["the", ".", "?", "tion"])


def signature_contains_documents(spark, sf_dir):
    """Rare patterns from a stored table whose blocks have signatures: few blocks are read."""
    signed = sign_texts(_documents(spark, sf_dir), _folder(spark), texts=100)
    return signed.contains(["zzzzz", "ntntnt", "this very passage", "onon the"])


def _blocks(spark, sf_dir):
    """Documents cut into blocks so small that most texts have several."""
    return BlockTexts(cut_texts(_documents(spark, sf_dir), size=1000), 1000)


def block_counts_documents(spark, sf_dir):
    return _blocks(spark, sf_dir).count(PATTERNS).withColumnRenamed("id", "doc_id")


def block_locate_documents(spark, sf_dir):
    return _blocks(spark, sf_dir).locate(["tion", "é"]).withColumnRenamed("id", "doc_id")


def block_contains_documents(spark, sf_dir):
    """Which benchmark passages, a table of patterns longer than some blocks, texts in blocks hold."""
    found = _blocks(spark, sf_dir).contains(_items(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.col("pattern_id").alias("item_id"))


def chunk_counts_conversations(spark, sf_dir):
    """Conversations as texts that come in chunks, never joined to more than a block."""
    blocks = join_chunks(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", size=64)
    return BlockTexts(blocks, 64).count(["the", ".", "?", "tion"]).withColumnRenamed("id", "doc_id")


def corpus_range_conversations(spark, sf_dir):
    """One suffix order of all conversations: the ranks and, as their number, the matches of patterns in the whole corpus."""
    blocks = join_chunks(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", size=4096)
    return build_corpus_index(blocks, _folder(spark), 4096).search_range(CORPUS)


def stream_counts_conversations(spark, sf_dir):
    """Matches in conversations as their turns come, in two runs of a stream that goes on from its checkpoint."""
    turns, root = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), _folder(spark)
    corpus, schema = IncrementalCorpus(spark, f"{root}/corpus"), turns.schema
    for some in (F.col("turn") < 2, F.col("turn") >= 2):
        turns.where(some).write.mode("append").parquet(f"{root}/arrived")
        stream = spark.readStream.schema(schema).parquet(f"{root}/arrived")
        corpus.search_stream(stream, ["the", ".", "?", "tion"], f"{root}/checkpoint", id_col="conv_id", seq_col="turn", chunk_col="text").awaitTermination()
    return corpus.found().groupBy("doc_id", "pattern_id").agg(F.count("*").alias("n_matches"))


def rebuild_after_append(spark, sf_dir):
    """Conversations whose later turns come after the first snapshot: the second one writes only what they touch."""
    turns, corpus = read_table(spark, sf_dir, "conversations"), IncrementalCorpus(spark, _folder(spark))
    corpus.append(turns.where("turn < 3"), "conv_id", "turn", "text")
    corpus.rebuild()
    corpus.append(turns.where("turn >= 3"), "conv_id", "turn", "text")
    corpus.rebuild()
    return corpus.count(["the", ".", "?", "tion"])


def codec_counts(spark, sf_dir):
    packed = compress_text(_documents(spark, sf_dir)).select("doc_id", "data")
    return search.count(from_compressed(packed), ["tion"])


def codec_locate(spark, sf_dir):
    packed = compress_text(_documents(spark, sf_dir)).select("doc_id", "data")
    return search.locate(from_compressed(packed), ["tion", "é"])


def codec_docs_with_any(spark, sf_dir):
    packed = compress_text(_documents(spark, sf_dir)).select("doc_id", "lang", "data")
    return search.contains(from_compressed(packed), _items(spark, sf_dir), how="semi").select("doc_id", "lang")


def codec_lengths(spark, sf_dir):
    packed = compress_text(_documents(spark, sf_dir)).select("doc_id", "data")
    return search.text_lengths(from_compressed(packed))


def incremental_state(spark, sf_dir):
    """What a growing corpus says of itself: after an append, after a rebuild, after clearing."""
    corpus = IncrementalCorpus(spark, _folder(spark))
    corpus.append(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    states = [("appended", corpus.buffer_len(), corpus.is_built(), corpus.snapshot().count())]
    corpus.rebuild()
    states.append(("rebuilt", corpus.buffer_len(), corpus.is_built(), corpus.snapshot().count()))
    corpus.clear()
    states.append(("cleared", corpus.buffer_len(), corpus.is_built(), corpus.snapshot().count()))
    return spark.createDataFrame(states, "state string, buffer_len long, is_built boolean, texts long")


def sql_locate(spark, sf_dir):
    """Places as the SQL functions give them: self-overlapping, folded and absent patterns, a row a place."""
    register(spark)
    found = _documents(spark, sf_dir).selectExpr("doc_id", "bytes_locate(text, 'onon') AS a", "bytes_locate_ci(text, 'É Tion') AS b", "bytes_locate(text, 'tion') AS c")
    return found.selectExpr("doc_id", "stack(3, 0L, a, 1L, b, 2L, c) AS (pattern_id, places)").selectExpr("doc_id", "pattern_id", "explode(places) AS pos")


def sql_functions(spark, sf_dir):
    register(spark)
    docs = _documents(spark, sf_dir)
    return docs.selectExpr("doc_id", "bytes_count(text, 'tion') AS n", "bytes_count_ci(text, 'THE ') AS n_ci", "bytes_contains(text, 'é') AS has", "bytes_index_size(text, 4) AS size", "bytes_text_len(text) AS len")


def fnv_hashes(spark, sf_dir):
    return _benchmark(spark, sf_dir).select("item_id", fnv1a64(F.col("text")).alias("hash"))


def _log(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    return events.select(F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("ts_ms"), F.col("event_type").alias("pattern"), (F.col("user_id") % 7).alias("result_count"), F.col("value").alias("latency_us"), "event_id")


def _rolled_up(spark, sf_dir):
    """A roll-up of all events, and the middle half of their time in whole minutes."""
    log, store = _log(spark, sf_dir), MetricRollup(spark, _folder(spark))
    store.add(log)
    ends = log.agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b")).first()
    quarter = (ends["b"] - ends["a"]) // 4
    return store, ends["a"] + quarter, ends["b"] - quarter


def rollup_summary(spark, sf_dir):
    store, start, end = _rolled_up(spark, sf_dir)
    return store.summary(start, end)


def rollup_quantiles(spark, sf_dir):
    store, start, end = _rolled_up(spark, sf_dir)
    return store.quantiles(start, end, [0.5, 0.99])


def rollup_frequency(spark, sf_dir):
    store, start, end = _rolled_up(spark, sf_dir)
    return store.frequency(start, end, _log(spark, sf_dir).select("pattern").distinct())


def stream_metrics_minutes(spark, sf_dir):
    """Queries by minute from events that come as a stream; the last ten minutes are still open."""
    root, events = _folder(spark), read_table(spark, sf_dir, "events")
    _log(spark, sf_dir).write.parquet(f"{root}/arrived")
    store, schema = MetricRollup(spark, f"{root}/rollup"), spark.read.parquet(f"{root}/arrived").schema
    store.add_stream(spark.readStream.schema(schema).parquet(f"{root}/arrived"), f"{root}/checkpoint").awaitTermination()
    ends = events.agg(F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', min(ts))").alias("a"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', max(ts))").alias("b")).first()
    found = spark.read.parquet(f"{root}/rollup").where(f"level = 0 and kind = 0 and start_ms between {ends['a'] - MINUTE} and {ends['b']}")
    return found.groupBy("start_ms").agg(F.sum("n").alias("n"))


def query_log_total(spark, sf_dir):
    return querylog.total(_log(spark, sf_dir))


def query_log_unique_exact(spark, sf_dir):
    return querylog.unique(_log(spark, sf_dir), lg_k=None)


def query_log_unique_sketch(spark, sf_dir):
    return querylog.unique(_log(spark, sf_dir))


def query_log_frequency(spark, sf_dir):
    return querylog.frequency(_log(spark, sf_dir))


def query_log_frequency_sketch(spark, sf_dir):
    log = _log(spark, sf_dir)
    return querylog.estimated_frequency(querylog.count_min(log), log.select("pattern").distinct().union(spark.range(1).select(F.lit("never seen"))))


def query_log_quantiles_exact(spark, sf_dir):
    return querylog.exact_quantiles(_log(spark, sf_dir), [0.5, 0.99])


def query_log_quantiles_sketch(spark, sf_dir):
    return querylog.quantiles(_log(spark, sf_dir), [0.5, 0.99])


def query_log_empty(spark, sf_dir):
    """Each metric of a log without a query."""
    log = _log(spark, sf_dir).where("false")
    seen = querylog.estimated_frequency(querylog.count_min(log), spark.range(1).select(F.lit("click").alias("pattern"))).select(F.col("n").alias("value"))
    parts = {"total": querylog.total(log), "unique": querylog.unique(log), "unique_exact": querylog.unique(log, lg_k=None), "frequency": seen, "hit_rate": cache.hit_rate(log).select("hit_rate"), "p50": querylog.exact_quantiles(log, [0.5])}
    parts["sketched"] = querylog.quantiles(log, [0.5]).agg(F.count("*").alias("n"))
    return reduce(DataFrame.union, (df.select(F.lit(name).alias("metric"), F.col(df.columns[0]).cast("double").alias("value")) for name, df in parts.items()))


def query_log_latency_scan(spark, sf_dir):
    log = _log(spark, sf_dir)
    store = querylog.MetricsStore(spark, _folder(spark))
    store.record(log)
    ends = log.agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b")).first()
    return store.latency(ends["a"] + (ends["b"] - ends["a"]) // 4, ends["b"])


def query_log_scan(spark, sf_dir):
    log = _log(spark, sf_dir)
    store = querylog.MetricsStore(spark, _folder(spark))
    store.record(log)
    ends = log.agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b")).first()
    return store.results(ends["a"], ends["a"] + (ends["b"] - ends["a"]) // 2)


def series_scan_events(spark, sf_dir):
    """Event types as series, from three writes that are compacted and a late one: the middle half of the time of two of them."""
    log, store = _log(spark, sf_dir), SeriesStore(spark, _folder(spark))
    points = log.select(F.col("pattern").alias("series"), "ts_ms", F.col("latency_us").alias("value"), "event_id")
    for k in range(3):
        store.record(points.where(F.col("event_id") % 4 == k))
    store.compact()
    store.record(points.where(F.col("event_id") % 4 == 3))
    ends = log.agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b")).first()
    quarter = (ends["b"] - ends["a"]) // 4
    return store.points(["click", "view"], ends["a"] + quarter, ends["b"] - quarter)


def cache_results(spark, sf_dir):
    """Each pattern's last result: the events are puts whose position is the event's own id."""
    puts = _log(spark, sf_dir).select(F.col("event_id").alias("seq"), "pattern", F.array("event_id").alias("positions"))
    kept = cache.entries(puts)
    asked = spark.createDataFrame([("click",), ("view",), ("purchase",), ("never",)], "pattern string")
    return cache.get(kept, asked).select("pattern", F.col("positions")[0].alias("position"), F.col("count").alias("n"))


def cache_hit_rate(spark, sf_dir):
    return cache.hit_rate(_log(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        contamination_pairs, docs_with_any, docs_with_none, count_by_document, count_many_patterns, count_by_lang, count_ci, contains_ci,
        locate_positions, locate_ci, locate_arrays, text_length, index_sizes, suffix_arrays, suffix_array_items, bwt_items, c_table_items,
        search_range_items, locate_suffix_order_items, locate_first_items, count_ci_index_items, byte_ranks_items, byte_histogram_by_lang, bit_ranks_events,
        page_hits, conversation_hits, incremental_snapshot, codec_counts, sql_functions, fnv_hashes, query_log_total, query_log_unique_exact,
        query_log_unique_sketch, query_log_frequency, query_log_frequency_sketch, query_log_quantiles_exact, query_log_quantiles_sketch,
        query_log_scan, cache_results, cache_hit_rate, search_range_documents, locate_first_documents, count_index_table_documents,
        count_ci_index_documents, bwt_counts_documents, c_table_documents, byte_ranks_documents, byte_access_documents, count_letter_fours,
        count_named_patterns, codec_locate, codec_docs_with_any, codec_lengths, incremental_state, block_counts_documents, block_locate_documents,
        block_contains_documents, chunk_counts_conversations, corpus_range_conversations, stream_counts_conversations, rebuild_after_append, rollup_summary, rollup_quantiles,
        rollup_frequency, stream_metrics_minutes, signature_contains_documents, sql_locate, query_log_empty, query_log_latency_scan, series_scan_events,
    )
}


def _quote(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _plain_count(text: str, pattern: str) -> str:
    """Overlapping occurrences of a pattern; those of a letter pair twice are counted by runs."""
    if not pattern:
        return f"strlen({text}) + 1"
    if pattern in ("onon", "anan"):
        return f"coalesce(list_sum(list_transform(regexp_extract_all({text}, '(?:{pattern[:2]}){{2,}}'), lambda m: length(m) // 2 - 1)), 0)"
    return f"len(string_split({text}, {_quote(pattern)})) - 1"


def _counts_sql(table: str, key: str, text: str, patterns: list[str], ci: bool = False) -> str:
    fold = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    lower = lambda p: "".join(c.lower() if c.isascii() else c for c in p)
    each = [f"SELECT {key}, {i}::BIGINT AS pattern_id, ({_plain_count(fold(text) if ci else text, lower(p) if ci else p)})::BIGINT AS n_matches FROM {table}" for i, p in enumerate(patterns)]
    return f"SELECT * FROM ({' UNION ALL '.join(each)}) WHERE n_matches > 0"


def _places_sql(pattern_id: int, pattern: str, text: str = "text") -> str:
    return f"""SELECT doc_id, {pattern_id}::BIGINT AS pattern_id, (sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY k) + (k - 1) * strlen({_quote(pattern)}))::BIGINT AS pos, k, n
      FROM (SELECT doc_id, unnest(string_split({text}, {_quote(pattern)})) AS piece, generate_subscripts(string_split({text}, {_quote(pattern)}), 1) AS k, len(string_split({text}, {_quote(pattern)})) AS n FROM documents)"""


def _hits_sql(pattern: str) -> str:
    """(doc_id, h, pos): each place of a pattern, overlapping ones too, and the text in hexadecimal."""
    size = 2 * len(pattern.encode())
    return f"""SELECT doc_id, h, 256 * b + pos AS pos FROM (SELECT doc_id, h, b, unnest(list_filter(range(0, 256), lambda k: substring(piece, 2 * k + 1, {size}) = hex(encode({_quote(pattern)})))) AS pos
      FROM (SELECT doc_id, h, b, substring(h, 512 * b + 1, {510 + size}) AS piece FROM (SELECT doc_id, h, unnest(range(0, length(h) // 512 + 1)) AS b FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE contains(text, {_quote(pattern)})))))"""


_PLACES = f"SELECT doc_id, pattern_id, pos FROM ({_places_sql(0, 'tion')} UNION ALL {_places_sql(1, 'é')}) WHERE k < n"
#: Cut into pieces first: a place in a long string takes long to reach.
_BYTES = """SELECT {key}, ('0x' || substring(piece, 2 * k + 1, 2))::INTEGER AS byte, 256 * p + k AS idx FROM (SELECT {key}, p, piece, unnest(range(0, length(piece) // 2)) AS k
  FROM (SELECT {key}, p, substring(h, 512 * p + 1, 512) AS piece FROM (SELECT {key}, h, unnest(range(0, length(h) // 512 + 1)) AS p FROM (SELECT {key}, hex(encode(text)) AS h FROM {table}))))"""
#: Suffixes as hexadecimal text: its order is that of the bytes.
_SUFFIXES = """item AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark),
suffix AS (SELECT item_id, unnest(range(0, length(h) // 2 + 1)) AS pos, h FROM item),
ranked AS (SELECT item_id, pos, h, row_number() OVER (PARTITION BY item_id ORDER BY substring(h, 2 * pos + 1)) - 1 AS sa_rank FROM suffix)"""
_ASKED = ", ".join(f"({i}, hex(encode({_quote(p)})))" for i, p in enumerate(INDEXED))
_HITS = f"WITH {_SUFFIXES}, asked(pattern_id, p) AS (VALUES {_ASKED}), hit AS (SELECT r.item_id, a.pattern_id::BIGINT AS pattern_id, r.sa_rank, r.pos FROM ranked r JOIN asked a ON starts_with(substring(r.h, 2 * r.pos + 1), a.p))"
_HALF = "SELECT epoch_us(ts) // 1000 AS ts_ms, (user_id % 7)::FLOAT AS value, min(epoch_us(ts) // 1000) OVER () AS a, max(epoch_us(ts) // 1000) OVER () AS b FROM events"

#: Events with whether they lie in the middle half of all time, in whole minutes.
_TIMED = """SELECT event_type, value, ms >= (a + (b - a) // 4) // 60000 * 60000 AND ms < (b - (b - a) // 4) // 60000 * 60000 AS inside
  FROM (SELECT event_type, value, epoch_us(ts) // 1000 AS ms, min(epoch_us(ts) // 1000) OVER () AS a, max(epoch_us(ts) // 1000) OVER () AS b FROM events)"""
_MIDDLE = f"SELECT * FROM ({_TIMED}) WHERE inside"
_CORPUS_ASKED = ", ".join(f"({i}, hex(encode({_quote(p)})))" for i, p in enumerate(CORPUS))
ORACLES = {
    "contamination_pairs": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "docs_with_any": "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))",
    "docs_with_none": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))",
    "count_by_document": _counts_sql("documents", "doc_id", "text", PATTERNS),
    "count_many_patterns": "SELECT doc_id, item_id, (len(string_split(d.text, b.text)) - 1)::BIGINT AS n_matches FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "count_by_lang": f"SELECT lang, pattern_id, sum(n_matches)::BIGINT AS n_matches FROM ({_counts_sql('documents', 'lang', 'text', PATTERNS)}) GROUP BY ALL",
    "count_ci": _counts_sql("documents", "doc_id", "text", ["THE", "É", "tION"], True),
    "contains_ci": f"SELECT doc_id, pattern_id FROM ({_counts_sql('documents', 'doc_id', 'text', ['THE ', 'é', 'zz'], True)})",
    "locate_positions": _PLACES,
    "locate_ci": "SELECT doc_id, pattern_id, pos FROM (" + _places_sql(0, "tion", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')") + ") WHERE k < n",
    "locate_arrays": f"SELECT doc_id, pattern_id, count(*) AS n, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM ({_PLACES}) GROUP BY ALL",
    "text_length": "SELECT doc_id, strlen(text)::BIGINT AS text_len FROM documents",
    "index_sizes": """SELECT doc_id, n AS text_len, 4::BIGINT AS sample_step, n // 4 + 1 AS n_samples, s AS size_bytes, CASE WHEN n = 0 THEN 0 ELSE s * (1.0::DOUBLE / n) END AS compression_ratio
      FROM (SELECT doc_id, n, ((n + 1) * 9 // 8) * 8 + 2048 + ((n + 1) // 512 + 1) * 72 + (n // 4 + 1) * 8 AS s FROM (SELECT doc_id, strlen(text)::BIGINT AS n FROM documents))""",
    "suffix_array_items": f"WITH {_SUFFIXES} SELECT item_id, sa_rank, pos FROM ranked",
    "bwt_items": f"WITH {_SUFFIXES} SELECT item_id, sa_rank, CASE WHEN pos > 0 THEN ('0x' || substring(h, 2 * pos - 1, 2))::INTEGER END AS bwt_byte FROM ranked",
    "c_table_items": f"""WITH b AS (SELECT item_id, byte FROM ({_BYTES.format(key='item_id', table='benchmark')}) UNION ALL SELECT item_id, 0 FROM benchmark)
      SELECT i.item_id, r.byte::INTEGER AS byte, (SELECT count(*) FROM b WHERE b.item_id = i.item_id AND b.byte < r.byte) AS c FROM benchmark i, range(256) r(byte)""",
    "search_range_items": f"{_HITS} SELECT i.item_id, a.pattern_id::BIGINT AS pattern_id, coalesce(min(sa_rank), 0)::BIGINT AS sp, coalesce(max(sa_rank) + 1, 0)::BIGINT AS ep FROM item i CROSS JOIN asked a LEFT JOIN hit h ON h.item_id = i.item_id AND h.pattern_id = a.pattern_id GROUP BY ALL",
    "locate_suffix_order_items": f"{_HITS} SELECT item_id, sa_rank, pos, pattern_id FROM hit",
    "locate_first_items": f"{_HITS} SELECT item_id, pattern_id, sa_rank, pos FROM (SELECT item_id, 1 - pattern_id AS pattern_id, sa_rank, pos, row_number() OVER (PARTITION BY item_id, pattern_id ORDER BY sa_rank) AS k FROM hit WHERE pattern_id < 2) WHERE k <= 3",
    "count_ci_index_items": _counts_sql("benchmark", "item_id", "text", ["THE", "tIoN "], True),
    # A suffix is less than a pattern if its first bytes are; no suffix array is needed for the range.
    "search_range_documents": f"""WITH asked(pattern_id, p) AS (VALUES {_ASKED}), item AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
      head AS (SELECT doc_id, substring(piece, 2 * pos + 1, 18) AS s FROM (SELECT doc_id, piece, unnest(range(0, least(256, (n - 512 * b) // 2 + 1))) AS pos FROM (SELECT doc_id, b, length(h) AS n, substring(h, 512 * b + 1, 530) AS piece FROM (SELECT doc_id, h, unnest(range(0, length(h) // 512 + 1)) AS b FROM item)))),
      told AS (SELECT doc_id, s, count(*) AS n FROM head GROUP BY ALL),
      ranged AS (SELECT doc_id, pattern_id, coalesce(sum(n) FILTER (WHERE NOT starts_with(s, p) AND s < p), 0) AS sp, sum(n) FILTER (WHERE starts_with(s, p)) AS n FROM told CROSS JOIN asked GROUP BY ALL)
      SELECT doc_id, pattern_id::BIGINT AS pattern_id, sp::BIGINT AS sp, (sp + n)::BIGINT AS ep FROM ranged WHERE n > 0""",
    "locate_first_documents": f"""SELECT doc_id, pattern_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pattern_id ORDER BY substring(h, 2 * pos + 1)) AS k
      FROM (SELECT *, 0::BIGINT AS pattern_id FROM ({_hits_sql("onon")}) UNION ALL SELECT *, 1 FROM ({_hits_sql("tion th")}))) WHERE k <= 3""",
    # Windows of nine letters that a text's end cuts to six are not words of six.
    "count_index_table_documents": """WITH word AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(text, '[^a-zA-Z]+')) AS word FROM benchmark) WHERE length(word) IN (6, 9)),
      piece AS MATERIALIZED (SELECT doc_id, substring(text, 200 * b + 1, 208) AS piece FROM (SELECT doc_id, text, unnest(range(0, length(text) // 200 + 1)) AS b FROM documents)),
      gram AS MATERIALIZED (SELECT doc_id, 6 AS n, unnest(list_transform(range(1, 201), lambda k: substring(piece, k, 6))) AS word FROM piece UNION ALL SELECT doc_id, 9, unnest(list_transform(range(1, 201), lambda k: substring(piece, k, 9))) FROM piece)
      SELECT doc_id, word, count(*) AS n_matches FROM gram WHERE length(word) = n AND word IN (SELECT word FROM word) GROUP BY ALL""",
    "count_ci_index_documents": _counts_sql("documents", "doc_id", "text", ["THE", "tIoN "], True),
    # The BWT permutes a text's bytes: the one before the suffix at pos is that at pos - 1.
    "bwt_counts_documents": f"SELECT doc_id, byte AS bwt_byte, count(*) AS n, sum(idx + 1)::BIGINT AS pos_sum FROM ({_BYTES.format(key='doc_id', table='documents')}) GROUP BY ALL",
    "c_table_documents": f"""WITH b AS (SELECT doc_id, byte, count(*) AS n FROM (SELECT doc_id, byte FROM ({_BYTES.format(key='doc_id', table='documents')}) UNION ALL SELECT doc_id, 0 FROM documents WHERE text IS NOT NULL) GROUP BY ALL)
      SELECT d.doc_id, r.byte::INTEGER AS byte, coalesce(sum(b.n), 0)::BIGINT AS c FROM documents d CROSS JOIN range(256) r(byte) LEFT JOIN b ON b.doc_id = d.doc_id AND b.byte < r.byte WHERE d.text IS NOT NULL GROUP BY ALL""",
    "byte_ranks_documents": f"SELECT *, row_number() OVER (PARTITION BY doc_id, byte ORDER BY idx) - 1 AS rank FROM ({_BYTES.format(key='doc_id', table='documents')})",
    "byte_access_documents": """SELECT doc_id, CASE WHEN n > 0 THEN ('0x' || substring(h, 1, 2))::INTEGER END AS first, CASE WHEN n > 0 THEN ('0x' || substring(h, 2 * (n // 2) + 1, 2))::INTEGER END AS middle, NULL::INTEGER AS beyond,
      len(list_filter(range(1, n // 2 + 1), lambda k: substring(h, 2 * k - 1, 2) = '65'))::BIGINT AS e_before FROM (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents)""",
    "count_letter_fours": """SELECT ((ascii(g[1]) - 97) * 17576 + (ascii(g[2]) - 97) * 676 + (ascii(g[3]) - 97) * 26 + ascii(g[4]) - 97)::BIGINT AS pattern_id, count(*) AS n_matches
      FROM (SELECT substring(piece, spot, 4) AS g FROM (SELECT substring(text, 200 * b + 1, 203) AS piece FROM (SELECT text, unnest(range(0, length(text) // 200 + 1)) AS b FROM documents)) CROSS JOIN range(1, 201) r(spot)) WHERE regexp_full_match(g, '[a-z]{4}') GROUP BY ALL""",
    "count_named_patterns": """SELECT doc_id, 'r ' || r_name AS name, (len(string_split(text, lower(r_name[1:3]))) - 1)::BIGINT AS n_matches FROM documents JOIN region ON contains(text, lower(r_name[1:3]))""",
    "codec_locate": _PLACES,
    "codec_docs_with_any": "SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))",
    "codec_lengths": "SELECT doc_id, strlen(text)::BIGINT AS text_len FROM documents",
    "signature_contains_documents": "SELECT doc_id, pattern_id::BIGINT AS pattern_id FROM documents JOIN (VALUES (0, 'zzzzz'), (1, 'ntntnt'), (2, 'this very passage'), (3, 'onon the')) p(pattern_id, p) ON contains(text, p)",
    "block_counts_documents": _counts_sql("documents", "doc_id", "text", PATTERNS),
    "block_locate_documents": _PLACES,
    "block_contains_documents": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "chunk_counts_conversations": _counts_sql("(SELECT conv_id AS doc_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)", "doc_id", "text", ["the", ".", "?", "tion"]),
    # The heads of all suffixes, the empty ones included.
    "corpus_range_conversations": f"""WITH asked(pattern_id, p) AS (VALUES {_CORPUS_ASKED}), item AS (SELECT hex(encode(string_agg(text, '' ORDER BY turn))) AS h FROM conversations GROUP BY conv_id),
      told AS (SELECT s, count(*) AS n FROM (SELECT substring(h, 2 * unnest(range(0, length(h) // 2 + 1)) + 1, 30) AS s FROM item) GROUP BY s),
      ranged AS (SELECT pattern_id, coalesce(sum(n) FILTER (WHERE NOT starts_with(s, p) AND s < p), 0) AS sp, coalesce(sum(n) FILTER (WHERE starts_with(s, p)), 0) AS n FROM told CROSS JOIN asked GROUP BY ALL)
      SELECT pattern_id::BIGINT AS pattern_id, CASE WHEN n > 0 THEN sp ELSE 0 END::BIGINT AS sp, CASE WHEN n > 0 THEN sp + n ELSE 0 END::BIGINT AS ep FROM ranged""",
    "incremental_state": """SELECT 'appended' AS state, sum(strlen(text))::BIGINT AS buffer_len, false AS is_built, 0::BIGINT AS texts FROM conversations
      UNION ALL SELECT 'rebuilt', sum(strlen(text))::BIGINT, true, count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'cleared', 0, false, 0""",
    "sql_locate": f"""SELECT doc_id, 0::BIGINT AS pattern_id, pos FROM ({_hits_sql("onon")}) UNION ALL SELECT doc_id, pattern_id, pos FROM
      ({_places_sql(1, "é tion", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')").replace("é", "É")} UNION ALL {_places_sql(2, "tion")}) WHERE k < n""",
    "query_log_empty": "SELECT * FROM (VALUES ('total', 0.0::DOUBLE), ('unique', 0.0), ('unique_exact', 0.0), ('frequency', 0.0), ('hit_rate', 0.0), ('p50', NULL), ('sketched', 0.0)) m(metric, value)",
    "query_log_latency_scan": "SELECT ts_ms, value FROM (SELECT epoch_us(ts) // 1000 AS ts_ms, value::FLOAT AS value, min(epoch_us(ts) // 1000) OVER () AS a, max(epoch_us(ts) // 1000) OVER () AS b FROM events) WHERE ts_ms >= a + (b - a) // 4",
    "series_scan_events": """SELECT series, ts_ms, value FROM (SELECT event_type AS series, epoch_us(ts) // 1000 AS ts_ms, value::FLOAT AS value, min(epoch_us(ts) // 1000) OVER () AS a, max(epoch_us(ts) // 1000) OVER () AS b FROM events)
      WHERE series IN ('click', 'view') AND ts_ms BETWEEN a + (b - a) // 4 AND b - (b - a) // 4""",
    # So few different patterns that the sketch holds each of them.
    "query_log_unique_sketch": "SELECT count(DISTINCT event_type)::DOUBLE AS unique_patterns FROM events",
    "query_log_quantiles_sketch": f"""WITH held AS (SELECT CASE WHEN value > 0 THEN ceil(ln(value) / {math.log(1.01 / 0.99)!r}) END AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL),
      summed AS (SELECT bucket, sum(n) OVER (ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER () AS total FROM held)
      SELECT q, coalesce(2 * power({1.01 / 0.99!r}::DOUBLE, arg_min(bucket, upto)) / ({1.01 / 0.99!r}::DOUBLE + 1), 0.0) AS value FROM summed CROSS JOIN (VALUES (0.5::DOUBLE), (0.99::DOUBLE)) a(q) WHERE upto > q * (total - 1) GROUP BY q""",
    "byte_ranks_items": f"SELECT *, row_number() OVER (PARTITION BY item_id, byte ORDER BY idx) - 1 AS rank FROM ({_BYTES.format(key='item_id', table='benchmark')})",
    "byte_histogram_by_lang": f"SELECT lang, byte, count(*) AS n FROM ({_BYTES.format(key='lang', table='documents')}) GROUP BY ALL",
    "bit_ranks_events": "SELECT idx, bit, ones AS rank1, idx - ones AS rank0 FROM (SELECT event_id AS idx, value > 50 AS bit, coalesce(sum((value > 50)::INTEGER) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ones FROM events)",
    "page_hits": _counts_sql("pages", "page_id", "html", ["<p>", "</a>", "href", "é"]),
    "conversation_hits": _counts_sql("conversations", "conv_id, turn", "text", ["the", "in", "."]),
    "stream_counts_conversations": _counts_sql("(SELECT conv_id AS doc_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)", "doc_id", "text", ["the", ".", "?", "tion"]),
    "rebuild_after_append": _counts_sql("(SELECT conv_id AS doc_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)", "doc_id", "text", ["the", ".", "?", "tion"]),
    "incremental_snapshot": _counts_sql("(SELECT conv_id AS doc_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)", "doc_id", "text", ["the", ".", "?", "tion"]),
    "codec_counts": _counts_sql("documents", "doc_id", "text", ["tion"]),
    "sql_functions": """SELECT doc_id, (len(string_split(text, 'tion')) - 1)::BIGINT AS n, (len(string_split(translate(text, 'THE', 'the'), 'the ')) - 1)::BIGINT AS n_ci, contains(text, 'é') AS has,
      ((len + 1) * 9 // 8) * 8 + 2048 + ((len + 1) // 512 + 1) * 72 + (len // 4 + 1) * 8 AS size, len FROM (SELECT doc_id, text, strlen(text)::BIGINT AS len FROM documents)""",
    "fnv_hashes": """SELECT item_id, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS hash FROM (
      SELECT item_id, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, octet_length(encode(text)) + 1), lambda p: ('0x' || hex(encode(text))[2 * p - 1:2 * p])::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS h FROM benchmark)""",
    "rollup_summary": f"SELECT count(*) AS total, count(DISTINCT event_type)::DOUBLE AS unique_patterns FROM ({_MIDDLE})",
    "rollup_frequency": f"SELECT event_type AS pattern, count(*) FILTER (WHERE inside) AS n FROM ({_TIMED}) GROUP BY ALL",
    "rollup_quantiles": f"""WITH held AS (SELECT CASE WHEN value > 0 THEN ceil(ln(value) / {math.log(1.01 / 0.99)!r}) END AS bucket, count(*) AS n FROM ({_MIDDLE}) WHERE value IS NOT NULL GROUP BY ALL),
      summed AS (SELECT bucket, sum(n) OVER (ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER () AS total FROM held)
      SELECT q, coalesce(2 * power({1.01 / 0.99!r}::DOUBLE, arg_min(bucket, upto)) / ({1.01 / 0.99!r}::DOUBLE + 1), 0.0) AS value FROM summed CROSS JOIN (VALUES (0.5::DOUBLE), (0.99::DOUBLE)) a(q) WHERE upto > q * (total - 1) GROUP BY q""",
    "stream_metrics_minutes": "SELECT start_ms, n FROM (SELECT ms // 60000 * 60000 AS start_ms, count(*) AS n, max(max(ms)) OVER () AS latest FROM (SELECT epoch_us(ts) // 1000 AS ms FROM events) GROUP BY 1) WHERE start_ms + 60000 <= latest - 600000",
    "query_log_total": "SELECT count(*) AS total FROM events",
    "query_log_unique_exact": "SELECT count(DISTINCT event_type)::DOUBLE AS unique_patterns FROM events",
    "query_log_frequency": "SELECT event_type AS pattern, count(*) AS n FROM events GROUP BY ALL",
    "query_log_frequency_sketch": "SELECT event_type AS pattern, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'never seen', 0",
    "query_log_quantiles_exact": "SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM events",
    "query_log_scan": f"SELECT ts_ms, value FROM ({_HALF}) WHERE ts_ms <= a + (b - a) // 2",
    "cache_results": "SELECT q.pattern, max(event_id) AS position, CASE WHEN max(event_id) IS NULL THEN NULL ELSE 1 END::BIGINT AS n FROM (VALUES ('click'), ('view'), ('purchase'), ('never')) q(pattern) LEFT JOIN events e ON e.event_type = q.pattern GROUP BY ALL",
    "cache_hit_rate": "SELECT count(event_type) AS lookups, count(DISTINCT event_type) AS entries, 1.0::DOUBLE - count(DISTINCT event_type) / count(event_type)::DOUBLE AS hit_rate FROM events",
}
