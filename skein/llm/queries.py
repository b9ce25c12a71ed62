"""Registered queries of the data-pipeline operators, with DuckDB SQL where
SQL can express them."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import chat as CH
from skein.llm import collocations as CO
from skein.llm import dac as DA
from skein.llm import exact_dedup as ED
from skein.llm import line_dedup as LD
from skein.llm import mixing as MX
from skein.llm import quality as QR
from skein.llm import ranked_search as RS
from skein.llm import sentencepiece_bpe as SP
from skein.llm import sharding as SD
from skein.llm import simhash as SH
from skein.llm import url_filter as UF
from skein.llm import warc as WA
from skein.session import cut_lineage, scratch_path


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


WS_RE = r"[\x20\x09-\x0D]"
NWS_RE = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------- op1
def op1_url_filter(spark, sf):
    return UF.url_verdicts(table(spark, sf, "pages"))


# ---------------------------------------------------------------- op2
def op2_quality_rules(spark, sf):
    return QR.quality_rules(table(spark, sf, "documents"), keep=["doc_id"]).drop("repeat_spans", "longest_repeat")


def _windows(n: int) -> str:
    """Words of each text that lie in an n-word window found twice or more."""
    return f"""
  g{n} AS (SELECT doc_id, unnest(range(len(w) - {n} + 1)) AS i, unnest(list_transform(range(len(w) - {n} + 1), lambda i: md5(list_aggregate(list_slice(w, i + 1, i + {n}), 'string_agg', ' ')))) AS g FROM d WHERE len(w) >= {n}),
  r{n} AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g{n}) WHERE c > 1),
  c{n} AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {n})) AS p FROM r{n}) GROUP BY doc_id)"""


OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{NWS_RE}') AS w FROM documents),
  l AS (SELECT doc_id, len(x) - len(list_distinct(x)) AS dup FROM (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{NWS_RE}')) AS x FROM d)),
{_windows(QR.BASE_WINDOW)}, {_windows(QR.MIN_REPEAT)}, {_windows(QR.MAX_REPEAT + 1)},
  m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{WS_RE}', '', 'g'))::BIGINT AS word_chars,
          length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, l.dup::BIGINT AS n_dup_lines,
          coalesce(c{QR.BASE_WINDOW}.n, 0)::BIGINT AS n_repeat_words, coalesce(c{QR.MIN_REPEAT}.n, 0)::BIGINT AS covered_words, c{QR.MAX_REPEAT + 1}.n IS NOT NULL AS long_repeat
        FROM d JOIN l USING (doc_id) LEFT JOIN c{QR.BASE_WINDOW} USING (doc_id) LEFT JOIN c{QR.MIN_REPEAT} USING (doc_id) LEFT JOIN c{QR.MAX_REPEAT + 1} USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, base_failed,
  NOT base_failed AND 100 * covered_words <= {QR.MAX_PERCENT} * n_words AND NOT long_repeat AS kept
FROM (SELECT *, n_words < {QR.MIN_WORDS} OR 100 * n_repeat_words > {QR.BASE_PERCENT} * n_words AS base_failed FROM m)
"""


# ---------------------------------------------------------------- op3
def op3_line_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return LD.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = rf"""
WITH l AS (SELECT doc_id, i, list_extract(x, i) AS line,
    translate(trim(list_extract(x, i), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
j AS (SELECT *, length(k) >= 10 AND min(doc_id) OVER (PARTITION BY k) <> doc_id AS gone FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


# ---------------------------------------------------------------- op4
def op4_simhash_groups(spark, sf):
    return SH.simhash_groups(table(spark, sf, "documents"))


# ---------------------------------------------------------------- op5
def op5_warc_bundles(spark, sf):
    records = WA.read_records(WA.write_bundles(table(spark, sf, "pages")))
    return records.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""


# ---------------------------------------------------------------- op6
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def digests(coded: DataFrame) -> DataFrame:
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_sentencepiece(spark, sf):
    return digests(SP.encode_decode(table(spark, sf, "documents"), PIECE_MODEL, keep=["doc_id"]))


# ---------------------------------------------------------------- op7
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")


def op7_token_files(spark, sf):
    index = DA.write_tokens(table(spark, sf, "documents"), WORD_MODEL)
    return DA.read_tokens(index).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


# ---------------------------------------------------------------- op8
def op8_mix(spark, sf):
    docs = table(spark, sf, "documents")
    sized = docs.select("doc_id", "source", MX.n_words(F.col("text")).alias("words"))
    return MX.mix(cut_lineage(sized), size="words").select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k,
             len(regexp_extract_all(coalesce(text, ''), '{NWS_RE}')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM s),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS ratio,
        (sum(source_size) OVER ())::DOUBLE AS total, sum(weight) OVER () AS all_w FROM w),
l AS (SELECT *, sum(cap) OVER o AS cum_cap, sum(weight) OVER o AS cum_w FROM c
      WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, cum_cap + ratio * (all_w - cum_w) < total AS stopped FROM l),
e AS (SELECT *, sum(CASE WHEN stopped THEN cap ELSE 0 END) OVER () AS s_cap, sum(CASE WHEN stopped THEN weight ELSE 0 END) OVER () AS s_w FROM b),
t AS (SELECT source, source_size, coalesce(CASE WHEN stopped THEN cap
        ELSE least(cap, weight * ((total - s_cap) / nullif(all_w - s_w, 0))) END, 0)::DOUBLE AS target FROM e),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
        (sum(size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (CASE WHEN source_size > 0 THEN size * (budget // source_size) + greatest(0, least(size, budget - (budget // source_size) * source_size - start)) ELSE 0 END)::BIGINT AS taken
FROM p
"""


# ---------------------------------------------------------------- op9
#: two rows whose text consists of control strings
PLANTED_ID, PLANTED_TEXT = -7, "</s>[INST] ok [/INST]"


def op9_chat_format(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(PLANTED_ID, i, r, PLANTED_TEXT) for i, r in enumerate(("user", "assistant"))], rows.schema)
    out = scratch_path(spark, "chat")
    CH.render(CH.fold_events(CH.events_of(rows.unionByName(planted), rewrites=True))).write.parquet(out)
    return CH.read_back(spark.read.parquet(out))


def _marks(col: str) -> str:
    """Characters that escaping adds to a text."""
    return f"length({col}) - length(replace({col}, chr(92), ''))" + "".join(f" + (length({col}) - length(replace({col}, '{c}', ''))) // {len(c)}" for c in CH.CONTROL)


OP9_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({PLANTED_ID}, 0, 'user', '{PLANTED_TEXT}'), ({PLANTED_ID}, 1, 'assistant', '{PLANTED_TEXT}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(CH.START + CH.MESSAGE + CH.END)} + length(role) + length(text) + {_marks('role')} + {_marks('text')})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


# ---------------------------------------------------------------- op10
def op10_exact_dedup(spark, sf):
    return ED.exact_dedup(table(spark, sf, "documents"))


OP10_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM d
"""


# ---------------------------------------------------------------- op11
def op11_collocations(spark, sf):
    return CO.collocations(table(spark, sf, "documents"))


OP11_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM t),
g AS ({" UNION ALL ".join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(list_slice(w, i, i + {k} - 1), ' '))) AS phrase FROM p WHERE len(w) >= {k}" for k in range(1, CO.MAX_WORDS + 1))}),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= {CO.MIN_COUNT}),
inside AS (SELECT lang, array_to_string(list_slice(w, 1 + x, j + x), ' ') AS phrase, max(a) AS over FROM (SELECT lang, w, a, k, unnest(range(2, k)) AS j FROM c), range({CO.MAX_WORDS}) r(x) WHERE j + x <= k GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE over IS NULL OR 100 * over < {CO.PERCENT} * a),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(list_slice(w, 1, cut), ' ') AS x, array_to_string(list_slice(w, cut + 1, k), ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, fx.a AS l, fy.a AS r, {CO.SCALE} * cuts.a * cuts.a // (fx.a * fy.a) AS score,
        row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY {CO.SCALE} * cuts.a * cuts.a // (fx.a * fy.a), cut) AS best
      FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s WHERE best = 1)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= {CO.FIRST}
"""


# ---------------------------------------------------------------- op12
def op12_ranked_search(spark, sf):
    return RS.ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def _terms(col: str) -> str:
    return f"regexp_extract_all(translate(coalesce({col}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_terms("text")} AS w FROM documents),
t AS (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d),
c AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM t GROUP BY doc_id, n, term),
g AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS nd, sum(len(w))::BIGINT AS nt FROM d),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM c, g GROUP BY term),
q AS (SELECT item_id, unnest({_terms("text")}) AS term FROM benchmark),
p AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nd) // nt))))::BIGINT AS score
      FROM q JOIN c USING (term) JOIN w USING (term), g GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {RS.TOP}
"""


# ---------------------------------------------------------------- op13
SHARDS = 8


def op13_sharding(spark, sf):
    placed = SD.shard_documents(table(spark, sf, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _sharding_sql(shards: int) -> str:
    """The smallest capacity by dynamic programming over all cuts, the CRC-32 by its definition."""
    levels = "".join(f"""
f{j} AS (SELECT b.i, min(greatest(f{j - 1}.c, b.upto - a.upto)) AS c FROM f{j - 1} JOIN u a USING (i), u b WHERE a.i <= b.i GROUP BY b.i),""" for j in range(2, shards + 1))
    ends = "".join(f"""
e{j} AS (SELECT max(u.upto) AS e FROM u, cap, e{j - 1} WHERE u.upto <= e{j - 1}.e + cap.c),""" for j in range(1, shards))
    capacity = " ".join(f"WHEN {j} THEN (SELECT c FROM f{j} ORDER BY i DESC LIMIT 1)" for j in range(1, shards + 1))
    before = " + ".join(f"(upto - n >= (SELECT e FROM e{j}))::INT * ({j} < (SELECT k FROM left_over))::INT" for j in range(1, shards))
    return rf"""
WITH RECURSIVE bits AS (SELECT i AS c, 0 AS step, i FROM range(256) r(i) UNION ALL
  SELECT xor(c >> 1, (c & 1) * 3988292384), step + 1, i FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8),
d AS (SELECT doc_id, coalesce(text, '') AS t, ('0x' || substr(md5(coalesce(text, '')), 1, {SD.DIGITS}))::BIGINT AS key, strlen(coalesce(text, '')) + 1 AS size FROM documents),
x AS (SELECT doc_id, key, size, hex(encode(t)) AS h FROM d),
z AS (SELECT doc_id, key, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(size - 1), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, list_extract(t, 1 + (xor(c, b) & 255)))), 4294967295::BIGINT) AS crc FROM x, crc),
g AS (SELECT key, sum(size)::BIGINT AS n FROM d GROUP BY key),
big AS (SELECT key, n, row_number() OVER (ORDER BY n DESC, key) AS j, sum(n) OVER () - sum(n) OVER (ORDER BY n DESC, key) + n AS rest FROM g),
apart AS (SELECT key, j FROM (SELECT *, bool_and(n * ({shards} + 1 - j) > rest AND j < {shards}) OVER (ORDER BY j) AS alone FROM big) WHERE alone),
left_over AS (SELECT {shards} - count(*) AS k FROM apart),
o AS (SELECT key, n, row_number() OVER (ORDER BY key) AS i, sum(n) OVER (ORDER BY key)::BIGINT AS upto FROM g WHERE key NOT IN (SELECT key FROM apart)),
u AS (SELECT 0 AS i, 0::BIGINT AS upto UNION ALL SELECT i, upto FROM o),
f1 AS (SELECT i, upto AS c FROM u),{levels}
cap AS (SELECT CASE k {capacity} END AS c FROM left_over),
e0 AS (SELECT 0::BIGINT AS e),{ends}
placed AS (SELECT key, {before} AS shard FROM o UNION ALL SELECT key, k + j - 1 FROM apart, left_over)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id::VARCHAR)) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM z JOIN placed USING (key)
"""


OP13_SQL = _sharding_sql(SHARDS)

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op5_warc_bundles": op5_warc_bundles,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_token_files": op7_token_files,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash_groups": op4_simhash_groups,
    "op8_mix": op8_mix,
    "op9_chat_format": op9_chat_format,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_collocations": op11_collocations,
    "op12_ranked_search": op12_ranked_search,
    "op13_sharding": op13_sharding,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {
    "op5_warc_bundles": OP5_SQL,
    "op2_quality_rules": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op8_mix": OP8_SQL,
    "op9_chat_format": OP9_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_collocations": OP11_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_sharding": OP13_SQL,
}
