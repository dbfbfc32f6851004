"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bytebpe, chat, htmltext, langid, linededup, mixing, ngramjoin, packing, quality, runs, urlfilter, vectors,
               whitening)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return deco


# ------------------------------------------------------------- near duplicates

@register("op1_ngram_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.reached = l.x)
SELECT doc_id, n AS n_shingles, min(reached) AS component_id FROM n JOIN r USING (doc_id) GROUP BY doc_id, n""")
def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component of its 5-word shingle links."""
    found = ngramjoin.ngram_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


# ------------------------------------------------------------- page extraction

@register("op2_page_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return htmltext.extract(table(spark, sf_dir, "pages"))


# ------------------------------------------------------------------ line dedup

@register("op5_line_dedup")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later repeated runs of lines."""
    docs = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", "text")


# ---------------------------------------------------------------- URL filters

#: The contract's rules: hosts with all subdomains, path prefixes (fixed values).
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Words of hosts and paths that mark unwanted sites; for URLs that no listed rule fits.
BLOCKED_WORDS = ("spam farm", "link farm", "cheap pills", "casino", "viagra", "porn", "xxx", "free money",
                 "payday loan", "phishing", "malware", "warez")

URL_RULES = [*(urlfilter.host_rule(v, n) for v, n in HOST_RULES),
             *(urlfilter.word_rule("block", w) for w in BLOCKED_WORDS)]

_BLOCKED = " OR ".join(
    "regexp_matches(host || path, '(^|[^a-z0-9])" + "[-_./]".join(w.split()) + "([^a-z0-9]|$)', 'i')"
    for w in BLOCKED_WORDS)


@register("op3_url_filters", f"""
WITH s AS (SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS i FROM pages),
r AS (SELECT page_id, CASE WHEN i = 0 THEN '' ELSE regexp_extract(substr(u, i + 3), '^[^/?#]*') END AS h,
             CASE WHEN i = 0 THEN '' ELSE regexp_extract(substr(u, i + 3), '^[^/?#]*([^?#]*)', 1) END AS path FROM s),
t AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM r),
d AS (SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM t)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
       WHEN rule IS NOT NULL THEN 'allow' WHEN {_BLOCKED} THEN 'block' ELSE 'allow' END AS verdict
FROM d""")
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of ``pages`` against the listed rules and the blocked words."""
    judged = urlfilter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


# --------------------------------------------------------------- vector search

@register("op4_vector_top_k", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 5""")
def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best products of every 50th embedding against all others."""
    all_vectors = vectors.quantised(table(spark, sf_dir, "embeddings"), "embedding")
    return vectors.top_k(all_vectors.where("vec_id % 50 = 0"), all_vectors, 5)


# --------------------------------------------------------------- source mixing

@register("op6_source_mix", r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, 'null') || '|0') AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, cap / weight AS r
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
t AS (SELECT *, CASE WHEN r <= level THEN cap::DOUBLE
             ELSE (SELECT level FROM l WHERE r > level ORDER BY r, source NULLS LAST LIMIT 1) * weight END AS target FROM l),
p AS (SELECT *, greatest(1, least(256, ceil(source_size / 1024)))::BIGINT AS width FROM t),
n AS (SELECT *, ceil(source_size / width)::BIGINT AS blocks,
             CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM p),
m AS (SELECT *, least(whole * blocks + least(round((target - whole * source_size) / width)::BIGINT, blocks), 3 * blocks) AS slots FROM n),
o AS (SELECT *, coalesce(sum(slots) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first,
             length(bin(greatest(sum(slots) OVER () - 1, 1)::BIGINT)) AS bits FROM m),
v AS (SELECT source, blocks, list_sum(list_transform(range(bits), lambda b: ((point >> b) & 1) << (bits - 1 - b)))::BIGINT AS slot
      FROM (SELECT *, unnest(range(first::BIGINT, (first + slots)::BIGINT)) AS point FROM o)),
k AS (SELECT source, slot, (row_number() OVER (PARTITION BY source ORDER BY slot) - 1) // blocks AS pass,
             (row_number() OVER (PARTITION BY source ORDER BY slot) - 1) % blocks AS block FROM v),
g AS (SELECT d.*, source_size, target, width,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source),
c AS (SELECT *, unnest(CASE WHEN size > 0 THEN range(start // width, (start + size - 1) // width + 1) ELSE [NULL] END) AS block FROM g),
h AS (SELECT c.doc_id, c.size, c.source_size, c.target, c.start, c.source, pass, min(slot) AS slot, sum(CASE WHEN slot IS NOT NULL THEN
             least(c.start + c.size, (c.block + 1) * width) - greatest(c.start, c.block * width) END) AS here
      FROM c LEFT JOIN k ON c.source IS NOT DISTINCT FROM k.source AND c.block = k.block GROUP BY ALL)
SELECT doc_id, size, source_size, target, coalesce(sum(here), 0)::BIGINT AS taken, min(slot) AS first_slot,
       coalesce(string_agg(slot::VARCHAR, ',' ORDER BY slot), '') AS slots
FROM h GROUP BY doc_id, size, source_size, target, start, source""")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by the contract's weights, with their places in the mix."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.array_min("slots").alias("first_slot"),
                        F.array_join("slots", ",").alias("slots"))


# ----------------------------------------------------------------- chat format

_MARKS = r"^[ \t]*((?:>[ \t]?)*)"
_INTRO = r"(?i)^\s*\S.{0,200}\b(?:wrote|writes|schrieb|schreibt|escribió|écrit|a écrit)\s*:\s*$"
_WHOLE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


@register("op7_quote_linking", rf"""
WITH RECURSIVE m AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
        string_split_regex(coalesce(text, ''), '\r\n|\n|\r') AS l FROM conversations),
e AS (SELECT *, row_number() OVER () AS msg,
        list_transform(l, lambda x: length(regexp_replace(regexp_extract(x, '{_MARKS}', 1), '[^>]', '', 'g'))) AS v FROM m),
k AS (SELECT msg, conv_id, turn, unnest(range(len(l))) AS i, unnest(v) AS level, trim(regexp_replace(lower(regexp_replace(unnest(l),
        '{_MARKS}', '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS p FROM e),
x AS (SELECT *, sum(new) OVER (PARTITION BY msg ORDER BY i) AS run FROM (SELECT *,
        CASE WHEN lag(level) OVER (PARTITION BY msg ORDER BY i) = level THEN 0 ELSE 1 END AS new FROM k)),
y AS (SELECT * EXCLUDE (new), sum(new) OVER (PARTITION BY msg, run ORDER BY i) AS part FROM (SELECT * EXCLUDE (new),
        CASE WHEN lag(p) OVER (PARTITION BY msg, run ORDER BY i) = '' THEN 1 ELSE 0 END AS new FROM x)),
z AS (SELECT conv_id, turn, level, p, string_agg(nullif(p, ''), ' ') OVER (PARTITION BY msg, run ORDER BY i {_WHOLE}) AS in_run,
        string_agg(nullif(p, ''), ' ') OVER (PARTITION BY msg, run, part ORDER BY i {_WHOLE}) AS in_part FROM y),
own AS (SELECT conv_id, h, min(turn) AS source FROM (SELECT conv_id, turn, unnest([in_run, in_part, p]) AS h FROM z
        WHERE level = 0 AND p <> '') GROUP BY 1, 2),
q AS (SELECT z.conv_id, z.turn, level, coalesce(a.source, b.source, c.source) AS source, count(*) AS n FROM z
      LEFT JOIN own a ON a.conv_id = z.conv_id AND a.h = in_run AND a.source < turn
      LEFT JOIN own b ON b.conv_id = z.conv_id AND b.h = in_part AND b.source < turn
      LEFT JOIN own c ON c.conv_id = z.conv_id AND c.h = p AND c.source < turn
      WHERE level > 0 AND p <> '' GROUP BY 1, 2, 3, 4),
b AS (SELECT conv_id, turn, sum(n) AS n_quoted, max({{'n': n, 's': source}}).s AS quoted FROM q WHERE source IS NOT NULL
      GROUP BY conv_id, turn, level QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level) = 1),
t AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM (SELECT DISTINCT conv_id, turn FROM m)),
a AS (SELECT t.conv_id, t.turn, coalesce(quoted, prev) AS reply_to, n_quoted FROM t LEFT JOIN b USING (conv_id, turn)),
r AS (SELECT conv_id, turn, turn AS root, 0 AS depth FROM a WHERE reply_to IS NULL
      UNION ALL SELECT a.conv_id, a.turn, r.root, r.depth + 1 FROM a JOIN r ON a.conv_id = r.conv_id AND a.reply_to = r.turn),
c AS (SELECT conv_id, turn, role, list_max(v)::INTEGER AS max_level, CASE WHEN NOT contains(text, '>') THEN text ELSE
        trim(array_to_string(list_filter(l, lambda x, i: v[i] = 0 AND NOT (regexp_matches(x, '{_INTRO}') AND coalesce(v[i + 1], 0) > 0)),
                             chr(10))) END AS text FROM e)
SELECT conv_id, turn, role, reply_to, root, depth::BIGINT AS depth, coalesce(n_quoted, 0)::BIGINT AS n_quoted, max_level,
       row_number() OVER (PARTITION BY conv_id ORDER BY root, turn, role, text) - 1 AS position, text,
       '<|' || role || '|>' || chr(10) || text AS formatted
FROM c JOIN a USING (conv_id, turn) JOIN r USING (conv_id, turn)""")
def quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of ``conversations`` in reply order without its quotes."""
    return chat.thread(table(spark, sf_dir, "conversations"))


# --------------------------------------------------------------- quality rules

@register("op8_quality_rules", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(s) AS g, unnest(range(len(s))) AS i FROM (SELECT doc_id,
        list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i + 7], ' ')) AS s FROM d)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), range(8) t(k)
      WHERE c > 1 GROUP BY doc_id),
b AS (SELECT doc_id, t, w, l, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed
    OR 100 * n_symbols > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 100 * (length(t) - length(replace(t, '!', ''))) > 20 * n_words
    OR 100 * len(regexp_extract_all(t, '\p{Lu}')) > 40 * len(regexp_extract_all(t, '\p{L}'))
    OR 100 * len(regexp_extract_all(t, '\p{L}')) < 60 * word_chars
    OR 100 * coalesce(list_max(map_values(list_histogram(w))), 0) > 30 * n_words
    OR 100 * len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > 20 * n_words
    OR 100 * n_dup_lines > 50 * len(l)
    OR 100 * len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•]'))) > 90 * len(l)
    OR 100 * len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) > 30 * len(l)) AS kept
FROM f""")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the cascade's verdict on every document."""
    return quality.judge(table(spark, sf_dir, "documents")).drop("rejected_by")


# --------------------------------------------------------------------- packing

def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op9_packing")
def sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


# ----------------------------------------------------------------- language ID

@register("op10_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predict_languages(docs).select("doc_id", "held_out", "lang_pred", F.col("score"))


# --------------------------------------------------------------- periodic runs

def _repeating(doc_id: int | None, words: list[str]) -> list[str]:
    """The contract's repeated tails: a tenth of the documents, dealt by the
    checksum of the id, repeat p words from word a on."""
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


@register("op11_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the periodic runs of every document."""
    found = runs.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), key="doc_id", prepare=_repeating)
    # greatest length, then smallest start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["col2"]).alias("start"), best["length"].alias("length"),
        (-best["col3"]).alias("period"), F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


# ---------------------------------------------------------------- byte-level BPE

@register("op12_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text decoded from them."""
    import public_tokenizers as known

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bytebpe.encode(docs, known.path("byte_bpe_multi_50k.tiktoken"), known.PATTERN, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


# ------------------------------------------------------------------- whitening

@register("op13_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the whitened principal components."""
    done = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    return whitening.by_component(done, "vec_id")
