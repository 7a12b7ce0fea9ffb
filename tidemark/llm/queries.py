"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    audit,
    chat,
    convnet,
    decontaminate,
    jaccard,
    langid,
    linededup,
    packing,
    quality,
    ranked,
    secrets,
    tokencount,
    urlfilter,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


def tokenizer_file(name: str) -> str:
    """Where the package of public tokenizers keeps a vocabulary file, on every machine alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_RULES = quality.QualityRules()


@query(
    rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
),
at8 AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS win, words[i] AS word
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)
),
twice AS (SELECT doc_id, win FROM at8 GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM at8 JOIN twice USING (doc_id, win), (SELECT unnest(range(8)) AS k) GROUP BY doc_id
),
line AS (
  SELECT doc_id, host, h, length(h) AS chars
  FROM (
    SELECT doc_id, host, trim(unnest(string_split(lower(regexp_replace(text, '[^\p{{L}}\n]+', ' ', 'g')), chr(10)))) AS h FROM d
  ) WHERE h <> ''
),
per_line AS (
  SELECT l.host, h, count(DISTINCT text) AS docs FROM line l JOIN d USING (doc_id) GROUP BY ALL
),
gone AS (
  SELECT doc_id, sum(chars) AS chars
  FROM line JOIN per_line p USING (host, h) WHERE docs >= {_RULES.line_docs} GROUP BY doc_id
),
m AS (
  SELECT doc_id, len(words) AS n_words,
         length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words, coalesce(a.chars, 0)::BIGINT AS line_chars,
         coalesce(gone.chars, 0)::BIGINT AS removed_chars
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id)
  LEFT JOIN (SELECT doc_id, sum(chars) AS chars FROM line GROUP BY doc_id) a USING (doc_id)
),
v AS (SELECT *, n_words < {_RULES.min_words} OR 100 * n_repeat_words > {_RULES.repeat_percent} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND line_chars - removed_chars >= line_chars * {_RULES.left_share} AS kept FROM v
"""
)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def _weights(c: secrets.CharClass) -> str:
    return "[" + ", ".join(map(str, secrets.weights(c.window))) + "]"


def _entropy(c: secrets.CharClass, rank: int) -> str:
    """Suspect windows of one class, runs of them merged."""
    needs = "".join(f" AND regexp_matches(s, '{n}')" for n in c.needs)
    allowed = "".join(f" AND NOT regexp_matches(s, '{a}')" for a in secrets.ALLOWED)
    return rf"""
  SELECT doc_id, start + min(i) - 1 AS start, {rank} AS rank, start + max(i) - 1 + {c.window} AS stop, '{c.name}' AS kind
  FROM (
    SELECT *, i - row_number() OVER (PARTITION BY doc_id, start ORDER BY i) AS run FROM (
      SELECT doc_id, start, i, substr(s, i, {c.window}) AS win
      FROM (SELECT *, unnest(range(1, length(s) - {c.window} + 2)) AS i FROM hits WHERE kind = '{c.name}'{needs}{allowed})
    ) WHERE list_sum(list_transform(list_distinct(string_split(win, '')), lambda ch:
        {_weights(c)}[length(win) - length(replace(win, ch, '')) + 1])) <= {secrets.most(c.window, c.bits)}
  ) GROUP BY doc_id, start, run"""


_PATTERNS = [("assign", secrets.ASSIGN), ("access", secrets.ACCESS), ("hex", secrets.HEX)] + [
    (c.name, c.pattern) for c in secrets.CLASSES
]


def _hits(kind: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, s, list_sum(list_transform(gaps[1:k], lambda x: length(x)))
         + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT doc_id, found, gaps, unnest(found) AS s, unnest(range(1, len(found) + 1)) AS k FROM (
    SELECT doc_id, regexp_extract_all(text, '{quoted}', 0) AS found, string_split_regex(text, '{quoted}') AS gaps FROM d
  ))"""


@query(
    f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({" UNION ALL ".join(_hits(k, p) for k, p in _PATTERNS)}),
spans AS (
  SELECT doc_id, start, list_position(['assign', 'access', 'hex'], kind) - 1 AS rank, start + length(s) AS stop, kind
  FROM hits WHERE kind IN ('access', 'hex')
    OR kind = 'assign' AND length(regexp_extract(s, '{secrets.ASSIGN.replace("'", "''")}', 2)) >= {secrets.ASSIGN_LEAST}
  UNION ALL {" UNION ALL ".join(_entropy(c, 3 + k) for k, c in enumerate(secrets.CLASSES))}
),
s AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank, stop) AS spans,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, rank, stop) FILTER (rank < 3) AS base
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (doc_id)
"""
)
def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(secrets.joined("base"), 256).alias("base_sha256"),
        secrets.joined("spans").alias("spans"),
    )


def _like(rule: urlfilter.Rule) -> str:
    host, path = (part.replace("*", "%") for part in rule.glob.split(urlfilter.SEAM))
    return f"'.' || host LIKE '{host}' AND path LIKE '{path}'"


_BASE = sorted(urlfilter.BASE, key=lambda r: -len(r.name))
_CASES = "".join(f" WHEN {_like(r)} THEN '{r.name}'" for r in _BASE)
_VERDICTS = "".join(f" WHEN {_like(r)} THEN '{r.verdict}'" for r in [*_BASE, *urlfilter.METHOD])


@query(
    rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM r
)
SELECT page_id, host, path, CASE{_CASES} END AS rule, CASE{_VERDICTS} ELSE 'allow' END AS verdict FROM h
"""
)
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


@query(
    r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
),
solid AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS no,
         lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS n
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
win AS (
  SELECT * FROM (
    SELECT doc_id, no, n || chr(10) || lead(n) OVER w || chr(10) || lead(n, 2) OVER w AS win
    FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY no)
  ) WHERE win IS NOT NULL
),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, no) AS nth FROM win) WHERE nth > 1),
gone AS (
  SELECT DISTINCT s.doc_id, s.place
  FROM solid s JOIN (SELECT DISTINCT doc_id, no + k AS no FROM later, (SELECT unnest([0, 1, 2]) AS k)) USING (doc_id, no)
),
left_ AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY place) AS text FROM lines ANTI JOIN gone USING (doc_id, place)
  GROUP BY doc_id
),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_removed, CASE WHEN n.n IS NULL THEN d.text ELSE coalesce(l.text, '') END AS text
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN left_ l USING (doc_id)
"""
)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, count_col="n_removed")


@query(
    rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'
),
f AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + {
        " + ".join(f"(length(text) - length(replace(text, '{m}', ''))) // {len(m)}" for m in chat.ChatTemplate().controls)
    } AS shown FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(shown + CASE {" ".join(f"WHEN role = '{r}' THEN {len(a + b)}" for r, (a, b) in chat.ChatTemplate().marks.items())}
           ELSE length(role) + {len("".join(chat.ChatTemplate().other))} END)::BIGINT AS formatted_chars,
       regexp_matches(string_agg(CASE WHEN role IN ('system', 'user', 'assistant') THEN role[1] ELSE '?' END, ''
           ORDER BY turn NULLS FIRST, role, text), '^s?(ua)+$') AS valid
FROM f GROUP BY conv_id
"""
)
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    chats = chat.format_chats(turns.unionByName(more))
    chats = chats.withColumn("read", chat.parse_turns(F.col("formatted")))
    chats = chats.withColumn("loss", chat.loss_text(F.col("segments")))
    told = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


@query()
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = jaccard.JaccardRule(words=3, at_least=90, lengthen=8)
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), rule)


@query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@query()
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query()
def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    network = langid.fit_languages(docs.filter(~held_out))
    found = langid.predict_languages(docs, network)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"


@query(
    f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
n AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
q AS (
  SELECT DISTINCT * FROM (
    SELECT item, item_id, unnest(terms) AS t
    FROM (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS terms FROM benchmark WHERE text IS NOT NULL)
  )
),
tf AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(terms) AS t FROM d) SEMI JOIN q USING (t) GROUP BY ALL
),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY t, docs),
f AS (
  SELECT item, item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN tf USING (t) JOIN n USING (r), s GROUP BY item, item_id, r, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM f WHERE score > 0
) WHERE rank <= 10
"""
)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    network = convnet.fit_quality(docs.filter(~held_out), labels.filter(~held_out))
    found = convnet.score_quality(docs, network)
    good = (F.col("score") >= 0.7).cast("int").alias("predicted")
    return found.select("doc_id", held_out.alias("held_out"), "score", good)


@query(
    r"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM t),
f AS (
  SELECT doc_id, part,
         (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM w
),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS xs, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a, letter b, letter c, letter d, letter e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps AS (
  SELECT array_to_string(xs, '') AS filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
)
SELECT part, filter_order, step::INT AS step,
       coalesce(sum(n) FILTER (mask & (own + before) = 0), 0)::BIGINT AS kept,
       coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
       coalesce(sum(n) FILTER (mask & own <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
       coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
       coalesce(sum(good) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
       coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
       coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & own <> 0), 0)::BIGINT AS shapley
FROM m, steps GROUP BY ALL
"""
)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/documents.parquet"
    slots = audit.slots_for(spark.read.parquet(path).count())
    return audit.audit_filters(audit.document_stream(spark, path), table(spark, sf_dir, "labels"), slots)
