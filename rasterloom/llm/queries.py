"""The queries over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import chat, exact_dedup, gif, langid, licenses, mixing, quality, segments, simhash, windows
from rasterloom.llm.common import OWN, crc_bucket, table, written


#: Where the public vocabulary files are.
TOKENIZERS = "/opt/tokenizers"


def encoded(docs: DataFrame, model: str = f"{TOKENIZERS}/piece_bpe_32k.model", samples: int = 2) -> DataFrame:
    """A row for each document and sample; rank 0 has the largest perturbed score."""
    rows = segments.sampled(docs, model, samples)
    rows = rows.select("doc_id", F.posexplode("samples").alias("rank", "s"))
    return rows.select("doc_id", "rank", F.size("s.ids").cast("long").alias("n_pieces"), "s.ids", "s.log_p", "s.perturbed", "s.inclusion", "s.exact")


def op1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def documents_mix() -> mixing.Mix:
    """Domains made from the last digit of the source's name."""
    digit = F.substring("source", -1, 1)
    domain = F.when(digit.isin("0", "1", "2"), "web").when(digit.isin("3", "4", "5", "6"), "books").otherwise("forums")
    return mixing.Mix(
        levels={"domain": domain, "lang": F.col("lang"), "source": F.col("source")},
        weights={"domain": {"web": 5, "books": 3, "forums": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 2}},
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = mixing.mixed(docs, documents_mix(), [])
    return rows.select("doc_id", *[F.col(OWN + n).alias(n) for n in ("domain", "lang", "source")], F.col(OWN + "tokens").alias("n_tokens"), F.col(OWN + "full").alias("whole_epochs"), F.col(OWN + "prefix").alias("prefix_tokens"))


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, CASE WHEN right(source, 1) IN ('0', '1', '2') THEN 'web' WHEN right(source, 1) IN ('3', '4', '5', '6') THEN 'books' ELSE 'forums' END AS domain,
    coalesce(lang, '~') AS lang, coalesce(source, '~') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n
  FROM documents),
leaf AS (SELECT domain, lang, source, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(n) * 2 AS BIGINT) AS cap FROM t WHERE n > 0 GROUP BY ALL),
root AS (SELECT least(CAST(floor(sum(n_tokens) * CAST(0.8 AS DOUBLE)) AS BIGINT), CAST(sum(cap) AS BIGINT)) AS budget FROM leaf),
d0 AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 WHEN 'forums' THEN 2 ELSE 1 END AS w FROM leaf GROUP BY domain),
d1 AS (SELECT *, CAST(cap AS DOUBLE) / w AS ratio, (SELECT budget FROM root) AS budget FROM d0),
d2 AS (SELECT *, CAST(budget - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS lev
  FROM d1 WINDOW b AS (ORDER BY ratio, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d3 AS (SELECT *, max(CASE WHEN ratio <= lev THEN NULL ELSE lev END) OVER () AS rest FROM d2),
d AS (SELECT domain, CASE WHEN ratio <= lev THEN cap ELSE least(cap, greatest(CAST(floor(w * rest) AS BIGINT), 0)) END AS got FROM d3),
l0 AS (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap, CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS w FROM leaf GROUP BY domain, lang),
l1 AS (SELECT l0.*, CAST(cap AS DOUBLE) / w AS ratio, d.got AS budget FROM l0 JOIN d USING (domain)),
l2 AS (SELECT *, CAST(budget - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / CAST(sum(w) OVER (PARTITION BY domain) - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS lev
  FROM l1 WINDOW b AS (PARTITION BY domain ORDER BY ratio, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l3 AS (SELECT *, max(CASE WHEN ratio <= lev THEN NULL ELSE lev END) OVER (PARTITION BY domain) AS rest FROM l2),
l AS (SELECT domain, lang, CASE WHEN ratio <= lev THEN cap ELSE least(cap, greatest(CAST(floor(w * rest) AS BIGINT), 0)) END AS got FROM l3),
s1 AS (SELECT leaf.*, CAST(cap AS DOUBLE) AS ratio, l.got AS budget FROM leaf JOIN l USING (domain, lang)),
s2 AS (SELECT *, CAST(budget - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / CAST(count(*) OVER (PARTITION BY domain, lang) - coalesce(count(*) OVER b, 0) AS DOUBLE) AS lev
  FROM s1 WINDOW b AS (PARTITION BY domain, lang ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, max(CASE WHEN ratio <= lev THEN NULL ELSE lev END) OVER (PARTITION BY domain, lang) AS rest FROM s2),
q AS (SELECT domain, lang, source, n_tokens, n_rows, CASE WHEN ratio <= lev THEN cap ELSE least(cap, greatest(CAST(floor(rest) AS BIGINT), 0)) END AS quota FROM s3),
h AS (SELECT t.doc_id, domain, lang, source, n, quota // n_tokens AS whole, quota % n_tokens AS rest,
    CAST('0x' || substr(md5('17:' || CAST(quota // n_tokens AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM t JOIN q USING (domain, lang, source) WHERE n > 0),
p AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS start FROM h)
SELECT t.doc_id, t.domain, t.lang, t.source, t.n AS n_tokens, CAST(coalesce(p.whole, 0) AS BIGINT) AS whole_epochs,
  CAST(coalesce(least(p.n, greatest(0, p.rest - p.start)), 0) AS BIGINT) AS prefix_tokens
FROM t LEFT JOIN p USING (doc_id)
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(quality.with_statistics(table(spark, sf_dir, "documents"), ["doc_id"]), "quality-stats")
    bucket = crc_bucket(F.col("doc_id"), 5)
    model = quality.train(*quality.labelled(stats, table(spark, sf_dir, "labels"), bucket))
    held_out = F.coalesce(bucket == 0, F.lit(False))
    return quality.scores(stats, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = licenses.scan(docs)
    return rows.select("doc_id", F.col(OWN + "digest").alias("canonical_sha256"), F.col(OWN + "license").alias("license"), F.array_join(OWN + "notices", ",").alias("notices"))


# The SQL goes its own way: it drops copyright lines from a list of lines, looks words up in a map of spellings, and joins
# digests that it works out itself.  What it shares with the operator are the known texts and digests.
OP4_WORDS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "authorisation": "authorization", "authorised": "authorized", "artefact": "artifact", "cancelled": "canceled", "catalogue": "catalog", "favour": "favor",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http", "initialise": "initialize", "judgement": "judgment", "labelled": "labeled", "licence": "license", "licenced": "licensed", "licences": "licenses",
    "licencing": "licensing", "modelled": "modeled", "noncommercial": "non commercial", "organisation": "organization", "programme": "program", "recognised": "recognized", "sublicence": "sublicense",
    "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}
OP4_PHRASES = {
    "copyright holder": "copyright owner", "copyright holders": "copyright owners", "merchantable quality": "merchantability", "owner s": "owners", "per cent": "percent", "sub license": "sublicense",
    "sub licensed": "sublicensed", "sub licensing": "sublicensing",
}


def op4_sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    start = r"^[\x00-\x09\x0B-\x20#*/;<\-\p{Z}\p{Cf}]*"
    stays = start + r"copyright[\p{Z}\x09]+(holders?|owners?|notices?|laws?|licen[cs]es?|and|or|in|interest|statement|treaty|treaties)\b"
    words = "MAP {" + ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in OP4_WORDS.items()) + "}"

    def sql(text: str) -> str:
        lines = f"string_split(replace(replace(lower(coalesce({text}, '')), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"
        dropped = rf"(regexp_matches(l, '{start}(\(c\)|©|all rights reserved)') OR (regexp_matches(l, '{start}copyright') AND NOT regexp_matches(l, '{stays}')))"
        kept = f"array_to_string(list_filter({lines}, lambda l: NOT {dropped}), chr(10))"
        split = rf"list_filter(string_split(regexp_replace({kept}, '[\p{{P}}\p{{S}}\p{{Z}}\p{{Cc}}\p{{Cf}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
        c = f"concat(' ', array_to_string(list_transform({split}, lambda w: replace(coalesce({words}[w], w), ' ', '  ')), '  '), ' ')"
        for a, b in OP4_PHRASES.items():
            c = "replace({}, {}, {})".format(c, *[quoted(f" {x} ".replace(" ", "  ")[1:-1]) for x in (a, b)])
        return f"sha256(replace(trim({c}), '  ', ' '))"

    texts = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in licenses.forms())
    digests = ", ".join(f"({quoted(d)}, {quoted(name)})" for d, name in licenses.DIGESTS.items())
    return f"""
WITH known AS MATERIALIZED (SELECT digest, min(name) AS license FROM (SELECT {sql('body')} AS digest, name FROM (VALUES {texts}) AS k(name, body) UNION ALL SELECT * FROM (VALUES {digests}) AS m(digest, name)) GROUP BY digest),
d AS (SELECT doc_id, {sql('text')} AS digest FROM documents),
l AS (SELECT doc_id, unnest(string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS k FROM documents),
n AS (SELECT doc_id, string_agg(license, ',' ORDER BY k) AS notices FROM (SELECT doc_id, k, {sql('line')} AS digest FROM l) JOIN (SELECT {sql('body')} AS digest, min(name) AS license FROM (VALUES {texts}) AS k(name, body) GROUP BY 1) USING (digest) GROUP BY doc_id)
SELECT d.doc_id, d.digest AS canonical_sha256, license, coalesce(notices, '') AS notices FROM d LEFT JOIN known USING (digest) LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op5_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.stored(table(spark, sf_dir, "documents"), with_media=False).drop("media")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.rotations(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m.start.cast("string"), F.lit("-"), m.end.cast("string"))), ",")
    return rows.select("conv_id", "speaker", "part", "offset", F.col("n_turns").cast("long").alias("n_turns"), "text", spans.alias("mask"))


OP7_SQL = r"""
WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k FROM t),
who AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
s AS (SELECT n.conv_id, speaker, k, k // 256 AS part, role, n.text,
    '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN role ELSE 'user name=' || role END || chr(10) AS head, n.text || '<|im_end|>' || chr(10) AS body
  FROM n JOIN who ON n.conv_id IS NOT DISTINCT FROM who.conv_id),
p AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop FROM s),
o AS (SELECT *, min(stop - length(head) - length(body)) OVER (PARTITION BY conv_id, speaker, part) AS first FROM p)
SELECT conv_id, speaker, part, CAST(min(first) AS BIGINT) AS "offset", count(*) AS n_turns, string_agg(head || body, '' ORDER BY k) AS text,
  coalesce(string_agg(CASE WHEN role = speaker THEN CAST(CAST(stop - first - length(body) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(stop - first - 1 AS BIGINT) AS VARCHAR) END, ',' ORDER BY k), '') AS mask
FROM o GROUP BY conv_id, speaker, part
"""


def op8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    bucket = crc_bucket(F.col("doc_id"), 4)
    held_out = F.coalesce(bucket == 2, F.lit(False))
    model = langid.learn(docs.filter(~held_out))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.dedup_folder(spark, f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents),
g AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS r, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY body) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, r = 1 AS kept, sha256(body) AS text_sha256 FROM g
"""


def op10_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k.range AS p FROM win JOIN firsts USING (s) CROSS JOIN range(13) k WHERE least < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_segments": op1_segments,
    "op2_mixing": op2_mixing,
    "op3_quality": op3_quality,
    "op4_licenses": op4_licenses,
    "op5_gif": op5_gif,
    "op6_simhash": op6_simhash,
    "op7_chat": op7_chat,
    "op8_languages": op8_languages,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_windows": op10_windows,
}
ORACLE_SQL: dict[str, str] = {
    "op2_mixing": OP2_SQL,
    "op4_licenses": op4_sql(),
    "op7_chat": OP7_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op10_windows": OP10_SQL,
}
