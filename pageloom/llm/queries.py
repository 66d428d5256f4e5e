"""The queries of this subpackage: thin, they derive the contracts' columns from what the operators give."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, tune, written
from .bpe import decode, encode
from .chat import format_conversations, loss_text, read_turns
from .warc import merge_index, read_archives, with_roles, write_archives
from .cotrain import classify
from .jaccard import jaccard_components
from .packing import pack, pieces
from .simhash import NEAR, edited, fingerprints, likeness, radius_links, with_next
from .substring import drop_repeats
from .token_counts import count_tokens
from .media import audio_features, encode_wav, padded_payload
from .negatives import hard_negatives
from .repair import repair
from .topk import top_k
from .vectors import integers


def op1_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), padded_payload(F.col("text")).alias("payload"))
    out = audio_features(docs.select("doc_id", "n_bytes", encode_wav(F.col("payload")).alias("media")), keep=("doc_id", "n_bytes"))
    size = F.octet_length("samples").cast("long")
    spans = F.concat_ws(",", F.transform("spans", lambda s: F.format_string("%.0f-%.0f", s["start_ms"], s["end_ms"])))
    return out.select(
        "doc_id",
        "n_bytes",
        size.alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("samples"), -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.lit("logmel16x32"), F.col("frames").cast("string"), F.sha2("tensors", 256), F.sha2(spans, 256)).alias("feature"),
        F.size("spans").alias("n_spans"),
    )


#: A conversation of the contract, whose texts are full of control strings.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(c).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(x).alias("text")) for c, t, r, x in PROBE])).alias("r")).select("r.*")
    out = format_conversations(rows.unionByName(probe))
    back = out.select("conv_id", "valid", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), esc AS (
  SELECT *,
    regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS etext,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length('<s>[INST]') + length(role) + length('[/INST]') + length(etext) + length('</s>') + 1)::BIGINT AS formatted_chars,
  bool_and(coalesce(before, '') || '>' || role IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user', 'assistant>tool', 'tool>assistant')) AS valid
FROM esc GROUP BY conv_id
"""


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    archives = write_archives(with_roles(table(spark, sf_dir, "pages")))
    index = merge_index(written(read_archives(archives), "captures"))  # ranges are sampled, and the archives shall be parsed once
    return index.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = with_next(table(spark, sf_dir, "documents"))
    docs = docs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "text", "next_text")
    docs = docs.withColumn("edited", edited(F.col("text"), F.col("next_text"))).withColumn("edited_sha256", F.sha2("edited", 256))
    names = {"text": "fingerprint", "next_text": "next_fingerprint", "edited": "edited_fingerprint"}
    first = written(fingerprints(docs, names, keep=("doc_id", "n_chars", "edited_sha256")), "simhash")  # it is read twice
    links = radius_links(first, radius=NEAR)
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return first.join(links, "fingerprint", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexed("fingerprint").alias("fingerprint"),
        hexed("edited_fingerprint").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    path = vocabulary("word_bpe_49k.json")
    out = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return pack(pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    out = drop_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
q AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM q),
m AS (SELECT h, min(doc_id) AS low FROM h GROUP BY 1),
r AS (SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 50)) AS pos FROM h JOIN m USING (h) WHERE m.low < h.doc_id),
g AS (SELECT doc_id, count(*) AS n_removed, list(pos) AS gone FROM r GROUP BY 1),
k AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, ws FROM w LEFT JOIN g USING (doc_id)),
p AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS pos FROM w),
kept AS (SELECT p.doc_id, string_agg(x, ' ' ORDER BY p.pos) AS t FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.pos = p.pos WHERE r.pos IS NULL GROUP BY 1)
SELECT k.doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM k LEFT JOIN kept USING (doc_id)
"""


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return jaccard_components(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 80 * (a.c + b.c - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reach)
SELECT d.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, m.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY 1) m ON m.node = d.doc_id
"""


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with the contract's faults; a row that goes still names its conversation."""
    number = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("k") == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    there = rows.select("conv_id", "turn", "role", "text", number.alias("k")).select("conv_id", *(F.when(F.col("k") != 0, c).alias(n) for n, c in (("turn", F.col("turn")), ("role", role), ("text", text))), "k")
    return there.select("*", F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    out = repair(damaged(table(spark, sf_dir, "conversations")))
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))


def _op11_sql() -> str:
    """The dynamic programme as a fold over each conversation's symbols; a state is its cost in six digits and its edits, so that the least text is the answer."""
    plus = lambda s, c, x: f"lpad((substr({s}, 1, 6)::BIGINT + {c})::VARCHAR, 6, '0') || substr({s}, 7) || '{x}'"
    more, low = "(CASE WHEN x[1] = upper(x[1]) THEN 1 ELSE 0 END)", "lower(x[1])"
    to_user = "least(s[1], s[2], s[4])"
    rows = [
        plus("s[1]", 3, "D"),
        f"least({plus('s[2]', 3, 'D')}, CASE WHEN {low} = 's' THEN {plus('s[1]', more, 'K')} END)",
        f"least({plus('s[3]', 3, 'D')}, CASE WHEN {low} = 'u' THEN {plus(to_user, more, 'K')} END, CASE WHEN {low} <> 'x' THEN {plus(to_user, f'2 + {more}', 'R')} END)",
        f"least({plus('s[4]', 3, 'D')}, CASE WHEN {low} = 'a' THEN {plus('s[3]', more, 'K')} END, CASE WHEN {low} <> 'x' THEN {plus('s[3]', f'2 + {more}', 'R')} END)",
    ]
    user = f"list_transform([[{', '.join(rows)}]], lambda r: [r[1], r[2], least(r[3], {plus('least(r[1], r[2], r[4])', 2, 'I')}), r[4]])"
    fold = f"list_transform({user}, lambda r: [r[1], r[2], r[3], least(r[4], {plus('r[3]', 2, 'I')})])[1]"
    return rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS key FROM conversations
), n AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(key, lambda x: unicode(x)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 20 AS k FROM c
), d AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 3 THEN 2 ELSE 1 END)) FROM n WHERE k <> 0
), o AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM d
), f AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial NOT IN ('su', 'ua', 'au') AS illegal,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
      WHEN regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM o
), y AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END) WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS symbol FROM f
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (illegal) AS illegal, list_reduce(list_prepend(['000000', NULL, '000002I', '000004II'], list([symbol] ORDER BY place)), lambda s, x: {fold}) AS states FROM y GROUP BY conv_id
), b AS (SELECT *, least(states[1], states[4]) AS best FROM g
), e AS (
  SELECT conv_id, unnest(string_split(substr(best, 7), '')) AS edit, unnest(range(1, length(best) - 5)) AS i FROM b WHERE length(best) > 6
), w AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER p AS place, count(*) FILTER (edit <> 'D') OVER p AS number FROM e WINDOW p AS (PARTITION BY conv_id ORDER BY i)
), t AS (
  SELECT w.conv_id, w.edit, w.number, y.role, y.text, max(CASE WHEN w.number = 1 AND w.edit = 'K' AND y.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY w.conv_id) AS system
  FROM w LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM w.conv_id AND y.place = w.place AND w.edit <> 'I' WHERE w.edit <> 'D'
), r AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (number - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY number) AS repaired FROM t GROUP BY conv_id
), a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(substr(best, 1, 6)::BIGINT, 0) AS cost, coalesce(substr(best, 7), '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM a LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""


OP11_SQL = _op11_sql()


def op12_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return top_k(table(spark, sf_dir, "embeddings"), vector=integers(F.col("embedding"), 1024))


_VECTORS = """v AS (
  SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0{more}
)"""

OP12_SQL = (
    "WITH "
    + _VECTORS.format(label="label", scale=1024, more="")
    + """, s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.c, v.c)::BIGINT AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 10
"""
)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=label, vector=integers(F.col("embedding"), 256))


OP13_SQL = (
    "WITH "
    + _VECTORS.format(label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END", scale=256, more=" AND label IS NOT NULL")
    + """, s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS alike, list_inner_product(a.c, v.c)::BIGINT AS score FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5
"""
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_audio_features": op1_audio_features, "op2_chat_format": op2_chat_format, "op3_token_counts": op3_token_counts, "op4_warc_index": op4_warc_index, "op5_quality_classifier": op5_quality_classifier, "op6_substring_dedup": op6_substring_dedup, "op7_simhash": op7_simhash, "op8_bpe_round_trip": op8_bpe_round_trip, "op9_best_fit_packing": op9_best_fit_packing, "op10_jaccard_join": op10_jaccard_join, "op11_conversation_repair": op11_conversation_repair, "op12_block_top_k": op12_block_top_k, "op13_hard_negatives": op13_hard_negatives}
SQL: dict[str, str] = {"op2_chat_format": OP2_SQL, "op4_warc_index": OP4_SQL, "op6_substring_dedup": OP6_SQL, "op10_jaccard_join": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op12_block_top_k": OP12_SQL, "op13_hard_negatives": OP13_SQL}
