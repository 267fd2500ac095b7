"""The registered queries of the operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import Query
from . import chat, decontamination, fingerprints, language_id, license_scan, line_dedup, near_dedup, periodic_runs, quality, resampling, sentence_pieces, sharding, url_filters

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None):
    def keep(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if oracle is not None:
            ORACLES[query.__name__] = oracle
        return query

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The added conversation of the contract.
PROBE = "\\### Assistant: </turn> ok"


@_query("""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), marked as (
  select *, row_number() over (partition by conv_id order by turn, role, text) as k,
    lag(role) over (partition by conv_id order by turn, role, text) as before,
    length(replace(replace(text, '<&', '<&&'), '<|', '<&|')) as text_len,
    length(replace(replace(role, '<&', '<&&'), '<|', '<&|')) as role_len
  from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(text_len + case when before = role then 8 else 23 + role_len end) as bigint) as formatted_chars,
  count(*) filter (where before is null or before <> role) as n_merged
from marked group by conv_id
""")
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    back = chat.read_back(chat.format_conversations(rows.union(added)))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_merged",
    )


@_query()
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# The fixed rules of the contract: (host, path, action).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


@_query("""
with rules(h, p, action) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
parsed as (
  select page_id, row_number() over () as k,
    translate(case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*') else '' end, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages)
select page_id, any_value(host) as host, any_value(path) as path,
  arg_max(case when h is not null then h || p end, length(h || p)) as rule,
  coalesce(arg_max(action, length(h || p)), 'allow') as verdict
from parsed left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
group by k, page_id
""")
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge(_table(spark, sf_dir, "pages"), url_filters.rules_frame(spark, RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _remainder(n: int):
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % n


@_query()
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, _table(spark, sf_dir, "labels"), _remainder(5) != 0)
    scored = quality.score(docs, model)
    held = F.coalesce(_remainder(5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query()
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    samples = language_id.learn_samples(docs.select("doc_id", "lang", "text"), _remainder(3) != 1)
    held = F.coalesce(_remainder(3) == 1, F.lit(False))
    return language_id.predict(docs.select("doc_id", "text"), samples).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@_query()
def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_fingerprints(_table(spark, sf_dir, "documents"))


@_query("""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words),
each as (select doc_id, hash(unnest(s)) as h from sets),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from each a join each b on a.h = b.h and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from pairs join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * shared >= 85 * (len(x.s) + len(y.s) - shared)),
reach(doc_id, c) as (select doc_id, doc_id from sets union select b, c from reach join links on a = doc_id where c < b)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(c) as component_id, min(c) = s.doc_id as kept
from sets s join reach r on r.doc_id = s.doc_id group by s.doc_id, s.s
""")
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query()
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


@_query()
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.find_passages(docs, _table(spark, sf_dir, "benchmark"))


# Where the public tokenizers are; a parameter of the operator.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@_query()
def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentence_pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), MODEL)
    back = sentence_pieces.decode(coded, MODEL)
    return back.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


# CRC-32 in SQL: its table by the rule of the polynomial, then a step for each byte.
CRC_TABLE = """crc as (select list(c order by i) as t from (select i,
  list_reduce(list_prepend(i::ubigint, list_transform(range(8), lambda x: x::ubigint)), lambda c, k: case when c & 1::ubigint = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as c
  from range(256) r(i)))"""


def _crc(text: str) -> str:
    each = f"list_transform(range(octet_length(encode({text}))), lambda k: ('0x' || substr(hex(encode({text})), (2 * k + 1)::integer, 2))::ubigint)"
    step = "xor(c >> 8, t[(1 + (xor(c, v) & 255::ubigint))::bigint])"
    return f"xor(list_reduce(list_prepend(4294967295::ubigint, {each}), lambda c, v: {step}), 4294967295::ubigint)::bigint"


def _edited(docs: DataFrame) -> DataFrame:
    """(doc_id, text): texts whose id has a hash divisible by ten end in a stretch that repeats with a period, as the contract says.

    Texts without words have no place ``a``; all of them stay as they are.
    """
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    rows = docs.select("doc_id", "text", h.alias("h"), words.alias("w")).withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("g % nullif(n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    times = F.expr("cast((n - a + p - 1) div p as int)")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", (F.col("a") + 1).cast("int"), F.col("p").cast("int")), times)), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    edited = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ")
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), edited).otherwise(F.col("text")).alias("text"))


@_query(f"""
with {CRC_TABLE},
split as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w, {_crc('doc_id::varchar')} as h from documents, crc),
numbers as (select *, len(w) as n, h // 10 as g, case when len(w) > 0 then (h // 10) % len(w) end as a from split),
made as (select doc_id, case when h % 10 = 0 and n > 0 then w[:a] || list_transform(range(n - a), lambda j: w[a + 1 + j % (1 + (n - a) // (3 + g % 8))]) else w end as w, n from numbers),
dictionary as (select x, row_number() over () as c from (select distinct unnest(w) as x from made)),
placed as (select doc_id, n, unnest(range(n)) as i, unnest(w) as x from made),
coded as (select doc_id, n, i, c from placed join dictionary using (x)),
equal as (select a.doc_id, a.i, b.i - a.i as q from coded a join coded b on a.doc_id = b.doc_id and a.c = b.c and b.i > a.i and b.i - a.i <= a.n // 4),
islands as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as k from equal),
stretches as (select doc_id, q, min(i) as start, count(*) + q as length from islands group by doc_id, q, k having count(*) + q >= greatest(6, 4 * q)),
runs as (select doc_id, start, length, min(q) as period from stretches group by doc_id, start, length),
summed as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as said from runs group by doc_id),
best as (select *, row_number() over (partition by doc_id order by (length::double / period) desc, start, period) as place from runs),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
kept as (select p.doc_id, string_agg(x, ' ' order by p.i) as text from placed p left join gone g on g.doc_id = p.doc_id and g.i = p.i where g.i is null group by p.doc_id)
select m.doc_id, coalesce(n_runs, 0) as n_runs, b.start, b.length, b.period, b.length * 1000 // b.period as exponent_milli,
  sha256(coalesce(said, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from made m left join summed s using (doc_id) left join best b on b.doc_id = m.doc_id and b.place = 1 left join kept k on k.doc_id = m.doc_id
""")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_edited(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    # greatest length / period by whole numbers; runs come by start and period, so the first of equals stays
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate("runs", F.lit(None).cast(found.schema["runs"].dataType.elementType), better)
    said = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@_query(f"""
with {CRC_TABLE},
texts as (select doc_id, row_number() over () as k, true as own, text from documents union all select null, row_number() over (), false, text from benchmark),
split as (select doc_id, k, own, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from texts),
each as (select k, own, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from split),
dealt as (select f, {_crc('f')} % 10000 as b from (select distinct f from each), crc),
counted as (select k, own, b, count(*) as n from each join dealt using (f) group by all),
buckets as (select b, sum(n) filter (where own) as s, sum(n) filter (where not own) as t from counted group by b),
sums as (select coalesce(sum(s), 0) as big_s, coalesce(sum(t), 0) as big_t from buckets),
gains as (select b, floor(1000 * ln(((coalesce(t, 0) + 1) * (big_s + 10000))::double / ((coalesce(s, 0) + 1) * (big_t + 10000))::double))::bigint as gain from buckets, sums),
weights as (select k, floor(sum(n * gain)::double / sum(n)::double)::bigint as weight, sum(n)::bigint as n from counted join gains using (b) where own group by k),
scored as (select doc_id, k, len(w) as n_words, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
  ('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint as h from split left join weights using (k) where own),
noisy as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from scored),
ranked as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_words >= 20) as total from noisy)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 25 * total // 100 then place end as rank from ranked
""")
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


TEMPLATES = license_scan.PHRASES + license_scan.NOTICES


@_query(f"""
with t(template, label, exact, share, grams, place, a, b) as (values {', '.join(repr(r).replace('True', 'true').replace('False', 'false') for r in license_scan.template_rows(TEMPLATES))}),
split as (select row_number() over () as k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
pairs as (select k, unnest(range(len(w) - 1)) as pos, unnest(w[:-2]) as a, unnest(w[2:]) as b from split where len(w) > 1),
hits as (select k, pos, template, label, exact, share, grams, place, pos - place as diagonal from pairs join t using (a, b)),
steps as (select *, coalesce(diagonal - lag(diagonal) over (partition by k, template order by diagonal) > case when exact then 0 else 3 end, false) as apart from hits),
spans as (select *, sum(apart::int) over (partition by k, template order by diagonal) as span from steps),
scores as (select k, template, label, exact, share, min(pos) as start, count(distinct place) / any_value(grams)::double as score from spans group by k, template, label, exact, share, span),
rows as (select k, count(*) filter (where exact and score >= share) as n_base, min(start) filter (where exact and score >= share) as first_word, max(start) filter (where exact and score >= share) as last_word,
  string_agg(distinct label, ',' order by label) filter (where exact and score >= share) as base_labels, string_agg(distinct label, ',' order by label) filter (where score >= share) as labels, max(score) as score from scores group by k)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score
from split left join rows using (k)
""")
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan.scan_licenses(_table(spark, sf_dir, "documents"), TEMPLATES)
    base = F.transform(F.filter("spans", lambda s: s["exact"]), lambda s: s["start"])
    labels = license_scan.labels_of("spans"), license_scan.labels_of("spans", exact=True)
    return scanned.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).alias("first_word"), F.array_max(base).alias("last_word"), labels[1].alias("base_labels"), labels[0].alias("labels"), "score")
