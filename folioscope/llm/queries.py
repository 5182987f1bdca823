"""The registered queries of this subpackage and their DuckDB counterparts.

Each query runs its operator with production parameters over its whole tables;
columns that only the query's contract asks for are derived here from the
operator's own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, embeddings, licenses, mixing, secrets, simhash, substrings, tokens, toxicity
from .common import UPPER, table

CONTROL_TEXT = "</s>[INST] ok [/INST]"


#: Production weights: the largest source is held to a tenth.
TARGETS: dict[str | None, int] = {"src0": 10} | {f"src{k}": 4 for k in range(1, 20)} | {mixing.SHARED: 14}


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "source", F.length("text").alias("units"), F.xxhash64("text").alias("tie"))
    return mixing.mix(docs, TARGETS, units="units", tie="tie").drop("units", "tie")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs).drop("text")
    base = secrets.of_kinds(F.col("spans"), [r.kind for r in secrets.BASE_RULES])
    counts = {f"n_{r.kind}": F.size(secrets.of_kinds(F.col("spans"), [r.kind])).cast("long") for r in secrets.BASE_RULES}
    return found.select(
        "doc_id",
        *[c.alias(name) for name, c in counts.items()],
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.find_licenses(docs).select("doc_id", "found.*")
    starts = F.transform("places", lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        licenses.labels_of(F.col("places")).alias("base_labels"),
        licenses.labels_of(F.col("places"), F.col("blocks")).alias("labels"),
        "score",
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_windows(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "found")
    return found.select("doc_id", *[c.alias(name) for name, c in decontam.findings(F.col("found")).items()])


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    """Fitted without the labels of the held-out third."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir, docs))
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.suffix_sums(tokens.length_histogram(table(spark, sf_dir, "documents")))


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    formatted = chat.format_conversations(table(spark, sf_dir, "conversations").select(*columns).unionByName(own))
    read = formatted.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_simhash": op2_simhash,
    "op3_secret_scan": op3_secret_scan,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_repeated_bytes": op9_repeated_bytes,
    "op10_chat_format": op10_chat_format,
}

_FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
_WORDS = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)
_SECRET_RULES = (
    (0, "assign", _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6"),
    (1, "access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    (2, "hex", "[0-9a-f]+", "length(m) >= 24"),
    (3, "pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"),
    (4, "hosting", "gh[oprsu]_[A-Za-z0-9]+", "length(m) >= 40"),
)


def _secret_sql() -> str:
    matches = " union all ".join(
        f"""select doc_id, k, kind, m, start_, start_ + length(m) as end_ from (
              select *, sum(length(p) + length(m)) over (partition by doc_id order by j) - length(m) as start_ from (
                select doc_id, {k} as k, '{kind}' as kind, unnest(range(1, len(ms) + 1)) as j, unnest(ms) as m, unnest(ps[1:len(ms)]) as p from (
                  select doc_id, regexp_extract_all(t, '{pattern}') as ms, string_split_regex(t, '{pattern}') as ps from d)))
            where {check}"""
        for k, kind, pattern, check in _SECRET_RULES
    )
    one = "string_agg(kind || ':' || start_::bigint || ':' || end_::bigint, ',' order by start_, k)"
    return f"""
      with d as (select doc_id, coalesce(text, '') as t from documents), m as ({matches}),
      g as (select doc_id, count(*) filter (k = 0) as a, count(*) filter (k = 1) as b, count(*) filter (k = 2) as c,
                   {one} filter (k < 3) as base, {one} as spans from m group by doc_id)
      select d.doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(b, 0)::bigint as n_access, coalesce(c, 0)::bigint as n_hex,
             sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g using (doc_id)"""


def _chat_sql() -> str:
    def esc(column: str) -> str:
        for a, b in chat.ESCAPES:
            column = f"replace({column}, '{a}', '{b}')"
        return column

    block = len(chat.START) + len(chat.SEP)
    return f"""
      with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                 union all select -1, 0, 'user', '{CONTROL_TEXT}' union all select -1, 1, 'assistant', '{CONTROL_TEXT}'),
      r as (select *, row_number() over w as pos, lag(role) over w as before from t
            window w as (partition by conv_id order by turn nulls first, {esc("role")}, {esc("text")}))
      select conv_id, count(*)::bigint as n_turns,
             sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
             coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
             sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256,
             (sum(length({esc("text")}) + case when before = role then {len(chat.JOIN)}
                  when before is null then {block} + length({esc("role")})
                  else {block + len(chat.END)} + length({esc("role")}) end) + {len(chat.END)})::bigint as formatted_chars
      from r group by conv_id"""


_DECONTAMINATION_SQL = f"""
  with d as (select doc_id, {_WORDS} as w from documents),
  i as (select item_id, w, least({decontam.WINDOW}, len(w)) as n from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
  iw as (select distinct item_id, n, array_to_string(w[s:s + n - 1], ' ') as g from (select *, unnest(range(1, len(w) - n + 2)) as s from i)),
  dw as (select doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') as g
         from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from i))),
  h as (select doc_id, s, n, item_id from dw join iw using (n, g)),
  c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + n)) as p from h) group by 1),
  x as (select doc_id, count(*) as n_items, string_agg(v, ',' order by v) as v from (select distinct doc_id, item_id::varchar as v from h) group by 1)
  select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
         sha256(coalesce(v, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
  from d left join c using (doc_id) left join x using (doc_id)"""

def _license_sql() -> str:
    """Every place and every block is tried, whatever its tokens."""
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in licenses.PHRASES)
    halves = [max(licenses.BLOCK // 2, len(t.split())) for t, _ in licenses.TEMPLATES]
    templates = ", ".join(f"(list_distinct(string_split('{t}', ' ')), '{label}', {h})" for (t, label), h in zip(licenses.TEMPLATES, halves, strict=True))
    return f"""
      with d as (select doc_id, {_WORDS} as w from documents),
      p(phrase, label, n) as (values {phrases}),
      b as (select doc_id, label, s - 1 as start_
            from (select doc_id, w, phrase, label, n, unnest(range(1, len(w) - n + 2)) as s from d, p)
            where array_to_string(w[s:s + n - 1], ' ') = phrase),
      t(tokens, label, half) as (values {templates}),
      c as (select doc_id, label, len(list_intersect(tokens, w[k * half + 1:k * half + 2 * half]))::double / len(tokens) as share
            from (select doc_id, w, tokens, label, half, unnest(range(0, greatest(1, ceil(len(w) / half))::bigint)) as k from d, t)),
      g as (select doc_id, count(*) as n, min(start_) as lo, max(start_) as hi, string_agg(distinct label, ',' order by label) as labels from b group by 1),
      m as (select doc_id, label from b union select doc_id, label from c where share >= {licenses.THRESHOLD}),
      x as (select doc_id, max(share) as share from c where share >= {licenses.THRESHOLD} group by 1),
      a as (select doc_id, string_agg(label, ',' order by label) as labels from m group by 1)
      select d.doc_id, len(w)::bigint as n_words, coalesce(g.n, 0)::bigint as n_base, g.lo::bigint as first_word, g.hi::bigint as last_word,
             coalesce(g.labels, '') as base_labels, coalesce(a.labels, '') as labels,
             greatest(case when g.n > 0 then 1.0 else 0.0 end, coalesce(x.share, 0.0))::double as score
      from d left join g using (doc_id) left join a using (doc_id) left join x using (doc_id)"""


_EMBEDDING_SQL = """
  with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
  u as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v
        where e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0),
  w as (select vec_id, list_transform(e, lambda x: x / n) as e from u where n > 0),
  l as (select a.vec_id as a, b.vec_id as b from w a, w b where a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) >= 0.95),
  r(a, c) as (select vec_id, vec_id from embeddings union select l.b, r.c from r join l on l.a = r.a),
  m as (select a as vec_id, min(c) as component_id from r group by a),
  k as (select a as vec_id, count(*) as n from l group by a)
  select vec_id, coalesce(k.n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
  from m left join k using (vec_id)"""

ORACLE_SQL: dict[str, str] = {
    "op4_embedding_dedup": _EMBEDDING_SQL,
    "op3_secret_scan": _secret_sql(),
    "op5_license_scan": _license_sql(),
    "op6_decontamination": _DECONTAMINATION_SQL,
    "op10_chat_format": _chat_sql(),
}
